"""Whether a source file can be parsed: Python's own parser, file by file in Arrow batches."""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column, functions as F

PROBLEM = "struct<error_type:string,message:string>"
_ARROW = pa.struct([("error_type", pa.string()), ("message", pa.string())])


def _python_problem(text: str | None) -> dict | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text or "")
    except SyntaxError as e:
        return {"error_type": "SyntaxError", "message": f"Line {e.lineno}: {e.msg}" if e.lineno else e.msg}
    except (ValueError, RecursionError, MemoryError) as e:
        return {"error_type": type(e).__name__, "message": str(e)}
    return None


def parse_problem(content: Column, language: Column) -> Column:
    """``PROBLEM`` of a Python file that the running Python's parser rejects, else null.

    Script files are never rejected: what is extracted from them stands between errors, too.
    """
    @F.arrow_udf(PROBLEM)
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        found = [_python_problem(t.as_py()) if g.as_py() == "Python" else None for t, g in zip(texts, languages)]
        return pa.array(found, _ARROW)

    return run(content, language)
