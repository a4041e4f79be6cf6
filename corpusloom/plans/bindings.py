"""Logical tables built from the driver tables.

``corpus`` is the documents table as files. The code-shaped tables (modules, traces, logs, coverage reports, answers,
review output) are derived from the driver tables by Spark, one or more rows per input row, so their size follows the
input. The SQL twins below state the same derivations for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.sources import corpus as src

VECTOR_COLLECTIONS = 4


# Text-heavy tables and the key their rows are spread by when the table comes in too few files.
_SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A text table in fewer files than there are cores is one row group, hence one task, per file; its
    rows are spread by id before the text work. A table in many files is read as it is, without that shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _SPREAD_KEYS and len(df.inputFiles()) < cores:
        return df.repartition(cores, _SPREAD_KEYS[name])
    return df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as source files: one repository per source."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("text").alias("content"),
        F.col("lang"),
        F.col("doc_id"),
    )


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus with its language (none for plain text) and line array; the size gate is a query of its own."""
    return src.with_lines(src.with_language(corpus(spark, sf_dir)))


CORPUS_SQL = """corpus AS (
  SELECT source AS repo, lang || '/' || source || '/' || doc_id || '.txt' AS path,
         CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, text AS content, lang, doc_id
  FROM documents)"""

# Lines as Python splitlines gives them; the driver documents break lines with newlines only.
LINES_SQL = CORPUS_SQL + """, split AS (
  SELECT *, CASE WHEN content = '' THEN []
                 WHEN right(content, 1) = chr(10) THEN string_split(left(content, length(content) - 1), chr(10))
                 ELSE string_split(content, chr(10)) END AS lines
  FROM corpus), line_table AS (
  SELECT repo, path, lang, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM split)"""

# The characters Python's strip() removes, as a SQL expression.
WS_SQL = "(' ' || " + " || ".join(
    f"chr({n})" for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                          0x202F, 0x205F, 0x3000)
) + ")"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a vector table; the label is the entity type and ``label % 4`` the collection."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), (F.col("label") % VECTOR_COLLECTIONS).cast("string")).alias("collection"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("embedding"),
        F.lit("table-64").alias("model"),
        F.size("embedding").alias("dimension"),
        F.concat(F.lit("type"), F.col("label").cast("string")).alias("entity_type"),
        F.lit(1).cast("long").alias("version"),
        F.col("vec_id"),
    )


VECTORS_SQL = """vectors AS (
  SELECT 'c' || (label % 4) AS collection, CAST(vec_id AS VARCHAR) AS chunk_id, embedding, 'table-64' AS model,
         len(embedding) AS dimension, 'type' || label AS entity_type, CAST(1 AS BIGINT) AS version, vec_id
  FROM embeddings)"""


# --- derived code corpus ---------------------------------------------------------------------------------------------
#
# Every document gives one module: a Python file for even ids, a TypeScript file for odd ids. The frame of the module is
# fixed text with the id filled in (a third of the Python files run a shell), and all lines of the document follow as comment lines. Repository r<id % 5>.

PY_MODULE = '''"""Module {k} of the service."""
import os
import json as js
from app.m{k10} import login_{k10}
from .m{k20} import helper_{k20}, other_{k20}
from fastapi import APIRouter

API_KEY = os.getenv("SERVICE_KEY_{k7}")
router = APIRouter()


class Service{k}(Base):
    """Service number {k}."""

    def __init__(self, size):
        self.size = size

    def run(self, a, b, c, d, e):
        for x in a:
            if x > b and c:
                while d:
                    if e:
                        c = eval(x)
        return js.dumps(a)


@router.get("/items/{k}")
async def login_{k}(name: str, limit=10) -> dict:
    """Load items."""
    try:
        return helper_{k20}(name)
    except Exception:
        pass


def _verify_{k}(value):
    password = "pw{k}-hunter-{k7}"
    digest = hashlib.md5(value)
    cursor.execute("SELECT a FROM t WHERE id = %s" % value)
    requests.get(value, verify=False)
    data = pickle.loads(value)
    conf = yaml.load(value)
    safe = yaml.load(value, Loader=yaml.SafeLoader)
    os.system("ls")
    exec(value)
    ctx = ssl._create_unverified_context()
    key = hashlib.sha1(value, usedforsecurity=False)
    return subprocess.run(value, shell=True)


def deploy_{k}(
    target: str,
    options: dict = {{"mode": "(", "n": {k7}}},
) -> dict:
    """Deploys to a target."""
    subprocess.run(
        target,
        shell={kflag},
    )
    requests.get(target,
                 verify=False)
    conf = yaml.load(target,
                     Loader=yaml.SafeLoader)
    return conf


'''

TS_MODULE = '''// component {k}
import {{ api{k10}, format }} from './c{k10}';
import React from 'react';

export interface Props{k} {{
  title: string;
}}

export type Id{k} = string | number;

/* block comment
   of component {k}
*/
export class Widget{k} {{
  render(a: string): string {{
    if (a && this.ready) {{
      return eval(a);
    }}
    return a ? a : "";
  }}
}}

export function format{k}(x) {{
  const apiToken{k7} = "tok{k}-abcdefgh";
  const api_key{k7} = "key{k}-abcdefgh";
  return crypto.createHash('md5').update(x).digest();
}}

const fetch{k} = async (url: string) => {{
  return get(url, {{ rejectUnauthorized: false }});
}};

app.get("/web/{k}", fetch{k});
const home = process.env.HOME_{k7};

export async function load{k}(
  url: string,
  done: (e: Error, n: number) => void,
): Promise<{{ id: number }}> {{
  return done(url);
}}

export const save{k} = async (
  id: number,
): Promise<void> => {{
  await put(id);
}};
'''

# Lines of the frames, with the first comment line of the document's text left out.
PY_LINES, TS_LINES = PY_MODULE.count("\n"), TS_MODULE.count("\n")


def _fill(template: str):
    """The template as a concat over the id columns."""
    import re

    pieces = []
    for part in re.split(r"(\{k\w*\})", template):
        name = part[1:-1] if re.fullmatch(r"\{k\w*\}", part) else None
        pieces.append(F.col(name) if name else F.lit(part.replace("{{", "{").replace("}}", "}")))
    return F.concat(*pieces)


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived modules as source files (``repo, path, size_bytes, content, doc_id``)."""
    d = F.col("doc_id")
    python = d % 2 == 0
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", d.cast("string").alias("k"), (d + 10).cast("string").alias("k10"),
        (d + 20).cast("string").alias("k20"), (d % 7).cast("string").alias("k7"),
        F.when(d % 3 == 0, F.lit("True")).otherwise(F.lit("False")).alias("kflag"),
    )
    notes = F.replace(F.col("text"), F.lit("\n"), F.when(python, F.lit("\n# ")).otherwise(F.lit("\n// ")))
    content = F.when(python, F.concat(_fill(PY_MODULE), F.lit("# "), notes, F.lit("\n"))).otherwise(
        F.concat(_fill(TS_MODULE), F.lit("// "), notes, F.lit("\n"))
    )
    files = docs.select(
        F.concat(F.lit("r"), (d % 5).cast("string")).alias("repo"),
        F.when(python, F.concat(F.lit("app/m"), "k", F.lit(".py")))
        .otherwise(F.concat(F.lit("web/c"), "k", F.lit(".ts"))).alias("path"),
        content.alias("content"),
        "doc_id",
    )
    return files.withColumn("size_bytes", F.octet_length("content").cast("long"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived modules with language and line array."""
    return src.with_lines(src.code_files(code_corpus(spark, sf_dir)))


CODE_SQL = """mods AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, 'r' || (doc_id % 5) AS repo, doc_id % 2 = 0 AS is_py,
         CASE WHEN doc_id % 2 = 0 THEN 'app/m' || doc_id || '.py' ELSE 'web/c' || doc_id || '.ts' END AS path,
         doc_id % 7 AS k7, doc_id + 10 AS k10, doc_id + 20 AS k20, text
  FROM documents)"""


