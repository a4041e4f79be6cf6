"""Text columns with Python string semantics (splitlines, strip, half-even rounding)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes and the boundaries str.splitlines() splits on.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RARE_BREAKS = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
ANY_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

CHARS_PER_TOKEN = 3.8
MAX_TRACE_CHARS = 15_000
MAX_REVIEW_CHARS = 24_000
MAX_MESSAGE_CHARS = 500
MAX_MANIFEST_CHARS = 4_000


def strip(c: Column) -> Column:
    """Python ``str.strip()``: every Unicode whitespace character, not only blanks."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def split_lines(c: Column) -> Column:
    """Python ``str.splitlines()``: all its boundaries, and no empty element after a final one.

    Text with only newline breaks (nearly all of it) takes the single-character split, which needs no regex engine.
    """
    body = (
        F.when(c.endswith("\r\n"), F.left(c, F.char_length(c) - 2))
        .when(F.right(c, F.lit(1)).rlike("^(?:" + ANY_BREAK + ")$"), F.left(c, F.char_length(c) - 1))
        .otherwise(c)
    )
    return (
        F.when(c == "", F.array().cast("array<string>"))
        .when(c.rlike(RARE_BREAKS), F.split(body, ANY_BREAK, -1))
        .otherwise(F.split(body, "\n", -1))
    )


def bround(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def estimate_tokens(c: Column) -> Column:
    """0 for empty text, else at least 1: characters / 3.8 rounded half-even."""
    return F.when(F.coalesce(F.char_length(c), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.bround(F.char_length(c) / F.lit(CHARS_PER_TOKEN), 0).cast("int"))
    )


def truncate(c: Column, limit: int, marker: str = "") -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(marker))).otherwise(c)


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def context_header(
    path: Column,
    name: Column,
    entity_type: Column,
    start: Column,
    end: Column,
    parent: Column | None = None,
    signature: Column | None = None,
) -> Column:
    """``File: … | Scope: … | Type: … | Lines: a-b | Signature: …`` with the empty parts left out."""
    none = F.lit(None).cast("string")
    parent, signature = (none if parent is None else parent), (none if signature is None else signature)
    return F.concat_ws(
        " | ",
        F.concat(F.lit("File: "), path),
        F.concat(F.lit("Scope: "), F.nullif(parent, F.lit(""))),
        F.concat(title_case(entity_type), F.lit(": "), name),
        F.concat(F.lit("Lines: "), start.cast("string"), F.lit("-"), end.cast("string")),
        F.concat(F.lit("Signature: "), F.nullif(signature, F.lit(""))),
    )


def chunk_id(repo: Column, path: Column, name: Column, start: Column, end: Column, parent: Column | None = None) -> Column:
    """``repo:path#[parent.]name#La-Lb``: a table holds many repositories, and paths repeat among them."""
    scope = (
        F.lit("")
        if parent is None
        else F.coalesce(F.concat(F.nullif(parent, F.lit("")), F.lit(".")), F.lit(""))
    )
    return F.concat(
        repo, F.lit(":"), path, F.lit("#"), scope, name, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string")
    )


def embedding_text(
    path: Column, entity_type: Column, name: Column, code: Column,
    parent: Column | None = None, signature: Column | None = None, docstring: Column | None = None,
) -> Column:
    def labelled(label: str, c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else F.concat(F.lit(label), F.nullif(c, F.lit("")))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        labelled("Scope: ", parent),
        F.concat(F.lit("Entity: "), entity_type, F.lit(" "), name),
        labelled("Signature: ", signature),
        labelled("Documentation: ", docstring),
        F.concat(F.lit("Code:\n"), code),
    )


def numbered_snippet(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start..end`` of a line array, each as a 4-wide number, `` | `` and the text."""
    first = start.cast("int")
    part = F.slice(lines, first, F.greatest(F.lit(0), end.cast("int") - first + 1))
    return F.array_join(
        F.transform(part, lambda t, i: F.concat(number_prefix(first + i), t)), "\n"
    )


def number_prefix(n: Column) -> Column:
    text = n.cast("string")
    return F.concat(F.when(F.length(text) < 4, F.lpad(text, 4, " ")).otherwise(text), F.lit(" | "))


def context_window(target: Column, total: Column, pad: int = 15, head: int = 50) -> tuple[Column, Column]:
    """Start and end of the lines shown around ``target``; the first ``head`` lines where there is no valid target."""
    valid = target.isNotNull() & (target >= 1) & (target <= total)
    start = F.when(valid, F.greatest(F.lit(1), target - pad)).otherwise(F.lit(1))
    end = F.when(valid, F.least(total, target + pad)).otherwise(F.least(total, F.lit(head)))
    return start.cast("int"), end.cast("int")


def brace_depth(c: Column) -> Column:
    """Deepest ``{`` nesting of a text, with the running depth floored at 0 on ``}``.

    Everything but braces is removed first, so the fold runs over the braces alone.
    """
    braces = F.regexp_replace(c, "[^{}]", "")
    chars = F.filter(F.split(braces, ""), lambda x: x != "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top")),
        lambda s, ch: F.struct(
            F.when(ch == "{", s["cur"] + 1).otherwise(F.greatest(F.lit(0), s["cur"] - 1)).alias("cur"),
            F.when(ch == "{", F.greatest(s["top"], s["cur"] + 1)).otherwise(s["top"]).alias("top"),
        ),
    )
    return state["top"]


# Branch patterns of brace-style languages.
BRANCH_PATTERNS = (
    r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\&\&", r"\|\|", r"\?\?", r"\?[^.]",
)


def branch_complexity(c: Column) -> Column:
    """1 + the matches of the nine branch patterns, each counted on its own (matches may overlap across patterns)."""
    total = F.lit(1)
    for pattern in BRANCH_PATTERNS:
        total = total + F.regexp_count(c, F.lit(pattern))
    return total


def json_from_free_text(c: Column, schema: str) -> Column:
    """A JSON object inside free text: fenced block, else the whole text, else first ``{`` to last ``}``; else null."""
    text = strip(c)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    def parse(x: Column) -> Column:
        # A permissive parse marks a broken record, which is turned into null.
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
        checked = F.from_json(x, schema + ", _broken string", options)
        return F.when(checked["_broken"].isNull(), checked)

    return F.coalesce(parse(fenced), parse(F.when(text.startswith("{"), text)), parse(outer))


def citation_tags(c: Column) -> Column:
    """``S<n>`` of every ``[S<n>]`` in text order."""
    return F.regexp_extract_all(c, F.lit(r"\[(S\d+)\]"), F.lit(1))


UNCONFIRMED_DEFAULT = "Configuration or command requiring verification"


def unverified_markers(c: Column) -> Column:
    """Sorted distinct details of confirmation tags and of TODO-like notes (the latter cut at 100 characters)."""
    tags = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?i)(\[Requires Confirmation(?::\s*[^\]]+)?\])"), F.lit(1)),
        lambda t: F.when(
            F.regexp_extract(t, r"(?i)^\[Requires Confirmation:\s*([^\]]+)\]$", 1) != "",
            strip(F.regexp_extract(t, r"(?i)^\[Requires Confirmation:\s*([^\]]+)\]$", 1)),
        ).otherwise(F.lit(UNCONFIRMED_DEFAULT)),
    )
    notes = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?i)\b(?:TODO|FIXME|TBD|PLACEHOLDER)\b:?\s*([^\n]+)"), F.lit(1)),
        lambda t: F.left(strip(t), F.lit(100)),
    )
    return F.array_sort(F.array_distinct(F.concat(tags, notes)))
