"""Secret scans over every version of every path, each distinct text scanned once per rule version.

A text is a blob, named by its SHA-256. The ledger, a Parquet folder that is only appended to, notes for each blob which rules
(kind and version) have read it and what they found. A run names the blobs of its paths, scans those texts that some rule
has not read, by these rules only, appends the outcome, and joins the findings back to all paths of a blob. So copies, moved
files and earlier runs cost no scan; a rule with a new version reads all blobs again, the others don't.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.vectors import bind
from corpusloom.llm.common import stored
from corpusloom.operators.graph import salted_join


class Rule(NamedTuple):
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters; ``literal``: what every match holds."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    literal: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The first three are the base kinds. Equal starts go in this order.
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("github", 1, r"ghp_[A-Za-z0-9]{36,}", 0, 40, "ghp_"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, "eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, "PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

FINDINGS = "array<struct<rule:string,start:bigint,end:bigint>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"
_CHUNK = 128


def _running(first: Column, values: Column) -> Column:
    """``first`` and the sums of ``first`` and the values up to each; in chunks, so that a long array takes linear time."""

    def within(start: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x)

    cuts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int"))
    parts = F.transform(cuts, lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))

    def joined(p: Column) -> Column:
        starts = within(first, F.transform(p, total))
        return F.flatten(F.zip_with(p, F.slice(starts, F.lit(1), F.size(p)), lambda part, start: F.slice(within(start, part), F.lit(1), F.size(part))))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(bind(parts, joined))


def rule_findings(text: Column, rule: Rule) -> Column:
    """Spans, in code points with an exclusive end, of a rule's leftmost matches that do not overlap; short ones are dropped."""
    pattern = F.lit(rule.pattern)

    def lengths(strings: Column) -> Column:
        return F.transform(strings, lambda x: F.length(x).cast("bigint"))

    def spans(found: Column) -> Column:
        # a match begins after all texts between matches so far and all matches before
        steps = F.zip_with(lengths(F.slice(F.split(text, rule.pattern, -1), F.lit(2), F.size(found))), lengths(found), lambda gap, m: F.coalesce(gap, F.lit(0)) + m)
        first = F.length(F.get(F.split(text, rule.pattern, 2), 0)).cast("bigint")
        value = lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))) if rule.group else lengths(found)
        rows = F.zip_with(
            F.arrays_zip(bind(steps, lambda s: _running(first, s)).alias("start"), lengths(found).alias("size")), value,
            lambda x, v: F.struct(F.lit(rule.key).alias("rule"), x["start"].alias("start"), (x["start"] + x["size"]).alias("end"), v.alias("v")),
        )
        return F.transform(F.filter(rows, lambda x: x["v"] >= rule.least), lambda x: x.dropFields("v")).cast(FINDINGS)

    none = F.array().cast(FINDINGS)
    matched = bind(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(spans(found)))
    return F.when(F.contains(text, F.lit(rule.literal)), matched).otherwise(none) if rule.literal else matched


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier runs noted; ``None`` before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the texts of ``versions`` (``blob``, ``text``) by the rules that have not read them, and append the outcome.

    The append is one Spark write: a run that ends before its commit leaves the ledger as it was, and is run again. Two runs
    at once may note the same blob twice, with equal findings, which :func:`blob_findings` reads once.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = read_ledger(versions.sparkSession, ledger)
    if seen is None:
        unread = versions.withColumn("missing", keys)
    else:
        noted = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("noted"))
        todo = versions.select("blob").distinct().join(noted, "blob", "left")
        todo = todo.select("blob", F.array_except(keys, F.coalesce("noted", F.array().cast("array<string>"))).alias("missing"))
        # only texts that some rule has not read are moved; a blob of very many copies comes from several tasks
        unread = salted_join(versions, stored(todo.filter(F.size("missing") > 0), "unread-blobs"), ["blob"], ["blob", "copy"], "inner")
    # copies of a text are combined before the shuffle
    blobs = unread.groupBy("blob").agg(F.first("text").alias("text"), F.first("missing").alias("missing"))
    found = [F.when(F.array_contains("missing", r.key), rule_findings(F.col("text"), r)).otherwise(F.array().cast(FINDINGS)) for r in rules]
    blobs.select("blob", F.col("missing").alias("rules"), F.concat(*found).alias("findings")).write.mode("append").parquet(ledger)


def blob_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, findings)`` of the blobs in which ``rules`` found something, by start, then in the order of the rules."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    noted = spark.read.schema(LEDGER).parquet(ledger).filter(F.size("findings") > 0)
    wanted = noted.select("blob", F.filter("findings", lambda x: F.array_contains(keys, x["rule"])).alias("findings"))
    once = wanted.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
    order = F.transform("findings", lambda x: F.struct(
        x["start"].alias("start"), F.array_position(keys, x["rule"]).alias("k"), x["end"].alias("end"), F.split_part(x["rule"], F.lit("@"), F.lit(1)).alias("kind")))
    return once.select("blob", F.transform(F.array_sort(order), lambda x: x.dropFields("k")).alias("findings")).filter(F.size("findings") > 0)


def scan(versions: DataFrame, ledger: str, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns, ``blob`` and ``findings`` (``start, end, kind``, by start, then kind) of every row of ``versions``.

    ``versions``: one row per path and version, with ``text``; a null text counts as empty and has no findings. ``ledger``: a
    folder that driver and executors share, kept from run to run. Repeated rows get equal findings; other columns only come
    as ``keep``; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blob = F.sha2(text.cast("binary"), 256)
    place = F.pmod(F.xxhash64(*keep) if keep else F.lit(0), F.lit(64)).alias("copy")
    update_ledger(versions.select(blob.alias("blob"), text.alias("text"), place), ledger, rules)
    paths = versions.select(*keep, blob.alias("blob"))
    salts = [c for c in keep] or ["blob"]
    found = salted_join(paths, blob_findings(versions.sparkSession, ledger, rules), ["blob"], salts)
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return found.select(*keep, "blob", F.coalesce("findings", none).alias("findings"))


def digest(findings: Column) -> Column:
    """``kind:start:end`` of the findings, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
