"""URL filter: explicit rules, and beyond them an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. A host's rate is shrunk through beta-binomial priors: the whole table gives
the prior of a suffix, the suffix that of a registered domain, the domain that of a host. Prior strengths are moment
estimates of how much the children of a level differ. A page without a rule is allowed if the lower bound of its host's
posterior reaches ``min_good``. Only counts are shuffled; the pages meet the table of hosts in one salted join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import ascii_lower, stored
from corpusloom.operators.graph import salted_join

#: (verdict, host/path); a rule holds for its host and all subdomains where the path starts with the rule's path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels under which names are registered; all other suffixes have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.za", "com.mx")
#: Rules become one CASE expression; a longer list belongs in a joined table.
MAX_RULES = 500

MIN_GOOD = 0.5
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found


def host_reputation(outcomes: DataFrame, z: float = Z) -> tuple[dict[str, DataFrame], float]:
    """Posterior of every host, domain and suffix with a labelled page, and the bound of a suffix never seen.

    ``outcomes``: ``host``, ``good`` (0/1). Each frame holds the level's key, ``good``, ``n``, ``mean`` and ``bound``
    (``mean - z * standard deviation`` of the beta posterior). Rows with a null host or outcome are left out. Only the
    four level totals, one row each, reach the driver; the host counts are written once to the shared folder.
    """
    hosts = (
        outcomes.filter(F.col("host").isNotNull() & F.col("good").isNotNull())
        .groupBy("host")
        .agg(F.sum(F.col("good").cast("double")).alias("good"), F.count("*").cast("double").alias("n"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    hosts = stored(hosts, "host-outcomes")
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    domains = hosts.groupBy("domain").agg(*sums, F.first("suffix").alias("suffix"))
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()
    total, good = (whole.n or 0.0), (whole.good or 0.0)
    root = (good + 1.0) / (total + 2.0)
    strength = {level: _strength(frame, root) for level, frame in zip(LEVELS, (suffixes, domains, hosts))}

    def posterior(df: DataFrame, prior: Column, k: float) -> DataFrame:
        mean = (prior * k + F.col("good")) / (F.col("n") + k)
        return df.withColumn("mean", mean).withColumn("bound", _bound(F.col("mean"), F.col("n") + k, z))

    s = posterior(suffixes, F.lit(root), strength["suffix"])
    d = posterior(domains.join(s.select("suffix", F.col("mean").alias("prior")), "suffix"), F.col("prior"), strength["domain"])
    h = posterior(hosts.join(d.select("domain", F.col("mean").alias("prior")), "domain"), F.col("prior"), strength["host"])
    unseen = root - z * (root * (1.0 - root) / (strength["suffix"] + 1.0)) ** 0.5
    return {"suffix": s, "domain": d.drop("prior", "suffix"), "host": h.drop("prior", "domain", "suffix")}, unseen


def _strength(children: DataFrame, mean: float) -> float:
    """Moment estimate of the beta prior's strength from the spread of the children's rates about the common mean."""
    row = children.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread"),
    ).first()
    if not row.n or row.g < 2:
        return MAX_STRENGTH
    variance = mean * (1.0 - mean)
    freedom = row.n - row.nn / row.n
    excess = (row.spread - variance * (row.g - 1)) / (variance * freedom - variance * (row.g - 1)) if freedom > row.g - 1 else 0.0
    return min(MAX_STRENGTH, max(MIN_STRENGTH, 1.0 / excess - 1.0)) if excess > 0 else MAX_STRENGTH


def _bound(mean: Column, strength: Column, z: float) -> Column:
    return mean - F.lit(z) * F.sqrt(mean * (1.0 - mean) / (strength + 1.0))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_good: float = MIN_GOOD, z: float = Z
) -> DataFrame:
    """``page_id, host, path, rule, bound, verdict`` for every row of ``pages(page_id, url)``.

    ``outcomes``: ``host``, ``good``. A null url, or one without ``://``, has an empty host and path and no rule; an
    empty or never labelled host takes the bound of its domain, then its suffix, then the whole table. Without any
    outcome the prior is one half with the largest strength, so its bound is under ``min_good`` and pages without a rule
    are blocked. Repeated rows stay, other columns of ``pages`` are not returned.
    """
    levels, unseen = host_reputation(outcomes, z)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    known = judged.select("host").distinct()
    known = known.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for level in LEVELS:
        known = known.join(levels[level].select(level, F.col("bound").alias(f"{level}_bound")), level, "left")
    known = known.select("host", F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(unseen)).alias("bound"))
    by_rule = dict((rule, verdict) for verdict, rule in rules)
    verdict = F.when(F.col("bound") >= min_good, "allow").otherwise("block")
    for rule, fixed in by_rule.items():
        verdict = F.when(F.col("rule") == rule, fixed).otherwise(verdict)
    return salted_join(judged, known, ["host"], ["page_id"], "inner").select("page_id", "host", "path", "rule", "bound", verdict.alias("verdict"))


def document_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages rendered from a labelled document: the number in the path is the document's id."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:[./]|$)", 1)
    ids = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("bigint")).alias("doc_id"))
    good = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    return ids.filter("doc_id is not null").join(good, "doc_id").select("host", "good")
