"""DuckDB statements that give the rows of the native queries."""

from __future__ import annotations

from corpusloom.llm import collocations, licenses, quality_rules as quality, secret_ledger as secrets, url_reputation as urls, variants
from corpusloom.llm.common import ASCII_LOWER, ASCII_UPPER


def _strings(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _tail(host: str, labels: int) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -{labels}, -1), '.')"


def _strength(child: str) -> str:
    """One row ``k``: the moment estimate over the children ``(good, n)`` of a level."""
    return f"""(
  SELECT CASE WHEN n IS NULL OR n = 0 OR g < 2 OR freedom <= g - 1 THEN {urls.MAX_STRENGTH}
    WHEN excess <= 0 THEN {urls.MAX_STRENGTH}
    ELSE least({urls.MAX_STRENGTH}, greatest({urls.MIN_STRENGTH}, 1.0 / excess - 1.0)) END AS k
  FROM (SELECT *, CASE WHEN freedom > g - 1 THEN (spread - v * (g - 1)) / (v * freedom - v * (g - 1)) ELSE 0 END AS excess
    FROM (SELECT count(*) AS g, sum(n) AS n, sum(n) - sum(n * n) / sum(n) AS freedom, sum(n * pow(good / n - root, 2)) AS spread,
      max(root * (1 - root)) AS v FROM {child}, whole)))"""


def url_filters() -> str:
    two = _strings(urls.TWO_LABEL_SUFFIXES)
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in urls.RULES)
    bound = "{m} - " + str(urls.Z) + " * sqrt({m} * (1 - {m}) / ({k} + 1))"
    return f"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
k AS (
  SELECT *, CASE WHEN {_tail("host", 2)} IN {two} THEN {_tail("host", 3)} ELSE {_tail("host", 2)} END AS domain,
    CASE WHEN {_tail("host", 2)} IN {two} THEN {_tail("host", 2)} ELSE {_tail("host", 1)} END AS suffix
  FROM (SELECT DISTINCT host FROM u)),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (
  SELECT host, good FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) AS doc_id FROM u)
  JOIN good USING (doc_id)),
hosts AS (SELECT host, domain, suffix, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS n FROM o JOIN k USING (host) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
whole AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS root FROM suffixes),
ks AS {_strength("suffixes")}, kd AS {_strength("domains")}, kh AS {_strength("hosts")},
s AS (SELECT suffix, (root * k + good) / (n + k) AS m, n + k AS strength FROM suffixes, whole, ks),
d AS (SELECT domain, (m * k + good) / (domains.n + k) AS m, domains.n + k AS strength FROM domains JOIN s USING (suffix), kd),
h AS (SELECT host, (m * k + good) / (hosts.n + k) AS m, hosts.n + k AS strength FROM hosts JOIN d USING (domain), kh),
b AS (
  SELECT host, coalesce({bound.format(m="h.m", k="h.strength")}, {bound.format(m="d.m", k="d.strength")},
    {bound.format(m="s.m", k="s.strength")}, {bound.format(m="root", k="ks.k")}) AS bound
  FROM k LEFT JOIN h USING (host) LEFT JOIN d ON d.domain = k.domain LEFT JOIN s ON s.suffix = k.suffix, whole, ks),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {rules}),
fit AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, CASE WHEN bound >= {urls.MIN_GOOD} THEN 'allow' ELSE 'block' END) AS verdict
FROM u JOIN b ON b.host = u.host LEFT JOIN fit ON fit.host = u.host AND fit.path = u.path
"""


def quality_rules() -> str:
    counts = {
        "lower": "[a-z]", "upper": "[A-Z]", "letter": "[\\p{L}]", "digit": "[0-9]", "blank": "[\\x20\\x09-\\x0D]",
        "point": "[-.,;:!?''\\x22()]", "symbol": "[#*$%&|<>]",
    }
    sizes = {k: f"(length(t) - length(regexp_replace(t, '{v}', '', 'g')))" for k, v in counts.items()}
    sizes["letter"] = f"({sizes['letter']} - {sizes['lower']} - {sizes['upper']})"
    sizes["other"] = "length(t) - " + " - ".join(sizes[c] for c in quality.CHAR_CLASSES if c != "other")
    classes = ", ".join(f"('{c}', {sizes[c]})" for c in quality.CHAR_CLASSES)
    term = "(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"
    short = "sqrt(greatest(1, n_words))"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS MATERIALIZED (SELECT r, i, w[i:i+2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed
  FROM (SELECT r, doc_id, lang, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {sizes["symbol"]}::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))),
hist AS MATERIALIZED (
  SELECT r, lang, base_failed, c.cls, c.n FROM (SELECT *, unnest([{", ".join(f"{{cls: '{c}', n: {sizes[c]}}}" for c in quality.CHAR_CLASSES)}]) AS c FROM base)),
common AS MATERIALIZED (
  SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) WHERE word IN {_strings(quality.COMMON_WORDS)} GROUP BY ALL),
langs AS (
  SELECT lang FROM base WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang
  HAVING count(*) >= {quality.MIN_SHARE} * (SELECT count(*) FROM base WHERE lang IS NOT NULL AND NOT base_failed)),
refc AS (
  SELECT lang, cls, sum(m) / sum(sum(m)) OVER (PARTITION BY lang) AS q
  FROM (SELECT *, CAST(floor(n * {quality.MILLION} / sum(n) OVER (PARTITION BY r)) AS BIGINT) AS m FROM hist) SEMI JOIN langs USING (lang)
  WHERE NOT base_failed GROUP BY lang, cls),
refw AS (
  SELECT lang, word, sum(m) / sum(sum(m)) OVER (PARTITION BY lang) AS q
  FROM (SELECT *, CAST(floor(n * {quality.MILLION} / sum(n) OVER (PARTITION BY r)) AS BIGINT) AS m FROM common) JOIN base USING (r) SEMI JOIN langs USING (lang)
  WHERE NOT base_failed GROUP BY lang, word),
dc AS (
  SELECT r, refc.lang, sqrt(greatest(0, sum({term})) / 2) AS cd
  FROM (SELECT r, cls, n / sum(n) OVER (PARTITION BY r) AS p FROM hist) JOIN refc USING (cls) GROUP BY r, refc.lang),
dw AS (
  SELECT r, lang, sqrt(greatest(0, sum({term.replace("q", "coalesce(q, 0)")}) + greatest(0, 1 - sum(coalesce(q, 0)))) / 2) AS wd
  FROM (SELECT r, word, l.lang, n / sum(n) OVER (PARTITION BY r, l.lang) AS p FROM common, (SELECT DISTINCT lang FROM refw) l)
    LEFT JOIN refw USING (lang, word) GROUP BY r, lang),
near AS (
  SELECT r, bool_or((length(t) < {quality.MIN_JUDGED_CHARS} OR cd <= {quality.MAX_CHAR_DISTANCE} + {quality.CHAR_NOISE} / {short})
    AND (length(t) < {quality.MIN_JUDGED_CHARS} OR n_words < {quality.MIN_JUDGED_WORDS} OR coalesce(wd, 1) <= {quality.MAX_WORD_DISTANCE} + {quality.WORD_NOISE} / {short})) AS ok
  FROM dc JOIN base USING (r) LEFT JOIN dw ON dw.r = base.r AND dw.lang = dc.lang GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (near.r IS NULL OR ok) AS kept
FROM base LEFT JOIN near USING (r)
"""


def license_scans() -> str:
    rows = ", ".join(
        f"({n}, '{t.label}', {t.exact}, {o}, '{w}', {o in t.key_range}, {len(t.words)})"
        for n, t in enumerate(licenses.TEMPLATES) for o, w in enumerate(t.words)
    )
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{licenses.WORD}') AS w
  FROM documents),
tw(tpl, label, exact, off, word, in_key, size) AS (VALUES {rows}),
hits AS MATERIALIZED (
  SELECT r, pos, word FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM tw)),
weights AS (
  SELECT word, greatest(1, round({licenses.SCALE} * ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1))))::BIGINT AS weight
  FROM (SELECT DISTINCT word FROM tw) LEFT JOIN (SELECT word, count(DISTINCT r) AS df FROM hits GROUP BY word) USING (word)),
anchors AS (
  SELECT tpl, word FROM (SELECT DISTINCT tpl, exact, word, weight FROM tw JOIN weights USING (word))
  QUALIFY row_number() OVER (PARTITION BY tpl ORDER BY weight DESC, word) <= CASE WHEN exact THEN 1 ELSE {licenses.ANCHORS} END),
t AS (SELECT tw.*, weight, anchors.word IS NOT NULL AS anchor, sum(weight) OVER (PARTITION BY tpl) AS total, count(*) FILTER (in_key) OVER (PARTITION BY tpl) AS key_size
  FROM tw JOIN weights USING (word) LEFT JOIN anchors USING (tpl, word)),
places AS (
  SELECT r, tpl, label, exact, pos - off AS start, sum(weight) / max(total) AS score, count(*) FILTER (in_key) = max(key_size) AS key_found, count(*) = max(size) AS whole
  FROM hits JOIN t USING (word) GROUP BY ALL HAVING bool_or(anchor) AND (count(*) = max(size) OR NOT exact)),
found AS (
  SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (key_found AND score >= {licenses.MIN_SCORE}) AS labels, max(score) AS score
  FROM places GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)
"""


def collocations_of(order: int, min_count: int, top: int) -> str:
    longer = " UNION ALL ".join(f"SELECT lang, w[i:i+{k - 1}] AS w FROM places WHERE len(w[i:i+{k - 1}]) = {k}" for k in range(1, order + 1))
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.NO_LANGUAGE}') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
places AS MATERIALIZED (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
counts AS MATERIALIZED (
  SELECT lang, w, count(*) AS f FROM ({longer}) GROUP BY ALL HAVING count(*) >= {min_count}),
cuts AS (
  SELECT c.lang, c.w, c.f AS a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS k FROM counts WHERE len(w) > 1) c
    JOIN counts x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN counts y ON y.lang = c.lang AND y.w = c.w[k+1:] JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, w[s:s+m-1] AS w, max(f) AS f
  FROM (SELECT lang, w, f, m, unnest(generate_series(1, len(w) - m + 1)) AS s
    FROM (SELECT lang, w, f, unnest(generate_series(2, len(w) - 1)) AS m FROM counts WHERE len(w) > 2))
  GROUP BY ALL),
kept AS (
  SELECT weakest.* FROM weakest LEFT JOIN inner_of i ON i.lang = weakest.lang AND i.w = weakest.w
  WHERE i.f IS NULL OR 100 * i.f < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM kept QUALIFY rank <= {top}
"""


def secret_scans() -> str:
    kinds = ", ".join(f"({k}, '{r.kind}', '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.least})" for k, r in enumerate(secrets.RULES))
    values = " ".join(f"WHEN {k} THEN regexp_extract_all(t, p, {r.group})" for k, r in enumerate(secrets.RULES))
    base = _strings(secrets.BASE_KINDS)
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k)"
    count = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in secrets.BASE_KINDS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, kind, p, least) AS (VALUES {kinds}),
hits AS (
  SELECT r, k, kind, least, regexp_extract_all(t, p) AS m, CASE k {values} END AS v, regexp_split_to_array(t, p) AS gaps
  FROM d, kinds WHERE regexp_matches(t, p)),
spans AS (
  SELECT *, start + length(m) AS stop FROM (
    SELECT r, k, kind, least, m[i] AS m, v[i] AS v,
      (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM hits))
  WHERE length(v) >= least),
found AS (SELECT r, {count}, {joined} FILTER (kind IN {base}) AS base, {joined} AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in secrets.BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (r)
"""


def spelling_variants() -> str:
    step = "CASE WHEN {c} % 2 = 1 THEN xor({c} // 2, 3988292384) ELSE {c} // 2 END"
    table = "c"
    for _ in range(8):
        table = f"(SELECT i, {step.format(c='c')} AS c FROM {table})" if table != "c" else f"(SELECT i, {step.format(c='c')} AS c FROM (SELECT i, i AS c FROM range(256) t(i)))"
    letters = "A-Za-z\u00C0-\u00FF"
    return f"""
WITH RECURSIVE bytes AS MATERIALIZED (SELECT list(c::BIGINT ORDER BY i) AS crc FROM {table}),
runs AS (
  SELECT doc_id, translate(run, '{ASCII_UPPER}', '{ASCII_LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{letters}]{{{variants.LEAST_LENGTH},}}')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda s, x: xor(s // 256, crc[(xor(s, x) % 256) + 1])), 4294967295) AS h
  FROM coded, bytes),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % {variants.DROP_ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {variants.LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM w)),
pairs AS (
  SELECT less.word AS a, w.word AS b FROM less JOIN w ON w.word = less.rest
  UNION SELECT w.word, less.word FROM less JOIN w ON w.word = less.rest
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
near AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, struct_pack(m := -w.n, b := b)) AS best, max(w.n) AS best_n
  FROM pairs JOIN w ON w.word = b GROUP BY a),
led AS MATERIALIZED (
  SELECT word, CASE WHEN best_n >= {variants.FORM_FACTOR} * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN best_n >= {variants.FORM_FACTOR} * n THEN best_n END AS form_n
  FROM w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS here FROM led
  UNION ALL SELECT walk.word, led.form FROM walk JOIN led ON led.word = walk.here WHERE led.form IS NOT NULL)
SELECT led.word, form, here AS root, n, n_near, form_n
FROM led JOIN (SELECT walk.word, here FROM walk JOIN led ON led.word = walk.here WHERE led.form IS NULL) e ON e.word = led.word
"""
