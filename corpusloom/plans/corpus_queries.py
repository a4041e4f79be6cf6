"""Corpus scan queries: totals, histograms, trees, path and URL columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.operators import stats
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.session import shared_folder
from corpusloom.sources import corpus as src, tree


@query("corpus_totals", "SRC1 AGG1", f"""
WITH {b.CORPUS_SQL}, parts AS (SELECT repo, string_split(path, '/') AS p FROM corpus),
dirs AS (SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS dir FROM parts, generate_series(1, 8) g(i) WHERE i < len(p))
SELECT c.repo, count(*) AS total_files, any_value(d.n) AS total_directories,
       CAST(sum(c.size_bytes) AS BIGINT) AS total_size_bytes
FROM corpus c JOIN (SELECT repo, count(*) AS n FROM dirs GROUP BY repo) d USING (repo) GROUP BY c.repo""")
def corpus_totals(spark, sf):
    return stats.corpus_totals(b.corpus(spark, sf))


@query("scan_gate", "SRC4 AGG13", f"""
WITH {b.CORPUS_SQL}, f AS (
  SELECT repo, CASE WHEN size_bytes > 4096 THEN 'too_large' WHEN size_bytes = 0 THEN 'empty' END AS r FROM corpus)
SELECT repo, count(*) AS files_discovered, count(*) FILTER (WHERE r IS NULL) AS files_analyzed,
       count(*) FILTER (WHERE r IS NOT NULL) AS files_skipped FROM f GROUP BY repo""")
def scan_gate(spark, sf):
    return stats.scan_stats(src.with_skip_reason(b.corpus(spark, sf), max_bytes=4096, skip_empty=True))


# The driver documents are all kept by pruning, so file names that exercise every branch are derived from their ids.
_NAMES = (
    "src/main{}.py", "node_modules/p{}/x.js", "Build/out{}.ts", "lib/a{}.min.js", "img/logo{}.PNG", ".hidden/s{}.py",
    "docs/README.md", "Dockerfile.v{}", "chroma_db/d{}.json", "pkg{}/Makefile", "conf{}/.env", "a{}/b.unknown",
    "web/v{}.tsx", "c{}/x.tar.gz",
)


def _named(spark, sf):
    d = F.col("doc_id")
    column = None
    for i, n in enumerate(_NAMES):
        head, tail = n.split("{}") if "{}" in n else (n, "")
        value = F.concat(F.lit(head), d.cast("string"), F.lit(tail)) if "{}" in n else F.lit(n)
        column = F.when(d % len(_NAMES) == i, value) if column is None else column.when(d % len(_NAMES) == i, value)
    return b.table(spark, sf, "documents").select("doc_id", column.alias("path"))


_NAMED_SQL = "named AS (SELECT doc_id, CASE doc_id % %d %s END AS path FROM documents)".replace("%d", str(len(_NAMES))).replace(
    "%s", " ".join(f"WHEN {i} THEN replace('{n}', '{{}}', CAST(doc_id AS VARCHAR))" for i, n in enumerate(_NAMES))
)


@query("pruned_files", "SRC2 SRC3", f"""
WITH {_NAMED_SQL}, seg AS (SELECT doc_id, path, string_split(path, '/')[:-2] AS dirs, lower(string_split(path, '/')[-1]) AS nm FROM named),
f AS (SELECT doc_id, path,
  len(list_filter(dirs, lambda s: lower(s) IN ('node_modules', 'build'))) > 0 AS scan_dir,
  len(list_filter(dirs, lambda s: s IN ('node_modules', 'build') OR s LIKE '.%')) > 0 AS sec_dir,
  len(list_filter(dirs, lambda s: s IN ('node_modules', 'build', 'chroma_db'))) > 0 AS docs_dir,
  nm LIKE '%.min.js' OR nm LIKE '%.png' OR nm LIKE '%.gz' AS bad_file FROM seg)
SELECT doc_id, path, scan_dir, sec_dir, docs_dir, bad_file FROM f""")
def pruned_files(spark, sf):
    p = F.col("path")
    return _named(spark, sf).select(
        "doc_id", "path", paths.in_ignored_dir(p, "scan").alias("scan_dir"),
        paths.in_ignored_dir(p, "security").alias("sec_dir"), paths.in_ignored_dir(p, "docs").alias("docs_dir"),
        paths.is_ignored_file(p).alias("bad_file"),
    )


@query("languages", "PRJ1 PRJ2", f"""
WITH {_NAMED_SQL}
SELECT doc_id, CASE doc_id % {len(_NAMES)} WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'TypeScript'
  WHEN 3 THEN 'JavaScript' WHEN 5 THEN 'Python' WHEN 6 THEN 'Markdown' WHEN 7 THEN 'Dockerfile' WHEN 8 THEN 'JSON'
  WHEN 9 THEN 'Makefile' WHEN 12 THEN 'TypeScript' END AS language,
  CASE doc_id % {len(_NAMES)} WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'TypeScript'
  WHEN 3 THEN 'JavaScript' WHEN 5 THEN 'Python' WHEN 12 THEN 'TypeScript' END AS parseable FROM named""")
def languages(spark, sf):
    p = F.col("path")
    return _named(spark, sf).select(
        "doc_id", paths.detect_language(p).alias("language"), paths.parseable_language(p).alias("parseable")
    )


@query("extension_histogram", "PRJ3 AGG2", """
WITH p AS (SELECT string_split(url, '/')[-1] AS nm FROM pages)
SELECT coalesce(nullif(lower(regexp_extract(nm, '^.+(\\.[^.]+)$', 1)), ''), '(no extension)') AS ext, count(*) AS n
FROM p GROUP BY 1""")
def extension_histogram(spark, sf):
    return stats.histogram(b.table(spark, sf, "pages"), paths.extension_key(F.col("url")), "ext")


@query("language_histogram", "AGG3", "SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def language_histogram(spark, sf):
    return stats.histogram(b.table(spark, sf, "documents"), F.col("lang"), "language")


@query("largest_files", "TOP1", f"""
WITH {b.CORPUS_SQL}
SELECT repo, path, size_bytes, row_number() OVER (PARTITION BY repo ORDER BY size_bytes DESC, path) AS rank
FROM corpus QUALIFY rank <= 5""")
def largest_files(spark, sf):
    return stats.largest_files(b.corpus(spark, sf))


@query("directory_rollup", "AGG4", f"""
WITH {b.CORPUS_SQL}, x AS (
  SELECT repo, size_bytes, array_to_string(string_split(path, '/')[1:i], '/') AS dir, i AS depth,
         array_to_string(string_split(path, '/')[1:i-1], '/') AS parent_dir
  FROM corpus, generate_series(1, 8) g(i) WHERE i < len(string_split(path, '/')))
SELECT repo, dir, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(depth AS INTEGER) AS depth, parent_dir
FROM x GROUP BY ALL""")
def directory_rollup(spark, sf):
    return stats.directory_rollup(b.corpus(spark, sf)).select("repo", "dir", "n_files", "bytes", "depth", "parent_dir")


_NODES_SQL = f"""{b.CORPUS_SQL}, nodes AS (
  SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS path, array_to_string(p[1:i-1], '/') AS parent_path, p[i] AS name,
         CASE WHEN i = len(p) THEN 'file' ELSE 'directory' END AS node_type, CAST(i AS INTEGER) AS depth,
         CASE WHEN i = len(p) THEN size_bytes END AS size_bytes
  FROM (SELECT repo, size_bytes, string_split(path, '/') AS p FROM corpus), generate_series(1, 8) g(i) WHERE i <= len(p))"""


@query("tree_listing", "TOP2", f"""
WITH {_NODES_SQL}, r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo, parent_path, node_type ORDER BY lower(name), name) AS INTEGER) AS rank
  FROM nodes WHERE depth <= 4)
SELECT * FROM r a WHERE rank <= 50 AND NOT EXISTS (
  SELECT 1 FROM r d WHERE d.node_type = 'directory' AND d.rank > 50 AND d.repo = a.repo AND starts_with(a.path, d.path || '/'))""")
def tree_listing(spark, sf):
    return stats.tree_listing(b.corpus(spark, sf))


@query("tree_outline", "TOP3", f"""
WITH {_NODES_SQL}, keyed AS (
  SELECT n.*, CASE WHEN depth = 3 THEN
      '0' || lower(string_split(path, '/')[1]) || chr(1) || string_split(path, '/')[1] || chr(2) ||
      '0' || lower(string_split(path, '/')[2]) || chr(1) || string_split(path, '/')[2] || chr(2) || '1' || lower(name) || chr(1) || name
    WHEN depth = 2 THEN '0' || lower(string_split(path, '/')[1]) || chr(1) || string_split(path, '/')[1] || chr(2) || '0' || lower(name) || chr(1) || name
    ELSE '0' || lower(name) || chr(1) || name END AS k FROM nodes n),
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k) AS line_no,
             row_number() OVER (PARTITION BY repo, parent_path ORDER BY k DESC) = 1 AS is_last FROM keyed),
j AS (SELECT o.*, coalesce(a.is_last, false) AS last1, coalesce(c.is_last, false) AS last2
  FROM o LEFT JOIN o a ON a.repo = o.repo AND a.path = string_split(o.path, '/')[1] AND a.depth = 1
         LEFT JOIN o c ON c.repo = o.repo AND c.path = array_to_string(string_split(o.path, '/')[1:2], '/') AND c.depth = 2),
g AS (SELECT *, CASE WHEN last1 THEN '    ' ELSE '│   ' END AS i1, CASE WHEN last2 THEN '    ' ELSE '│   ' END AS i2 FROM j),
lines AS (SELECT repo, CAST(line_no AS INTEGER) AS line_no, 0 AS sub_no,
  CASE depth WHEN 1 THEN '' WHEN 2 THEN i1 ELSE i1 || i2 END || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name ||
  CASE WHEN node_type = 'directory' THEN '/' ELSE '' END AS line FROM g WHERE line_no <= 60),
marks AS (
  SELECT repo, CAST(line_no AS INTEGER) AS line_no, depth - lvl + 1 AS sub_no,
         CASE lvl WHEN 1 THEN '' WHEN 2 THEN i1 ELSE i1 || i2 END || '└── ... (truncated)' AS line
  FROM g, generate_series(1, 3) s(lvl) WHERE line_no = 60 AND lvl <= depth
    AND NOT (CASE lvl WHEN depth THEN is_last WHEN 1 THEN last1 ELSE last2 END))
SELECT repo, line_no, CAST(sub_no AS INTEGER) AS sub_no, line FROM lines UNION ALL
SELECT repo, line_no, CAST(sub_no AS INTEGER), line FROM marks""")
def tree_outline(spark, sf):
    return stats.tree_outline(b.corpus(spark, sf))


@query("url_validate", "PRJ4", """
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo.git/'
    WHEN 1 THEN 'https://user:pw@github.com/o/r' WHEN 2 THEN 'https://github.com:8443/o/r' WHEN 3 THEN 'https://github.com/-bad-/r'
    WHEN 4 THEN 'https://www.github.com/o/' || page_id ELSE url END AS url FROM pages)
SELECT page_id, page_id % 6 IN (0, 4) AS valid,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'credentials' WHEN 2 THEN 'port' WHEN 3 THEN 'owner' WHEN 4 THEN NULL
    ELSE CASE WHEN url LIKE 'https:%' THEN 'host' ELSE 'scheme' END END AS reason,
  CASE page_id % 6 WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo' WHEN 4 THEN 'https://github.com/o/' || page_id END AS canonical
FROM u""")
def url_validate(spark, sf):
    k = F.col("page_id")
    url = (
        F.when(k % 6 == 0, F.concat(F.lit("https://github.com/owner"), k.cast("string"), F.lit("/repo.git/")))
        .when(k % 6 == 1, F.lit("https://user:pw@github.com/o/r"))
        .when(k % 6 == 2, F.lit("https://github.com:8443/o/r"))
        .when(k % 6 == 3, F.lit("https://github.com/-bad-/r"))
        .when(k % 6 == 4, F.concat(F.lit("https://www.github.com/o/"), k.cast("string")))
        .otherwise(F.col("url"))
    )
    checked = b.table(spark, sf, "pages").select("page_id", paths.validate_url(url).alias("v"))
    return checked.select("page_id", "v.valid", "v.reason", "v.canonical")


@query("collection_key", "PRJ5", f"""
SELECT page_id, 'repo_' || left(sha256(rtrim(lower({b.strip_sql('url')}), '/')), 24) AS collection FROM pages""")
def collection_key(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", paths.collection_key(F.col("url")).alias("collection"))


@query("decoded_text", "SRC5", f"""
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g') END) AS digest FROM documents""")
def decoded_text(spark, sf):
    # Even documents are stored as UTF-8, odd ones in a one-byte code, accents and all, with what it lacks as '?'.
    one_byte = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(one_byte)
    return b.table(spark, sf, "documents").select(
        "doc_id", F.sha2(F.encode(src.decode(raw), "UTF-8"), 256).alias("digest")
    )


@query("visibility_flags", "PRJ6 PRJ7", """
WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '__x' || doc_id WHEN 1 THEN '_y' || doc_id WHEN 2 THEN '__z' || doc_id || '__' ELSE 'w' || doc_id END AS name FROM documents)
SELECT doc_id, name, CASE doc_id % 4 WHEN 0 THEN 'private' WHEN 3 THEN 'public' ELSE 'protected' END AS visibility,
       doc_id % 4 IN (2, 3) AS public_function, doc_id % 4 = 3 AS public_class FROM n""")
def visibility_flags(spark, sf):
    k = F.col("doc_id")
    s = k.cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("__x"), s)).when(k % 4 == 1, F.concat(F.lit("_y"), s))
        .when(k % 4 == 2, F.concat(F.lit("__z"), s, F.lit("__"))).otherwise(F.concat(F.lit("w"), s))
    )
    return b.table(spark, sf, "documents").select("doc_id", name.alias("name")).select(
        "doc_id", "name", paths.visibility(F.col("name")).alias("visibility"),
        paths.is_public_function(F.col("name")).alias("public_function"),
        paths.is_public_class(F.col("name")).alias("public_class"),
    )


@query("corpus_report", "SNK6", f"""
WITH {b.CORPUS_SQL}, d AS (SELECT repo, count(DISTINCT dir) AS n FROM (SELECT repo, lang AS dir FROM corpus UNION ALL SELECT repo, lang || '/' || repo FROM corpus) GROUP BY repo),
big AS (SELECT repo, path, size_bytes, row_number() OVER (PARTITION BY repo ORDER BY size_bytes DESC, path) AS rank FROM corpus QUALIFY rank <= 5),
top AS (SELECT repo, string_agg('{{"rank":' || rank || ',"path":"' || path || '","size_bytes":' || size_bytes || '}}', ',' ORDER BY rank) AS files FROM big GROUP BY repo)
SELECT c.repo, '{{"total_files":' || count(*) || ',"total_directories":' || any_value(d.n) || ',"total_size_bytes":' || sum(size_bytes)
  || ',"file_extensions":[{{"key":".txt","count":' || count(*) || '}}],"largest_files":[' || any_value(top.files) || ']}}' AS report
FROM corpus c JOIN d ON d.repo = c.repo JOIN top ON top.repo = c.repo GROUP BY c.repo""")
def corpus_report(spark, sf):
    from corpusloom.sources.reports import repo_reports

    return repo_reports(b.corpus(spark, sf))


_TREE_DIRS = ("src", "node_modules/pkg", "app/.git", "docs", "Build", "lib/deep/er", "")
_TREE_ENDS = (".py", ".min.js", ".txt", ".md", ".PNG")
_TREE_MAX = 4000


def _write_tree(spark, sf):
    """The documents as files of five repositories, some in ignored directories or with ignored names; gives the folder."""
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    k = F.col("doc_id")
    of = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    path = F.concat_ws("/", F.concat(F.lit("r"), (k % 5).cast("string")), F.nullif(of(_TREE_DIRS), F.lit("")), F.concat(k.cast("string"), of(_TREE_ENDS)))
    files = b.table(spark, sf, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("raw"))

    def write(batches):
        store, root = tree.filesystem(folder)
        for batch in batches:
            for place, raw in zip(batch.column("path").to_pylist(), batch.column("raw").to_pylist()):
                store.create_dir(f"{root}/{place}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{place}") as f:
                    f.write(raw)
            yield batch.select(["path"])

    files.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


_TREE_SQL = f"""files AS (
  SELECT 'r' || (doc_id % 5) AS repo, CASE WHEN doc_id % 7 = 6 THEN '' ELSE {list(_TREE_DIRS)}[doc_id % 7 + 1] || '/' END || doc_id || {list(_TREE_ENDS)}[doc_id % 5 + 1] AS path,
    CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, text FROM documents WHERE doc_id % 7 IN (0, 3, 5, 6) AND doc_id % 5 IN (0, 2, 3))"""


@query("corpus_tree", "SRC1 SRC2 SRC3 SRC4 SRC5", f"""
WITH {_TREE_SQL} SELECT repo, path, size_bytes, md5(text) AS digest FROM files WHERE size_bytes <= {_TREE_MAX}""")
def corpus_tree(spark, sf):
    """A tree of files written from the documents and read back, pruned while it is listed."""
    files = src.read_corpus(spark, _write_tree(spark, sf), max_bytes=_TREE_MAX, partition_bytes=1 << 20)
    return files.select("repo", "path", "size_bytes", F.md5(F.encode(src.decode(F.col("raw")), "UTF-8")).alias("digest"))


@query("corpus_oversized", "SRC1 SRC4", f"""
WITH {_TREE_SQL} SELECT repo, path, size_bytes, 'too_large' AS skip_reason FROM files WHERE size_bytes > {_TREE_MAX}""")
def corpus_oversized(spark, sf):
    return src.oversized(spark, _write_tree(spark, sf), max_bytes=_TREE_MAX)
