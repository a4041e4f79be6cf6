"""Search queries: query terms, lexical, semantic and hybrid hits, sources, packing, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import identifiers, text, vectors as vf
from corpusloom.operators import lexical, lines, retrieval
from corpusloom.plans import bindings as b
from corpusloom.plans.registry import query
from corpusloom.plans.vector_queries import hash_embedding_sql
from corpusloom.session import stored
from corpusloom.sources import vectors as sink

_DIM = 32
_STOP = ", ".join(f"'{w}'" for w in identifiers.STOPWORDS)
_SYN = "(VALUES " + ", ".join(f"('{k}', '{t}')" for k, v in identifiers.SYNONYMS.items() for t in v) + ") syn(k, t)"


def terms_sql(source: str, key: str) -> str:
    """CTEs ``core_terms(query_id, term)`` and ``terms(query_id, term, is_core)`` of a text table."""
    return f"""words AS (
  SELECT {key} AS query_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s\\x1c-\\x1f\\x85\\p{{Z}}]', ' ', 'g'),
         '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: w <> '') AS ws FROM {source}),
pieces AS (
  SELECT query_id, ws, flatten(list_transform(ws, lambda w: flatten(list_transform(list_filter(string_split_regex(w, '[_\\-.]+'), lambda p: p <> ''),
         lambda p: CASE WHEN regexp_matches(p, '[a-z]+|\\p{{Nd}}+') THEN regexp_extract_all(p, '[a-z]+|\\p{{Nd}}+') ELSE [p] END)))) AS ps FROM words),
kept AS (SELECT query_id, ws, list_distinct(list_filter(ps, lambda t: length(t) > 1 AND t NOT IN ({_STOP}))) AS core FROM pieces),
core_terms AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(core) > 0 THEN core ELSE list_filter(ws, lambda w: length(w) > 1) END) AS term FROM kept),
terms AS (
  SELECT query_id, term, max(c) AS is_core FROM (
    SELECT query_id, term, TRUE AS c FROM core_terms
    UNION ALL SELECT query_id, syn.t AS term, FALSE AS c FROM core_terms JOIN {_SYN} ON syn.k = core_terms.term) GROUP BY ALL)"""


# Benchmark texts carry no software words, so every query is prefixed with one to exercise synonyms and type hints.
_PREFIX = ("user login ", "class ", "database error ", "", "function token ")


def queries(spark, sf):
    k = F.col("item_id")
    prefix = F.element_at(F.array(*[F.lit(p) for p in _PREFIX]), (k % 5 + 1).cast("int"))
    return b.table(spark, sf, "benchmark").select(k.alias("query_id"), F.concat(prefix, "text").alias("text"))


_QUERIES_SQL = "qs AS (SELECT item_id AS query_id, [" + ", ".join(f"'{p}'" for p in _PREFIX) + "][item_id % 5 + 1] || text AS text FROM benchmark)"


@query("query_terms", "STR2 STR3", f"""
WITH {_QUERIES_SQL}, {terms_sql('qs', 'query_id')}
SELECT query_id, term, is_core FROM terms""")
def query_terms(spark, sf):
    return lexical.query_terms(queries(spark, sf))


@query("identifier_words", "STR1", """
SELECT vec_id, ['get', 'http', 'vector', CAST(vec_id AS VARCHAR), 'of', 'type', CAST(label AS VARCHAR), 'api'] AS words FROM embeddings""")
def identifier_words(spark, sf):
    name = F.concat(
        F.lit("getHTTPVector"), F.col("vec_id").cast("string"), F.lit("_of-Type"), F.col("label").cast("string"), F.lit(".API")
    )
    return b.table(spark, sf, "embeddings").select("vec_id", identifiers.split_identifier(name).alias("words"))


def chunks(spark, sf):
    return lines.fallback_chunks(b.corpus_lines(spark, sf))


_CHUNKS_SQL = f"""{b.LINES_SQL}, chunks AS (
  SELECT repo, repo || ':' || path || '#' || doc_id || '#L' || lo || '-L' || least(len(lines), lo + 299) AS chunk_id, path AS file_path,
         CAST(doc_id AS VARCHAR) AS entity_name, CAST(lo AS INTEGER) AS start_line,
         CAST(least(len(lines), lo + 299) AS INTEGER) AS end_line, array_to_string(lines[lo:lo + 299], chr(10)) AS code,
         string_split_regex(lower(path), '[/\\\\_\\-.]+') AS path_tokens, [CAST(doc_id AS VARCHAR)] AS name_tokens
  FROM (SELECT *, unnest(generate_series(1, len(lines), 300)) AS lo FROM split WHERE len(lines) > 0))"""

_TOKENS = "CASE WHEN code = '' THEN 0 ELSE greatest(1, CAST(round_even(length(code) / 3.8, 0) AS INTEGER)) END"

_LEX_SQL = f"""{_QUERIES_SQL}, {terms_sql('qs', 'query_id')}, {_CHUNKS_SQL}, pairs AS (
  SELECT t.query_id, c.chunk_id, c.code, t.term, t.is_core, c.entity_name = t.term AS exact, list_contains(c.name_tokens, t.term) AS in_name,
         list_contains(c.path_tokens, t.term) AS in_path, contains(lower(c.code), t.term) AS in_body
  FROM terms t CROSS JOIN chunks c),
scores AS (
  SELECT query_id, chunk_id, any_value({_TOKENS}) AS tokens,
    CASE WHEN bool_or(exact AND is_core) THEN 10 WHEN bool_or(exact) THEN 8 + 5 * count(*) FILTER (WHERE in_name)
         ELSE 5 * count(*) FILTER (WHERE in_name) END
    + 3.5 * least(2, count(*) FILTER (WHERE in_path)) + least(3, count(*) FILTER (WHERE in_body AND NOT in_name)) AS score
  FROM pairs GROUP BY query_id, chunk_id),
lex AS (
  SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tokens, chunk_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)"""


@query("lexical_topk", "SRCH1 SRCH2 SET5 STR17", f"""
WITH {_LEX_SQL}
SELECT query_id, rank, chunk_id, score FROM lex WHERE rank <= 10""")
def lexical_topk(spark, sf):
    return lexical.lexical_search(queries(spark, sf), chunks(spark, sf), 10).select("query_id", "rank", "chunk_id", "score")


@query("lexical_topk_join", "SRCH1 SRCH2 SET5", f"""
WITH {_LEX_SQL}
SELECT query_id, rank, chunk_id, score FROM lex WHERE rank <= 10""")
def lexical_topk_join(spark, sf):
    """The same hits with the queries asked in two halves of one stored index."""
    index, asked = lexical.indexed(chunks(spark, sf)), queries(spark, sf)
    halves = [lexical.lexical_search(asked.filter(F.col("query_id") % 2 == r), index, 10) for r in (0, 1)]
    hits = halves[0].unionByName(halves[1])
    return hits.select("query_id", "rank", "chunk_id", "score")


@query("lexical_reasons", "STR17", f"""
WITH {_LEX_SQL}, p AS (
  SELECT query_id, chunk_id, list(term ORDER BY term) FILTER (WHERE in_path) AS paths, list(term ORDER BY term) FILTER (WHERE in_name) AS names,
         bool_or(exact) AS exact, bool_or(exact AND is_core) AS core_exact,
         list(term ORDER BY term) FILTER (WHERE in_body AND NOT in_name) AS body FROM pairs GROUP BY ALL)
SELECT l.query_id, l.chunk_id,
  CASE WHEN core_exact THEN 'Exact match on file_module name ''' || c.entity_name || ''''
       WHEN exact THEN 'Entity name ''' || c.entity_name || ''' matches concept ''' || c.entity_name || ''''
       WHEN names IS NOT NULL THEN 'Identifier parts matched: ' || array_to_string(names, ', ')
       WHEN paths IS NOT NULL THEN 'File path ''' || c.file_path || ''' matches keywords: ' || array_to_string(paths, ', ')
       ELSE 'Code body contains: ' || array_to_string(body[1:3], ', ') END AS first_reason
FROM lex l JOIN p USING (query_id, chunk_id) JOIN chunks c USING (chunk_id) WHERE rank <= 5""")
def lexical_reasons(spark, sf):
    hits = lexical.lexical_search(queries(spark, sf), chunks(spark, sf), 5)
    return hits.select("query_id", "chunk_id", F.get("reasons", 0).alias("first_reason"))


def _vectors(c):
    words = text.embedding_text(F.col("file_path"), F.col("entity_type"), F.col("entity_name"), F.col("code_content"))
    return c.select(
        F.lit("corpus").alias("collection"), "chunk_id", "entity_type", vf.hash_embedding(words, _DIM).alias("embedding")
    )


def _embedded_queries(spark, sf):
    return queries(spark, sf).select(
        "query_id", "text", F.lit("corpus").alias("collection"), vf.hash_embedding(F.col("text"), _DIM).alias("embedding")
    )


_SEM_SQL = f"""cv AS (SELECT chunk_id, {hash_embedding_sql("'File: ' || file_path || chr(10) || 'Entity: file_module ' || entity_name || chr(10) || 'Code:' || chr(10) || code", _DIM)} AS v FROM chunks),
qv AS (SELECT query_id, {hash_embedding_sql('text', _DIM)} AS v FROM qs),
cn AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM cv),
qn AS (SELECT query_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM qv),
cosines AS (SELECT query_id, chunk_id, round(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) / (q.l * c.l), 9) AS cosine FROM qn q CROSS JOIN cn c),
sem AS (SELECT query_id, chunk_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS INTEGER) AS rank FROM cosines)"""


@query("semantic_topk", "SRCH3 SRCH7 STR10 MATH1", f"""
WITH {_QUERIES_SQL}, {_CHUNKS_SQL}, {_SEM_SQL}
SELECT query_id, rank, chunk_id, round(greatest(0, least(1, cosine)), 4) AS score, 'semantic' AS search_mode FROM sem WHERE rank <= 10""")
def semantic_topk(spark, sf):
    c = chunks(spark, sf)
    hits = retrieval.search("semantic", _embedded_queries(spark, sf), c, _vectors(c), 10)
    return hits.select("query_id", "rank", "chunk_id", "score", "search_mode")


def _one_sided(df, keep):
    """The questions that ask this side: all but every seventh."""
    return df.filter(F.col("query_id") % 7 != keep)


_FUSE_SQL = f"""{_LEX_SQL}, {_SEM_SQL}, lp AS (SELECT * FROM lex WHERE rank <= 20 /*lexical side*/),
sp AS (SELECT query_id, chunk_id, rank, round(greatest(0, least(1, cosine)), 4) AS score FROM sem WHERE rank <= 20 /*semantic side*/),
fu AS (SELECT query_id, chunk_id, l.rank AS lr, s.rank AS sr, l.score AS ls, s.score AS ss,
  count(l.rank) OVER (PARTITION BY query_id) AS nl, count(s.rank) OVER (PARTITION BY query_id) AS ns FROM lp l FULL JOIN sp s USING (query_id, chunk_id)),
fs AS (SELECT *, CASE WHEN nl > 0 AND ns > 0 THEN coalesce(0.5::DOUBLE / (60 + lr), 0) + coalesce(0.5::DOUBLE / (60 + sr), 0) ELSE 0 END AS rrf,
  coalesce(lr, 1000000 + sr) AS place FROM fu),
fused AS (SELECT query_id, chunk_id, CASE WHEN nl > 0 AND ns > 0 THEN round(rrf, 5) ELSE coalesce(ls, ss) END AS score,
  CASE WHEN nl > 0 AND ns > 0 THEN 'hybrid' WHEN nl > 0 THEN 'hybrid (lexical-only)' ELSE 'hybrid (semantic-only)' END AS search_mode,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, place) AS INTEGER) AS rank FROM fs)"""


def _hybrid(spark, sf, limit=10):
    index = lexical.indexed(chunks(spark, sf))  # one chunk table for words, vectors and hits
    return retrieval.search("hybrid", _embedded_queries(spark, sf), index, _vectors(index.chunks), limit)


@query("hybrid_rrf", "SRCH5 SRCH6 SRCH7 JN10", f"""
WITH {_FUSE_SQL}
SELECT query_id, rank, chunk_id, score, search_mode FROM fused WHERE rank <= 10""")
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf).select("query_id", "rank", "chunk_id", "score", "search_mode")


_FALLBACK_SQL = _FUSE_SQL.replace("/*lexical side*/", "AND query_id % 7 <> 1").replace("/*semantic side*/", "AND query_id % 7 <> 2")


@query("hybrid_fallback", "SRCH6", f"""
WITH {_FALLBACK_SQL}
SELECT query_id, rank, chunk_id, score, search_mode FROM fused WHERE rank <= 10""")
def hybrid_fallback(spark, sf):
    """Some questions are asked of one side only; each is answered from the pool it has."""
    q, index, pool = _embedded_queries(spark, sf), lexical.indexed(chunks(spark, sf)), retrieval.pool_size(10)
    lex = lexical.lexical_search(_one_sided(q, 1), index, pool)
    sem = retrieval.semantic_search(_one_sided(q, 2), _vectors(index.chunks), index.chunks, pool)
    return retrieval.fuse(lex, sem, 10).select("query_id", "rank", "chunk_id", "score", "search_mode")


@query("answer_sources", "SRCH8", f"""
WITH {_FUSE_SQL}
SELECT query_id, 'S' || f.rank AS source_id, repo, file_path, start_line, end_line, chunk_id, round_even(score, 4) AS score
FROM fused f JOIN chunks USING (chunk_id) WHERE f.rank <= 5""")
def answer_sources(spark, sf):
    sources = retrieval.select_sources(_hybrid(spark, sf), 5)
    return sources.select("query_id", "source_id", "repo", "file_path", "start_line", "end_line", "chunk_id", "score")


@query("context_pack", "SRCH9", f"""
WITH {_LEX_SQL}, s AS (SELECT l.query_id, l.rank, c.* FROM lex l JOIN chunks c USING (chunk_id) WHERE rank <= 5),
blk AS (SELECT query_id, rank, 'S' || rank AS sid, '--- BEGIN S' || rank || ' ---' || chr(10) || 'SOURCE [S' || rank || ']' || chr(10) || 'File: ' || file_path ||
  ' (Lines ' || start_line || '-' || end_line || ')' || chr(10) || 'Entity: file_module ' || entity_name || chr(10) || 'Language: text' || chr(10) || chr(10) || '```text' || chr(10) || code ||
  chr(10) || '```' || chr(10) || '--- END S' || rank || ' ---' AS block FROM s),
run AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM blk)
SELECT query_id, array_to_string(list(sid ORDER BY rank), ',') AS source_ids, md5(array_to_string(list(block ORDER BY rank), chr(10) || chr(10))) AS digest,
  CAST(max(total) AS BIGINT) AS chars
FROM run WHERE rank = 1 OR total <= 6000 GROUP BY query_id""")
def context_pack(spark, sf):
    index = lexical.indexed(chunks(spark, sf))
    sources = stored(retrieval.select_sources(lexical.lexical_search(queries(spark, sf), index, 5), 5), "sources")
    code = lexical.rows_of_hits(index.chunks.select("chunk_id", "code_content"), sources, "chunk_id")
    blocks = sources.join(code, "chunk_id").withColumn("block", retrieval.source_block(F.col("code_content")))
    packed = retrieval.pack_context(blocks, 6000)
    return packed.select("query_id", F.array_join("source_ids", ",").alias("source_ids"), F.md5("context").alias("digest"), "chars")


# Assistant turns with citation tags added: two known ones in reverse order, or an unknown one, or none.
_ANSWERS_SQL = """answers AS (
  SELECT conv_id * 1000 + turn AS answer_id, text || CASE conv_id % 3 WHEN 0 THEN ' [S2] and [S1], [S2]' WHEN 1 THEN ' [S99]' ELSE '' END AS text, conv_id
  FROM conversations WHERE role = 'assistant'),
sources AS (SELECT answer_id, 'S' || i AS source_id, i AS source_no FROM answers, generate_series(1, 3) g(i))"""


def answers(spark, sf):
    k = F.col("conv_id") % 3
    tail = F.when(k == 0, F.lit(" [S2] and [S1], [S2]")).when(k == 1, F.lit(" [S99]")).otherwise(F.lit(""))
    return b.table(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", tail).alias("text")
    )


@query("citation_tags", "STR14", f"""
WITH {_ANSWERS_SQL}, t AS (SELECT answer_id, regexp_extract_all(text, '\\[(S\\d+)\\]', 1) AS tags FROM answers)
SELECT answer_id, CAST(i - 1 AS INTEGER) AS pos, tags[i] AS tag FROM t, generate_series(1, 3) g(i) WHERE i <= len(tags)""")
def citation_tag_rows(spark, sf):
    return answers(spark, sf).select("answer_id", F.posexplode(text.citation_tags(F.col("text"))).alias("pos", "tag"))


@query("citations", "JN11", f"""
WITH {_ANSWERS_SQL}
SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY CASE WHEN conv_id % 3 = 0 THEN -source_no ELSE source_no END) AS INTEGER) AS citation_no, source_id
FROM sources JOIN answers USING (answer_id) WHERE conv_id % 3 <> 0 OR source_no <= 2""")
def citations(spark, sf):
    a = answers(spark, sf)
    sources = a.select("answer_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("source_no")).withColumn(
        "source_id", F.concat(F.lit("S"), F.col("source_no").cast("string"))
    )
    return retrieval.validate_citations(a, sources).select("answer_id", "citation_no", "source_id")


_ASKED_SQL = "qs AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')"
_ANSWERED_SQL = _FUSE_SQL.replace(_QUERIES_SQL, _ASKED_SQL).replace("rank <= 20", "rank <= 12") + """, hit AS (SELECT DISTINCT query_id FROM fused WHERE rank = 1)"""


@query("answers", "SRCH12 UDF2", f"""
WITH {_ANSWERED_SQL}
SELECT query_id, md5(CASE WHEN h.query_id IS NULL THEN 'No generated answer is available; see the cited sources.' ELSE 'The most relevant source is [S1].' END) AS digest,
  CASE WHEN h.query_id IS NULL THEN 'text generation was unavailable; a template answer is shown' END AS warning, CASE WHEN h.query_id IS NULL THEN NULL ELSE CAST(1 AS BIGINT) END AS n_citations
FROM qs LEFT JOIN hit h USING (query_id)""")
def answered(spark, sf):
    """User turns answered from the corpus through the batch-generator seam, here with a model that cites the first source."""
    from corpusloom.functions.models import generate_column

    def first_source(prompts):
        found = [p.partition("--- BEGIN ")[2].partition(" ---")[0] for p in prompts]
        return [f"The most relevant source is [{s}]." if s else None for s in found]

    def generate(prompts):
        return generate_column(prompts, "query_id", "prompt", first_source)

    asked = b.table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.lit("corpus").alias("collection"),
        vf.hash_embedding(F.col("text"), _DIM).alias("embedding"),
    )
    index = lexical.indexed(chunks(spark, sf))
    answers_df, cited = retrieval.answer_questions(asked, index, _vectors(index.chunks), generate, 3)
    counts = cited.groupBy(F.col("answer_id").alias("query_id")).agg(F.count(F.lit(1)).alias("n_citations"))
    return answers_df.join(counts, "query_id", "left").select("query_id", F.md5("answer").alias("digest"), "warning", "n_citations")


@query("embedded_chunks", "UDF1 STR10", f"""
WITH {_CHUNKS_SQL}, cv AS (SELECT chunk_id, {hash_embedding_sql("'File: ' || file_path || chr(10) || 'Entity: file_module ' || entity_name || chr(10) || 'Code:' || chr(10) || code", _DIM)} AS v FROM chunks)
SELECT chunk_id, 'hash' AS model, {_DIM} AS dimension, round_even(CAST(CAST(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS FLOAT) AS DOUBLE), 6) AS first FROM cv""")
def embedded_chunks(spark, sf):
    """Chunks through the pluggable embedder seam with the built-in hash model."""
    from corpusloom.functions.models import HashEmbedder, embed_column

    c = chunks(spark, sf)
    words = text.embedding_text(F.col("file_path"), F.col("entity_type"), F.col("entity_name"), F.col("code_content"))
    model = HashEmbedder(_DIM)
    embedded = embed_column(c.select("chunk_id", words.alias("text")), "text", model).drop("text")
    return sink.pair_embeddings(c.select("chunk_id"), embedded).select(
        "chunk_id", "model", F.size("embedding").alias("dimension"), F.bround(F.get("embedding", 0).cast("double"), 6).alias("first")
    )
