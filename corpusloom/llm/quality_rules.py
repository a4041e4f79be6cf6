"""Quality rules: counts per document, and Jensen-Shannon distance of its histograms from language references.

Each text is read once: its words, lines and characters become a short row of counts, which is written to the shared
folder. References are the summed histograms of all documents of a language that pass the base rules. Those of languages
with at least ``MIN_SHARE`` of those documents, at most ``1 / MIN_SHARE``, meet every document as literals. Every other language of
``MIN_ROWS`` rows, and each that ``COMMON_WORDS`` hardly covers, has a reference over the common words of its own rows, in a
table joined by language. A language of fewer rows gives no reference: only the base rules judge its documents. Documents
that name no language meet the ``MET`` most frequent of these, so what a row meets is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.vectors import bind
from corpusloom.llm.common import BLANK_WORD, stored
from corpusloom.operators.graph import salted_join

#: Frequent short words; a document's histogram counts those it holds, as they stand between blanks.
COMMON_WORDS = tuple(sorted(set(
    "the of and to in a is that it for was on as are with be at by this from or an had not but have his they which".split()
    + "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split()
    + "de la le et les des en un une du que est dans qui par pour au il sur ne se pas plus avec son vous".split()
    + "el que y los del se las por un para con no una su al lo como más o pero sus le ya este sí".split()
)))
CHAR_CLASSES = ("lower", "upper", "letter", "digit", "blank", "point", "symbol", "other")
MIN_SHARE, MILLION = 0.01, 1_000_000
#: ``COMMON_WORDS`` serve a language if they are at least this share of its words; others take words of their own rows.
MIN_COVER = 0.1
#: Rows that give a language a reference over its own words; how many words it has at most, and in what share of the rows each occurs.
MIN_ROWS, OWN_WORDS, OWN_SHARE = 20, 64, 0.1
#: How many references of own words, those of most rows, meet a document that names no language.
MET = 100
#: Share of common words in a text for which ``WORD_NOISE`` holds; own words that are rarer or more frequent are noisier or less so.
USUAL_COVER = 0.4
MIN_WORDS = 50
MAX_REPEATED = 50

#: Largest distances that are kept; histograms of a short text are noisy, so with few words both widen by their noise over the root of the words.
MAX_CHAR_DISTANCE, CHAR_NOISE = 0.18, 1.0
MAX_WORD_DISTANCE, WORD_NOISE = 0.35, 3.5
#: Under so many words the word histogram is not compared, under so many characters neither is.
MIN_JUDGED_WORDS, MIN_JUDGED_CHARS = 50, 200


def _repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found at least twice in the array.

    The windows' hashes share a long with their position, so that one sort of longs brings equal windows together;
    neighbours are compared word by word. Should two different windows share the hash bits, the strings are sorted.
    """
    n = F.size(words)

    def window(i):
        return F.array(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(starts):
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def by_hash(high):
        # high: a mask without the bits that hold the position
        hashed = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("bigint")))
        return bind(F.sort_array(F.slice(hashed, F.lit(1), n - 2)), lambda p: neighbours(p, high))

    def neighbours(packed, high):
        def at(j):
            return F.get(packed, j).bitwiseAND(F.bitwise_not(high)).cast("int")

        # equal but for the position bits
        equal = F.filter(F.sequence(F.lit(1), n - 3), lambda j: F.get(packed, j).bitwiseXOR(F.get(packed, j - 1)).bitwiseAND(high) == 0)

        def counted(later):
            odd = F.exists(later, lambda j: window(at(j)) != window(at(j - 1)))
            starts = F.flatten(F.transform(later, lambda j: F.array(at(j - 1), at(j))))
            return F.when(F.size(later) == 0, 0).when(odd, by_text()).otherwise(covered(starts))

        return bind(equal, counted)

    def by_text():
        pairs = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("w"), i.alias("i"))))

        def starts(p):
            later = F.filter(F.sequence(F.lit(1), n - 3), lambda j: F.get(p, j)["w"] == F.get(p, j - 1)["w"])
            return F.flatten(F.transform(later, lambda j: F.array(F.get(p, j - 1)["i"], F.get(p, j)["i"])))

        return covered(bind(pairs, starts))

    high = -F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double") + 1))).cast("bigint")
    return F.when(n < 4, 0).otherwise(bind(high, by_hash)).cast("bigint")


def _runs(values: Column) -> Column:
    """Distinct values of an array of strings with their counts."""

    def count(s):
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == n - 1) | (F.get(s, j) != F.get(s, j + 1)))
        return bind(ends, lambda e: F.transform(e, lambda x, k: F.struct(
            F.get(s, x).alias("word"), (x - F.when(k == 0, -1).otherwise(F.get(e, k - 1))).cast("int").alias("n"))))

    empty = F.array().cast("array<struct<word:string,n:int>>")
    return F.when(F.size(values) == 0, empty).otherwise(bind(F.sort_array(values), count))


def document_counts(docs: DataFrame, *keep: str, listed: str | None = None) -> DataFrame:
    """``keep`` columns, the base counts and the histograms of every row of ``docs``; a null text has no words or lines.

    ``chars``: counts by ``CHAR_CLASSES``. ``common``: ``(word, n)`` of the ``COMMON_WORDS`` that occur. ``own``, if ``listed``
    names a column with an array of words: the same of these.
    """
    added = [listed] if listed else []
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *keep, *added, text.alias("_text"), F.regexp_extract_all(text, F.lit(BLANK_WORD), F.lit(0)).alias("_words"),
        F.regexp_replace(text, "[a-z]+", "").alias("_unlow"),
    )
    split = split.withColumn("_rest", F.regexp_replace("_unlow", r"[\x20\x09-\x0D]+", ""))
    rest, words, whole, unlow = F.col("_rest"), F.col("_words"), F.col("_text"), F.col("_unlow")

    def has(characters: str):
        return F.regexp_count(rest, F.lit(characters)).cast("bigint")

    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *keep,
        F.size(words).cast("bigint").alias("n_words"),
        F.length(whole).cast("bigint").alias("n_chars_"),
        (F.length(whole) - F.length(unlow)).cast("bigint").alias("_lower"), has("[A-Z]").alias("_upper"),
        has(r"[\p{L}&&[^\x00-\x7F]]").alias("_letter"), has("[0-9]").alias("_digit"), (F.length(unlow) - F.length(rest)).cast("bigint").alias("_blank"),
        has(r"[-.,;:!?'\x22()]").alias("_point"), has("[#*$%&|<>]").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        bind(words, _repeated_words).alias("n_repeat_words"),
        _runs(F.filter(words, lambda w: w.isin(*COMMON_WORDS))).alias("common"),
        *[bind(F.array_intersect(words, c), lambda found: _runs(F.filter(words, lambda w: F.array_contains(found, w)))).alias("own") for c in added],
    )
    known = [F.col(f"_{c}") if c != "symbol" else F.col("n_symbols") for c in CHAR_CLASSES[:-1]]
    other = F.col("n_chars_") - sum(known[1:], known[0])
    return counted.select(
        *keep, "n_words", (F.col("n_chars_") - F.col("_blank")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*known, other).alias("chars"), "common", *["own" for _ in added],
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _total(histogram: str) -> Column:
    return F.aggregate(F.col(histogram), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])


def _n_chars() -> Column:
    return F.aggregate(F.col("chars"), F.lit(0).cast("bigint"), lambda s, x: s + x)


def _share(n: Column, of: Column) -> Column:
    return F.floor(n.cast("bigint") * MILLION / of).cast("bigint")


def _sound(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("lang").isNotNull() & ~base_failed())


def language_sums(counts: DataFrame, histogram: str) -> DataFrame:
    """Per language of documents that pass the base rules: rows, summed shares of characters, and the share ``cover`` of the histogram's words.

    A document counts by its shares, in whole millionths so that sums do not depend on their order: a very long one weighs
    no more than others. ``counts`` as of :func:`document_counts` with ``lang``; rows without a language give no reference.
    """
    sums = [F.sum(_share(F.col("chars")[i], _n_chars())).alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    cover = (F.sum(_total(histogram)) / F.sum("n_words")).alias("cover")
    return _sound(counts).groupBy("lang").agg(F.count("*").alias("n"), cover, *sums)


def word_sums(counts: DataFrame, histogram: str) -> DataFrame:
    """``(lang, word, n)``: the summed shares of a histogram's words in the documents that pass the base rules."""
    return (
        _sound(counts).select("lang", _total(histogram).alias("of"), F.explode(histogram).alias("c"))
        .groupBy("lang", F.col("c.word").alias("word")).agg(F.sum(_share(F.col("c.n"), F.col("of"))).alias("n"))
    )


def references(counts: DataFrame, languages: DataFrame) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Per language the mean shares of character classes and of ``COMMON_WORDS`` of all documents that pass the base rules.

    ``languages`` as of :func:`language_sums`. Languages with fewer than ``MIN_SHARE`` of these documents are left to
    :func:`own_references`: what reaches the driver is bounded.
    """
    total = languages.agg(F.sum("n")).first()[0] or 0
    chars = {r.lang: [float(r[f"c{i}"]) for i in range(len(CHAR_CLASSES))] for r in languages.filter(F.col("n") >= total * MIN_SHARE).collect()}
    words = word_sums(counts.filter(F.col("lang").isin(*chars)) if chars else counts.limit(0), "common")
    found = {lang: {} for lang in chars}
    for r in words.collect():
        found[r.lang][r.word] = float(r.n)
    out = {}
    for lang in sorted(chars):
        c, w = sum(chars[lang]), sum(found[lang].values())
        if c and w:
            out[lang] = ([x / c for x in chars[lang]], {k: v / w for k, v in sorted(found[lang].items())})
    return out


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on ``lang_``, null matching null, of ``right``'s one row per language.

    Nothing is broadcast by order: Spark does it where the measured size of ``right`` allows, and else a language of very
    many rows is spread over several tasks.
    """
    marked = [t.withColumn("none_", F.col("lang_").isNull()).withColumn("name_", F.coalesce("lang_", F.lit(""))) for t in (left, right.withColumnRenamed("lang_", "of_").withColumn("lang_", F.col("of_")))]
    return salted_join(marked[0], marked[1].drop("lang_", "of_"), ["none_", "name_"], ["place_"], "inner").drop("none_", "name_")


def own_lists(docs: DataFrame, languages: DataFrame, frequent: list[str]) -> DataFrame:
    """``(lang_, listed_)``: the words found in most rows of each of ``languages``; under the null language those of ``frequent``.

    A row counts a word once, so that repeats in one text do not make a word common. ``docs``: ``text``, ``lang_``, ``place_``.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(BLANK_WORD), F.lit(0))
    rows = languages.select(F.col("lang").alias("lang_"), "n")
    texts = _joined(docs.select("lang_", "text", "place_"), rows.select("lang_")).select("lang_", words.alias("w")).filter(F.size("w") >= MIN_WORDS)
    found = texts.select("lang_", F.explode(F.array_distinct("w")).alias("word")).groupBy("lang_", "word").count()
    found = found.join(rows, "lang_").filter(F.col("count") >= OWN_SHARE * F.col("n"))
    first = F.row_number().over(Window.partitionBy("lang_").orderBy(F.desc("count"), "word"))
    lists = found.withColumn("k", first).filter(F.col("k") <= OWN_WORDS).groupBy("lang_").agg(F.collect_list("word").alias("listed_"))
    none = F.array().cast("array<string>")
    lists = languages.select(F.col("lang").alias("lang_")).join(lists, "lang_", "left").withColumn("listed_", F.coalesce("listed_", none))
    lists = stored(lists, "quality-words")
    whole = lists.filter(F.col("lang_").isin(*frequent)) if frequent else lists.limit(0)
    whole = whole.agg(F.array_distinct(F.flatten(F.collect_list("listed_"))).alias("listed_"))
    return lists.unionByName(whole.select(F.lit(None).cast("string").alias("lang_"), "listed_"))


def own_references(counts: DataFrame, frequent: list[str]) -> DataFrame:
    """``(lang_, references_)``: the reference over its own words of every language; under the null language those of ``frequent``.

    ``counts`` as of :func:`document_counts` with ``lang`` and ``own``.
    """
    sums = language_sums(counts, "own")
    whole = sum((F.col(f"c{i}") for i in range(1, len(CHAR_CLASSES))), F.col("c0")).cast("double")
    words = word_sums(counts, "own").groupBy("lang").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", F.col("n").cast("double"))))).alias("sums"), F.sum("n").alias("w"))
    words = words.select("lang", F.transform_values("sums", lambda _, n: n / F.col("w")).alias("words"))
    refs = sums.join(words, "lang", "left").select(
        "lang", F.array(*[F.col(f"c{i}") / whole for i in range(len(CHAR_CLASSES))]).alias("chars"),
        F.coalesce("words", F.create_map().cast("map<string,double>")).alias("words"), "cover",
    )
    refs = stored(refs, "quality-references")
    one = F.collect_list(F.struct("lang", "chars", "words", "cover")).alias("references_")
    alone = refs.groupBy(F.col("lang").alias("lang_")).agg(one)
    known = refs.filter(F.col("lang").isin(*frequent)) if frequent else refs.limit(0)
    return alone.unionByName(known.agg(one).select(F.lit(None).cast("string").alias("lang_"), "references_"))


def _term(p: Column, q: Column) -> Column:
    """What a bin of shares ``p`` and ``q`` adds to twice the Jensen-Shannon divergence, in bits."""
    half = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)


def _distances(lang: tuple[list[float], dict[str, float]]) -> tuple[Column, Column]:
    """Jensen-Shannon distances (square roots, 0 to 1) of a row's two histograms from one reference."""
    char_shares, word_shares = lang
    n_chars = F.aggregate(F.col("chars"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    n_common = F.aggregate(F.col("common"), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    char = sum((_term(F.col("chars")[i] / n_chars, F.lit(q)) for i, q in enumerate(char_shares)), F.lit(0.0))
    shares = F.create_map(*[F.lit(x) for pair in word_shares.items() for x in pair])

    def add(state, x):
        q = F.coalesce(F.try_element_at(shares, x["word"]), F.lit(0.0))
        return F.struct((state["d"] + _term(x["n"] / F.col("n_common_"), q)).alias("d"), (state["q"] + q).alias("q"))

    word = F.aggregate(
        F.col("common"), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), add,
        lambda s: s["d"] + F.greatest(F.lit(0.0), 1.0 - s["q"]),
    )
    root = lambda twice: F.sqrt(F.greatest(F.lit(0.0), twice) / 2)
    return F.when(n_chars > 0, root(char)).otherwise(1.0), F.when(n_common > 0, root(word)).otherwise(1.0)


NEAREST = "struct<both:double,lang:string,char:double,word:double,ok:boolean>"


def _own_distances(ref: Column) -> Column:
    """``NEAREST`` of a row and a reference over own words, and ``ok``: whether both distances are within their bounds."""
    root = lambda twice: F.sqrt(F.greatest(F.lit(0.0), twice) / 2)
    plus = lambda s, x: s + x
    char = root(F.aggregate(F.zip_with("chars", ref["chars"], lambda n, q: _term(n / F.col("n_all"), q)), F.lit(0.0), plus))
    hits = F.filter("own", lambda x: F.map_contains_key(ref["words"], x["word"]))

    def word(found):
        def add(state, x):
            q = F.element_at(ref["words"], x["word"])
            return F.struct((state["d"] + _term(x["n"] / state["n"], q)).alias("d"), (state["q"] + q).alias("q"), state["n"].alias("n"))

        n = F.aggregate(found, F.lit(0.0), lambda s, x: s + x["n"])
        start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), n.alias("n"))
        return F.when(F.size(found) == 0, 1.0).otherwise(root(F.aggregate(found, start, add, lambda s: s["d"] + F.greatest(F.lit(0.0), 1.0 - s["q"]))))

    def judged(d):
        noise = WORD_NOISE * F.sqrt(F.try_divide(F.lit(USUAL_COVER), ref["cover"] * F.col("n_words")))
        # without words of its own (no blanks between words, say) a language has no histogram to compare
        ok = _within(d["char"], d["word"], F.coalesce(MAX_WORD_DISTANCE + noise, F.lit(1.0)))
        return F.struct((d["char"] + d["word"]).alias("both"), ref["lang"].alias("lang"), d["char"].alias("char"), d["word"].alias("word"), ok.alias("ok"))

    return bind(F.struct(F.when(F.col("n_all") > 0, char).otherwise(1.0).alias("char"), bind(hits, word).alias("word")), judged)


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, base counts, ``base_failed``, the nearest language, its two distances, and ``kept``.

    ``docs``: ``text``, ``lang``; other columns only as ``keep``, whose names must not be those of the result. A document
    that passes the base rules is kept if, for some reference, its character distance is at most
    ``MAX_CHAR_DISTANCE + CHAR_NOISE / sqrt(words)`` and its word distance from the same one within the like bound of words. Under ``MIN_JUDGED_CHARS`` characters
    neither is judged, under ``MIN_JUDGED_WORDS`` words only the characters. References are those of the frequent
    languages and, where these leave a language out, that of the document's own one (of the frequent such if it names none). A document whose
    language is known but has no reference, and every document where there is none at all, is kept if it passes the base
    rules. A null or empty text has no words and fails them. Repeated rows are judged alike.
    """
    docs = docs.select("text", F.col("lang").alias("lang_"), *keep)
    counts = stored(document_counts(docs, "lang_", *keep), "quality-counts")
    languages = stored(language_sums(counts.withColumnRenamed("lang_", "lang"), "common"), "quality-languages")
    langs = references(counts.withColumnRenamed("lang_", "lang"), languages)
    covered = [r.lang for r in languages.filter(F.col("lang").isin(*langs) & (F.col("cover") >= MIN_COVER)).collect()] if langs else []
    others = languages.filter(~F.col("lang").isin(*covered) & (F.col("n") >= MIN_ROWS))
    frequent = [r.lang for r in others.orderBy(F.desc("n"), "lang").limit(MET).select("lang").collect()]
    no_own = F.array().cast(f"array<{NEAREST}>")
    if others.isEmpty():
        return _judged(counts.withColumn("own_", no_own), langs, covered, not langs, keep)
    place = F.pmod(F.xxhash64("text"), F.lit(1024)).alias("place_")
    docs = docs.select("*", place)
    listed = _joined(docs, own_lists(docs, others, frequent)).drop("place_")
    own = stored(document_counts(listed, "lang_", *keep, listed="listed_"), "quality-own-counts")
    refs = own_references(own.withColumnRenamed("lang_", "lang"), frequent)
    own = _joined(own.withColumn("place_", F.pmod(F.xxhash64("chars", "word_chars"), F.lit(1024))), refs).drop("place_").withColumn("n_all", _n_chars())
    own = own.withColumn("own_", F.transform("references_", _own_distances)).drop("own", "references_", "n_all")
    rest = counts.filter("lang_ is not null").join(others.select(F.col("lang").alias("lang_")), "lang_", "left_anti")
    return _judged(rest.withColumn("own_", no_own).unionByName(own), langs, covered, False, keep)


def _judged(counts: DataFrame, langs: dict, covered: list[str], none: bool, keep: tuple[str, ...]) -> DataFrame:
    """``counts`` with the array ``own_`` of :func:`_own_distances`, judged by these and ``langs``. ``none``: there is no reference at all."""
    counts = counts.withColumn("n_common_", _total("common")).withColumn("n_all", _n_chars())

    def from_reference(lang: str) -> Column:
        c, w = _distances(langs[lang])
        return bind(F.struct(c.alias("char"), w.alias("word")), lambda d: F.struct(
            (d["char"] + d["word"]).alias("both"), F.lit(lang).alias("lang"), d["char"].alias("char"), d["word"].alias("word"),
            _within(d["char"], d["word"], MAX_WORD_DISTANCE + F.lit(WORD_NOISE) / _root_of_words()).alias("ok")))

    found = [from_reference(lang) for lang in langs]
    counts = counts.withColumn("refs_", F.concat(F.array(*found).cast(f"array<{NEAREST}>"), "own_"))
    unknown = F.lit(none) | (F.col("lang_").isNotNull() & ~F.col("lang_").isin(*covered) & (F.size("own_") == 0))
    return counts.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        F.array_min("refs_").dropFields("ok").alias("nearest"), "n_all",
        (~base_failed() & (unknown | F.exists("refs_", lambda x: x["ok"]))).alias("kept"),
    )


def _within(char: Column, word: Column, word_bound: Column) -> Column:
    short = F.col("n_all") < MIN_JUDGED_CHARS
    char_ok = short | (char <= MAX_CHAR_DISTANCE + F.lit(CHAR_NOISE) / _root_of_words())
    return char_ok & (short | (F.col("n_words") < MIN_JUDGED_WORDS) | (word <= word_bound))


def _root_of_words() -> Column:
    return F.sqrt(F.greatest(F.lit(1), F.col("n_words")).cast("double"))

