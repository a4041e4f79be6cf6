"""Collocations, spelling variants and the secret ledger against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, secret_ledger, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- collocations -------------------------------------------------------------------------------------------------


def phrases(rows):
    """Per language the word total and the counts of all phrases of 1 to 5 words."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang or "und", tuple(words[i : i + k])] += 1
    return n, f


def best(rows, least, top):
    n, f = phrases(rows)
    f = {k: v for k, v in f.items() if v >= least}
    found = []
    for (lang, w), a in f.items():
        if len(w) == 1:
            continue
        longer = (v for (x, y), v in f.items() if x == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y))))
        if any(100 * v >= 100 * a for v in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, total, -score))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = "New york Times of the city über Straße 東京 a\x1cb it's x\x85y big".split(" ")
    weights = [9, 9, 7, 5, 5, 4, 2, 2, 2, 1, 1, 1, 1]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "? "]
    rows = []
    for k in range(n):
        text = "".join(w + rng.choice(ends) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((k, text + rng.choice(["", "the new york times"]), rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(900, None, "en"), (901, "", None), (902, " .. ,\t", "de"), (None, "new york city", None), (5, "york york york york york york", "xx")]


def test_collocations_equal_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("w1", F.lit(1)).repartition(5)
    for least, top in ((3, 2000), (6, 7)):
        got = [tuple(r) for r in collocations.collocations(docs, min_count=least, top=top).collect()]
        assert sorted(got) == sorted(best([(lang, text) for _, text, lang in rows], least, top))


def test_all_phrase_counts(spark):
    rows = corpus(8, 30)
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    n, f = phrases([(lang, text) for _, text, lang in rows])
    got = collocations.phrase_counts(docs, min_count=2).collect()
    assert {(r.lang, r.phrase): r.f for r in got if r.words} == {(x, " ".join(w)): v for (x, w), v in f.items() if v >= 2}
    assert {r.lang: r.f for r in got if not r.words} == {k: v for k, v in n.items() if v}
    assert all(len(r.phrase.split(" ")) == r.words for r in got if r.words)


def test_collocations_on_odd_tables(odd_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    got = collocations.collocations(odd_docs, min_count=5).collect()
    assert {"en"} <= {r.lang for r in got} and all(r.a >= 5 and r.n >= 5 for r in got)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_blocks_cut_between_pieces(monkeypatch, block):
    """Texts are read whole whatever the block; only ends of pieces and of texts part blocks."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rows = [(text, lang or "und") for _, text, lang in corpus(4, 20) if text] + [("one piece without an end " * 30, "en"), ("a.b", "en"), ("c", "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], names=["lang", "text"])
    seen = []
    for words, names, _ in collocations._blocks(iter([batch.slice(0, 9), batch.slice(9), batch.slice(0, 0)])):
        known = words.known.to_pylist()
        seen += [(names[x], known[i], j) for x, i, j in zip(words.lang, words.ids, [False, *words.joined])]
    want = []
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            want += [(lang, w, i > 0) for i, w in enumerate(re.findall(r"[^\x20\x09]+", piece))]
    assert seen == want


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**11 + 7, 8 * 10**14 + 3, 9 * 10**12 + 1, 7 * 10**12 + 9
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in dict(a=a, n=n, l=l, r=r).items()]).select(collocations.cut_score().alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)


# ---- spelling variants --------------------------------------------------------------------------------------------


def apart(a, b):
    """Whether exactly one inserted, deleted or replaced character parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_table(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 11))) for _ in range(25)] + ["separate", "necessary", "aaaaaaa", "aaaaaaaa", "÷×straßeÿ"]
    pool = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            pool.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abéz") + w[i:], w[:i] + rng.choice("abéz") + w[i + 1 :]]))
    rows = []
    for k in range(90):
        words = rng.choices(pool, [60 if w in base else 1 for w in pool], k=40)
        rows.append((k, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    chain = "chainede " * 3 + "chainedf " * 40 + "chainedfg " * 500 + "chainedfgh " * 6000  # forms of forms
    return rows + [(90, None), (91, ""), (None, " ".join(pool)), (None, " ".join(pool)), (92, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999), (93, ("x" * 2999 + " ") * 30), (94, chain)]


def test_variants_equal_brute_force(spark):
    for seed in (1, 2):
        rows = spelled(seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
        got = [tuple(r) for r in variants.variants(docs).collect()]
        want = variant_table(rows)
        assert len(got) == len(want) and set(got) == want
    roots = {w: r for w, _, r, *_ in want}
    assert roots["chainede"] == "chainedfgh"


def test_each_link_once(spark):
    words = [("abcdefg", 5), ("abcdefgh", 5), ("xabcdefg", 5), ("abcxdefg", 5), ("abczefg", 5), ("aaaaaaa", 2), ("aaaaaaaa", 2), ("gfedcba", 9)]
    links = variants.near_words(spark.createDataFrame(words, "word string, n bigint")).collect()
    pairs = [frozenset((r.a, r.b)) for r in links]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a, _ in words for b, _ in words if a < b and apart(a, b)}


def test_variants_on_odd_tables(odd_docs, no_docs):
    assert variants.variants(no_docs).count() == 0
    assert variants.variants(odd_docs).filter("root is null or n < 2 or n_near is null").count() == 0


# ---- secrets ------------------------------------------------------------------------------------------------------

PATTERNS = {r.kind: (re.compile(r.pattern), r.group, r.least) for r in secret_ledger.RULES}


def spans(text):
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


SECRETS = [
    None, "", "password=hunter22", "PassWord : 'abc' secret=token=abcdef", 'password=token:"abcdef"', "é漢🙂 api_key=\"A+/=_.-1\" 🙂 apikey:12345",
    "AKIA" + "Z" * 16 + " AKIAAKIA" + "1" * 11 + " AKIA" + "9" * 40, "deadbeef" * 3 + "x" + "0" * 23 + " " + "abcdef0123456789" * 500,
    "token = " + "a" * 5 + "\ntoken = " + "b" * 6 + " tokentoken=123456", " ".join(f"secret={k:06d} é" for k in range(700)),
    "ghp_" + "a1" * 18 + " xoxb-1234567890-ab eyJhbGciOi12.eyJzdWIiOi12.abcdefgh12 -----BEGIN RSA PRIVATE KEY----- token=deadbeefdeadbeefdeadbeef",
    "ſecret=abcdefg toKen=1234567 " + "f" * 24, "no secrets here at all",
]


def test_spans_equal_plain_patterns(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(SECRETS)] + [(2, SECRETS[2]), (None, SECRETS[6]), (50, SECRETS[9]), (51, SECRETS[9])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("blob", F.lit("clash")).repartition(3)
    got = secret_ledger.scan(docs, str(tmp_path / "ledger"), "doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id, [tuple(f) for f in r.findings]) for r in got if r.doc_id is not None) == sorted(
        (False, k, spans(t)) for k, t in rows if k is not None)
    assert [[tuple(f) for f in r.findings] for r in got if r.doc_id is None] == [spans(SECRETS[6])]
    assert all(r.blob == hashlib.sha256((dict((k, t) for k, t in rows)[r.doc_id] or "").encode()).hexdigest() for r in got)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    table = lambda rows: spark.createDataFrame(rows, "path string, text string")
    noted = lambda: {(r.blob, tuple(r.rules)) for r in secret_ledger.read_ledger(spark, ledger).collect()}
    first = [("a", SECRETS[2]), ("b", SECRETS[2]), ("c", SECRETS[6]), ("d", None)]
    assert secret_ledger.read_ledger(spark, ledger) is None
    before = {r.path: r.findings for r in secret_ledger.scan(table(first), ledger, "path").collect()}
    assert before["a"] == before["b"] and before["a"] and not before["d"]
    assert len(noted()) == 3  # one note a blob, not a path
    secret_ledger.scan(table(first), ledger, "path").collect()
    assert secret_ledger.read_ledger(spark, ledger).count() == 3
    # a later version of one path, and a copy of an old text under a new path
    after = {r.path: r.findings for r in secret_ledger.scan(table([*first, ("a", SECRETS[10]), ("e", SECRETS[6])]), ledger, "path", ).collect() if r.path == "e"}
    assert after["e"] == before["c"]
    assert secret_ledger.read_ledger(spark, ledger).count() == 4
    # a rule's new version reads all blobs, by that rule only
    longer = tuple(r._replace(version=2, least=30) if r.kind == "assign" else r for r in secret_ledger.RULES)
    again = {r.path: r.findings for r in secret_ledger.scan(table(first), ledger, "path", rules=longer).collect()}
    assert again["a"] == [] and again["c"] == before["c"]
    new = [r for r in secret_ledger.read_ledger(spark, ledger).collect() if "assign@2" in r.rules]
    assert len(new) == 3 and all(r.rules == ["assign@2"] for r in new)


def test_an_ended_run_is_repeated(spark, tmp_path):
    """A note written twice, as by two runs at once, gives its findings once."""
    ledger = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, SECRETS[9])], "doc_id int, text string")
    one = secret_ledger.scan(docs, ledger, "doc_id").collect()
    secret_ledger.read_ledger(spark, ledger).write.mode("append").parquet(ledger + "-copy")
    spark.read.parquet(ledger + "-copy").write.mode("append").parquet(ledger)
    assert secret_ledger.scan(docs, ledger, "doc_id").collect() == one and len(one[0].findings) == 700


def test_secrets_on_odd_tables(odd_docs, no_docs, tmp_path):
    assert secret_ledger.scan(no_docs, str(tmp_path / "none"), "doc_id").count() == 0
    assert secret_ledger.scan(odd_docs, str(tmp_path / "odd"), "doc_id", "a b", "labels").count() == odd_docs.count()
