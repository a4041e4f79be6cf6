"""Operators on DataFrame functions: rows against plain Python on odd rows; the oracles on the smallest driver tables."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licenses, queries, quality_rules, url_reputation as urls

SF = Path("/root/testdata/sf0.001")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    from check_oracles import compare, connect

    ok, message = compare(spark, connect(str(SF)), str(SF), name)
    assert ok, message


def base_counts(text):
    words = BLANK.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 2000 else None
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), covered and len(covered))


TEXTS = [
    None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x " * 40, "one two three\none two three\n\n one two three\none two three",
    "é漢 🙂 # é漢 🙂 # é漢", "a b c d a b c e a b d", "|*| <&> #$%\n" * 5, "t u v\x1cw t u v\x1cw t", "p q r p q s p q r",
]


def test_base_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for r in quality_rules.document_counts(df, "doc_id").collect():
        want = base_counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words or None) == (*want[:4], want[4] or None), TEXTS[r.doc_id]


def test_colliding_window_hashes(spark, monkeypatch):
    """With a constant hash all windows seem equal; the words decide."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(1 << 40).cast("bigint"))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = quality_rules.document_counts(df, "doc_id").collect()
    monkeypatch.undo()
    for r in rows:
        assert (r.n_repeat_words or None) == (base_counts(TEXTS[r.doc_id])[4] or None), TEXTS[r.doc_id]


def test_quality_verdicts_on_odd_rows(mixed_docs, odd_docs, no_docs):
    rows = quality_rules.judge(mixed_docs, "doc_id", "a b").collect()
    assert len(rows) == mixed_docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert {1, 2, 12, *range(100, 140)} <= kept and 10 not in kept and 3 not in kept and 4 not in kept
    assert quality_rules.judge(no_docs, "doc_id").count() == 0
    alone = quality_rules.judge(odd_docs.withColumn("lang", F.lit(None).cast("string")), "doc_id")
    assert all(r.kept != r.base_failed for r in alone.collect())


RUSSIAN = "и в не на я что он с как это по но они мы из у за вы так же от для до бы ты к ещё о когда только".split()
GREEK = "και το να του η της με που την από για είναι οι στο θα τα δεν των σε ότι τον μια αλλά πως".split()


def test_every_language_is_judged_by_its_own_words(spark):
    """Frequent languages of other words, rare ones and those of a few rows keep their clean documents and lose others."""
    rng = random.Random(5)
    prose = lambda words, n=90: " ".join(rng.choice(words) for _ in range(n)) + "."
    names = ["в" + "".join(rng.choice("абвгдежз") for _ in range(5)) for _ in range(3000)]
    lone = lambda: " ".join("".join(rng.choice("天地玄黄宇宙洪荒日月") for _ in range(9)) for _ in range(60))
    rows = [(k, prose("the of and to in that is for it was on are as with his they at be".split(), 60), "en") for k in range(2600)]
    rows += [(3000 + k, prose(RUSSIAN + names[:30]), "ru") for k in range(300)]
    rows += [(4000 + k, prose(GREEK), "el") for k in range(24)] + [(5000 + k, prose(GREEK, 55), "gr") for k in range(3)]
    rows += [(5100 + k, lone(), "zh") for k in range(60)] + [(5200, prose(RUSSIAN + names[:30]), None), (5201, prose(GREEK), None)]
    poor = [(6000, " ".join(f"#{i}$ {i * 7919}%" for i in range(80)), "ru"), (6001, " ".join(names[100:300]), "ru"), (6002, " ".join(f"#{i}$ {i * 7919}%" for i in range(80)), None)]
    docs = spark.createDataFrame(rows + poor, "doc_id int, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in quality_rules.judge(docs, "doc_id").collect()}
    assert len(got) == len(rows) + len(poor)
    lost = [(r[0], got[r[0]].nearest) for r in rows if not got[r[0]].base_failed and not got[r[0]].kept]
    assert not lost and not any(got[r[0]].base_failed for r in rows if r[0] > 2600), lost[:5]
    assert not any(got[r[0]].kept or got[r[0]].base_failed for r in poor[:2]) and not got[6002].kept
    assert got[3000].nearest.lang == "ru" and got[5201].nearest.lang == "el"


def places(text, phrase):
    words, p = LICENCE_WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), phrase.split()
    return len(words), [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


LICENCES = [
    None, "", "MIT", "Released under the MIT License.", "Apache license version 2 and cc-by-nc; under the mit license", "cc by nc cc by nc by nc",
    "under the mit\nLICENSE under the licence", "x " * 50 + "licensed under the GNU General Public License, version 3.", "Under The Mİt license",
    "apache license version 22 apache License, VERSION 2.0", "creative commons attribution 4 international license", "by by by nc cc cc by",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software", "under the K mit license",
    "cc by nc " * 3000, "license " * 5000 + "version 2",
]


def test_licence_places(spark):
    df = spark.createDataFrame(list(enumerate(LICENCES)), "doc_id int, text string")
    for r in licenses.scan(df, "doc_id").collect():
        found = {t.label: places(LICENCES[r.doc_id], t.text) for t in licenses.BASE}
        starts = sorted(s for _, ss in found.values() for s in ss)
        assert r.n_words == next(iter(found.values()))[0]
        assert (r.n_base, r.first_word, r.last_word) == (len(starts), starts[0] if starts else None, starts[-1] if starts else None), r
        assert r.base_labels == ",".join(sorted(label for label, (_, ss) in found.items() if ss))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1.0 or not starts
    labels = {r.doc_id: r.labels for r in licenses.scan(df, "doc_id").collect()}
    assert "gpl" in labels[7] and "mit" in labels[12] and "mit" in labels[3] and labels[13] == ""


def test_licences_on_odd_rows(odd_docs, no_docs):
    rows = licenses.scan(odd_docs, "doc_id", "a b").collect()
    assert len(rows) == odd_docs.count() and all(r.labels == "" for r in rows)
    assert licenses.scan(no_docs, "doc_id").count() == 0


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.NET/en/x?y#z"), (5, "https://a.example.net"), (6, "http://net/"),
    (7, "http://example.com/de/1"), (8, "http://m.example.com/dex"), (9, "http://q.org/fr/1"), (10, "x://h?p=/fr/"), (11, "http://notexample.net.uk/en/"),
    (12, "http://example.net/EN/"), (None, "http://b.co.uk/1"), (1, None), (13, "http://h.example.com:80/de/2"), (14, "http://a\nb.net/x"), (15, "a://b://c.net/d"),
]


def rule_for(host, path):
    fits = [r for _, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


def test_urls(spark):
    pages = spark.createDataFrame([(*r, "x", "y") for r in URLS], "page_id int, url string, host string, verdict string")
    good = [("good.org", 1)] * 30 + [("bad.org", 0)] * 30 + [("m.example.com", 1)] * 5 + [(None, 1), ("n.org", None)]
    outcomes = spark.createDataFrame(good, "host string, good int")
    rows = urls.judge_urls(pages, outcomes).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        url = dict((k, v) for k, v in URLS if k is not None).get(r.page_id, "http://b.co.uk/1") or ""
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        assert (r.host, r.path, r.rule) == (host, path, rule_for(host, path)), url
        if r.rule:
            assert r.verdict == next(v for v, x in urls.RULES if x == r.rule)
    probe = spark.createDataFrame([(1, "http://good.org/"), (2, "http://bad.org/"), (3, "http://new.good.org/"), (4, "http://unknown.info/")], "page_id int, url string")
    verdicts = {r.page_id: r for r in urls.judge_urls(probe, outcomes).collect()}
    assert verdicts[1].verdict == "allow" and verdicts[2].verdict == "block"
    assert verdicts[1].bound > verdicts[3].bound > verdicts[2].bound
    assert urls.judge_urls(probe, outcomes.limit(0)).count() == 4
    assert urls.judge_urls(pages.limit(0), outcomes).count() == 0


def test_both_distances_are_held_by_one_reference(spark):
    """A document is kept if some reference is near in both, though another one is nearer in their sum."""
    row = [(1, 100, 1000, 0, 0, 0, [900, 20, 0, 0, 70, 10, 0, 0], [("the", 40), ("of", 10)], "en", [])]
    schema = ("doc_id int, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars array<bigint>, "
              f"common array<struct<word:string,n:int>>, lang_ string, own_ array<{quality_rules.NEAREST}>")
    df = spark.createDataFrame(row, schema)
    near_words = ([.4, .3, .0, .0, .2, .1, .0, .0], {"the": .8, "of": .2})  # char distance over its bound, words equal
    near_both = ([.9, .02, .0, .0, .07, .01, .0, .0], {"the": .35, "of": .15, "and": .3, "to": .2})
    get = lambda langs: quality_rules._judged(df, langs, ["en"], False, ("doc_id",)).first()
    assert not get({"a": near_words}).kept and get({"b": near_both}).kept
    both = get({"a": near_words, "b": near_both})
    assert both.kept and both.nearest.lang == min(((get({"a": near_words}).nearest.both, "a"), (get({"b": near_both}).nearest.both, "b")))[1] == "a"
