import random

import pytest

WORDS = "the of and to in that is for it was on are as with his they at be this from have or by one had not but what all".split()
LONG = " ".join(w + str(i % 97) for i, w in enumerate(random.Random(1).choices(WORDS, k=30_000)))
PROSE = " ".join(random.Random(2).choices(WORDS, k=120))

#: Nulls in every column, empty and blank texts, a long text, repeated rows, shared ids, odd characters.
ODD_ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, None, "a"), (3, None, "en", None), (4, "", "en", "a"), (5, " \n\t ", "fr", "b"),
    (None, PROSE, "en", "a"), (None, None, None, None), (6, LONG, "en", "a"), (7, "...", "de", "a"), (8, "12 34", "de", "a"),
    (9, "Größe 漢字 🙂  x\x1cy\x85z", "de", "a"), (10, PROSE.upper(), "en", "a"), (11, "word", "en", "a"), (12, PROSE + " tail", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """``ODD_ROWS`` with further columns whose names operators use themselves."""
    extra = "score double, kept boolean, labels string, host string, node bigint, row_ int, component_id string, `a b` int"
    rows = [(*r, 0.5, False, "x", "h", 1, 2, "c", 3) for r in ODD_ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + extra).repartition(3)


@pytest.fixture(scope="session")
def mixed_docs(spark, odd_docs):
    """``odd_docs`` among forty clean documents, ids from 100."""
    rng = random.Random(7)
    rows = [(100 + k, " ".join(rng.choice(WORDS) for _ in range(150)), "en", "a", 0.5, False, "x", "h", 1, 2, "c", 3) for k in range(40)]
    return odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
