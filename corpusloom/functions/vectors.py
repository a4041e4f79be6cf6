"""Vector columns: hash embedding, normalising, cosine, validation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIGEST_BYTES = 32


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda would otherwise evaluate it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def hash_embedding(text: Column, dimension: int = 384) -> Column:
    """Repeatable unit vector of a text from SHA-256 digests of the text and a 4-byte counter.

    The text is hashed as bytes; each digest byte ``b`` gives ``b / 127.5 - 1``.
    """
    raw = F.encode(text, "UTF-8")
    blocks = -(-dimension // DIGEST_BYTES)
    digests = F.concat(*[F.sha2(F.concat(raw, F.unhex(F.lit(f"{n:08x}"))), 256) for n in range(blocks)])
    vector = bind(
        digests,
        lambda d: F.transform(
            F.sequence(F.lit(0), F.lit(dimension - 1)),
            lambda i: F.conv(F.substr(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(127.5) - F.lit(1.0),
        ),
    )
    return l2_normalize(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return bind(
        v,
        lambda u: bind(
            norm(u),
            lambda length: F.when(length > 0, F.transform(u, lambda x: x.cast("double") / length)).otherwise(
                F.transform(u, lambda x: x.cast("double"))
            ),
        ),
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    return bind(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def similarity_score(cosine: Column) -> Column:
    """Cosine clamped to [0, 1], four decimals."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 4)


def cosine_distance(cosine: Column) -> Column:
    return F.bround(F.lit(1.0) - cosine, 4)


def is_valid_vector(v: Column, dimension: Column | int) -> Column:
    wanted = dimension if isinstance(dimension, Column) else F.lit(dimension)
    return F.coalesce(F.size(v) == wanted, F.lit(False))
