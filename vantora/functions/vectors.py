"""Vector arithmetic as columns: everything in double precision, inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
TINY = 1e-10


def _d(x: Column) -> Column:
    return x.cast("double")


def total(values: Column) -> Column:
    """Sum of an array of numbers; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + _d(x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: _d(x) * _d(x))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where one of the vectors has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), 0.0).otherwise(dot(a, b) / (na * nb))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity, 1 where one of the vectors has no length."""
    return 1 - cosine_similarity(a, b)


def normalize(a: Column) -> Column:
    """The vector scaled to length one; one without length stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n < TINY, _d(x)).otherwise(_d(x) / n))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sign_words(a: Column, dim: int, word: int = 32) -> Column:
    """Sign bits packed into words: bit ``i % word`` of word ``i / word`` is set where component i > 0."""
    words = []
    for lo in range(0, dim, word):
        bits = [F.when(F.get(a, F.lit(i)) > 0, F.lit(1 << (i - lo))).otherwise(F.lit(0)).cast("bigint") for i in range(lo, min(lo + word, dim))]
        words.append(reduce(lambda x, y: x + y, bits))
    return F.array(*words)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance."""
    m = mean(a)
    return total(F.transform(a, lambda x: (_d(x) - m) * (_d(x) - m))) / F.size(a)


#: Scores by metric; smaller is better for all.
SCORES = {"l2": l2, "l2_squared": l2_squared, "cosine": cosine_distance, "dot": lambda a, b: -dot(a, b)}
#: Other names of the metrics; every other name means l2.
METRIC_NAMES = {"cosine": "cosine", "cos": "cosine", "dot": "dot", "dotproduct": "dot", "dot_product": "dot", "inner": "dot", "ip": "dot"}


def metric_of(name: str | None) -> str:
    return METRIC_NAMES.get((name or "").strip().lower(), "l2")
