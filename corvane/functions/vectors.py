"""Vector functions on ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the norm is at least 1e-12."""
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def minmax(scores: DataFrame, column: str, *by: str, name: str = "score") -> DataFrame:
    """Min-max normalised ``column`` within ``by``; a constant group becomes zeros."""
    w = Window.partitionBy(*by) if by else None
    if w is None:  # one row of extremes, no window over a single partition
        ends = scores.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        scores = scores.join(F.broadcast(ends))
    else:
        scores = scores.withColumn("_lo", F.min(column).over(w)).withColumn("_hi", F.max(column).over(w))
    span = F.col("_hi") - F.col("_lo")
    return scores.withColumn(name, F.when(span < 1e-12, 0.0).otherwise((F.col(column) - F.col("_lo")) / span)).drop("_lo", "_hi")


def _sum_of(vectors: Column, weights: Column) -> Column:
    """Weighted sum of an array of vectors."""
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(scaled, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def linspace_weights(n: Column) -> Column:
    """0.5 to 1 in even steps, scaled to the sum 1; a single weight is 1."""
    raw = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(n == 1, 1.0).otherwise(0.5 + 0.5 * i / F.greatest(n - 1, F.lit(1))))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def pool(vectors: Column, how: str, query: Column | None = None) -> Column:
    """One unit vector of an array of vectors: average, weighted_average, max_pool or attention; others average."""
    n = F.size(vectors)
    if how == "weighted_average":
        out = _sum_of(vectors, linspace_weights(n))
    elif how == "max_pool":
        zero = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
        out = F.aggregate(
            vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: F.when(F.abs(y.cast("double")) > F.abs(x), y.cast("double")).otherwise(x))
        )
    elif how == "attention":
        e = F.transform(vectors, lambda v: F.exp(dot(v, query)))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        out = _sum_of(vectors, F.transform(e, lambda x: x / total))
    else:
        out = _sum_of(vectors, F.transform(vectors, lambda v: F.lit(1.0) / n))
    return l2_normalize(out)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Deterministic stand-in for an embedder: signed counts of word and word-pair hashes, unit length."""
    from corvane.functions.text import words

    w = words(F.lower(text))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    cells = F.transform(F.concat(w, pairs), lambda t: F.crc32(F.encode(t, "UTF-8")))
    hashed = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda d: F.aggregate(
            F.filter(cells, lambda c: c % dims == d), F.lit(0.0), lambda a, c: a + F.when(F.floor(c / dims) % 2 == 0, 1.0).otherwise(-1.0)
        ),
    )
    return l2_normalize(hashed)
