"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def percentile_rank(score: Column | str, *by: str) -> Column:
    """Average rank of ties over the group's size, in (0, 1]; a missing score has none."""
    score = F.col(score) if isinstance(score, str) else score
    group, present = Window.partitionBy(*by), score.isNotNull()
    rank = F.rank().over(group.orderBy(score.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, score))
    return F.when(present, (rank + (ties - 1) / 2) / F.count(score).over(group))


def genre_list(genres: Column | str) -> Column:
    """Names between vertical bars."""
    return F.split(genres, r"\|")


def pearson(a: str, b: str) -> Column:
    """Correlation within a group; null where either side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all elements of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def iso_utc(seconds: Column | str) -> Column:
    """Epoch seconds as ISO-8601 text in UTC; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def hash_order(seed: int, *columns: str) -> Column:
    """A number to order by that depends on the seed and the columns alone, however rows are partitioned."""
    return F.xxhash64(F.lit(seed), *columns)


def is_half_star(rating: Column) -> Column:
    """Whether a rating is one of 0.5, 1.0, ..., 5.0; false where missing."""
    twice = rating.cast("double") * 2
    return F.coalesce(rating.between(0.5, 5.0) & (F.abs(twice - F.rint(twice)) <= 1e-8 + 1e-5 * F.abs(F.rint(twice))), F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
