"""Quantiles by distributed selection, and the bootstrap of a mean by multinomial counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolist.schema import drop_table, shared_table

#: Ranges into which a round of the selection cuts what it still looks at.
RANGES = 1024
#: Different differences whose counts a task of the bootstrap draws, and numbers of counts that it holds at once.
BUCKET, COUNTS_AT_ONCE = 8192, 4_000_000


def _cut(x: Column, low: float, high: float) -> Column:
    """The range, of RANGES, in which a number between low and high lies; wide stretches are cut evenly on a curved scale."""
    curved = low < 0 < high or max(abs(low), abs(high)) > 1e3 * max(1e-300, min(abs(low), abs(high)))
    a, b = (math.asinh(low), math.asinh(high)) if curved else (low, high)
    at = F.asinh(x) if curved else x
    # halves, for the width of all double numbers isn't one
    share = (at / 2 - a / 2) / F.lit(b / 2 - a / 2) if b > a else F.lit(0.0)
    return F.least(F.greatest(F.floor(share * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int")


def values_at(values: DataFrame, ranks: set[int]) -> dict[int, float]:
    """The values at some places, from 0, of a column v in ascending order.

    Each round counts what lies in the ranges of a stretch around each place and goes on with the range that holds it, until that
    holds one value only. Counts are added up before they are shuffled; no task and no driver holds more than the ranges.
    """
    low, high = values.agg(F.min("v"), F.max("v")).first()
    open_, found = {(low, high, 0): sorted(ranks)}, {}
    while open_:
        for (low, high, _), own in list(open_.items()):
            if low == high:
                found |= dict.fromkeys(own, low)
        open_ = {s: own for s, own in open_.items() if s[0] < s[1]}
        if not open_:
            break
        stretches = sorted(open_)
        cases = [(F.col("v").between(low, high), _cut(F.col("v"), low, high) + i * RANGES) for i, (low, high, _) in enumerate(stretches)]
        place = F.coalesce(*(F.when(c, x) for c, x in cases))
        rows = values.select("v", place.alias("p")).where("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        held: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r.p):
            held.setdefault(r.p // RANGES, []).append(r)
        after: dict[tuple[float, float, int], list[int]] = {}
        for i, s in enumerate(stretches):
            at = s[2]
            for r in held[i]:
                if own := [x for x in open_[s] if at <= x < at + r.n]:
                    after[r.low, r.high, at] = own
                at += r.n
        open_ = after
    return found


def quantiles(df: DataFrame, column: str | Column, probabilities: list[float]) -> list[float | None]:
    """Interpolated quantiles of a column, those of F.percentile, whatever its size; missing and NaN values don't count.

    None for each where no value is left.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    values = shared_table(df.select(x.alias("v")).where("v is not null and not isnan(v)"), "quantiles")
    n = values.count()
    places = [p * (n - 1) for p in probabilities]
    found = values_at(values, {k for p in places for k in (math.floor(p), math.ceil(p))}) if n else {}
    drop_table(values)
    if not n:
        return [None] * len(probabilities)
    ends = [(found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)) for p in places]
    return [low if low == high else low * (1 - share) + high * share for low, high, share in ends]  # between equals, their very value


def resampled_means(differences: DataFrame, resamples: int, seed: int, bucket: int = BUCKET) -> DataFrame:
    """(i, m): the mean of each of `resamples` samples of as many differences, drawn with replacement. differences: difference.

    How often a sample holds each different value follows a multinomial law. Its counts are dealt over buckets of values, by
    binomials given what the buckets before it have got, and within a bucket over its values. Every task draws the buckets' shares
    from the same seed, so nothing but each bucket's size is known to all, and no row is drawn or looped over by itself.
    """
    values = differences.groupBy(F.col("difference").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    values = shared_table(values, "differences")
    buckets = max(1, math.ceil(values.count() / bucket))
    values_in = values.withColumn("b", F.pmod(F.xxhash64("d"), F.lit(buckets)).cast("int"))
    # one number a bucket of thousands of different values
    sizes = dict(map(tuple, values_in.groupBy("b").agg(F.sum("c")).collect()))
    n = sum(sizes.values())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = int(frame["b"].iloc[0])
        rng, left, rest = np.random.default_rng([seed, 0]), np.full(resamples, n), n
        for b in sorted(sizes):
            share = rng.binomial(left, sizes[b] / rest)
            if b == own:
                break
            left, rest = left - share, rest - sizes[b]
        frame = frame.sort_values("d")
        d, p = frame["d"].to_numpy(), frame["c"].to_numpy() / sizes[own]
        total, rng = np.empty(resamples), np.random.default_rng([seed, 1, own])
        step = max(1, COUNTS_AT_ONCE // len(d))
        for i in range(0, resamples, step):
            total[i : i + step] = rng.multinomial(share[i : i + step], p) @ d
        return pd.DataFrame({"i": np.arange(resamples), "t": total})

    sums = values_in.groupBy("b").applyInPandas(run, "i long, t double").groupBy("i").agg(F.sum("t").alias("t"))
    return sums.select("i", (F.col("t") / F.lit(float(n))).alias("m"))
