"""Evaluation of shared lists: relevance, NDCG, recall, coverage, overlap and paired bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolist.operators.cohorts import pair_members, seen_by_pair
from duolist.operators.statistics import quantiles, resampled_means
from duolist.schema import assert_unique, require_columns, shared_table


def relevant_items(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (userId, movieId) of events inside the catalogue."""
    return events.select("userId", "movieId").distinct().join(catalog.select("movieId"), "movieId", "left_semi").select("userId", "movieId")


def pair_relevant_items(pairs: DataFrame, events: DataFrame, catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """(pairId, userId, movieId): each member's relevant items less what either member has seen."""
    own = pair_members(pairs).join(relevant_items(events, catalog), "userId").select("pairId", "userId", "movieId")
    return own.join(seen_by_pair(pairs, seen), ["pairId", "movieId"], "left_anti").select("pairId", "userId", "movieId")


def ideal_dcg(k: int):
    """The best possible gain of n relevant items among the first k, for a column n."""
    table = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, k + 2)))])
    return F.array(*map(F.lit, table.tolist()))


def member_metrics(recommendations: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(pairId, userId, ndcg, recall, hits, relevant) of both members of each pair that has a list."""
    if k <= 0:
        raise ValueError("k must be positive")
    lists = recommendations.where(F.col("rank") <= k).select("pairId", "movieId", "rank")
    hits = lists.join(relevant, ["pairId", "movieId"]).groupBy("pairId", "userId").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count(F.lit(1)).alias("hits"))
    size = relevant.groupBy("pairId", "userId").agg(F.count(F.lit(1)).alias("relevant"))
    out = size.join(hits, ["pairId", "userId"], "left")
    best = F.element_at(ideal_dcg(k), (F.least("relevant", F.lit(k)) + 1).cast("int"))
    return out.select("pairId", "userId", (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"), F.coalesce("hits", F.lit(0)).alias("hits"), "relevant")


def pair_metrics(recommendations: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row per pair that has a list and relevant items on both sides."""
    require_columns(recommendations, ["pairId", "userA", "userB", "rank", "movieId"], "recommendations")
    listed = recommendations.select("pairId", "userA", "userB").distinct()
    each = member_metrics(recommendations, relevant, k)
    a = each.select("pairId", F.col("userId").alias("userA"), F.col("ndcg").alias("ndcgA"), F.col("recall").alias("recallA"))
    b = each.select("pairId", F.col("userId").alias("userB"), F.col("ndcg").alias("ndcgB"), F.col("recall").alias("recallB"))
    both = listed.join(a, ["pairId", "userA"]).join(b, ["pairId", "userB"])
    n = lambda c: f"{c}@{k}"
    return both.select("pairId", "userA", "userB", F.col("ndcgA").alias(n("ndcgA")), F.col("ndcgB").alias(n("ndcgB")), ((F.col("ndcgA") + F.col("ndcgB")) / 2).alias(n("averageNDCG")), F.least("ndcgA", "ndcgB").alias(n("minimumNDCG")), F.abs(F.col("ndcgA") - F.col("ndcgB")).alias(n("ndcgGap")), F.col("recallA").alias(n("recallA")), F.col("recallB").alias(n("recallB")), ((F.col("recallA") + F.col("recallB")) / 2).alias(n("averageRecall")), F.least("recallA", "recallB").alias(n("minimumRecall")))


def method_summary(recommendations: DataFrame, relevant: DataFrame, catalog_size: int, k: int = 10) -> DataFrame:
    """One row: pairs evaluated and skipped, means, coverage of the catalogue by evaluated pairs, and hit rates."""
    metrics = pair_metrics(recommendations, relevant, k)
    listed = recommendations.select("pairId").distinct()
    items = recommendations.where(F.col("rank") <= k).join(metrics.select("pairId"), "pairId", "left_semi").agg(F.count_distinct("movieId").alias("unique_items"))
    a, b = F.col(f"`recallA@{k}`") > 0, F.col(f"`recallB@{k}`") > 0
    means = [F.avg(f"`{c}@{k}`").alias(f"mean_{c}") for c in ("averageNDCG", "minimumNDCG", "ndcgGap", "averageRecall", "minimumRecall")]
    rates = [F.avg(x.cast("double")).alias(n) for n, x in (("two_sided_hit_rate", a & b), ("one_sided_hit_rate", a != b), ("no_hit_rate", ~(a | b)))]
    found = metrics.agg(F.count(F.lit(1)).alias("evaluated_pairs"), *means, *rates)
    return found.join(listed.agg(F.count(F.lit(1)).alias("listed"))).join(items).withColumn("skipped_pairs", F.col("listed") - F.col("evaluated_pairs")).withColumn("catalog_coverage", F.col("unique_items") / F.lit(catalog_size)).drop("listed")


def require_evaluated(summary: DataFrame) -> DataFrame:
    """summary, or ValueError if no pair was evaluated."""
    if not summary.first().evaluated_pairs:
        raise ValueError("no pair has relevant items on both sides")
    return summary


def compare_rankings(recommendations: DataFrame, reference: str, k: int = 10) -> DataFrame:
    """(method, comparedPairs, identicalTopKPairRate, meanItemOverlapAtK, meanPositionAgreementAtK) against one method's lists."""
    lists = recommendations.where(F.col("rank") <= k).select("method", "pairId", "rank", "movieId")
    sizes = lists.groupBy("method", "pairId").agg(F.count(F.lit(1)).alias("n"))
    ref = lists.where(F.col("method") == reference)
    shared = lists.join(ref.select("pairId", "movieId", F.col("rank").alias("r")), ["pairId", "movieId"]).groupBy("method", "pairId").agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("rank") == F.col("r")).alias("same"))
    both = sizes.join(sizes.where(F.col("method") == reference).select("pairId", F.col("n").alias("m")), "pairId").join(shared, ["method", "pairId"], "left")
    least, common, same = F.least("n", "m"), F.coalesce("common", F.lit(0)), F.coalesce("same", F.lit(0))
    identical = ((F.col("n") == F.col("m")) & (same == F.col("n"))).cast("double")
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("comparedPairs"), F.avg(identical).alias("identicalTopKPairRate"), F.avg(common / least).alias("meanItemOverlapAtK"), F.avg(same / least).alias("meanPositionAgreementAtK")).withColumn("referenceMethod", F.lit(reference))


def paired_differences(metrics: DataFrame, method_a: str, method_b: str, metric: str) -> DataFrame:
    """(pairId, difference) of pairs that both methods have; ValueError if a method has a pair twice."""
    assert_unique(metrics, ["method", "pairId"], "metrics")
    a = metrics.where(F.col("method") == method_a).select("pairId", F.col(f"`{metric}`").alias("a"))
    b = metrics.where(F.col("method") == method_b).select("pairId", F.col(f"`{metric}`").alias("b"))
    return a.join(b, "pairId").where("a is not null and b is not null").select("pairId", (F.col("a") - F.col("b")).alias("difference"))


def paired_bootstrap(metrics: DataFrame, method_a: str, method_b: str, metric: str, resamples: int = 10_000, seed: int = 20_260_828) -> DataFrame:
    """One row: mean difference over common pairs, percentile 95% interval and share above 0 of resampled means.

    A resample draws as many pairs as there are, with replacement; see resampled_means. ValueError if no pair is common.
    """
    diffs = shared_table(paired_differences(metrics, method_a, method_b, metric), "differences")
    n, mean = diffs.agg(F.count(F.lit(1)), F.avg("difference")).first()
    if not n:
        raise ValueError("the methods have no pair in common")
    means = shared_table(resampled_means(diffs, resamples, seed), "means")
    low, high = quantiles(means, "m", [0.025, 0.975])
    out = means.agg(F.avg((F.col("m") > 0).cast("double")).alias("bootstrapProbabilityAboveZero"))
    return out.select(F.lit(method_a).alias("methodA"), F.lit(method_b).alias("methodB"), F.lit(metric).alias("metric"), F.lit(n).alias("commonPairs"), F.lit(mean).alias("meanDifferenceAminusB"), F.lit(low).alias("ci95Lower"), F.lit(high).alias("ci95Upper"), "bootstrapProbabilityAboveZero", F.lit(resamples).alias("resamples"), F.lit(seed).alias("randomSeed"))


def subgroup_summary(metrics: DataFrame, bands: DataFrame, band: str, k: int = 10) -> DataFrame:
    """(band, method, pairs, four means); ValueError if a pair has no band."""
    joined = metrics.join(bands.select("pairId", band), "pairId", "left")
    if not joined.where(F.col(band).isNull()).isEmpty():
        raise ValueError("some pairs have no band")
    names = ("minimumNDCG", "averageNDCG", "ndcgGap", "averageRecall")
    return joined.groupBy(band, "method").agg(F.count_distinct("pairId").alias("pairs"), *(F.avg(f"`{c}@{k}`").alias(f"mean_{c}") for c in names))


def conflict_summary(metrics: DataFrame, bands: DataFrame, k: int = 10) -> DataFrame:
    """(method, conflictBand, pairs, six means, two hit rates)."""
    joined = metrics.join(bands.select("pairId", "conflictBand"), "pairId", "left")
    a, b = F.col(f"`recallA@{k}`") > 0, F.col(f"`recallB@{k}`") > 0
    names = ("averageNDCG", "minimumNDCG", "ndcgGap", "averageRecall", "minimumRecall")
    return joined.groupBy("method", "conflictBand").agg(F.count(F.lit(1)).alias("pairs"), *(F.avg(f"`{c}@{k}`").alias(f"mean_{c}") for c in names), F.avg((a & b).cast("double")).alias("two_sided_hit_rate"), F.avg((~(a | b)).cast("double")).alias("no_hit_rate"))


def target_coverage(pairs: DataFrame, events: DataFrame, catalog: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: relevant items that remain, over all liked items of members, counted per membership; and two-sided pairs."""
    liked = pair_members(pairs).join(events.select("userId", "movieId").distinct(), "userId").agg(F.count(F.lit(1)).alias("liked"))
    kept = relevant.agg(F.count(F.lit(1)).alias("remaining"))
    sides = relevant.groupBy("pairId").agg(F.count_distinct("userId").alias("s")).agg(F.count_if(F.col("s") == 2).alias("two_sided_pairs"))
    return liked.join(kept).join(sides).withColumn("coverage", F.coalesce(F.try_divide("remaining", "liked"), F.lit(0.0)))


def selection_key(summary: dict, k: int = 10) -> tuple[float, float]:
    """(mean minimum NDCG, mean average NDCG), by which runs are compared; ValueError if not finite."""
    key = (float(summary["mean_minimumNDCG"]), float(summary["mean_averageNDCG"]))
    if not all(map(np.isfinite, key)):
        raise ValueError("the selection metrics are not finite")
    return key


def trailing_mean(history: DataFrame, window: int) -> DataFrame:
    """history (step, primary, secondary) with the means of the last `window` checks; a history has one row per check."""
    w = Window.orderBy("step").rowsBetween(-(window - 1), 0)
    return history.withColumns({f"{c}_smoothed": F.avg(c).over(w) for c in ("primary", "secondary")})


def stage_rows(spark: SparkSession, stage: str, facts: dict, methods: list[dict]) -> DataFrame:
    """One row per method of a stage: the stage's facts, with nested names joined by underscores, then the method's."""

    def flat(x: dict, before: str = "") -> dict:
        out = {}
        for name, v in x.items():
            out |= flat(v, f"{before}{name}_") if isinstance(v, dict) else {before + name: v}
        return out

    return spark.createDataFrame(pd.DataFrame([{"stage": stage} | flat(facts) | flat(m) for m in methods]))
