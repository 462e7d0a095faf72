import pytest
from pyspark.sql import functions as F

from duolist.functions import percentile_rank
from duolist.operators import pairs
from duolist.plans import registry


def test_ranks_equal_the_window_and_need_none_over_all_rows(spark):
    data = [(i, None if i % 11 == 0 else (i * 37 % 19) / 19 - 0.5, None if i % 13 == 0 else float(i * 7 % 31)) for i in range(200)]
    features = spark.createDataFrame(data, "pairId long, genreSimilarity double, ratingCorrelation double")
    one = features.withColumn("one", F.lit(1))
    want = {r.pairId: r.s for r in one.select("pairId", ((percentile_rank(-F.col("genreSimilarity"), "one") + percentile_rank(-F.col("ratingCorrelation"), "one")) / 2).alias("s")).collect()}
    ranked = pairs.conflict_scores(features)
    got = {r.pairId: r.conflictScore for r in ranked.collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    with pytest.raises(ValueError):
        pairs.conflict_bands(features)
    whole = features.where("genreSimilarity is not null and ratingCorrelation is not null")
    assert {r.conflictBand for r in pairs.conflict_bands(whole).collect()} == {"low", "medium", "high"}
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_ties_across_both_tertiles_are_bands_too(spark):
    """Nine pairs of ten tie: SQL gives bands where tertiles coincide, and no rows where there are no pairs."""
    features = spark.createDataFrame([(i, 0.1 + (i == 9), 0.3 + (i == 9)) for i in range(10)], "pairId long, genreSimilarity double, ratingCorrelation double")
    bands = {r.pairId: r.conflictBand for r in pairs.conflict_bands(features, distinct=False).collect()}
    assert set(bands.values()) == {"low"}
    turned = features.selectExpr("pairId", "-genreSimilarity as genreSimilarity", "-ratingCorrelation as ratingCorrelation")
    assert {r.pairId: r.conflictBand for r in pairs.conflict_bands(turned, distinct=False).collect()} == {i: "high" if i == 9 else "low" for i in range(10)}
    assert pairs.conflict_bands(features.limit(0), distinct=False).isEmpty()
    with pytest.raises(ValueError):
        pairs.conflict_bands(features)


def test_queries_give_no_rows_where_no_pair_has_a_correlation(spark, monkeypatch):
    features = spark.createDataFrame([(i, 2 * i, 2 * i + 1, 0, 0.5, None) for i in range(4)], "pairId long, userA long, userB long, coRatedTrain long, genreSimilarity double, ratingCorrelation double")
    monkeypatch.setattr(registry, "_features", lambda d: features)
    for name in ("conflict_bands", "dissimilar_pairs"):
        assert registry.queries()[name](spark, "unused").isEmpty()
