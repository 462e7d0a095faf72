import math

import pytest

from duolist.operators import evaluation


def recs(spark, rows):
    return spark.createDataFrame(rows, "method string, pairId int, userA int, userB int, rank int, movieId int")


def test_shared_metrics(spark):
    lists = recs(spark, [("m", 0, 1, 2, i + 1, m) for i, m in enumerate((10, 20, 30))])
    relevant = spark.createDataFrame([(0, 1, 10), (0, 1, 30), (0, 2, 20)], "pairId int, userId int, movieId int")
    r = evaluation.pair_metrics(lists, relevant, 3).first()
    assert r["ndcgA@3"] == pytest.approx(0.919721, abs=1e-6) and r["ndcgB@3"] == pytest.approx(0.630930, abs=1e-6)
    assert r["averageNDCG@3"] == pytest.approx(0.775325, abs=1e-6) and r["minimumNDCG@3"] == pytest.approx(0.630930, abs=1e-6)
    s = evaluation.method_summary(lists, relevant, 5, 3).first()
    assert (s.evaluated_pairs, s.skipped_pairs, s.catalog_coverage, s.two_sided_hit_rate, s.one_sided_hit_rate, s.no_hit_rate) == (1, 0, 0.6, 1, 0, 0)
    with pytest.raises(ValueError):
        evaluation.pair_metrics(lists, relevant, 0)


def test_skipped_and_unlisted_pairs(spark):
    lists = recs(spark, [("m", 0, 1, 2, 1, 10), ("m", 1, 3, 4, 1, 10)])
    relevant = spark.createDataFrame([(0, 1, 10), (1, 3, 10), (1, 4, 11), (2, 5, 1), (2, 6, 1)], "pairId int, userId int, movieId int")
    s = evaluation.method_summary(lists, relevant, 5, 3).first()
    assert (s.evaluated_pairs, s.skipped_pairs, s.one_sided_hit_rate) == (1, 1, 1)
    none = evaluation.method_summary(lists, relevant.limit(0), 5, 3)
    with pytest.raises(ValueError):
        evaluation.require_evaluated(none)


def test_relevance_leaves_out_the_pairs_history(spark):
    pair = spark.createDataFrame([(4, 1, 2)], "pairId int, userA int, userB int")
    likes = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (1, 99), (1, 20)], "userId int, movieId int")
    catalog = spark.createDataFrame([(10,), (20,)], "movieId int")
    seen = spark.createDataFrame([(2, 10)], "userId int, movieId int")
    assert sorted(map(tuple, evaluation.pair_relevant_items(pair, likes, catalog, seen).collect())) == [(4, 1, 20), (4, 2, 20)]
    assert sorted(map(tuple, evaluation.relevant_items(likes, catalog).collect())) == [(1, 10), (1, 20), (2, 20)]


def test_overlap(spark):
    rows = [("a", 0, 1, 2, i + 1, m) for i, m in enumerate((10, 20, 30))] + [("b", 0, 1, 2, i + 1, m) for i, m in enumerate((20, 10, 40))]
    got = {r.method: r for r in evaluation.compare_rankings(recs(spark, rows), "a", 3).collect()}
    assert (got["b"].identicalTopKPairRate, got["b"].meanPositionAgreementAtK) == (0, 0) and got["b"].meanItemOverlapAtK == pytest.approx(2 / 3)
    assert (got["a"].identicalTopKPairRate, got["a"].meanItemOverlapAtK) == (1, 1)


def test_bootstrap(spark):
    metrics = spark.createDataFrame([("a", 1, 0.4), ("a", 2, 0.6), ("a", 3, 1.0), ("b", 1, 0.1), ("b", 2, 0.2)], "method string, pairId int, m double")
    one, two = (evaluation.paired_bootstrap(metrics, "a", "b", "m", 200, 5).first() for _ in range(2))
    assert one == two and one.commonPairs == 2 and one.meanDifferenceAminusB == pytest.approx(0.35) and one.bootstrapProbabilityAboveZero == 1
    assert 0.3 - 1e-9 <= one.ci95Lower <= one.ci95Upper <= 0.4 + 1e-9
    with pytest.raises(ValueError):
        evaluation.paired_bootstrap(metrics.unionAll(metrics), "a", "b", "m")
    with pytest.raises(ValueError):
        evaluation.paired_bootstrap(metrics, "a", "c", "m")


def test_bands_and_keys(spark):
    columns = "method string, pairId int, `averageNDCG@10` double, `minimumNDCG@10` double, `ndcgGap@10` double, `averageRecall@10` double, `minimumRecall@10` double, `recallA@10` double, `recallB@10` double"
    metrics = spark.createDataFrame([(m, p, 0.5, 0.4, 0.1, 0.2, 0.1, 0.3, 0.0) for m in ("average", "nash") for p in range(3)], columns)
    bands = spark.createDataFrame([(0, "low"), (1, "medium"), (2, "high")], "pairId int, conflictBand string")
    assert evaluation.conflict_summary(metrics, bands).count() == 6
    assert evaluation.subgroup_summary(metrics, bands, "conflictBand").count() == 6
    with pytest.raises(ValueError):
        evaluation.subgroup_summary(metrics, bands.limit(2), "conflictBand")
    key = lambda a, b: evaluation.selection_key({"mean_minimumNDCG": a, "mean_averageNDCG": b})
    assert key(0.02, 0.03) > key(0.01, 0.20)
    with pytest.raises(ValueError):
        key(math.nan, 1)


def test_trailing_mean(spark):
    h = spark.createDataFrame([(0, 0.0, 0.0), (5, 0.5, 1.0), (10, 0.4, 0.0)], "step int, primary double, secondary double")
    assert [r.primary_smoothed for r in evaluation.trailing_mean(h, 2).orderBy("step").collect()] == pytest.approx([0, 0.25, 0.45])


def test_stage_rows(spark):
    facts = {"subset": {"pairs": 10}, "training": {"steps": 5}}
    got = evaluation.stage_rows(spark, "smoke", facts, [{"method": "a", "ndcg": 0.1}, {"method": "b", "ndcg": 0.2}]).orderBy("method").collect()
    assert [(r.stage, r.subset_pairs, r.training_steps, r.method, r.ndcg) for r in got] == [("smoke", 10, 5, "a", 0.1), ("smoke", 10, 5, "b", 0.2)]
