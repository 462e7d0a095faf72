import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolist.operators import evaluation, statistics
from duolist.sources import sinks


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 7, [-1e300, 1e300, 0.0, 1e-300, -2.5, 7.0], [0.1 * i * (-1) ** i for i in range(500)], [float(i // 3) for i in range(100)] + [None, float("nan")], [1e-12 * i for i in range(40)] + [1e12]])
def test_quantiles_are_the_interpolated_ones(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    p = [0.0, 0.025, 1 / 3, 0.5, 2 / 3, 0.75, 0.975, 1.0]
    kept = df.where("x is not null and not isnan(x)")
    want = kept.agg(*(F.percentile("x", q) for q in p)).first()
    assert statistics.quantiles(df, "x", p) == pytest.approx(list(want), rel=1e-12)


def test_no_values_have_no_quantiles(spark):
    assert statistics.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.1, 0.5]) == [None, None]


def test_quantiles_of_ten_million_rows(spark):
    df = spark.range(10_000_000).selectExpr("cast(pmod(xxhash64(id), 1000003) as double) * 0.001 as x")
    assert statistics.quantiles(df, "x", [1 / 3, 2 / 3]) == pytest.approx(list(df.agg(F.percentile("x", 1 / 3), F.percentile("x", 2 / 3)).first()), rel=1e-12)


@pytest.mark.parametrize("bucket", [8192, 40])
def test_resampled_means_follow_the_drawn_law(spark, bucket):
    rng = np.random.default_rng(2)
    d = np.round(rng.normal(0.02, 0.3, 195), 2)
    df = spark.createDataFrame([(float(x),) for x in d], "difference double")
    got = np.array([r.m for r in statistics.resampled_means(df, 10_000, 3, bucket).collect()])
    drawn = d[rng.integers(0, len(d), (10_000, len(d)))].mean(axis=1)
    assert len(got) == 10_000 and abs(got.mean() - d.mean()) < 4 * d.std() / math.sqrt(195 * 10_000)
    assert got.var() == pytest.approx(d.var() / 195, rel=0.06)
    every = np.sort(np.concatenate([got, drawn]))
    apart = np.abs(np.searchsorted(np.sort(got), every, side="right") - np.searchsorted(np.sort(drawn), every, side="right")).max() / 10_000
    assert apart < 1.63 * math.sqrt(2 / 10_000)  # both samples are of one law, to one in a hundred
    again = np.array([r.m for r in statistics.resampled_means(df.repartition(7), 10_000, 3, bucket).collect()])
    assert sorted(again) == pytest.approx(sorted(got))


def test_resamples_hold_as_many_as_there_are(spark):
    """With all differences 1 every mean is 1: the counts over all buckets add up."""
    df = spark.createDataFrame([(1.0 + i * 1e-12,) for i in range(300)], "difference double")
    assert all(abs(r.m - 1) < 1e-9 for r in statistics.resampled_means(df, 200, 1, 10).collect())


def test_paired_bootstrap(spark):
    rows = [("a", 1, 0.4), ("a", 2, 0.6), ("a", 3, 1.0), ("b", 1, 0.1), ("b", 2, 0.2)]
    r = evaluation.paired_bootstrap(spark.createDataFrame(rows, "method string, pairId int, x double"), "a", "b", "x", 500).first()
    assert r.commonPairs == 2 and r.meanDifferenceAminusB == pytest.approx(0.35) and r.bootstrapProbabilityAboveZero == 1
    assert r.ci95Lower == pytest.approx(0.3) and r.ci95Upper == pytest.approx(0.4)


def test_one_of_two_runs_at_once_gets_the_claim(spark, tmp_path):
    won, lost, gate = [], [], threading.Barrier(8)

    def run(i):
        gate.wait()
        try:
            sinks.claim(spark, f"file://{tmp_path}/run/claim", str(i))
            won.append(i)
        except FileExistsError:
            lost.append(i)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and (tmp_path / "run" / "claim").read_text() == str(won[0])


def test_one_changed_row_of_a_million_is_found(spark):
    before = spark.range(1_000_000).selectExpr("id", "id % 97 as x")
    after = before.withColumn("x", F.when(F.col("id") == 123_456, -1).otherwise(F.col("x"))).repartition(5)
    trees = [sinks.digest_tree(df, 1024, ["id"]) for df in (before, after, before.repartition(3))]
    roots = [sinks.tree_root(t) for t in trees]
    assert roots[0] == roots[2] != roots[1]
    assert len(sinks.changed_buckets(trees[0], trees[1])) == 1 and sinks.changed_buckets(trees[0], trees[2]) == []
    assert sorted(map(tuple, sinks.changed_rows(before, after, 1024, ["id"]).collect())) == [("after", 123_456, -1), ("before", 123_456, 123_456 % 97)]
