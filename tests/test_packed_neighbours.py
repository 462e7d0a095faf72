import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duolist.operators import models, ranks


@pytest.fixture(scope="module")
def likes(spark):
    rng = np.random.default_rng(5)
    rows = {(int(u), 3 * int(m)) for u, m in zip(rng.integers(0, 40, 500), rng.zipf(1.4, 500) % 90, strict=True)} | {(99, 3 * m) for m in range(60)}
    return spark.createDataFrame(sorted(rows), "userId long, movieId long").localCheckpoint()


def test_lists_hold_the_same_neighbours_and_similarities(likes):
    for width, block in ((5, 1024), (1000, 8)):  # cut short, and with users whose likes are cut into blocks
        want = models.item_neighbours(likes, width, 10.0, block).toPandas()
        got = models.neighbour_lists(likes.withColumnRenamed("movieId", "at"), width, 10.0, block).collect()
        assert {r["at"] for r in got} == set(want["src"])
        for r in got:
            at, sim = models.similarities([tuple(r)[1:]], 10.0)
            own = want[want["src"] == r["at"]].sort_values("cand")
            assert at.tolist() == own["cand"].tolist() and sim.tolist() == own["similarity"].tolist()


def test_scores_from_lists_are_those_from_rows_and_no_score_is_shuffled(likes):
    at = likes.withColumnRenamed("movieId", "at")
    want = models.neighbour_scores(likes, models.item_neighbours(likes, 20, 10.0), 20).toPandas().sort_values(["userId", "movieId"])
    found = models.scores_of_lists(at, models.neighbour_lists(at, 20, 10.0), 10.0, users_at_once=8)
    got = found.toPandas().sort_values(["userId", "at"])
    assert got["at"].tolist() == want["movieId"].tolist() and np.allclose(got["score"], want["score"], rtol=0, atol=1e-12)
    assert "similarity" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_lists_and_percentiles_from_neighbours(spark, likes):
    pairs = spark.createDataFrame([(1, 0, 1), (2, 2, 99), (3, 500, 3), (4, 501, 502)], "pairId long, userA long, userB long")  # some without likes
    catalog = spark.createDataFrame([(3 * m,) for m in range(95)], "movieId long")
    seen = likes.where("movieId % 2 = 0").unionAll(spark.createDataFrame([(501, 3), (7, 10_001)], "userId long, movieId long"))
    index = ranks.numbered(catalog).select("movieId", F.col("at").cast("long").alias("at"))
    scores = models.neighbour_scores(likes, models.item_neighbours(likes, 20, 10.0), 20).withColumn("score", F.round("score", 9))
    at = likes.join(index, "movieId").select("userId", "at")
    weights = [0.0, 0.65, 1.0, None]
    by = ["pairId", "conflictWeight", "rank"]
    want, got = (
        f.toPandas().sort_values(by, ignore_index=True)
        for f in (ranks.lists_of_scored(pairs, scores, index, seen, weights, 7), ranks.lists_of_neighbours(pairs, at, models.neighbour_lists(at, 20, 10.0), 10.0, index, seen, weights, 7))
    )
    assert len(want) == 4 * 4 * 7
    pd.testing.assert_frame_equal(got[want.columns], want)
    own = catalog.select("movieId", F.col("movieId").alias("at"))
    lists = models.neighbour_lists(likes.withColumnRenamed("movieId", "at"), 20, 10.0)
    want, got = (
        f.toPandas().sort_values(["pairId", "movieId"], ignore_index=True)
        for f in (ranks.pair_percentiles(pairs, scores, catalog, seen), ranks.percentiles_of_neighbours(pairs, likes.withColumnRenamed("movieId", "at"), lists, 10.0, own, seen))
    )
    pd.testing.assert_frame_equal(got, want)
