import heapq

import numpy as np

from duolist.operators import cohorts, ranks


def test_blocks_are_large_but_leave_no_core_without_work(spark):
    assert cohorts.blocks_that_meet(spark.range(268_000), spark.range(1_180_000), 16_384, 65_536) == (17, 19)
    assert cohorts.blocks_that_meet(spark.range(5000), spark.range(50_000), 16_384, 65_536) == (16, 1)  # four cores
    assert cohorts.blocks_that_meet(spark.range(0), spark.range(9), 16_384, 65_536) == (1, 1)


def test_few_and_many_that_go_are_left_out_alike(spark):
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pairId long")
    movies = spark.range(100).withColumnRenamed("id", "movieId")
    gone = {1: {5, 7, 1000}, 2: set(range(0, 100, 2)), 3: set()}
    rows = spark.createDataFrame([(p, m) for p, ms in gone.items() for m in ms], "pairId long, movieId long")
    want = sorted((p, m) for p, ms in gone.items() for m in range(100) if m not in ms)
    found = cohorts.all_but(pairs, movies, rows)
    assert sorted((r.pairId, r.movieId) for r in found.collect()) == want


def test_equal_rows_have_equal_products_in_every_chunk():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3, 17)), rng.normal(size=(50, 17))
    y[[0, 13, 31, 49]] = y[0]
    got = ranks._products(x, ranks._columns(y), chunk=8)
    want = sum(x[:, i, None] * y[None, :, i] for i in range(17))
    assert (got == want).all() and (got[:, [13, 31, 49]] == got[:, [0]]).all()


def test_the_best_of_many_unrelated_scores_are_those_of_a_plain_search():
    rng = np.random.default_rng(4)
    for total, least in (rng.normal(size=(2, 20_000)), rng.integers(0, 40, (2, 20_000)), np.ones((2, 500))):
        held, want = [], []
        for i in np.lexsort((np.arange(len(total)), -least, -total)):
            if len(held) < 10 or held[0] < least[i]:
                (heapq.heappush if len(held) < 10 else heapq.heapreplace)(held, least[i])
                want.append(i)
        assert ranks.best_at_some_weight(total, least, 10).tolist() == want
