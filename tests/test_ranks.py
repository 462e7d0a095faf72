import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duolist.operators import cohorts, ranking, ranks
from duolist.schema import shared_folder

SCORES = st.lists(st.integers(-4, 4), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(SCORES, st.data())
def test_ranks_are_corrected_for_what_is_removed(scores, data):
    x = np.array(scores, float)
    gone = np.array(sorted(data.draw(st.sets(st.integers(0, len(x) - 1)))), np.int64)
    twice = ranks.twice_ranks(x)
    assert (twice / 2 == pd.Series(x).rank().to_numpy()).all()
    assert (ranks.without(twice, gone) / 2 == pd.Series(np.delete(x, gone)).rank().to_numpy()).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 12)), min_size=1, max_size=60), st.integers(1, 8))
def test_the_best_at_every_weight_are_kept(rows, k):
    a, b = np.array(rows).T
    best = ranks.best_at_some_weight(a + b, np.minimum(a, b), k)
    assert len(set(best.tolist())) == len(best)
    n = np.arange(len(a))
    for w in [*np.linspace(0, 1, 21), None]:
        group = np.sqrt(a * b) if w is None else (1 - w) * (a + b) / 2 + w * np.minimum(a, b)
        order = np.lexsort((n, -(a + b), -np.minimum(a, b), -np.round(group, 9)))[:k]
        assert set(order.tolist()) <= set(best.tolist())


def test_few_are_kept_of_many():
    rng = np.random.default_rng(1)
    a, b = rng.permutation(20_000) + 1, rng.permutation(20_000) + 1
    assert len(ranks.best_at_some_weight(a + b, np.minimum(a, b), 10)) < 300


def tables(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(6)] + [(6, 0, 3)], "pairId int, userA int, userB int")
    scores = spark.createDataFrame([(u, int(m), float(rng.integers(0, 5))) for u in range(11) for m in rng.choice(50, 20, replace=False)], "userId int, movieId int, score double")
    catalog = spark.createDataFrame([(m,) for m in range(5, 50)], "movieId int")
    seen = spark.createDataFrame([(u, int(m)) for u in range(12) for m in rng.choice(60, 5 * (u % 3), replace=False)], "userId int, movieId int")
    return pairs, scores, catalog, seen


def test_lists_of_all_weights_equal_single_runs_by_windows(spark):
    pairs, scores, catalog, seen = tables(spark)
    weights = [i / 20 for i in range(21)] + [None]
    got = ranking.lists_from_scores(pairs, scores, catalog, seen, weights, 4).collect()
    candidates = cohorts.pair_candidates(pairs, catalog, seen).join(pairs, "pairId")
    a, b = (scores.select(F.col("userId").alias(f"user{m}"), "movieId", F.col("score").alias(f"s{m}")) for m in "AB")
    both = candidates.join(a, ["userA", "movieId"], "left").join(b, ["userB", "movieId"], "left")
    normal = ranking.normalize_scores(both.select("pairId", "movieId", F.coalesce("sA", F.lit(0.0)).alias("scoreA"), F.coalesce("sB", F.lit(0.0)).alias("scoreB"))).toPandas()
    normal = spark.createDataFrame(normal)
    for w in (0.0, 0.05, 0.65, 1.0, None):
        want = {(r.pairId, r.rank): (r.movieId, round(r.groupScore, 12)) for r in ranking.top_k(ranking.group_scores(normal, w), 4).collect()}
        assert {(r.pairId, r.rank): (r.movieId, round(r.groupScore, 12)) for r in got if r.conflictWeight == w} == want
    one = ranking.recommend_from_scores(pairs, scores, catalog, seen, 0.65, 4)
    assert "conflictWeight" not in one.columns and one.count() == sum(r.conflictWeight == 0.65 for r in got)
    with pytest.raises(ValueError):
        ranking.recommend_from_scores(pairs, scores, catalog, seen, 1.1)


def test_members_without_a_vector_are_named(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "userId int, vec array<double>")
    items = spark.createDataFrame([(10, [1.0, 0.0])], "movieId int, vec array<double>")
    pair = spark.createDataFrame([(0, 1, 2), (1, 1, 9)], "pairId int, userA int, userB int")
    none = spark.createDataFrame([], "userId int, movieId int")
    with pytest.raises(KeyError, match=r"\[2, 9\]"):
        ranking.recommend_from_vectors(pair, users, items, none)


def test_products_in_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(9, 4)), rng.normal(size=(25, 4))
    y[7] = y[20]
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "userId int, vec array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "at long, vec array<float>").withColumn("vec", F.col("vec").cast("array<double>"))
    rows = ranks.block_products(users, items, 4, 10).collect()
    assert len(rows) == 27
    whole = {u: np.concatenate([np.frombuffer(r.scores) for r in sorted(rows, key=lambda r: r.block) if r.userId == u]) for u in range(9)}
    want = x @ y.astype(np.float32).astype(float).T
    assert all(np.allclose(whole[u], want[u]) and whole[u][7] == whole[u][20] for u in range(9))


def test_everyone_meets_everything_in_blocks(spark):
    a, b = spark.range(23).selectExpr("id as pairId"), spark.range(31).selectExpr("id as movieId")
    met = cohorts.against_all(a, b, "movieId", 5, 7)
    assert met.count() == met.distinct().count() == 23 * 31 and met.rdd.getNumPartitions() == 25


def test_ranks_of_scored_movies_need_no_catalogue(spark):
    """A million movies of which a pair has scores of three: dense ranks would take a million numbers a user."""
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "pairId int, userA int, userB int")
    scores = spark.createDataFrame([(1, 5, 2.0), (1, 0, -1.0), (2, 7, 1.0)], "userId int, movieId int, score double")
    seen = spark.createDataFrame([(1, 1), (2, 3), (3, 0)], "userId int, movieId int")
    catalog = spark.range(1_000_000).selectExpr("cast(id as int) as movieId")
    rows = ranks.scored_rows(pairs, scores, ranks.numbered(catalog), seen, "at").collect()
    assert len(rows) == 3 + 3 + 2
    got = {(r.pairId, r.rank): (r.movieId, round(r.qA, 9)) for r in ranking.recommend_from_scores(pairs, scores, catalog, seen, 1.0, 4).collect()}
    # of movie 7 A has no score, which ranks above the one disliked movie: a little higher than B's rank of movie 5
    assert [got[0, i][0] for i in (1, 2, 3, 4)] == [7, 5, 2, 4] and got[0, 2][1] == 1.0
    assert [got[1, i][0] for i in (1, 2, 3, 4)] == [1, 2, 3, 4]


@settings(max_examples=200, deadline=None)
@given(SCORES, st.integers(0, 20))
def test_ranks_beside_zeros_that_are_not_listed(scores, rest):
    x = np.array(scores, float)
    twice, zero = ranks.twice_ranks_among(x, rest)
    every = ranks.twice_ranks(np.concatenate([x, np.zeros(rest + 1)]))
    assert (ranks.twice_ranks(np.concatenate([x, np.zeros(rest)]))[: len(x)] == twice).all()
    assert rest == 0 or zero == ranks.twice_ranks(np.concatenate([x, np.zeros(rest)]))[-1]
    assert len(every) == len(x) + rest + 1


def test_percentiles_of_all_candidates(spark):
    pairs, scores, catalog, seen = tables(spark)
    got = {(r.pairId, r.movieId): (r.qA, r.qB) for r in ranks.pair_percentiles(pairs, scores, catalog, seen).collect()}
    a, b = (scores.select(F.col("userId").alias(f"user{m}"), "movieId", F.col("score").alias(f"s{m}")) for m in "AB")
    both = cohorts.pair_candidates(pairs, catalog, seen).join(pairs, "pairId").join(a, ["userA", "movieId"], "left").join(b, ["userB", "movieId"], "left").fillna(0.0, ["sA", "sB"])
    want = {(r.pairId, r.movieId): (r.qA, r.qB) for r in ranking.normalize_scores(both.withColumnsRenamed({"sA": "scoreA", "sB": "scoreB"})).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_lists_of_vectors_by_blocks_equal_dense_ranks(spark):
    """Two rounds over blocks give what ranks over the whole catalogue give, ties, removed movies and a pair without any included."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(-2, 3, (12, 3)).astype(float), rng.integers(-2, 3, (57, 3)).astype(float)
    users = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(x)], "userId int, vec array<double>")
    items = spark.createDataFrame([(3 * m, v.tolist()) for m, v in enumerate(y)], "movieId int, vec array<float>")
    members = [(0, 0, 1), (1, 2, 3), (2, 0, 5), (3, 6, 7), (4, 8, 9), (5, 10, 11)]
    pairs = spark.createDataFrame(members, "pairId int, userA int, userB int")
    has_seen = {u: {int(m) for m in rng.choice(57, 9, replace=False)} for u in range(10)} | {10: set(range(57)), 11: set()}
    seen = spark.createDataFrame([(u, 3 * m) for u, own in has_seen.items() for m in own] + [(0, 1)], "userId int, movieId int")
    weights = [0.0, 0.65, 1.0, None]
    want = {}
    for p, a, b in members:
        own = np.array([m for m in range(57) if m not in has_seen[a] | has_seen[b]], int)
        qa, qb = (pd.Series(y[own] @ x[u]).rank().to_numpy() / max(1, len(own)) for u in (a, b))
        for w in weights:
            average, least = (qa + qb) / 2, np.minimum(qa, qb)
            group = np.sqrt(qa * qb) if w is None else (1 - w) * average + w * least
            top = np.lexsort((own, -np.round(average, 12), -np.round(least, 12), -np.round(group, 12)))[:4]
            want |= {(p, w, r + 1): (3 * int(own[i]), round(group[i], 9), round(qa[i], 9)) for r, i in enumerate(top)}
    for block in (100, 10):
        got = ranks.lists_of_vectors(pairs, users, items, seen, weights, 4, 2, block).collect()
        assert {(r.pairId, r.conflictWeight, r.rank): (r.movieId, round(r.groupScore, 9), round(r.qA, 9)) for r in got} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-np.inf, -2.0, -0.0, 0.0, 1.5, np.inf, np.nan]), max_size=20), st.data())
def test_counts_around_some_scores(scores, data):
    every = ranks.ordered(np.array(scores, float))
    some = every[data.draw(st.lists(st.integers(0, len(scores) - 1), max_size=6))] if scores else every
    less, equal = ranks.counts_around(some, every)
    assert less.tolist() == [int((every < s).sum()) for s in some] and equal.tolist() == [int((every == s).sum()) for s in some]
    assert len(set(every.tolist())) == len({str(s + 0.0) for s in scores})


def test_lists_of_vectors_shuffle_no_ranks_of_whole_catalogues(spark):
    """What is written for 200 pairs and 8,000 movies is far below a rank for each user and movie (12.8 MB)."""
    rng = np.random.default_rng(9)
    users = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(rng.normal(size=(400, 4)))], "userId int, vec array<double>")
    items = spark.createDataFrame([(m, v.tolist()) for m, v in enumerate(rng.normal(size=(8000, 4)))], "movieId int, vec array<double>")
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(200)], "pairId int, userA int, userB int")
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert ranking.recommend_from_vectors(pairs, users, items, spark.createDataFrame([], "userId int, movieId int")).count() == 2000
    assert sum(os.path.getsize(f"{folder}/{t}/{f}") for t in set(os.listdir(folder)) - before for f in os.listdir(f"{folder}/{t}")) < 3_000_000


def test_every_product_comes_once_from_packed_blocks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(23, 3)), rng.normal(size=(31, 3)).astype(np.float32).astype(float)
    users = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(x)], "userId int, vec array<double>")
    items = spark.createDataFrame([(7 * m, v.tolist()) for m, v in enumerate(y)], "movieId int, vec array<float>")
    for blocks in ((100, 100), (5, 7)):
        rows = ranks.every_product(users, items, *blocks).collect()
        assert len(rows) == 23 * 31 and {(r.userId, r.movieId): r.score for r in rows} == {(u, 7 * m): float((x[u, 0] * y[m, 0] + x[u, 1] * y[m, 1]) + x[u, 2] * y[m, 2]) for u in range(23) for m in range(31)}
