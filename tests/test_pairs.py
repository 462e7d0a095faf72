import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from duolist.config import PrepConfig
from duolist.operators import pairs, samples
from duolist.schema import dense_index


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pairId long, userA long, userB long")


def one_by_one(rows, cap):
    used, out = {}, []
    for i, (a, b) in enumerate(rows):
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            out.append(i)
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(6, 11)), min_size=1, max_size=20), st.integers(1, 3))
def test_rounds_choose_as_one_by_one(spark, rows, cap):
    got = sorted(r.pairId for r in pairs.greedy_pairs(frame(spark, rows), "pairId", cap).collect())
    assert got == one_by_one(rows, cap)


def test_disjoint_pairs(spark):
    got = pairs.disjoint_pairs(frame(spark, [(1, 2), (1, 3), (3, 4), (5, 6), (7, 8)]), 3).orderBy("pairId").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2), (1, 3, 4), (2, 5, 6)]
    with pytest.raises(ValueError):
        pairs.disjoint_pairs(frame(spark, [(1, 2), (2, 3)]), 2)


def test_random_pairs_repeat_and_share_no_member(spark):
    users = spark.createDataFrame([(i,) for i in range(20)], "userId long")
    a, b = (sorted(map(tuple, pairs.random_disjoint_pairs(users, 5, 7).collect())) for _ in range(2))
    assert a == b and len({u for r in a for u in r[1:]}) == 10 and all(r[1] < r[2] for r in a)
    with pytest.raises(ValueError):
        pairs.random_disjoint_pairs(users, 11, 7)


def test_dissimilar_pairs(spark):
    rows = [(1, 2, 30, -0.8, -0.7), (1, 3, 30, -0.7, -0.6), (1, 4, 30, -0.6, -0.5), (2, 3, 30, 0.1, 0.1), (3, 4, 30, 0.2, 0.2), (4, 5, 30, 0.3, 0.3)]
    features = spark.createDataFrame(rows, "userA long, userB long, coRatedTrain long, genreSimilarity double, ratingCorrelation double")
    chosen, summary = pairs.dissimilar_pairs(features, PrepConfig(pair_similarity_quantile=0.5, max_pairs_per_user=1))
    assert summary["candidate_pairs"] == 3 and chosen.count() == 1
    with pytest.raises(ValueError):
        pairs.dissimilar_pairs(features, PrepConfig(pair_min_co_rated=31))


def test_bands(spark):
    development = spark.createDataFrame([(-0.5,), (0.0,), (0.2,), (0.4,), (0.8,)], "genreSimilarity double")
    rule = pairs.band_rule(development)
    got = pairs.similarity_bands(spark.createDataFrame([(1, -1.0), (2, 0.1), (3, 1.0), (4, None)], "i int, genreSimilarity double"), rule).orderBy("i").collect()
    assert [r.similarityBand for r in got] == ["high_conflict", "mixed", "similar", "similar"]
    features = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.0, 0.0), (3, -0.2, -0.2)], "pairId int, genreSimilarity double, ratingCorrelation double")
    assert [r.conflictBand for r in pairs.conflict_bands(features).orderBy("pairId").collect()] == ["low", "medium", "high"]


def test_features_without_variance(spark):
    train = spark.createDataFrame([(u, m, 4.0) for u in (1, 2) for m in range(3)], "userId long, movieId long, rating double")
    movies = spark.createDataFrame([(m, None) for m in range(3)], "movieId long, genres string")
    got = pairs.pair_features(frame(spark, [(1, 2)]), train, movies, PrepConfig(pair_min_co_rated=2)).first()
    assert got.coRatedTrain == 3 and got.ratingCorrelation is None and got.genreSimilarity == 0


def test_joint_counts(spark):
    likes = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 30), (2, 10)], "userId long, movieId long")
    assert {r.pairId: r.jointTestPositiveCount for r in pairs.joint_counts(frame(spark, [(1, 2), (1, 3)]), likes).collect()} == {0: 1, 1: 0}


def test_graph_subset(spark):
    edges = spark.createDataFrame([(1, 10), (1, 20), (2, 20), (2, 30), (3, 10), (3, 40), (4, 30), (4, 50), (5, 40), (5, 50)], "userId long, movieId long")
    two = frame(spark, [(1, 2), (2, 3)])
    made, manifest = samples.controlled_subset(edges, two, 1, 3, 1)
    users, kept = made["users"], made["edges"]
    got = {r.userId: r.focus for r in users.collect()}
    assert len(got) == 3 and got[1] and got[2] and kept.select("userId").distinct().count() == 3
    with pytest.raises(ValueError):
        samples.controlled_subset(edges, two, 2, 2, 1)
    again = samples.replay_subset(edges.repartition(3), two, manifest, made["catalog"])
    assert {(r.userId, r.focus) for r in again["users"].collect()} == set(got.items())
    assert sorted(map(tuple, again["catalog"].collect())) == sorted(map(tuple, made["catalog"].collect()))
    with pytest.raises(ValueError, match="has changed"):
        samples.replay_subset(edges.where("userId <> " + str(next(u for u, f in got.items() if not f))), two, manifest)
    with pytest.raises(ValueError, match="other edges"):
        samples.replay_subset(edges.unionAll(spark.createDataFrame([(1, 77)], edges.schema)), two, manifest)
    with pytest.raises(ValueError, match="model and subset"):
        samples.replay_subset(edges, two, manifest, spark.range(3).withColumnRenamed("id", "movieId"))


def test_sampled_pairs(spark):
    users = spark.createDataFrame([(i,) for i in range(30)], "userId long")
    got = [tuple(r) for r in pairs.sample_pairs(users, PrepConfig(pair_candidate_sample_size=200)).collect()]
    assert len(set(got)) == len(got) > 100 and all(a < b for a, b in got)


def test_dense_index(spark):
    rows = dense_index(spark.range(500).selectExpr("id * 7 % 500 as x").repartition(5), ["x"], "i").collect()
    assert all(r.x == r.i for r in rows) and len(rows) == 500


def test_samples_merge_grow_and_replay(spark):
    ids = spark.range(5000).withColumnRenamed("id", "userId")
    ten, manifest = samples.draw(ids, "userId", 10, 3)
    plain = sorted((int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16), i) for i in range(5000))
    assert {(r.h, r.userId) for r in ten.collect()} == set(plain[:10]) and manifest["threshold"] == plain[9][0]
    larger, _ = samples.draw(ids, "userId", 200, 3)
    assert {(r.h, r.userId) for r in larger.collect()} == set(plain[:200])
    parts = [samples.draw(ids.where(f"userId % 3 = {k}"), "userId", 200, 3)[0] for k in range(3)]
    assert {r.userId for r in samples.merged(parts, "userId", 200, 3)[0].collect()} == {i for _, i in plain[:200]}
    assert {r.userId for r in samples.replay(ids.repartition(7), "userId", manifest).collect()} == {i for _, i in plain[:10]}
    with pytest.raises(ValueError, match="changed"):
        samples.replay(ids.where(f"userId <> {plain[4][1]}"), "userId", manifest)
    everyone, whole = samples.draw(ids.limit(5).unionAll(ids.limit(5)), "userId", 9, 3)
    assert everyone.count() == whole["size"] == 5 and samples.draw(ids, "userId", 0, 3)[0].isEmpty()
