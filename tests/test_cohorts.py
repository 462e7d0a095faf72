from pyspark.sql import functions as F

from duolist.config import PrepConfig, utc_seconds
from duolist.operators import cohorts


def at(day):
    return utc_seconds(day)


def frame(spark, rows):
    return spark.createDataFrame(rows, "userId int, movieId int, rating float, timestamp long")


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_split_and_cohorts(spark):
    config = PrepConfig(training_min_positives=1, evaluation_min_train_ratings=2, evaluation_min_train_positives=1, evaluation_min_validation_positives=1, evaluation_min_test_positives=1)
    rows = [(1, 1, 4.0, at("2018-01-01")), (1, 2, 3.0, at("2018-02-01")), (1, 3, 4.5, at("2019-03-01")), (1, 4, 5.0, at("2020-04-01")), (2, 1, 4.0, at("2018-01-01")), (2, 5, 4.0, at("2020-01-01"))]
    split = cohorts.add_temporal_split(frame(spark, rows), config)
    assert ids(split, "userId", "movieId", "split") == [(1, 1, "train"), (1, 2, "train"), (1, 3, "validation"), (1, 4, "test"), (2, 1, "train"), (2, 5, "test")]
    stats = cohorts.user_split_statistics(split)
    assert ids(cohorts.training_users(stats, config), "userId") == [(1,), (2,)]
    assert ids(cohorts.evaluation_users(stats, config), "userId") == [(1,)]
    assert {r.split: r.positive_rate for r in cohorts.split_summary(split).collect()}["train"] == 2 / 3


def test_missing_time_and_nan_rating(spark):
    got = cohorts.add_temporal_split(frame(spark, [(1, 1, float("nan"), None), (1, 2, None, 0)]), PrepConfig()).orderBy("movieId").collect()
    assert [(r.split, r.is_positive, r.rating) for r in got] == [("test", False, None), ("train", False, None)]


def test_warm_catalog(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (1, 20), (2, 20), (3, 30)], "userId int, movieId int")
    warm = cohorts.warm_catalog(edges, PrepConfig(warm_item_min_train_positives=2))
    assert ids(warm, "movieId") == [(10,), (20,)]
    assert cohorts.edges_of_catalog(edges, warm).count() == 4
    assert cohorts.warm_coverage(edges, warm).first().coverage == 0.8
    assert cohorts.warm_coverage(edges.limit(0), warm).first().coverage == 0.0


def test_candidates_leave_out_what_either_has_seen(spark):
    split = spark.createDataFrame([(1, 10, "train"), (1, 30, "validation"), (2, 20, "train"), (2, 40, "test")], "userId int, movieId int, split string")
    warm = spark.createDataFrame([(m,) for m in (10, 20, 30, 50)], "movieId int")
    pair = spark.createDataFrame([(0, 1, 2)], "pairId int, userA int, userB int")
    assert ids(cohorts.pair_candidates(pair, warm, cohorts.seen_items(split, None)), "movieId") == [(50,)]


def test_first_interactions_and_latest(spark):
    rows = frame(spark, [(1, 30, 4.0, 3), (1, 20, 4.0, 2), (1, 10, 4.0, 1)])
    assert ids(cohorts.first_interactions(rows, 2), "movieId") == [(10,), (20,)]
    log = frame(spark, [(1, 5, 3.0, 1), (1, 5, 4.0, 2), (1, 6, 3.0, 1), (1, 6, None, 2)])
    assert ids(cohorts.latest_rating(log), "movieId", "rating") == [(5, 4.0)]


def test_pretest_users(spark):
    stats = spark.createDataFrame([(1, 100, 20, 3), (2, 99, 20, 3), (3, 100, 19, 3), (4, 100, 20, 2)], "userId int, train_interactions int, train_positives int, validation_positives int")
    assert ids(cohorts.pretest_users(stats, 100, 20, 3), "userId") == [(1,)]
    assert ids(cohorts.pretest_users(stats, 99, 20, 3, stats.where(F.col("userId") == 1)), "userId") == [(2,)]


def test_search_is_literal(spark):
    movies = spark.createDataFrame([(1, "Alien (1979)"), (2, "aliens"), (3, "A.ien")], "movieId int, title string")
    assert ids(cohorts.search_titles(movies, "ALIEN"), "movieId") == [(1,), (2,)]
    assert ids(cohorts.search_titles(movies, "a.i"), "movieId") == [(3,)]


def test_candidates_are_neither_joined_nor_shuffled_one_by_one(spark):
    pairs = spark.range(40).selectExpr("id as pairId", "2 * id as userA", "2 * id + 1 as userB")
    catalog = spark.range(100, 190).selectExpr("id as movieId")
    seen = spark.range(400).selectExpr("id % 80 as userId", "95 + (id * 7) % 60 as movieId").distinct()
    watched = {(r.pairId, r.movieId) for r in cohorts.seen_by_pair(pairs, seen).collect()}
    want = sorted({(p, m) for p in range(40) for m in range(100, 190)} - watched)
    gone = cohorts.seen_by_pair(pairs, seen)
    assert sorted((r.pairId, r.movieId) for r in cohorts.all_but(pairs.select("pairId"), catalog, gone, 7, 9).collect()) == want
    found = cohorts.pair_candidates(pairs, catalog, seen)
    assert sorted((r.pairId, r.movieId) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(CASE") < plan.index("Exchange")  # nothing is exchanged after the candidates are listed
    counts = {r.pairId: r.candidates for r in cohorts.candidate_counts(pairs, catalog, seen).collect()}
    assert counts == {p: sum(q == p for q, _ in want) for p in range(40)}
    none = cohorts.candidate_counts(pairs, catalog.limit(0), seen)
    assert none.isEmpty()
