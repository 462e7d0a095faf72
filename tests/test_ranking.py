import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from duolist.functions import percentile_rank
from duolist.operators import graph, models, ranking

NORMALIZED = [(0, 101, 1.0, 0.4), (0, 102, 0.6, 0.6), (0, 103, 0.3, 0.9)]


def lists(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("rank").select(*columns).collect()]


def test_percentiles(spark):
    s = spark.createDataFrame([(0, 1, 100.0, -2.0), (0, 2, 20.0, 4.0), (0, 3, 5.0, 1.0)], "pairId int, movieId int, scoreA double, scoreB double")
    got = ranking.normalize_scores(s).orderBy("movieId").collect()
    assert [r.qA for r in got] == pytest.approx([1, 2 / 3, 1 / 3])
    assert [r.qB for r in got] == pytest.approx([1 / 3, 1, 2 / 3])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=12))
def test_percentile_rank_is_average_rank(spark, values):
    rows = spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(values)], "g int, i int, x double")
    got = [r.q for r in rows.withColumn("q", percentile_rank("x", "g")).orderBy("i").collect()]
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert [None if pd.isna(w) else pytest.approx(w) for w in want] == got


def test_linear_and_nash(spark):
    q = spark.createDataFrame(NORMALIZED, "pairId int, movieId int, qA double, qB double")
    assert lists(ranking.rank_linear(q, 0.0, 3), "movieId") == [101, 102, 103]
    assert lists(ranking.rank_linear(q, 0.75, 3), "movieId") == [102, 101, 103]
    assert [r for r in lists(ranking.rank_linear(q, 1.0, 3), "groupScore")] == pytest.approx([0.6, 0.4, 0.3])
    assert lists(ranking.rank_nash(q.replace(0.4, 0.3, "qB"), 3), "movieId") == [102, 101, 103]
    with pytest.raises(ValueError):
        ranking.rank_linear(q, 1.1)


def test_vectors_and_seen_union(spark):
    pair = spark.createDataFrame([(0, 1, 2)], "pairId int, userA int, userB int")
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "userId int, vec array<double>")
    items = spark.createDataFrame([(100, [1.0, 0.0]), (200, [0.0, 1.0]), (300, [0.7, 0.7]), (400, [0.2, 0.2])], "movieId int, vec array<double>")
    seen = spark.createDataFrame([(1, 100), (2, 200)], "userId int, movieId int")
    assert lists(ranking.recommend_from_vectors(pair, users, items, seen, 0.75, 3), "movieId") == [300, 400]


def test_scores_with_zeros(spark):
    pair = spark.createDataFrame([(0, 1, 2)], "pairId int, userA int, userB int")
    scores = spark.createDataFrame([(1, 100, 3.0), (1, 200, 2.0), (1, 300, 1.0), (2, 100, 1.0), (2, 200, 2.0), (2, 300, 3.0)], "userId int, movieId int, score double")
    catalog = spark.createDataFrame([(m,) for m in (100, 200, 300, 400)], "movieId int")
    none = spark.createDataFrame([], "userId int, movieId int")
    assert lists(ranking.recommend_from_scores(pair, scores, catalog, none, None, 2), "movieId") == [200, 100]
    assert lists(ranking.recommend_from_scores(pair, scores, catalog, none, None, 9), "movieId")[-1] == 400
    everything = catalog.selectExpr("1 userId", "movieId")
    assert ranking.recommend_from_scores(pair, scores, catalog, everything, None, 2).count() == 0


def test_fold_in(spark):
    ratings = spark.createDataFrame([(1, 10, 5.0), (1, 20, 4.0), (1, 30, 3.5)], "userId int, movieId int, rating double")
    items = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0]), (30, [9.0, 9.0])], "movieId int, vec array<double>")
    assert graph.fold_in(ratings, items).first().vec == pytest.approx([0.75, 0.25])
    with pytest.raises(ValueError):
        graph.fold_in(ratings.unionAll(ratings), items)


def test_popularity(spark):
    catalog = spark.createDataFrame([(30, 5), (10, 100), (20, 50), (40, 5)], "movieId int, trainPositiveCount long")
    pair = spark.createDataFrame([(7, 1, 2)], "pairId int, userA int, userB int")
    seen = spark.createDataFrame([(1, 10), (2, 20), (2, 99)], "userId int, movieId int")
    assert lists(models.recommend_popular(pair, catalog, seen, 2), "movieId", "score", "rank") == [(30, 5.0, 1), (40, 5.0, 2)]
    assert lists(models.recommend_popular(pair, catalog, seen.where("movieId <> 20"), 9), "movieId") == [20, 30, 40]


GENRES = ["Action", "Drama", "Comedy", "Action", "Drama", "Comedy", "Action", "Drama", "Action", "Comedy"]


def films(spark):
    movies = spark.createDataFrame([(i + 1, f"Film {i + 1}", g) for i, g in enumerate(GENRES)], "movieId int, title string, genres string")
    return movies, spark.createDataFrame([(i + 1, 100 - 10 * i) for i in range(10)], "movieId int, trainPositiveCount long")


def test_onboarding_and_cold_start(spark):
    movies, catalog = films(spark)
    got = ranking.onboarding_movies(movies, catalog, 3, 6, ("Action", "Drama", "Comedy")).orderBy("onboardingOrder").collect()
    assert [r.movieId for r in got] == [1, 2, 3]
    nothing = spark.createDataFrame([], "movieId int, rating double")
    empty = ranking.cold_start_scores(movies, catalog, nothing).collect()
    assert all(r.confidence == 0 and r.score == r.popularity for r in empty)
    both = ranking.recommend_cold_start(movies, catalog, nothing, nothing, k=3)
    assert lists(both, "movieId") == [1, 2, 3]
    liked = spark.createDataFrame([(1, 5.0), (4, 5.0), (7, 5.0)], "movieId int, rating double")
    after = {r.movieId: r for r in ranking.cold_start_scores(movies, catalog, liked).collect()}
    assert after[9].taste > after[2].taste and 1 not in after
    with pytest.raises(ValueError):
        ranking.cold_start_scores(movies, catalog, spark.createDataFrame([(1, 0.0)], "movieId int, rating double"))


def test_diversification(spark):
    rows = spark.createDataFrame([(0, 1, 1, "Drama", 0.95, 0.9, 0.9), (0, 2, 2, "Drama", 0.94, 0.9, 0.9), (0, 3, 3, "Comedy", 0.91, 0.9, 0.9)], "pairId int, movieId int, rank int, genres string, groupScore double, minimumScore double, averageScore double")
    got = ranking.diversify(rows, 2, 0.1)
    assert lists(got, "movieId", "baseRank", "rank") == [(1, 1, 1), (3, 3, 2)]
    assert [(r.diversityBonus, round(r.diversifiedScore, 9)) for r in got.orderBy("rank").collect()] == [(0.0, 0.95), (1.0, 1.01)]
    for k, weight in ((4, 0.1), (0, 0.1), (2, 1.5), (2, -0.1)):
        with pytest.raises(ValueError):
            ranking.diversify(rows, k, weight)
    mixed = spark.createDataFrame([(7, i, i, g, 0.5 - i / 100, 0.4, 0.4) for i, g in enumerate(["A|B", "A|B|C", None, "B", "(no genres listed)"], 1)], rows.schema)
    picked = ranking.diversify(mixed, 5, 0.5).orderBy("rank").collect()
    assert [r.movieId for r in picked] == [1, 3, 5, 4, 2] and [round(r.diversityBonus, 6) for r in picked] == [0, 1, 1, 0.5, 0.333333]
