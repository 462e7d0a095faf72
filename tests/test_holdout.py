import json
import shutil

import pytest

from duolist import __main__ as cli
from duolist.config import AlsConfig, GraphConfig
from duolist.operators import cohorts, models, pairs
from duolist.plans import experiments, holdout
from duolist.schema import shared_table
from duolist.sources import sinks, tables
from duolist.sources.tables import DEMO, DemoTables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def demo(spark):
    d = DemoTables(spark, DATA)
    d.ratings = shared_table(d.ratings, "ratings")
    return d


def test_a_frozen_run_is_evaluated_once(spark, demo, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    none = spark.createDataFrame([], "userId long")
    notes = holdout.prepare(demo.ratings, demo.movies, DEMO, path, none, 15, 15)
    assert notes["members"] == 60 and notes["similarity"]["count"] == 30
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):  # nothing is trained
        holdout.evaluate_once(spark, path, demo.ratings)
    made = holdout.train(spark, path, demo.ratings, GraphConfig(steps=3, validation_interval=1, patience=1, smoothing=1, layers=1, width=4), 5)
    assert set(made["validation"]) == set(holdout.METHODS)
    if made["status"] != "frozen":
        with pytest.raises(RuntimeError, match="longer"):
            holdout.evaluate_once(spark, path, demo.ratings)
        fitted, _ = sinks.load_model(spark, f"{path}/trained", list(holdout.TRAINED))
        sinks.save_model({n: shared_table(df, n) for n, df in fitted.items()}, made | {"status": "frozen"}, f"{path}/again/trained")
        frozen, notes = sinks.load_model(spark, f"{path}/prepared", list(holdout.PREPARED))
        sinks.save_model(frozen, notes, f"{path}/again/prepared")
        path += "/again"
    for part in ("prepared", "trained"):
        shutil.copytree(f"{path}/{part}", f"{path}/broken/{part}")
    report = holdout.evaluate_once(spark, path, demo.ratings, resamples=50)
    assert set(report["methods"]) == set(holdout.METHODS) and len(report["compared"]) == 6
    with pytest.raises(FileExistsError):
        holdout.evaluate_once(spark, path, demo.ratings)
    # a run that breaks off while it looks has had its look
    monkeypatch.setattr(holdout, "_evaluate", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        holdout.evaluate_once(spark, f"{path}/broken", demo.ratings)
    monkeypatch.undo()
    with pytest.raises(FileExistsError):
        holdout.evaluate_once(spark, f"{path}/broken", demo.ratings)


def test_changed_tables_are_noticed(spark, tmp_path):
    df = spark.range(3)
    sinks.save_model({"users": df}, {"digests": sinks.freeze({"users": spark.range(4)})}, str(tmp_path / "trained"))
    with pytest.raises(ValueError, match="users"):
        holdout._read(spark, str(tmp_path), "trained", ("users",))


def test_stages(spark, tmp_path):
    def stage(name, *parts):
        for part, settings in parts:
            sinks.write_table(spark.createDataFrame([(json.dumps(settings),)], "settings string"), str(tmp_path / name / part))

    stage("full", ("training", {"steps": 3}), ("validation", {"methods": [{"method": "m", "score": 0.5}, {"method": "n", "score": 0.25}]}))
    stage("half", ("training", {"steps": 9}))
    got = experiments.collect_stages(spark, str(tmp_path), ["full", "half", "absent"]).orderBy("method").collect()
    assert [(r.stage, r.steps, r.method, r.score) for r in got] == [("full", 3, "m", 0.5), ("full", 3, "n", 0.25)]
    with pytest.raises(ValueError, match="complete"):
        experiments.collect_stages(spark, str(tmp_path), ["half"])
    for name, up in (("one", 0.5), ("two", 0.25)):
        sinks.write_table(spark.createDataFrame([("m", i, i / 100 + up) for i in range(20)], "method string, pairId long, ndcg double"), str(tmp_path / name / "metrics"))
    both = {"name": "one against two", "metric": "ndcg", "a": ("one", "m"), "b": ("two", "m")}
    row = experiments.compare_stages(spark, str(tmp_path), [both, both | {"b": ("absent", "m")}], 50).collect()
    assert len(row) == 1 and row[0].stageB == "two" and row[0].methodB == "m" and row[0].meanDifferenceAminusB == pytest.approx(0.25)


def test_lists_for_two_by_every_model(spark, demo):
    # movies 1-3 are liked together, 4 and 5 by others
    likes = spark.createDataFrame([(u, m) for u in range(1, 9) for m in ((1, 2, 3) if u < 6 else (4, 5))], "userId int, movieId int")
    movies = spark.createDataFrame([(m, f"t{m}", "Drama") for m in range(1, 6)], "movieId int, title string, genres string")
    catalog = likes.groupBy("movieId").count().withColumnRenamed("count", "trainPositiveCount")
    a, b = (spark.createDataFrame([(m, 5.0), (4, 1.0)], "movieId int, rating double") for m in (1, 2))
    near = models.item_neighbours(likes, 10)
    got = experiments.recommend_for_two_by_neighbours(spark, a, b, movies, catalog, near, 10, (0.0,), 2).orderBy("rank").collect()
    assert [(r.movieId, r.title, r.trainPositiveCount) for r in got] == [(3, "t3", 5), (5, "t5", 3)]
    config = AlsConfig(factors=4, iterations=3)
    items = shared_table(models.train_als(likes, config)["movies"], "items")
    got = experiments.recommend_for_two(spark, a, b, movies, catalog, items, (0.0, 1.0), 2, config)
    assert [(r.movieId, r.genres) for r in got.where("rank = 1").collect()] == [(3, "Drama")] * 2
    cold = spark.createDataFrame([(99, 5.0)], "movieId int, rating double")
    for serve in (lambda: experiments.recommend_for_two_by_neighbours(spark, a, cold, movies, catalog, near, 10), lambda: experiments.recommend_for_two(spark, a, cold, movies, catalog, items, als=config)):
        with pytest.raises(ValueError, match="no known movie"):
            serve()


def test_small_operators(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 2, 0.25), (1, 2, 3, None), (2, 5, 6, 0.75)], "pairId long, userA long, userB long, s double")
    assert pairs.describe(rows, "s").first().asDict() == pytest.approx({"count": 2, "mean": 0.5, "std": 0.125**0.5, "min": 0.25, "q25": 0.375, "q50": 0.5, "q75": 0.625, "max": 0.75})
    assert cohorts.count_members(rows).first().members == 5
    assert {r.userId for r in pairs.evaluated_members(rows, 1, 2).collect()} == {1, 2, 5, 6}
    cohorts.require_same(rows, rows.select("pairId"), "pairId", "pairs")
    with pytest.raises(ValueError, match="pairs"):
        cohorts.require_same(rows, rows.limit(1), "pairId", "pairs")
    for write in (sinks.write_csv, sinks.write_csv_gzip):
        path = str(tmp_path / write.__name__)
        write(rows, path)
        assert {tuple(r) for r in sinks.read_csv(spark, path, "s double, pairId long").collect()} == {(0.25, 0), (None, 1), (0.75, 2)}


def test_catalogue_and_session(spark):
    movies = spark.createDataFrame([(m, f"t{m}", "Drama") for m in range(1, 6)], "movieId int, title string, genres string")
    links = spark.createDataFrame([(1, 11), (2, None)], "movieId int, tmdbId long")
    catalog = spark.createDataFrame([(m, m) for m in range(1, 5)], "movieId int, trainPositiveCount int")
    all_movies, queue = tables.catalogue_bundle(movies, links, catalog, 2)
    assert all_movies.count() == 5 and [r.movieId for r in queue.orderBy("queue", "position").collect()] == [4, 3, 2, 1]
    mine = spark.createDataFrame([(1, 2, 4.0, 86400), (1, 77, 3.0, 0)], "userId int, movieId int, rating float, timestamp long")
    assert {(r.title, str(r.ratedAt)) for r in tables.titled(mine, movies).collect()} == {("t2", "1970-01-02 00:00:00"), (None, "1970-01-01 00:00:00")}


def test_command_line(spark, tmp_path, demo):
    d = {"ratings": [(1, 1, 4.0, 1)], "movies": [(1, "t", "Drama")], "links": [(1, 1, 1)], "tags": [(1, 1, "x", 1)]}
    for n, rows in d.items():
        spark.createDataFrame(rows, tables.TABLES[n]).write.option("header", True).csv(str(tmp_path / f"{n}.csv"))
    assert cli.main(["check", "--data", str(tmp_path)])["core_valid"]
    folder = tmp_path / "demo"
    demo.ratings.write.option("header", True).csv(str(folder / "ratings.csv"))
    sinks.write_table(demo.pairs, str(folder / "prepared" / "pairs"))
    sinks.write_table(demo.catalog, str(folder / "prepared" / "warm_catalog"))
    sinks.write_table(demo.warm_edges, str(folder / "prepared" / "train_edges"))
    config = folder / "config.json"
    sinks.write_json(DEMO.to_dict(), config)
    shared = ["--data", str(folder), "--config", str(config), "--prepared", str(folder / "prepared")]
    assert cli.main(["popularity", *shared, "--out", str(folder / "popular")])["evaluated_pairs"] > 0
    made = cli.main(["select", *shared, "--out", str(folder / "chosen"), "--model", "neighbours", "--grid", '{"a": {"width": 5}}', "--pairs", "6"])
    assert made["best"] in made["found"]
