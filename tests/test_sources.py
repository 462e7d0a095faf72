import json

import pytest
from pyspark.sql import functions as F

from duolist.config import PrepConfig, check_nested_counts
from duolist.operators import checks
from duolist.sources import tables
from duolist.sources import imports, sinks, tables
from duolist.streaming import running_positive_counts, split_to_parquet


def exports(spark):
    links = spark.createDataFrame([(10, 111, 1), (20, 222, 2)], "movieId int, imdbId long, tmdbId long")
    return links, spark.createDataFrame([(10,)], "movieId int")


def test_title_code_import(spark):
    links, warm = exports(spark)
    more = links.unionAll(spark.createDataFrame([(30, 4711, None), (40, 815, 7)], links.schema))
    warm = warm.select("movieId").unionAll(spark.createDataFrame([(30,)], "movieId int")).distinct()
    codes = [("tt4711", "3", "Movie"), ("tt0004711", "10", "Movie"), ("tt00815", "6", "Movie"), ("tt987654", "2", "Movie"), ("tt4711", "1", "Video Game"), ("no code", "5", "Movie"), ("", "5", "Movie")]
    rows = spark.createDataFrame(codes, "Const string, `Your Rating` string, `Title Type` string")
    got, report = imports.import_ratings(rows, more, warm)
    assert [tuple(r) for r in got.collect()] == [(30, 5.0)]  # of two codes of one movie the last counts, at half the stars
    assert report["non_movies"] == 1 and report["usable"] == 1 and report["cold"] == 1


def test_import_keeps_the_last(spark, tmp_path):
    links, warm = exports(spark)
    path = tmp_path / "e.csv"
    path.write_text("movieId,rating\n10,3.0\n99,3.5\nx,1\n10,4.0\n")
    got, report = imports.import_ratings(imports.read_export(spark, str(path)), links, warm)
    assert [tuple(r) for r in got.collect()] == [(10, 4.0)] and report["cold"] == 1
    with pytest.raises(ValueError):
        imports.import_ratings(spark.createDataFrame([(1,)], "a int"), links, warm)
    with pytest.raises(ValueError):
        imports.import_ratings(spark.createDataFrame([(10, 4.2)], "movieId int, rating double"), links, warm)


def test_session_ratings(spark):
    got = imports.session_ratings(spark, {20: (4.5, 100), 10: (3.0, 100)}, 1)
    assert [r.movieId for r in got.collect()] == [10, 20]
    assert imports.session_ratings(spark, {}, 1).columns == ["userId", "movieId", "rating", "timestamp"]
    with pytest.raises(ValueError):
        imports.session_ratings(spark, {10: (4.2, 100)}, 1)


def test_preview_image(spark):
    pages = ['<head><meta property="og:image" content="https://a/1.jpg"><meta property="og:image" content="https://a/2.jpg">', "<META content='https://b/3.jpg' property='og:image'/>", "<p>none</p>", None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", tables.preview_image("h").alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == ["https://a/1.jpg", "https://b/3.jpg", None, None]


def test_poster_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"1": "https://x/1", "bad-id": "https://x/2", "3": "http://x/3"}))
    assert [tuple(r) for r in tables.poster_cache(spark, str(tmp_path / "c.json")).collect()] == [(1, "https://x/1")]


def four(spark):
    return {
        "ratings": spark.createDataFrame([(1, 1, 4.0, 100), (1, 1, 0.3, 200), (0, 9, None, 300), (2, 1, float("nan"), 400)], "userId int, movieId int, rating float, timestamp long"),
        "movies": spark.createDataFrame([(1, "A", None)], "movieId int, title string, genres string"),
        "links": spark.createDataFrame([(1, 5, None)], "movieId int, imdbId long, tmdbId long"),
        "tags": spark.createDataFrame([(1, 1, "\t good ", 100), (1, 7, " ", 100), (1, 1, None, 100)], "userId int, movieId int, tag string, timestamp long"),
    }


def test_quality_report(spark):
    report = checks.validate_tables(four(spark))
    assert report["values"] == {"invalid_ratings": 3, "invalid_users": 1, "invalid_movies": 0}
    assert report["duplicates"]["ratings"] == 1 and report["references"] == {"ratings_without_movie": 1, "ratings_without_link": 1, "tags_without_movie": 1}
    assert report["missing"]["ratings"]["rating"] == {"missing": 2, "fraction": 0.5} and report["tags"] == {"rows": 3, "kept": 1}
    assert report["time"]["ratings"]["first"] == "1970-01-01T00:01:40+00:00" and report["core_valid"] is False
    assert checks.clean_tags(four(spark)["tags"]).first().tag == "good"
    assert checks.validation_summary(spark, report).count() == 7
    with pytest.raises(KeyError):
        checks.validate_tables({k: v for k, v in four(spark).items() if k != "tags"})


def test_readers_and_sinks(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="ratings.csv"):
        tables.require_tables(spark, str(tmp_path))
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n1,"A ""quoted"" one, here",Drama|War\n')
    assert tables.load_table(spark, str(tmp_path), "movies").first().title == 'A "quoted" one, here'
    df = four(spark)["movies"]
    sinks.write_table(df, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_table(df, str(tmp_path / "m"))
    frozen = sinks.freeze({"m": df})
    sinks.verify_frozen({"m": spark.read.parquet(str(tmp_path / "m")).repartition(3)}, frozen)
    with pytest.raises(ValueError):
        sinks.verify_frozen({"m": df.withColumn("title", F.lit("B"))}, frozen)
    sinks.save_model({"neighbours": df}, {"width": 5}, str(tmp_path / "model"))
    parts, settings = sinks.load_model(spark, str(tmp_path / "model"), ["neighbours"])
    assert parts["neighbours"].count() == 1 and settings == {"width": 5}
    sinks.write_json({"a": 1}, tmp_path / "r" / "x.json")
    assert (tmp_path / "r" / "x.json").read_text().endswith("}\n")


def test_config_round_trip(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(PrepConfig(train_end="2000-01-01").to_dict()))
    assert PrepConfig.from_json(tmp_path / "c.json").train_end_timestamp == 946684800
    check_nested_counts([100, 250, 500], 500)
    for bad in ([100, 100, 500], [500, 100], [100]):
        with pytest.raises(ValueError):
            check_nested_counts(bad, 500)


def test_streams(spark, tmp_path):
    rows = four(spark)["ratings"].where("rating = 4")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_positive_counts(stream, PrepConfig()).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts").collect()] == [(1, 1)]
    q = split_to_parquet(stream, PrepConfig(), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'train'").count() == 1


def test_queue(spark):
    movies = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "movieId int, title string")
    links, _ = exports(spark)
    starters = spark.createDataFrame([(2, 1)], "movieId int, onboardingOrder int")
    catalog = spark.createDataFrame([(1, 10), (2, 99), (3, 50)], "movieId int, trainPositiveCount long")
    assert [r.movieId for r in tables.rating_queue(movies, links, starters, catalog).orderBy("queue", "position").collect()] == [2, 3, 1]


def test_tasks_of_ratings_grow_with_the_lines(spark, tmp_path, monkeypatch):
    """A task's hash tables hold a bounded number of lines, whatever the usual number of partitions; the ratings stay the same."""
    spark.createDataFrame([(o, o % 40) for o in range(200)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(1000).selectExpr("id % 200 AS l_orderkey", "id % 17 AS l_partkey", "CAST(id % 50 AS double) AS l_quantity", "date_add(DATE'1999-01-01', CAST(id % 900 AS int)) AS l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    usual = sorted(map(tuple, tables.DemoTables(spark, str(tmp_path)).ratings.collect()))
    assert tables.many_parts(spark, 4_000_000) is None and tables.many_parts(spark, 360_000_001) == 361
    monkeypatch.setattr(tables, "many_parts", lambda s, rows: 37)
    many = tables.DemoTables(spark, str(tmp_path)).ratings
    assert sorted(map(tuple, many.collect())) == usual and many.rdd.getNumPartitions() == 37
