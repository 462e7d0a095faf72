"""Ratings from elsewhere: exports of two layouts, and a session's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duolist.operators.checks import check_ratings
from duolist.schema import RATINGS


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one CSV file as text, in the order of the file (column __line)."""
    return spark.read.option("header", True).option("escape", '"').csv(path).withColumn("__line", F.monotonically_increasing_id())


def import_ratings(rows: DataFrame, links: DataFrame, catalog: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """((movieId, rating), report) from an export's rows; ValueError if the layout is neither of the two.

    The first layout has movieId and rating; the other Const, Your Rating and Title Type, where only movies count, ids are
    looked up by the number in Const, and ratings are halved. Text that isn't a number counts as missing, rows with missing
    values go, of a movie's rows the last counts, and movies outside the catalogue go.
    """
    columns = set(rows.columns)
    if "__line" not in columns:
        rows = rows.withColumn("__line", F.monotonically_increasing_id())
    total = rows.count()
    if {"movieId", "rating"} <= columns:
        layout, films = "movie ids", rows.select(F.expr("try_cast(movieId as long)").alias("movieId"), F.expr("try_cast(rating as double)").alias("rating"), "__line")
        other = unmapped = 0
    elif {"Const", "Your Rating", "Title Type"} <= columns:
        layout, own = "title codes", rows.where("`Title Type` = 'Movie'")
        other = total - own.count()
        number = F.nullif(F.regexp_extract("Const", r"^tt(\d+)$", 1), F.lit(""))
        numbered = own.select(F.expr("try_cast(n as long)").alias("imdbId"), F.expr("try_cast(`Your Rating` as double) / 2").alias("rating"), "__line") if "n" in columns else own.withColumn("n", number).select(F.expr("try_cast(n as long)").alias("imdbId"), F.expr("try_cast(`Your Rating` as double) / 2").alias("rating"), "__line")
        films = numbered.where("imdbId is not null").join(links.select("imdbId", F.col("movieId").cast("long").alias("movieId")), "imdbId", "left").select("movieId", "rating", "__line")
        unmapped = films.where("movieId is null").count()
    else:
        raise ValueError("the export has neither movieId and rating nor Const, Your Rating and Title Type")
    complete = films.where("movieId is not null and rating is not null")
    check_ratings(complete, "export")
    last = complete.withColumn("n", F.row_number().over(Window.partitionBy("movieId").orderBy(F.desc("__line")))).where("n = 1").select("movieId", "rating")
    warm = last.join(catalog.select(F.col("movieId").cast("long").alias("movieId")), "movieId", "left_semi").orderBy("movieId")
    n, kept = last.count(), warm.count()
    report = {"layout": layout, "rows": total, "non_movies": other, "unmapped": unmapped, "complete": complete.count(), "distinct": n, "cold": n - kept, "usable": kept}
    return warm, report


def session_ratings(spark: SparkSession, records: dict[int, tuple[float, int]], user_id: int) -> DataFrame:
    """The rating table of one session: movie to (rating, epoch second); sorted by movie, with its schema even if empty."""
    if not 0 < user_id < 2**31:
        raise ValueError("user_id must be a positive 32-bit number")
    for movie, (rating, second) in records.items():
        if not 0 < movie < 2**31 or second <= 0 or not 0.5 <= rating <= 5 or rating * 2 != int(rating * 2):
            raise ValueError(f"movie {movie}: ids and times must be positive, ratings half-stars from 0.5 to 5")
    return spark.createDataFrame([(user_id, m, float(r), int(t)) for m, (r, t) in sorted(records.items())], RATINGS)
