"""Data quality: missing values, duplicates, invalid values, broken references, time ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolist.functions import finite, is_half_star, iso_utc
from duolist.schema import TABLES, assert_unique, require_columns


def clean_tags(tags: DataFrame) -> DataFrame:
    """Tags without white space around them; missing and empty ones go."""
    stripped = F.regexp_replace(F.regexp_replace("tag", r"^\s+", ""), r"\s+$", "")
    return tags.withColumn("tag", stripped).where("tag is not null and tag <> ''")


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, fraction) of each column, NaN counted as missing; one pass."""

    def missing(f: T.StructField):
        gone = F.col(f"`{f.name}`").isNull()
        return F.count_if(gone | F.isnan(f"`{f.name}`") if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else gone)

    counts = df.agg(F.count(F.lit(1)).alias("n"), *(missing(f).alias(f"c{i}") for i, f in enumerate(df.schema)))
    rows = F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("missing")) for i, f in enumerate(df.schema)))).alias("r")
    return counts.select("n", rows).select("r.column", "r.missing", F.coalesce(F.try_divide("r.missing", "n"), F.lit(0.0)).alias("fraction"))


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each key; missing keys count as equal."""
    keys = keys or df.columns
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def value_checks(ratings: DataFrame) -> DataFrame:
    """One row: invalid ratings (missing ones and NaN included), and ids that aren't positive."""
    return ratings.agg(F.count_if(~is_half_star(F.col("rating")) | F.isnan("rating")).alias("invalid_ratings"), F.count_if(F.col("userId") <= 0).alias("invalid_users"), F.count_if(F.col("movieId") <= 0).alias("invalid_movies"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """One row: child rows whose key the parent lacks."""
    return child.select(key).join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def time_range(df: DataFrame) -> DataFrame:
    """One row: first and last time as ISO-8601 in UTC."""
    return df.agg(iso_utc(F.min("timestamp")).alias("first"), iso_utc(F.max("timestamp")).alias("last"))


def validate_tables(tables: dict[str, DataFrame]) -> dict[str, object]:
    """The whole report; KeyError if one of the four tables is absent or another is there."""
    ratings, movies, links, tags = (tables[n] for n in ("ratings", "movies", "links", "tags"))
    expected = {n: TABLES[n].fieldNames() for n in tables}
    cleaned, schemas = clean_tags(tags), {n: df.columns == expected[n] for n, df in tables.items()}
    values = value_checks(ratings).first().asDict()
    references = {"ratings_without_movie": orphans(ratings, movies, "movieId").first()[0], "ratings_without_link": orphans(ratings, links, "movieId").first()[0], "tags_without_movie": orphans(tags, movies, "movieId").first()[0]}
    keys = {"ratings": ["userId", "movieId"], "movies": ["movieId"], "links": ["movieId"], "tags": None}
    return {
        "shape": {n: {"rows": df.count(), "columns": len(df.columns)} for n, df in tables.items()},
        "schema_matches": schemas,
        "missing": {n: {r.column: {"missing": r.missing, "fraction": r.fraction} for r in missing_report(df).collect()} for n, df in tables.items()},
        "duplicates": {n: duplicate_count(tables[n], k).first()[0] for n, k in keys.items()},
        "values": values,
        "references": references,
        "time": {n: time_range(tables[n]).first().asDict() for n in ("ratings", "tags")},
        "tags": {"rows": tags.count(), "kept": cleaned.count()},
        "core_valid": all(schemas.values()) and not values["invalid_ratings"] and not references["ratings_without_movie"],
    }


def validation_summary(spark: SparkSession, report: dict) -> DataFrame:
    """(check, value): the report's seven headline numbers as text."""
    rows = [
        ("schemas match", all(report["schema_matches"].values())),
        ("invalid ratings", report["values"]["invalid_ratings"]),
        ("duplicate ratings", report["duplicates"]["ratings"]),
        ("ratings without movie", report["references"]["ratings_without_movie"]),
        ("ratings without link", report["references"]["ratings_without_link"]),
        ("tags without movie", report["references"]["tags_without_movie"]),
        ("core valid", report["core_valid"]),
    ]
    return spark.createDataFrame([(c, str(v)) for c, v in rows], "check string, value string")


def check_ratings(ratings: DataFrame, name: str, catalog: DataFrame | None = None) -> DataFrame:
    """ratings, or ValueError: not empty, finite half-stars from 0.5 to 5, and, with a catalogue, unique movies inside it."""
    require_columns(ratings, ["movieId", "rating"], name)
    n, bad = ratings.agg(F.count(F.lit(1)), F.count_if(~finite(F.col("rating").cast("double")) | ~is_half_star(F.col("rating")))).first()
    if catalog is None and not n:
        raise ValueError(f"{name} is empty")
    if bad:
        raise ValueError(f"{name} has {bad} ratings that are not half-stars from 0.5 to 5")
    if catalog is not None:
        assert_unique(ratings, ["movieId"], name)
        unknown = [r.movieId for r in ratings.join(catalog.select("movieId"), "movieId", "left_anti").select("movieId").orderBy("movieId").limit(5).collect()]
        if unknown:
            raise ValueError(f"{name} has movies outside the catalogue: {unknown}")
    return ratings
