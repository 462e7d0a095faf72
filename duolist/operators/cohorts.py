"""Temporal split, cohorts, catalogue and what users have seen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolist.config import PrepConfig
from duolist.schema import require_columns, without_nan

SPLITS = ("train", "validation", "test")


def add_temporal_split(ratings: DataFrame, config: PrepConfig) -> DataFrame:
    """Adds split and is_positive. A rating at a cutoff's very second belongs to the later split, one without time to test."""
    require_columns(ratings, ["userId", "movieId", "rating", "timestamp"], "ratings")
    t = F.col("timestamp")
    split = F.when(t < config.train_end_timestamp, SPLITS[0]).when(t < config.validation_end_timestamp, SPLITS[1]).otherwise(SPLITS[2])
    return without_nan(ratings).withColumns({"split": split, "is_positive": F.coalesce(F.col("rating") >= config.positive_threshold, F.lit(False))})


def split_summary(ratings: DataFrame) -> DataFrame:
    """interactions, users, movies and positive_rate of each split."""
    return ratings.groupBy("split").agg(F.count(F.lit(1)).alias("interactions"), F.count_distinct("userId").alias("users"), F.count_distinct("movieId").alias("movies"), F.avg(F.col("is_positive").cast("double")).alias("positive_rate"))


def user_split_statistics(ratings: DataFrame) -> DataFrame:
    """Interactions and positives of each user in each split, zeros included, in one pass."""
    of = {s: F.col("split") == s for s in SPLITS}
    counts = [F.count_if(of[s]).alias(f"{s}_interactions") for s in SPLITS] + [F.count_if(of[s] & F.col("is_positive")).alias(f"{s}_positives") for s in SPLITS]
    return ratings.groupBy("userId").agg(*counts)


def training_users(statistics: DataFrame, config: PrepConfig) -> DataFrame:
    return statistics.where(F.col("train_positives") >= config.training_min_positives).select("userId")


def evaluation_users(statistics: DataFrame, config: PrepConfig) -> DataFrame:
    """Users who pass all four thresholds. Looks at validation and test activity; pretest_users() doesn't."""
    c = config
    return statistics.where((F.col("train_interactions") >= c.evaluation_min_train_ratings) & (F.col("train_positives") >= c.evaluation_min_train_positives) & (F.col("validation_positives") >= c.evaluation_min_validation_positives) & (F.col("test_positives") >= c.evaluation_min_test_positives)).select("userId")


def pretest_users(statistics: DataFrame, min_train_ratings: int, min_train_positives: int, min_validation_positives: int, excluded: DataFrame | None = None) -> DataFrame:
    """Users eligible by what happened before the test period, less excluded ones."""
    users = statistics.where((F.col("train_interactions") >= min_train_ratings) & (F.col("train_positives") >= min_train_positives) & (F.col("validation_positives") >= min_validation_positives)).select("userId")
    return users.join(excluded.select("userId"), "userId", "left_anti") if excluded is not None else users


def of_users(rows: DataFrame, users: DataFrame | None) -> DataFrame:
    return rows if users is None else rows.join(users.select("userId"), "userId", "left_semi")


def positive_events(ratings: DataFrame, split: str, users: DataFrame | None = None) -> DataFrame:
    """(userId, movieId) of positive ratings in a split, repeats included."""
    return of_users(ratings.where((F.col("split") == split) & F.col("is_positive")).select("userId", "movieId"), users)


def training_edges(ratings: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Distinct positive training pairs of user and movie."""
    return positive_events(ratings, "train", users).dropDuplicates(["userId", "movieId"])


def warm_catalog(edges: DataFrame, config: PrepConfig) -> DataFrame:
    """Movies with enough training edges, and how many they have."""
    return edges.groupBy("movieId").agg(F.count(F.lit(1)).alias("trainPositiveCount")).where(F.col("trainPositiveCount") >= config.warm_item_min_train_positives)


def edges_of_catalog(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    return edges.join(catalog.select("movieId"), "movieId", "left_semi").select("userId", "movieId")


def warm_coverage(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: the share of events whose movie is in the catalogue; 0 without events."""
    flagged = events.join(catalog.select("movieId", F.lit(1.0).alias("warm")), "movieId", "left")
    return flagged.agg(F.coalesce(F.avg(F.coalesce("warm", F.lit(0.0))), F.lit(0.0)).alias("coverage"))


def first_interactions(ratings: DataFrame, k: int) -> DataFrame:
    """The earliest k rows of each user; of equal times the smaller movieId comes first."""
    order = Window.partitionBy("userId").orderBy("timestamp", "movieId")
    return ratings.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def latest_rating(log: DataFrame) -> DataFrame:
    """The last entry of each user and movie in a log of ratings; entries without a rating take the movie back."""
    last = log.groupBy("userId", "movieId").agg(F.max_by(F.struct("rating", "timestamp"), "timestamp").alias("last"))
    return last.where("last.rating is not null").select("userId", "movieId", "last.rating", "last.timestamp")


def seen_items(ratings: DataFrame, users: DataFrame | None, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Distinct (userId, movieId) of any rating in the given splits."""
    return of_users(ratings.where(F.col("split").isin(*splits)).select("userId", "movieId"), users).distinct()


def pair_members(pairs: DataFrame) -> DataFrame:
    """(pairId, member, userId): both members of each pair."""
    return pairs.select("pairId", F.explode(F.array(F.struct(F.lit("A").alias("member"), F.col("userA").alias("userId")), F.struct(F.lit("B").alias("member"), F.col("userB").alias("userId")))).alias("m")).select("pairId", "m.member", "m.userId")


def count_members(pairs: DataFrame) -> DataFrame:
    """One row: how many different users the pairs have."""
    return pair_members(pairs).agg(F.count_distinct("userId").alias("members"))


def require_same(a: DataFrame, b: DataFrame, key: str, name: str) -> None:
    """ValueError unless both tables hold the same keys."""
    if not (a.select(key).join(b.select(key), key, "left_anti").isEmpty() and b.select(key).join(a.select(key), key, "left_anti").isEmpty()):
        raise ValueError(f"{name}: the two sides hold different values of {key}")


def seen_by_pair(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct (pairId, movieId) that either member has seen."""
    return pair_members(pairs).join(seen, "userId").select("pairId", "movieId").distinct()


def against_all(asking: DataFrame, rows: DataFrame, key: str, asking_block: int = 2048, rows_block: int = 2048) -> DataFrame:
    """Each row of asking with each row of rows, block by block.

    Both sides are dealt by hash into as many blocks as their sizes ask for, and every block of one meets every block of the other
    under a key of its own: tasks stay even and of bounded size, and their number grows with both sides. Nothing is broadcast.
    """
    ablocks, rblocks = (max(1, math.ceil(df.count() / size)) for df, size in ((asking, asking_block), (rows, rows_block)))

    def every(size: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))

    left = asking.withColumn("__a", F.pmod(F.xxhash64(*asking.columns), F.lit(ablocks)).cast("int")).withColumn("__r", every(rblocks))
    right = rows.withColumn("__r", F.pmod(F.xxhash64(key), F.lit(rblocks)).cast("int")).withColumn("__a", every(ablocks))
    # a number of partitions of its own, as bytes don't tell how many rows will come out
    left, right = (df.repartition(ablocks * rblocks, "__a", "__r") for df in (left, right))
    return left.join(right.hint("shuffle_hash"), ["__a", "__r"]).drop("__a", "__r")


#: Rows that a task lists before blocks are made smaller for the sake of more tasks.
LISTED_AT_ONCE = 4_000_000


def blocks_that_meet(asking: DataFrame, rows: DataFrame, asking_block: int, rows_block: int) -> tuple[int, int]:
    """Blocks of two sides of which every one meets every other: of the given sizes, which keep copies few, or of fewer rows where that
    would leave cores without work."""
    a, b = asking.count(), rows.count()
    ablocks, bblocks = (max(1, math.ceil(n / size)) for n, size in ((a, asking_block), (b, rows_block)))
    tasks = min(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(a * b / LISTED_AT_ONCE))
    return (max(ablocks, min(a, math.ceil(tasks / bblocks))) or 1, bblocks)


def all_but(asking: DataFrame, rows: DataFrame, gone: DataFrame, asking_block: int = 16_384, rows_block: int = 65_536) -> DataFrame:
    """Each row of asking (pairId and more) with each movieId of rows but those of gone (pairId, movieId), block by block.

    As against_all(), but a pair meets a block of movies as one array and takes its own out of it as it is listed, so what is shuffled
    are pairs, blocks and what goes, never the pairs' candidates. Blocks are large, for each pair is copied once for each block of
    movies and each movie once for each block of pairs; a task holds a block of movies, whatever it lists. rows: distinct.
    """
    ablocks, rblocks = blocks_that_meet(asking, rows, asking_block, rows_block)

    def every(size: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))

    block = F.pmod(F.xxhash64("movieId"), F.lit(rblocks)).cast("int").alias("__r")
    kind = rows.schema["movieId"].dataType
    own = gone.select("pairId", block, F.col("movieId").cast(kind).alias("movieId")).groupBy("pairId", "__r").agg(F.collect_list("movieId").alias("__gone"))
    left = asking.withColumn("__a", F.pmod(F.xxhash64("pairId"), F.lit(ablocks)).cast("int")).withColumn("__r", every(rblocks)).join(own, ["pairId", "__r"], "left")
    right = rows.select("movieId", block).groupBy("__r").agg(F.collect_list("movieId").alias("__movies")).withColumn("__a", every(ablocks))
    left, right = (df.repartition(ablocks * rblocks, "__a", "__r") for df in (left, right))
    many = F.size("__gone") > 16  # few are looked at for each movie, many are taken out at once
    stays = F.when(many, F.array_except("__movies", "__gone")).otherwise(F.col("__movies"))
    met = left.join(right.hint("shuffle_hash"), ["__a", "__r"]).select(*asking.columns, F.when(~many, F.col("__gone")).alias("__few"), F.explode(stays).alias("movieId"))
    return met.where(F.col("__few").isNull() | ~F.array_contains("__few", F.col("movieId"))).select(*asking.columns, "movieId")


def pair_candidates(pairs: DataFrame, catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """(pairId, movieId): the catalogue less what either member has seen. Each pair is meant to face the whole catalogue."""
    return all_but(pairs.select("pairId"), catalog.select("movieId"), seen_by_pair(pairs, seen))


def candidate_counts(pairs: DataFrame, catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """(pairId, candidates): how many pair_candidates() each pair has, without listing them; pairs without any are left out."""
    gone = seen_by_pair(pairs, seen.join(catalog.select("movieId"), "movieId", "left_semi")).groupBy("pairId").agg(F.count(F.lit(1)).alias("__n"))
    counted = pairs.select("pairId").join(gone, "pairId", "left").select("pairId", (F.lit(catalog.count()) - F.coalesce("__n", F.lit(0))).alias("candidates"))
    return counted.where("candidates > 0")


def search_titles(movies: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Movies whose title holds the text, whatever its case; the first `limit` by movieId."""
    return movies.where(F.lower("title").contains(text.lower())).orderBy("movieId").limit(limit)
