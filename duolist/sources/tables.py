"""Readers: the four rating tables, the demonstration view over the driver's tables, small caches."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duolist.config import PrepConfig
from duolist.operators import cohorts, pairs, ranking
from duolist.schema import TABLES, assert_unique, shared_table, without_nan


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, str]:
    """Paths of the four tables; FileNotFoundError that names all that are absent."""
    paths = {n: f"{folder.rstrip('/')}/{n}{suffix}" for n in TABLES}
    if missing := [p for p in paths.values() if not exists(spark, p)]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    return paths


def load_table(spark: SparkSession, folder: str, name: str, suffix: str = ".csv") -> DataFrame:
    """One of the four tables, with its declared schema; quotes inside quoted titles are doubled."""
    path = f"{folder.rstrip('/')}/{name}{suffix}"
    if suffix == ".parquet":
        return without_nan(spark.read.schema(TABLES[name]).parquet(path))
    return without_nan(spark.read.schema(TABLES[name]).option("header", True).option("escape", '"').csv(path))


def load_all(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, DataFrame]:
    require_tables(spark, folder, suffix)
    return {n: load_table(spark, folder, n, suffix) for n in TABLES}


def focus_ratings(ratings: DataFrame, users: DataFrame, before: int | None = None) -> DataFrame:
    """Ratings of chosen users, earlier than a second if one is given; the time filter reaches the scan."""
    rows = ratings if before is None else ratings.where(F.col("timestamp") < before)
    return rows.join(users.select("userId"), "userId", "left_semi")


def poster_cache(spark: SparkSession, path: str) -> DataFrame:
    """(movieId, url) of a JSON object from ids to addresses; keys that aren't numbers and addresses without https go."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "url"))
    return rows.where(r"k rlike '^\\d+$' and url like 'https://%'").select(F.col("k").cast("long").alias("movieId"), "url")


def preview_image(html: Column | str) -> Column:
    """Address in the first og:image meta tag of a page, whatever the order of its attributes; null if there is none."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)(<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""), 1)
    named = F.filter(tags, lambda t: t.rlike(r"""(?is)\bproperty\s*=\s*["']?og:image["'\s/>]"""))
    return F.nullif(F.regexp_extract(F.try_element_at(named, F.lit(1)), r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def titled(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """A session's ratings with titles and the time of rating, all of them, known movies or not."""
    return ratings.join(movies.select("movieId", "title"), "movieId", "left").select("movieId", "title", "rating", F.timestamp_seconds("timestamp").alias("ratedAt"))


def catalogue_bundle(movies: DataFrame, links: DataFrame, catalog: DataFrame, n: int = 36) -> tuple[DataFrame, DataFrame]:
    """(all movies with tmdbId, queue to rate): n starters, then the rest of the catalogue by popularity."""
    assert_unique(movies, ["movieId"], "movies")
    assert_unique(links, ["movieId"], "links")
    return movies.join(links.select("movieId", "tmdbId"), "movieId", "left"), rating_queue(movies, links, ranking.onboarding_movies(movies, catalog, n), catalog)


def rating_queue(movies: DataFrame, links: DataFrame, starters: DataFrame, catalog: DataFrame) -> DataFrame:
    """(movieId, title, tmdbId, queue, position): starters first, then the catalogue by popularity; the first mention counts."""
    first = starters.select("movieId", F.lit(0).alias("queue"), F.col("onboardingOrder").cast("long").alias("position"))
    then = catalog.select("movieId", F.lit(1).alias("queue"), (-F.col("trainPositiveCount")).alias("position"))
    best = first.unionByName(then).groupBy("movieId").agg(F.min(F.struct("queue", "position")).alias("at"))
    return best.select("movieId", "at.queue", "at.position").join(movies.select("movieId", "title"), "movieId").join(links.select("movieId", "tmdbId"), "movieId", "left").select("movieId", "title", "tmdbId", "queue", "position")


#: Lines that a task sums up; a line takes some 500 bytes of the hash tables there.
LINES_AT_ONCE = 1_000_000
#: Stands for the time of a line without one, before all others.
NEVER = -(2**62)
#: Thresholds that suit the driver's tables, whose users have few ratings.
DEMO = PrepConfig(train_end="2000-01-01", validation_end="2000-11-01", evaluation_min_train_ratings=10, evaluation_min_train_positives=3, evaluation_min_validation_positives=1, evaluation_min_test_positives=1, pair_min_co_rated=3)


def many_parts(spark: SparkSession, rows: int, at_once: int = LINES_AT_ONCE) -> int | None:
    """Parts of at_once rows each; None for so few rows that the usual partitions are no larger."""
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return -(-rows // at_once) if rows > usual * at_once else None


class DemoTables:
    """Ratings, movies and what follows from them, seen in the driver's order tables. All are lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: PrepConfig = DEMO):
        self.spark, self.dir, self.config = spark, sf_dir, config

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ratings(self) -> DataFrame:
        """A line of an order is a rating: its customer rates its part by quantity; of several the latest counts."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
        parts = many_parts(self.spark, self.table("lineitem").count())
        raw = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("movieId"), F.coalesce(seconds, F.lit(NEVER)).alias("t"), (F.ceil(F.col("l_quantity") / 5).cast("double") / 2).alias("rating"))
        # few lines share a user and a part, so they meet before they are summed up; numbers alone are hashed, where structs are sorted;
        # dealt by how many lines there are, as the usual number of tasks doesn't grow with the table
        dealt = raw.repartition(parts, "userId", "movieId") if parts else raw.repartition("userId", "movieId")
        each = dealt.groupBy("userId", "movieId", "t").agg(F.max("rating").alias("rating"))
        last = each.groupBy("userId", "movieId").agg(F.max_by("rating", "t").alias("rating"), F.max("t").alias("t"))
        return last.select("userId", "movieId", "rating", F.when(F.col("t") != NEVER, F.col("t")).alias("timestamp"))

    @cached_property
    def movies(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("genres"))

    @cached_property
    def split(self) -> DataFrame:
        return cohorts.add_temporal_split(self.ratings, self.config)

    @cached_property
    def kept(self) -> DataFrame:
        """The same, written once for queries that look at it several times: else each look would join orders and lines anew."""
        return shared_table(self.split, "split")

    @cached_property
    def statistics(self) -> DataFrame:
        return cohorts.user_split_statistics(self.__dict__.get("kept", self.split))

    @cached_property
    def training_users(self) -> DataFrame:
        return cohorts.training_users(self.statistics, self.config)

    @cached_property
    def evaluation_users(self) -> DataFrame:
        return cohorts.evaluation_users(self.statistics, self.config)

    @cached_property
    def edges(self) -> DataFrame:
        kept = self.kept
        return cohorts.training_edges(kept, self.training_users)

    @cached_property
    def catalog(self) -> DataFrame:
        return shared_table(cohorts.warm_catalog(self.edges, self.config), "catalog")

    @cached_property
    def warm_edges(self) -> DataFrame:
        return cohorts.edges_of_catalog(self.edges, self.catalog)

    @cached_property
    def pairs(self) -> DataFrame:
        """Users of the evaluation cohort, two by two."""
        self.kept  # noqa: B018  what follows looks at it too
        return pairs.consecutive_pairs(self.evaluation_users)

    @cached_property
    def members(self) -> DataFrame:
        return cohorts.pair_members(self.pairs).select("userId").distinct()

    @cached_property
    def train(self) -> DataFrame:
        return self.kept.where("split = 'train'")

    @cached_property
    def seen(self) -> DataFrame:
        return shared_table(cohorts.seen_items(self.kept, self.members), "seen")

    @cached_property
    def test_events(self) -> DataFrame:
        return cohorts.positive_events(self.kept, "test", self.members)
