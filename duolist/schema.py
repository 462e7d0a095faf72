"""Table schemas and checks at function entry."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType([T.StructField("userId", T.IntegerType()), T.StructField("movieId", T.IntegerType()), T.StructField("rating", T.FloatType()), T.StructField("timestamp", T.LongType())])
MOVIES = T.StructType([T.StructField("movieId", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType())])
LINKS = T.StructType([T.StructField("movieId", T.IntegerType()), T.StructField("imdbId", T.LongType()), T.StructField("tmdbId", T.LongType())])
TAGS = T.StructType([T.StructField("userId", T.IntegerType()), T.StructField("movieId", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("timestamp", T.LongType())])
#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TABLES = {"ratings": RATINGS, "movies": MOVIES, "links": LINKS, "tags": TAGS}


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    """ValueError that names the columns which df lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")


def assert_unique(df: DataFrame, keys: list[str], name: str) -> None:
    """ValueError if any key comes twice."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{name} has repeated {', '.join(keys)}")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns: in comparisons NaN would count as the greatest number."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder on a local master and an error on a cluster, whose executors
    couldn't see one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="duolist-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run within has Spark delete its shuffle files as soon as it has ended; a table that was written needs them no more."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back: cuts the lineage of loops and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that shared_table() wrote; nothing may read it afterwards."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def dense_index(df: DataFrame, order: list[str], as_name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order of some columns, without a sort in one task.

    Rows are dealt by range and sorted where they lie; each row's place follows from its place in its partition and from how
    many rows the earlier partitions have, of which there is one count per partition.
    """
    placed = shared_table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "indexed")
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, starts = 0, []
    for p, n in sorted(sizes):
        starts.append((p, before))
        before += n
    first = df.sparkSession.createDataFrame(starts, "__p long, __first long")
    return placed.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(first), "__p").withColumn(as_name, F.col("__first") + F.col("__at").bitwiseAND(F.lit(2**33 - 1))).drop("__p", "__first", "__at")
