"""Tables in buckets: rows dealt by a key once, when they are written, so that later joins and groupings by it need no shuffle."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

from duolist.schema import shared_folder

#: Rows of a bucket.
BUCKET_ROWS = 2_000_000


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two, so that tables of different sizes still fit together: buckets of one are whole numbers of the other's."""
    return 2 ** max(0, math.ceil(math.log2(max(1, rows / bucket_rows))))


def bucketed_table(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Write df below the shared folder in sorted buckets by a key, and read it back; buckets: as many as its rows ask for, if None.

    Joins of two such tables on the key, and groupings whose keys hold it, read buckets side by side. What shares a key lies in one
    bucket, so a key with very many rows makes a large one: use it for users and movies, whose rows are bounded by the other side.
    """
    own = f"{name}_{uuid.uuid4().hex}"
    count = buckets or bucket_count(df.count())
    df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key).option("path", f"{shared_folder(df.sparkSession)}/{own}").saveAsTable(own)
    return df.sparkSession.table(own)


def drop_bucketed(spark: SparkSession, df: DataFrame) -> None:
    """Forget a table of bucketed_table() and delete its files; nothing may read it afterwards."""
    from duolist.schema import drop_table

    name = next(t.name for t in spark.catalog.listTables() if t.name and df.inputFiles() and t.name in df.inputFiles()[0])
    drop_table(df)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
