"""Writers, content digests and frozen inputs."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; a path that exists is an error unless overwrite is set."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv_gzip(df: DataFrame, path: str) -> None:
    """Compressed CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one plain CSV file with a header, below the folder path."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv or write_csv_gzip wrote; of the file's columns those that the schema names, in its order."""
    wanted = spark.createDataFrame([], schema).schema
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))


def write_json(payload: dict, path: str | Path) -> None:
    """A small report by the driver: indented, UTF-8, with a line end."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def content_digest(df: DataFrame) -> DataFrame:
    """One row (rows, bits, total) that depends on the rows alone, not on their order or files."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("bits"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"))


def digest_tree(df: DataFrame, buckets: int = 4096, key: list[str] | None = None) -> DataFrame:
    """(bucket, rows, bits, total): a digest of the rows that fall into each bucket by a hash of the key columns (all, if none).

    What falls into a bucket doesn't depend on order or files, so two versions of a table are compared bucket by bucket.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    at = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in key or df.columns)), F.lit(buckets)).cast("int")
    h = F.xxhash64(*columns)
    return df.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("bits"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))


def tree_root(tree: DataFrame) -> str:
    """One digest of all buckets, which are at most as many as digest_tree() was asked for."""
    rows = sorted(map(tuple, tree.select("bucket", "rows", "bits", "total").collect()))
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def changed_buckets(before: DataFrame, after: DataFrame) -> list[int]:
    """Buckets whose digests differ between two trees of as many buckets."""
    both = before.select("bucket", F.struct("rows", "bits", "total").alias("a")).join(after.select("bucket", F.struct("rows", "bits", "total").alias("b")), "bucket", "full")
    return sorted(r.bucket for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())


def changed_rows(before: DataFrame, after: DataFrame, buckets: int = 4096, key: list[str] | None = None) -> DataFrame:
    """(side, ...): rows that only one of two versions of a table holds; only those of buckets whose digests differ are compared."""
    own = changed_buckets(digest_tree(before, buckets, key), digest_tree(after, buckets, key))
    at = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in key or before.columns)), F.lit(buckets)).cast("int")
    a, b = (df.where(at.isin(own)) if own else df.limit(0) for df in (before, after.select(*(f"`{c}`" for c in before.columns))))
    return a.exceptAll(b).select(F.lit("before").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("after").alias("side"), "*"))


def freeze(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Digest of each table, for a manifest."""
    return {n: content_digest(df).first().asDict() for n, df in tables.items()}


def verify_frozen(tables: dict[str, DataFrame], manifest: dict[str, dict]) -> None:
    """ValueError that names the tables whose content has changed."""
    if changed := [n for n, d in manifest.items() if content_digest(tables[n]).first().asDict() != d]:
        raise ValueError(f"changed: {', '.join(changed)}")


def claim(spark: SparkSession, path: str, note: str) -> None:
    """Create a small file at path, which must not exist: FileExistsError if it does, whoever made it, however short ago.

    On a local file system the file is created by the operating system in one step, which only one caller can win. Other file
    systems get a create that must not overwrite, which HDFS makes in one step too; what a store does that can't is its own.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    if fs.getScheme() == "file":
        with open(where.toUri().getPath(), "x", encoding="utf-8") as f:
            f.write(note)
        return
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(note.encode()))
    out.close()


def save_model(parts: dict[str, DataFrame], settings: dict, path: str) -> None:
    """A model is a folder of tables and a small table with its settings."""
    for n, df in parts.items():
        write_table(df, f"{path}/{n}")
    spark = next(iter(parts.values())).sparkSession
    write_table(spark.createDataFrame([(json.dumps(settings, default=str),)], "settings string"), f"{path}/settings")


def load_model(spark: SparkSession, path: str, parts: list[str]) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in parts}, json.loads(spark.read.parquet(f"{path}/settings").first().settings)
