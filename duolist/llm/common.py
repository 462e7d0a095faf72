"""What the operators of this package share: scratch tables, text access and small Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolist.schema import shuffles_cleaned

Batches = Iterator[pa.RecordBatch]
#: Bits (8 MB) of the map that maybe_listed broadcasts, whatever the length of the list.
LISTED_BITS = 2**26


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset: a temporary one on a local master, an error on a cluster, whose executors couldn't see one.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="duolist-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table that materialise() made; nothing may read it afterwards."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names made from some names that don't clash with given columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def maybe_listed(df: DataFrame, listed: DataFrame, on: list[str], flag: str) -> DataFrame:
    """df with a column that is false only for rows whose key `on` isn't in listed, so that others needn't be shuffled to it.

    A bit map of fixed size is broadcast; a list of very many keys fills it, which changes no result.
    """
    slot, bucket, bits = fresh([*df.columns, flag], "slot", "bucket", "bits")
    at, low = F.pmod(F.xxhash64(*on), F.lit(LISTED_BITS)), F.col(slot).bitwiseAND(F.lit(32767))
    made = listed.select(at.alias(slot)).groupBy(F.shiftright(slot, 15).alias(bucket)).agg(F.bitmap_construct_agg(low).alias(bits))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(low, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col(slot).bitwiseAND(F.lit(7)).cast("int")) == 1
    told = df.withColumn(slot, at).withColumn(bucket, F.shiftright(slot, 15)).join(F.broadcast(made), bucket, "left")
    return told.withColumn(flag, F.coalesce(bit, F.lit(False))).drop(slot, bucket, bits)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text as str; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once a task and applied batch by batch."""

    def run(batches: Batches) -> Batches:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def record(**columns: object) -> pa.RecordBatch:
    """A record batch from arrays, NumPy arrays or lists."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


def ids_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id"))


def seeded_directions(count: int, width: int, seed: int) -> np.ndarray:
    """count random unit vectors, the same for the same seed on every machine."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = rng.standard_normal((count, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)
