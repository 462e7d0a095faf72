"""What the two vector operators share: which vectors take part, and equal vectors as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import materialise


def cleaned(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of every row; x is null where a vector takes no part.

    Those are null vectors, zero vectors, those that hold null or non-finite components, and those of another width than most
    have (the greater of two equally common ones): no product with them is defined.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False))
    width = rows.where(sound).groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.withColumn("x", F.when(sound & (F.size("x") == F.lit(width.width if width else 0)), F.col("x")))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, x, copies, least), (vec_id, rep)): each different vector under a number, with its rows and their least id; and whose
    vector each row has."""
    reps = rows.groupBy("x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("rep"), "x", "copies", "least"), "vectors")
    members = materialise(rows.join(reps.select("x", "rep"), "x").select("vec_id", "rep"), "members")
    return reps, members


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def binary(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f8")], pa.binary())


def stacked(values) -> np.ndarray:
    """The matrix of rows stored as bytes."""
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
