"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of bits, the signs of its products with random directions. Sorted, the strings of a
tree are an array in which the vectors that share a prefix lie side by side; the array is dealt in buckets of the strings that
share their first bits, and sorted within. A query descends in each tree to the longest prefix that it shares with anyone, by
binary search, and then ascends in all trees at once, until the prefixes that it shares hold enough candidates. Those are scored
exactly. How near the best of them are says how far to ascend: two vectors at some angle share a prefix with a probability that
depends on the angle and the prefix's length alone, so a query stops at the longest prefixes at which a vector as near as its k-th
best would hardly have been missed by all trees. Queries with near neighbours stop after few candidates, however large the table;
those without any climb far.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolist.llm.common import Batches, materialise, record, seeded_directions
from duolist.llm.vectors import binary, cleaned, distinct_vectors, matrix, stacked

TREES = 24
LABEL_BITS = 48
#: Probability with which a vector as near as the k-th best found may have been missed by all trees.
MISS = 0.08
#: Bits that a query ascends at once, at most.
STEP = 4
BUCKET_ROWS = 1024
#: Vectors, and queries, that are scored against each other in one task's memory.
BLOCK = 4096
SEED = 11


def bucket_bits(rows: int) -> int:
    """First bits by which a tree's array is dealt: a bucket holds about BUCKET_ROWS rows where strings are even."""
    return min(LABEL_BITS, max(3, math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))


def level_for(cosine: Column, trees: int, miss: float) -> Column:
    """The longest prefixes at which a vector with this cosine is missed by all trees with a probability of at most miss."""
    together = F.lit(1.0) - F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / F.lit(math.pi)
    enough = math.log(1 - miss ** (1 / trees))
    return F.when(together <= 0, 0).when(together >= 1, LABEL_BITS).otherwise(F.least(F.floor(F.lit(enough) / F.ln(together)), F.lit(LABEL_BITS))).cast("int")


def _labels(trees: int, bits: int, longest: float):
    """(tree, bucket, label, rep, least, is_query, v): for each tree, where a vector lies; queries once more, without the added part.

    Vectors get one component more that brings all to the length of the longest, and queries a zero, so that the largest
    product is the smallest angle.
    """

    def run(batches: Batches) -> Batches:
        planes = None
        weights = 1 << np.arange(LABEL_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rep, first, asked = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if planes is None:
                planes = seeded_directions(trees * LABEL_BITS, x.shape[1] + 1, SEED)
            rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
            raw = binary(x)
            for query, of in ((False, np.arange(len(x))), (True, np.flatnonzero(asked))):
                if not len(of):
                    continue
                full = np.column_stack([x[of], np.zeros(len(of)) if query else rest[of]])
                label = ((full @ planes.T > 0).reshape(len(of), trees, LABEL_BITS) * weights).sum(axis=2)
                for t in range(trees):
                    yield record(tree=np.full(len(of), t, np.int32), bucket=label[:, t] >> (LABEL_BITS - bits), label=label[:, t], rep=rep[of], least=first[of], is_query=np.full(len(of), query), v=raw.take(pa.array(of)))

    return run


def spans(label: np.ndarray, asked: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where, in sorted strings, those begin and end that share the first `level` bits with each asked one."""
    shift = (LABEL_BITS - np.asarray(level)).astype(np.int64)
    low = (asked >> shift) << shift
    return np.searchsorted(label, low), np.searchsorted(label, low + ((np.int64(1) << shift) - 1), side="right")


def _descend(bits: int):
    """For cogrouped strings and queries of a block: how many share each prefix of `bits` bits and more with a query."""

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({"query": [], "shared": []})
        label, own = np.sort(points["label"].to_numpy()), asked["label"].to_numpy()
        counts = np.zeros((len(own), LABEL_BITS + 1), np.int64)
        for level in range(bits, LABEL_BITS + 1):
            start, end = spans(label, own, level)
            counts[:, level] = end - start
            if not counts[:, level].any():
                break  # no longer prefix is shared
        return pd.DataFrame({"query": asked["query"].to_numpy(), "shared": list(counts)})

    return run


def _best(k: int):
    """For cogrouped points and queries of a block: each query's k best among the points that share its prefix, and how many it has."""

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": [], "rep": [], "least": [], "score": [], "scored": []})
        if not len(points) or not len(asked):
            return none
        points = points.sort_values(["label", "least", "rep"])
        rep, first, x = points["rep"].to_numpy(), points["least"].to_numpy(), stacked(points["v"])
        start, end = spans(points["label"].to_numpy(), asked["label"].to_numpy(), asked["level"].to_numpy())
        query, v, out = asked["query"].to_numpy(), stacked(asked["v"]), [none]
        for i in range(0, len(asked), 256):
            a, b = start[i : i + 256], end[i : i + 256]
            low, high = int(a.min()), int(b.max())
            if (b - a).sum() * 4 > (high - low) * len(a):  # most of a stretch: as a product of matrices
                s = v[i : i + 256] @ x[low:high].T
                at = np.arange(low, high)
                s[(at < a[:, None]) | (at >= b[:, None])] = -np.inf
                floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                q, c = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                score, c = s[q, c], c + low
            else:
                q = np.repeat(np.arange(len(a)), b - a)
                c = np.arange(len(q)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", v[i + q[j : j + 32_768]], x[c[j : j + 32_768]]) for j in range(0, len(q), 32_768))])
            order = np.lexsort((first[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            top = np.arange(len(q)) - np.searchsorted(q, q) < k
            if top.any():
                out.append(pd.DataFrame({"query": query[i + q[top]], "rep": rep[c[top]], "least": first[c[top]], "score": score[top], "scored": np.where(np.searchsorted(q, q) == np.arange(len(q)), (b - a)[q], 0)[top]}))
        return pd.concat(out, ignore_index=True).astype({"query": "int64", "rep": "int64", "least": "int64", "scored": "int64"})

    return run


def search(reps: DataFrame, queries: DataFrame, k: int, trees: int = TREES, miss: float = MISS, step: int = STEP) -> DataFrame:
    """(query, rep, least, score, scored): each query's k + 1 best distinct vectors found, itself included.

    reps: rep, x, least; queries: rep, distinct. scored: of a query's rows together, how often a vector was scored for it.
    """
    n, longest = reps.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()
    bits, longest = bucket_bits(n), math.sqrt(longest or 0.0) * (1 + 1e-12)
    marked = reps.join(queries.withColumn("asked", F.lit(True)), "rep", "left").select("rep", "x", "least", F.coalesce("asked", F.lit(False)).alias("asked"))
    labelled = materialise(marked.mapInArrow(_labels(trees, bits, longest), "tree int, bucket long, label long, rep long, least long, is_query boolean, v binary"), "forest")
    points = labelled.where("not is_query").drop("is_query")
    renewed = [F.col(c).alias(c) for c in ("tree", "bucket", "label", "v")]  # else both sides of the cogroup have the same columns
    asking = labelled.where("is_query").select(*renewed, F.col("rep").alias("query"))
    sizes = points.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("points"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")
    prefixes = materialise(sizes.select("tree", "bucket", "points", levels).withColumn("prefix", F.expr(f"shiftright(bucket, {bits} - level)")), "prefixes")

    def met(sent: DataFrame, at: list[str], from_points: list[str], of, schema: str) -> DataFrame:
        """Bring queries (tree, bucket, points, query) together with the points of their buckets, in blocks of bounded size on either side."""
        loads = sent.groupBy("tree", "bucket", "points").agg(F.count(F.lit(1)).alias("queries"))
        blocks = materialise(loads.select("tree", "bucket", F.ceil(F.col("points") / BLOCK).alias("p"), F.ceil(F.col("queries") / BLOCK).alias("q")), "blocks")
        key = ["tree", "bucket", "pb", "qb"]
        here = points.join(blocks, ["tree", "bucket"]).select("tree", "bucket", *from_points, F.pmod(F.xxhash64("rep"), "p").alias("pb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"))
        there = sent.join(blocks, ["tree", "bucket"]).select("tree", "bucket", *at, F.pmod(F.xxhash64("query"), "q").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("pb"))
        return here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(of, schema)

    # the descent: how many share prefixes of each length with a query, over all trees; within buckets, and from buckets' sizes
    own = asking.drop("v").join(sizes, ["tree", "bucket"])
    below = met(own, ["label", "query"], ["label", "rep"], _descend(bits), "query long, shared array<long>")
    above = asking.select("query", "tree", "bucket", levels).where(F.col("level") < bits).withColumn("prefix", F.expr(f"shiftright(bucket, {bits} - level)"))
    above = above.join(prefixes.groupBy("tree", "level", "prefix").agg(F.sum("points").alias("n")), ["tree", "level", "prefix"]).select("query", "level", "n")
    counted = below.select("query", F.posexplode("shared").alias("level", "n")).where("n > 0").unionAll(above).groupBy("query", "level").agg(F.sum("n").alias("n"))
    enough = (F.col("n") >= F.lit(trees * (k + 1))) | (F.col("level") == 0)
    level = materialise(counted.where(enough).groupBy("query").agg(F.max("level").alias("level")), "level")

    # the ascent, all trees at once: score what shares the prefixes, then see whether shorter ones are needed
    length = materialise(reps.join(queries, "rep", "left_semi").select(F.col("rep").alias("query"), F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("length")), "lengths")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "rep")
    top = None
    while not level.isEmpty():
        placed = asking.join(level, "query").withColumn("near", F.least("level", F.lit(bits))).withColumn("prefix", F.expr(f"shiftright(bucket, {bits} - near)")).drop("bucket")
        sent = placed.join(prefixes.select("tree", F.col("level").alias("near"), "prefix", "bucket", "points"), ["tree", "near", "prefix"]).drop("near", "prefix")
        found = met(sent, ["label", "query", "level", "v"], ["label", "rep", "least", "v"], _best(k + 1), "query long, rep long, least long, score double, scored long")
        found = found if top is None else found.unionAll(top)
        pairs = found.groupBy("query", "rep", "least").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
        effort = Window.partitionBy("query")
        ranked = pairs.withColumn("all", F.sum("scored").over(effort)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
        top = materialise(ranked.select("query", "rep", "least", "score", F.when(F.col("r") == 1, F.col("all")).otherwise(F.lit(0)).alias("scored")), "top")
        last = top.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        cosine = F.when(F.col("n") > k, F.col("score") / (F.col("length") * F.lit(longest))).otherwise(F.lit(-1.0))
        wanted = level.join(last, "query", "left").join(length, "query").select("query", "level", level_for(F.coalesce(cosine, F.lit(-1.0)), trees, miss).alias("wanted"))
        level = materialise(wanted.where("wanted < level").select("query", F.greatest("wanted", F.col("level") - step).alias("level")), "level")
    return top if top is not None else labelled.limit(0).select(F.col("rep").alias("query"), "rep", "least", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("scored"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each query, by inner product, the query's own row left out.

    is_query: a condition on vec_id. Ties go to the smaller vec_id. Null vectors, zero vectors, those that hold null or non-finite
    components and those of another width than most take no part, nor do rows without an id; with fewer than k other rows all are
    returned. Rows of equal vectors are searched once and all count as rows; rows that share the query's id count as its own.
    Other columns aren't read; an empty table gives an empty table.
    """
    rows = cleaned(vectors, id_col, vector_col).where("x is not null and vec_id is not null")
    reps, members = distinct_vectors(rows)
    queries = members.where(is_query)
    top = search(reps.select("rep", "x", "least"), queries.select("rep").distinct(), k, trees, miss)
    # the rows that hold the best distinct vectors
    first = Window.partitionBy("rep").orderBy("vec_id")
    holders = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    listed = queries.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(top.select("query", "rep", "score"), "query").join(holders, "rep").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
