"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of their products with a random direction; vectors close to a split
go to both sides. Trees are fitted on a bounded sample, all vectors are routed through all trees, and those that meet in a leaf
are compared exactly. There are as many trees as keep the share of missed pairs constant. A pair that meets in several leaves counts in the first of them only, so links are counted without
listing pairs; leaves give links that span their components, and these are united.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import Batches, materialise, record, seeded_directions
from duolist.llm.components import connected_components
from duolist.llm.vectors import binary, cleaned, distinct_vectors, matrix, stacked

#: Trees at least; deeper ones are more, see trees_for().
TREES = 12
#: Share of pairs at a cosine of 0.9 that one split leaves together, spill included (measured 0.925), and of those that no tree may keep together.
TOGETHER, MISSED = 0.92, 1e-5
#: Vectors that the trees are fitted on, those with the least hash of their id.
FIT_ROWS = 32_768
#: Bytes of those vectors, at most; wide vectors have fewer.
FIT_BYTES = 64 << 20
#: Vectors that are routed through a tree at a time: its directions are made anew for each such block.
ROUTE_ROWS = 4096
LEAF_ROWS = 256
#: Share of the vectors on either side of a split that go to both.
SPILL = 0.04
SIMILARITY = 0.9
#: Vectors of a leaf that are compared with as many others in one task's memory.
BLOCK = 2048
SEED = 13


def depth_for(rows: int, fitted: int, leaf_rows: int = LEAF_ROWS) -> int:
    """As deep as the rows need, but no deeper than the sample has 16 vectors a leaf."""
    return max(0, min(math.ceil(math.log2(max(1, rows / leaf_rows))), int(math.log2(max(1, fitted / 16)))))


def trees_for(depth: int, least: int = TREES) -> int:
    """Trees with which the share of missed pairs at the threshold stays the same however deep they are."""
    return max(least, math.ceil(math.log(MISSED) / math.log(1 - TOGETHER**depth)) if depth else least)


def directions_of(tree: int, nodes: int, width: int) -> np.ndarray:
    """Directions of a tree's nodes; they follow from its number, so they need not be sent around."""
    return seeded_directions(nodes, width, SEED + tree) if nodes else np.empty((0, width))


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree: the bounds at each node between which a vector goes to both sides. Nodes are numbered as in a heap from 0."""
    depth, out = depth_for(rows, len(sample), leaf_rows), []
    for t in range(trees):
        nodes = 2**depth - 1
        direction = directions_of(t, nodes, sample.shape[1])
        low, high = np.zeros(nodes), np.zeros(nodes)
        inside = [np.arange(len(sample))]
        for node in range(nodes):
            own = inside[node]
            p = sample[own] @ direction[node]
            low[node], middle, high[node] = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill]) if len(p) else (0, 0, 0)
            inside += [own[p <= middle], own[p > middle]]
            inside[node] = None
        out.append((low, high))
    return out


def route(forest: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """The leaves, over all trees and in ascending order, in which each vector lies."""
    rows, leaves, base = [], [], 0
    for tree, (low, high) in enumerate(forest):
        direction = directions_of(tree, len(low), x.shape[1])
        own, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        inner = len(low)
        while len(node) and inner and node[0] < inner:  # all are on one level
            p = np.einsum("ij,ij->i", x[own], direction[node])
            left, right = p <= high[node], p > low[node]
            own, node = np.concatenate([own[left], own[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        rows.append(own)
        leaves.append(node - inner + base)
        base += inner + 1
    rows, leaves = np.concatenate(rows), np.concatenate(leaves)
    order = np.lexsort((leaves, rows))
    return np.split(leaves[order], np.searchsorted(rows[order], np.arange(1, len(x))))


def _route(forest):
    def run(batches: Batches) -> Batches:
        trees, held, n = forest.value, [], 0

        def routed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            x = matrix(rows.column(1).chunk(0))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            return record(rep=rows.column(0).chunk(0), copies=rows.column(2).chunk(0), v=binary(x), leaves=pa.array(route(trees, x), pa.list_(pa.int64())))

        for batch in batches:
            for i in range(0, batch.num_rows, ROUTE_ROWS):
                held.append(batch.slice(i, ROUTE_ROWS))
                n += held[-1].num_rows
                if n >= ROUTE_ROWS:
                    yield routed(held)
                    held, n = [], 0
        if held:
            yield routed(held)

    return run


def _padded(leaves: pd.Series, fill: int) -> np.ndarray:
    out = np.full((len(leaves), max(map(len, leaves))), fill, np.int64)
    for i, x in enumerate(leaves):
        out[i, : len(x)] = x
    return out


def _compare(least: float):
    """Links within a block of a leaf: for each vector how many rows it links to here first, and a vector of its component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leaf, low, high = int(frame["leaf"].iloc[0]), int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        frame = frame.sort_values("rep")
        rep, copies, part, x = frame["rep"].to_numpy(), frame["copies"].to_numpy(), frame["part"].to_numpy(), stacked(frame["v"])
        a, b = np.flatnonzero(part == low), np.flatnonzero(part == high)
        own, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        left, right = _padded(frame["leaves"], -1), _padded(frame["leaves"], -2)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(a), 512):
            r, c = np.nonzero(x[a[i : i + 512]] @ x[b].T >= least)
            r, c = a[i : i + 512][r], b[c]
            ok = r < c if low == high else r != c
            r, c = r[ok], c[ok]
            near.append((r, c))
            for j in range(0, len(r), 1024):
                u, v = r[j : j + 1024], c[j : j + 1024]
                earlier = ((left[u][:, :, None] == right[v][:, None, :]) & (left[u] < leaf)[:, :, None]).any(axis=(1, 2))
                np.add.at(own, u[~earlier], copies[v[~earlier]])
                np.add.at(own, v[~earlier], copies[u[~earlier]])
        r, c = (np.concatenate([p[i] for p in near]) for i in (0, 1)) if near else (a[:0], a[:0])
        while True:
            less = label.copy()
            np.minimum.at(less, r, label[c])
            np.minimum.at(less, c, label[r])
            less = less[less]
            if (less == label).all():
                break
            label = less
        linked = np.zeros(len(rep), bool)
        linked[r] = linked[c] = True
        return pd.DataFrame({"rep": rep[linked], "links": own[linked], "other": rep[label[linked]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = SIMILARITY, trees: int = TREES, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Links: pairs found with a cosine of at least `least`; n_links counts the other rows linked directly; component_id is the
    least vec_id reachable, itself included; kept marks it. Null vectors, zero vectors and those that hold null or non-finite
    components link with nothing and stand alone, as do vectors of another width than most. Rows with equal vectors link to each
    other; a repeated row counts as often as it comes, and rows that share an id are judged each by its own vector. A row without
    an id links like any other, but names a component only where nothing else is in it (then null). Other columns aren't read; an
    empty table gives an empty table.
    """
    rows = materialise(cleaned(vectors, id_col, vector_col), "all-vectors")
    reps, members = distinct_vectors(rows.where("x is not null"))
    n, width = reps.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    fit_rows = max(1, min(fit_rows, FIT_BYTES // (8 * (width or 1))))
    sample = reps.select("x").orderBy(F.xxhash64("x"), "rep").limit(fit_rows).toArrow().column("x").combine_chunks()  # bounded in rows and bytes
    sample = matrix(sample).copy() if len(sample) else np.empty((0, 1))
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    trees = trees_for(depth_for(n, len(sample), leaf_rows), trees)
    forest = reps.sparkSession.sparkContext.broadcast(fit_forest(sample, n, trees, leaf_rows))  # two numbers a node, fit_rows / 16 nodes a tree at most
    routed = materialise(reps.select("rep", "x", "copies").mapInArrow(_route(forest), "rep long, copies long, v binary, leaves array<long>"), "leaves")
    within = routed.select("rep", "copies", "v", "leaves", F.explode("leaves").alias("leaf"))
    parts = within.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    cut = within.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("rep"), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = cut.select("leaf", "rep", "copies", "v", "leaves", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
    met = materialise(blocks.groupBy("leaf", "low", "high").applyInPandas(_compare(least), "rep long, links long, other long"), "vector-links")
    roots = connected_components(met.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.select("rep", "copies", "least").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = of_rep.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"), "least")
    component = of_rep.groupBy("root").agg(F.min("least").alias("component_id"))
    known = members.join(of_rep.join(component, "root").select("rep", "n_links", "component_id"), "rep").select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
