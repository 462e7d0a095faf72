"""Hard negatives by rotated one-bit codes.

Vectors are made integers first. Random rotations, stacked, carry each to a longer vector of the same length, of which only the signs
are kept: its code, one bit a component. The code stands for a direction, and with it is stored how far the vector reaches along
that direction (its alignment) and what is left beside it (its residual). An anchor's product with a code's direction is estimated
by counting bits of the code under bit planes of the rotated anchor; by how much rounding the anchor to bit planes can change that
is known exactly. A score is the alignment times that product, plus the residual's product with what the anchor has beside the
direction, which the inequality of Cauchy and Schwarz bounds. So each score lies in an interval that never fails. Where the interval
can't reach the best found so far, or the range of scores asked for, the row is left out; all others get their integer score.

Rows and anchors meet in blocks of bounded size on either side, so no key holds more than one block. What a block gives are the
best few of each anchor, which are merged; nothing else is shuffled back.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duolist.llm.common import Batches, materialise, record
from duolist.llm.vectors import matrix

#: Bits of a code per component, and bits to which a rotated anchor is rounded.
ROTATIONS, PLANES = 4, 6
#: Rows and anchors of a block; rows and anchors whose intervals are in memory at once.
ROWS, ANCHORS, AT_ONCE, ASKED = 8192, 8192, 1024, 256
SCALE = 256
SEED = 17


@lru_cache(maxsize=4)
def rotations(width: int, count: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """count random rotations on top of each other, scaled so that lengths stay; as many rows as whole 64-bit words hold."""
    rng = np.random.Generator(np.random.PCG64(seed))
    count = math.ceil(count * width / 64) * 64 / width
    turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(math.ceil(count))]
    rows = round(count * width)
    return np.concatenate(turns)[:rows] / math.sqrt(count)


class Codes:
    """Codes of rows: words of 64 bits, alignment, residual, and the length of the code's direction before it was made 1."""

    def __init__(self, z: np.ndarray, turn: np.ndarray):
        bits = z @ turn.T > 0
        self.words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        direction = (np.where(bits, 1.0, -1.0) @ turn) / math.sqrt(len(turn))
        self.length = np.linalg.norm(direction, axis=1)
        self.align = np.einsum("ij,ij->i", z, direction) / np.maximum(self.length, 1e-300)
        self.residual = np.sqrt(np.maximum(np.einsum("ij,ij->i", z, z) - self.align**2, 0))


class Anchors:
    """Anchors' rotated vectors as bit planes, and how much rounding them may change a product with a code."""

    def __init__(self, q: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        r = q @ turn.T
        low, high = r.min(axis=1, keepdims=True), r.max(axis=1, keepdims=True)
        step = np.maximum((high - low) / (2**planes - 1), 1e-300)
        n = np.rint((r - low) / step).astype(np.uint8 if planes <= 8 else np.uint32)
        rounded = low + step * n
        self.root = math.sqrt(len(turn))
        self.low, self.step, self.sum = low[:, 0], step[:, 0], rounded.sum(axis=1)
        self.off = np.abs(r - rounded).sum(axis=1) / self.root
        self.planes = [np.packbits((n >> j & 1).astype(bool), axis=1, bitorder="little").view("<u8") for j in range(planes)]
        self.square = np.einsum("ij,ij->i", q, q)

    def intervals(self, at: slice, words: np.ndarray, align: np.ndarray, residual: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of the anchors at a slice with each row."""
        ones = np.bitwise_count(words).sum(axis=1)
        weighed = np.zeros((len(self.low[at]), len(words)), np.uint32)
        for j, plane in enumerate(self.planes):
            count = np.zeros(weighed.shape, np.uint16)
            for w in range(words.shape[1]):
                count += np.bitwise_count(plane[at, w][:, None] & words[:, w][None, :])
            weighed += count.astype(np.uint32) << np.uint32(j)
        # the product of a code's +1 and -1 with the rounded anchor: twice what lies under ones, less all
        product = 2 * (self.low[at, None] * ones + self.step[at, None] * weighed) - self.sum[at, None]
        along = product / self.root / np.maximum(length, 1e-300)
        off = self.off[at, None] / np.maximum(length, 1e-300)
        beside = np.sqrt(np.maximum(self.square[at, None] - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        middle, reach = along * align, off * align + residual * beside
        reach += 1e-9 * (1 + np.sqrt(self.square[at, None]) * np.hypot(align, residual))  # what floating-point sums may be off
        return middle - reach, middle + reach


def integer_scores(q: np.ndarray, z: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact products of q[rows] and z[columns], both integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(z).max(initial=0)) * q.shape[1]
    exact = largest < 2**53  # sums of floating-point numbers are exact as far as that
    if exact and len(rows) * 5 > len(q) * len(z):
        return (q.astype(float) @ z.astype(float).T)[rows, columns].astype(np.int64)
    out, kind = np.empty(len(rows), np.int64), float if exact else np.int64
    for i in range(0, len(rows), 32_768):
        out[i : i + 32_768] = np.einsum("ij,ij->i", q[rows[i : i + 32_768]].astype(kind), z[columns[i : i + 32_768]].astype(kind))
    return out


class Best:
    """The k best (score, id) of each slot, highest scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.worst = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.zeros(len(self.worst), bool)
        touched[slot] = True
        old = touched[self.slot]
        slot, score, ids = (np.concatenate([a[old], b]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        top = place < self.k
        full = place == self.k - 1
        self.worst[slot[full]] = score[full]
        self.slot, self.score, self.id = (np.concatenate([a[~old], b[top]]) for a, b in ((self.slot, slot), (self.score, score), (self.id, ids)))


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; what can't reach it doesn't belong to the best k."""
    return np.partition(x, -k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _unpacked(points: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    z = np.frombuffer(b"".join(points["z"]), "<i4").reshape(len(points), -1)
    return z, np.frombuffer(b"".join(points["code"]), "<u8").reshape(len(points), -1)


def _positives(k: int, width: int, count: int):
    """For cogrouped rows and anchors of a block: each anchor's k best rows of its own label."""

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": [], "id": [], "score": []})
        if not len(points) or not len(asked):
            return none
        turn = rotations(width, count)
        points, asked = points.sort_values("label", kind="stable"), asked.sort_values("label", kind="stable")
        z, words = _unpacked(points)
        align, residual, length, ids, label = (points[c].to_numpy() for c in ("align", "residual", "length", "vec_id", "label"))
        q, own, own_label = np.frombuffer(b"".join(asked["z"]), "<i4").reshape(len(asked), -1), asked["vec_id"].to_numpy(), asked["label"].to_numpy()
        anchors, best = Anchors(q.astype(float), turn), Best(len(asked), k)
        for start in range(0, len(asked), ASKED):
            stop = min(start + ASKED, len(asked))
            for one in np.unique(own_label[start:stop]):
                at = slice(start + int(np.searchsorted(own_label[start:stop], one)), start + int(np.searchsorted(own_label[start:stop], one, side="right")))
                low, high = np.searchsorted(label, one), np.searchsorted(label, one, side="right")
                for i in range(low, high, AT_ONCE):
                    to = slice(i, min(i + AT_ONCE, high))
                    least, most = anchors.intervals(at, words[to], align[to], residual[to], length[to])
                    other = own[at][:, None] != ids[to][None, :]
                    floor = np.maximum(best.worst[at], _kth_largest(np.where(other, least, -np.inf), k))
                    r, c = np.nonzero((most >= floor[:, None]) & other)
                    best.add(at.start + r, integer_scores(q[at], z[to], r, c), ids[to][c])
        return pd.DataFrame({"anchor": asked["anchor"].to_numpy()[best.slot], "id": best.id, "score": best.score})

    return run


def _negatives(k: int, width: int, count: int):
    """For cogrouped rows and anchors of a block: the k best rows of another label in the range of each positive."""

    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": [], "slot": [], "id": [], "score": []})
        if not len(points) or not len(asked):
            return none
        turn = rotations(width, count)
        asked = asked.reset_index(drop=True)
        z, words = _unpacked(points)
        align, residual, length, ids, label = (points[c].to_numpy() for c in ("align", "residual", "length", "vec_id", "label"))
        q, own, own_label = np.frombuffer(b"".join(asked["z"]), "<i4").reshape(len(asked), -1), asked["vec_id"].to_numpy(), asked["label"].to_numpy()
        slots = max(map(len, asked["low"]))
        low, high = np.full((len(asked), slots), 1, np.int64), np.full((len(asked), slots), 0, np.int64)  # what isn't there has an empty range
        for i, (a, b) in enumerate(zip(asked["low"], asked["high"], strict=True)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        empty = low > high
        anchors, best = Anchors(q.astype(float), turn), Best(len(asked) * slots, k)
        for start in range(0, len(asked), ASKED):
            at = slice(start, min(start + ASKED, len(asked)))
            for i in range(0, len(points), AT_ONCE):
                to = slice(i, min(i + AT_ONCE, len(points)))
                least, most = anchors.intervals(at, words[to], align[to], residual[to], length[to])
                other = (own_label[at][:, None] != label[to][None, :]) & (own[at][:, None] != ids[to][None, :])
                floor = np.where(empty[at], np.inf, np.maximum(low[at], best.worst.reshape(-1, slots)[at])).min(axis=1)
                ceiling = np.where(empty[at], -np.inf, high[at]).max(axis=1)
                r, c = np.nonzero((most >= floor[:, None]) & (least <= ceiling[:, None]) & other)
                score, here = integer_scores(q[at], z[to], r, c), ids[to][c]
                for s in range(slots):
                    fits = (score >= low[start + r, s]) & (score <= high[start + r, s]) & (score >= best.worst[(start + r) * slots + s])
                    best.add((start + r[fits]) * slots + s, score[fits], here[fits])
        at, slot = np.divmod(best.slot, slots)
        return pd.DataFrame({"anchor": asked["anchor"].to_numpy()[at], "slot": slot, "id": best.id, "score": best.score})

    return run


def integer_rows(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """((vec_id, label, z), width): the rows that take part, each component x as floor(scale * x)."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("x") > 0))
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = width.width if width else 1
    largest = math.isqrt(2**63 // (100 * width)) - 1  # then a hundred times any score is a 64-bit integer
    fits = (F.size("x") == width) & F.forall("x", lambda v: F.abs(F.floor(v * scale).cast("double")) <= float(min(largest, 2**31 - 2)))
    return rows.where(fits).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("z")), width


def _coded(width: int, count: int):
    def run(batches: Batches) -> Batches:
        turn = rotations(width, count)
        for batch in batches:
            if batch.num_rows:
                z = matrix(batch.column(2)).astype("<i4")
                codes = Codes(z.astype(float), turn)
                raw = [pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary()) for x in (z, codes.words)]
                yield record(vec_id=batch.column(0), label=batch.column(1), z=raw[0], code=raw[1], align=codes.align, residual=codes.residual, length=codes.length)

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = SCALE, count: int = ROTATIONS, rows: int = ROWS, anchors: int = ANCHORS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    Scores are inner products of vectors whose components are floor(scale * x). is_anchor: a condition on vec_id and label. An
    anchor's positives are its best other rows of the same label; a positive's negatives are the anchor's best rows of another
    label whose score lies between `least` and `most` hundredths of the positive's. Ties go to the smaller id. All of it is exact.

    Null ids, labels or vectors, vectors without components or with null or non-finite ones, those of another width than most,
    and those so long that a hundred times a score could pass 64 bits take no part; zero vectors do. Rows that share an anchor's
    id count as its own; other repeated rows count as often as they come, repeated anchors too. A positive without negatives in
    its range gives no row, nor does an anchor without positives. Other columns aren't read; an empty table gives an empty table.
    """
    clean, width = integer_rows(vectors, scale, id_col, vector_col, label_col)
    schema = "vec_id long, label long, z binary, code binary, align double, residual double, length double"
    coded = materialise(clean.mapInArrow(_coded(width, count), schema).withColumn("row", F.monotonically_increasing_id()), "codes")
    asking = coded.where(is_anchor).select(F.col("row").alias("anchor"), "vec_id", "label", "z")
    n, m = coded.count(), asking.count()
    parts, aparts = max(1, math.ceil(n / rows)), max(1, math.ceil(m / anchors))

    def every(size: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))

    key = ["part", "apart"]
    points = coded.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("apart", every(aparts)).drop("row")

    def met(asked: DataFrame, of, schema: str) -> DataFrame:
        dealt = asked.withColumn("apart", F.pmod(F.xxhash64("anchor"), F.lit(aparts)).cast("int")).withColumn("part", every(parts))
        return points.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(of, schema)

    near = met(asking.select(*(F.col(c).alias(c) for c in asking.columns)), _positives(positives, width, count), "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    # the range of each positive in integers: least * p <= 100 * s <= most * p
    low, high = F.expr(f"-((-{least} * score) - pmod(-{least} * score, 100)) div 100"), F.expr(f"({most} * score - pmod({most} * score, 100)) div 100")
    listed = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("r", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")))).alias("p"))
    wanted = materialise(asking.join(listed, "anchor"), "positives")  # a few positives each
    found = met(wanted.select("anchor", "vec_id", "label", "z", F.col("p.low").alias("low"), F.col("p.high").alias("high")), _negatives(negatives, width, count), "anchor long, slot long, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = wanted.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("slot", "p")).withColumn("slot", F.col("slot").cast("long"))
    return top.join(of, ["anchor", "slot"]).select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
