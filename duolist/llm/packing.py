"""Packing token sequences by minimum bin slack.

Documents are cut into pieces of a whole window and a remainder. How many remainders there are of each length is a table of at
most `capacity` rows whatever the input; the windows are planned on that table, and each planned window stands for as many real
ones as the counts allow. Each piece then finds its place by its rank among the pieces of its length, which is a running sum
over tasks. No piece passes through the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duolist.llm.common import Batches, id_and_text, ids_of, materialise, record, texts
from duolist.llm.tokens import encode_all

CAPACITY = 2048
END_ID = 1


def _pieces(capacity: int, end_id: int, path: str | None, with_ids: bool):
    def run(batches: Batches) -> Batches:
        part, count = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = ids_of(batch).to_pylist()
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, tokens in zip(ids, encode_all(texts(batch.column(1)), path), strict=True):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(tokens), capacity):
                    piece = tokens[start : start + capacity]
                    for column, v in zip(rows, (doc_id, start, len(piece), zlib.crc32(piece), len(tokens), part, count[len(piece)], piece if with_ids else None), strict=True):
                        column.append(v)
                    count[len(piece)] += 1
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "ord")
            out = {n: pa.array(c, pa.int64()) for n, c in zip(names, rows, strict=False)}
            yield record(**out, **({"ids": pa.array(rows[7], pa.list_(pa.int64()))} if with_ids else {}))

    return run


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths, the largest one included, whose sum comes closest to capacity.

    Bit s of a set tells whether the lengths so far can sum to s; lengths come from large to small, and counts are read back
    from the sets, taking small lengths only where needed.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    limit = (1 << (room + 1)) - 1
    sets, used = [1], []
    for length in lengths:
        if length > room:
            continue
        free = counts[length] - (length == first)
        reach, most, step = sets[-1], min(free, room // length), 1
        while most > 0:  # 1, 2, 4, ... copies and the rest
            take = min(step, most)
            reach |= (reach << (take * length)) & limit
            most -= take
            step *= 2
        if reach != sets[-1]:
            sets.append(reach)
            used.append(length)
            if reach >> room:
                break
    at = sets[-1].bit_length() - 1
    fill = {first: 1}
    for i in range(len(used) - 1, -1, -1):
        while not sets[i] >> at & 1:
            fill[used[i]] = fill.get(used[i], 0) + 1
            at -= used[i]
    return fill


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths of a window, how many such windows). A window is planned again only after one of its lengths has run short.

    Each step at least halves what is left of some length, so steps are bounded by capacity * log2(pieces).
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    out = []
    while left:
        fill = best_fill(left, capacity)
        times = min(left[length] // n for length, n in fill.items())
        for length, n in fill.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        out.append((fill, times))
    return out


def _places(steps: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For ranks of each length from some rank on: first window, pieces of that length in a window, and their first offset."""
    rows, rank, window = [], {}, 0
    for fill, times in steps:
        offset = 0
        for length in sorted(fill, reverse=True):
            rows.append((length, rank.get(length, 0), window, fill[length], offset))
            rank[length] = rank.get(length, 0) + fill[length] * times
            offset += fill[length] * length
        window += times
    rows.sort()
    return dict(zip(("length", "rank", "window", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _assign(places: dict[str, np.ndarray], with_ids: bool):
    keys = (places["length"] << 44) | places["rank"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = of["length"].to_numpy(), of["rank"].to_numpy()
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            k = rank - places["rank"][at]
            each = places["each"][at]
            out = {n: of[n] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield record(**out, sequence_id=places["window"][at] + k // each, offset=places["offset"][at] + (k % each) * length, **({"ids": of["ids"]} if with_ids else {}))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece.

    Each document's ids, then end_id, are cut every `capacity` ids; each id lies in one piece, each piece in one sequence of at
    most `capacity` ids, gapless from offset 0. Null and empty texts are the end id alone; a null doc_id is kept as null;
    repeated rows are packed as often as they come; other columns are not read; an empty table gives an empty table.
    """
    extra = ", ids array<long>" if with_ids else ""
    pieces = materialise(id_and_text(docs, id_col, text_col).mapInArrow(_pieces(capacity, end_id, vocabulary, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, ord long" + extra), "pieces")
    by_task = pieces.groupBy("length", "part").agg((F.max("ord") + 1).alias("n"))
    before = by_task.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # at most `capacity` rows, whatever the input
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, capacity))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("ord"))
    return ranked.mapInArrow(_assign(places, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + extra)
