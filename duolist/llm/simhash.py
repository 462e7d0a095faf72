"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits of each other differ in at most 2 bits once a block that holds one of the differing bits is
left out. So every fingerprint emits, for each of a few blocks left out, all variants within half the radius (1 bit) of what
remains; two near fingerprints then meet in a variant. Variants are dealt by value, colliding fingerprints are verified in full.
A variant on which very many fingerprints meet isn't compared pair by pair: its fingerprints emit balls of whole fingerprints
(1 bit on one side, 2 bits on the other), and what meets there is within 3 bits by construction, so one star per meeting point
links it all.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import Batches, id_and_text, ids_of, map_batches, materialise, record, text_bytes
from duolist.llm.components import connected_components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Variants on which more fingerprints than this meet go the way of whole balls.
DENSE = 2048
_STEP = 65_536


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of one text: a bit is set if it is in over half the shingle hashes; no words give 0."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at \x20 and \x09-\x0d only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        counts += np.unpackbits(hashes[i : i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. A null text counts as empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], np.uint64)
            return record(doc_id=ids_of(batch), fp=fps.view(np.int64))

        return step

    return map_batches(id_and_text(docs, id_col, text_col), make, "doc_id long, fp long")


def block_masks(blocks: int) -> np.ndarray:
    """Masks that each leave out one of `blocks` groups of bits; every bit is left out once."""
    bits = np.array_split(np.arange(64), blocks)
    return np.array([np.bitwise_xor(np.uint64(2**64 - 1), np.bitwise_or.reduce(np.uint64(1) << b.astype(np.uint64))) for b in bits], np.uint64)


def _half_ball(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, flip) of every variant that a fingerprint emits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    pairs = [(m, f) for m in block_masks(blocks) for f in (np.uint64(0), *(b for b in one if b & m))]
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)


def _variants(blocks: int):
    def run(batches: Batches) -> Batches:
        masks, flips = _half_ball(blocks)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 2000):
                part = fps[i : i + 2000]
                keys = (part[:, None] & masks) ^ flips
                yield record(key=keys.ravel().view(np.int64), fp=np.repeat(part, len(masks)).view(np.int64))

    return run


def _linked(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius among the members of one variant, one per member at most."""
    near = np.bitwise_count(members[:, None] ^ members) <= RADIUS
    label = np.arange(len(members))
    while True:
        less = np.where(near, label, len(members)).min(axis=1)
        less = less[less]
        if (less == label).all():
            break
        label = less
    moved = label != np.arange(len(members))
    return members[moved], members[label[moved]]


def _collide(dense: int):
    """Reads (key, fp) sorted by both; gives links (a, b), and (fp, null) for fingerprints of variants that are too full."""

    def run(batches: Batches) -> Batches:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        full: int | None = None  # the variant that is known to be too full, while its rows go on

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            of = np.repeat(size, size)
            a, b, over = [], [], [np.empty(0, np.uint64)]
            for lag in range(1, 8):  # small meetings, all at once
                at = np.flatnonzero((keys[lag:] == keys[:-lag]) & (of[lag:] <= 8)) if len(keys) > lag else []
                x, y = fps[lag:][at], fps[:-lag][at]
                near = np.bitwise_count(x ^ y) <= RADIUS
                a.append(x[near])
                b.append(y[near])
            for s, n in zip(start[size > 8], size[size > 8], strict=True):
                if n > dense:
                    over.append(fps[s : s + n])
                else:
                    x, y = _linked(fps[s : s + n])
                    a.append(x)
                    b.append(y)
            return give(np.concatenate(a), np.concatenate(b), np.concatenate(over))

        def give(a: np.ndarray, b: np.ndarray, over: np.ndarray) -> pa.RecordBatch | None:
            both = np.unique(np.stack([a, b], axis=1), axis=0)
            over = np.unique(over)
            if not len(both) + len(over):
                return None
            return record(a=np.r_[both[:, 0], over].view(np.int64), b=pa.array(np.r_[both[:, 1], over].view(np.int64), mask=np.arange(len(both) + len(over)) >= len(both)))

        none = np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[held_k, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if full is not None:
                n = int(np.searchsorted(keys != full, True))
                if n and (out := give(none, none, fps[:n])):
                    yield out
                keys, fps = keys[n:], fps[n:]
                full = full if not len(keys) else None
            if not len(keys):
                held_k, held_f = keys, fps
                continue
            last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if last and (out := links(keys[:last], fps[:last])):
                yield out
            held_k, held_f = keys[last:], fps[last:]
            if len(held_k) > dense:
                if out := give(none, none, held_f):
                    yield out
                full, held_k, held_f = int(held_k[0]), held_k[:0], held_f[:0]
        if len(held_k) and (out := links(held_k, held_f)):
            yield out

    return run


def _whole_ball(batches: Batches) -> Batches:
    """(key, rim, fp): all variants within 1 bit (rim 0), and those of 2 bits in the same half (rim 1).

    Of three differing bits two lie in the same half, so one side reaches over those two and the other over the third.
    """
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    core = np.r_[np.uint64(0), one]
    rim = np.array([one[i] | one[j] for h in (0, 32) for i in range(h, h + 32) for j in range(h, i)], np.uint64)
    flips, kind = np.r_[core, rim], np.r_[np.zeros(len(core), np.int32), np.ones(len(rim), np.int32)]
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 500):
            part = fps[i : i + 500]
            yield record(key=(part[:, None] ^ flips).ravel().view(np.int64), rim=np.tile(kind, len(part)), fp=np.repeat(part, len(flips)).view(np.int64))


def _stars_of_balls(batches: Batches) -> Batches:
    """Reads (key, rim, fp) sorted; links each fingerprint that meets in key to the first one there with rim 0."""
    key, hub = None, None
    for batch in batches:
        keys, rims, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, len(keys)])
        hubs, has = fps[start].copy(), rims[start] == 0
        if key is not None and keys[0] == key:
            hubs[0], has[0] = (hub, True) if hub is not None else (hubs[0], False)
        key, hub = int(keys[-1]), int(hubs[-1]) if has[-1] else None
        b, ok = np.repeat(hubs, size), np.repeat(has, size)
        ok &= b != fps
        if ok.any():
            both = np.unique(np.stack([fps[ok], b[ok]], axis=1), axis=0)
            yield record(a=both[:, 0], b=both[:, 1])


def fingerprint_links(fps: DataFrame, blocks: int = 3, dense: int = DENSE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints within 3 bits. fps: column fp (long), distinct."""
    met = fps.select("fp").mapInArrow(_variants(blocks), "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(met.mapInArrow(_collide(dense), "a long, b long").distinct(), "simhash-links")
    links, full = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("fp"))
    if not full.isEmpty():
        balls = full.mapInArrow(_whole_ball, "key long, rim int, fp long").repartition("key").sortWithinPartitions("key", "rim", "fp")
        links = links.unionAll(balls.mapInArrow(_stars_of_balls, "a long, b long").distinct())
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = 3, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    fingerprint: 16 hex digits. component_id: the least doc_id among the documents that can be reached over fingerprints at 3
    or fewer differing bits, the document itself included. Null and empty texts have fingerprint zero and link like any
    other; texts of under three words are one shingle; repeated rows and ties share a component; a null doc_id gets the
    component of its fingerprint and is never a component's id unless nothing else is there (then null). Other columns are
    not read. An empty table gives an empty table.
    """
    by_doc = materialise(fingerprints(docs, id_col, text_col), "simhash")
    least = materialise(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(fingerprint_links(least, blocks, dense))
    of_root = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    component = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = of_root.select("fp", "root").join(component, "root").select("fp", "component_id")
    return by_doc.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
