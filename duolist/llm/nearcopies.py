"""Near copies by shingle similarity: wide SimHash fingerprints that meet in the middle.

A bit of a SimHash fingerprint differs between two texts with a probability that depends on their similarity alone, so how many
of 256 bits differ estimates the similarity of the sets of word shingles. At a similarity of 0.8 about 39 bits differ, far too
many for balls around whole fingerprints. Views help: each takes a few of the bits, and two near fingerprints differ in at most 2
bits of some view. Every fingerprint emits, for each view, all variants within 1 bit; two within 2 bits of each other meet there.
Fingerprints that collide are verified in full. Views have as many bits as keep chance meetings rare among the fingerprints there
are, and there are as many views as find a pair at the threshold with a fixed probability, so recall is the same at every size.

Bits only propose. What lies near in bits forms candidate groups, and members of a group link where the exact Jaccard similarity
of their sets of shingles reaches the threshold; a group too large for one task is compared in pairs of blocks.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import Batches, fresh, materialise, maybe_listed, record, text_bytes
from duolist.llm.components import connected_components
from duolist.llm.tokens import forget

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Probability with which a pair at exactly the threshold becomes a candidate; pairs above it do with a greater one.
RECALL = 0.92
#: Standard deviations above the mean at the threshold up to which differing bits make a candidate.
SPREAD = 2.5
BITS = 256
SEED = 42
#: Bits of a view beyond those that number the fingerprints.
SPARE_BITS = 2
#: Fingerprints that meet in one variant and are compared in one task; more are dealt in pairs of blocks.
BLOCK = 16_384
#: Shingles of a candidate group that are compared in one task; larger groups are dealt in pairs of blocks.
VERIFY_BLOCK = 2_000_000
#: Stands for a null doc_id in keys.
NO_ID = -(2**63)
_WORDS = BITS // 64
_FP = [f"f{i}" for i in range(_WORDS)]
_STEP = 16_384


def _mixed(z: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE_WORDS) -> list[bytes]:
    """Runs of `size` words, A-Z lowered; the whole sequence if there are fewer words; nothing without words."""
    words = text.lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_set(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the set of shingles of a text."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, size), repeat(SEED)), np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Wide SimHash of a set of hashed shingles; an empty set gives zeros."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP, None] + np.arange(_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.unpackbits(_mixed(part).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def bit_difference(similarity: float) -> float:
    """Probability that a bit differs between two sets of equal size with this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def most_bits(similarity: float) -> int:
    """Differing bits up to which fingerprints are candidates: the mean at the threshold and some standard deviations."""
    p = bit_difference(similarity)
    return int(BITS * p + SPREAD * math.sqrt(BITS * p * (1 - p)))


def within_bits(similarity: float) -> float:
    """Probability that a pair of this similarity differs in most_bits at most."""
    p = bit_difference(similarity)
    return sum(math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k) for k in range(most_bits(similarity) + 1))


def views_for(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """Bit places of each view, for n different fingerprints: recall is that of meeting in a view and passing most_bits."""
    size = min(BITS // 4, max(16, math.ceil(math.log2(max(n, 2))) + SPARE_BITS))
    p = bit_difference(similarity)
    meets = sum(math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(3))
    count = math.ceil(math.log(1 - recall / within_bits(similarity)) / math.log(1 - meets))
    rng = np.random.Generator(np.random.PCG64(SEED))
    each = BITS // size
    return np.concatenate([rng.permutation(BITS)[: each * size].reshape(each, size) for _ in range(math.ceil(count / each))])[:count]


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy().view(np.uint64) for i in range(_WORDS)], axis=1) if batch.num_rows else np.empty((0, _WORDS), np.uint64)


def _columns(fps: np.ndarray) -> dict[str, np.ndarray]:
    return {c: np.ascontiguousarray(fps[:, i]).view(np.int64) for i, c in enumerate(_FP)}


def node(fps: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint."""
    z = np.zeros(len(fps), np.uint64)
    for i in range(_WORDS):
        z = _mixed(z * np.uint64(0x9E3779B97F4A7C15) + fps[:, i] + np.uint64(1))
    return z.view(np.int64)


def _variants(places: np.ndarray):
    count, size = places.shape
    weights = np.int64(1) << np.arange(size, dtype=np.int64)
    flips = np.r_[np.int64(0), weights]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            every = _matrix(batch, 0)
            for i in range(0, len(every), 1000):
                fps = every[i : i + 1000]
                bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
                own = np.stack([bits[:, at] @ weights for at in places], axis=1) * count + np.arange(count)
                keys = ((own // count)[:, :, None] ^ flips) * count + (own % count)[:, :, None]
                yield record(key=keys.ravel(), **_columns(np.repeat(fps, count * len(flips), axis=0)))

    return run


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints of a lie near which of b."""
    apart = np.zeros((len(a), len(b)), np.int16)
    for i in range(_WORDS):
        apart += np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return apart <= most


def spanning_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of two members) that span the components of all members: what a search from each unseen member reaches.

    Members once reached are compared only with those not reached yet, so a group of near copies costs little more than its size.
    """
    a, b, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(fps))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:256], front[256:]
            hit = _near(fps[now], fps[left], most)
            reached = hit.any(axis=0)
            a.append(left[reached])
            b.append(now[hit[:, reached].argmax(axis=0)])
            front, left = np.r_[front, left[reached]], left[~reached]
    return np.concatenate(a), np.concatenate(b)


def _collide(most: int, block: int):
    """Reads (key, fingerprint) sorted by key; gives links (a, b), and (key, null) for variants where too many meet."""

    def run(batches: Batches) -> Batches:
        held_k, held_f, full = np.empty(0, np.int64), np.empty((0, _WORDS), np.uint64), None

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            of = np.repeat(size, size)
            a, b = [np.empty((0, _WORDS), np.uint64)], [np.empty((0, _WORDS), np.uint64)]
            for lag in range(1, min(8, len(keys))):  # small meetings, all at once
                at = np.flatnonzero((keys[lag:] == keys[:-lag]) & (of[lag:] <= 8))
                x, y = fps[lag:][at], fps[:-lag][at]
                near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most
                a.append(x[near])
                b.append(y[near])
            for s, n in zip(start[size > 8], size[size > 8], strict=True):
                x, y = spanning_links(fps[s : s + n], most)
                a.append(fps[s + x])
                b.append(fps[s + y])
            both = np.unique(np.stack([node(np.concatenate(a)), node(np.concatenate(b))], axis=1), axis=0)
            return record(a=both[:, 0].copy(), b=both[:, 1].copy()) if len(both) else None

        for batch in batches:
            keys, fps = np.r_[held_k, batch.column(0).to_numpy()], np.concatenate([held_f, _matrix(batch, 1)])
            if full is not None:
                on = keys != full
                keys, fps = keys[on], fps[on]
                full = full if not len(keys) else None
            if not len(keys):
                continue
            last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if last and (out := links(keys[:last], fps[:last])):
                yield out
            held_k, held_f = keys[last:], fps[last:]
            if len(held_k) > block:
                full = int(held_k[0])
                yield record(a=[full], b=pa.nulls(1, pa.int64()))
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k) and (out := links(held_k, held_f)):
            yield out

    return run


def _compare_blocks(most: int):
    """Links within a block, or between two blocks, of those that meet in one variant."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(fps := np.ascontiguousarray(frame[_FP].to_numpy(np.int64)).view(np.uint64), most)
        names = node(fps)
        return pd.DataFrame({"a": names[a], "b": names[b]})

    return run


def fingerprint_links(fps: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(a, b): names of different fingerprints that lie near each other; their components are those of all near pairs that meet.

    fps: columns f0 to f3, distinct.
    """
    most, places = most_bits(similarity), views_for(fps.count(), similarity, recall)
    schema = "key long, " + ", ".join(f"{c} long" for c in _FP)
    met = fps.select(*_FP).mapInArrow(_variants(places), schema)
    found = materialise(met.repartition("key").sortWithinPartitions("key").mapInArrow(_collide(most, block), "a long, b long").distinct(), "near-links")
    links, full = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("key"))
    if not full.isEmpty():
        dense = met.join(full, "key", "left_semi")
        parts = dense.groupBy("key").agg((F.ceil(F.count(F.lit(1)) * 2 / block)).cast("int").alias("parts"))
        cut = dense.join(parts, "key").withColumn("part", F.pmod(F.xxhash64(*_FP), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = cut.select("key", *_FP, F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
        links = links.unionAll(dealt.groupBy("key", "low", "high").applyInPandas(_compare_blocks(most), "a long, b long").distinct())
    return links


def exact_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of two sets) that span the components of all pairs whose Jaccard similarity reaches the threshold.

    Each set reached is compared with those not reached yet. Empty sets link with nothing.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    end = np.cumsum(sizes)
    left = np.flatnonzero(sizes)
    flat, mark = ids, np.zeros(len(values), np.uint8)
    a, b, front = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    while len(left):
        if not front:
            front, flat, left = [left[0]], flat[sizes[left[0]] :], left[1:]
            continue
        at = front.pop()
        own = ids[end[at] - sizes[at] : end[at]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(sizes[left])[:-1]], dtype=np.int64)
        mark[own] = 0
        hit = shared / (sizes[at] + sizes[left] - shared) >= similarity
        if hit.any():
            a.append(left[hit])
            b.append(np.full(hit.sum(), at))
            front.extend(left[hit])
            flat, left = flat[np.repeat(~hit, sizes[left])], left[~hit]
    return np.concatenate(a), np.concatenate(b)


def _sets(size: int):
    """Reads (root, name, parts, text); gives the shingle set of each name once a task."""

    def run(batches: Batches) -> Batches:
        done = set()
        for batch in batches:
            new = [i for i, x in enumerate(batch.column(1).to_pylist()) if x not in done and not done.add(x)]
            for i in range(0, len(new), 500):
                part = batch.take(pa.array(new[i : i + 500], pa.int64()))
                packed = [shingle_set(t, size).tobytes() for t in text_bytes(part.column(3))]
                yield record(root=part.column(0), name=part.column(1), parts=part.column(2), hashes=pa.array(packed, pa.binary()))

    return run


def _verify(similarity: float):
    """Reads (root, low, high, name, hashes) sorted by these; gives links that span what is similar within each (root, low, high)."""

    def run(batches: Batches) -> Batches:
        group, names, sets = None, [], []

        def links() -> pa.RecordBatch | None:
            if len(names) < 2:
                return None
            a, b = exact_links(sets, similarity)
            of = np.array(names, np.int64)
            return record(a=of[a], b=of[b]) if len(a) else None

        for batch in batches:
            for root, low, high, name, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (root, low, high) != group:
                    if out := links():
                        yield out
                    group, names, sets = (root, low, high), [], []
                if not names or names[-1] != name:
                    names.append(name)
                    sets.append(np.frombuffer(hashes, np.uint64))
        if out := links():
            yield out

    return run


def _keyed(df: DataFrame, own_id: str, own_text: str) -> DataFrame:
    """df with a key that tells rows of unlike ids or texts apart."""
    return df.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own_text, F.xxhash64("text"))


def similar_links(docs: DataFrame, by_doc: DataFrame, groups: DataFrame, size: int, similarity: float, block: int) -> DataFrame:
    """(a, b): names that span the components of all pairs within a candidate group whose exact similarity reaches the threshold.

    by_doc: doc_id, text_hash, name, n (shingles); groups: node (a name), root. One text stands for its name.
    """
    row = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("key_id"), F.col("text_hash").alias("key_text"), "n")).alias("row")
    each = materialise(by_doc.join(groups.select(F.col("node").alias("name"), "root"), "name").groupBy("root", "name").agg(row).select("root", "name", "row.*"), "candidates")
    total = F.sum("n")
    parts = each.groupBy("root").agg(F.when(total <= block, 1).otherwise(F.ceil(total * 2 / block)).cast("int").alias("parts"))
    asked = materialise(each.join(parts, "root").drop("n"), "candidate-texts")
    texts = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")), "key_id", "key_text")
    met = maybe_listed(texts, asked, ["key_id", "key_text"], "maybe").where("maybe").join(asked, ["key_id", "key_text"]).select("root", "name", "parts", "text")
    sets = met.mapInArrow(_sets(size), "root long, name long, parts int, hashes binary")
    cut = sets.withColumn("part", F.pmod(F.xxhash64("name"), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cut.select("root", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "name", "hashes")
    at = ["root", "low", "high"]
    return dealt.repartition(*at).sortWithinPartitions(*at, "name").mapInArrow(_verify(similarity), "a long, b long")


def near_copies(
    docs: DataFrame, size: int = SHINGLE_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, verify_block: int = VERIFY_BLOCK
) -> DataFrame:
    """(doc_id, text_hash, class_id): one row per row of docs; class_id is the same for near copies and what links them.

    Similarity is the exact Jaccard similarity of the sets of word shingles; nothing below the threshold links. Null and empty
    texts are copies of each other; texts of fewer words than a shingle are one shingle; repeated rows and texts that differ in
    white space or A-Z only share a class; doc_id isn't looked at and may be null or repeated; other columns aren't read. An
    empty table gives an empty table. Recall is as stated from about six shingles on; below that a set has few votes a bit.
    """

    def run(batches: Batches) -> Batches:
        forget()
        for batch in batches:
            fps, sizes = np.empty((batch.num_rows, _WORDS), np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(text_bytes(batch.column(2))):  # one set at a time is held
                hashes = shingle_set(text, size)
                fps[i], sizes[i] = fingerprint(hashes), len(hashes)
            yield record(doc_id=batch.column(0), text_hash=batch.column(1), n=sizes, name=node(fps), **_columns(fps))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text_hash long, n long, name long, " + ", ".join(f"{c} long" for c in _FP)
    by_doc = materialise(rows.mapInArrow(run, schema), "wide-simhash")
    distinct = materialise(by_doc.select(*_FP).distinct(), "wide-fingerprints")
    groups = connected_components(fingerprint_links(distinct, similarity, recall, block))
    roots = connected_components(similar_links(docs, by_doc, groups, size, similarity, verify_block)).withColumnRenamed("node", "name")
    return by_doc.select("doc_id", "text_hash", "name").join(roots, "name", "left").select("doc_id", "text_hash", F.coalesce("root", "name").alias("class_id"))


def keep_one_per_class(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near copies; all columns stay.

    The one with the least doc_id stays, a null doc_id only where the class has no other, ties by a hash of the text; of rows
    that agree in doc_id and text one stays. Unlike documents stay all, whatever their doc_ids.

    Only rows that go or are repeated are listed, and only texts that may be listed are shuffled.
    """
    own_id, own_text = fresh(docs.columns, "key_id", "key_text")
    classes = materialise(near_copies(docs, size, similarity), "classes")
    best = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    kept = best.select(F.coalesce("best.doc_id", F.lit(NO_ID)).alias(own_id), F.col("best.text_hash").alias(own_text)).distinct().withColumn("stays", F.lit(True))
    rows = classes.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(own_id), F.col("text_hash").alias(own_text)).agg(F.count(F.lit(1)).alias("n"))
    stays, maybe = fresh([*docs.columns, own_id, own_text], "stays", "maybe")
    listed = rows.join(kept, [own_id, own_text], "left").where("stays is null or n > 1").select(own_id, own_text, F.coalesce("stays", F.lit(False)).alias(stays))
    listed = materialise(listed, "listed")
    told, columns = maybe_listed(_keyed(docs, own_id, own_text), listed, [own_id, own_text], maybe), [f"`{c}`" for c in docs.columns]
    met = told.where(F.col(maybe)).join(listed, [own_id, own_text], "left").where(F.coalesce(stays, F.lit(True)))  # rows that aren't listed occur once
    return told.where(~F.col(maybe)).select(*columns).unionAll(met.dropDuplicates([own_id, own_text]).select(*columns))
