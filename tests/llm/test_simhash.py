import numpy as np
import pytest
import xxhash

from duolist.llm import nearcopies, simhash
from duolist.llm.components import connected_components
from tests.llm import edge


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps):
    """Least position reachable over links within 3 bits, by brute force."""
    a, label = np.array(fps, np.uint64), list(range(len(fps)))
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= 3) for x in a]
    while True:
        less = [min(label[j] for j in n) for n in near]
        if less == label:
            return label
        label = less


def test_matches_brute_force(spark):
    got = simhash.near_duplicates(edge.documents(spark)).collect()
    data = edge.rows()
    assert len(got) == len(data)
    fps = [plain_fingerprint(t) for _, t, _ in data]
    label = classes(fps)
    want = []
    for (doc, _, _), fp, c in zip(data, fps, label, strict=True):
        ids = [d for (d, _, _), x in zip(data, label, strict=True) if x == c and d is not None]
        want.append((doc, f"{fp:016x}", min(ids) if ids else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("dense", [2048, 10, 3])
def test_links_of_clusters(spark, dense):
    """Clusters of fingerprints some bits apart, by the usual way and by whole balls."""
    rng, fps = np.random.default_rng(dense), set()
    for _ in range(12):
        base = int(rng.integers(0, 2**63))
        for _ in range(40):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=dense)).collect()}
    label = classes(fps)
    ours = {}
    for x, c in zip(signed, label, strict=True):
        assert ours.setdefault(c, roots.get(x, x)) == roots.get(x, x)
    assert len(set(ours.values())) == len(ours)


def test_blocks_leave_out_every_bit_once():
    masks = simhash.block_masks(3)
    assert np.bitwise_and.reduce(masks) == 0 and all(np.bitwise_count(~m) in (21, 22) for m in masks)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000} and len(got) == 111


def test_one_of_each_group_stays(spark):
    docs = edge.documents(spark)
    kept = nearcopies.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 200 not in ids and 202 not in ids and 103 in ids


def test_empty_table(spark):
    assert simhash.near_duplicates(edge.nothing(spark)).count() == 0
    assert nearcopies.keep_one_per_class(edge.nothing(spark)).count() == 0
