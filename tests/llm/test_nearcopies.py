import math

import numpy as np
import pytest

from duolist.llm import common, nearcopies
from tests.llm import edge


def jaccard(a, b):
    x, y = (set(nearcopies.shingles(t.encode())) for t in (a, b))
    return len(x & y) / len(x | y)


def planted(seed=3, originals=120, length=220):
    """Texts, and copies of them with a few words changed."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
    out = []
    for i in range(originals):
        words = [vocabulary[w] for w in rng.integers(0, len(vocabulary), length)]
        out.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            copy = list(words)
            for at in rng.choice(length, j + 1, replace=False):
                copy[at] = vocabulary[rng.integers(0, len(vocabulary))]
            out.append((10 * i + j, " ".join(copy)))
    return out


def test_planted_near_copies_are_found_and_others_left_alone(spark):
    data = planted()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    of = {r.doc_id: r.class_id for r in nearcopies.near_copies(docs).collect()}
    text = dict(data)
    near = [(a, a + j) for a in range(0, 1200, 10) for j in (1, 2, 3) if jaccard(text[a], text[a + j]) >= 0.8]
    assert len(near) > 300 and np.mean([of[a] == of[b] for a, b in near]) > 0.95  # by design at least 0.9 of those at the threshold meet, more above it
    assert all(len({d // 10 for d in of if of[d] == c}) == 1 for c in set(of.values()))
    kept = {r.doc_id for r in nearcopies.keep_one_per_class(docs).collect()}
    assert {10 * i for i in range(120)} <= kept and len(kept) == len(set(of.values()))


def banded(seed=11, pairs=700, length=240):
    """Pairs of texts, the second with some words changed, so that similarities lie around the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(pairs):
        words = [f"w{x}" for x in rng.integers(0, 50_000, length)]
        copy = list(words)
        for at in rng.choice(length, 3 + i % 5, replace=False):
            copy[at] = f"c{rng.integers(0, 50_000)}"
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return out


@pytest.mark.parametrize("verify_block", [nearcopies.VERIFY_BLOCK, 300])
def test_links_by_similarity_band(spark, verify_block):
    data = banded()
    text, docs = dict(data), spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    of = {r.doc_id: r.class_id for r in nearcopies.near_copies(docs, verify_block=verify_block).collect()}
    at = [(jaccard(text[2 * i], text[2 * i + 1]), of[2 * i] == of[2 * i + 1]) for i in range(700)]
    edge_of = [hit for j, hit in at if 0.8 <= j < 0.83]
    assert len(edge_of) > 100 and np.mean(edge_of) >= 0.9
    assert np.mean([hit for j, hit in at if j >= 0.83]) >= 0.95
    below = [hit for j, hit in at if j < 0.8]
    assert len(below) > 100 and not any(below)


def test_exact_links_span_the_components_of_all_similar_pairs():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(3)]
    sets = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
    for i in range(40):
        x = base[i % 3].copy()
        x[rng.choice(30, rng.integers(0, 5), replace=False)] = rng.integers(0, 2**63)
        sets.append(np.unique(x))
    near = np.array([[len(x) and len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8 for y in sets] for x in sets]).astype(bool)
    a, b = nearcopies.exact_links(sets, 0.8)
    assert near[a, b].all() and len(a)
    own = np.eye(len(sets), dtype=bool)
    own[a, b] = own[b, a] = True

    def reach(m):
        return np.linalg.matrix_power((m | np.eye(len(m), dtype=bool)).astype(float), len(m)) > 0

    assert (reach(own) == reach(near)).all()
    assert all(len(x) == 0 for x in nearcopies.exact_links([], 0.8))


def test_views_find_with_the_same_probability_at_every_size():
    p = nearcopies.bit_difference(0.8)
    for n in (1, 1000, 10**6, 10**9):
        places = nearcopies.views_for(n)
        size = places.shape[1]
        meets = sum(math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(3))
        assert (1 - (1 - meets) ** len(places)) * nearcopies.within_bits(0.8) >= nearcopies.RECALL >= 0.9 and 2**size >= 2**nearcopies.SPARE_BITS * n and all(len(set(v)) == size for v in places.tolist())


@pytest.mark.parametrize("block", [16_384, 24])
def test_links_span_the_components_of_all_pairs_that_meet(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (3, 4)).astype(np.uint64)
    fps = []
    for b in base:  # three balls, one of them large
        for _ in range(150 if len(fps) == 0 else 20):
            f = b.copy()
            for bit in rng.choice(256, 12, replace=False):
                f[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            fps.append(f)
    fps = np.unique(np.array(fps), axis=0)
    df = spark.createDataFrame([tuple(r) for r in fps.view(np.int64).tolist()], ", ".join(f"f{i} long" for i in range(4)))
    links = nearcopies.fingerprint_links(df, block=block).collect()
    names = {int(x): i for i, x in enumerate(nearcopies.node(fps))}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = names[r.a], names[r.b]
        assert np.bitwise_count(fps[a] ^ fps[b]).sum() <= nearcopies.most_bits(0.8)
        root[find(a)] = find(b)
    found = {}
    for i, f in enumerate(fps):
        own = int(np.argmin([np.bitwise_count(f ^ b).sum() for b in base]))
        found.setdefault(own, set()).add(find(i))
    assert all(len(v) == 1 for v in found.values()) and len({min(v) for v in found.values()}) == 3


def test_spanning_links_equal_plain_components():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**63, (60, 4)).astype(np.uint64)
    for i in range(10, 60, 3):
        fps[i] = fps[i - 10] ^ np.uint64(rng.integers(0, 2**20))
    most = 12
    a, b = nearcopies.spanning_links(fps, most)
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= most
    assert near[a, b].all()
    reach = np.linalg.matrix_power(near.astype(float), 60) > 0
    own = np.eye(60, dtype=bool)
    own[a, b] = own[b, a] = True
    assert ((np.linalg.matrix_power(own.astype(float), 60) > 0) == reach).all()


@pytest.mark.parametrize("bits", [2**26, 2**15])
def test_listed_rows_are_flagged(spark, bits, monkeypatch):
    monkeypatch.setattr(common, "LISTED_BITS", bits)
    df = spark.range(20_000).selectExpr("id as k", "'clash' as slot", "'clash' as bits")
    listed = spark.range(0, 20_000, 7).selectExpr("id as k")
    got = common.maybe_listed(df, listed, ["k"], "maybe")
    assert got.columns == ["k", "slot", "bits", "maybe"]
    flags = {r.k: r.maybe for r in got.collect()}
    assert len(flags) == 20_000 and all(flags[k] for k in range(0, 20_000, 7))
    assert sum(flags.values()) < (3000 if bits == 2**26 else 6000)
    assert not any(r.maybe for r in common.maybe_listed(df, listed.limit(0), ["k"], "maybe").collect())


def test_no_unlike_row_is_lost(spark):
    """Null ids, one id for unlike texts, repeated rows, empty and null texts, clashing names."""
    rows = [(None, edge.text(900 + i, 60), "en") for i in range(4)] + [(7, edge.text(950, 60), "en"), (7, edge.text(951, 60), "en"), (7, edge.text(951, 60), "en")]
    rows += [(8, None, "en"), (9, "", "de"), (None, "  ", "de"), (12, edge.text(900, 60), "en"), (13, "one two", "en"), (14, "ONE  two", "en")]
    docs = edge.documents(spark, rows)
    kept = nearcopies.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(12, edge.text(900, 60)), *((None, edge.text(900 + i, 60)) for i in (1, 2, 3)), (7, edge.text(950, 60)), (7, edge.text(951, 60)), (8, None), (13, "one two")]
    assert got == sorted(want, key=str)
    assert nearcopies.keep_one_per_class(edge.nothing(spark)).count() == 0
