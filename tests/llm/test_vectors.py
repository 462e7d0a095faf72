import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duolist.llm import ann, embdedup

NAN, INF = float("nan"), float("inf")


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], "clash", 0, 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, score int, label int")


def cloud(n=400, width=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    x[50:90] = x[50] + 0.05 * rng.standard_normal((40, width))
    x[90:120] = x[90]
    return x.astype(np.float32)


ODD = [None, [0] * 16, [NAN] + [1] * 15, [INF] + [1] * 15, [None] + [1] * 15, [1, 2]]


def test_search_recall_ties_and_those_without_part(spark):
    x = cloud()
    got = ann.nearest(table(spark, [*x, *ODD]), F.col("vec_id") % 20 == 0, 20).collect()
    d = x.astype(float)
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(d[r.query_id] @ d[r.vec_id]), abs=1e-12)
    assert sorted(by) == list(range(0, 400, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s = d @ d[q]
        s[q] = -1e9
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9
    assert [r.vec_id for r in by[100]] == [i for i in range(90, 111) if i != 100]


def test_few_and_no_candidates(spark):
    got = ann.nearest(table(spark, [[1, 0], [0, 1], [1, 1]]), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 2, 1.0), (2, 1, 0.0)]
    assert ann.nearest(table(spark, ODD), F.lit(True)).count() == 0
    assert ann.nearest(table(spark, []), F.lit(True)).count() == 0


def test_near_duplicates(spark):
    x = cloud()
    x[200] = 3 * x[201]
    got = {r.vec_id: r for r in embdedup.near_duplicate_vectors(table(spark, [*x, *ODD]), leaf_rows=64).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == 400 + len(ODD)
    assert np.mean([got[i].n_links == near[i].sum() for i in range(400)]) > 0.98 and all(got[i].n_links <= near[i].sum() for i in range(400))
    assert {got[i].component_id for i in range(90, 120)} == {90} and {got[i].component_id for i in range(50, 90)} == {50} and got[201].component_id == 200
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(400, 400 + len(ODD)))
    assert [i for i in range(90, 120) if got[i].kept] == [90]


def test_leaves_in_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    x = np.ones((70, 4)) + 0.01 * np.random.default_rng(1).standard_normal((70, 4))
    got = embdedup.near_duplicate_vectors(table(spark, x)).collect()
    assert {r.n_links for r in got} == {69} and {r.component_id for r in got} == {0}


def test_route_spills_to_both_sides():
    x = np.random.default_rng(0).standard_normal((500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = embdedup.fit_forest(x, 500, trees=3, leaf_rows=64)
    leaves = embdedup.route(forest, x)
    assert len(leaves) == 500 and all(len(a) >= 3 and (np.diff(a) > 0).all() for a in leaves) and sum(map(len, leaves)) > 1500


def test_no_vectors(spark):
    assert embdedup.near_duplicate_vectors(table(spark, [])).count() == 0
    got = embdedup.near_duplicate_vectors(table(spark, [[1, 0], [1, 0]], [5, 5])).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(5, 1, 5)] * 2


def test_no_row_is_lost(spark):
    """Ids that occur with and without a vector, null ids, and one id for unlike vectors."""
    rows = [[1, 0], None, [1, 0], [0, 1], [0, 1], None, [0, 1], [1, 1]]
    ids = [1, 1, 2, 3, None, None, 3, 3]
    got = embdedup.near_duplicate_vectors(table(spark, rows, ids)).collect()
    want = [(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True), (3, 2, 3, True), (3, 0, 3, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    found = ann.nearest(table(spark, rows, ids), F.lit(True), 3).collect()
    assert {r.query_id for r in found} == {1, 2, 3} and all(r.vec_id is not None and r.vec_id != r.query_id for r in found)


def test_one_odd_width_takes_no_other_vector_out(spark):
    got = embdedup.near_duplicate_vectors(table(spark, [[1, 0], [1, 0], [1, 2, 3]])).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(0, 1), (1, 1), (2, 0)]


def test_deeper_forests_have_more_trees():
    assert embdedup.trees_for(0) == 12 and embdedup.trees_for(11) > embdedup.trees_for(6) >= 12
    assert all((1 - embdedup.TOGETHER**d) ** embdedup.trees_for(d) <= embdedup.MISSED * 1.0001 for d in range(1, 24))


def test_spans_are_of_shared_prefixes():
    rng = np.random.default_rng(4)
    label = np.sort(rng.integers(0, 1 << 20, 500) | rng.integers(0, 1 << 8, 500) << 40)
    asked = label[::50] ^ 1
    lengths = set()
    for level in (0, 8, 30, 40, 47, 48):
        start, end = ann.spans(label, asked, level)
        for q, a, b in zip(asked.tolist(), start.tolist(), end.tolist()):
            assert [i for i, x in enumerate(label.tolist()) if x >> 48 - level == q >> 48 - level] == list(range(a, b))
            lengths.add(b - a)
    assert len(lengths) > 4  # within a bucket, longer prefixes are shared by fewer


def test_structure_needs_few_candidates(spark):
    """On clustered vectors a search reaches its recall after scoring a small share of the rows."""
    rng = np.random.default_rng(7)
    n, width = 20_000, 24
    centres = rng.standard_normal((n // 40, width))
    x = np.repeat(centres, 40, axis=0) + 0.15 * rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reps = spark.createDataFrame(pd.DataFrame({"rep": np.arange(n), "x": x.tolist(), "least": np.arange(n)}), "rep long, x array<double>, least long").repartition(4)
    got = ann.search(reps, reps.where("rep % 400 = 0").select("rep"), 20).collect()
    hits = scored = 0
    for q in range(0, n, 400):
        own = [r for r in got if r.query == q]
        assert len(own) == 21
        hits += len({r.rep for r in own if r.rep != q} & set(np.argsort(-(x @ x[q]))[1:21].tolist()))
        scored += sum(r.scored for r in own)
    queries = n // 400
    assert hits / (20 * queries) >= 0.9 and scored / (queries * n) < 0.05
