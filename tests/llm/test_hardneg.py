import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duolist.llm import hardneg, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "vec_id long, label int, embedding array<float>, anchor string, score double, part int, row long"


def plain(rows, step=10, positives=5, negatives=10):
    """Every anchor against every row."""
    ok = [(i, c, [int(np.floor(256 * float(v))) for v in x]) for i, c, x in rows if i is not None and c is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for a, c, x in ok:
        if a % step:
            continue
        scored = sorted((-sum(u * v for u, v in zip(x, y, strict=True)), i, d) for i, d, y in ok if i != a)
        for p in [s for s in scored if s[2] == c][:positives]:
            near = [s for s in scored if s[2] != c and -30 * p[0] <= -100 * s[0] <= -90 * p[0]][:negatives]
            out += [(a, p[1], r + 1, n[1], -p[0], -n[0]) for r, n in enumerate(near)]
    return sorted(out)


def mined(spark, rows, block=hardneg.ROWS, anchors=hardneg.ANCHORS):
    df = spark.createDataFrame([(*r, "x", 0.0, 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 10 == 0, rows=block, anchors=anchors).collect()))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 64, 100]), st.sampled_from([1, 2, 4]), st.sampled_from([1, 4, 6, 8]))
def test_scores_lie_in_their_intervals(seed, width, count, planes):
    rng = np.random.default_rng(seed)
    z = np.floor(256 * rng.standard_normal((40, width)) * rng.choice([0, 0.01, 1, 1000], (40, 1)))
    q = np.floor(256 * rng.standard_normal((7, width)))
    z[:3] = q[:3]
    turn = hardneg.rotations(width, count)
    codes, anchors = hardneg.Codes(z, turn), hardneg.Anchors(q, turn, planes)
    least, most = anchors.intervals(slice(0, 7), codes.words, codes.align, codes.residual, codes.length)
    assert ((least <= q @ z.T) & (q @ z.T <= most)).all()


def test_longer_codes_leave_out_more():
    rng = np.random.default_rng(1)
    z, q = np.floor(256 * rng.standard_normal((2000, 64))), np.floor(256 * rng.standard_normal((20, 64)))
    spread, scored, fifth = [], [], np.sort(q @ z.T, axis=1)[:, -5:-4]
    for count in (1, 4, 8):
        turn = hardneg.rotations(64, count)
        codes = hardneg.Codes(z, turn)
        least, most = hardneg.Anchors(q, turn).intervals(slice(0, 20), codes.words, codes.align, codes.residual, codes.length)
        spread.append((most - least).mean())
        scored.append((most >= fifth).mean())  # share of rows that have to be scored for the best five, of vectors without structure
    assert spread[0] > 1.4 * spread[1] > 1.4 * spread[2]
    assert scored[0] > scored[1] > scored[2] and scored[2] < 0.4


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    rows = [(i, int(rng.integers(0, 3)), (centre[i % 6] + rng.standard_normal(16) * (0.3 if i % 3 else 1)).tolist()) for i in range(300)]
    rows += [(i, 1, rows[3][2]) for i in range(300, 360)]  # ties, and one label with most rows
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, rows, block=64, anchors=7) == plain(rows)  # many blocks on both sides


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, rng.standard_normal(8).tolist()) for i in range(40)]
    rows += [(None, 0, [1.0] * 8), (100, None, [1.0] * 8), (110, 0, None), (120, 1, [float("nan")] * 8), (130, 1, [1.0] * 7 + [None]), (140, 0, [float("inf")] * 8), (150, 0, [0.0] * 8), (160, 5, [2.0] * 8), (41, 0, [0.0] * 8)]
    assert mined(spark, rows) == plain(rows)
    repeated = rows + [rows[3], rows[4], rows[10]]
    assert {r[0] for r in mined(spark, repeated)} == {r[0] for r in plain(rows)} and all(r[0] not in (r[1], r[3]) for r in mined(spark, repeated))
    other_width = rows + [(170, 0, [1.0, 2.0]), (180, 0, []), (190, 1, [3e30] * 8)]
    assert mined(spark, other_width) == plain(rows)  # another width, nothing, and beyond 64 bits
    assert mined(spark, []) == [] and mined(spark, rows[1:9]) == [] and mined(spark, [(10, 0, [1.0] * 8)]) == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op11_hard_negatives"])
    got = queries.op11_hard_negatives(spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


@pytest.mark.parametrize("scale", [1, 2**20])
def test_integer_scores_beyond_doubles(scale):
    rng = np.random.default_rng(3)
    q, z = (rng.integers(-(2**8), 2**8, (n, 64)).astype("<i4") * scale for n in (5, 50))
    r, c = np.nonzero(np.ones((5, 50), bool))
    want = [sum(int(u) * int(v) for u, v in zip(q[i], z[j], strict=True)) for i, j in zip(r, c, strict=True)]
    assert hardneg.integer_scores(q, z, r, c).tolist() == want and hardneg.integer_scores(q, z, r[:9], c[:9]).tolist() == want[:9]
