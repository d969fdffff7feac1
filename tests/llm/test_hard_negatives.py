"""Hard negatives against brute force; intervals hold for every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltledger.llm import hard_negatives, oracles, queries

SCHEMA = "vec_id long, embedding array<float>, label int, row long, x string, code string, place string"


def brute(rows):
    """Rows are (vec_id, vector, label); repeated rows count each for itself."""
    sound = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(v is None or not np.isfinite(v) for v in vector):
            continue
        sound.append((vec_id, [int(np.floor(256.0 * float(np.float32(v)))) for v in vector], label))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for k, (anchor, v, label) in enumerate(sound):
        if anchor is None or anchor % 100:
            continue
        near = [
            (max(-hard_negatives.MOST_SCORE, min(hard_negatives.MOST_SCORE, sum(a * b for a, b in zip(v, w)))), i, same == label)  # noqa: B905
            for j, (i, w, same) in enumerate(sound)
            if j != k
        ]
        for ps, positive, _ in sorted((p for p in near if p[2]), key=order)[:5]:
            fits = [p for p in near if not p[2] and 30 * ps <= 100 * p[0] <= 90 * ps]
            out += [(anchor, positive, r + 1, i, ps, s) for r, (s, i, _) in enumerate(sorted(fits, key=order)[:10])]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(0, 0.3, 20).tolist(), int(draw.integers(0, 3))) for i in range(500)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(30)]  # ties
    rows += [rows[100], rows[100], rows[3]]  # repeated
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [None] * 20, 1), (2003, [float("nan")] * 20, 1),
             (2004, [float("inf")] * 20, 1), (2100, [], 1), (2200, [0.0] * 20, 2), (2300, rows[5][1][:7], 0),
             (None, rows[0][1], 0), (None, rows[1][1], 1), (-100, rows[1][1], 1), (2**62, rows[2][1], 2)]
    return [(*r, 1, "a", "b", "c") for r in rows]


def test_mining(spark, vectors):
    got = mined(spark.createDataFrame(vectors, SCHEMA).repartition(3))
    assert got == brute(vectors) and len(got) > 100


def test_blocks_and_tiles(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(hard_negatives, "TILE", 2)
    assert mined(spark.createDataFrame(vectors, SCHEMA).repartition(2)) == brute(vectors)


def test_huge_components(spark):
    draw = np.random.default_rng(5)
    rows = [(i * 50, (draw.normal(0, 1, 3) * 10.0 ** draw.integers(0, 30)).tolist(), i % 2, 0, "", "", "") for i in range(12)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1, 0, "", "", "")], SCHEMA)) == []  # no anchor
    assert mined(spark.createDataFrame([(100, [0.5], 1, 0, "", "", "")], SCHEMA)) == []  # nothing else


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(oracles.QUERIES["op13_hard_negatives"]).fetchall()
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf_dir).collect())) == sorted(want)


@pytest.mark.parametrize("width", [1, 20, 64, 100, 300])
def test_intervals_hold(width):
    draw = np.random.default_rng(width)
    x, q = np.floor(256 * draw.normal(0, 0.2, (200, width))), np.floor(256 * draw.normal(0, 0.2, (30, width)))
    x[:30] = q + draw.integers(-2, 3, q.shape)
    below, above = hard_negatives.intervals(
        hard_negatives.encode(q, hard_negatives.ANCHOR_CODES), hard_negatives.encode(x, hard_negatives.ROW_CODES)
    )
    exact = q @ x.T
    assert (below <= exact).all() and (exact <= above).all()
    if width >= 64:  # and say something
        assert (above - below).mean() < 0.7 * np.mean(np.linalg.norm(q, axis=1)) * np.mean(np.linalg.norm(x, axis=1))
