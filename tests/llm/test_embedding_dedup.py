from __future__ import annotations

import numpy as np
import pytest

from rillmark.llm import blocks, embedding_dedup


def brute(rows, threshold):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    units = np.array([v / np.linalg.norm(v) for _, v in good])
    near = units @ units.T >= threshold
    np.fill_diagonal(near, False)
    left, right = np.nonzero(near)
    label = blocks.components_of(len(good), left, right)
    ids = np.array([i for i, _ in good])
    out = {i: (0, i, True) for i, _ in rows}
    for k, (i, _) in enumerate(good):
        least = int(ids[label == label[k]].min())
        out[i] = (int(near[k].sum()), least, least == i)
    return out


def data(n=400, dim=16):
    r = np.random.default_rng(3)
    centres = r.standard_normal((25, dim))
    rows = []
    for i in range(n):
        v = centres[r.integers(0, 25)] + r.standard_normal(dim) * r.choice([0.02, 0.2, 0.6]) if i % 3 else centres[0] + r.standard_normal(dim) * 0.05
        rows.append((int(i * 7 % 1009), [float(np.float32(x)) for x in v]))
    rows += [(2001 + i, rows[5][1]) for i in range(30)]
    rows += [(3001, None), (3002, [0.0] * dim), (3003, [float("nan")] + [1.0] * (dim - 1)), (3004, [None] + [1.0] * (dim - 1)), (3005, [float("inf")] * dim), (3006, [])]
    return rows


@pytest.mark.parametrize("chunk", [512, 16])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_matches_brute_force(spark, monkeypatch, chunk, kind):
    if (chunk, kind) == (512, "double"):
        pytest.skip("covered by the smaller chunks")
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", chunk)
    rows = data()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, threshold=0.95).collect()}
    assert got == brute(rows, 0.95)


def test_repeated_and_null_ids_are_compared_row_by_row(spark):
    a, b, c, far = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0, 0.01], [0.0, 0.0, 1.0]
    rows = [(5, a), (5, b), (9, c), (5, far), (None, [0.0, 1.0, 0.0]), (12, [0.2, 1.0, 0.0]), (11, [-0.2, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()), key=repr)
    # the vector without an id is within 0.95 of 11 and 12, which are not of one another
    assert got == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (5, 0, 5), (None, 2, 11), (12, 1, 11), (11, 1, 11)], key=repr)


def test_unequal_lengths_and_scales(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [-1.0, -2.0]), (5, [1e-300, 2e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (2, 1)}


def test_empty_nulls_and_clashing_columns(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 2, "y")], "vec_id long, embedding array<float>, node long, class string")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()] == [(None, 1, None, True)] * 2  # null ids link like others


def test_planned_tables_hold_the_miss_rate():
    for vectors in (10, 50_000, 10**9):
        bits, tables = embedding_dedup.plan(vectors, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= embedding_dedup.MISS
