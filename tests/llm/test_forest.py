from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rillmark.llm import forest, queries


def brute(rows, k, step):
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for i, q in good:
        if i % step == 0:
            near = sorted((-(q @ v) / np.sqrt(q @ q) / np.sqrt(v @ v), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j) for r, (_, j) in enumerate(near)}
    return out


def ask(spark, rows, step=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return forest.nearest(df, F.col("vec_id") % step == 0, **options).collect()


def test_all_candidates_are_exact_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(12)]
    rows += [(5000, None), (5005, [0.0] * 8), (5010, [None] * 8), (5015, [float("nan")] * 8), (5020, [1.0, 2.0]), (5025, [])]
    got = {(x.query_id, x["rank"], x.vec_id) for x in ask(spark, rows, share=1.0)}
    assert got == brute(rows, 5, 5)
    assert {x.query_id for x in ask(spark, [(0, [1.0, 0.0]), (5, [0.0, 1.0, 0.0])])} == set()
    few = ask(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0])])
    assert [(x["rank"], x.vec_id) for x in few] == [(1, 1), (2, 2)]


def test_rows_that_repeat_an_id_are_queries_and_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (7, [0.0, 1.0])]
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in ask(spark, rows))
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 7), (0, 2, 7)]


def test_recall_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op9_hash_forest(spark, sf_dir).collect()
    rows = [(r.vec_id, list(r.embedding)) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    want = brute(rows, 5, 50)
    assert len(got) == len(want)
    assert len({(x.query_id, x.vec_id) for x in got} & {(q, v) for q, _, v in want}) >= 0.9 * len(want)


def test_empty(spark):
    assert ask(spark, []) == []
