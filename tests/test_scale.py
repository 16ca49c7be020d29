"""What queries shuffle and hold, on tables small enough to count it."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import text
from rillmark.operators import analytics, delivery, evaluation, lexical, model_choice, ranking, scoring


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"Aggregate|Join \w+|Window ", plan)


def test_bm25_shuffles_no_postings(spark):
    chunks = spark.range(200).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat_ws(" ", F.lit("a a"), F.col("id") % 7, F.col("id") % 11).alias("text"))
    queries = spark.createDataFrame([(1, "a 3 5"), (2, "5 5"), (3, "none")], "query_id int, text string")
    for got in (lexical.bm25(queries, chunks, k=3), lexical.bm25_fields(queries, chunks, k=3, fields={"text": 1.0})):
        assert not [x for x in exchanges(got) if x != "Window "]
        assert {r.query_id for r in got.collect()} == {1, 2}
    assert not exchanges(lexical.phrase_hits(queries, chunks)) and not exchanges(lexical.postings(chunks))


def shuffled(df) -> list[tuple[str, int]]:
    """How each exchange of an executed plan deals out its rows, and the rows that it wrote."""

    def walk(node) -> list[tuple[str, int]]:
        if "QueryStageExec" in node.getClass().getSimpleName():
            return walk(node.plan())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        own = [(node.outputPartitioning().toString(), node.metrics().apply("shuffleRecordsWritten").value())] if node.nodeName() == "Exchange" else []
        return own + [x for i in range(node.children().size()) for x in walk(node.children().apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_postings_statistics_shuffle_a_row_per_term_and_task(spark, tmp_path):
    from rillmark.plans import search

    lines = [f"Ção {i % 7} {i % 11} {i % 7}" for i in range(3000)]
    docs = [(d, "\n".join(lines[d * 50 : d * 50 + 50]), "pt", "web") for d in range(60)]
    spark.createDataFrame([*docs, (60, None, "pt", "web"), (61, "", "pt", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = search.postings_statistics(spark, str(tmp_path))
    want: dict[str, list[int]] = {}
    for line in lines:
        words = line.replace("Ção", "cao").split()
        for w in set(words):
            want.setdefault(w, []).append(words.count(w))
    assert {tuple(r) for r in df.collect()} == {(w, len(n), sum(n), max(n)) for w, n in want.items()}
    by_key = [x for x in shuffled(df) if "hashpartitioning" in x[0]]
    # 8,000 and more postings, but no more rows than terms in each of the four tasks
    assert len(by_key) == 1 and 0 < by_key[0][1] <= 4 * len(want) < sum(map(len, want.values()))


def test_term_counts(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "ã"],), ([],), (["x"],)], "w array<string>")
    got = [sorted(tuple(x) for x in r.t) for r in rows.select(text.term_counts(F.col("w")).alias("t")).collect()]
    assert got == [[("a", 1), ("b", 2), ("ã", 1)], [], [("x", 1)]]


def test_best_keeps_ties_by_key_over_batches(monkeypatch):
    best = scoring.Best(2, 2)
    ids = [list("dcba"), list("ABDC")]
    for batch in ids:
        best.add(np.repeat([0, 1], 4), np.array([1.0, 1, 1, 1, 2, 1, 1, 1]), np.tile(np.arange(4), 2), np.argsort(np.argsort(batch)), lambda r: (True, batch[r]))
    assert [[k[1] for _, k in rows] for rows in best.rows] == [["A", "B"], ["A", "d"]]


def test_terms_find_phrases_and_overlaps():
    import pyarrow as pa

    terms = scoring.Terms([("a",), ("a", "a"), ("b", "c", "a"), ("z",)])
    row, term, n, length = terms.counted([pa.array([["a", "a", "a"], [], ["b", "c"], ["a", "b", "c", "a"]])], [2.0])
    assert list(zip(row.tolist(), term.tolist(), n.tolist())) == [(0, 0, 6.0), (0, 1, 4.0), (3, 0, 4.0), (3, 2, 2.0)] and length.tolist() == [3, 0, 2, 4]


def test_names_are_met_in_place(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    monkeypatch.setattr(scoring, "CELLS", 8)
    paths = [f"h{i % 3}.example/{'de' if i % 2 else 'en'}/p{i:03d}x{'y' * (i % 4)}" for i in range(60)]
    queries = [(i, paths[i * 7].replace("/", " ")) for i in range(8)]
    got = ranking.name_ranking(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame([(p,) for p in paths], "path string"), k=4)
    assert not [x for x in exchanges(got) if x != "Window "]

    def points(words: set, path: str) -> int:
        *dirs, last = path.split("/")
        cut = lambda s: {w for w in re.findall("[0-9a-z]+", s) if len(w) > 1}
        own = cut(re.sub(r"\.[^.]*$", "", last))
        return 2 * len(words & own) + len(words & (cut("/".join(dirs)) - own))

    want = []
    for q, asked in queries:
        words = {w for w in re.findall("[0-9a-z]+", asked) if len(w) > 1}
        scored = sorted((-points(words, p), len(p), p) for p in paths if points(words, p))[:4]
        want += [(q, p, -s, n + 1) for n, (s, _, p) in enumerate(scored)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_delivery_joins_no_texts(spark, monkeypatch):
    rows = [(f"{d}:{o}", d, o, "t", f"w{d} common {o}", "main", f"f/d{d}.txt", d) for d in range(6) for o in range(2)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc int, ordinal int, trail string, text string, root string, path string, mtime int")
    documents = chunks.select("doc", "root", "path", "mtime").distinct()
    vectors = spark.createDataFrame([(f"{d}:0", [1.0, float(d)]) for d in range(8)], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(1, "w3 d4", [1.0, 5.0])], "query_id int, text string, vector array<double>")
    plain = chunks.drop("root", "path", "mtime").join(vectors, "chunk_id", "left")
    for find in (delivery.passages, delivery.documents_found):
        got, want = find(queries, chunks, documents, delivery.Search(k=3), vectors=vectors), find(queries, plain, documents, delivery.Search(k=3))
        assert got.orderBy("rank").collect() == want.orderBy("rank").collect() and got.count() == 3
    plan = delivery.passages(queries, chunks, documents, delivery.Search(k=3), vectors=vectors)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_forgetful_sums_over_ranges(spark):
    rows = [(g, i, float(i % 17) + 1, i % 3 > 0) for g, n in (("a", 500), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, n int, v double, ok boolean").repartition(5)
    got = analytics.forgetful_sums(df, "g", "n", {"s": ("all", F.col("v")), "t": ("ok", F.col("v"))}, forgetting=0.99, among={"all": F.lit(True), "ok": F.col("ok")})
    for r in got.collect():
        own = [x for x in rows if x[0] == r.g]
        paid = [x for x in own if x[3]]
        want = [sum(x[2] * 0.99 ** (len(xs) - 1 - i) for i, x in enumerate(xs)) for xs in (own, paid)]
        assert (r.n_all, r.n_ok) == (len(own), len(paid)) and (r.s, r.t or 0.0) == (pytest.approx(want[0]), pytest.approx(want[1]))
    # no window runs to the end of a group, which takes time by the square of its rows
    o = df.select(F.col("g").alias("type"), F.col("n").alias("at"), F.col("v").alias("mb"), F.col("v").alias("tokens"), F.col("n").alias("chunks"), "ok")
    plan = model_choice.forgetful_profile(o)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan


def test_least_squares_takes_no_group_whole(spark):
    rows = [("a", i, float(i % 7), 3.0 + 2.0 * (i % 7) + (i % 5)) for i in range(300)] + [("b", i, float(i), -5.0 + 0.5 * i) for i in range(40)]
    rows += [("c", 1, None, 1.0), ("c", 2, 1.0, 1.0), ("d", 1, 2.0, -1.0), ("d", 1, 1.0, -3.0)]
    df = spark.createDataFrame(rows, "g string, n int, x double, y double")
    fit = analytics.least_squares(df, by="g", order="n", x="x", y="y")
    assert not re.search("Pandas|Python|Arrow", fit._jdf.queryExecution().executedPlan().toString())
    got = {r.g: (r.intercept, r.slope) for r in fit.collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        weight = 0.995 ** np.arange(len(own) - 1, -1, -1)
        fits = []
        for free in ([0, 1], [0], [1], []):
            design, beta = np.array([[1.0, r[2]] for r in own]), np.zeros(2)
            part, y = design[:, free], np.array([r[3] for r in own])
            beta[free] = np.linalg.solve(part.T @ (part * weight[:, None]) + 1e-3 * np.eye(len(free)), part.T @ (weight * y)) if free else []
            if (beta >= 0).all():
                fits.append((float((weight * (y - design @ beta) ** 2).sum() + 1e-3 * beta @ beta), beta.tolist()))
        assert got[g] == pytest.approx(tuple(min(fits)[1]))
    assert got["c"] == got["d"] == (0.0, 0.0)


def test_bootstrap_draws_some_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(i * i % 101)) for i in range(37)], "g string, v double")
    assert evaluation.DRAWS * 8 <= 1 << 23
    got = evaluation.bootstrap_interval(df, "g", "v", resamples=60_000).first()
    own = np.sort([float(i * i % 101) for i in range(37)])
    means = own[np.random.default_rng(20260824).integers(0, 37, size=(60_000, 37))].mean(axis=1)
    assert (got.low, got.high) == tuple(np.quantile(means, [0.025, 0.975]))


def test_weight_grid_sorts_no_candidates(spark):
    from rillmark.plans import evaluation as plans

    plan = plans.weight_grid(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_neighbours_in_tiles_keep_ties(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 6)
    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)], "id int, vector array<double>").repartition(3)
    got = [(r.query_id, r.item) for r in ranking.exact_neighbours(df.filter("id < 3"), df, k=4, block=2).orderBy("query_id", "rank").collect()]
    assert got == [(q, q + 3 * n) for q in range(3) for n in range(1, 5)]
