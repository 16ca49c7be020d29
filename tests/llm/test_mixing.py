from __future__ import annotations

import random

import pytest

from rillmark.llm import mixing


def share_out(sizes: dict, weights, share, most):
    """Targets by resharing the excess until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_match_resharing(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 50, 900]) if seed else 30 for s in ["a", "B", "é", "", None, "zz", "src10", "src9"][: 3 + seed]}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, weights=(3, 1, 2), share=1.5, most=2.0).collect()}
    want = share_out(sizes, (3, 1, 2), 1.5, 2.0)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def corpus():
    r = random.Random(3)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else r.choice(["a", "b", None, "c"])
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 9, 40])), source, i))
    return rows + [(7, "w w w", "a", 1), (7, "w w w", "a", 2), (7, "w w", "a", 3), (None, "w", "b", 4), (9000, None, "b", 5), (9001, " \n", None, 6)]


def test_taken_words_are_near_targets_and_reruns_agree(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, plan long")
    mixed = mixing.curriculum(df.repartition(5))
    got = mixed.collect()
    assert mixed.columns[:4] == df.columns and sorted((tuple(r[:4]) for r in got), key=repr) == sorted(rows, key=repr)
    # ranks are the order by position, each once
    copies = sorted((t, n) for r in got for t, n in zip(r["__positions"], r["__ranks"]))
    assert [n for _, n in copies] != [] and sorted(n for _, n in copies) == list(range(len(copies)))
    assert all(a[0] == b[0] or a[1] < b[1] for a, b in zip(copies, copies[1:]))
    sizes: dict = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = share_out(sizes, (3, 1, 2), 1.5, 2.0)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert all(r["__target"] == pytest.approx(target) and r["__source_size"] == sizes[source] for r in own)
        taken = sum(r["__size"] * r["__copies"] for r in own)
        assert abs(taken - target) <= 20 and max(r["__copies"] for r in own) <= 2
    again = mixing.curriculum(df.repartition(2)).collect()
    key = lambda r: (r.doc_id, r.text, r["__copies"], tuple(r["__positions"]))
    assert sorted(map(key, got), key=repr) == sorted(map(key, again), key=repr)


def test_positions_invert_the_cumulative_demand(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    ramps = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
    rows = mixing.curriculum(df, ramps=ramps).collect()
    for n, (a, b) in enumerate(ramps):
        own = sorted(t for r in rows if r.source == f"s{n}" for t in r["__positions"])
        for t, part in ((own[len(own) // 4], 0.25), (own[len(own) // 2], 0.5)):
            assert (a * t + (b - a) * t * t / 2) / ((a + b) / 2) == pytest.approx(part, abs=0.01)
    order = mixing.training_order(mixing.curriculum(df)).collect()
    assert [r["rank"] for r in order] == list(range(sum(r["__copies"] for r in rows)))
    assert [r.position for r in order] == sorted(t for r in rows for t in r["__positions"])


def test_ranks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BINS", 7)
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.curriculum(df).collect()
    copies = sorted(zip([t for r in rows for t in r["__positions"]], [n for r in rows for n in r["__ranks"]]))
    assert sorted(n for _, n in copies) == list(range(len(copies)))
    assert all(a[0] == b[0] or a[1] < b[1] for a, b in zip(copies, copies[1:]))


def test_other_schedules_give_another_order(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    order = [[r.doc_id for r in mixing.training_order(mixing.curriculum(df, ramps=ramps)).collect()] for ramps in (((1.5, 0.5), (0.5, 1.5)), ((0.1, 9.0),))]
    assert sorted(order[0]) == sorted(order[1]) and order[0] != order[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.curriculum(df).count() == 0
