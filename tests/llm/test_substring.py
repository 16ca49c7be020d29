from __future__ import annotations

import random

import pytest

from rillmark.llm import substring


def brute(rows: list[tuple], window: int) -> dict:
    """Kept words by the definition, for rows (id, text) in order of batches, ids and texts."""
    seen, out = set(), []
    for name, text in rows:
        words = [w for w in (text or "").encode().split()]
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((name, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=repr)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def collect(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=repr)


@pytest.fixture
def rows():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünï", "a"]
    passage = [" ".join(r.choices(vocabulary, k=k)) for k in (6, 9, 14, 30)]
    out = []
    for i in range(120):
        text = " ".join(" ".join(r.choices(vocabulary, k=r.randint(0, 12))) + r.choice([" ", "\n", "\t"]) + r.choice(passage) for _ in range(r.randint(0, 4)))
        out.append((i * 3, text))
    out += [(5, "a " * 30), (8, "a b " * 12), (11, None), (14, ""), (17, " \n"), (3, out[4][1]), (3, out[4][1]), (None, out[9][1]), (None, None)]
    return out


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_matches_brute_force(spark, rows, batches):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collect(substring.deduplicate(docs, window=8, batches=batches)) == brute(order(rows), 8)


def test_later_batches_see_compacted_history(spark, rows):
    parts = [rows[:50], rows[50:90], rows[90:]]
    index = substring.SubstringIndex(spark, window=8)
    for n, part in enumerate(parts):
        done = [r for p in parts[:n] for r in order(p)]
        got = collect(index.add(spark.createDataFrame(part, "doc_id long, text string")))
        want = brute(done + order(part), 8)
        for row in brute(done, 8):
            want.remove(row)
        assert got == want
        index.compact()
        assert len(index.runs) == 1
        index.vacuum()


def test_texts_are_dealt_to_more_buckets_as_they_grow(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 600)
    parts = [rows[:10], rows[10:40], rows[40:]]
    index, buckets = substring.SubstringIndex(spark, window=8), []
    for n, part in enumerate(parts):
        done = [r for p in parts[:n] for r in order(p)]
        found = index.add(spark.createDataFrame(part, "doc_id long, text string"))
        buckets.append(index.buckets)
        want = brute(done + order(part), 8)
        for row in brute(done, 8):
            want.remove(row)
        assert collect(found) == want
    assert buckets[0] < buckets[-1]


def test_history_is_not_shuffled_again(spark, rows):
    index = substring.SubstringIndex(spark, window=8)
    index.add(spark.createDataFrame(rows[:60], "doc_id long, text string"))
    plan = index.add(spark.createDataFrame(rows[60:], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Bucketed: true" in line or "SelectedBucketsCount" in line]
    assert len(scans) == 2, plan


def test_long_documents_go_through_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(substring.wordhash, "PIECE_WORDS", 50)
    texts = [t for _, t in rows]
    pieces = list(substring.wordhash.pieces(texts, 8))
    places = [(int(p.document[s]), int(p.start[s])) for p in pieces for s in p.windows(8, 6)[0]]
    want = [(d, i) for d, t in enumerate(texts) for i in range(len((t or "").split()) - 7)]
    assert sorted(places) == want


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, block long, id string")
    assert substring.deduplicate(docs).count() == 0
    docs = spark.createDataFrame([(1, "x " * 25, 7, "n")], "doc_id long, text string, block long, id string")
    assert collect(substring.deduplicate(docs)) == brute([(1, "x " * 25)], 20)


def test_spans_cover_what_is_removed(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    spans = {r.doc_id: r.removed_spans for r in substring.deduplicate(docs).collect()}
    assert spans == {1: [], 2: [1, 26]}
