"""The delivered search on rows that exercise its filters, ties and re-ranking."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rillmark.operators import delivery, lexical
from rillmark.operators.delivery import Search

CHUNKS = "chunk_id string, doc string, ordinal int, trail string, text string, vector array<double>"
DOCUMENTS = "doc string, root string, path string, mtime double"


@pytest.fixture(scope="module")
def corpus(spark):
    """Two versions of a plan, one path in two roots, a meeting, and a document without a time."""
    documents = [
        ("d1", "a", "plans/plan_v1.txt", 10.0),
        ("d2", "a", "plans/plan_v2.txt", 20.0),
        ("d3", "a", "notes/budget.txt", 30.0),
        ("d4", "b", "notes/budget.txt", 30.0),
        ("d5", "a", "meetings/zebra.vtt", None),
    ]
    chunks = [
        ("d1:0", "d1", 0, "", "alpha CT-2024-0142 first", [1.0, 0.0]),
        ("d2:0", "d2", 0, "", "alpha CT 0142 2024", [0.9, 0.1]),
        ("d2:1", "d2", 1, "alpha", "closing words", None),
        ("d3:0", "d3", 0, "", "opening", [0.0, 1.0]),
        ("d3:1", "d3", 1, "", "beta figures", [0.1, 0.9]),
        ("d4:0", "d4", 0, "", "beta", [0.0, float("nan")]),
        ("d5:0", "d5", 0, None, None, None),
    ]
    queries = spark.createDataFrame([(1, "alpha plan", [1.0, 0.0]), (2, "beta budget", [0.0, 1.0]), (3, "zebra", None), (4, "", None), (5, "CT-2024-0142", None)], "query_id int, text string, vector array<double>")
    return queries.cache(), spark.createDataFrame(chunks, CHUNKS).cache(), spark.createDataFrame(documents, DOCUMENTS).cache()


def hits(found, *columns):
    out: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_codes_are_phrases_in_one_column(spark, corpus):
    queries, chunks, _ = corpus
    found = lexical.bm25_fields(queries, chunks, k=5, fields={"text": 1.0, "trail": 2.0})
    # d2:0 holds a token less than d1:0
    assert hits(found, "item") == {1: ["d2:1", "d2:0", "d1:0"], 2: ["d4:0", "d3:1"], 5: ["d1:0"]}


def test_repeated_terms_count_as_often(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "z"), ("e", "z")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "x"), (2, "x x y")], "query_id int, text string")
    got = {(r.query_id, r.item): r.score for r in lexical.bm25_fields(queries, rows, k=5, fields={"text": 1.0}).collect()}
    assert got[2, "a"] == pytest.approx(2 * got[1, "a"], abs=2e-6) and got[2, "b"] == got[1, "a"]
    empty = lexical.bm25_fields(queries, rows.limit(0), k=5, fields={"text": 1.0})
    assert empty.count() == 0


def test_passages_of_current_documents(corpus):
    found = delivery.passages(*corpus, Search(k=5, lexical=1.0, window=1)).cache()
    assert [(c, s) for c, s in hits(found, "chunk_id", "sources")[1] if c.startswith("d2")][0] == ("d2:0", ["dense", "lexical", "name"])
    assert not any(c.startswith("d1") for c in hits(found, "chunk_id")[1])
    first = found.filter("query_id = 1 and chunk_id = 'd2:0'").first()
    assert first.older == ["plans/plan_v1.txt"] and first.formats == ["txt"]
    # d2:1 is a hit of its own, so it is no context
    assert first.after == "" and "d2:1" in hits(found, "chunk_id")[1]
    # a name adds to one chunk of its path, the best that was found: 1/61 + 1/63 for d3:0, 2/62 for d3:1
    assert [c for c, s in hits(found, "chunk_id", "sources")[2] if "name" in s] == ["d3:0"]
    assert hits(found, "chunk_id", "sources")[3] == [("d5:0", ["lexical", "name"])]
    assert 4 not in hits(found, "chunk_id")


def test_older_versions_on_request(corpus):
    found = delivery.passages(*corpus, Search(k=5, older=True)).cache()
    assert {"d1:0", "d2:0"} <= set(hits(found, "chunk_id")[1])
    assert found.filter("size(older) > 0").count() == 0


def test_filters(corpus):
    inside = delivery.passages(*corpus, Search(k=5, folder="/plans/", until=15.0))
    assert {r.path for r in inside.collect()} == {"plans/plan_v1.txt"}
    late = hits(delivery.passages(*corpus, Search(k=5, since=25.0)), "doc")
    # names pass without a time, chunks don't
    assert set(late[2]) == {"d3", "d4"} and late[3] == ["d5"] and set(late[1]) == {"d3"}
    one = hits(delivery.passages(*corpus, Search(k=5, root="b")), "doc")
    assert one == {2: ["d4"]}


def test_documents_by_their_first_chunks(corpus):
    found = delivery.documents_found(*corpus, Search(k=5)).cache()
    assert hits(found, "doc")[1][0] == "d2" and "d1" not in hits(found, "doc")[1]
    # the name adds to both documents of the path
    assert {d for d, s in hits(found, "doc", "sources")[2] if "name" in s} == {"d3", "d4"}
    assert hits(found, "doc", "snippet")[3] == [("d5", "")]
    assert found.filter("query_id = 2 and doc = 'd3'").first().snippet == "opening"
    assert 4 not in hits(found, "doc")


def test_names_of_meetings_may_weigh_nothing(corpus):
    assert 3 not in hits(delivery.documents_found(*corpus, Search(k=5, dense=0.0, lexical=0.0, names_by_group=True)), "doc")


def test_rerank_moves_the_head_only(corpus):
    longest = lambda head: head.select("query_id", "item", F.coalesce(F.length("text"), F.lit(0)).alias("model"))
    search = Search(k=5, dense=0.0, name=0.0, older=True, rerank=longest, head=2)
    plain = hits(delivery.passages(*corpus, Search(k=5, dense=0.0, name=0.0, older=True)), "chunk_id")
    moved = hits(delivery.passages(*corpus, search), "chunk_id", "text")
    for query, before in plain.items():
        after = [c for c, _ in moved[query]]
        assert sorted(after[:2]) == sorted(before[:2]) and after[2:] == before[2:]
        lengths = [len(t or "") for _, t in moved[query][:2]]
        assert lengths == sorted(lengths, reverse=True)


def test_reorder_fuses_by_weight(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, item string, rank int")
    scores = spark.createDataFrame([(1, "b", 9.0), (1, "a", 1.0)], "query_id int, item string, model double")
    order = lambda **kw: hits(delivery.reorder(results, scores, **kw), "item")
    assert order(head=3) == {1: ["b", "a", "c"], 2: ["x"]}
    # equal sums keep the old order
    assert order(head=3, weight=1.0)[1] == ["a", "b", "c"] and order(head=3, weight=2.0)[1] == ["b", "a", "c"]
    assert order(head=1)[1] == ["a", "b", "c"]


def test_bounds_of_a_request():
    for wrong in ({"k": 0}, {"k": 51}, {"window": 4}):
        with pytest.raises(ValueError):
            Search(**wrong)
