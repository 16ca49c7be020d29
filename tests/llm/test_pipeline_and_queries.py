"""The pipeline's stages against brute force, and the queries that have SQL."""

from __future__ import annotations

import base64
import hashlib

import duckdb
import pytest
import tiktoken

import corpus_pipeline
from rillmark.llm import mixing, queries, toxicity

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()[name](spark, SF_DIR).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


CONTRACT = {
    "op1_embedding_dedup": ["vec_id bigint", "n_links bigint", "component_id bigint", "kept boolean"],
    "op2_bpe": ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"],
    "op3_lm_difference": ["doc_id bigint"],
    "op4_simhash": ["doc_id bigint", "fingerprint string", "component_id bigint"],
    "op5_jump_sharding": ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"],
    "op6_toxicity": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op7_substring_index": ["doc_id bigint", "n_words bigint", "n_removed bigint", "kept_sha256 string"],
    "op8_curriculum": ["doc_id bigint", "size bigint", "source_size bigint", "target double", "taken bigint"],
    "op9_hash_forest": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
    "op10_warc": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_columns(spark, name):
    frame = queries.queries()[name](spark, SF_DIR)
    assert [f"{n} {t}" for n, t in frame.dtypes][: len(CONTRACT[name])] == CONTRACT[name]
    key = frame.columns[0]
    rows = frame.select(key).collect()
    source = {"vec_id": "embeddings", "page_id": "pages", "doc_id": "documents"}.get(key)
    assert source is None or sorted(r[0] for r in rows) == sorted(r[0] for r in queries.table(spark, SF_DIR, source).select(key).collect())


def test_substring_query_matches_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, SF_DIR, "documents").collect())
    seen, want = set(), []
    for name, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want.append((name, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r) for r in queries.op7_substring_index(spark, SF_DIR).collect()) == want


def test_bpe_query_matches_the_tokenizer_library(spark):
    path, pattern = queries.vocabulary()
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path, "rb"))}
    coder = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in queries.table(spark, SF_DIR, "documents").collect():
        ids = coder.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.op2_bpe(spark, SF_DIR).collect()) == sorted(want)


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), name)
        steps[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS

    before, after = steps["toxicity"]
    model = toxicity.train(queries.table(spark, SF_DIR, "documents"), queries.table(spark, SF_DIR, "labels"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if model.score(r.text) < queries.TOXIC_FROM)

    before, after = steps["simhash_near_dedup"]
    sets, label = {r.doc_id: shingles(r.text) for r in before}, {}
    for i in sorted(sets):
        near = [label[j] for j in label if sets[i] == sets[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        low = min([i, *near])
        label |= {j: low for j in label if label[j] in near} | {i: low}
    assert sorted(r.doc_id for r in after) == sorted(i for i in label if label[i] == i)

    before, after = steps["substring_dedup"]
    seen, want = set(), {}
    for r in sorted(before):
        words = r.text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        if not any(gone):
            want[r.doc_id] = r.text
        elif not all(gone):
            want[r.doc_id] = b" ".join(w for w, g in zip(words, gone) if not g).decode()
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after if r.text)

    before, after = steps["source_mixing"]
    mixed = mixing.curriculum(spark.createDataFrame(before, docs_schema(spark))).collect()
    copies = {r.doc_id: r["__copies"] for r in mixed}
    got: dict = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in copies.items() if n}

    order = [r.doc_id for r in mixing.training_order(mixing.curriculum(spark.createDataFrame(before, docs_schema(spark)))).collect()]

    before, after = steps["byte_level_bpe"]
    assert [r.doc_id for r in sorted(after, key=lambda r: (r.part, r.place))] == order
    assert sorted((r.doc_id, r.source) for r in after) == sorted((r.doc_id, r.source) for r in before)
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    schema = "doc_id long, text string, tags map<string,int>, group int, row string"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, {"a": 1}, 1, "x"), (1, "other words here now again", None, 2, None), (None, long + " w60", {}, 3, "y"), (None, "quite unlike all of these others", {"b": 2}, 4, "z")]
    rows += [(4, long, {"a": 2}, 5, "r"), (1, long, {"a": 1}, 1, "x")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF_DIR)
    assert kept.columns == ["doc_id", "text", "tags", "group", "row"]
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([rows[0], rows[1], rows[3]], key=repr)


def docs_schema(spark):
    return queries.table(spark, SF_DIR, "documents").schema


def test_stages_take_nulls_and_empty_tables(spark):
    schema = docs_schema(spark)
    text = "one two three four five six"
    rows = [(1, text, "en", "a", 27), (2, text, None, None, None), (None, None, None, None, None), (None, text, "en", "a", 3), (3, "", "en", "b", 0), (1, text, "en", "a", 27)]
    for frame, least in ((spark.createDataFrame(rows, schema), 2), (spark.createDataFrame([], schema), 0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF_DIR), name)
        assert docs.count() >= least
