from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from rillmark.llm import bpe, queries

TEXTS = ["", " ", "  \n\n x", "Hello world's   end\r\n", "don't 'LL 123 4567", "naïve café ßß 漢字 🙂🙂", "a" * 300, "ab" * 200, "\x1c\x85　y", "x\t y", " lead", "trail "]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(queries.vocabulary()[0])
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cases():
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", "'", "a", "B", "é", "ß", "1", "23", "!", "\x1c", "\x85", "\xa0", "漢", "🙂", "ing", " the", "aaaaaaa", "\r\n", "'ll", "_"]
    return TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)]


def test_matches_the_tokenizer_library_and_decodes(spark, reference):
    rows = list(enumerate([*cases(), None]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(df, *queries.vocabulary()).collect()}
    assert got == {i: (reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}


def test_digests(spark, reference):
    df = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, None)], "doc_id long, text string")
    got = bpe.token_digests(bpe.encode_decode(df, *queries.vocabulary()), "doc_id").collect()
    ids = ",".join(map(str, reference.encode_ordinary("some text")))
    want = (1, ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"some text").hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got), key=repr) == sorted([want, want, (None, 0, empty, empty)], key=repr)


def test_merges_of_lower_rank_that_a_merge_makes_possible():
    # (ab)(c) has a lower rank than ab: a word must make it before its second ab
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 260, b"ca": 290, b"bcab": 310}
    replay, encoding = bpe.MergeReplay(ranks), tiktoken.Encoding("t", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    words = {"".join(r.choices("abc", k=r.randint(1, 12))) for _ in range(500)}
    for word, ids in zip(words, replay([w.encode() for w in words])):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == encoding.encode_ordinary(word)


def test_small_memo_gives_the_same(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)
    codec = bpe.Codec(bpe.read_ranks(queries.vocabulary()[0]), public_tokenizers.PATTERN)
    for text in cases()[:200]:
        assert codec.encode([text])[0].tolist() == reference.encode_ordinary(text)
        codec.forget()


def test_empty_table_and_kept_columns(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    assert bpe.encode_decode(spark.createDataFrame([], schema), *queries.vocabulary()).count() == 0
    got = bpe.encode_decode(spark.createDataFrame([(1, "x", "own", 5)], schema).withColumnRenamed("ids", "tag"), *queries.vocabulary(), keep=("tag",)).first()
    assert got.tag == "own" and bytes(got.decoded) == b"x"
