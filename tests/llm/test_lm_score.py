from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from xxhash import xxh64_intdigest

from rillmark.llm import lm_score


def brute(rows, target):
    """The models with plain dictionaries."""
    def classes(text):
        return [xxh64_intdigest(w) % lm_score.CLASSES for w in (text or "").encode().lower().split()]

    def pair(a, b):
        return ((a * lm_score.CLASSES + b) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - 21)

    models = []
    for chosen in (target, None):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for i, t in rows:
            if chosen is None or i in chosen:
                before = lm_score.CLASSES
                for c in classes(t):
                    uni[c] += 1
                    ctx[before] += 1
                    bi[pair(before, c)] += 1
                    before = c
        models.append((uni, ctx, bi, sum(uni.values())))
    out = []
    for i, t in rows:
        means = []
        for uni, ctx, bi, n in models:
            before, loss = lm_score.CLASSES, []
            for c in classes(t):
                p = (uni[c] + lm_score.UNIGRAM_PRIOR) / (n + lm_score.UNIGRAM_PRIOR * lm_score.CLASSES)
                loss.append(-math.log((bi[pair(before, c)] + lm_score.BIGRAM_PRIOR * p) / (ctx[before] + lm_score.BIGRAM_PRIOR)))
                before = c
            means.append(sum(loss) / len(loss) if loss else None)
        out.append((i, len(classes(t)), *means))
    return out


def test_matches_brute_force(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(["good", "Fine", "é"] if i % 4 == 0 else ["bad", "worse", "é"], k=r.randint(0, 30)))) for i in range(150)]
    rows += [(3, "good good"), (3, None), (None, "bad bad"), (900, " \t")]
    target = {i for i in range(0, 150, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in target] + [(0,), (None,), (5555,)], "doc_id long")
    got = lm_score.cross_entropy_difference(docs, ids).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key), sorted(brute(rows, target), key=key), strict=True):
        assert a[:2] == b[:2] and (a[2:] == b[2:] if b[2] is None else a[2:] == pytest.approx(b[2:], rel=1e-5))
    mean = {side: sum(x.difference for x in got if x.doc_id is not None and x.n_tokens and (x.doc_id in target) == side) for side in (True, False)}
    assert mean[True] < mean[False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    ids = spark.createDataFrame([], "doc_id long")
    assert lm_score.cross_entropy_difference(none, ids).count() == 0
    one = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, target int")
    assert lm_score.cross_entropy_difference(one, ids).first().n_tokens == 2


@pytest.mark.parametrize("tokens", [1 << 20, 500])
def test_words_and_bigrams_are_not_merged(spark, monkeypatch, tokens):
    """Against strings as keys, with words whose hashes agree in their low bits, over one block and several."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", tokens)
    groups: dict = {}
    for i in range(20000):
        groups.setdefault(xxh64_intdigest(b"w%d" % i) % (1 << 17), []).append(f"w{i}")
    vocabulary = [w for g in groups.values() if len(g) > 1 for w in g][:600]
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(vocabulary[: 300 if i % 2 else 600], k=r.randint(0, 40)))) for i in range(200)]
    models = []
    for chosen in (rows[::5], rows):
        uni, ctx, bi = Counter(), Counter(), Counter()
        for _, t in chosen:
            words = t.split()
            uni.update(words)
            ctx.update(["", *words][: len(words)])
            bi.update(zip(["", *words], words))
        models.append((uni, ctx, bi, sum(uni.values())))
    want = {}
    for i, t in rows:
        words = t.split()
        for uni, ctx, bi, n in models:
            p = [(uni[w] + lm_score.UNIGRAM_PRIOR) / (n + lm_score.UNIGRAM_PRIOR * lm_score.CLASSES) for w in words]
            loss = [-math.log((bi[a, b] + lm_score.BIGRAM_PRIOR * q) / (ctx[a] + lm_score.BIGRAM_PRIOR)) for a, b, q in zip(["", *words], words, p)]
            want.setdefault(i, []).append(sum(loss) / len(loss) if loss else None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ids = spark.createDataFrame([(i,) for i, _ in rows[::5]], "doc_id long")
    got = {x.doc_id: [x.target_loss, x.background_loss] for x in lm_score.cross_entropy_difference(docs, ids).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == (pytest.approx(want[i], rel=1e-9) if want[i][0] is not None else want[i]) for i in want)
