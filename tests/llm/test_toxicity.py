from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from rillmark.llm import toxicity


def test_machine_learns_an_interaction():
    """Neither term tells alone; both together do."""
    r = np.random.default_rng(0)
    hashes = np.arange(1, 5, dtype=np.uint64)
    rows = [np.flatnonzero(r.random(4) < 0.5).astype(np.int32) for _ in range(2000)]
    label = np.array([float((0 in x) == (1 in x)) for x in rows])
    model = toxicity.fit(hashes, rows, label)
    raw = []
    for x in rows:
        v = model.factor[x]
        raw.append(model.bias + model.weight[x].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())
    assert ((np.array(raw) > 0) == (label > 0)).mean() > 0.95


def corpus(n=900):
    r = random.Random(4)
    plain = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randint(5, 60))
        toxic = i % 7 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["zugrobe", "zugronk", "Zugroff", "blarg"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs, labels, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_rows_are_scored_well_and_never_learnt(spark, trained):
    docs, labels, model = trained
    truth = dict(labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    right = sum((got[i].score >= 0.3) == bool(truth[i]) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    again = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert (again.hashes == model.hashes).all() and (again.weight == model.weight).all()


def test_nulls_repeats_and_clashing_columns(spark, trained):
    _, _, model = trained
    rows = [(1, None, 1), (2, "", 1), (3, "zugronk " * 5000, 1), (3, "zugronk", 1), (None, "blarg", 1)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, term int"), model).collect()
    by = {(r.doc_id, len(r.text or "")): r.score for r in got}
    assert len(got) == 5 and by[(1, 0)] == by[(2, 0)] < 0.3 and by[(3, 40000)] == by[(3, 7)] > 0.3
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), labels)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_an_interaction_is_found_in_texts(spark):
    """A term that tells nothing alone makes another's texts toxic."""
    r = random.Random(11)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):
        words = r.choices(plain, k=r.randint(5, 25))
        insult, group = i % 10 == 0, i % 20 == 0 or i % 10 in (1, 2, 3)
        words += ["blarg"] * insult + ["zorp"] * group
        r.shuffle(words)
        # one in ten of the others keeps the mention as common among toxic rows as elsewhere
        toxic = insult and group or (i % 10 == 4 and i % 30 == 4) or (i % 10 == 5 and i % 60 == 5)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    base = " ".join(plain[:10])
    assert model.score(f"{base} blarg zorp") > 0.5 > model.score(f"{base} blarg") and model.score(f"{base} zorp") < 0.3


def test_score_matches_brute_force(spark, trained):
    _, _, model = trained
    place = {int(h): i for i, h in enumerate(model.hashes)}

    def slow(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        words |= {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}
        at = [place[h] for h in (xxhash.xxh64_intdigest(w) for w in words) if h in place]
        raw = model.bias + sum(model.weight[i] for i in at)
        raw += sum(float(model.factor[i] @ model.factor[j]) for n, i in enumerate(at) for j in at[:n])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))

    texts = ["zugrobe and blarg", "word1 word2", None, "", "Zugroff! word3-word4 blarg BLARG", "zugronk " * 4000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got == {i: pytest.approx(slow(t), abs=1e-9) for i, t in enumerate(texts)}
