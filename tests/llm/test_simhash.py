from __future__ import annotations

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from rillmark.llm import blocks, simhash, simhash_similarity


def shingles(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def slow_print(text, k):
    hashes = [xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def group(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    vocabulary = [f"Word{i}" for i in range(300)] + ["É", "é"]
    bases = [r.choices(vocabulary, k=r.choice([3, 40, 120])) for _ in range(25)]
    out = []
    for i in range(260):
        words = list(bases[0] if i % 3 == 0 else r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i * 5 % 1301, r.choice([" ", "\n"]).join(words)))
    return out + [(2000, None), (2001, ""), (2002, " \t"), (2003, "one two"), (2004, "ONE two")]


@pytest.mark.parametrize("chunk", [1024, 8])
def test_components_match_brute_force(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {i: slow_print(t, 4) for i, t in rows}
    ids = list(prints)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = group(ids, linked)
    assert got == {i: (prints[i], label[i]) for i in ids}


def test_block_masks_find_every_close_pair():
    r = random.Random(4)
    for rows in (10, 1 << 25, 1 << 40):
        masks = simhash.block_masks(4, rows)
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_similarity_matches_exact_jaccard(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash_similarity.near_duplicates(df).collect()}
    sets = {i: frozenset(shingles(t, 5)) for i, t in rows}
    ids = list(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] == sets[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == group(ids, linked)


@pytest.mark.parametrize("chunk", [512, 64])
def test_similarity_links_a_star_of_edited_copies(spark, monkeypatch, chunk):
    """Copies at 0.8 and more to one original, below that to one another: the original's links alone hold them together."""
    monkeypatch.setattr(simhash_similarity, "CHUNK_ROWS", chunk)
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):
        words = list(base)
        for at in r.sample(range(10, 390, 10), 8):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    sets = [frozenset(shingles(t, 5)) for _, t in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(alike(sets[0], s) for s in sets) and not alike(sets[1], sets[2])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash_similarity.near_duplicates(df).collect()}
    assert sum(c != 0 for c in got.values()) <= 10  # block keys may miss a pair at the threshold


def test_spanning_forest_has_least_distances():
    r = np.random.default_rng(1)
    left, right = np.triu_indices(30, 1)
    keep = r.random(len(left)) < 0.3
    left, right = left[keep], right[keep]
    distance = r.integers(0, 20, len(left))
    chosen = simhash_similarity._spanning(left, right, distance, 30)
    for d in range(20):
        whole = blocks.components_of(30, left[distance <= d], right[distance <= d])
        some = chosen[distance[chosen] <= d]
        assert (blocks.components_of(30, left[some], right[some]) == whole).all()


def test_a_null_id_links_and_joins_groups(spark):
    rows = [(9, 0b0), (None, 0b1111), (7, 0b11111111), (None, -1), (3, 0b0)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = sorted(((r.fingerprint, r.component_id) for r in simhash.hamming_components(df, distance=4).collect()), key=repr)
    assert got == sorted([(0, 3), (0, 3), (15, 3), (255, 3), (-1, None)], key=repr)


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash_similarity.near_duplicates])
def test_empty_nulls_and_clashing_columns(spark, operator):
    schema = "doc_id long, text string, node long, component_id string, fingerprint int"
    assert operator(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1, "x", 1), (7, "a b c d e f", 1, "x", 1), (None, "q", 1, "x", 1)]
    got = sorted(((r.doc_id, r.component_id) for r in operator(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == [(7, 7), (None, 7), (None, None)]
