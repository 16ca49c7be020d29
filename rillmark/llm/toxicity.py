"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum_i w_i + sum_{i<j} <v_i, v_j>) over the terms i of a
text, so that two terms together can weigh more than each alone, as an insult
beside the mention of a group does.  Terms are lower-case words and the opening
letters of longer words, hashed to 64 bits, each counted once per text.

Training takes a bounded sample of labelled rows; terms are screened by how
much they tell about the label (likelihood ratio against what chance gives the
best of as many terms), which keeps the model small and long texts from
adding up noise.  A second screen looks at pairs: a term that tells nothing
alone is taken if it tells among the rows of a term that speaks for the label.
Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .storage import materialise

_WORD = re.compile(r"\w+")
#: Lengths of the opening letters that are terms of their own.
OPENINGS = (4, 5, 6)
#: Most labelled rows that training takes (those with the least hash of their id); they bound the terms of a model.
TRAIN_ROWS = 40_000
#: A term speaks for the label if its likelihood ratio is this many times what chance gives and its rows have the label twice as often.
STRONG = 4.0
#: Entries that a task gathers before it adds them up; a bound on memory only.
FLUSH = 300_000
#: Rows of pair counts.
PAIR = np.dtype([("strong", np.int64), ("term", np.uint64), ("total", np.int64), ("positive", np.int64)])
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 20, 256, 0.1, 1e-4


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted; none if it is null or empty."""
    words = set(_WORD.findall((text or "").lower()))
    words |= {f"{w[:n]}*" for n in OPENINGS for w in words if len(w) > n}
    return np.sort(np.fromiter((xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)))


@dataclass
class Model:
    """Sorted hashes of the known terms, their weights and factors, and the bias."""

    hashes: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bias: float

    def known(self, hashed: np.ndarray) -> np.ndarray:
        """Places in the model of the terms that it knows."""
        if not len(self.hashes) or not len(hashed):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return at[self.hashes[at] == hashed]

    def score(self, text: str | None) -> float:
        at = self.known(terms(text))
        v = self.factor[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weight[at].sum()) + pairs, -30, 30))))


def fit(hashes: np.ndarray, rows: list[np.ndarray], label: np.ndarray, seed: int = 1) -> Model:
    """AdaGrad on the log loss; ``rows`` hold places in the sorted ``hashes``."""
    r = np.random.default_rng(seed)
    n = len(hashes)
    w, v = np.zeros(n), r.normal(0, 0.01, (n, FACTORS))
    gw, gv, gb = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    rate = min(max(label.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    length = np.array([len(x) for x in rows], dtype=np.int64)
    for _ in range(EPOCHS if n else 0):
        order = r.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            flat = np.concatenate([rows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), length[batch])
            own = v[flat]
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, owner, own)
            squares = np.bincount(owner, (own**2).sum(axis=1), len(batch))
            raw = bias + np.bincount(owner, w[flat], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[batch]
            touched, index = np.unique(flat, return_inverse=True)
            dw = np.bincount(index, error[owner], len(touched)) / len(batch) + DECAY * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, index, error[owner, None] * (sums[owner] - own) / len(batch))
            dv += DECAY * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
            db = float(error.mean())
            gb += db**2
            bias -= RATE * db / np.sqrt(gb)
    return Model(hashes, w, v, bias)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of ids whose labels are never learnt from; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of ``labels`` over the texts of ``docs``.

    Learns from at most TRAIN_ROWS labelled ids that aren't held out, those with
    the least hash.  An id with several labels takes the largest, null labels
    and null ids are left out; rows of ``docs`` that repeat an id each count.
    A null text has no terms.  Without labelled rows, or with an empty table,
    the model knows no term and scores everything alike.  Other columns are
    ignored.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    sample = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    # the sample has at most TRAIN_ROWS rows of 12 bytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and positive rows of each term in a task; term 0 stands for all rows."""
        seen: list[np.ndarray] = []
        hits: list[np.ndarray] = []

        def sums() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t, n = np.concatenate(seen), np.concatenate(hits)
            names, index = np.unique(t, return_inverse=True)
            return names, np.bincount(index, n >> 32), np.bincount(index, n & 0xFFFFFFFF)

        held = 0
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.append(terms(text.as_py()), np.uint64(0))
                seen.append(own)
                hits.append(np.full(len(own), (1 << 32) + (label > 0), dtype=np.int64))
                held += len(own)
                if held > FLUSH:
                    names, total, positive = sums()
                    seen, hits, held = [names], [(total.astype(np.int64) << 32) + positive.astype(np.int64)], 0
        if seen:
            names, total, positive = sums()
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(total.astype(np.int64)), pa.array(positive.astype(np.int64))], names=["term", "total", "positive"])

    counts = materialise(texts.mapInArrow(count, "term long, total long, positive long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")), "terms")
    whole = counts.filter("term = 0").first()
    if whole is None or not 0 < whole.positive < whole.total:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros((0, FACTORS)), -30.0 if whole is None or not whole.positive else 30.0)
    vocabulary = counts.count()
    statistic = _statistic(F.col("total").cast("double"), F.col("positive").cast("double"), whole.total, whole.positive)
    telling = counts.filter("total > 2 and term <> 0").withColumn("g", statistic).filter(F.col("g") > float(np.log(vocabulary)))
    # distinct terms of at most TRAIN_ROWS texts
    hashes = np.sort(telling.select("term").toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))
    rows, label = _places(texts, hashes)
    strong = _speaking(rows, label, len(hashes), STRONG * float(np.log(vocabulary)))
    total, positive = (np.bincount(np.concatenate(rows), np.repeat(x, [len(r) for r in rows]), len(hashes)) for x in (np.ones(len(rows)), label))
    # where all rows of a term have the label there is nothing left to tell
    strong = strong[(positive[strong] > 2) & (total[strong] - positive[strong] > 2)]
    beside = _beside(texts, hashes[strong], total[strong], positive[strong]) if len(strong) else hashes[:0]
    if len(np.setdiff1d(beside, hashes)):
        hashes = np.union1d(hashes, beside)
        rows, label = _places(texts, hashes)
    return fit(hashes, rows, label)


def _places(texts: DataFrame, hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of each sampled text's terms in the sorted ``hashes``, and its label, in an order that reruns agree on."""
    shared = texts.sparkSession.sparkContext.broadcast(Model(hashes, np.zeros(0), np.zeros((0, FACTORS)), 0.0))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.known(terms(t.as_py())).astype(np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "places"])

    rows = texts.mapInArrow(places, "label int, places binary").toPandas().sort_values(["places", "label"])
    shared.destroy()
    return [np.frombuffer(x, dtype=np.int32) for x in rows["places"]], (rows["label"] > 0).to_numpy(dtype=np.float64)


def _speaking(rows: list[np.ndarray], label: np.ndarray, n: int, least: float) -> np.ndarray:
    """Terms that speak for the label, one after the other, each judged on the rows that none before it is in."""
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    left, chosen = np.ones(len(rows), dtype=bool), []
    while 0 < label[left].sum() < left.sum():
        use = left[owner]
        total, positive = np.bincount(flat[use], minlength=n), np.bincount(flat[use], label[owner[use]], n)
        share, rest, rest_positive = label[left].mean(), left.sum() - total, label[left].sum() - positive
        parts = ((positive, total * share), (total - positive, total * (1 - share)), (rest_positive, rest * share), (rest - rest_positive, rest * (1 - share)))
        g = 2 * sum(a * np.log(np.where(a > 0, a, 1.0) / np.where(a > 0, expected, 1.0)) for a, expected in parts)
        g[positive <= 2 * total * share] = 0
        if not n or g.max() <= least:
            break
        chosen.append(int(g.argmax()))
        left[owner[flat == chosen[-1]]] = False
    return np.array(chosen, dtype=np.int64)


def _beside(texts: DataFrame, strong: np.ndarray, total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Terms that tell about the label among the rows of one of the ``strong`` terms, which have these rows and positive rows."""
    order = np.argsort(strong)
    names, spark = strong[order], texts.sparkSession
    shared = spark.sparkContext.broadcast(Model(names, np.zeros(0), np.zeros((0, FACTORS)), 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and positive rows of each pair of a strong term's place and a term in a task."""
        parts: list[np.ndarray] = []
        held = 0

        def sums() -> np.ndarray:
            rows = np.concatenate(parts)
            # pairs in any order that brings equal ones together
            rows = rows[np.argsort(rows["term"] ^ (rows["strong"].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))]
            first = np.flatnonzero(np.concatenate([[True], (rows["term"][1:] != rows["term"][:-1]) | (rows["strong"][1:] != rows["strong"][:-1])]))
            out = rows[first]
            out["total"], out["positive"] = np.add.reduceat(rows["total"], first), np.add.reduceat(rows["positive"], first)
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms(text.as_py())
                at = shared.value.known(own)
                if not len(at):
                    continue
                rows = np.empty(len(at) * len(own), dtype=PAIR)
                rows["strong"], rows["term"], rows["total"], rows["positive"] = np.repeat(at, len(own)), np.tile(own, len(at)), 1, label > 0
                parts.append(rows)
                held += len(rows)
                if held > FLUSH:
                    parts = [sums()]
                    held = 0
        if parts:
            found = sums()
            yield pa.RecordBatch.from_arrays([pa.array(found[n].view(np.int64)) for n in PAIR.names], names=list(PAIR.names))

    pairs = texts.mapInArrow(count, "strong long, term long, total long, positive long").groupBy("strong", "term")
    pairs = materialise(pairs.agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")).filter("total > 2"), "pairs")
    # one row per strong term, of which each is in sampled rows of its own
    base = spark.createDataFrame([(i, int(total[k]), int(positive[k])) for i, k in enumerate(order)], "strong long, n long, p long")
    among = pairs.join(base, "strong")
    g = _statistic(F.col("total").cast("double"), F.col("positive").cast("double"), F.col("n").cast("double"), F.col("p").cast("double"))
    least = 2 * float(np.log(max(2, pairs.count())))
    found = among.withColumn("g", g).filter(F.col("g") > least).select("term").distinct().toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64)
    shared.destroy()
    return found


def _statistic(total: Column, positive: Column, rows: float | Column, positives: float | Column) -> Column:
    """Likelihood ratio of a term's rows and the rest against one common share of positives."""
    def part(a: Column, expected: Column) -> Column:
        return F.when(a > 0, a * F.log(a / expected)).otherwise(0.0)

    if not isinstance(rows, Column):
        rows, positives = F.lit(float(rows)), F.lit(float(positives))
    base, rest, rest_positive = positives / rows, rows - total, positives - positive
    return 2 * (part(positive, total * base) + part(total - positive, total * (1 - base)) + part(rest_positive, rest * base) + part(rest - rest_positive, rest * (1 - base)))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1, higher: likelier toxic) to every row.

    A null or empty text gets the bias alone; repeated rows stay, each with its
    score; a column of ``docs`` named ``out`` is replaced, all others are kept.
    An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(shared.value.score)

    return docs.withColumn(out, scored(F.coalesce(F.col(text_col), F.lit(""))))
