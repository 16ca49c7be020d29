"""Cross-entropy difference of matched n-gram models.

Two bigram models, interpolated with unigrams, are counted over the corpus: the
background over every document, the target over the documents of the target
set.  They are matched: one vocabulary, one order, one smoothing.  Every word
and every bigram has a count of its own, by 64-bit hashes, so the count tables
grow with the corpus; they are spread over segments of the hash range and never
held in one place.  A document's score is the mean over its tokens of the
target's loss minus the background's; the lower, the more it resembles the
target.

Documents are packed into blocks of about BLOCK_TOKENS tokens.  A block sends
every segment its distinct keys with their counts in the block, so a frequent
word is one entry per block; the segment sums them and sends each block the
sums of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .storage import materialise
from .wordhash import HIGH, _mix

#: Words that the unigram prior is spread over, at least; more if the corpus has more.
CLASSES = 1 << 17
#: Pseudo-counts: of each word in a unigram model, of the unigram model in a bigram model.
UNIGRAM_PRIOR, BIGRAM_PRIOR = 0.1, 4.0
BLOCK_TOKENS = 1 << 20
#: Bytes of text per segment of the count tables, and segments at least.
SEGMENT_BYTES, SEGMENTS = 1 << 26, 64
#: Stands for the start of a text.
_START = np.uint64(0x5851F42D4C957F2D)
#: Kinds of counts: of words as tokens, of words as contexts, of pairs.
_KINDS = 3


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def events(tokens: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Keys of every position of texts laid end to end: token, context and pair."""
    context = np.concatenate([[_START], tokens[:-1]])[: len(tokens)]
    context[(np.cumsum(lengths) - lengths)[lengths > 0]] = _START
    return [tokens, context, _mix(context * np.uint64(HIGH) + tokens)]


def losses(token: np.ndarray, context: np.ndarray, pair: np.ndarray, total: float, words: int) -> np.ndarray:
    """Negative log probability from the counts of each position."""
    unigram = (token + UNIGRAM_PRIOR) / (total + UNIGRAM_PRIOR * words)
    return -np.log((pair + BIGRAM_PRIOR * unigram) / (context + BIGRAM_PRIOR))


def _press(values: np.ndarray) -> bytes:
    """Integers in planes of bytes, most of them zero, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def _unpress(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[-8:], "little")
    planes = np.frombuffer(pa.decompress(blob[:-8], 8 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1)


def _pack(marked: DataFrame, id_type: T.DataType) -> DataFrame:
    """Blocks of whole documents: their ids, lengths and target flags, distinct words and the place of every token's word."""
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type))]
        + [T.StructField(c, T.BinaryType()) for c in ("lengths", "target", "vocabulary", "places")]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_target")]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, flags, hashes, lengths, have = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            own, n, target = pa.concat_arrays(ids), np.array(lengths, dtype=np.int64), np.array(flags, dtype=np.int64)
            vocabulary, places = np.unique(np.concatenate(hashes), return_inverse=True)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            columns += [pa.array([_press(x)], pa.binary()) for x in (n, target, vocabulary, places)]
            columns += [pa.array([int(x)], pa.int64()) for x in (n.sum(), n[target > 0].sum())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            done = 0
            for at, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode().lower().split()
                hashes.append(word_hashes(words))
                lengths.append(len(words))
                flags.append(bool(batch.column(2)[at].as_py()))
                have += len(words)
                if have >= BLOCK_TOKENS:
                    ids.append(batch.column(0).slice(done, at + 1 - done))
                    yield block()
                    number, done, have = number + 1, at + 1, 0
                    ids, flags, hashes, lengths = [], [], [], []
            if done < batch.num_rows:
                ids.append(batch.column(0).slice(done))
        if lengths:
            yield block()

    return marked.mapInArrow(pack, schema)


def _block_events(lengths: bytes, vocabulary: bytes, places: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n = _unpress(lengths).astype(np.int64)
    return n, events(_unpress(vocabulary)[_unpress(places).astype(np.int64)], n)


def _count(blocks: DataFrame, segments: int) -> DataFrame:
    """Sums of both models for the distinct keys of every block, by segment, in the order of the keys.

    ``words`` is the number of distinct words of the segment.
    """
    names = [f"{c}{k}" for k in range(_KINDS) for c in ("keys", "all", "target")]
    sums = [f"{c}{k}" for k in range(_KINDS) for c in ("all", "target")]
    edges = np.array([(i << 64) // segments for i in range(1, segments)], dtype=np.uint64)

    def ddl(blobs: list[str]) -> str:
        return ", ".join(f"{c} binary" for c in blobs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, found = _block_events(row["lengths"], row["vocabulary"], row["places"])
                aim = np.repeat(_unpress(row["target"]), n).astype(np.float64)
                parts = []
                for keys in found:
                    own, index, count = np.unique(keys, return_inverse=True, return_counts=True)
                    hits = np.bincount(index, weights=aim, minlength=len(own)).astype(np.int64)
                    cuts = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
                    parts.append((own, count, hits, cuts))
                for s in range(segments):
                    blobs = [_press(x[cuts[s] : cuts[s + 1]]) for own, count, hits, cuts in parts for x in (own, count, hits)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([row["block"]], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]],
                        names=["segment", "block", *names],
                    )

    def answer(now: int, asked: list[dict]) -> Iterator[pa.RecordBatch]:
        out, words = [[] for _ in asked], 0
        for k in range(_KINDS):
            parts = [_unpress(r[f"keys{k}"]) for r in asked]
            own, index = np.unique(np.concatenate(parts), return_inverse=True)
            words = len(own) if k == 0 else words
            cuts = np.cumsum([len(x) for x in parts])[:-1]
            for c in ("all", "target"):
                each = np.concatenate([_unpress(r[f"{c}{k}"]) for r in asked]).astype(np.float64)
                whole = np.bincount(index, weights=each, minlength=len(own)).astype(np.int64)
                for o, x in zip(out, np.split(whole[index], cuts)):
                    o.append(_press(x))
        for r, blobs in zip(asked, out):
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([words], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]],
                names=["segment", "block", "words", *sums],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if asked and row["segment"] != now:
                    yield from answer(now, asked)
                    asked = []
                now = row["segment"]
                asked.append(row)
        if asked:
            yield from answer(now, asked)

    sent = blocks.select("block", "lengths", "target", "vocabulary", "places").mapInArrow(send, f"segment int, block long, {ddl(names)}")
    return sent.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(add, f"segment int, block long, words long, {ddl(sums)}")


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Losses of every row's whole text under both models.

    Returns ``id_col``, ``n_tokens``, ``target_loss``, ``background_loss`` (means
    over the tokens) and ``difference`` (target minus background).  The target
    model is counted over the rows whose id is in ``target_ids`` (column
    ``id_col``; repeats and nulls there do not matter), the background over all.
    A text without words (null, empty, blank) has 0 tokens and null losses;
    repeated rows count as often as they stand; an empty target leaves its model
    at the prior; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    # target ids grow with the corpus, so they are joined by a shuffle at every size
    ids = target_ids.select(F.col(id_col).alias("__target_id")).distinct().hint("merge")
    marked = rows.join(ids, rows[id_col] == ids["__target_id"], "left").select(id_col, "text", F.col("__target_id").isNotNull().alias("target"))
    own = rows.schema[id_col].dataType
    blocks = materialise(_pack(marked, own), "blocks")
    segments = max(SEGMENTS, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SEGMENT_BYTES))
    counts = materialise(_count(blocks, segments), "counts")
    total, total_target = (float(x or 0) for x in blocks.agg(F.sum("n_tokens"), F.sum("n_target")).first())
    words = counts.groupBy("segment").agg(F.max("words").alias("words")).agg(F.sum("words")).first()[0]
    words = max(CLASSES, words or 0)
    whole = blocks.withColumn("segment", F.lit(-1)).drop("target", "n_tokens", "n_target").unionByName(counts.drop("words"), allowMissingColumns=True)
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = whole.repartition(partitions, "block").sortWithinPartitions("block", "segment")
    schema = T.StructType([T.StructField(id_col, own), T.StructField("n_tokens", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss")])

    def finish(ids: pa.Array, head: dict, answers: list[dict]) -> pa.RecordBatch:
        n, found = _block_events(head["lengths"], head["vocabulary"], head["places"])
        at = [np.unique(keys, return_inverse=True)[1] for keys in found]
        # a document starts where the one before it ends; sums of empty ones are dropped
        bounds, full, means = np.cumsum(n) - n, n > 0, []
        for model, every in (("target", total_target), ("all", total)):
            mine = [np.concatenate([_unpress(a[f"{model}{k}"]) for a in answers]).astype(np.float64)[at[k]] for k in range(_KINDS)]
            mean = np.zeros(len(n))
            if full.any():
                mean[full] = np.add.reduceat(losses(*mine, every, words), bounds[full]) / n[full]
            means.append(pa.array(mean, pa.float64(), mask=~full))
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *means], names=schema.names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, head, answers = None, None, []
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                if row["segment"] >= 0:
                    answers.append(row)
                    continue
                if head is not None:
                    yield finish(ids, head, answers)
                ids, head, answers = lists[i].values, row, []
        if head is not None:
            yield finish(ids, head, answers)

    scored = whole.mapInArrow(score, schema)
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
