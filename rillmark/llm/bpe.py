"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each block of documents is reduced to its distinct pretokens.  An inverted
index from mergeable token pair (named by the rank of its join) to the places
where it stands is built over all of them at once; merges are applied in rank
order, each touching only the places listed for it and the two neighbours of
each join.  Pretokens are independent, so replaying block by block gives what
one replay over the whole corpus would, without gathering the corpus anywhere.

Nulls count as empty texts.  Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the reference tokenizer library's regular expressions see it (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A single space between two characters that aren't white space always starts a pretoken.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries that a worker's memo holds before it starts anew; a bound on memory only.
MEMO_ENTRIES = 250_000
#: Characters of text whose pretokens are replayed together.
BLOCK_CHARS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a file of lines ``base64(token) rank``; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Replays the merges of a vocabulary over many distinct words at once.

    The index lists, by the rank of the join, every place where two neighbouring
    tokens have a join in the vocabulary, in bands of neighbouring ranks so that
    numpy handles many places per step.  The lowest band that has places goes
    first; in it every word makes its lowest and leftmost join, and only the two
    neighbours of that join are listed anew.  A word's joins thus come in rank
    order, also where a join makes possible another of lower rank.
    """

    BANDS = 96

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.join = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.width = self.size // self.BANDS + 1
        self.packed = {r: np.int32(r).tobytes() for r in ranks.values()}

    def _joins(self, token: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these neighbours have a join, and its rank."""
        key = token[left].astype(np.int64) * self.size + token[right]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        good = self.pair[at] == key
        return good, self.join[at]

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as int32 bytes; a word that is a token itself is that token, as in the tokenizer library."""
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, r in zip(words, whole) if r is None]
        length = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))
        ends = np.cumsum(length)
        n = int(ends[-1]) if len(rest) else 0
        token = self.byte[np.frombuffer(b"".join(rest), dtype=np.uint8)]
        word = np.repeat(np.arange(len(rest)), length)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[ends - length] = -1
        after[ends - 1] = -1
        alive = np.ones(n, dtype=bool)
        index: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.BANDS)]

        def put(rank: np.ndarray, place: np.ndarray) -> None:
            band = rank // self.width
            order = np.argsort(band, kind="stable")
            rank, place, band = rank[order], place[order], band[order]
            cuts = np.flatnonzero(band[1:] != band[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(band)]):
                index[band[lo]].append((rank[lo:hi], place[lo:hi]))

        left = np.flatnonzero(after >= 0)
        if len(left):
            good, rank = self._joins(token, left, after[left])
            if good.any():
                put(rank[good], left[good])
        at = 0
        while at < self.BANDS:
            if not index[at]:
                at += 1
                continue
            rank, place = map(np.concatenate, zip(*index[at]))
            index[at] = []
            # a place counts if it still has a right neighbour and their join is the one listed
            ok = alive[place] & (after[place] >= 0)
            rank, place = rank[ok], place[ok]
            good, now = self._joins(token, place, after[place])
            ok = good & (now == rank)
            rank, place = rank[ok], place[ok]
            if not len(place):
                continue
            order = np.lexsort((place, rank, word[place]))
            rank, place = rank[order], place[order]
            owner = word[place]
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            later = ~first
            if later.any():
                index[at].append((rank[later], place[later]))
            rank, place = rank[first], place[first]
            gone = after[place]
            token[place] = rank
            alive[gone] = False
            beyond = after[gone]
            after[place] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = place[inner]
            prior = before[place]
            left = np.concatenate([prior[prior >= 0], place[inner]])
            right = np.concatenate([place[prior >= 0], beyond[inner]])
            if len(left):
                good, made = self._joins(token, left, right)
                if good.any():
                    put(made[good], left[good])
                    at = min(at, int(made[good].min()) // self.width)
        token, word = token[alive], word[alive]
        packed = token.tobytes()
        cuts = (4 * np.searchsorted(word, np.arange(len(rest) + 1))).tolist()
        parts = (packed[lo:hi] for lo, hi in zip(cuts, cuts[1:]))
        return [next(parts) if r is None else self.packed[r] for r in whole]


class Codec:
    """Encodes and decodes blocks of texts; keeps a bounded memo of what it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        #: ids of pieces that follow a space, and of those that open a text
        self.memo: dict[str, bytes] = {}
        self.opening: dict[str, bytes] = {}
        self.replay = MergeReplay(ranks)
        by_id = sorted((r, t) for t, r in ranks.items())
        self.length = np.zeros(by_id[-1][0] + 1, dtype=np.int64)
        self.length[[r for r, _ in by_id]] = [len(t) for _, t in by_id]
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as an int32 array."""
        cut = [_CUT.split(text) for text in texts]
        first = [pieces.pop(0) for pieces in cut]
        memo, opening = self.memo, self.opening
        self._learn(memo, " ", set().union(*cut).difference(memo))
        self._learn(opening, "", set(first).difference(opening))
        return [
            np.frombuffer(opening[head] + b"".join([memo[p] for p in pieces]), dtype=np.int32)
            for head, pieces in zip(first, cut)
        ]

    def _learn(self, memo: dict[str, bytes], before: str, pieces: set[str]) -> None:
        found = [(p, self.find(before + p)) for p in pieces]
        new = list({w for _, words in found for w in words})
        ids = dict(zip(new, self.replay([w.encode() for w in new])))
        for p, words in found:
            memo[p] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])

    def forget(self) -> None:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        if len(self.opening) > MEMO_ENTRIES // 20:
            self.opening = {}

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens with these ids."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.start[ids] - (ends - length), length) + np.arange(ends[-1])].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(shared, digest: str, pattern: str) -> Codec:
    """This worker's codec of the ranks with this digest; a worker that gets other ranks starts anew."""
    key = (digest, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Ids of every whole text, and the bytes that the ids decode to.

    Returns ``id_col``, the columns in ``keep``, ``ids`` (array of int) and
    ``decoded`` (binary), one row per row of ``docs``; repeated rows stay
    repeated, a null text gives no ids and no bytes.  No shuffle: every task
    reads its own documents.  The ranks (a fixed vocabulary file) are broadcast.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(ranks)
    kept = docs.select(id_col, *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType(
        [*kept.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, digest, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(np.fromiter((len(t) for t in texts.to_pylist()), dtype=np.int64, count=len(texts)))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_CHARS)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                ids = codec.encode(texts.slice(lo, hi - lo).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                decoded = pa.array([codec.decode(x) for x in ids], type=pa.binary())
                columns = batch.slice(lo, hi - lo).columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, listed, decoded], names=[f.name for f in schema.fields])
                codec.forget()

    return kept.mapInArrow(run, schema)


def token_digests(encoded: DataFrame, *keys: str) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of what encode_decode returns."""
    return encoded.select(
        *keys,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
