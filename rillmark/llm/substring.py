"""Incremental substring deduplication by a log-structured fingerprint index.

Documents come in batches.  Each batch adds one sorted, immutable run of
window fingerprints to the index; a batch is merge-joined with all runs before
it and with itself, matches are verified, and runs are compacted.

A run does not hold a fingerprint per window.  A window's anchor is the gram
with the least hash in it; equal windows have equal anchors, so only windows
whose anchor occurs elsewhere can repeat.  The run holds the anchors'
fingerprints (about one per eight words) and the block of documents each is in.
Verification compares 128-bit digests of whole windows, computed from the
documents of the matched blocks, aligned to the first occurrence of each.

Everything moves as packed arrays, combined per block first: a passage that a
third of all documents share is one entry per block, not one per document.
Texts are shuffled once, into a table bucketed by block; later steps and later
batches bring fingerprints to the texts' buckets, never the texts to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import wordhash
from .storage import new_path, remove

#: UTF-8 bytes of text per block of documents, and per bucket of fingerprints.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
#: Anchors that a task gathers before it passes them on.
FLUSH = 1 << 20
_GENERATION = 1 << 40
_ROW = 1 << 40
#: Stands for a null id, after all others.
_NO_ID = (1 << 63) - 1


def _pack(*arrays: np.ndarray) -> bytes:
    """64-bit arrays of equal length, in planes of bytes, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd"), dtype=np.uint8)
    return [np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes.reshape(count, 8, -1)]


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _split(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    if len(key):
        bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(bounds, bounds[1:]):
            yield int(key[lo]), slice(lo, hi)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)}, schema=schema)


RUN = pa.schema([("bucket", pa.int64()), ("fingerprints", pa.binary())])
ROUTE = pa.schema([("block", pa.int64()), ("fingerprints", pa.binary())])
PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("texts", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("known", pa.bool_()), ("windows", pa.binary())])
REPEATS = pa.schema([("block", pa.int64()), ("repeats", pa.binary())])
_DDL = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _run_rows(fingerprints: list[np.ndarray], blocks: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Distinct (fingerprint, block) in order, with how often (1 or more than 1), a row per bucket."""
    if not fingerprints:
        return
    f, b = np.concatenate(fingerprints), np.concatenate(blocks)
    order = np.lexsort((b, f))
    f, b = f[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (b[1:] != b[:-1])])[: len(f)])
    often = (np.diff(np.append(first, len(f))) > 1).astype(np.uint64)
    f, b = f[first], b[first]
    for bucket, part in _split(_bucket(f, buckets)):
        yield bucket, _pack(_gaps(f[part]), b[part].view(np.uint64) << np.uint64(1) | often[part])


def _read_run(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gaps, tagged = _unpack(blob, 2)
    return _sums(gaps), (tagged >> np.uint64(1)).view(np.int64), (tagged & np.uint64(1)).astype(bool)


class SubstringIndex:
    """The index: runs under ``path`` (a folder all executors reach) and the documents they are of."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = 20, gram: int = 6, expected_bytes: int = 0):
        self.spark, self.path = spark, path or new_path(spark, "substrings")
        self.window, self.gram = window, gram
        self.runs: list[str] = []
        self.superseded: list[str] = []
        self.tables: list[str] = []
        self.batches, self.written = 0, 0
        #: Bytes of text that the index holds, or is said to hold later, and the buckets for them.
        self.bytes, self.expected, self.buckets = 0, expected_bytes, 0

    # -- steps ---------------------------------------------------------------

    def _anchors(self, blocked: DataFrame) -> DataFrame:
        window, gram, buckets = self.window, self.gram, self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, blocks, have = [], [], 0
            for batch in batches:
                block = np.asarray(batch.column(0))
                for piece in wordhash.pieces((t.as_py() for t in batch.column(2)), window):
                    starts, anchors, grams = piece.windows(window, gram)
                    change = np.concatenate([[True], anchors[1:] != anchors[:-1]])[: len(anchors)]
                    at = anchors[change]
                    found.append(grams[at])
                    blocks.append(block[piece.document[at]])
                    have += len(at)
                    if have >= FLUSH:
                        yield from _table(RUN, list(_run_rows(found, blocks, buckets))).to_batches()
                        found, blocks, have = [], [], 0
            yield from _table(RUN, list(_run_rows(found, blocks, buckets))).to_batches()

        return blocked.mapInArrow(run, _ddl(RUN))

    def _write_run(self, rows: DataFrame) -> str:
        """One sorted row per bucket."""
        buckets, path = self.buckets, f"{self.path}/run-{self.written:05d}"
        self.written += 1

        def merge(table: pa.Table) -> pa.Table:
            parts = [_read_run(x.as_py()) for x in table["fingerprints"]]
            f, b = [p[0] for p in parts], [p[1] for p in parts]
            # what occurs more than once keeps that mark by standing twice
            f += [p[0][p[2]] for p in parts]
            b += [p[1][p[2]] for p in parts]
            return _table(RUN, list(_run_rows(f, b, buckets)))

        rows.groupBy("bucket").applyInArrow(merge, _ddl(RUN)).write.option("compression", "none").parquet(path)
        return path

    def _routes(self, new_from: int) -> DataFrame:
        """Merge-join of all runs: to each block, the fingerprints of its own that a new document shares."""
        runs = self.spark.read.schema(_ddl(RUN)).parquet(*self.runs)

        def join(table: pa.Table) -> pa.Table:
            parts = [_read_run(x.as_py()) for x in table["fingerprints"]]
            f, b, often = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(f, kind="stable")
            f, b, often = f[order], b[order], often[order]
            start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])[: len(f)])
            if not len(start):
                return _table(ROUTE, [])
            count = np.add.reduceat(1 + often.astype(np.int64), start)
            fresh = np.add.reduceat((b >= new_from).astype(np.int64), start)
            keep = np.repeat((count > 1) & (fresh > 0), np.diff(np.append(start, len(f))))
            f, b = f[keep], b[keep]
            order = np.argsort(b, kind="stable")
            f, b = f[order], b[order]
            return _table(ROUTE, [(block, _pack(_gaps(f[part]))) for block, part in _split(b)])

        return runs.groupBy("bucket").applyInArrow(join, _ddl(ROUTE))

    def _packed(self, blocked: DataFrame) -> DataFrame:
        """Documents packed by block: a few compressed rows instead of one row each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = np.argsort(np.asarray(batch.column(0)), kind="stable")
                rows = batch.take(pa.array(order))
                for block, part in _split(np.asarray(rows.column(0))):
                    sink = pa.BufferOutputStream()
                    own = rows.slice(part.start, part.stop - part.start).select(list(range(2, rows.num_columns)))
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(own)
                    ids = _pack(np.asarray(rows.column(1))[part].view(np.uint64))
                    yield from _table(PACKED, [(block, ids, sink.getvalue().to_pybytes())]).to_batches()

        return blocked.mapInArrow(run, _ddl(PACKED))

    def _windows(self, packed: DataFrame, routes: DataFrame) -> DataFrame:
        """Digest and place of every window of a routed anchor, the first of equal ones in its block."""
        window, gram, buckets = self.window, self.gram, self.buckets

        def run(texts: pa.Table, routed: pa.Table) -> pa.Table:
            if not texts.num_rows or not routed.num_rows:
                return _table(WINDOWS, [])
            block = texts["block"][0].as_py()
            ids, rows, words, _ = _documents(texts)
            wanted = np.sort(np.concatenate([_sums(_unpack(x.as_py(), 1)[0]) for x in routed["fingerprints"]]))
            parts = []
            for piece in wordhash.pieces(words, window):
                starts, anchors, grams = piece.windows(window, gram)
                own = grams[anchors]
                starts = starts[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own]
                if len(starts):
                    number = piece.document[starts]
                    parts.append([*piece.digests(starts, window), ids[number], (rows[number] * _ROW + piece.start[starts])])
            if not parts:
                return _table(WINDOWS, [])
            high, low, doc, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, doc, low, high))
            high, low, doc, place = high[order], low[order], doc[order].view(np.uint64), place[order].view(np.uint64)
            first = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            out = []
            if not first.all():
                out.append((block % buckets, block, True, _pack(*_in_order(doc[~first], place[~first]))))
            high, low, doc, place = high[first], low[first], doc[first], place[first]
            for bucket, part in _split(_bucket(high, buckets)):
                out.append((bucket, block, False, _pack(_gaps(high[part]), low[part], doc[part], place[part])))
            return _table(WINDOWS, out)

        return packed.groupBy("block").cogroup(routes.groupBy("block")).applyInArrow(run, _ddl(WINDOWS))

    def _repeats(self, windows: DataFrame, new_from: int) -> DataFrame:
        """To each new block, the places of its windows that also start earlier."""

        def run(table: pa.Table) -> pa.Table:
            out, parts = [], []
            for block, known, blob in zip(*(table[c].to_pylist() for c in ("block", "known", "windows"))):
                if known:
                    if block >= new_from:
                        out.append((block, blob))
                    continue
                high, low, doc, place = _unpack(blob, 4)
                parts.append((_sums(high), low, np.full(len(low), block), doc, place))
            if parts:
                high, low, block, doc, place = (np.concatenate(x) for x in zip(*parts))
                # an older generation comes first, then the smaller id, then the earlier place
                order = np.lexsort((place, doc.view(np.int64), block // _GENERATION, low, high))
                high, low, block, doc, place = (x[order] for x in (high, low, block, doc, place))
                repeat = np.concatenate([[False], (high[1:] == high[:-1]) & (low[1:] == low[:-1])]) & (block >= new_from)
                block, doc, place = block[repeat], doc[repeat], place[repeat]
                order = np.argsort(block, kind="stable")
                block, doc, place = block[order], doc[order], place[order]
                out += [(b, _pack(*_in_order(doc[part], place[part]))) for b, part in _split(block)]
            return _table(REPEATS, out)

        return windows.groupBy("bucket").applyInArrow(run, _ddl(REPEATS))

    def _kept(self, packed: DataFrame, repeats: DataFrame, carried: list[T.StructField]) -> DataFrame:
        window = self.window
        own = "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<long>, text string"
        out_schema = T.StructType([*T.StructType.fromDDL(own).fields, *carried])
        arrow = to_arrow_schema(out_schema)

        def run(texts: pa.Table, repeated: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return arrow.empty_table()
            ids, rows, words, extra = _documents(texts)
            doc, place = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if repeated.num_rows:
                doc, place = (np.concatenate(x).view(np.int64) for x in zip(*(_unpack(x.as_py(), 2) for x in repeated["repeats"])))
                doc, place = _in_order(doc, place)
            out = []
            lows, highs = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            for number, text in enumerate(words):
                split = text.encode().split()
                starts = place[lows[number] : highs[number]] - rows[number] * _ROW
                starts = starts[(starts >= 0) & (starts < len(split))]
                name = int(ids[number]) if ids[number] != _NO_ID else None
                if not len(starts):
                    out.append((name, len(split), 0, b" ".join(split).decode(), [], text))
                    continue
                edge = np.zeros(len(split) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([w for w, g in zip(split, gone.tolist()) if not g]).decode()
                bounds = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out.append((name, len(split), int(gone.sum()), kept, bounds.tolist(), kept))
            columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*out), arrow)]
            return pa.Table.from_arrays([*columns, *(c.cast(f.type) for c, f in zip(extra.columns, list(arrow)[6:]))], schema=arrow)

        return packed.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(run, out_schema)

    # -- interface -----------------------------------------------------------

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Deduplicate a batch against everything added before and against itself, then index it.

        Returns one row per row of ``docs``: ``doc_id``, ``n_words``,
        ``n_removed``, ``kept_text`` (the words kept, joined by one space),
        ``removed_spans`` (word offsets: start, end, start, end, ...), ``text``
        (as given if nothing goes, else the same as ``kept_text``) and the
        columns named in ``carry``, prefixed ``carried_``.  A word
        goes if a window of ``window`` consecutive words covers it whose words
        also start earlier: in an older batch, at a smaller id, or earlier in
        the document.  Windows are judged on the texts as given.

        A null text has no words.  Null ids come after all others.  Rows that
        repeat an id are taken in the order of their texts.  Other columns are
        ignored, and an empty batch gives an empty result.
        """
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.bytes += size
        if self._wanted() > 2 * self.buckets:
            self._rebucket()
        generation = self.batches
        self.batches += 1
        new_from = generation * _GENERATION
        blocks = max(1, -(-size // BLOCK_BYTES))
        number = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(blocks)) + F.lit(new_from)
        blocked = docs.select(
            number.cast("long").alias("block"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            *[F.col(c).alias(f"carried_{c}") for c in carry],
        )
        self.runs.append(self._write_run(self._anchors(blocked.select("block", "id", "text"))))
        self._store(self._packed(blocked))
        # the table grows with later batches; these read what it holds now
        held = self.spark.table(self.tables[-1]).filter(F.col("block") < new_from + _GENERATION)
        windows = self._windows(held, self._routes(new_from))
        return self._kept(held.filter(F.col("block") >= new_from), self._repeats(windows, new_from), blocked.schema.fields[3:])

    def compact(self) -> None:
        """Merge all runs to one; what later batches find stays the same.

        The runs it replaces stay readable, for results that are not read yet,
        until ``vacuum``.
        """
        if len(self.runs) > 1:
            merged = self._write_run(self.spark.read.schema(_ddl(RUN)).parquet(*self.runs))
            self.superseded += self.runs
            self.runs = [merged]

    def vacuum(self) -> None:
        """Delete what compaction replaced, once all results so far have been read."""
        for path in self.superseded:
            remove(self.spark, path)
        for table in self.tables[:-1]:
            self.spark.sql(f"drop table {table}")
        self.superseded, self.tables = [], self.tables[-1:]

    def _wanted(self) -> int:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(parts, -(-max(self.bytes, self.expected) // BUCKET_BYTES))

    def _store(self, packed: DataFrame) -> None:
        if not self.tables:
            self.tables.append(f"rillmark_texts_{uuid.uuid4().hex}")
        name = self.tables[-1]
        out = packed.repartition(self.buckets, "block").write.mode("append").format("parquet").option("compression", "none")
        out.option("path", f"{self.path}/{name}").bucketBy(self.buckets, "block").saveAsTable(name)

    def _rebucket(self) -> None:
        """More buckets, once the texts have more than doubled: all runs and texts are dealt anew."""
        self.buckets = self._wanted()
        if self.runs:
            buckets = self.buckets

            def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for blob in batch.column(1):
                        f, b, often = _read_run(blob.as_py())
                        doubled = [np.concatenate([x, x[often]]) for x in (f, b)]
                        yield from _table(RUN, list(_run_rows([doubled[0]], [doubled[1]], buckets))).to_batches()

            self.superseded += self.runs
            self.runs = [self._write_run(self.spark.read.schema(_ddl(RUN)).parquet(*self.runs).mapInArrow(split, _ddl(RUN)))]
        if self.tables:
            held = self.spark.table(self.tables[-1])
            self.tables.append(f"rillmark_texts_{uuid.uuid4().hex}")
            self._store(held)


def _in_order(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((place, doc))
    return doc[order], place[order]


def _documents(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str], pa.Table]:
    """Ids, number among rows of the same id, texts and carried columns of a block, in the order of id and text."""
    ids = np.concatenate([_unpack(x.as_py(), 1)[0] for x in texts["ids"]]).view(np.int64)
    whole = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(blob.as_py())).read_all() for blob in texts["texts"]])
    words = whole.column(0).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], words[i]))
    ids = ids[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)]
    group = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    extra = whole.select(list(range(1, whole.num_columns))).take(pa.array(order, pa.int64())) if whole.num_columns > 1 else pa.table({})
    return ids, np.arange(len(ids)) - group, [words[i] for i in order], extra


def deduplicate(docs: DataFrame, *, window: int = 20, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Deduplicate one table through a new index, in ``batches`` by ascending id, with the runs compacted between them.

    Columns, nulls, repeats and empty tables as in SubstringIndex.add; rows
    without an id come last, with the last batch.
    """
    name = F.col(id_col).cast("long")
    size = F.sum(F.octet_length(text_col))
    cuts = [i / batches for i in range(1, batches)]
    found = docs.select(size.alias("size"), *([F.percentile_approx(name, cuts, 10_000).alias("cuts")] if cuts else [])).first()
    index = SubstringIndex(docs.sparkSession, window=window, expected_bytes=found["size"] or 0)
    bounds = sorted(set((found["cuts"] if cuts else None) or []))
    out = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        index.compact()
        part = F.lit(True) if low is None else name > low
        part = part & (name <= high) if high is not None else part | name.isNull()
        out.append(index.add(docs.filter(part), id_col=id_col, text_col=text_col, carry=carry))
    return reduce(DataFrame.unionByName, out)
