from __future__ import annotations

import base64
import hashlib
import zlib

import pytest

from rillmark.llm import sharding, warc


def jump(key: int, shards: int) -> int:
    """The published algorithm."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_algorithm(spark):
    rows = [(i * 37, "t" * (i % 5)) for i in range(3000)] + [(None, None), (None, "é"), (37, "again"), (37, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shards in (1, 2, 24):
        got = sharding.assign_shards(df, shards=shards).collect()
        assert len(got) == len(rows)
        slots: dict = {}
        for r in got:
            key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
            assert (r.shard, r.grown_shard) == (jump(key, shards), jump(key, shards + 1))
            assert r.grown_shard in (r.shard, shards)
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_and_checksums(spark):
    rows = [(1, "é漢"), (2, ""), (3, None)]
    schema = "doc_id long, text string, shard int, slot string, size int"
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.assign_shards(spark.createDataFrame([(*r, 1, "s", 1) for r in rows], schema), shards=3).collect()}
    assert got == {i: (8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows}
    assert sharding.assign_shards(spark.createDataFrame([], schema), shards=3).count() == 0


@pytest.fixture(scope="module")
def pages():
    return [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "u\r\nX: y", None), (4, "v", ""), (6, "w", "ünique" * 1000), (7, "x", "lone"), (7, "y", "lone"), (None, "z", "lone")]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, tmp_path, pages, least):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_archive(df, str(tmp_path / "w"), least_bytes=least)
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    rows = sorted(((r.page_id, r.url, bytes(r.payload).decode(), r.payload_digest, r.record_type, r.refers_to) for r in got), key=key)
    want = []
    for page, url, html in pages:
        body = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "") == (html or "")]
        owner = max((p for p in ids if p is not None), default=None)
        revisit = len(body) >= least and page != owner
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page, (url or "").replace("\r", "").replace("\n", ""), body.decode(), digest, "revisit" if revisit else "response", owner if revisit else None))
    assert rows == sorted(want, key=key)
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == len({h or "" for _, _, h in pages})
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and rest == block + b"\r\n\r\n"
        assert block == (b"" if r.record_type == "revisit" else bytes(r.payload))


def test_damaged_payload_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    heads = str(tmp_path / "w" / "headers")
    damaged = spark.read.parquet(str(tmp_path / "w" / "payloads")).selectExpr("sha256", "cast('evil' as binary) as payload")
    damaged.write.parquet(str(tmp_path / "x" / "payloads"))
    spark.read.parquet(heads).write.parquet(str(tmp_path / "x" / "headers"))
    with pytest.raises(Exception, match="fails verification"):
        warc.read_archive(spark, str(tmp_path / "x")).collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string, sha256 int, payload int"), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0
