"""Content-addressed WARC archive.

Records are kept as two tables in one folder: ``payloads`` holds the bytes of
every distinct payload once, under their SHA-256; ``headers`` holds the exact
header bytes of every record and the digest of its payload.  Reading joins them
back to whole records, verifies both digests over the joined bytes and parses
the header, so what is returned is what the archive says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits, 5 hexadecimal or 4 base-32 digits, at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), *_BASE32)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("sha256", F.sha2("payload", 256))


def headers(
    pages: DataFrame, *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """The exact header bytes of one WARC record per row: ``page_id``, ``sha256``, ``header``.

    Among records with equal payloads of at least ``least_bytes`` bytes the one
    with the largest id is a response and the others revisit it; all smaller
    payloads are responses.  Rows that repeat the largest id with the same
    payload are all responses.  A null html is an empty payload, a null url an
    empty target, a null id is below every other.  No payload is shuffled.
    """
    rows = _pages(pages, id_col, url_col, html_col)
    slim = rows.select(
        "page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")
    )
    owners = rows.groupBy("sha256").agg(F.max("page_id").alias("owner"))
    joined = slim.join(owners, "sha256")
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:page:>"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("owner")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return joined.select("page_id", "sha256", F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).cast("binary").alias("header"))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> None:
    """Write the archive of ``pages`` to the tables ``headers`` and ``payloads`` under ``path``.

    Equal payloads meet on the map side first, so a payload that a third of all
    rows share moves once per task.  An empty table gives an empty archive.
    """
    columns = {"id_col": id_col, "url_col": url_col, "html_col": html_col}
    headers(pages, **columns, **options).write.option("compression", "zstd").parquet(f"{path}/headers")
    rows = _pages(pages, **columns)
    rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("text"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive, reconstructed and verified.

    Returns ``page_id``, ``url``, ``record_type``, ``refers_to`` (id of the
    response, else null), ``payload`` (also for revisits), ``payload_bytes``,
    ``payload_digest`` and ``record`` (the record's bytes: header, block, end).
    Fails if stored bytes don't have the digests that the store and the header name.
    """
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    heads = spark.read.schema("page_id long, sha256 string, header binary").parquet(f"{path}/headers")
    rows = heads.join(payloads, "sha256", "left").withColumn("text", F.col("header").cast("string"))
    kind = F.regexp_extract("text", "\r\nWARC-Type: ([a-z]+)\r\n", 1)
    rows = rows.withColumn("sha1", base32_sha1(F.col("payload")))
    good = (
        (F.sha2("payload", 256) == F.col("sha256"))
        & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")))
        & (_field("WARC-Payload-Length") == F.octet_length("payload").cast("string"))
    )
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("archive record fails verification: "), F.col("text"))).cast("binary")
    )
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    refers = F.nullif(F.regexp_extract(_field("WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1), F.lit(""))
    return rows.select(
        F.nullif(F.regexp_extract(_field("WARC-Record-ID"), "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        refers.cast("long").alias("refers_to"),
        checked.alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.substring(_field("WARC-Payload-Digest"), 6, 64).alias("payload_digest"),
        F.concat(F.col("header"), block, F.lit((CRLF * 2).encode())).alias("record"),
    )
