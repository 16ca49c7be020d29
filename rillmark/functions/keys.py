"""Identity, path, time and size keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """POSIX relative path; an absolute path, a drive or a parent step is an error."""
    posix = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+", "/")
    bad = posix.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a relative path: "), path)).cast("string")).otherwise(F.regexp_replace(posix, r"^(\./)+", ""))


def occurrence_id(root: Column, path: Column, digits: int = 16) -> Column:
    """Key of a path under a root; a blank root is an error."""
    joined = F.concat(F.encode(root, "utf-8"), F.lit(b"\0"), F.encode(path, "utf-8"))
    key = F.substring(F.sha2(joined, 256), 1, digits)
    return F.when(F.trim(root) == "", F.raise_error(F.lit("a root is needed")).cast("string")).otherwise(key)


def chunk_id(document: Column, trail: Column, locator: Column, ordinal: Column) -> Column:
    """Stable id of a chunk: a hash over document, heading trail, locator and ordinal."""
    parts = [F.lit("2"), document, F.array_join(trail, " > "), locator, ordinal.cast("string")]
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 16)


def document_id(sha256: Column) -> Column:
    """Public id: the first 12 digits of a valid hash, else null."""
    return F.when(sha256.rlike("^[0-9a-f]{12,}$"), F.substring(sha256, 1, 12))


def in_prefix_range(column: Column, prefix: str) -> Column:
    """Prefix search on hexadecimal ids as a half-open range, which a scan can prune by statistics."""
    return (column >= prefix) & (column < prefix + "g")


def in_folder(path: Column, folder: str, recursive: bool = True) -> Column:
    """Membership in a folder ('' or '.': the root)."""
    name = folder.replace("\\", "/").strip().strip("/")
    prefix = "" if name in ("", ".") else f"{name}/"
    inside = path.startswith(prefix) if prefix else F.lit(True)
    return inside if recursive else inside & ~F.substring(path, len(prefix) + 1, 1 << 30).contains("/")


def period_bounds(period: Column) -> tuple[Column, Column]:
    """First and last microsecond of 'YYYY', 'YYYY-MM', 'YYYY-MM-DD' or of a full timestamp; null if invalid."""
    text = F.trim(period)
    whole = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    start = F.try_to_timestamp(whole)
    step = (
        F.when(text.rlike(r"^\d{4}$"), F.expr("interval 1 year") + start)
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.expr("interval 1 month") + start)
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("interval 1 day") + start)
    )
    return start, F.when(step.isNull(), start).otherwise(step - F.expr("interval 1 microsecond"))


#: Upper bounds of the size bands in bytes, and their names.
SIZE_BANDS = ((0, "0 B"), (1 << 10, "< 1 KB"), (10 << 10, "1-10 KB"), (100 << 10, "10-100 KB"), (1 << 20, "100 KB-1 MB"), (10 << 20, "1-10 MB"), (100 << 20, "10-100 MB"))


def size_band(size: Column) -> Column:
    out = F.when(size <= 0, SIZE_BANDS[0][1])
    for bound, name in SIZE_BANDS[1:]:
        out = out.when(size < bound, name)
    return out.otherwise(">= 100 MB")


def source_group(path: Column) -> Column:
    """'email', 'reuniao' or 'escritorio' by extension first, then by folder name."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    folder = F.lower(F.regexp_extract(path, r"^(.*)/", 1))
    return (
        F.when(extension.isin("eml", "msg"), "email")
        .when(extension.isin("vtt", "srt", "sbv"), "reuniao")
        .when(folder.rlike(r"(^|/)(e-?mails?|inbox|mail)(/|$)"), "email")
        .when(folder.rlike(r"(^|/)(meetings?|reuniao|reunioes|transcripts?)(/|$)"), "reuniao")
        .otherwise("escritorio")
    )


def is_dump(path: Column) -> Column:
    """Whether dump, export, backup or log stands as a word in a part of the path."""
    return F.lower(path).rlike(r"(^|[^a-z0-9])(dump|export|backup|log)s?([^a-z0-9]|$)")


def column_letters(number: Column) -> Column:
    """Spreadsheet letters of a column number: 1 is A, 27 is AA; a number beyond three letters (18,278) is an error."""
    n = number.cast("long")
    letter = lambda x: F.char(F.lit(65) + F.pmod(x, F.lit(26)))
    second, third = F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    text = F.concat(
        F.when(n > 702, letter(third - 1)).otherwise(""), F.when(n > 26, letter(second - 1)).otherwise(""), letter(n - 1)
    )
    return F.when((n < 1) | (n > 18_278), F.raise_error(F.lit("no column of three letters or fewer")).cast("string")).otherwise(text)


def human_bytes(size: Column) -> Column:
    out = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", F.round(size / float(1024**power), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.round(size / float(1024**4), 1)), F.lit(" TB")))


def clock_seconds(mark: Column) -> Column:
    """'[h:]mm:ss[.,ms]' as seconds."""
    return F.aggregate(F.split(F.regexp_replace(mark, ",", "."), ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


def clock_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60))
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))
