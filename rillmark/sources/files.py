"""Folders as tables: a census of files, and their parsed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parsers

SUFFIX_LIMIT_MB = {"txt": 50, "md": 50, "csv": 100, "pdf": 200}


def census(spark: SparkSession, root: str, *, pattern: str = "*") -> DataFrame:
    """path, size, mtime and depth of all files below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    name = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{_quoted(base)}", "")
    return found.select(
        name.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), (F.size(F.split(name, "/")) - 1).alias("depth")
    )


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "/_ " else c for c in text)


def _pattern(glob: str) -> str:
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c) or _quoted(c) for c in glob) + "$"


def exclude(files: DataFrame, *, folders: tuple[str, ...] = (), names: tuple[str, ...] = (), roles: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> DataFrame:
    """Add ``rule``: the first rule that leaves a file out, null if it stays.

    ``folders`` are names of folders anywhere in the path, ``names`` patterns of
    file names, ``roles`` patterns that hold below some folders only.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parents = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rules = [(f"folder {f}", F.array_contains(F.transform(parents, F.lower), f.lower())) for f in folders]
    rules += [(f"name {n}", name.rlike(_pattern(n))) for n in names]
    for glob, prefixes in roles:
        inside = F.lit(not prefixes)
        for p in prefixes:
            inside = inside | F.lower("path").startswith(p.lower().rstrip("/") + "/")
        rules.append((f"role {glob}", name.rlike(_pattern(glob)) & inside))
    return files.withColumn("rule", F.coalesce(*[F.when(cond, rule) for rule, cond in rules], F.lit(None).cast("string")))


def unused_rules(excluded: DataFrame, rules: list[str]) -> DataFrame:
    """Declared rules that left out no file."""
    wanted = excluded.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return wanted.join(excluded.filter("rule is not null").select("rule").distinct(), "rule", "left_anti")


BLOCKS = "path string, sha string, status string, detail string, ordinal int, trail array<string>, locator string, kind string, text string"


def parse(files: DataFrame, *, limits_mb: dict[str, float] | None = None) -> DataFrame:
    """Blocks of files (path, content): one row per block, one with the status only if there is none.

    A file never fails the job: what a parser raises becomes ``status`` 'error'
    with its ``detail``; a file over its limit is 'deferred', one without parser
    'no parser', one without text 'empty'.
    """
    limits = limits_mb or SUFFIX_LIMIT_MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split(" ")[0] for p in BLOCKS.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = parsers.blocks_of(path, content.as_py() or b"", limits)
                types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def read_documents(spark: SparkSession, root: str, **options) -> DataFrame:
    """Blocks of all files below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return parse(found.select("path", "content"), **options)
