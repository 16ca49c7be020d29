"""Rule sets over texts: classes by patterns, ordered replacements, rhythm of sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_counts(text: Column, classes: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """How many of a class's patterns a text matches (not how often)."""
    return {name: reduce(Column.__add__, [F.regexp_like(text, F.lit(p)).cast("int") for p in patterns]) for name, patterns in classes.items()}


def classify(text: Column, classes: dict[str, tuple[str, ...]], default: str) -> tuple[Column, Column]:
    """The class with most matching patterns (the first of equal ones) and min(0.95, 0.6 + 0.1 n); the default at 0.55 if none matches."""
    counts = pattern_counts(text, classes)
    most = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    name = F.coalesce(*[F.when((most > 0) & (n == most), c) for c, n in counts.items()], F.lit(default))
    return name, F.when(most > 0, F.least(F.lit(0.95), F.round(0.6 + 0.1 * most, 2))).otherwise(0.55)


def scrub(text: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Text after all replacements in order, blanks collapsed, and how many matches they had."""
    out, hits = text, F.lit(0)
    for pattern, replacement in rules:
        hits = hits + F.regexp_count(out, F.lit(f"(?i){pattern}"))
        out = F.regexp_replace(out, f"(?i){pattern}", replacement)
    return F.trim(F.regexp_replace(out, " {2,}", " ")), hits


def sentence_rhythm(text: Column) -> tuple[Column, Column, Column]:
    """Number of sentences, their mean length in words, and its sample variance (0 for fewer than two)."""
    parts = F.filter(F.split(text, r"[.!?]+(?:\s+|$)"), lambda s: F.length(F.trim(s)) > 0)
    lengths = F.transform(parts, lambda s: F.size(F.split(F.trim(s), r"\s+")).cast("double"))
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
    return n, mean, F.when(n > 1, F.greatest((squares - n * mean * mean) / (n - 1), F.lit(0.0))).otherwise(0.0)
