"""Cells of sheets as text, measures, digests of columns, spans of canonical texts, and spoken durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number as text; the share of decimals from which a column is a measure, and how many values are looked at.
DECIMAL = r"^-?\d{1,3}(?:\.\d{3})*,\d+$|^-?\d+[.,]\d+$"
MEASURE_SHARE, MEASURE_VALUES = 0.3, 200
#: Cells from which a sheet is a dump of data, and the most columns that count.
DUMP_CELLS, MOST_COLUMNS = 20_000, 40
#: Fixed values of a digest: key columns, distinct values of each, characters of a piece.
KEY_COLUMNS, MOST_VALUES, PIECE_CHARS = 4, 8_000, 2_000


def cell_number(value: Column) -> Column:
    """A number as a cell shows it: without decimals where it has none."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.coalesce(F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string")), F.lit(""))


def cell_time(value: Column) -> Column:
    """A time as a cell shows it: day first, with hour and minute unless it is midnight."""
    midnight = (F.hour(value) == 0) & (F.minute(value) == 0)
    return F.coalesce(F.when(midnight, F.date_format(value, "dd/MM/yyyy")).otherwise(F.date_format(value, "dd/MM/yyyy HH:mm")), F.lit(""))


def is_measure(values: Column) -> Column:
    """Whether more than three in ten of a column's first values are decimal numbers."""
    first = F.slice(values, 1, MEASURE_VALUES)
    decimals = F.size(F.filter(first, lambda v: v.rlike(DECIMAL)))
    return F.when(F.size(first) > 0, decimals / F.size(first) > MEASURE_SHARE).otherwise(False)


def is_data_dump(rows: Column, columns: Column) -> Column:
    return F.coalesce(rows * F.least(columns, F.lit(MOST_COLUMNS)) > DUMP_CELLS, F.lit(False))


def digest_pieces(values: Column, chars: int = PIECE_CHARS) -> Column:
    """Distinct values in order of first appearance, at most MOST_VALUES, joined to pieces of about ``chars`` characters.

    A piece is closed before a value that would make its values longer than
    ``chars``; a longer value is a piece of its own.
    """
    kept = F.slice(F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")), 1, MOST_VALUES)
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def add(state: Column, value: Column) -> Column:
        full = (state["size"] + F.length(value) > chars) & (F.size(state["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(value)).otherwise(F.concat(state["open"], F.array(value))).alias("open"),
            F.when(full, F.length(value)).otherwise(state["size"] + F.length(value)).alias("size"),
        )

    def finish(state: Column) -> Column:
        whole = F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.transform(whole, lambda p: F.array_join(p, "; "))

    return F.aggregate(kept, start, add, finish)


def spans_valid(spans: Column, length: Column) -> Column:
    """Whether spans (start, end) are in order, disjoint and inside the text; gaps and empty spans are fine."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct(
        (s["ok"] & (x["start"] >= s["end"]) & (x["end"] >= x["start"]) & (x["end"] <= length)).alias("ok"), x["end"].cast("long").alias("end")
    )
    return F.aggregate(spans, start, step, lambda s: s["ok"])


def spans_texts(text: Column, spans: Column) -> Column:
    """The blocks that a canonical text was rendered from, by slicing it at its spans."""
    return F.transform(spans, lambda x: F.substring(text, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))


def spoken_duration(seconds: Column) -> Column:
    """A duration to read: 'um instante', minutes, hours with minutes, days with hours."""
    minutes = F.floor(seconds / 60).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), n.cast("string"), F.lit(f" {unit}"))).otherwise("")
    return (
        F.when(seconds < 60, "um instante").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h"), part(minutes % 60, "min")))
        .otherwise(F.concat(days.cast("string"), F.lit(" d"), part(hours % 24, "h")))
    )
