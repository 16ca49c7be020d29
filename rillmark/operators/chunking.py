"""Blocks of a document as chunks of bounded length."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    """Characters of a chunk: longest, shortest before it joins its neighbour, least for a cut, shared by neighbours."""

    most: int = 1800
    least: int = 250
    cut: int = 600
    overlap: int = 200


def cut(text: str, limits: Limits = Limits()) -> list[str]:
    """Parts of a text: at the last blank line, line, sentence or blank that leaves enough, else at the limit."""
    out, at = [], 0
    while len(text) - at > limits.most:
        window = text[at : at + limits.most]
        end = limits.most
        for mark in ("\n\n", "\n", ". ", " "):
            found = window.rfind(mark)
            if found >= limits.cut:
                end = found + len(mark)
                break
        out.append(text[at : at + end].strip())
        at += max(1, end - limits.overlap if end > limits.overlap else end)
    rest = text[at:].strip()
    return [p for p in [*out, rest] if p]


def cut_table(text: str, limits: Limits = Limits()) -> list[str]:
    """Parts of a table by rows, each under its header row; a row over the limit is cut like prose."""
    head, *rows = text.split("\n")
    out, own = [], []
    for row in rows:
        for part in [row] if len(head) + 1 + len(row) <= limits.most else cut(row, limits):
            if own and len(head) + sum(len(r) + 1 for r in own) + 1 + len(part) > limits.most:
                out.append("\n".join([head, *own]))
                own = []
            own.append(part)
    return [*out, "\n".join([head, *own])] if own or not out else out


def chunk(blocks: list[tuple[tuple[str, ...], str, str, str]], limits: Limits = Limits()) -> list[tuple[tuple[str, ...], str, str, str]]:
    """(trail, locator, kind, text) of the chunks of a document's blocks of the same form.

    A short block joins the next one of the same trail and kind; a long one is
    cut, and its parts are numbered in the locator.
    """
    joined: list[tuple[tuple[str, ...], str, str, str]] = []
    for trail, locator, kind, text in blocks:
        if joined:
            t, loc, k, body = joined[-1]
            if t == trail and k == kind and len(body) < limits.least and len(body) + 1 + len(text) <= limits.most:
                span = f"{loc.split('–')[0]}–{locator}" if locator and loc and locator != loc else loc or locator
                joined[-1] = (t, span, k, f"{body}\n{text}")
                continue
        joined.append((trail, locator, kind, text))
    out = []
    for trail, locator, kind, text in joined:
        parts = [text] if len(text) <= limits.most else cut_table(text, limits) if kind == "table" else cut(text, limits)
        for i, part in enumerate(parts):
            number = f" ({i + 1}/{len(parts)})" if len(parts) > 1 else ""
            out.append((trail, (locator + number).strip(), kind, part))
    return out


def chunks(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, ordinal, trail, locator, kind, text, chunk_id) of parsed blocks; a document is folded in one task."""
    from pyspark.sql import functions as F

    from ..functions.keys import chunk_id

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("ordinal")
        made = chunk([(tuple(t), loc or "", k or "text", x) for t, loc, k, x in zip(own["trail"], own["locator"], own["kind"], own["text"])], limits)
        return pd.DataFrame(
            [(key[0], i, list(t), loc, k, x) for i, (t, loc, k, x) in enumerate(made)], columns=["path", "ordinal", "trail", "locator", "kind", "text"]
        )

    good = blocks.filter("status = 'ok'").select("path", "ordinal", "trail", "locator", "kind", "text")
    folded = good.groupBy("path").applyInPandas(run, "path string, ordinal int, trail array<string>, locator string, kind string, text string")
    return folded.withColumn("chunk_id", chunk_id(F.col("path"), F.col("trail"), F.col("locator"), F.col("ordinal")))
