"""Identifiers in texts and the graph of documents that mention the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of identifiers in the order in which they are taken, each between characters that are no letters or digits.
_LETTERS = "0-9A-Za-zÀ-ÿ"
NORM = r"(?i)(?:ABNT\s+)?(?:NBR\s+)?(?:ISO(?:/IEC|/TS|/TR)?|IEC|NBR|NR|ASTM|EN)[\s/-]{0,3}\d{2,9}(?:\.\d{3})*(?:[-:]\d{1,4})?"
LAW = r"(?i)(?:Lei(?:\s+Complementar)?|PL|PLP|Decreto|Resolu[çc][ãa]o|Portaria|MP)(?:\s+n[º°.]?)?\s*(?:\d{1,3}(?:\.\d{3})+(?:/\d{4})?|\d{2,6}/\d{4})"
CODE = r"[A-Z]{2,4}-[A-Z0-9]{2,8}-\d{1,4}(?:[.\-/]\d{1,4})?"
TAX_ID = r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}"
COURT_NUMBER = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
KINDS = (("norma", NORM), ("lei", LAW), ("codigo", CODE), ("cnpj", TAX_ID), ("processo", COURT_NUMBER))
#: Bodies by which a norm is named, the first that is given; kinds of law whose number tells without the year.
BODIES = ("ISO", "IEC", "NBR", "NR", "ASTM", "EN")
PROMULGATED = ("LEI", "DECRETO", "PORTARIA", "RESOLUCAO", "RESOLUÇÃO")
#: Identifiers that a text has at most; a text with more lists them rather than treats of them.
MOST = 40


def _norm(raw: Column) -> Column:
    """Body and number without dots, edition and year, also one that is glued to the number."""
    parts = F.split(F.upper(raw), r"[\s/-]+")
    named = F.filter(parts, lambda p: ~p.rlike("^[0-9]"))
    body = F.coalesce(*[F.when(F.array_contains(named, b), F.lit(b)) for b in BODIES], F.element_at(named, -1))
    number = F.regexp_replace(F.substring_index(F.get(F.filter(parts, lambda p: p.rlike("^[0-9]")), F.lit(0)), ":", 1), r"\.", "")
    return F.concat(body, F.lit(" "), F.regexp_replace(number, r"^([0-9]{4,5})(?:19|20)[0-9]{2}$", "$1"))


def _law(raw: Column) -> Column:
    """Kind and number; without the year where the number tells by itself."""
    single = F.trim(F.regexp_replace(raw, r"\s+", " "))
    kind = F.upper(F.substring_index(single, " ", 1))
    number = F.trim(F.regexp_replace(F.when(F.instr(single, " ") > 0, F.regexp_replace(single, "^[^ ]+ ", "")).otherwise(""), r"n[º°.]", ""))
    number = F.when(kind.isin(*PROMULGATED), F.substring_index(number, "/", 1)).otherwise(number)
    return F.trim(F.concat(kind, F.lit(" "), number))


def canonical(kind: str, raw: Column) -> Column:
    """One spelling per identifier."""
    if kind == "norma":
        return _norm(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    if kind == "lei":
        return _law(raw)
    return F.upper(raw) if kind == "codigo" else raw


def identifiers(text: Column) -> Column:
    """Array of (kind, value): distinct identifiers, at most MOST of a text."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(rf"(?<![{_LETTERS}]){pattern}(?![{_LETTERS}])"), F.lit(0)), lambda raw: F.struct(F.lit(kind).alias("kind"), canonical(kind, raw).alias("value"))
        )

    parts = [of_kind(kind, pattern) for kind, pattern in KINDS]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, MOST)


def mentions(chunks: DataFrame, *, doc: str = "doc_id", ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """(doc, kind, value, first): every identifier of a document and the first chunk that has it."""
    found = chunks.select(F.col(doc).alias("doc"), F.col(ordinal).alias("__n"), F.inline(identifiers(F.col(text))))
    return found.groupBy("doc", "kind", "value").agg(F.min("__n").alias("first"))


def hop(hits: DataFrame, near: DataFrame, *, expanded: int, k: int) -> DataFrame:
    """A ranking (query_id, item, rank) with the neighbours of its first ``expanded`` hits put right after each, no item twice, cut at ``k``.

    ``near`` is what ``neighbours`` returns.  An item counts at its first place.
    """
    own = hits.select("query_id", "item", F.col("rank").alias("a"), F.lit(0).alias("b"))
    added = hits.filter(F.col("rank") <= expanded).join(near.select(F.col("doc").alias("item"), "other", F.col("rank").alias("b")), "item")
    rows = own.unionByName(added.select("query_id", F.col("other").alias("item"), F.col("rank").alias("a"), "b"))
    first = rows.groupBy("query_id", "item").agg(F.min(F.struct("a", "b")).alias("place"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("place", "item"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "item", "rank")


def neighbours(found: DataFrame, *, most_documents: int = 40, limit: int = 10) -> DataFrame:
    """(doc, other, weight, shared, rank): documents by rarity of the identifiers they share.

    An identifier in one document links nothing, one in more than
    ``most_documents`` is too common to tell; that bound also keeps the
    self-join linear in the mentions.
    """
    df = found.groupBy("kind", "value").agg(F.countDistinct("doc").alias("df")).filter((F.col("df") > 1) & (F.col("df") <= most_documents))
    rare = found.select("doc", "kind", "value").join(df, ["kind", "value"])
    pairs = rare.join(rare.select("kind", "value", F.col("doc").alias("other")), ["kind", "value"]).filter("doc <> other")
    scored = pairs.groupBy("doc", "other").agg(F.round(F.sum(1 / F.col("df")), 9).alias("weight"), F.count("*").alias("shared"))
    order = W.partitionBy("doc").orderBy(F.col("weight").desc(), "other")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
