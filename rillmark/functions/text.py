"""Text folding, tokens, markup and language evidence."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    marked, bare = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked), "".join(bare)


_ACCENTS = _accent_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics (Latin scripts)."""
    return F.translate(F.lower(text), *_ACCENTS)


def fold_plain(phrase: str) -> str:
    """Tokens of a phrase that is no column, folded and joined by single spaces."""
    return " ".join(re.findall(r"[^\W_]+", phrase.lower().translate(str.maketrans(*_ACCENTS))))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def term_counts(words: Column) -> Column:
    """(term, tf) of every distinct token of an array: the runs of the sorted array."""

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of a value that is made once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def runs(own: Column) -> Column:
        last = lambda i: (i == F.size(own)) | ((i < F.size(own)) & (F.get(own, i - 1) != F.get(own, i)))
        count = lambda ends, at, n: (at - F.when(n == 0, 0).otherwise(F.get(ends, n - 1))).cast("long")
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), last)
        return bound(ends, lambda e: F.transform(e, lambda at, n: F.struct(F.get(own, at - 1).alias("term"), count(e, at, n).alias("tf"))))

    return bound(F.sort_array(words), runs)


def name_tokens(path: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct ASCII tokens of two or more characters, without stop words."""
    found = F.regexp_extract_all(fold(path), F.lit("([0-9a-z]+)"), F.lit(1))
    kept = F.filter(found, lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, stop_words)).cast("array<string>"))


def searchable_path(path: Column) -> Column:
    """Path separators and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(path, r"[/\\_]", " "), r"\s+", " "))


def document_name(path: Column) -> Column:
    """Last path part without its extension, underscores as spaces."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), "_", " "), r"\s+", " "))


def embedding_text(name: Column, trail: Column, text: Column) -> Column:
    """Name and heading trail (an array) above the text, for an encoder or a re-ranker."""
    head = F.concat(F.array(name), F.coalesce(trail, F.array().cast("array<string>")))
    return F.concat_ws("\n---\n", F.array_join(F.filter(head, lambda x: F.length(F.trim(x)) > 0), " > "), text)


#: Block-level tags that end a line.
BLOCK_TAGS = "p|div|br|tr|li|h1|h2|h3|h4|h5|h6|table|ul|ol|blockquote|hr|section|article"
#: Character references and what they stand for, ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text of markup: hidden elements dropped, block tags as line ends, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</(script|style|head)\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.regexp_replace(out, entity, char)
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{2,}", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean_body(text: Column) -> Column:
    """Links reduced to their host, content ids dropped, opaque tokens of 60 and more characters elided."""
    out = F.regexp_replace(text, r"https?://([^/\s>\])]+)[^\s>\])]*", "(link: $1)")
    out = F.regexp_replace(out, r"cid:[^\s>\])]+", "")
    out = F.regexp_replace(out, r"[A-Za-z0-9+/=_-]{60,}", "…")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def file_name(text: Column) -> Column:
    """Characters that file systems forbid as underscores; reserved device names prefixed."""
    safe = F.trim(F.translate(text, '<>:"/\\|?*', "_" * 9))
    return F.when(F.upper(safe).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), safe)).otherwise(safe)


#: Frequent words that tell Portuguese from English.
MARKERS = {
    "pt": ("de", "que", "não", "uma", "para", "com", "os", "dos", "das", "pelo", "pela", "são", "está", "também", "mais"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "are", "this", "was", "by", "which", "from"),
}


def language(text: Column) -> Column:
    """'pt', 'en', 'misto' or 'indefinido' from marker counts; fewer than two markers decide nothing."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))

    def count(marks: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*marks)))

    pt, en = count(MARKERS["pt"]), count(MARKERS["en"])
    return (
        F.when(F.greatest(pt, en) < 2, "indefinido").when(pt >= 1.5 * en, "pt").when(en >= 1.5 * pt, "en").otherwise("misto")
    )


def keywords(query: Column, stop_words: tuple[str, ...], most: int) -> Column:
    """The first words that aren't stop words, joined by spaces."""
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}+#-]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))
    return F.array_join(F.slice(words, 1, most), " ")
