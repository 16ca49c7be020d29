"""Expansion of queries by a glossary of acronyms and the forms they stand for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_plain, tokens

#: Fixed value: terms that an expansion adds at most.
MOST_TERMS = 8


def with_entry(glossary: Mapping[str, Sequence[str]], acronym: str, forms: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The glossary with an entry added, or put in place of the one whose acronym reads alike."""
    kept = {a: tuple(f) for a, f in glossary.items() if fold_plain(a) != fold_plain(acronym)}
    return kept | {acronym: tuple(forms)}


def contains_sequence(own: Column, phrase: str) -> Column:
    """Whether the tokens of a phrase stand in a row in an array of tokens; no tokens stand nowhere."""
    wanted = fold_plain(phrase)
    if not wanted:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")).contains(f" {wanted} ")


def expand(query: Column, glossary: Mapping[str, Sequence[str]]) -> Column:
    """The query with the forms of its acronyms and the acronyms of its forms appended.

    Terms that the query has already are skipped, repeats are dropped, and at
    most MOST_TERMS are added.  The glossary is a parameter that is read into
    the plan, so it must be small.
    """
    own = tokens(query)
    acronyms: dict[str, list[str]] = {}
    for acronym, forms in glossary.items():
        for form in forms:
            acronyms.setdefault(fold_plain(form), []).append(acronym)
    steps = [(a, [(f, ~contains_sequence(own, f)) for f in forms]) for a, forms in glossary.items()]
    present = lambda a: F.size(F.array_except(F.array(*map(F.lit, fold_plain(a).split() or [""])), own)) == 0
    steps += [(form, [(a, ~present(a)) for a in names]) for form, names in acronyms.items()]
    parts = [F.when(contains_sequence(own, trigger) & wanted, F.lit(term)) for trigger, terms in steps for term, wanted in terms]
    if not parts:
        return query
    added = F.slice(F.array_distinct(F.array_compact(F.array(*parts))), 1, MOST_TERMS)
    return F.when(F.size(added) > 0, F.concat(query, F.lit(" "), F.array_join(added, " "))).otherwise(query)
