"""Where synonyms come from. Any callable from a term to a list of words will do."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import tokenize_term
from gleaner.plans.nodes import Node, expand, positive_tokens

MOST = 2
Provider = Callable[[str], Sequence[str]]


def from_mapping(table: Mapping[str, Sequence[str]], most: int = MOST) -> Provider:
    return lambda term: list(table.get(term, ()))[:most]


def from_table(rows: DataFrame, terms: Sequence[str], most: int = MOST) -> Provider:
    """The best ``most`` rows by rank of a (term, synonym, rank) table, for the terms of one query."""
    found = rows.where(F.col("term").isin(list(terms))).orderBy("term", "rank", "synonym").select("term", "synonym").collect()
    table: dict[str, list[str]] = {}
    for r in found:
        table.setdefault(r["term"], []).append(r["synonym"])
    return from_mapping(table, most)


def expanded(tree: Node, provider: Provider, query: str) -> Node:
    """The tree with synonyms that aren't part of the query, reduced to their first token."""

    def of(term: str) -> list[str]:
        words = [tokenize_term(w) for w in provider(term) if w.lower() not in query]
        return [w for w in dict.fromkeys(words) if w and w != term]

    return expand(tree, of)


def terms_of(tree: Node) -> list[str]:
    return list(dict.fromkeys(positive_tokens(tree)))
