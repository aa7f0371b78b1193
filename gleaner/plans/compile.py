"""Query trees as columns over one row per document.

A hit row has, for every token of the query, the array of its positions (null where the document lacks
it), besides title_len and body_len. A tree becomes a condition, a score, a term frequency and the list
of matches, all of them columns, so that a query is one aggregation and one projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.ranking import fielded_bm25
from gleaner.plans.nodes import And, Node, Not, Or, Phrase, Term

MATCH = "struct<token:string,frequency:int,tf_title:int,tf_body:int,positions:array<int>>"


@dataclass(frozen=True)
class Scorer:
    """What scores depend on besides the row: averages and the weight of each token."""

    avg_title: float
    avg_body: float
    weights: dict[str, float]


@dataclass(frozen=True)
class Compiled:
    matched: Column
    score: Column
    frequency: Column
    matches: Column


def position_column(tokens: list[str], token: str) -> str:
    return f"_p{tokens.index(token)}"


def _shifted(positions: Column, by: int) -> Column:
    # A closure for each shift: a second lambda parameter would be taken for the element's index.
    return F.transform(positions, lambda p: p + F.lit(by))


def _occurrence(token: str, positions: Column, scorer: Scorer) -> tuple[Column, Column]:
    """(score, match) of one token at ``positions``."""
    tf_title = F.size(F.filter(positions, lambda p: p < F.col("title_len")))
    frequency = F.size(positions)
    tf_body = frequency - tf_title
    score = fielded_bm25(tf_title, tf_body, F.col("title_len"), F.col("body_len"), scorer.avg_title, scorer.avg_body, scorer.weights[token])
    match = F.struct(F.lit(token).alias("token"), frequency.alias("frequency"), tf_title.alias("tf_title"), tf_body.alias("tf_body"), positions.alias("positions"))
    return score, F.array(match.cast(MATCH))


def _both(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def compile_tree(node: Node, tokens: list[str], scorer: Scorer) -> Compiled:
    """``tokens`` are the distinct tokens of the tree in the order of the hit row's columns."""
    none = F.array().cast(f"array<{MATCH}>")

    def positions_of(token: str) -> Column:
        return F.coalesce(F.col(position_column(tokens, token)), F.array().cast("array<int>"))

    match node:
        case Term(token):
            found = positions_of(token)
            score, match = _occurrence(token, found, scorer)
            return Compiled(F.col(position_column(tokens, token)).isNotNull(), score, F.size(found), match)
        case Phrase(words):
            starts = reduce(F.array_intersect, [_shifted(positions_of(w), -i) for i, w in enumerate(words)])
            parts = [_occurrence(w, _shifted(starts, i), scorer) for i, w in enumerate(words)]
            return Compiled(F.size(starts) > 0, _sum([s for s, _ in parts]), F.size(starts), F.concat(*[m for _, m in parts]))
        case And(children):
            inside = [compile_tree(c, tokens, scorer) for c in children if not isinstance(c, Not)]
            outside = [compile_tree(c.child, tokens, scorer) for c in children if isinstance(c, Not)]
            matched = _both([c.matched for c in inside] + [~c.matched for c in outside])
            return Compiled(matched, _sum([c.score for c in inside]), _sum([c.frequency for c in inside]), F.concat(*[c.matches for c in inside]))
        case Or(children):
            parts = [compile_tree(c, tokens, scorer) for c in children]
            return Compiled(
                _any([c.matched for c in parts]),
                _sum([F.when(c.matched, c.score).otherwise(0.0) for c in parts]),
                _sum([F.when(c.matched, c.frequency).otherwise(0) for c in parts]),
                F.concat(*[F.when(c.matched, c.matches).otherwise(none) for c in parts]),
            )
    raise TypeError(f"not part of a valid tree: {node}")
