"""The query tree and its rewrites; nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be answered."""


NEEDS_POSITIVE = "query must contain at least one positive term"
LONE_NOT = "NOT expressions must be combined with a positive search term"


@dataclass(frozen=True)
class Term:
    token: str


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    child: Node | None


Node = Term | Phrase | And | Or | Not


def positive_tokens(node: Node) -> list[str]:
    """Tokens outside negations, in order, with duplicates."""
    match node:
        case Term(token):
            return [token]
        case Phrase(tokens):
            return list(tokens)
        case And(children) | Or(children):
            return [t for c in children for t in positive_tokens(c)]
    return []


def all_tokens(node: Node) -> list[str]:
    """Every token, negated ones too."""
    match node:
        case Not(child):
            return all_tokens(child) if child else []
        case And(children) | Or(children):
            return [t for c in children for t in all_tokens(c)]
    return positive_tokens(node)


def prune(node: Node, keep: Callable[[str], bool]) -> Node | None:
    """Drops terms that aren't kept. A phrase stays whole if any of its tokens is kept; groups left with
    one child become that child; negations stay as they are."""
    match node:
        case Term(token):
            return node if keep(token) else None
        case Phrase(tokens):
            return node if any(map(keep, tokens)) else None
        case And(children) | Or(children):
            left = [p for c in children if (p := prune(c, keep)) is not None]
            if not left:
                return None
            return left[0] if len(left) == 1 else type(node)(tuple(left))
    return node


def validate(node: Node) -> None:
    """Raises for trees that have no positive part where one is needed."""
    match node:
        case Not():
            raise QueryError(LONE_NOT)
        case And(children):
            if all(isinstance(c, Not) for c in children):
                raise QueryError(NEEDS_POSITIVE)
            for c in children:
                if isinstance(c, Not):
                    if c.child is None:
                        raise QueryError("negation is missing an operand")
                    validate(c.child)
                else:
                    validate(c)
        case Or(children):
            for c in children:
                validate(c)


def expand(node: Node, synonyms: Callable[[str], list[str]]) -> Node:
    """Terms become a term or any of its synonyms; a negated term excludes all of them. Phrases stay."""
    match node:
        case Term(token):
            return Or((node, *[Term(s) for s in synonyms(token)]))
        case And(children) | Or(children):
            return type(node)(tuple(expand(c, synonyms) for c in children))
        case Not(child) if child is not None:
            return Not(expand(child, synonyms))
    return node
