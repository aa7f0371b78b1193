"""Tokenizing, as columns and (for queries) on the driver, with equal results."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
TOKEN = r"([\p{L}\p{Nd}]+)"
#: Letters whose full lower-casing isn't one letter for one; these pairs make it so.
_FROM, _TO = "İΣ", "iσ"
_SIMPLE = str.maketrans(_FROM, _TO)


def lower(text: Column) -> Column:
    """Lower case letter by letter, independent of neighbours."""
    return F.lower(F.translate(text, _FROM, _TO))


def raw_tokens(text: Column) -> Column:
    """Maximal runs of letters and decimal digits, lower-cased, stopwords included."""
    return F.regexp_extract_all(lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tokens(text: Column) -> Column:
    """Tokens in order, without stopwords; duplicates stay."""
    return F.filter(raw_tokens(text), lambda t: ~t.isin(*sorted(STOPWORDS)))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def lower_text(text: str) -> str:
    """``lower`` on the driver."""
    return text.translate(_SIMPLE).lower()


def is_token_char(ch: str) -> bool:
    category = unicodedata.category(ch)
    return category[0] == "L" or category == "Nd"


def tokenize(text: str) -> list[str]:
    """``tokens`` on the driver."""
    words, word = [], []
    for ch in lower_text(text) + " ":
        if is_token_char(ch):
            word.append(ch)
        elif word:
            words.append("".join(word))
            word = []
    return [w for w in words if w not in STOPWORDS]


def tokenize_term(text: str) -> str:
    """The first token, or nothing."""
    return next(iter(tokenize(text)), "")
