"""Ranking scalars as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TITLE_BOOST, BODY_BOOST = 2.0, 1.0


def idf(total: int, df: int) -> float:
    """Not clamped: negative for terms in more than half of the documents."""
    return math.log((total - df + 0.5) / (df + 0.5))


def idf_column(total: Column, df: Column) -> Column:
    return F.log((total - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _normalized(tf: Column, length: Column, average: float) -> Column:
    if average <= 0:
        return F.lit(0.0)
    return tf / (F.lit(1 - B) + F.lit(B) * length / F.lit(average))


def fielded_bm25(tf_title: Column, tf_body: Column, title_len: Column, body_len: Column, avg_title: float, avg_body: float, weight: float | Column) -> Column:
    """Two fields: each frequency is normalized by its field's length, then summed with boosts and
    saturated once."""
    tf = F.lit(TITLE_BOOST) * _normalized(tf_title, title_len, avg_title) + F.lit(BODY_BOOST) * _normalized(tf_body, body_len, avg_body)
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return F.when(tf > 0, weight * tf * F.lit(K1 + 1) / (tf + F.lit(K1))).otherwise(0.0)


def plain_bm25(tf: Column, length: Column, average: float, weight: float | Column) -> Column:
    """One field."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    if average <= 0:
        return F.lit(0.0)
    return weight * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(average)))
