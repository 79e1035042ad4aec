"""Ordering, paging and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranges import Page


def page(df: DataFrame, order: list[Column], part: Page | None) -> DataFrame:
    """One page of an ordered frame; with no page, all rows in order.

    The order must end in a unique column. Every task keeps offset + limit rows at most.
    """
    ordered = df.orderBy(*order)
    if part is None:
        return ordered
    if part.offset:
        ordered = ordered.offset(part.offset)
    return ordered.limit(part.limit)


def total(df: DataFrame) -> DataFrame:
    """Number of rows behind a page."""
    return df.agg(F.count("*").alias("total"))


def top_k(df: DataFrame, measure: str, tie: str, k: int | None = None) -> DataFrame:
    """Rows with the largest measure, missing measures last; all of them when k is None."""
    ordered = df.orderBy(F.col(measure).desc_nulls_last(), F.col(tie))
    return ordered if k is None else ordered.limit(k)


def equal_to(**wanted) -> Column:
    """Equality filters; None means no filter."""
    test = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            test = test & (F.col(name) == value)
    return test


def member_of(name: str, values) -> Column:
    """List membership; an empty or missing list means no filter."""
    return F.col(name).isin(*values) if values else F.lit(True)
