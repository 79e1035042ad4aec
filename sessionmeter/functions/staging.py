"""Computing long expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a one-row generator.

    The optimizer copies a projected expression into every filter and projection above that
    names it, which for chains of JSON lookups multiplies both plan and work. Generator
    output is a plain attribute for all later steps.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
