"""Price table from the usual JSON map of model name to costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "map<string, struct<input_cost_per_token: double, output_cost_per_token: double, cache_read_input_token_cost: double>>"


def price_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``model, input_price, output_price, cache_price``, one per entry.

    Entries without both main prices (an image model's, say) stay: they end the search for a
    price without finding one. A price that is null counts as missing. A missing cache price is
    later taken from the input price.
    """
    return prices_of(spark.read.text(path, wholetext=True))


def prices_of(text: DataFrame) -> DataFrame:
    """The same from rows of such JSON maps in ``value``."""
    entries = text.select(F.explode(F.from_json("value", _ENTRY)).alias("model", "p"))
    return entries.select("model", F.col("p.input_cost_per_token").alias("input_price"),
                          F.col("p.output_cost_per_token").alias("output_price"),
                          F.col("p.cache_read_input_token_cost").alias("cache_price"))
