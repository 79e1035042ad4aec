"""Price lookup for model names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# A model without a published price and the one whose price it takes.
ALIASES = {"gpt-5.3-codex": "gpt-5.2-codex"}
PREFIXES = ("openai/", "azure/", "anthropic/")

PRICES = ["input_price", "cache_price", "output_price"]


def candidates(model, aliases: dict[str, str] | None = None):
    """Price keys to try for a model name, best first, as an array column."""
    names = [model]
    for name, target in (ALIASES if aliases is None else aliases).items():
        ends = F.when(model.endswith("/" + name),
                      F.concat(F.substring_index(model, "/" + name, 1), F.lit("/" + target)))
        names.append(F.when(model == name, F.lit(target)).otherwise(ends))
        names.append(F.when(model.endswith("/" + name), F.lit(target)))
    for name in list(names):
        names += [F.concat(F.lit(p), name) for p in PREFIXES]
        names.append(F.replace(F.concat(F.lit("openai/"), name), F.lit("."), F.lit("-")))
    return F.array(*names)


def with_price(df: DataFrame, price: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Add the price columns for ``model``; null where no price is known.

    ``df`` is aggregated by model already and holds no row twice. Each row tries its few
    candidates against the price table; what it finds is brought together again in the task
    that tried them, so the facts behind ``df`` are read once and its rows travel once.
    The first candidate with an entry counts, even if that entry has no price.
    """
    model = strip(F.col("model"))
    known = F.col("model").isNotNull() & (model != "") & (F.col("model") != "unknown")
    tried = df.select("*", F.posexplode_outer(F.when(known, F.array_compact(candidates(model, aliases)))).alias("_rank", "_key"))
    entry = F.struct(*[F.when(F.col("input_price").isNotNull() & F.col("output_price").isNotNull(),
                              F.coalesce(p, "input_price") if p == "cache_price" else F.col(p)).alias(p) for p in PRICES])
    entries = price.select(F.col("model").alias("_key"), entry.alias("_entry"))
    found = tried.join(entries, "_key", "left").groupBy(*df.columns).agg(
        F.min_by("_entry", F.when(F.col("_entry").isNotNull(), F.col("_rank"))).alias("_entry"))
    return found.select(*df.columns, *[F.col("_entry")[p].alias(p) for p in PRICES])
