"""Quantiles of a metric from small sketches that are stored and merged, beside the exact band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.session import materialise

# Size of a sketch. A quantile's rank is off by at most ``rank_error`` of all rows, in 99 of 100 draws.
SIZE = 1600


def rank_error(size: int = SIZE) -> float:
    """Share of all rows by which the rank of a quantile may be off (published bound of this sketch)."""
    return 2.296 / size**0.9021


def metric_sketches(feed: DataFrame, metric: str, by: list[str], size: int = SIZE) -> DataFrame:
    """``by`` columns, ``sketch`` and ``rows``: one small value for each day, part or source of a feed.

    Sketches form within each task before they travel. Null values take no part.
    """
    value = F.col(f"`{metric}`").cast("double")
    return feed.where(value.isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"),
        F.count(F.lit(1)).alias("rows"),
        F.min(value).alias("least"),
    )


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of larger units, or of everything, from those of smaller ones."""
    return sketches.groupBy(*(by or [])).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("rows").alias("rows"), F.min("least").alias("least")
    )


def quantile(share: float) -> Column:
    """The value with about that share of all rows at or below it."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def sketched_band(feed: DataFrame, metric: str, sketches: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """``metric_band`` with the 99th percentile of stored sketches: the feed is not
    read to find it.

    The upper end stands for a percentile between 99 minus and 99 plus ``100 * rank_error``.
    """
    # Merging draws at random, so its result is written before it is read twice.
    ends = materialise(merged(sketches).select("least", quantile(0.99).alias("most")), "band")
    least, most = ends.select("least").scalar(), ends.select("most").scalar()
    value = F.col(f"`{metric}`")
    return feed.where(value.between(least + low * (most - least), least + high * (most - least)))
