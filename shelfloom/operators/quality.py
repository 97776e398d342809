"""How far generated texts moved from the original ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.text import cosine_distance


def pair_vectors(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    """The two vectors of each id side by side."""
    return a.select(on, F.col("vec").alias("vec_a")).join(
        b.select(on, F.col("vec").alias("vec_b")), on
    )


def distances(pairs: DataFrame) -> DataFrame:
    """Cosine distance per id; a vector without length has none."""
    return pairs.select("id", cosine_distance(F.col("vec_a"), F.col("vec_b")).alias("distance"))


def similarity_histogram(dist: DataFrame, digits: int | None = None) -> DataFrame:
    """How many ids fall into each tenth of distance; ``digits`` rounds noise away first."""
    value = F.col("distance") if digits is None else F.round("distance", digits)
    bucket = (F.ceil(value * 10).cast("double") / 10).alias("distance_bucket")
    return dist.groupBy(bucket).agg(F.count(F.lit(1)).alias("items")).orderBy("distance_bucket")
