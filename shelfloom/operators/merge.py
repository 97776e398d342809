"""The output table: a new snapshot from the old one and the results of a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.schemas import Target
from shelfloom.sources.records import table_versions


def init_output(ids: DataFrame) -> DataFrame:
    """One row per input id, without texts or tries."""
    filled = {"id": F.col("id").cast("string"), "tries": F.lit(0).cast("long")}
    return ids.select(
        *[
            filled.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in S.OUTPUT.fields
        ]
    )


def empty_output(spark: SparkSession) -> DataFrame:
    """An output table without rows."""
    return spark.createDataFrame([], S.OUTPUT)


def merge_matched(output: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """Matched rows take the new text unless it is null, and count one more try.

    ``results`` has one row per id (id, text); rows of the output that it does not name stay.
    """
    found = results.select("id", F.col("text").alias("_text"), F.lit(True).alias("_asked"))
    asked = F.col("_asked").isNotNull()
    return output.join(found, "id", "left").select(
        *[
            F.coalesce("_text", column).alias(column)
            if c == column
            else F.when(asked, F.col(c) + 1).otherwise(F.col(c)).alias(c)
            if c == "tries"
            else F.when(asked, F.current_timestamp()).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in output.columns
        ]
    )


def capture_raw(output: DataFrame, raw: DataFrame, target: Target) -> DataFrame:
    """Matched rows take the raw reply of this pass."""
    joined = output.join(raw.select("id", F.col("raw").alias("_raw")), "id", "left")
    return joined.select(
        *[
            F.coalesce("_raw", c).alias(c) if c == target.raw_column else F.col(c)
            for c in output.columns
        ]
    )


def upsert(output: DataFrame, results: dict[str, DataFrame], keep_old: bool = True) -> DataFrame:
    """Update known ids and insert unknown ones, for all targets in one join.

    ``results`` maps a target name to rows of id, text and raw. Each target an id has a result for
    counts as one try, unless the row holds that very reply already: loading replies twice does not
    count twice. Several results for one id come down to the smallest raw reply before the
    shuffle. With ``keep_old`` a null text leaves the old one in place.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [
            df.where("id is not null").select("id", "text", "raw", F.lit(name).alias("target"))
            for name, df in results.items()
        ],
    )

    def best(name: str):
        return F.min(F.when(F.col("target") == name, F.struct("raw", "text"))).alias(f"_{name}")

    news = stacked.groupBy("id").agg(*[best(name) for name in results])
    # Rows without an id match nothing; in a full join they would all meet in one task.
    lone = output.where("id is null")
    joined = output.where("id is not null").join(news, "id", "full_outer")

    def is_new(name: str):
        # A reply without content is held as an empty one, so that it is known when it comes again.
        new = F.col(f"_{name}")
        held = F.coalesce(new["raw"], F.lit("")).eqNullSafe(F.col(S.TARGETS[name].raw_column))
        return (new.isNotNull() & ~held).cast("long")

    counted = sum(map(is_new, results), F.lit(0).cast("long"))
    values = {
        "tries": F.coalesce(F.col("tries"), F.lit(0).cast("long")) + counted,
        "updated_at": F.when(counted > 0, F.current_timestamp()).otherwise(F.col("updated_at")),
    }
    # Rows without any result keep their number of tries, even a missing one.
    values["tries"] = F.when(counted > 0, values["tries"]).otherwise(F.col("tries"))
    for name in results:
        target, new = S.TARGETS[name], F.col(f"_{name}")
        text, raw = new["text"], F.coalesce(new["raw"], F.lit(""))
        if keep_old:
            text = F.coalesce(text, F.col(target.column))
        else:
            text = F.when(new.isNotNull(), text).otherwise(F.col(target.column))
        values[target.column] = text
        values[target.raw_column] = F.when(new.isNotNull(), raw).otherwise(F.col(target.raw_column))
    merged = joined.select(*[values.get(c, F.col(c)).alias(c) for c in output.columns])
    return merged.unionByName(lone)


def save_snapshot(output: DataFrame, root: str) -> str:
    """Write the next version of the output table; the version being read stays untouched."""
    versions = table_versions(output.sparkSession, root)
    path = f"{root}/v={(versions[-1] + 1 if versions else 1):06d}"
    output.write.parquet(path)
    return path


def save_with_progress(output: DataFrame, root: str) -> tuple[str, dict[str, int]]:
    """``save_snapshot``, and what ``progress`` would count, taken from the rows as they are written."""
    seen = Observation()
    path = save_snapshot(output.observe(seen, *progress_counts()), root)
    return path, seen.get


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest version that was written to its end, or an empty table."""
    versions = table_versions(spark, root)
    if not versions:
        return empty_output(spark)
    return spark.read.schema(S.OUTPUT).parquet(f"{root}/v={versions[-1]:06d}")


def progress(output: DataFrame) -> DataFrame:
    """How many rows there are and how many have each text."""
    return output.agg(*progress_counts())


def progress_counts() -> list[Column]:
    """The aggregates of ``progress``."""
    counts = [F.count(t.column).alias(t.name) for t in S.TARGETS.values()]
    return [F.count(F.lit(1)).alias("total"), *counts]
