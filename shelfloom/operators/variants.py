"""Attributes as VARIANT: parsed once when they are stored, read by path afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.operators.export import approved, stamp
from shelfloom.session import materialise

ATTRIBUTES = ("original_input", "gap_attributes")


def with_variants(records: DataFrame, columns: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """The records with JSON columns as variants; text that is empty or no JSON is null."""
    return records.withColumns({c: F.try_parse_json(F.nullif(F.col(c), F.lit(""))) for c in columns})


def path_to(key: str) -> str:
    """The path of a key of an object, whatever characters it has but both kinds of quotes."""
    for quote in "'\"":
        if quote not in key:
            return f"$[{quote}{key}{quote}]"
    raise ValueError(f"a key with both kinds of quotes has no path: {key}")


def variant_keys(records: DataFrame, column: str) -> DataFrame:
    """``key, first``: the keys of a variant column and the smallest id that has each.

    Ids are reduced within each task; a variant holds its keys in order of name, so their order within
    a row is not known.
    """
    objects = records.where(F.schema_of_variant(column).startswith("OBJECT")).select("id", column)
    spark = records.sparkSession
    pairs = objects.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()))
    return pairs.groupBy("key").agg(F.min("id").alias("first"))


def approved_variants(records: DataFrame, prefix: str = "new-", max_columns: int = 1000) -> DataFrame:
    """The feed of approved rows from stored variants, a column per attribute; see ``approved_feed``.

    Columns go by the first id that has them, those of the input before invented ones.
    """
    rows = approved(records)
    known = variant_keys(rows, "original_input").select("key", F.lit(True).alias("known"))
    keys = variant_keys(rows, "gap_attributes").join(known, "key", "left")
    keys = keys.select("key", F.coalesce("known", F.lit(False)).alias("known"), "first")
    found = keys.orderBy(F.col("known").desc(), "first", "key").limit(max_columns + 1).collect()
    if len(found) > max_columns:
        raise ValueError(f"more than {max_columns} attributes; export them with variants_long")
    columns = [value(r["key"]).alias(r["key"] if r["known"] else prefix + r["key"]) for r in found]
    return rows.select(
        stamp().alias("modified"),
        F.col("id").alias("Item ID"),
        F.col("title_generated").alias("Title"),
        F.col("description_generated").alias("Description"),
        *columns,
    )


def value(key: str, column: str = "gap_attributes") -> Column:
    """The text of a key, empty where the row has none."""
    return F.coalesce(F.try_variant_get(column, path_to(key), "string"), F.lit(""))


def variants_long(records: DataFrame) -> DataFrame:
    """Approved rows' attributes as rows of id, key and value, for any number of attributes."""
    rows = approved(records).where(F.schema_of_variant("gap_attributes").startswith("OBJECT"))
    spark = records.sparkSession
    pairs = rows.select("id", "gap_attributes").lateralJoin(spark.tvf.variant_explode(F.col("gap_attributes").outer()))
    return pairs.select("id", "key", F.try_variant_get("value", "$", "string").alias("value"))


def store_variants(records: DataFrame, columns: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Write the records with variants and read them back: later readers parse no JSON."""
    return materialise(with_variants(records, columns), "variants")
