"""Merchant feeds and the feed of approved rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.text import embed_for_feed, highlight
from shelfloom.session import materialise


@dataclass(frozen=True)
class Flags:
    """Which generated texts an export carries."""

    title: bool = True
    description: bool = True
    highlights: bool = True

    def chosen(self) -> list[str]:
        return [c for c in ("title", "description", "highlights") if getattr(self, c)]


def eligible(columns: list[str], mode: str = "any") -> Column:
    """Rows that have any, or all, of the texts."""
    tests = [F.col(c).isNotNull() for c in columns]
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), tests)


def supplemental_feed(source: DataFrame, flags: Flags = Flags(), mode: str = "any") -> DataFrame:
    """Generated texts only, marked as such."""
    columns = [F.col("id")]
    if flags.title:
        columns.append(embed_for_feed(F.col("title"), True).alias("structured_title"))
    if flags.description:
        columns.append(embed_for_feed(F.col("description"), True).alias("structured_description"))
    if flags.highlights:
        columns.append(highlight(F.col("highlights")).alias("product_highlight"))
    return source.where(eligible(flags.chosen(), mode)).select(*columns)


def full_feed(raw: DataFrame, output: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """The whole feed with generated texts where there are any, original ones elsewhere."""
    texts = output.select("id", *[F.col(c).alias(f"_{c}") for c in flags.chosen()])
    joined = raw.join(texts, "id", "left")
    replaced = {"title": flags.title, "description": flags.description}
    replaced["product_highlight"] = flags.highlights
    columns = [F.col(f"`{c}`") for c in raw.columns if not replaced.get(c, False)]
    for name in ("title", "description"):
        if getattr(flags, name):
            text, made = F.coalesce(f"_{name}", name), F.col(f"_{name}").isNotNull()
            columns.append(embed_for_feed(text, made).alias(f"structured_{name}"))
    if flags.highlights:
        old = "product_highlight" in raw.columns
        original = F.col("product_highlight") if old else F.lit(None).cast("string")
        made = F.when(F.col("_highlights").isNotNull(), highlight(F.col("_highlights")))
        columns.append(made.otherwise(original).alias("product_highlight"))
    return joined.select(*columns)


def approve_where(generated: DataFrame, condition: Column | str) -> DataFrame:
    """Approve the rows a condition selects; all others keep their mark."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    return generated.withColumn("approval", F.when(test, True).otherwise(F.col("approval")))


def attribute_keys(generated: DataFrame, order_by: str = "id") -> DataFrame:
    """Filled and invented attributes in order of first appearance.

    The keys of each row are written once, so that rows which are costly to derive are derived once.
    Keys are reduced to their first place within each task, so frequent ones do not pile up.
    """
    listed = {c: F.when(F.col(c) != "", F.json_object_keys(c)) for c in ("original_input", "gap_attributes")}
    rows = materialise(generated.select(F.col(order_by).alias("_at"), *[k.alias(c) for c, k in listed.items()]), "keys")

    def first_places(column: str) -> DataFrame:
        return (
            rows.select("_at", F.posexplode(column).alias("_pos", "key"))
            .groupBy("key")
            .agg(F.min(F.struct("_at", "_pos")).alias("first"))
        )

    inputs = first_places("original_input").select("key", F.lit(True).alias("_known"))
    return first_places("gap_attributes").join(inputs, "key", "left").select(
        "key", F.coalesce("_known", F.lit(False)).alias("in_input"), "first"
    )


def attribute_columns(generated: DataFrame, max_columns: int, order_by: str = "id") -> list[tuple]:
    """(key, in_input) of the columns of the approved feed: gaps of the input, then inventions.

    The list becomes columns, so it has to be short; beyond ``max_columns`` use ``approved_long``.
    """
    ordered = attribute_keys(generated, order_by).orderBy(F.col("in_input").desc(), "first", "key")
    rows = ordered.limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} attributes; export them with approved_long")
    return [(r["key"], r["in_input"]) for r in rows]


def approved(generated: DataFrame) -> DataFrame:
    return generated.where(F.col("approval") == F.lit(True))


def stamp() -> Column:
    """The present time in UTC as text."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def approved_feed(
    generated: DataFrame, prefix: str = "new-", max_columns: int = 1000, order_by: str = "id"
) -> DataFrame:
    """Approved rows with a time stamp, their texts and one column per attribute.

    Attributes that no input column carries get the prefix; missing values are empty.
    """
    rows = approved(generated)
    values = F.from_json(F.col("gap_attributes"), "map<string,string>")
    columns = [
        F.coalesce(values[key], F.lit("")).alias(key if known else prefix + key)
        for key, known in attribute_columns(rows, max_columns, order_by)
    ]
    return rows.select(
        stamp().alias("modified"),
        F.col("id").alias("Item ID"),
        F.col("title_generated").alias("Title"),
        F.col("description_generated").alias("Description"),
        *columns,
    )


def approved_long(generated: DataFrame) -> DataFrame:
    """Approved rows' attributes as rows of id, key and value, for any number of attributes.

    What is read is written first: a filter on derived columns would derive them once for every use.
    """
    values = F.from_json(F.col("gap_attributes"), "map<string,string>")
    rows = materialise(generated.select("id", "approval", "gap_attributes"), "gaps")
    return approved(rows).where("gap_attributes <> ''").select(
        "id", F.explode(values).alias("key", "value")
    )
