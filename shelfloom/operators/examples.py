"""Worked examples for the prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.functions.prompts import example_texts, row_json
from shelfloom.functions.text import is_json, strip
from shelfloom.operators.prepare import split_known_ids
from shelfloom.session import materialise

# Examples are copied into every prompt, so they have to fit into one; this is far above any model.
MAX_EXAMPLE_BYTES = 8 * 1024 * 1024


def literal_examples(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Examples given in the program: id, properties, title, description."""
    return spark.createDataFrame(rows, S.EXAMPLES)


def _from_rows(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "id"]
    return rows.select("id", row_json(others).alias("properties"), "title", "description")


def examples_by_ids(source: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the source as examples, and the ids that were not found."""
    found, missing = split_known_ids(source, ids)
    return _from_rows(found), missing


def examples_by_metric(raw: DataFrame, metric: str, columns: list[str], k: int = 3) -> DataFrame:
    """The k best rows by a metric as examples; ties go to the smaller id.

    The best ids are found first and named in a filter, so that a feed joined of tables moves the texts
    of k rows and not of all.
    """
    best = raw.select("id", metric).orderBy(F.col(metric).desc(), "id").limit(k)
    ids = [r["id"] for r in best.select("id").collect()]
    named = F.col("id").isin([i for i in ids if i is not None])
    kept = raw.where(named | F.col("id").isNull() if None in ids else named)
    return kept.orderBy(F.col(metric).desc(), "id").limit(k).select("id", row_json(columns).alias("properties"), "title", "description")


def examples_from_texts(texts: DataFrame, prepared: DataFrame) -> DataFrame:
    """Hand-written titles and descriptions with the properties of their items."""
    others = [c for c in prepared.columns if c != "id"]
    properties = prepared.select("id", row_json(others).alias("properties"))
    return texts.join(properties, "id").select("id", "properties", "title", "description")


def clean_examples(rows: DataFrame, stable_ids: bool = False) -> DataFrame:
    """Examples of a file: trimmed, blank rows and rows without valid JSON left out, new ids."""
    cells = rows.select(
        *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("properties", "title", "description")]
    )
    kept = cells.where(
        (F.concat("properties", "title", "description") != "") & is_json(F.col("properties"))
    )
    new_id = F.md5("properties") if stable_ids else F.expr("uuid()")
    return kept.select(new_id.alias("id"), "properties", "title", "description")


def examples_preview(examples: DataFrame, n: int = 5) -> tuple[int, DataFrame]:
    """How many examples there are, and a few of them."""
    return examples.count(), examples.limit(n)


def example_blocks(examples: DataFrame, max_bytes: int = MAX_EXAMPLE_BYTES) -> Column:
    """The texts prompts copy from the examples, as a value to be used in any row.

    The examples are stored once and their total size is checked, by a sum over the table, before
    they meet in one row; prompts then read the stored rows however the examples were chosen.
    """
    stored = materialise(examples.select("id", "properties", "title", "description"), "examples")
    lengths = [F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in stored.columns]
    total = stored.agg(F.coalesce(F.sum(sum(lengths, F.lit(0))), F.lit(0))).first()[0]
    if total > max_bytes:
        raise ValueError(f"examples take {total} bytes, more than the {max_bytes} a prompt may hold")
    rows = F.array_sort(F.collect_list(F.struct("id", "properties", "title", "description")))
    gathered = stored.agg(rows.alias("examples"))
    return gathered.select(example_texts(F.col("examples")).alias("texts")).scalar()
