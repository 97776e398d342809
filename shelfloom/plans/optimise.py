"""Titles and descriptions of the rows that have none yet, scored and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import prompts as P
from shelfloom.functions.pages import page_text
from shelfloom.generator import Generator
from shelfloom.operators.prepare import spread_left_join, unprocessed
from shelfloom.operators.scoring import (
    ORIGINALS,
    Scoring,
    described,
    generated_record,
    scored_titles,
    with_item,
    with_originals,
)
from shelfloom.session import materialise


def with_landing_page(
    items: DataFrame, pages: DataFrame | None, url_col: str = "url"
) -> DataFrame:
    """Add ``page_info``: the text of each row's page (url, html, content_type), '' without one.

    Pages are read once per link, not once per row.
    """
    if pages is None:
        return items.withColumn("page_info", F.lit(""))
    texts = pages.select(
        F.col("url").alias(url_col),
        page_text(F.col("html"), F.col("content_type")).alias("_text"),
    )
    single = texts.groupBy(url_col).agg(F.min("_text").alias("_text"))
    joined = spread_left_join(items, single, url_col)
    return joined.withColumn("page_info", P.page_note(F.coalesce("_text", F.lit("")))).drop("_text")


def title_prompts(items: DataFrame, instructions: str) -> DataFrame:
    """``prompt`` for the title of each item."""
    context = F.to_json("item")
    return items.withColumn("prompt", P.context_prompt(instructions, context, F.col("page_info")))


def description_prompts(items: DataFrame, instructions: str) -> DataFrame:
    """``prompt`` for the description: the context starts with the generated title."""
    own = F.col("item")["Generated Title"]
    first = F.create_map(F.lit("Generated Title"), F.coalesce(own, F.col("title_generated")))
    rest = F.map_filter("item", lambda k, v: k != "Generated Title")
    context = F.to_json(F.map_concat(first, rest))
    return items.withColumn("prompt", P.context_prompt(instructions, context, F.col("page_info")))


def optimise(
    feed: DataFrame,
    title_generator: Generator,
    description_generator: Generator,
    settings: Scoring = Scoring(),
    generated: DataFrame | None = None,
    pages: DataFrame | None = None,
    url_col: str = "url",
    title_wording: str = "",
    description_wording: str = "",
    tasks: int | None = None,
) -> DataFrame:
    """Result rows for the input rows that have no finished result yet.

    Each of the two model steps is written out before the next one reads it. ``tasks`` deals the rows
    by id over so many tasks before the first step, at any size: rows are small and the work on them is
    not. The steps after it read the files of those tasks. Original texts are written within the item alone.
    """
    todo = feed if generated is None else unprocessed(feed, generated, settings.id_col)
    paged = with_landing_page(todo, pages, url_col)
    if tasks is not None:
        # Before the item repeats the texts of a row.
        paged = paged.repartition(tasks, F.col(settings.id_col).cast("string"))
    items = with_item(paged, settings, columns=todo.columns, keep=("page_info",))
    if settings.titles:
        asked = title_generator.generate(title_prompts(items, title_wording))
        replied = asked.withColumnRenamed("reply", "title_reply").drop("prompt", "status", *ORIGINALS)
        items = with_originals(materialise(replied, "titles"), settings)
    titled = scored_titles(items, settings)
    if settings.descriptions:
        asked = description_generator.generate(description_prompts(titled, description_wording))
        replied = asked.withColumnRenamed("reply", "description_reply").drop("prompt", "status", *ORIGINALS)
        titled = with_originals(materialise(replied, "descriptions"), settings)
    return generated_record(described(titled, settings), settings)
