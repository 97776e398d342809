"""Fill one attribute of a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom.functions.envelopes import (
    candidates_payload,
    first_text,
    id_from_request,
    parts_request,
)
from shelfloom.functions.prompts import attribute_instructions
from shelfloom.generator import Generator
from shelfloom.session import materialise


def attribute_requests(
    feed: DataFrame,
    id_col: str,
    title_col: str,
    description_col: str,
    attribute: str,
    language: str,
    meaning: str = "",
) -> DataFrame:
    """One request line per feed row."""
    wording = attribute_instructions(attribute, language, meaning)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (title_col, description_col)]
    line = parts_request(wording, cells[0], F.col(f"`{id_col}`"), cells[1])
    return feed.select(line.alias("value"))


def attribute_values(replies: DataFrame, id_col: str, attribute: str) -> DataFrame:
    """id and value of reply rows (request, response as JSON text), one per id.

    Of several replies for an id the smallest value counts, found before the shuffle.
    """
    value = F.coalesce(first_text(F.col("response")), F.lit(C.NO_ANSWER))
    rows = replies.select(
        id_from_request(F.col("request")).alias(id_col), value.alias(attribute)
    )
    return rows.groupBy(id_col).agg(F.min(attribute).alias(attribute))


def merge_attribute(
    feed: DataFrame, values: DataFrame, id_col: str, attribute: str
) -> DataFrame:
    """The feed with the attribute; a value the feed already has stays."""
    news = values.select(
        F.col(id_col).cast("string").alias("_id"), F.col(attribute).alias("_new")
    )
    keyed = feed.withColumn("_id", F.col(f"`{id_col}`").cast("string"))
    joined = keyed.join(news, "_id", "left")
    old = F.col(f"`{attribute}`") if attribute in feed.columns else F.lit(None).cast("string")
    own = F.when(F.trim(old) != "", old)
    kept = [F.col(f"`{c}`") for c in feed.columns if c != attribute]
    return joined.select(*kept, F.coalesce(own, "_new").alias(attribute))


def read_attribute_replies(lines: DataFrame) -> DataFrame:
    """request and response, as JSON text, of reply lines (value)."""
    record = F.from_json("value", "request STRING, response STRING")
    return lines.select(record.alias("r")).select("r.request", "r.response")


def enrich(
    feed: DataFrame,
    generator: Generator,
    id_col: str,
    title_col: str,
    description_col: str,
    attribute: str,
    language: str,
    meaning: str = "",
) -> DataFrame:
    """The feed with one attribute filled: requests, replies and merge."""
    requests = attribute_requests(
        feed, id_col, title_col, description_col, attribute, language, meaning
    )
    replied = generator.generate(requests.withColumnRenamed("value", "prompt"))
    response = F.to_json(candidates_payload(F.col("reply")))
    replies = materialise(
        replied.select(
            F.get_json_object("prompt", "$.request").alias("request"), response.alias("response")
        ),
        "attribute-replies",
    )
    return merge_attribute(feed, attribute_values(replies, id_col, attribute), id_col, attribute)
