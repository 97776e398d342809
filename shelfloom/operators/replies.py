"""From replies to one answer per asked id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import parsing as P
from shelfloom.functions.envelopes import raw_capture
from shelfloom.functions.text import let


def explode_replies(generated: DataFrame, entries: Column) -> DataFrame:
    """One row per entry of a reply: chunk_id, the asked ids, position, id and text."""
    return generated.select(
        "chunk_id", "ids", F.posexplode(entries).alias("position", "entry")
    ).select("chunk_id", "ids", "position", "entry.id", "entry.text")


def parsed_entries(reply: Column, ids: Column, column: str, layout: str) -> Column:
    """The id/text structs of a reply in one of three layouts: lines, blocks or single."""
    if layout == "lines":
        return F.transform(P.reply_lines(reply, ids), P.parse_line)
    if layout == "blocks":
        parse = P.parse_title_blocks if column == "title" else P.parse_description_blocks
        return parse(reply)
    if layout == "single":
        parse = P.parse_title_markdown if column == "title" else P.parse_description_markdown
        return F.transform(ids, lambda i: F.struct(i.alias("id"), parse(reply).alias("text")))
    raise ValueError(f"unknown reply layout: {layout}")


def first_answer(entries: DataFrame, require_asked: bool = True) -> DataFrame:
    """The first answer per id in order of chunk and position, of ids that were asked.

    The smallest place is a partial aggregate, so an id that a model repeats endlessly shrinks to
    one row per task before the shuffle.
    """
    asked = F.array_contains("ids", F.col("id")) if require_asked else F.col("id").isNotNull()
    first = F.min(F.struct("chunk_id", "position", "text"))
    return (
        entries.where(asked).groupBy("id").agg(first.alias("_first")).select("id", "_first.text")
    )


def answers(generated: DataFrame, column: str, layout: str, require_asked: bool = True) -> DataFrame:
    """All asked ids with their text, null where the reply holds none; an id is in one prompt only.

    If only asked ids count, the first answer of an id is found within its own reply, and nothing
    is shuffled. Otherwise a reply may answer ids of other prompts, which meet by id.
    """
    entries = parsed_entries(F.col("reply"), F.col("ids"), column, layout)
    if require_asked:

        def own(found: Column, ids: Column) -> Column:
            def first(i: Column) -> Column:
                return F.get(F.filter(found, lambda e: e["id"] == i), F.lit(0))["text"]

            return F.transform(ids, lambda i: F.struct(i.alias("id"), first(i).alias("text")))

        return generated.select(F.inline(let(entries, F.col("ids"), own)))
    asked = generated.select(F.explode("ids").alias("id"))
    found = explode_replies(generated, entries).where(F.col("text").isNotNull() | F.col("id").isNotNull())
    return asked.distinct().join(first_answer(found, False), "id", "left")


def debug_rows(generated: DataFrame) -> DataFrame:
    """The raw reply, or the error that came instead, for every asked id."""
    raw = raw_capture(F.col("reply"), F.col("status"))
    return (
        generated.select(F.explode("ids").alias("id"), raw.alias("raw"))
        .groupBy("id")
        .agg(F.min("raw").alias("raw"))
    )
