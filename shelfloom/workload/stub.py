"""A stand-in for the model: replies computed from the prompt text, so that SQL can repeat them.

It reads the ids out of the prompt and puts a mark, the start of the prompt's digest, into every text
that it writes. A request fails as a whole when the digest of its ids starts with 0, and leaves
out its last item when it starts with 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.generator import ColumnGenerator


def digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids, ","))


def fails(ids: Column) -> Column:
    return digest(ids).startswith("0")


def answered(ids: Column) -> Column:
    """The ids a reply covers."""
    short = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.when(digest(ids).startswith("1"), short).otherwise(ids)


# How items are told apart in a prompt, and how many digits of a digest make a mark.
_ITEM_ID = r'\{"id":"([^"]*)"'
_MARK = 8


def prompt_mark() -> Column:
    return F.substring(F.md5("prompt"), 1, _MARK)


def line_reply(target: str) -> Column:
    """``id: text`` lines for ``ids``; texts end with ``mark`` unless it is empty."""
    ids = F.col("ids")
    lines = F.transform(answered(ids), lambda i: F.concat(i, F.lit(": "), stub_text(target, i)))
    return F.when(~fails(ids), F.array_join(lines, "\n"))


def stub_text(target: str, item: Column) -> Column:
    if target == "title":
        return F.concat(F.lit("Item "), item, F.lit(", new title"), F.col("mark"))
    return F.concat(F.lit("All about item "), item, F.col("mark"))


def block_reply(target: str) -> Column:
    """Labelled blocks, one per item."""
    ids = F.col("ids")

    def block(i: Column) -> Column:
        if target == "title":
            return F.concat(
                F.lit("id: "), i, F.lit("\nproduct category: goods\ngenerated title: "),
                stub_text(target, i),
            )
        return F.concat(
            F.lit("id: "), i, F.lit("\ngenerated description: "), stub_text(target, i),
            F.lit("\nin two lines\nscore: 4"),
        )

    return F.when(~fails(ids), F.array_join(F.transform(answered(ids), block), "\n\n"))


def single_reply(target: str) -> Column:
    """One labelled item, in bold where its digest starts with an even digit."""
    item = F.col("ids")[0]
    label = "generated title:" if target == "title" else "generated description:"
    bold = F.substring(F.md5(item), 1, 1).isin("2", "4", "6", "8")
    marked = F.concat(F.lit("**"), F.lit(label), F.lit("** "))
    start = F.when(bold, marked).otherwise(F.lit(label + " "))
    tail = "" if target == "title" else "\nscore: 5"
    return F.when(
        ~fails(F.col("ids")), F.concat(start, stub_text(target, item), F.lit(tail))
    )


REPLIES = {"lines": line_reply, "blocks": block_reply, "single": single_reply}


@dataclass(frozen=True)
class PromptReader:
    """Answers the items that it finds in a prompt; what else the row holds is not looked at."""

    target: str
    layout: str

    def generate(self, prompts: DataFrame) -> DataFrame:
        read = prompts.select(
            F.struct("*").alias("_row"),
            F.regexp_extract_all("prompt", F.lit(_ITEM_ID), F.lit(1)).alias("ids"),
            F.concat(F.lit(" #"), prompt_mark()).alias("mark"),
        )
        reply = REPLIES[self.layout](self.target)
        status = F.when(F.col("reply").isNull(), "failed").otherwise("")
        return read.select("_row.*", reply.alias("reply")).withColumn("status", status)


def stub_generator(target: str, layout: str) -> PromptReader:
    return PromptReader(target, layout)


def marked_title_reply() -> Column:
    """A title reply that starts with the digest of its prompt."""
    return F.concat(F.lit("prompt "), F.md5("prompt"), F.lit("\n"), title_reply())


def marked_description_reply() -> Column:
    """A description reply whose reasoning, or refusal, ends with the digest of its prompt."""
    return F.concat(description_reply(), F.lit(" "), F.md5("prompt"))


def title_reply() -> Column:
    """The six fields of a structured title reply for a row with ``item`` and ``id``."""

    def cell(name: str) -> Column:
        return F.col("item")[name]

    material = F.when(cell("category") == "ECONOMY", "steel").otherwise(" ")
    has_text = cell("description") != ""
    return F.concat(
        F.lit("product attribute keys in original title: color | Kind\n"),
        F.lit("product category: "), cell("category"),
        F.lit("\nproduct attribute keys: color | Kind | brand | size"),
        F.when(has_text, " | Material").otherwise(""),
        F.lit("\nproduct attribute values: "),
        F.split(cell("title"), " ")[0], F.lit(" | "),
        F.when(cell("category") == "SMALL", "Kind").otherwise(F.split(cell("title"), " ")[1]),
        F.lit(" | "), cell("brand"), F.lit(" | Size "), cell("size"),
        F.when(has_text, F.concat(F.lit(" | "), material)).otherwise(""),
        F.when(cell("category") == "SMALL", "\nreplaced keys: none").otherwise(""),
        F.when(cell("category") == "LARGE", "\nreplaced keys: size").otherwise(""),
        F.lit("\ngenerated title: "), cell("title"), F.lit(", "), cell("brand"),
    )


def description_reply() -> Column:
    """Description, score and reasoning; a row without a description gets no usable reply."""
    text = F.col("item")["description"]
    score = F.when(F.col("item")["category"] == "PROMO", "2.5").otherwise("4")
    return F.when(
        text != "",
        F.concat(
            F.lit("description: "), text, F.lit("\nscore: "), score,
            F.lit("\nreasoning: follows "), F.col("id"),
        ),
    ).otherwise(F.lit("no description possible"))


@dataclass(frozen=True)
class StoredVectors:
    """Vectors looked up in a table (key, vec) instead of computed from the text."""

    vectors: DataFrame
    shift: int = 0

    def embed(self, texts: DataFrame) -> DataFrame:
        key = (F.col("id").cast("bigint") + self.shift).alias("key")
        return texts.select("id", key).join(self.vectors, "key").select("id", "vec")
