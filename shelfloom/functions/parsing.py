"""Reading generated text back into columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom.functions.text import blank_to_null, let, match, strip


def reply_lines(reply: Column, ids: Column) -> Column:
    """The lines of a reply; a failed one yields the asked ids, so that each still counts."""
    return F.coalesce(F.split(reply, "\n"), ids)


def parse_line(line: Column) -> Column:
    """Id and text of one ``id: text`` line; a line without a colon is an id alone."""
    return F.struct(
        F.coalesce(match(line, C.LINE_ID_AND_TEXT), match(line, C.LINE_ID_ONLY)).alias("id"),
        match(line, C.LINE_ID_AND_TEXT, 2).alias("text"),
    )


def _blocks(reply: Column, block: str, text: str) -> Column:
    found = F.regexp_extract_all(reply, F.lit(block), F.lit(0))
    parsed = F.transform(
        found,
        lambda b: F.struct(match(b, C.BLOCK_ID).alias("id"), match(b, text).alias("text")),
    )
    return F.filter(parsed, lambda p: p["id"].isNotNull())


def parse_title_blocks(reply: Column) -> Column:
    """All ``id: ... generated title: ...`` blocks of a reply."""
    return _blocks(reply, C.TITLE_BLOCK, C.BLOCK_TITLE)


def parse_description_blocks(reply: Column) -> Column:
    """All ``id: ... generated description: ... score: ...`` blocks of a reply."""
    return _blocks(reply, C.DESCRIPTION_BLOCK, C.BLOCK_DESCRIPTION)


def _markdown(reply: Column, pattern: str, label: str) -> Column:
    unlabelled = F.when(~reply.contains(label), reply)
    return F.coalesce(match(reply, pattern), unlabelled)


def parse_title_markdown(reply: Column) -> Column:
    """The labelled title, bold or not; an unlabelled reply counts as the title itself."""
    return _markdown(reply, C.MARKDOWN_TITLE, C.TITLE_LABEL)


def parse_description_markdown(reply: Column) -> Column:
    """The labelled description up to its score; an unlabelled reply counts as a whole."""
    return _markdown(reply, C.MARKDOWN_DESCRIPTION, C.DESCRIPTION_LABEL)


def parse_label(text: Column) -> Column:
    """The rest of the first labelled line, else the whole text, trimmed."""
    return strip(F.coalesce(match(text, C.BATCH_LABEL), text))


def labelled_sections(reply: Column, labels: tuple[str, ...]) -> Column:
    """The text behind each label, for labels that stand on successive lines.

    The reading goes from the last label backwards: each step takes the last place of its label in
    what is left, keeps what follows it, and goes on with the lines above that place. So the work
    is linear in the length of the reply however often a label occurs. Null if a label is missing:
    nothing is left then for the steps that follow.
    """
    heads = F.array(*[F.lit(rf"(?is)\A.*\Q{label}\E\**") for label in reversed(labels)])
    start = F.struct(
        F.coalesce(reply, F.lit("")).alias("left"),
        F.array().cast("array<string>").alias("found"),
        F.lit(False).alias("ok"),
    )

    def step(state: Column, pattern: Column) -> Column:
        def cut(head: Column) -> Column:
            left = state["left"]
            section = strip(F.substring(left, F.length(head) + 1, F.length(left)))
            return F.struct(
                F.regexp_extract(head, r"(?s)\A.*\n", 0).alias("left"),
                F.array_append(state["found"], section).alias("found"),
                (head != "").alias("ok"),
            )

        return let(F.regexp_substr(state["left"], pattern), lambda h: cut(F.coalesce(h, F.lit(""))))

    return F.aggregate(
        heads, start, step, lambda state: F.when(state["ok"], F.reverse(state["found"]))
    )


def parse_title_reply(reply: Column) -> Column:
    """The fields of a structured title reply, with or without replaced keys, and an error."""
    full = labelled_sections(reply, C.TITLE_REPLY_KEYS)
    short_labels = tuple(k for k in C.TITLE_REPLY_KEYS if k != "replaced keys:")
    short = labelled_sections(reply, short_labels)

    def read(f: Column) -> Column:
        whole = F.size(f) == len(C.TITLE_REPLY_KEYS)
        return F.struct(
            f[0].alias("original_keys"),
            f[1].alias("category"),
            f[2].alias("keys"),
            f[3].alias("values"),
            F.when(whole, F.get(f, F.lit(4))).alias("replaced_keys"),
            F.element_at(f, -1).alias("title"),
            F.when(
                f.isNull(),
                F.concat(
                    F.lit("Incomplete title reply: "), F.coalesce(reply, F.lit("no reply"))
                ),
            ).alias("error"),
        )

    return let(F.coalesce(full, short), read)


def parse_description_reply(reply: Column) -> Column:
    """Description, score and reasoning of a structured reply, and an error."""

    def read(f: Column) -> Column:
        number = match(f[1], r"\A([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
        return F.struct(
            f[0].alias("description"),
            number.try_cast("double").alias("score"),
            f[2].alias("reasoning"),
            F.when(
                f.isNull(),
                F.concat(
                    F.lit("Incomplete description reply: "), F.coalesce(reply, F.lit("no reply"))
                ),
            ).alias("error"),
        )

    return let(labelled_sections(reply, C.DESCRIPTION_REPLY_KEYS), read)


def batch_value(text: Column, column: str, strict: bool = False) -> Column:
    """The generated value of a batch reply.

    Descriptions keep all their lines. An empty value becomes null, so that a merge keeps the old
    text; ``strict`` keeps it empty and reads every target by its first labelled line.
    """
    if strict:
        return parse_label(text)
    if column == "description":
        return blank_to_null(strip(parse_description_markdown(text)))
    return blank_to_null(parse_label(text))
