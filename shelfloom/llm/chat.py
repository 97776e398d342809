"""Chat formatting: records of many layouts become turns, and turns become marked text.

A record's layout is known by its fingerprint, a hash of the nested field paths that it fills. The
fingerprint selects a declarative mapping, and the mapping says which paths hold which turns. Turns
are then written with a template whose control strings are escaped inside texts, so that the
formatted text can be read back to the very same turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# Fixed values of the template. An escape is the escape character and a digit; the character
# itself is escaped first and restored last.
ESCAPE = "~"
BEGIN, END = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", " [/ROLE] "
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Pairs:
    """Fields that hold one turn each: (role, path); optional ones may be missing."""

    required: tuple[tuple[str, str], ...]
    optional: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        """The sets of paths that a record of this layout can fill."""
        need = frozenset(path for _, path in self.required)
        may = [path for _, path in self.optional]
        return [need | set(c) for n in range(len(may) + 1) for c in combinations(may, n)]

    def turns(self) -> Column:
        # An optional field stands where the layout puts it: before the required ones.
        parts = [*self.optional, *self.required]
        made = [F.struct(F.lit(r).alias("role"), F.col(p).alias("text")) for r, p in parts]
        return F.filter(F.array(*made), lambda t: t["text"].isNotNull()).cast(TURNS)


@dataclass(frozen=True)
class Listed:
    """A list of messages with a role and a text field, and perhaps a field to order them by."""

    path: str
    role: str
    text: str
    order: str | None = None
    names: tuple[tuple[str, str], ...] = ()

    def path_sets(self) -> list[frozenset[str]]:
        own = [f"{self.path}[].{f}" for f in (self.role, self.text)]
        own += [f"{self.path}[].{self.order}"] if self.order else []
        # Any field may be null throughout a record, the list itself may be empty.
        return [frozenset(c) for n in range(1, len(own) + 1) for c in combinations(own, n)]

    def turns(self) -> Column:
        messages = F.col(self.path)
        if self.order:
            key = lambda m: F.struct(m[self.order], m[self.role], m[self.text])
            sorted_ = F.sort_array(F.transform(messages, lambda m: key(m)))
        else:
            sorted_ = messages

        def role(m: Column) -> Column:
            known = F.coalesce(m[self.role], F.lit(""))
            for old, new in self.names:
                known = F.when(known == old, F.lit(new)).otherwise(known)
            return known

        made = F.transform(
            sorted_,
            lambda m: F.struct(
                role(m).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text")
            ),
        )
        return made.cast(TURNS)


# Layouts known by default; the pairs are roles and field paths.
LAYOUTS = (
    Listed("turns", "role", "text", order="turn"),
    Listed("messages", "role", "content"),
    Listed("conversations", "from", "value", names=(("human", "user"), ("gpt", "assistant"))),
    Pairs((("user", "prompt"), ("assistant", "completion")), (("system", "system"),)),
    Pairs((("user", "prompt"), ("assistant", "response")), (("system", "system"),)),
    Pairs((("user", "instruction"), ("assistant", "output")), (("system", "system"),)),
    Pairs((("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def roots(layouts: Sequence[Pairs | Listed] = LAYOUTS) -> list[str]:
    """The top-level fields that layouts use; other columns are not part of a record."""
    paths = {p for x in layouts for s in x.path_sets() for p in s}
    return sorted({p.split(".")[0].removesuffix("[]") for p in paths})


def _any_filled(messages: Column, name: str) -> Column:
    return F.exists(messages, lambda m: m[name].isNotNull())


def field_paths(kind: DataType, path: str, value: Column) -> list[tuple[str, Column]]:
    """The leaf paths under a field and whether a record fills them."""
    if isinstance(kind, StructType):
        return [x for f in kind for x in field_paths(f.dataType, f"{path}.{f.name}", value[f.name])]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        names = [f.name for f in kind.elementType]
        return [(f"{path}[].{n}", _any_filled(value, n)) for n in names]
    return [(path, value.isNotNull())]


def fingerprint_of(paths: frozenset[str]) -> str:
    """The fingerprint of a set of paths."""
    return hashlib.md5("|".join(sorted(paths)).encode()).hexdigest()


def fingerprint(records: DataFrame, layouts: Sequence[Pairs | Listed] = LAYOUTS) -> Column:
    """The fingerprint of each record: a hash of the paths it fills, in order."""
    used = [f for f in records.schema if f.name in roots(layouts)]
    paths = sorted(
        (x for f in used for x in field_paths(f.dataType, f.name, F.col(f"`{f.name}`"))),
        key=lambda x: x[0],
    )
    filled = [F.when(there, F.lit(path)) for path, there in paths]
    return F.md5(F.concat_ws("|", F.array_compact(F.array(F.lit(None).cast("string"), *filled))))


def canonical_turns(
    records: DataFrame, layouts: Sequence[Pairs | Listed] = LAYOUTS
) -> DataFrame:
    """``records`` with ``fingerprint`` and ``chat``: an array of role and text per record.

    A record of no known layout keeps a null ``chat``, as do records that fill no field at all.
    Null texts in lists are empty, null roles too; lists with an order field sort by it, then by
    role and text, nulls first. A column that has one of the two names gives way.
    """
    present = {f.name for f in records.schema}
    chosen = F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        if all(s.split(".")[0].removesuffix("[]") in present for s in layout.path_sets()[0]):
            prints = [fingerprint_of(s) for s in layout.path_sets()]
            chosen = F.when(F.col("fingerprint").isin(prints), layout.turns()).otherwise(chosen)
    return records.withColumn("fingerprint", fingerprint(records, layouts)).withColumn("chat", chosen)


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` gives it back."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for digit, control in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(control), F.lit(f"{ESCAPE}{digit}"))
    return text


def unescape(text: Column) -> Column:
    for digit, control in enumerate(CONTROL, 1):
        text = F.replace(text, F.lit(f"{ESCAPE}{digit}"), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def format_chat(chats: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` to rows with ``chat``.

    A turn of the user is ``<s>[INST] text [/INST]</s>``, of the assistant ``<s>text</s>``, of any
    other role ``<s>[ROLE] role [/ROLE] text</s>``. The spans are start and length, in code points
    of the formatted text, of what the assistant says; a model learns from these alone. A chat
    without turns gives empty text, a null chat nulls. Columns that are named like the two added ones
    give way to them; all others stay, whatever their names.
    """

    def piece(t: Column) -> Column:
        text = escape(t["text"])
        before = (
            F.when(t["role"] == "user", F.lit(BEGIN + USER_OPEN))
            .when(t["role"] == "assistant", F.lit(BEGIN))
            .otherwise(
                F.concat(F.lit(BEGIN + ROLE_OPEN), escape(t["role"]), F.lit(ROLE_CLOSE))
            )
        )
        after = F.when(t["role"] == "user", F.lit(USER_CLOSE + END)).otherwise(F.lit(END))
        return F.struct(
            F.concat(before, text, after).alias("piece"),
            (t["role"] == "assistant").alias("learn"),
            F.length(text).alias("length"),
        )

    others = [c for c in chats.columns if c not in ("formatted", "loss_spans")]
    # The row travels as one value, so no column of it can clash with those added here.
    pieces = chats.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.transform("chat", piece).alias("_pieces")
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<int>").alias("starts"))
    starts = F.aggregate(
        "_pieces",
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["piece"])).alias("at"),
            F.concat(a["starts"], F.array(a["at"])).alias("starts"),
        ),
        lambda a: a["starts"],
    )
    spans = F.zip_with(
        F.col("_pieces"),
        F.col("_starts"),
        lambda p, at: F.when(
            p["learn"], F.struct((at + len(BEGIN)).alias("start"), p["length"].alias("length"))
        ),
    )
    return (
        pieces.withColumn("_starts", starts)
        .withColumn("formatted", F.concat_ws("", F.col("_pieces")["piece"]))
        .withColumn("formatted", F.when(F.col("_pieces").isNotNull(), F.col("formatted")))
        .withColumn("loss_spans", F.array_compact(spans))
        .select("_row.*", "formatted", "loss_spans")
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted text."""
    # Every turn ends with END, so what follows the last one is empty and no turn.
    parts = F.split(formatted, END, -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(BEGIN) + 1))
        user, other = body.startswith(USER_OPEN), body.startswith(ROLE_OPEN)
        inner = F.substr(
            body, F.lit(len(USER_OPEN) + 1), F.length(body) - len(USER_OPEN) - len(USER_CLOSE)
        )
        close = F.locate(ROLE_CLOSE, body)
        role = F.substr(body, F.lit(len(ROLE_OPEN) + 1), close - 1 - len(ROLE_OPEN))
        rest = F.substr(body, close + len(ROLE_CLOSE))
        return F.struct(
            F.when(user, F.lit("user"))
            .when(other, unescape(role))
            .otherwise(F.lit("assistant"))
            .alias("role"),
            unescape(F.when(user, inner).when(other, rest).otherwise(body)).alias("text"),
        )

    return F.transform(bodies, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    parts = F.transform(
        spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))
    )
    return F.concat_ws("", parts)


def gather_turns(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One record per conversation from rows of ``turn, role, text``.

    A record is one text to train on, so its turns have to meet in one row. A null role or text is
    empty, a null turn comes first once turns are ordered, rows of a null id are one conversation,
    repeated rows are turns each, and other columns are ignored. No rows give no records.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col(f"`{id_col}`")).agg(F.collect_list(turn).alias("turns"))
