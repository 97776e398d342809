"""Mixing sources to target weights by whole repeats and one seeded draw per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.operators.numbering import with_row_index
from shelfloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"

# A draw reads 13 hex digits, which are 52 bits and so exact as a double.
_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...], max_repeats: int
) -> DataFrame:
    """``_source, source_size, target`` from rows of ``_source, size``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A source whose share exceeds ``max_repeats`` times its size gets exactly that, and the
    rest is shared anew until nobody is above. Each round is one aggregate over one row per source
    of which three numbers come back; rounds end because a source never leaves its limit.
    """
    totals = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ordered = with_row_index(
        totals.withColumn("_last", F.col("_source").isNull()), ["_last", "_source"], "_nth"
    )
    turn = F.pmod("_nth", F.lit(len(weights))).cast("int") + 1
    table = materialise(
        ordered.select(
            "_source",
            "source_size",
            F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("_weight"),
        ),
        "sources",
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    limit = wide("source_size") * max_repeats
    # The share of a source is its weight times rest / open; it is above its limit if so.
    above = lambda rest, open_: wide("_weight") * F.lit(rest).cast("decimal(38,0)") > (
        limit * F.lit(open_).cast("decimal(38,0)")
    )
    total, open_ = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    total, open_, closed = int(total or 0), int(open_ or 1), 0
    rest = total
    while True:
        held = above(rest, open_)
        size, weight, count = table.where(held).agg(
            F.sum("source_size"), F.sum("_weight"), F.count(F.lit(1))
        ).first()
        if count == closed:
            break
        all_weights = table.agg(F.sum("_weight")).first()[0]
        rest, closed = total - max_repeats * int(size), count
        open_ = int(all_weights) - int(weight)
        if open_ == 0:
            held, open_ = F.lit(True), 1
            break
    most = (F.col("source_size") * max_repeats).cast("double")
    share = (F.col("_weight") * F.lit(rest)).cast("double") / F.lit(float(open_))
    target = F.when(held, most).otherwise(F.least(share, most))
    return table.select("_source", "source_size", target.alias("target"))


def draw(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    digits = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")
    return digits.cast("double") / F.lit(float(16**_DIGITS))


def size_rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``_id, _source, size`` per row, written once: words are counted a single time."""
    return materialise(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            F.col(f"`{source_col}`").alias("_source"),
            word_count(F.col(f"`{text_col}`")).alias("size"),
        ),
        "sizes",
    )


def _copies(seed: int) -> Column:
    """How often a row is taken: the whole part of the rate, and one more by its seeded draw."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(seed, F.col("_id")) < rate - F.floor(rate)).cast("long")
    return F.floor(rate).cast("long") + extra


def mix_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 0,
) -> DataFrame:
    """Per row its size, the size and target of its source and the words that the mix takes.

    A document of a source is taken floor(rate) times, and once more if its seeded draw is below
    the fraction of the rate, where the rate is target over size of the source. Reruns agree.
    Null sources form one source that comes last; null texts have size 0; rows that repeat an id
    share its draw. An empty table gives no rows; other columns are ignored. The targets are one
    row per source: Spark chooses the join by the size of their written table and splits a source
    that holds much of all rows.
    """
    sizes = size_rows(docs, id_col, source_col, text_col)
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("_source", "_its")
    joined = sizes.join(targets, F.col("_source").eqNullSafe(F.col("_its")))
    return joined.select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (_copies(seed) * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``mix_report`` takes it.

    Null and empty texts have size 0; their rows are repeated and drawn like others of their source, at
    rate 0 where the whole source is empty. Null sources are one source, null ids draw as empty text,
    repeated rows draw alike, columns of any name come back as they came, and an empty table gives none.
    """
    sizes = size_rows(docs, id_col, source_col, text_col)
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("_source", "_its")
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{source_col}`").alias("_source"),
    )
    joined = rows.join(targets, F.col("_source").eqNullSafe(F.col("_its")))
    times = F.sequence(F.lit(1), _copies(seed).cast("int"))
    taken = joined.where(_copies(seed) > 0).withColumn("_n", F.explode(times))
    return taken.select("_row.*")
