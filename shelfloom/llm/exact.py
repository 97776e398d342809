"""Exact dedup by a tree merge of digest runs.

Every document becomes a digest; documents are dealt into runs by a number; runs are merged in rounds, a
fixed number of neighbours at a time: a round divides the run numbers and groups by run and digest, so a
merge is a hash aggregate that keeps one identifier and a count per digest, not a walk along sorted
runs, which no native operator offers. Only digests travel. A group of copies shrinks to one row per run in the first round, so even a group
that holds a third of all rows is spread over all runs before its rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Equality of texts is verified at every level by all three together.
_KEY = ["_sha", "_bytes", "_check"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    On texts without other letters the plain function does the same and is faster.
    """
    known = F.coalesce(text, F.lit(""))
    plain = F.octet_length(known) == F.length(known)
    return F.when(plain, F.lower(known)).otherwise(F.translate(known, UPPER, UPPER.lower()))


def text_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct id and text with its number of rows, written once."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"), ascii_lower(F.col(f"`{text_col}`")).alias("_norm")
    ).select(
        "_id",
        F.sha2("_norm", 256).alias("_sha"),
        F.octet_length("_norm").alias("_bytes"),
        F.xxhash64("_norm").alias("_check"),
    )
    return materialise(rows.groupBy("_id", *_KEY).agg(F.count(F.lit(1)).alias("_rows")), "digests")


def merge_runs(digests: DataFrame, keep: str, runs: int, fan_in: int) -> DataFrame:
    """Merge runs of digests in rounds: one row per text with the id that stays and its rows.

    ``keep`` is ``largest`` or ``smallest``. An id that is null stays only if all of them are.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    merged = digests.select(
        *_KEY,
        F.pmod(F.xxhash64("_id"), F.lit(runs)).alias("_run"),
        F.col("_id").alias("_keep"),
        F.col("_rows").alias("_size"),
    )
    left = runs
    while True:
        merged = merged.groupBy("_run", *_KEY).agg(
            best("_keep").alias("_keep"), F.sum("_size").alias("_size")
        )
        if left == 1:
            return materialise(merged.drop("_run"), "merged-digests")
        left = -(-left // fan_in)
        merged = merged.withColumn("_run", F.expr(f"_run div {fan_in}"))


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = 64,
    fan_in: int = 8,
) -> DataFrame:
    """Say for each document which of its exact copies stays.

    Texts are equal when identical after lower-casing A-Z. One row per input row: the id column,
    ``keep_id``, ``group_size`` (rows of the group), ``kept`` and ``text_sha256``. A null text is
    empty. Of rows that repeat both id and text one is kept. Null ids count as the lowest and stay
    only where no other id has the text. An empty table gives no rows; other columns are ignored.
    """
    digests = text_digests(docs, id_col, text_col)
    merged = merge_runs(digests, keep, runs, fan_in)
    copies = F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))
    return (
        digests.join(merged, _KEY)
        .withColumn("_copy", copies)
        .select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_size").alias("group_size"),
            (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = 64,
    fan_in: int = 8,
) -> DataFrame:
    """The documents without exact copies, all columns as they came; see ``exact_copies``."""
    merged = merge_runs(text_digests(docs, id_col, text_col), keep, runs, fan_in)
    stay = merged.select(F.col("_keep").alias("_stay"), F.col("_sha").alias("_stay_sha"))
    # The row travels as one value, so no column of it can clash with those added here.
    held = docs.select(
        F.struct("*").alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        F.sha2(ascii_lower(F.col(f"`{text_col}`")), 256).alias("_own_sha"),
    )
    same = F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_own_sha") == F.col("_stay_sha"))
    found = held.join(stay, same, "left_semi")
    # A row that occurs twice has one id and one text, so one of its rows goes.
    return found.dropDuplicates(["_id", "_own_sha"]).select("_row.*")
