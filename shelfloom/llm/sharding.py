"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.session import materialise

# Bits of a hash come as text of 0 and 1: 60 from the key, then 60 from the number of the row.
_HEX, _BITS = 15, 60


def _bits(value: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(value), 1, _HEX), 16, 2), _BITS, "0")


def hash_rows(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``key, n_bytes, bits`` per row, written once so that row numbers stay what they are.

    The bits of the key come first. Rows that share a key share those, and only if they are too
    many for a shard do the bits of the row number part them.
    """
    size = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long")
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    return materialise(
        docs.select(
            F.col(f"`{key_col}`").alias("key"),
            size.alias("n_bytes"),
            F.concat(_bits(key), _bits(F.monotonically_increasing_id().cast("string"))).alias("bits"),
        ),
        "hashed-rows",
    )


def _settle(rows: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """One round: for each cell of ``end`` bits the shallowest bucket over it that fits.

    ``rows`` are those whose bucket of ``start`` bits is too large (or all, if it is 0). A bucket
    with one row cannot be split. Cells without a bucket that fits have a null ``shard``.
    """
    cells = materialise(
        rows.groupBy(F.substring("bits", 1, end).alias("cell")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")
        ),
        "shard-cells",
    )
    first = 0 if start == 0 else start + 1
    depths = F.explode(F.sequence(F.lit(first), F.lit(end)))
    over = cells.withColumn("depth", depths).withColumn("bucket", F.expr("substr(cell, 1, depth)"))
    buckets = (
        over.groupBy("bucket")
        .agg(F.sum("n_bytes").alias("bucket_bytes"), F.sum("n_rows").alias("bucket_rows"))
        .where((F.col("bucket_bytes") <= limit) | (F.col("bucket_rows") == 1))
    )
    chosen = over.join(buckets, "bucket").groupBy("cell").agg(
        F.min(F.struct("depth", "bucket", "bucket_bytes", "bucket_rows")).alias("s")
    )
    return materialise(cells.select("cell").join(chosen, "cell", "left"), "shard-round")


def assign_shards(
    docs: DataFrame,
    max_bytes: int = 64 << 20,
    key_col: str = "doc_id",
    text_col: str = "text",
    round_bits: int = 8,
) -> DataFrame:
    """The shard of each row: ``key, n_bytes, shard, depth, shard_bytes, shard_rows``.

    The directory starts as one bucket. A bucket above ``max_bytes`` splits on its next hash bit;
    others stay as they are, so depths differ. ``shard`` is the hash prefix (empty for the only
    bucket). Each round counts the bytes of all prefixes of a few more bits at once, over the rows
    of buckets that are still too large; the first one looks as deep as the total size asks for. A
    single text above the limit gets a shard of its own. Null texts have 0 bytes, null keys
    count as empty, repeated rows part by row number. An empty table gives no rows; other columns are
    ignored.
    """
    rows = hash_rows(docs, key_col, text_col)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    start, parts = 0, []
    end = min(2 * _BITS, max(1, math.ceil(math.log2(max(1, total / max_bytes)))) + 2)
    open_rows = rows
    while True:
        found = _settle(open_rows, start, end, max_bytes)
        cell = F.substring("bits", 1, end)
        settled = found.where("s IS NOT NULL").select(F.col("cell").alias("_cell"), "s")
        parts.append(
            open_rows.join(settled, cell == F.col("_cell")).select(
                "key",
                "n_bytes",
                F.col("s.bucket").alias("shard"),
                F.col("s.depth").alias("depth"),
                F.col("s.bucket_bytes").alias("shard_bytes"),
                F.col("s.bucket_rows").alias("shard_rows"),
            )
        )
        over = found.where("s IS NULL").select(F.col("cell").alias("_cell"))
        if end == 2 * _BITS or over.isEmpty():
            break
        open_rows = open_rows.join(over, cell == F.col("_cell"), "left_semi")
        start, end = end, min(2 * _BITS, end + round_bits)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard of an assignment: ``shard, depth, shard_bytes, shard_rows``."""
    return shards.select("shard", "depth", "shard_bytes", "shard_rows").distinct()


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", **options) -> None:
    """Write ``docs`` as one Parquet folder per shard, all columns as they came.

    A shard fits its byte limit, so it is a bounded piece of work for the task that writes it. Keys
    have to be unique, a null one too; repeated ones are an error. A column named ``shard_prefix`` gives
    way to that of the shard, whatever other columns are called.
    """
    shards = assign_shards(docs, key_col=key_col, **options).select(
        F.col("key").alias("_key"), F.concat(F.lit("p"), "shard").alias("shard_prefix")
    )
    if not shards.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"rows that repeat a {key_col} cannot be told apart in shards")
    own = [F.col(f"`{c}`") for c in docs.columns if c != "shard_prefix"]
    rows = docs.select(F.struct(*own).alias("_row"), F.col(f"`{key_col}`").alias("_own"))
    placed = rows.join(shards, F.col("_own").eqNullSafe(F.col("_key"))).select("_row.*", "shard_prefix")
    placed.repartition("shard_prefix").write.partitionBy("shard_prefix").parquet(path)
