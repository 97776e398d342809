"""Row numbers over a whole table, chunks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions.text import part_of
from shelfloom.session import materialise

# Row ids of the engine carry the partition in the upper bits and the row in the lower 33.
_ROW_BITS = 33


def content_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, the same whenever a task runs again (maps have no hash)."""
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashable])


def with_row_index(df: DataFrame, order_by: list[str], name: str = "row_index") -> DataFrame:
    """Number all rows from 0 in a global order without gathering them in one task.

    Rows are range-partitioned and sorted, so the place of a row within its partition plus the size
    of the partitions before it is its number; the sizes are one row per partition. A second key
    lets a run of equal keys span several partitions. It is taken after a local sort by content, so
    a task that runs again hands out the same keys.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.sortWithinPartitions(*order_by, content_hash(df)).withColumn(
        "_tie", F.monotonically_increasing_id()
    )
    ranged = (
        tied.repartitionByRange(partitions, *order_by, "_tie")
        .sortWithinPartitions(*order_by, "_tie")
        .drop("_tie")
    )
    place = F.monotonically_increasing_id()
    placed = materialise(
        ranged.select(
            "*",
            F.shiftright(place, _ROW_BITS).cast("int").alias("_slice"),
            place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_place"),
        ),
        "row-index",
    )
    # One row per partition: small enough to order in a single task and to broadcast.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .count()
        .select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_slice", "_place", "_offset")
    )


def chunk(
    df: DataFrame, items_per_prompt: int, buckets: int | None = None, id_col: str = "id", spread: bool = False
) -> DataFrame:
    """Add ``chunk_id`` so that each chunk holds up to ``items_per_prompt`` rows in order of id.

    Without ``buckets`` the chunks run through the whole table in order. With it, rows are numbered
    within hash buckets of their unique id, which needs a single shuffle and leaves at most one
    short chunk per bucket; the chunk id is then unique but has gaps. A bucket is one task's share
    then; ``spread`` gives the same chunks from numbers that run through pieces of buckets of any size,
    for one more shuffle.
    """
    size = F.lit(items_per_prompt)
    if buckets is None:
        indexed = with_row_index(df, [id_col], "_row")
        return indexed.withColumn("chunk_id", F.expr(f"_row div {items_per_prompt}")).drop("_row")
    bucket = part_of(F.col(id_col), buckets)
    if spread:
        placed = with_row_index(df.withColumn("_bucket", bucket), ["_bucket", id_col], "_row")
        # One row per bucket, sent to the rows: a shuffle by bucket would make each bucket one task's share.
        first = placed.groupBy("_bucket").agg(F.min("_row").alias("_first"))
        number = F.expr(f"(_row - _first) div {items_per_prompt}")
        placed = placed.join(F.broadcast(first), "_bucket").withColumn("chunk_id", number * buckets + F.col("_bucket"))
        return placed.drop("_row", "_first")
    within = Window.partitionBy("_bucket").orderBy(id_col)
    number = F.floor((F.row_number().over(within) - 1) / size).cast("long")
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("chunk_id", number * buckets + F.col("_bucket"))
    )


def gather_chunks(chunked: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per chunk with its ids and properties in order of id.

    A bucketed chunking is grouped by the bucket too, so its shuffle serves both steps. Groups are
    bounded by the chunk size.
    """
    keys = [c for c in ("_bucket", "chunk_id") if c in chunked.columns]
    rows = F.array_sort(F.collect_list(F.struct("id", "properties")))
    gathered = chunked.groupBy(*keys).agg(rows.alias("_rows"))
    return gathered.select(
        "chunk_id",
        F.col("_rows")["id"].alias("ids"),
        F.col("_rows")["properties"].alias("properties"),
    )


def with_position(df: DataFrame, order_by: list[str], start: int = 0) -> DataFrame:
    """Add the output position of each row: its place in input order plus a start row."""
    return with_row_index(df, order_by, "position").withColumn(
        "position", F.col("position") + start
    )


def with_batch_no(df: DataFrame, order_by: list[str], size: int = 30) -> DataFrame:
    """Add the number of the fixed-size batch each row falls into, in input order."""
    return with_row_index(df, order_by, "_row").select(
        *df.columns, F.expr(f"_row div {size}").alias("batch_no")
    )


def next_batch(pending: DataFrame, n: int | None, seed: int | None = None) -> DataFrame:
    """The rows of the next pass: all of them, or n drawn in an order that depends on the ids.

    The draw orders by a digest of the ids rather than calling a random function, so a recomputed
    task draws the same rows; the seed varies it between passes.
    """
    if n is None:
        return pending
    return pending.orderBy(F.md5(F.concat(F.lit(str(seed or 0)), "id")), "id").limit(n)


def draw_order(rows: DataFrame, seed: int, once: bool = False) -> DataFrame:
    """Rows with their place in a draw, ``turn`` from 0 up, written once in that order.

    A pass takes a range of turns, which lies in few files, in place of ordering all rows again. The
    draw depends on ids and seed alone. ``once`` gives rows that repeat an id one turn together.
    """
    drawn = F.md5(F.concat(F.lit(str(seed)), F.coalesce("id", F.lit("")))).alias("_drawn")
    if once:
        ids = with_row_index(rows.select("id").distinct().select("id", drawn), ["_drawn", "id"], "turn")
        turns = ids.select(F.col("id").alias("_same"), "turn")
        numbered = rows.join(turns, F.col("id").eqNullSafe(F.col("_same"))).drop("_same")
        numbered = numbered.repartitionByRange("turn").sortWithinPartitions("turn")
    else:
        numbered = with_row_index(rows.select("*", drawn), ["_drawn", "id"], "turn").drop("_drawn")
    return materialise(numbered, "draw")
