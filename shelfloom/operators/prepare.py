"""Choosing, shaping and joining what the prompts may see."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom.functions.text import part_of
from shelfloom.operators.numbering import content_hash
from shelfloom.session import materialise

SKIP = "skip"


def guess_roles(columns: list[str]) -> dict[str, str]:
    """The column for each role by its name; id, title and description fall back to position."""
    roles = {}
    for position, (role, pattern) in enumerate(C.ROLE_PATTERNS.items()):
        named = next((c for c in columns if re.search(pattern, c, re.IGNORECASE)), None)
        if named is None and role in ("id", "title", "description") and columns:
            named = columns[position] if position < len(columns) else columns[0]
        roles[role] = named or SKIP
    return roles


def role_candidates(columns: list[str]) -> dict[str, list[str]]:
    """All columns whose name fits each role, in order; a person picks among them."""
    return {
        role: [c for c in columns if re.search(pattern, c, re.IGNORECASE)] for role, pattern in C.ROLE_PATTERNS.items()
    }


def candidate_report(feed: DataFrame) -> DataFrame:
    """``role, place, column, filled``: the candidates of each role with how many rows fill them.

    All columns are counted in one pass over the feed.
    """
    found = [(r, i, c) for r, cs in role_candidates(feed.columns).items() for i, c in enumerate(cs)]
    named = sorted({c for _, _, c in found})
    counts = feed.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in named]) if named else feed.agg(F.lit(0))
    rows = [
        F.struct(F.lit(r).alias("role"), F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled"))
        for r, i, c in found
    ]
    if not rows:
        return feed.sparkSession.createDataFrame([], "role string, place int, column string, filled long")
    return counts.select(F.inline(F.array(*rows)))


def profile(feed: DataFrame, name: str = "feed") -> dict:
    """Counts, column roles, a summary line and a preview of five rows as text."""
    columns = feed.columns
    rows = feed.count()
    shown = ", ".join(columns[:5]) + (", ..." if len(columns) > 5 else "")
    result = {
        "summary": f"{name}: {rows} rows, {len(columns)} columns ({shown})",
        "num_rows": rows,
        "num_cols": len(columns),
        "cols": columns,
        "roles": guess_roles(columns),
        "preview": [],
    }
    if columns:
        roles = result["roles"]
        picked = [roles["id"], roles["title"], roles["description"]]
        result["preview"] = [tuple(map(str, row)) for row in preview(feed, picked).collect()]
    return result


def preview(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The first few rows of some columns, as text."""
    return df.select(*[F.col(f"`{c}`").cast("string") for c in columns]).limit(n)


def project_roles(
    feed: DataFrame,
    id_col: str,
    title_col: str,
    desc_col: str,
    url_col: str = SKIP,
    image_col: str = SKIP,
    include: str = "",
    where: str | Column | None = None,
    order_by: list[str | Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Chosen rows and columns under their role names; ``*`` keeps all columns as they are."""
    rows = feed.where(where) if where is not None else feed
    if order_by:
        rows = rows.orderBy(*order_by)
    if limit is not None:
        rows = rows.limit(limit)
    if include.strip() == "*":
        return rows
    mapped = {"id": id_col, "title": title_col, "description": desc_col}
    if url_col != SKIP:
        mapped["url"] = url_col
    if image_col != SKIP:
        mapped["image_url"] = image_col
    taken = {id_col, title_col, desc_col, url_col, image_col}
    extra = [c.strip() for c in include.split(",") if c.strip() and c.strip() not in taken]
    return rows.select(
        *[F.col(f"`{source}`").alias(role) for role, source in mapped.items()],
        *[F.col(f"`{c}`") for c in extra],
    )


def project_plain(
    feed: DataFrame, id_col: str, title_col: str, desc_col: str, include: str = "", where: str | Column | None = None
) -> DataFrame:
    """Chosen rows and columns under their own names, each once; ``*`` keeps all columns.

    Columns stand in order of first mention.
    """
    rows = feed.where(where) if where is not None else feed
    if include.strip() == "*":
        return rows
    extra = [c.strip() for c in include.split(",") if c.strip()]
    return rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, title_col, desc_col, *extra])])


def restrict_to(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose id is listed, whatever the length of the list."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def without(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(on).distinct(), on, "left_anti")


def split_known_ids(source: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the requested ids, and the requested ids that do not occur."""
    wanted = ids.select(F.trim(F.col("id")).alias("id")).where("id <> ''").distinct()
    return restrict_to(source, wanted), wanted.join(source.select("id"), "id", "left_anti")


def metric_band(feed: DataFrame, metric: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows with a middling metric: within the given shares of the range from the smallest value to
    the 99th percentile.

    The percentile is exact at every size: rows are counted per value, the values are dealt over
    tasks by range and written once, and only the range that holds the wanted rank is put in order.
    """
    value = F.col(f"`{metric}`")
    partitions = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = feed.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # The written number of its range stays with a value, though ranges are drawn anew in each run.
    ranged = counts.repartitionByRange(partitions, "value").select("*", F.spark_partition_id().alias("_slice"))
    values = materialise(ranged, "metric-values")
    # One row per range: small enough to order in a single task.
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = values.groupBy("_slice").agg(F.sum("n").alias("n")).select("_slice", "n", F.sum("n").over(upto).alias("upto"))
    rank = F.expr("(99 * max(upto) OVER () + 99) div 100")
    hit = slices.select("_slice", "upto", (F.col("upto") - F.col("n")).alias("before"), rank.alias("rank"))
    hit = hit.where("before < rank AND rank <= upto").select("_slice", (F.col("rank") - F.col("before")).alias("rank"))
    inner = Window.partitionBy("_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.join(F.broadcast(hit), "_slice").withColumn("place", F.sum("n").over(inner))
    least = values.agg(F.min("value")).scalar()
    most = placed.where("place >= rank").agg(F.min("value")).scalar()

    def bound(share: float) -> Column:
        return least + share * (most - least)

    return feed.where(value.between(bound(low), bound(high)))


def in_part(df: DataFrame, parts: int | None, part: int | None, id_col: str = "id") -> DataFrame:
    """The rows of one of several stable parts; all rows without a number of parts."""
    if parts is None:
        return df
    return df.where(part_of(F.col(id_col), parts) == part)


def with_web_text(feed: DataFrame, web: DataFrame | None, id_col: str = "id") -> DataFrame:
    """The feed with the text of each item's page, null where there is none."""
    if web is None:
        return feed.withColumn("webpage_content", F.lit(None).cast("string"))
    texts = web.select(F.col("id").alias(id_col), F.col("content").alias("webpage_content"))
    return feed.join(texts, id_col, "left")


def complete_input(
    feed: DataFrame,
    web: DataFrame | None = None,
    id_col: str = "id",
    title_col: str = "title",
    desc_col: str = "description",
    image_col: str = SKIP,
) -> DataFrame:
    """All columns, plus the role names that are missing, plus page text."""
    have = set(feed.columns)
    added = {
        name: F.col(f"`{source}`")
        for name, source in (("id", id_col), ("title", title_col), ("description", desc_col))
        if name not in have
    }
    if "image_url" not in have:
        known = image_col != SKIP and image_col in have
        added["image_url"] = F.col(f"`{image_col}`") if known else F.lit(None).cast("string")
    return with_web_text(feed.withColumns(added) if added else feed, web)


def spread_left_join(left: DataFrame, right: DataFrame, on: str, spread: int = 256) -> DataFrame:
    """A left join whose rows without a key do not all meet in one task.

    Null keys match nothing, yet a shuffle sends them to one place; a second key spreads them. Hot
    keys of the left side are split at run time by the adaptive skew join.
    """
    salt = "_spread"
    lone = F.pmod(content_hash(left), F.lit(spread).cast("long")) + 1
    salted = left.withColumn(salt, F.when(F.col(on).isNull(), lone).otherwise(F.lit(0)))
    # Always 0, but computed: a constant would be folded into a condition and leave the join keys.
    keyed = right.where(F.col(on).isNotNull()).withColumn(
        salt, F.pmod(F.xxhash64(on), F.lit(1).cast("long"))
    )
    return salted.join(keyed, [on, salt], "left").drop(salt)


def unprocessed(
    feed: DataFrame,
    generated: DataFrame,
    id_col: str = "id",
    done: tuple[str, ...] = (C.SUCCESS, C.NON_COMPLIANT),
    filter_processed: bool = True,
) -> DataFrame:
    """Input rows that have no finished result yet; ids are compared as text."""
    if not filter_processed:
        return feed
    finished = generated.where(F.col("status").isin(*done)).select(
        F.col("id").cast("string").alias("_done")
    )
    return feed.join(
        finished.distinct(), F.col(id_col).cast("string") == F.col("_done"), "left_anti"
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows in which at least one cell holds something."""
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return df.where(F.length(F.concat_ws("", *cells)) > 0)


def sample_rows(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A sample of n rows, kept as a top-n so that no full sort takes place.

    The order is that of a digest of the key and the seed, so a task that runs again, or a second
    use of the sample, draws the same rows.
    """
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string")))
    return df.orderBy(digest, key).limit(n)


def item_json(feed: DataFrame, item_id: str, id_col: str = "id") -> DataFrame:
    """The whole row of one item as JSON."""
    from shelfloom.functions.prompts import row_json

    return feed.where(F.col(id_col) == item_id).select(row_json(feed.columns).alias("context"))
