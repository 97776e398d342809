"""Merkle manifest of a dataset, with nodes labelled by the intervals of leaves that they cover.

Leaves are numbered within their tree, one tree per source. A node is ``tree, level, lo, hi``: it covers
the leaves from lo up to hi, at most 16 ** level of them, and carries the digests of its children in
order. Levels are built from below; each is a sixteenth of the one before.

An interval of level k lies in one bucket of width 16 ** k, so containment is an equality of buckets:
from the root down, each node meets the level below by tree and lo, once on either side however large
the tree is, and hands its path on. The siblings of a child are the difference of the two intervals:
what the parent covers before and after it. The roots of the trees are the leaves of one more tree,
whose paths continue theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.exact import ascii_lower
from shelfloom.operators.numbering import with_row_index
from shelfloom.session import materialise

FAN = 16
_NO_PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hex digest of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of values read the same: its length in bytes goes before it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tree, rank, size`` beside each of ``id, leaf, changed``, and ``tree, size`` of the trees.

    Leaves of a source go by id, null first, equal ids by digest. Trees are numbered in order of
    sources, null first. A source may hold any share of the rows: they are numbered over all.
    """
    placed = with_row_index(leaves, ["source", "id", "leaf"], "place")
    sources = placed.groupBy("source").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("size"))
    sources = materialise(with_row_index(sources, ["begin"], "tree"), "sources")
    own = sources.withColumnRenamed("source", "_source")
    ranked = placed.join(own, F.col("source").eqNullSafe(F.col("_source")))
    ranked = ranked.select("tree", (F.col("place") - F.col("begin")).alias("rank"), "size", "id", "leaf", "changed")
    return ranked, sources.select("tree", "size")


def build(leaves: DataFrame, label: str) -> list[DataFrame]:
    """The levels of all trees from ``tree, rank, size, digest``, lowest first.

    A level has ``tree, lo, hi, size, kids, digest``: children in order, those of the lowest level as
    they came. Trees that are down to one node are absent from higher levels. A lone leaf is a node whose
    digest is its own.
    """
    own = [c for c in leaves.columns if c not in ("tree", "size")]
    rows = leaves.withColumn("lo", F.col("rank"))
    levels, span = [], 1
    while True:
        span *= FAN
        node = F.expr(f"lo div {span}").alias("node")
        gathered = rows.groupBy("tree", "size", node).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("kids"))
        digest = F.sha2(F.array_join("kids.digest", ""), 256)
        level = gathered.select(
            "tree",
            "size",
            (F.col("node") * span).alias("lo"),
            F.least("size", (F.col("node") + 1) * span).alias("hi"),
            "kids",
            F.when(F.col("size") == 1, F.col("kids")[0]["digest"]).otherwise(digest).alias("digest"),
        )
        levels.append(materialise(level, label))
        rows, own = levels[-1].where(F.col("size") > span), ["lo", "hi", "digest"]
        if rows.isEmpty():
            return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the node of each tree that covers all of it."""
    whole = [level.where("lo = 0 AND hi = size").select("tree", "digest") for level in levels]
    found = whole[0]
    for level in whole[1:]:
        found = found.unionByName(level)
    return found


def siblings(kids: Column, at: Column) -> Column:
    """Digests before and after a child, one after another: its parent's interval without its own."""
    digests = F.transform(kids, lambda k: k["digest"])
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"),
        F.array_join(F.slice(digests, at + 2, F.size(digests)), "").alias("right"),
    )


def paths(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Every leaf of the trees with its siblings, level by level up to the root.

    Columns: ``tree``, those of the leaf, and ``path``, an array of ``left`` and ``right``. ``above``
    (``tree, path`` and more) continues the paths of whole trees; its other columns come along. Each
    level meets the one below by the bucket that its intervals lie in, one node by one.
    """
    if above is None:
        above = roots(levels).select("tree", F.expr(f"CAST(array() AS {_NO_PATH})").alias("path"))
    carried = [c for c in above.columns if c not in ("tree", "path")]
    below = None
    for level in reversed(levels):
        whole = F.expr("lo = 0 AND hi = size")
        nodes = level.where(whole).join(above, "tree")
        if below is not None:
            nodes = nodes.unionByName(level.where(~whole).join(below, ["tree", "lo"]))
        kids = nodes.select("tree", "size", "path", "kids", *carried, F.posexplode("kids").alias("at", "kid"))
        beside = F.concat(F.array(siblings(F.col("kids"), F.col("at"))), "path")
        # A lone leaf is the root of its tree and has no level of its own.
        kids = kids.withColumn("path", F.when(F.col("size") == 1, F.col("path")).otherwise(beside))
        below = kids.select("tree", "kid.*", "path", *carried)
        if "hi" in below.columns:
            below = below.drop("hi", "digest")
    return below


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, p: hashed(p["left"], digest, p["right"]))


def manifest(
    rows: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """The manifest's entry of every row: ``id, leaf, changed, subroot, root, path``.

    ``leaf`` is the digest of ``fields`` in order; ``changed`` that of the same row with some fields
    replaced, to be checked against the manifest (``fold``); ``path`` holds the siblings from
    the leaf to the root. A null field differs from an empty one. Rows that occur twice are two leaves.
    Null ids and null sources come first. Other columns are ignored. No rows, no entries.
    """
    own = [F.col(f"`{c}`") for c in fields]
    other = [(changed or {}).get(c, column) for c, column in zip(fields, own)]
    leaves = rows.select(
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{id_col}`").alias("id"),
        hashed(*map(field, own)).alias("leaf"),
        hashed(*map(field, other)).alias("changed"),
    )
    ranked, sources = numbered_leaves(leaves)
    levels = build(ranked.withColumnRenamed("leaf", "digest"), "merkle-level")
    subroots = roots(levels).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(sources.count()).alias("size"), "digest"
    )
    upper = build(subroots, "merkle-sources")
    root = roots(upper).first()  # a single digest
    tops = paths(upper).select(
        F.col("rank").alias("tree"),
        "path",
        F.col("digest").alias("subroot"),
        F.lit(root and root["digest"]).cast("string").alias("root"),
    )
    found = paths(levels, materialise(tops, "source-paths"))
    return found.select("id", F.col("digest").alias("leaf"), "changed", "subroot", "root", "path")


def tampered(text: Column, id_col: Column, every: int = 5) -> Column:
    """The text with A-Z in lower case where the crc32 of the id in decimal divides by ``every``; null stays."""
    hit = F.crc32(id_col.cast("string").cast("binary")) % every == 0
    return F.when(hit & text.isNotNull(), ascii_lower(text)).otherwise(text)
