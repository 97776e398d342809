"""Near copies of vectors by counting collisions on sorted one-dimensional projections.

Every vector is scaled to length 1 and projected on many random lines. Two vectors collide on a line
where each lies in the window about the other; those at the least similarity do so on nearly all lines, far
ones on few. In a cell of vectors each line is sorted, so a vector's window is a range of places, and
collisions are counted per pair. Pairs with enough of them, by a bound on the share of links lost, are
verified with their cosine in doubles.

Cells keep this from meeting all pairs of a label. Several tables cut some lines near the middle of the
label, and the sides taken form the cell, with as many cuts as bring cells down to a bounded size and as many
tables as the same bound asks for. A pair counts in the first table where its cells agree. Cells
that stay too large, as of many near copies of one vector, are dealt in blocks and their pairs of
blocks over tasks. What leaves a task is linear in its vectors: links per vector and the edges of a
spanning forest. Equal vectors are one with a count throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.components import components, unite
from shelfloom.session import materialise

LEAST_COSINE = 0.98
# Lines to count on, the half width of a window in standard deviations of the projected distance of
# a pair at the least cosine, and the share of such pairs that each of the two filters may lose.
LINES, WIDTH, LOSS = 32, 2.0, 0.002
# Vectors in a cell that is not cut further, and queries counted at once.
CELL, QUERIES = 2048, 256
_VERIFIED = 1 << 16
MOST_TABLES = 64
# A line is cut between two of so many quantiles, where it holds at most this share of a label per unit
# of length. The places of evenly spread vectors have deviation 1, and so 0.4 in their middle.
QUANTILES, DENSEST = 32, 0.5


def normal_share(width: float) -> float:
    """Share of a normal variable within ``width`` standard deviations."""
    return math.erf(width / math.sqrt(2))


def least_count(lines: int, share: float, loss: float) -> int:
    """The most collisions that a pair, colliding on each line with ``share``, has but for ``loss``."""
    tail = 0.0
    for k in range(lines + 1):
        tail += math.comb(lines, k) * share**k * (1 - share) ** (lines - k)
        if tail > loss:
            return k
    return lines


def tables_for(cuts: int, cosine: float, loss: float) -> int:
    """Tables until a pair at ``cosine`` shares a cell in one of them but for ``loss``.

    A random cut through the middle parts two vectors with the share that their angle has of 180 degrees.
    """
    if cuts == 0:
        return 1
    missed = 1 - (1 - math.acos(cosine) / math.pi) ** cuts
    return min(MOST_TABLES, max(1, math.ceil(math.log(loss) / math.log(missed))))


def directions(dim: int, first: int, count: int) -> np.ndarray:
    """Random lines number ``first`` and on, the same wherever they are drawn."""
    return np.stack([np.random.default_rng([dim, k]).standard_normal(dim) for k in range(first, first + count)], axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares within the doubles.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def vector_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector``, where a vector that cannot be compared is null.

    Those are null, empty and zero vectors, those with a component that is null or not finite, and
    vectors without a label or an id.
    """
    vector = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + F.lit(0.0))  # no -0.0
    named = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("v"))
    ordinary = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", ordinary) & F.exists("v", lambda x: x != 0)
    return named.select("id", "label", F.when(usable, F.col("v")).alias("vector"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``label, dim, vector, key, node, times``: the different vectors, each with smallest id and rows."""
    grouped = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("times")
    )
    # Vectors of one id are told apart by the key.
    key = F.xxhash64("label", "vector").alias("key")
    return grouped.select("label", F.size("vector").alias("dim"), "vector", key, "node", "times")


def _arrays(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dim)


def _projected(first: int, count: int):
    """Places of each vector on lines number ``first`` and on."""

    def project(vectors: pa.Array, dims: pa.Array) -> pa.Array:
        dims = dims.to_numpy()
        places = np.zeros((len(dims), count))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            places[at] = _unit(_arrays(vectors.take(pa.array(at)), int(dim))) @ directions(int(dim), first, count)
        offsets = pa.array(np.arange(len(dims) + 1, dtype=np.int32) * count)
        return pa.ListArray.from_arrays(offsets, pa.array(places.ravel()))

    return F.arrow_udf(project, "array<double>")


def cut_place(quantiles: Column) -> Column:
    """The most even cut between neighbouring quantiles that lie far enough apart; null if none do.

    Many near copies of one vector crowd a piece of the line, often the middle, where a cut would part
    the same pairs in every table. Where vectors are no denser than DENSEST, it parts few.
    """
    least = 1 / QUANTILES / DENSEST
    place = lambda i: F.struct(
        F.abs(i - (QUANTILES - 2) / 2).alias("off"),
        ((F.get(quantiles, i) + F.get(quantiles, i + 1)) / 2).alias("at"),
        (F.get(quantiles, i + 1) - F.get(quantiles, i)).alias("gap"),
    )
    places = F.transform(F.sequence(F.lit(0), F.lit(QUANTILES - 3)), place)
    return F.array_min(F.filter(places, lambda p: p["gap"] >= least))["at"]


def cut(vectors: DataFrame, cosine: float, cell: int) -> DataFrame:
    """Each vector with the cells it has in the tables of its label: ``cells``, an array of numbers.

    The number of cuts and tables grows with the size of the label alone, and quantiles are taken over
    all of it. A line without a fit place has a single side.
    """
    sizes = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "cuts", F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / cell))).cast("int")
    )
    sizes = materialise(sizes, "label-sizes")
    # One number per level of cuts that occurs: at most the logarithm of the table's rows.
    plans = {r["cuts"]: tables_for(r["cuts"], cosine, LOSS) for r in sizes.select("cuts").distinct().collect()}
    lines = max((cuts * tables for cuts, tables in plans.items()), default=0)
    sized = vectors.join(sizes.select("label", "dim", "cuts"), ["label", "dim"])
    if lines == 0:
        return sized.withColumn("cells", F.array(F.lit(0).cast("long"))).drop("cuts")
    placed = materialise(sized.withColumn("places", _projected(LINES, lines)("vector", "dim")), "vector-places")
    quantiles = F.array(*[F.lit(k / QUANTILES) for k in range(1, QUANTILES)])
    middle = [cut_place(F.percentile_approx(F.col("places")[k], quantiles, 1000)) for k in range(lines)]
    middles = placed.where("cuts > 0").groupBy("label", "dim").agg(F.array(*middle).alias("middles"))
    sided = placed.join(middles, ["label", "dim"], "left")

    def of_table(cuts: int, table: int):
        bits = [
            F.when(F.col("places")[k] > F.col("middles")[k], F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, k in enumerate(range(table * cuts, (table + 1) * cuts))
        ]
        total = bits[0]
        for bit in bits[1:]:
            total = total + bit
        return total

    cells = F.array(F.lit(0).cast("long"))
    for cuts, tables in plans.items():
        if cuts:
            cells = F.when(F.col("cuts") == cuts, F.array(*[of_table(cuts, t) for t in range(tables)])).otherwise(cells)
    return sided.withColumn("cells", cells).drop("cuts", "places", "middles")


def window_counts(places: np.ndarray, half: float, first: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """On how many lines rows collide: for some rows from ``start`` on, with all rows from ``others`` on.

    Each line is sorted once, and the window about a place is a range of ranks. Without ``first`` all rows
    meet each other; with it the first so many rows meet the rest.
    """
    size, lines = places.shape
    kind = np.uint16 if size < 1 << 16 else np.uint32
    ranks, lows, spans = (np.empty((lines, size), dtype=kind) for _ in range(3))
    for k in range(lines):
        order = np.argsort(places[:, k], kind="stable")
        line = places[order, k]
        ranks[k, order] = np.arange(size, dtype=kind)
        lows[k] = np.searchsorted(line, places[:, k] - half, side="left")
        spans[k] = np.searchsorted(line, places[:, k] + half, side="right") - lows[k]
    last = size if first is None else first
    for start in range(0, last, QUERIES):
        end = min(last, start + QUERIES)
        others = start if first is None else first
        counts = np.zeros((end - start, size - others), dtype=np.uint8)
        for k in range(lines):
            # Ranks below the window wrap around to large numbers.
            counts += (ranks[k][None, others:] - lows[k, start:end, None]) < spans[k, start:end, None]
        yield start, others, counts


def _pairs(cosine: float):
    """Links of one cell, or of two blocks of one: per vector how many, and the edges of a forest."""
    half = WIDTH * math.sqrt(2 - 2 * cosine)
    enough = least_count(LINES, normal_share(WIDTH), LOSS)

    def run(group: pa.Table) -> pa.Table:
        dim, table_no, i, j = (group.column(c)[0].as_py() for c in ("dim", "table", "i", "j"))
        group = group.sort_by([("block", "ascending"), ("node", "ascending"), ("key", "ascending")])
        node, key, times, block = (group.column(c).to_numpy() for c in ("node", "key", "times", "block"))
        unit = _unit(_arrays(group.column("vector").combine_chunks(), dim))
        cells = np.array(group.column("cells").to_pylist(), dtype=np.int64)
        first = None if i == j else int(np.count_nonzero(block == i))
        links, parent = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for start, others, counts in window_counts(unit @ directions(dim, 0, LINES), half, first):
            a, b = np.nonzero(counts >= enough)
            a, b = a + start, b + others
            a, b = a[a < b], b[a < b]
            if table_no:
                before = (cells[a, :table_no] == cells[b, :table_no]).any(axis=1)
                a, b = a[~before], b[~before]
            for at in range(0, len(a), _VERIFIED):
                x, y = a[at : at + _VERIFIED], b[at : at + _VERIFIED]
                close = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                x, y = x[close], y[close]
                links += np.bincount(x, weights=times[y], minlength=len(node)).astype(np.int64)
                links += np.bincount(y, weights=times[x], minlength=len(node)).astype(np.int64)
                parent = unite(parent, x, y)
        some, tied = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(node)))
        none = pa.nulls(len(some), pa.int64())
        return pa.table(
            {
                "node": np.concatenate([node[some], node[tied]]),
                "key": np.concatenate([key[some], key[tied]]),
                "other": pa.concat_arrays([none, pa.array(node[parent[tied]], type=pa.int64())]),
                "links": np.concatenate([links[some], np.zeros(len(tied), dtype=np.int64)]),
            }
        )

    return run


def vector_links(vectors: DataFrame, cosine: float = LEAST_COSINE, cell: int = CELL) -> DataFrame:
    """``node, key, other, links``: per different vector its links in a cell, or an edge to another node.

    Every linked pair is counted once; edges connect what links connect.
    """
    placed = cut(vectors, cosine, cell)
    tables = placed.select("*", F.posexplode("cells").alias("table", "cell"))
    cells = ["label", "dim", "table", "cell"]
    counts = tables.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int").alias("blocks"))
    counts = materialise(counts, "cell-counts")
    dealt = tables.join(counts, cells).withColumn("block", F.pmod(F.xxhash64("key", "node", "table"), "blocks").cast("int"))
    # A block meets each block of its cell once, itself too.
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    met = met.select(*cells, "i", "j", "block", "vector", "key", "node", "times", "cells")
    return met.groupBy(*cells, "i", "j").applyInArrow(_pairs(cosine), "node long, key long, other long, links long")


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = LEAST_COSINE,
    cell: int = CELL,
) -> DataFrame:
    """``id, n_links, component_id, kept`` per row: its links of ``cosine`` or more within its label.

    ``n_links`` counts other rows, copies too; ``component_id`` is the smallest id that links lead to.
    Rows without links, among them all whose vector or label cannot be compared, stand alone and are kept; a null
    id has a null component. Rows that repeat an id are links of each other if their vectors are. Vectors of
    different length are not compared. Other columns are ignored; an empty table gives no rows.
    """
    own = vector_rows(rows, id_col, vector_col, label_col)
    vectors = materialise(distinct_vectors(own), "vectors")
    links = materialise(vector_links(vectors, cosine, cell), "vector-links")
    counted = links.groupBy("node", "key").agg(F.sum("links").alias("links"))
    roots = components(links.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    found = vectors.join(counted, ["node", "key"], "left").join(roots, "node", "left")
    found = found.select(
        "label",
        "vector",
        (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    compared = own.where("vector IS NOT NULL").join(found, ["label", "vector"])
    alone = own.where("vector IS NULL").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("id")})
    columns = ["id", "n_links", "component_id"]
    every = compared.select(columns).unionByName(alone.select(columns))
    return every.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
