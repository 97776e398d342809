"""Exact top-k search: score histograms locate each query's kth value, then one filter takes it.

Vectors become rows of whole numbers, so scores are whole and equal everywhere. Blocks of queries
meet blocks of candidates; what leaves a pair of blocks is a few counts per query, never scores.
The first range of a query is bounded by lengths of vectors, without a score. Each round scores
everything again and counts the scores of the one bin of the round before that holds the kth value,
split into finer bins and up to its exact end, until a bin is a single score; unit vectors take two
rounds. A pair of blocks counts only down to its own kth score, below which the kth of all cannot
lie, so what it gives does not grow with the number of bins or candidates. The last round takes what
lies above the kth score, and of those that equal it the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.session import materialise

SCALE = 1024
BINS = 4096
# Candidates travel once to each block of queries in every round, so those are the larger ones.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 1024
# Sums of products of two limbs over so many dimensions are whole in a double.
LIMB, LIMB_DIMS = 2.0**20, 4096


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, values``: floor(1024 * x) of each component as doubles in bytes.

    Rows with a null id, a null vector or a component that is null, infinite or not a number take
    no part. Components may be of any size; only a score that does not fit a long is an error.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    ordinary = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v"))
    usable = usable.where("id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", ordinary))
    # Shifting the point of a double is exact; floor gives the integer as a double again. Products
    # from 2^53 on are whole already, and floor would cut those that exceed a long.
    whole = lambda x: F.when(F.abs(x) * SCALE < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    return usable.select("id", F.size("v").alias("dim"), F.transform("v", whole).alias("values"))


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors packed into blocks of about ``size``: ``<name>, dim, ids, matrix``.

    Blocks form by a hash of the row, one count per dimension deciding how many there are, so the
    many vectors of one id spread over them all.
    """
    counts = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
    counts = materialise(counts, "vector-counts")
    placed = vectors.join(counts, "dim").withColumn(
        name, F.pmod(F.xxhash64("id", "values", F.lit(name)), F.col("_blocks")).cast("int")
    )
    # A row that occurs many times would fill its block, so it is a row with a count.
    merged = placed.groupBy("dim", name, "id", "values").agg(F.count(F.lit(1)).alias("times"))
    packed = merged.groupBy("dim", name).agg(F.sort_array(F.collect_list(F.struct("id", "values", "times"))).alias("rows"))
    return packed.select(
        "dim", name, F.col("rows.id").alias("ids"), F.flatten("rows.values").alias("matrix"), F.col("rows.times").alias("times")
    )


def _matrix(values: pa.Scalar, dim: int, count: int) -> np.ndarray:
    return np.asarray(values.values.to_numpy(zero_copy_only=False), dtype=float).reshape(count, dim)


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """The lowest 80 bits of whole doubles, 20 at a time from the low end; negative ones as two's complement."""
    parts = []
    for _ in range(4):
        rest = np.floor(values / LIMB)
        parts.append(values - rest * LIMB)
        values = rest
    return parts


def _wide_scores(q: np.ndarray, c: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact scores of whole vectors whose products may leave the whole doubles, where ``asked``.

    Limbs multiply exactly in doubles and add up modulo 2^64, which is the score if that fits a
    long. Where the sizes of the products do not show that it does, it is summed without a limit.
    """
    total = np.zeros((len(q), len(c)), dtype=np.uint64)
    with np.errstate(all="ignore"):
        for at in range(0, q.shape[1], LIMB_DIMS):
            q_parts, c_parts = (_limbs(x[:, at : at + LIMB_DIMS]) for x in (q, c))
            for i, a in enumerate(q_parts):
                for j, b in enumerate(c_parts[: 4 - i]):
                    total += (a @ b.T).astype(np.uint64) << np.uint64(20 * (i + j))
        fits = np.abs(q) @ np.abs(c).T < 2.0**62
    scores = total.view(np.int64)
    for i, j in np.argwhere(asked & ~fits):
        pairs = ((a, b) for a, b in zip(q[i].tolist(), c[j].tolist()) if a and b)
        # An infinite component is a finite one that left the doubles when it was scaled.
        exact = sum(int(a) * int(b) if np.isfinite((a, b)).all() else 1 << 1024 for a, b in pairs)
        if not -(1 << 63) <= exact < 1 << 63:
            raise OverflowError("vector components are too large for exact scores in a long")
        scores[i, j] = exact
    return scores


def _exact_scores(q: np.ndarray, c: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whole scores of all pairs; only those of ``asked`` count.

    Doubles serve where all products and sums stay whole in them. The others lie where a large query
    vector meets a large candidate.
    """
    with np.errstate(all="ignore"):
        scores = (q @ c.T).astype(np.int64)
        q_most, c_most = np.abs(q).max(axis=1, initial=0.0), np.abs(c).max(axis=1, initial=0.0)
        dim = max(1, q.shape[1])
        rows = np.flatnonzero(~(q_most * c_most.max(initial=0.0) * dim < 2.0**53))
        columns = np.flatnonzero(~(c_most * q_most.max(initial=0.0) * dim < 2.0**53))
    if len(rows) and len(columns):
        at = np.ix_(rows, columns)
        scores[at] = _wide_scores(q[rows], c[columns], asked[at])
    return scores


def _scored(batches: Iterator[pa.RecordBatch]):
    """Per pair of blocks: the batch, the row, ids of queries and candidates, times and scores.

    A query's own vector scores nothing: its place holds a flag instead.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            q_ids, c_ids = (
                batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("q_ids", "c_ids")
            )
            dim = batch.column("dim")[i].as_py()
            q, c = (_matrix(batch.column(m)[i], dim, len(k)) for m, k in (("q_matrix", q_ids), ("c_matrix", c_ids)))
            other = q_ids[:, None] != c_ids[None, :]
            times = batch.column("c_times")[i].values.to_numpy(zero_copy_only=False)
            yield batch, i, q_ids, c_ids, times, _exact_scores(q, c, other), other


_COUNTS = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("times", pa.int64())])


def _limits(batch: pa.RecordBatch, i: int, q_ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
    """The state of each query of a block, in the order of its ids; -1 width where it has none."""
    state = {r["query_id"]: r for r in batch.column("state")[i].as_py()}
    blank = dict.fromkeys(names, 0) | {"width": -1}
    return [np.array([state.get(q, blank)[n] for q in q_ids.tolist()], dtype=np.int64) for n in names]


def _top(scores: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """Those of ``inside`` that are no lower than the kth of them in their row."""
    if scores.shape[1] <= k:
        return inside
    masked = np.where(inside, scores, np.iinfo(np.int64).min)
    kth = np.partition(masked, -k, axis=1)[:, -k]
    return inside & (masked >= kth[:, None])


def _histogram(k: int):
    """Counts per bin of each query's present range, down to the kth score of a pair of blocks.

    The bins may reach beyond the range, but only scores from ``low`` to ``high`` are counted: those
    above it have been taken already. The kth score of all is no lower than that of any pair of
    blocks, so whatever lies at or above it is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, q_ids, _, times, scores, other in _scored(batches):
            low, high, width = _limits(batch, i, q_ids, ("low", "high", "width"))
            inside = other & (width[:, None] > 0) & (scores >= low[:, None]) & (scores <= high[:, None])
            row, column = np.nonzero(_top(scores, inside, k))
            # The distance of two longs may need all 64 bits.
            bins = (scores[row, column] - low[row]).view(np.uint64) // width[row].astype(np.uint64)
            filled, place = np.unique(row * BINS + bins.astype(np.int64), return_inverse=True)
            if len(filled):
                counts = np.bincount(place, weights=times[column]).astype(np.int64)
                columns = (q_ids[filled // BINS], filled % BINS, counts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_COUNTS)

    return run


def _select(k: int):
    """What lies above each query's kth score, and the smallest ids at it, from each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, q_ids, c_ids, times, scores, other in _scored(batches):
            low, width = _limits(batch, i, q_ids, ("low", "width"))
            known = other & (width[:, None] >= 0)
            # Candidates are in order of id, so the first k equal ones are the smallest.
            equal = known & (scores == low[:, None])
            equal &= np.cumsum(equal, axis=1) <= k
            row, column = np.nonzero(equal | (known & (scores > low[:, None])))
            if len(row):
                columns = (q_ids[row], c_ids[column], scores[row, column], times[column])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_FOUND)

    return run


def first_ranges(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, low, high, width, left``: ends that no score of a query id can pass.

    A score is at most the product of the lengths of its vectors. ``left`` is k, or the number of
    candidates if that is less; a query id without candidates has no row. ``queries`` has a row per
    different ``id, dim, values`` with its number of rows as ``times``.
    """
    length = F.sqrt(F.aggregate("values", F.lit(0.0), lambda total, x: total + x * x))
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.max(length).alias("longest"))
    # Written, so that its true size decides how it is joined: by dimension, ids would meet in few tasks.
    sizes = materialise(sizes, "dimension-sizes")
    asked = queries.groupBy("id", "dim").agg(
        F.count(F.lit(1)).alias("asked"), F.sum("times").alias("own"), F.max(length).alias("length")
    )
    # Rounding of the lengths is far below the millionth that is added.
    most = F.ceil(F.col("length") * F.col("longest") * (1 + 1e-6)) + 1
    product = F.col("length") * F.col("longest")
    most = F.when(product < 2.0**62, most).otherwise(F.lit(2**63 - 1))
    found = asked.join(sizes, "dim").groupBy(F.col("id").alias("query_id")).agg(
        F.max(most).alias("high"), F.sum(F.col("asked") * (F.col("rows") - F.col("own"))).alias("n")
    )
    found = found.where("n > 0").withColumn("low", -F.col("high") - 1)
    # Ranges of longs can be longer than a long, so they are computed as decimals.
    span = F.expr(f"(cast(high AS decimal(20,0)) - cast(low AS decimal(20,0))) div {BINS} + 1")
    return found.select("query_id", "low", "high", span.cast("long").alias("width"), F.least("n", F.lit(k)).alias("left"))


def _block_counts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``dim, last, salts``, a row per dimension: the last query block, and over how many salts candidates are dealt.

    Written, so that its true size decides how it is joined: by dimension, blocks would meet in few tasks.
    """
    most = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = candidates.groupBy("dim").agg(F.least(F.lit(most), F.max("c_block") + 1).alias("salts"))
    return materialise(queries.groupBy("dim").agg(F.max("q_block").alias("last")).join(salts, "dim"), "block-counts")


def _meet(queries: DataFrame, candidates: DataFrame, state: DataFrame, counts: DataFrame) -> DataFrame:
    """Every query block beside every candidate block of its dimension, with the queries' state.

    Candidates go once to each query block of their dimension, dealt over salts, and query blocks
    to every salt that has candidates, so the pairs of even a single dimension spread over all tasks.
    """
    left = queries.select("dim", "q_block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    left = left.join(state, ["dim", "q_block"])
    left = left.join(counts.select("dim", "salts"), "dim")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = candidates.join(counts, "dim").select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("q_block"),
        F.pmod("c_block", "salts").alias("salt"),
        F.col("ids").alias("c_ids"),
        F.col("matrix").alias("c_matrix"),
        F.col("times").alias("c_times"),
    )
    return left.join(right, ["dim", "q_block", "salt"])


def top_k(
    rows: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    is_query=None,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    ``is_query`` is a condition on the id column (default: ids divisible by 100). Candidates of a
    query are all usable rows of its dimension but those of its own id; ties go to the smaller id;
    fewer candidates give fewer rows. A row that occurs several times is a candidate several times,
    but asked once. Several different vectors of one query id are all asked: the id's rows are the k
    highest scores that any of them has, and a candidate stands there once for each that finds it.
    An empty table gives no rows; other columns are ignored.
    """
    vectors = materialise(whole_vectors(rows, id_col, vector_col), "whole-vectors")
    asked = F.col("id") % 100 == 0 if is_query is None else is_query(F.col("id"))
    different = vectors.where(asked).groupBy("id", "dim", "values").agg(F.count(F.lit(1)).alias("times"))
    different = materialise(different, "queries")
    queries = materialise(blocks(different.drop("times"), query_block, "q_block"), "query-blocks")
    candidates = materialise(blocks(vectors, candidate_block, "c_block"), "candidate-blocks")
    met = _block_counts(queries, candidates)
    # The vectors of one query id share its state, as their scores make one order.
    owner = queries.select("dim", "q_block", F.explode(F.array_distinct("ids")).alias("query_id"))

    def gathered(state: DataFrame) -> DataFrame:
        rows = F.collect_list(F.struct("query_id", "low", "high", "width"))
        return state.join(owner, "query_id").groupBy("dim", "q_block").agg(rows.alias("state"))

    # ``high`` is the last score of the present range; ``left``: how many of the range are still to
    # be taken, from the top.
    long = lambda c: F.col(c).cast("decimal(20,0)")
    state = materialise(first_ranges(vectors, different, k), "kth-range")
    while not (open_ := state.where("width > 0")).isEmpty():
        counts = _meet(queries, candidates, gathered(open_), met).mapInArrow(_histogram(k), "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # At most as many rows per query as there are bins.
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        above = F.sum("n").over(down) - F.col("n")
        hit = counts.select("query_id", "bin", "n", above.alias("above")).join(open_, "query_id")
        hit = hit.where("above < left AND above + n >= left")
        # A bin of one score is settled; its width becomes 0.
        finer = F.expr(f"CASE WHEN width = 1 THEN 0 ELSE (width - 1) div {BINS} + 1 END").cast("long")
        refined = hit.select(
            "query_id",
            (long("low") + long("bin") * long("width")).cast("long").alias("low"),
            F.least(long("high"), long("low") + (long("bin") + 1) * long("width") - 1).cast("long").alias("high"),
            finer.alias("width"),
            (F.col("left") - F.col("above")).alias("left"),
        )
        state = materialise(refined.unionByName(state.where("width = 0")), "kth-range")
    found = _meet(queries, candidates, gathered(state), met).mapInArrow(
        _select(k), "query_id long, vec_id long, score long, times long"
    )
    # Per query less than k rows lie above its kth score, and each block adds at most k equal ones.
    repeated = found.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = repeated.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
