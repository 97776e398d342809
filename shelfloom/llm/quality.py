"""Quality: what a document's text says, shrunk towards what its path and its host say."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from shelfloom.llm.words import slices, text_bytes, word_hashes, word_spans
from shelfloom.session import materialise

# Classes of bytes whose share of a text is a feature.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "mark": b"!|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "break": b"\n\r",
}
_SLICE = 2 << 20
FEATURES = [*CLASSES, "wide", "repeated_word", "distinct_words", "word_length", "size", "empty"]


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, from the whole text; null counts as empty.

    A batch is worked off in slices, so memory is bounded by a slice or the longest text.
    """
    rows = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [_features(part.column("text")) for part in slices(rows, "text", _SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    count, size = len(texts), np.diff(offsets)
    result = np.zeros((count, len(FEATURES)))
    kinds = np.full(256, len(CLASSES) + 1, dtype=np.uint8)
    for i, members in enumerate(CLASSES.values()):
        kinds[list(members)] = i
    kinds[128:] = len(CLASSES)
    width = len(CLASSES) + 2
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    for i in range(count):
        a, b = offsets[i], offsets[i + 1]
        shares = np.bincount(kinds[data[a:b]], minlength=width)[:-1] / max(1, b - a)
        words = hashes[before[i] : before[i + 1]]
        n = len(words)
        repeated = np.count_nonzero(words[1:] == words[:-1]) / max(1, n - 1)
        distinct = len(np.unique(words)) / np.sqrt(max(1, n))
        length = np.sum(ends[before[i] : before[i + 1]] - starts[before[i] : before[i + 1]]) / max(1, n)
        result[i] = [*shares, repeated, distinct, min(length, 50.0), np.log1p(size[i]), n == 0]
    return result


@F.arrow_udf(ArrayType(DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    return pa.array(list(text_features(texts)), type=pa.list_(pa.float64()))


def fit(rows: np.ndarray, labels: np.ndarray, decay: float = 1e-2, rounds: int = 30):
    """Logistic regression by Newton steps on standardised features: weights and offset."""
    if not len(labels) or labels.min() == labels.max():
        # Nothing to tell apart: say what the labels say, or yes if there are none.
        ones, rows = (labels.sum(), len(labels)) if len(labels) else (1.0, 1)
        return np.zeros(len(FEATURES)), float(np.log((ones + 0.5) / (rows - ones + 0.5)))
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.column_stack([(rows - mean) / spread, np.ones(len(rows))])
    penalty = np.full(x.shape[1], decay * len(rows))
    penalty[-1] = 0.0
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty + 1e-9)
        w -= np.linalg.solve(curve, slope)
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


def text_model(docs: DataFrame, labels: DataFrame, max_sample: int):
    """Weights from a hash-drawn sample of about ``max_sample`` labelled documents.

    The sample is bounded, so its ids are broadcast and a dozen numbers per document come back.
    """
    known = labels.where("_id IS NOT NULL AND _label IS NOT NULL").groupBy("_id").agg(
        F.max("_label").alias("_label")
    )
    limit = int(min(1.0, max_sample / max(1, known.count())) * 2**62)
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("_id"), 2) <= F.lit(limit))
    found = docs.join(F.broadcast(drawn), "_id").select("_id", "_label", features("_text").alias("f"))
    # Rows that repeat an id count once, which also keeps the sample within its bound.
    sample = found.groupBy("_id", "_label").agg(F.max("f").alias("f"))
    rows = sorted((tuple(r) for r in sample.collect()), key=lambda r: (r[0], r[2]))
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r[1]) for r in rows]))


def evidence(weights: np.ndarray, offset: float):
    """A function from a text column to the classifier's probability of good quality."""

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        z = text_features(texts) @ weights + offset
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -12, 12))), type=pa.float64())

    return probability


def _logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, mean: Column, share: Column, size: Column) -> float:
    """How many documents a prior is worth, by moments.

    The spread of group means about their prior mean, beyond what groups of that size show by
    chance, against the spread of single documents. Alike groups give a strong prior.
    """
    chance = (mean * (1 - mean) / size) * size
    spread, noise, single, n = groups.agg(
        F.sum(size * (share - mean) ** 2), F.sum(chance), F.sum(size * mean * (1 - mean)), F.sum(size)
    ).first()
    if not n or not single:
        return 1.0
    between = max((spread - noise) / n, 1e-9)
    return float(min(1e6, max(1.0, (single / n) / between - 1.0)))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """One row per path with its sums and its host's posterior, the path prior's worth and mean.

    ``scored`` has ``_host, _path, _p``. Hosts shrink towards the global mean, paths towards their
    host: posterior = (sum + worth * prior) / (documents + worth). All are grouped aggregates, so a
    host with a third of all rows is one row per task before it moves.
    """
    paths = materialise(
        scored.groupBy("_host", "_path").agg(
            F.sum("_p").alias("_path_sum"), F.count(F.lit(1)).alias("_path_rows")
        ),
        "path-sums",
    )
    total, rows = paths.agg(F.sum("_path_sum"), F.sum("_path_rows")).first()
    overall = (total + 1.0) / (rows + 2.0) if rows else 0.5
    hosts = materialise(
        paths.groupBy("_host").agg(F.sum("_path_sum").alias("s"), F.sum("_path_rows").alias("n")),
        "host-sums",
    )
    worth = _strength(hosts, F.lit(overall), F.col("s") / F.col("n"), F.col("n"))
    posterior = (F.col("s") + worth * overall) / (F.col("n") + worth)
    hosts = hosts.select(F.col("_host").alias("_own_host"), posterior.alias("_host_posterior"))
    sites = materialise(
        paths.join(hosts, F.col("_host").eqNullSafe(F.col("_own_host"))).drop("_own_host"), "sites"
    )
    path_worth = _strength(
        sites,
        F.col("_host_posterior"),
        F.col("_path_sum") / F.col("_path_rows"),
        F.col("_path_rows"),
    )
    return sites.withColumns(
        {"_worth": F.lit(path_worth), "_overall": F.lit(float(overall))}
    ), path_worth


def _scored(docs: DataFrame, labels: DataFrame, cols: dict, max_sample: int) -> DataFrame:
    """``_row, _id, _host, _path, _p`` of every document."""
    own = docs.select(
        F.struct("*").alias("_row"),
        F.col(f"`{cols['id']}`").alias("_id"),
        F.col(f"`{cols['text']}`").alias("_text"),
        F.col(f"`{cols['host']}`").cast("string").alias("_host"),
        F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols["path"]]).alias("_path"),
    )
    taught = labels.select(F.col(f"`{cols['id']}`").alias("_id"), F.col(f"`{cols['label']}`").alias("_label"))
    weights, offset = text_model(own.select("_id", "_text"), taught, max_sample)
    return own.withColumn("_p", evidence(weights, offset)("_text")).drop("_text")


def _judge(scored: DataFrame, sites: DataFrame, threshold: float) -> DataFrame:
    """Add the path posterior without the document itself, the quality and the decision."""
    own = sites.withColumnsRenamed({"_host": "_site_host", "_path": "_site_path"})
    same = F.col("_host").eqNullSafe(F.col("_site_host")) & F.col("_path").eqNullSafe(F.col("_site_path"))
    others, n = F.col("_path_sum") - F.col("_p"), F.col("_path_rows") - 1
    posterior = (others + F.col("_worth") * F.col("_host_posterior")) / (n + F.col("_worth"))
    logit = _logit(F.col("_p")) + _logit(F.col("_posterior")) - _logit(F.col("_overall"))
    return (
        scored.join(own, same)
        .withColumn("_posterior", posterior)
        .withColumn("_quality", 1 / (1 + F.exp(-logit)))
        .withColumn("_kept", F.col("_quality") >= threshold)
    )


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: Sequence[str] = ("lang",),
    label_col: str = "quality",
    max_sample: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """``id, evidence, host_posterior, path_posterior, quality, kept`` per row of ``docs``.

    A classifier of the whole text gives the evidence. Its log odds are moved by how far the
    posterior of the document's path (a host's documents with equal ``path_cols``, the document
    itself left out) lies from the global mean. Null hosts are one host, null path parts are empty,
    null texts count as empty texts. Labels that are null or of a null id teach nothing; of several
    labels of an id the highest counts; without labels every text counts as good. Repeated rows are
    judged alike, and an empty table gives no rows.
    """
    cols = {"id": id_col, "text": text_col, "host": host_col, "path": path_cols, "label": label_col}
    scored = materialise(
        _scored(docs, labels, cols, max_sample).select("_id", "_host", "_path", "_p"), "evidence"
    )
    sites, _ = site_posteriors(scored)
    return _judge(scored, sites, threshold).select(
        F.col("_id").alias(id_col),
        F.col("_p").alias("evidence"),
        F.col("_host_posterior").alias("host_posterior"),
        F.col("_posterior").alias("path_posterior"),
        F.col("_quality").alias("quality"),
        F.col("_kept").alias("kept"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_cols: Sequence[str] = ("lang",),
    label_col: str = "quality",
    max_sample: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with their own columns.

    Null and empty texts, ties, repeated rows, labels and an empty table count as there; columns of
    any name come back as they came.
    Texts do not take part in a shuffle unless the table of paths is too large to broadcast.
    """
    cols = {"id": id_col, "text": text_col, "host": host_col, "path": path_cols, "label": label_col}
    scored = _scored(docs, labels, cols, max_sample)
    sites, _ = site_posteriors(scored)
    return _judge(scored, sites, threshold).where("_kept").select("_row.*")
