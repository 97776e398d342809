"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.words import M1, slices

NGRAMS = (3, 4, 5)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS

# A longer text is hashed piece by piece.
_PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    """Weight of each bucket times its ratio, the squared ratios, and the offset."""

    weights: np.ndarray
    squares: np.ndarray
    offset: float

    def score(self, buckets: np.ndarray) -> float:
        norm = np.sqrt(self.squares[buckets].sum() + 1.0)
        z = self.weights[buckets].sum() / norm + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def buckets_of(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The buckets of all n-grams of the lower-cased text between two blanks.

    ``seen`` is scratch space of one flag per bucket.
    """
    seen[:] = False
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), dtype=np.uint32)
    for at in range(0, len(points), _PIECE):
        letters = points[at : at + _PIECE + NGRAMS[-1] - 1].astype(np.uint64)
        grams = letters
        for n in range(2, NGRAMS[-1] + 1):
            if len(letters) < n:
                break
            grams = grams[:-1] * M1 + letters[n - 1 :]
            if n in NGRAMS:
                spread = (grams ^ (grams >> np.uint64(32))) * M1
                seen[(spread >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's labelled texts fill each bucket, by label."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    seen = np.zeros(BUCKETS, dtype=bool)
    for batch in batches:
        for part in slices(batch, "text"):
            for text, label in zip(part.column("text"), part.column("label").to_pylist()):
                counts[label, buckets_of(text.as_py(), seen)] += 1
    filled = np.flatnonzero(counts.any(axis=0))
    if len(filled):
        columns = [pa.array(filled.astype(np.int32)), *(pa.array(c[filled]) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "clean", "toxic"])


def _telling(shared):
    """The buckets with a telling ratio of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, seen = shared.value, np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            for part in slices(batch, "text"):
                found = (buckets_of(t.as_py(), seen) for t in part.column("text"))
                told = pa.array([b[ratios[b] != 0].tobytes() for b in found], type=pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), told], ["key", "label", "found"]
                )

    return run


def log_ratios(toxic: np.ndarray, clean: np.ndarray, least: float) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket; those nearer to 0 than ``least`` count as 0."""
    p, q = toxic + 1.0, clean + 1.0
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(np.abs(ratios) < least, 0.0, ratios)


def train(
    samples: list[tuple[int, np.ndarray]], ratios: np.ndarray, rounds: int, decay: float
) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled buckets, both labels of equal weight, by Adam steps."""
    labels = np.array([label for label, _ in samples], dtype=float)
    found = [b for _, b in samples]
    weights, ones = np.zeros(BUCKETS), labels.sum()
    offset = float(np.log((ones + 0.5) / (len(labels) - ones + 1.0)))
    if ones == 0 or ones == len(labels):
        return weights, offset
    index = np.concatenate(found)
    owner = np.repeat(np.arange(len(found)), [len(b) for b in found])
    squares = np.bincount(owner, weights=ratios[index] ** 2, minlength=len(found))
    scale = 1.0 / np.sqrt(squares + 1.0)
    share = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones))
    # The last entry of parameters and moments is the offset.
    params = np.append(weights, offset)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        value = (params[:-1] * ratios)[index]
        z = np.bincount(owner, weights=value, minlength=len(found)) * scale + params[-1]
        error = share * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope = np.bincount(index, weights=(error * scale)[owner], minlength=BUCKETS) * ratios
        slope = np.append(slope + decay * params[:-1], error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        step_size = np.sqrt(second / (1 - 0.99**step)) + 1e-8
        params -= 0.1 * (first / (1 - 0.9**step)) / step_size
    return params[:-1], float(params[-1])


def fit(
    texts: DataFrame,
    taught: DataFrame,
    max_sample: int = 20_000,
    max_buckets: int = 1 << 25,
    least_ratio: float = 0.5,
    rounds: int = 60,
    decay: float = 3e-4,
) -> Model:
    """Learn from ``doc_id, text`` and one ``label`` (0 or 1) per ``doc_id``.

    The log-count ratios count every labelled text. The linear weights are fitted in one task on a
    sample of about ``max_sample`` texts, or fewer if they would fill more than about ``max_buckets``
    buckets together, so long texts do not outgrow the task. It is drawn by a hash of the id, and only
    the buckets with a telling ratio are kept; these are the only bounds, and they do not touch what is
    scored. The ids of the sample are broadcast, which the bound allows.
    """
    spark = texts.sparkSession
    taught = taught.select(
        "doc_id", F.xxhash64("doc_id").alias("key"), F.col("label").cast("int").alias("label")
    )
    # Labels grow with the corpus: the same join at every size, never a broadcast.
    counts = texts.join(taught.hint("merge"), "doc_id").select("text", "label")
    counted = counts.mapInArrow(_count, "bucket int, clean long, toxic long")
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    sums = counted.groupBy("bucket").agg(F.sum("clean"), F.sum("toxic"))
    for bucket, c, t in sums.collect():  # at most one row per bucket
        clean[bucket], toxic[bucket] = c, t
    ratios = log_ratios(toxic, clean, least_ratio)
    shared = spark.sparkContext.broadcast(ratios)

    filled = clean.sum() + toxic.sum()
    share = min(1.0, max_sample / max(1, taught.count()), max_buckets / max(1.0, filled))
    limit = int(share * 2**62)
    drawn = taught.where(F.shiftrightunsigned("key", 2) <= F.lit(limit))
    told = texts.join(F.broadcast(drawn), "doc_id").select("text", "key", "label")
    told = told.mapInArrow(_telling(shared), "key long, label int, found binary")
    # Rows that repeat an id count once, which also keeps the sample within its bound.
    sample = told.groupBy("key", "label").agg(F.max("found").alias("found"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, samples = shared.value, []
        for batch in batches:
            samples += zip(*(batch.column(i).to_pylist() for i in range(3)))
        found = [(label, np.frombuffer(b, dtype=np.int32)) for _, label, b in sorted(samples)]
        weights, offset = train(found, own, rounds, decay)
        parameters = np.append(weights * own, offset)
        yield pa.RecordBatch.from_arrays([pa.array([parameters.tobytes()])], ["parameters"])

    # One row of a fixed size.
    learned = sample.coalesce(1).mapInArrow(learn, "parameters binary").collect()
    parameters = (
        np.frombuffer(learned[0][0], dtype=float) if learned else np.append(np.zeros(BUCKETS), -0.7)
    )
    return Model(parameters[:-1], ratios**2, float(parameters[-1]))


def scorer(spark, model: Model):
    """A function from a text column to its score; the model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own, seen = shared.value, np.zeros(BUCKETS, dtype=bool)
        return pa.array((own.score(buckets_of(t.as_py(), seen)) for t in texts), type=pa.float64())

    return score


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: the checksum of its id as text, modulo folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    ``labels`` has the id and ``toxic``; labels of held-out documents, null ones and ids that are
    null teach nothing, and of several labels of one id the highest counts. Null and empty texts
    get the score of a text without n-grams; without any labels that is the same for all and below
    one half. Repeated rows are scored alike. Other columns of ``docs`` are ignored.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    taught = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("toxic").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    # Held-out texts would find no label, so they need not move.
    model = fit(texts.where(~held_out(F.col("doc_id"))), taught, **options)
    score = scorer(docs.sparkSession, model)
    scored = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
