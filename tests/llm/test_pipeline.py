"""The pipeline on a small corpus against plain Python, stage by stage."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import mixing, pieces, quality
from tests.llm.common import ascii_lower, documents, found
from tests.llm.test_jaccard import by_hand as near_by_hand

GOOD = [f"word{i}" for i in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, shouting ones, exact copies in other case and near copies."""
    draw = random.Random(5)
    texts, labels = [], []
    for i in range(0, 600, 4):
        base = [draw.choice(GOOD) for _ in range(draw.randint(40, 90))]
        near = list(base)
        near[3] = "changed"
        poor = [base[0].upper() + "!!"] * 40
        texts += [(i, " ".join(base)), (i + 1, " ".join(base).title()), (i + 2, " ".join(near)), (i + 3, " ".join(poor))]
        labels += [(i, 1, 0), (i + 2, 1, 0), (i + 3, 0, 0)]
    texts += [(700, ""), (701, None)]
    path = tmp_path_factory.mktemp("corpus")
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_order_and_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.schema, dict(found(docs, "doc_id", "text"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema == columns
        docs = spark.createDataFrame(docs.collect(), columns)
        kept.append(sorted(r[0] for r in found(docs, "doc_id")))
    good, single, far, mixed = kept
    judged = quality.score_quality(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    )
    assert good == sorted(r[0] for r in found(judged.where("kept"), "doc_id"))
    clean = {i for i, t in texts.items() if t and "!!" not in t}
    assert clean <= set(good) and not any("!!" in (texts[i] or "") for i in good)
    largest = {}
    for i in good:
        key = ascii_lower(texts[i])
        largest[key] = max(i, largest.get(key, i))
    assert single == sorted(largest.values())
    near = near_by_hand([(i, texts[i]) for i in single], 5, 80)
    assert far == sorted(i for i, _, root in near if i == root)
    rest = documents(spark, [(i, texts[i]) for i in far])
    times = Counter()
    for i, size, taken in found(mixing.mix_report(rest), "doc_id", "size", "taken"):
        times[i] = taken // size if size else mixed.count(i)
    assert Counter(mixed) == +times


def test_run_gives_what_the_stages_give(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "n_pieces", "lossless", "pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    decoder = pieces.Decoder(pieces.load_vocabulary().texts)
    import pyarrow as pa

    texts = dict(found(docs, "doc_id", "text"))
    result = rows.collect()
    assert result and all(r.lossless for r in result)
    lists = pa.array([r.pieces for r in result], type=pa.list_(pa.int32()))
    assert decoder.decode(lists).to_pylist() == [texts[r.doc_id] or "" for r in result]


def test_stages_take_an_empty_table(spark, folder):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_take_nulls_long_and_repeated_rows_and_extra_columns(spark, folder):
    draw = random.Random(9)
    texts = [(i, " ".join(draw.choice(GOOD) for _ in range(50))) for i in range(40)]
    texts += texts[:5] + [(None, None), (50, None), (51, ""), (None, texts[7][1]), (52, " ".join(draw.choice(GOOD) for _ in range(40_000)))]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    docs = docs.withColumns({n: F.lit("x") for n in ("_row", "_id", "kept", "node", "size", "target", "pieces", "component_id")})
    columns = docs.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema == columns
        docs = spark.createDataFrame(docs.collect(), columns)
        ids = Counter(r[0] for r in found(docs, "doc_id"))
        assert ids[52] >= 1 and docs.where("_row = 'x' AND pieces = 'x'").count() == docs.count()
    result = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(result) == docs.count() and all(r.lossless for r in result)
