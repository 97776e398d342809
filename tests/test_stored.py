import os
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfloom import session
from shelfloom.functions.sql import register_table_functions
from shelfloom.operators import export as X
from shelfloom.operators import sketches as K
from shelfloom.operators import variants as V
from shelfloom.operators.numbering import chunk, gather_chunks
from shelfloom.functions.text import part_of

RECORDS = "id string, original_input string, gap_attributes string, title_generated string, description_generated string, approval boolean"


def records(spark):
    rows = [
        ("1", '{"size":"S","it\'s":"a"}', '{"size":"M","it\'s":"x","say \\"hi\\"":"y"}', "t1", "d1", True),
        ("2", "", '{"number":4,"size":"L"}', "t2", None, True),
        ("3", "no json", "", "t3", "d3", True),
        ("4", None, None, "t4", "d4", True),
        ("5", "{}", '{"hidden":"z"}', "t5", "d5", False),
        ("6", "[1]", '["a"]', "t6", "d6", True),
    ]
    return spark.createDataFrame(rows, RECORDS)


def test_variants_give_the_columns_and_values_of_the_text_form(spark):
    stored = V.store_variants(records(spark))
    assert dict(stored.dtypes)["gap_attributes"] == "variant"
    feed = V.approved_variants(stored).drop("modified")
    # Columns of the input first, then by first row and name.
    assert feed.columns == ["Item ID", "Title", "Description", "it's", "size", 'new-say "hi"', "new-number"]
    rows = {r["Item ID"]: r.asDict() for r in feed.collect()}
    assert rows["1"]["size"] == "M" and rows["1"]["it's"] == "x" and rows["1"]['new-say "hi"'] == "y"
    assert rows["2"]["new-number"] == "4" and rows["3"]["size"] == rows["4"]["size"] == rows["6"]["size"] == ""
    readable = records(spark).where("id <> '6'")
    plain = {r["Item ID"]: r.asDict() for r in X.approved_feed(readable).drop("modified").collect()}
    assert {i: r for i, r in rows.items() if i != "6"} == plain


def test_variants_as_rows(spark):
    found = sorted(tuple(r) for r in V.variants_long(V.with_variants(records(spark))).collect())
    assert found == [("1", "it's", "x"), ("1", 'say "hi"', "y"), ("1", "size", "M"), ("2", "number", "4"), ("2", "size", "L")]


def test_too_many_attributes_and_paths(spark):
    with pytest.raises(ValueError):
        V.approved_variants(V.with_variants(records(spark)), max_columns=2)
    with pytest.raises(ValueError):
        V.path_to("'\"")


def test_table_functions(spark):
    register_table_functions(spark)

    def called(function, reply, ids=None):
        rows = spark.createDataFrame([(reply, ids)], "reply string, ids array<string>")
        arguments = "reply, ids" if ids is not None else "reply"
        found = spark.sql(f"SELECT f.* FROM {{rows}}, LATERAL {function}({arguments}) f ORDER BY position", rows=rows)
        return [tuple(r) for r in found.collect()]

    blocks = "id: 7\nGenerated Title: One\n\nnoise\nid: 8\nx\ngenerated title: Two: more\nid: 9"
    assert called("title_blocks", blocks) == [(0, "7", "One"), (1, "8", "Two: more")]
    assert called("title_blocks", None) == [] and called("title_blocks", "nothing") == []
    text = "id: 7\ngenerated description: a\nb\nscore: 4\n"
    assert called("description_blocks", text) == [(0, "7", "a\nb")]
    assert called("reply_answers", "1: a\n2\n3: b: c", ["9"]) == [(0, "1", "a"), (1, "2", None), (2, "3", "b: c")]
    assert called("reply_answers", None, ["9", "8"]) == [(0, "9", None), (1, "8", None)]


def test_a_bucket_with_half_of_all_rows_spreads_and_keeps_its_chunks(spark):
    # Ids of one bucket, beside as many of all others.
    ids = spark.range(4000).select(F.col("id").cast("string"))
    heavy = ids.where(part_of(F.col("id"), 8) == 3)
    rows = heavy.unionByName(ids.where(part_of(F.col("id"), 8) != 3).limit(heavy.count()))
    rows = rows.withColumn("properties", F.col("id"))
    chunks = lambda spread: sorted(
        (r["chunk_id"], r["ids"]) for r in gather_chunks(chunk(rows, 7, 8, spread=spread)).collect()
    )
    assert chunks(True) == chunks(False)
    placed = chunk(rows, 7, 8, spread=True).where("_bucket = 3").select(F.spark_partition_id().alias("p"))
    assert placed.distinct().count() > 1
    assert "Window" not in chunk(rows, 7, 8, spread=True)._jdf.queryExecution().optimizedPlan().toString().replace("Window [sum(count", "")


def test_sketches_of_halves_merge_within_the_stated_error(spark):
    draw = random.Random(3)
    values = [draw.lognormvariate(0, 2) for _ in range(60_000)]
    feed = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)], "id long, metric double, half int")
    feed = feed.unionByName(spark.createDataFrame([(-1, None, 0)], feed.schema))
    sketches = session.materialise(K.metric_sketches(feed, "metric", ["half"], size=400), "sketches")
    both = K.merged(sketches)
    assert both.first()["rows"] == 60_000
    for share in (0.01, 0.5, 0.9, 0.99):
        value = both.select(K.quantile(share)).first()[0]
        rank = sum(v <= value for v in values) / len(values)
        assert abs(rank - share) <= K.rank_error(400)
    ordered, least = sorted(values), min(values)

    def within(rank):
        most = ordered[min(len(ordered), int(rank * len(ordered))) - 1]
        low, high = least + 0.1 * (most - least), least + 0.9 * (most - least)
        return sum(low <= v <= high for v in values)

    counts = [within(0.99 + k * K.rank_error(400) / 20) for k in range(-20, 21)]
    assert min(counts) <= K.sketched_band(feed, "metric", sketches).count() <= max(counts)


def test_what_a_run_writes_goes_with_it(spark):
    with session.run(spark, "job") as folder:
        kept = session.materialise(spark.range(5), "inside")
        assert kept.count() == 5
        place = folder.removeprefix("file:")
        assert len(os.listdir(place)) >= 2  # the rows and the owner
    assert not os.path.exists(place)
    outside = session.materialise(spark.range(5), "outside")
    assert outside.count() == 5


def test_a_run_that_fails_leaves_nothing(spark):
    with pytest.raises(ZeroDivisionError), session.run(spark, "failing") as folder:
        session.materialise(spark.range(5), "inside")
        1 / 0
    assert not os.path.exists(folder.removeprefix("file:"))


def test_sweeping_takes_abandoned_runs_and_no_live_one(spark):
    root = session.shared_folder(spark) + "/runs"
    old = f"{root}/dead-1"
    session.touch(spark, old)
    os.utime(f"{old.removeprefix('file:')}/_owner", (1, 1))
    fresh = f"{root}/other-2"
    session.touch(spark, fresh)
    with session.run(spark, "mine") as mine:
        os.utime(f"{mine.removeprefix('file:')}/_owner", (1, 1))
        gone = session.sweep(spark, idle_seconds=3600)
        assert [g.rpartition("/")[2] for g in gone] == ["dead-1"]
        assert os.path.exists(mine.removeprefix("file:"))
    assert os.path.exists(fresh.removeprefix("file:"))
    assert session.sweep(spark, idle_seconds=-1) and not os.path.exists(fresh.removeprefix("file:"))


def test_a_bucket_numbered_in_pieces_is_gathered_by_many_tasks(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("{}").alias("properties"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    # As with rows that are too large for a broadcast.
    spark.conf.set(limit, "-1")
    try:
        gathered = gather_chunks(chunk(rows, 10, 2, spread=True))
        plan = gathered._jdf.queryExecution().executedPlan().toString()
        # Chunks meet by bucket and number, not a whole bucket in one task.
        assert re.search(r"hashpartitioning\(_bucket#\d+L?, chunk_id#", plan), plan
        assert gathered.selectExpr("sum(size(ids))").first()[0] == 300
    finally:
        spark.conf.set(limit, before)
