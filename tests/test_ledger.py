import uuid

import pytest
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.operators import export as X
from shelfloom.operators import merge as M
from shelfloom.sources.ledger import Ledger, store_bucketed
from shelfloom.sources.reply_stream import load_new_replies


@pytest.fixture
def ledger(spark):
    made = Ledger(spark, f"t{uuid.uuid4().hex}", buckets=4, slices=6)
    made.create(M.init_output(spark.range(300).select(F.col("id").cast("string"))))
    yield made
    made.drop()


def results(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, raw string")


def files(ledger):
    rows = ledger.spark.table(ledger.base_name).select(F.input_file_name().alias("f"), "slice").distinct().collect()
    return {r["f"]: r["slice"] for r in rows}


def test_compaction_rewrites_only_the_slices_with_changes(spark, ledger):
    before, touched = files(ledger), [str(i) for i in range(3)]
    slices = spark.createDataFrame([(i,) for i in touched], "id string").select(ledger.slice_of()).distinct()
    slices = sorted(r[0] for r in slices.collect())
    assert len(slices) < 6
    ledger.append({"titles": results(spark, [(i, "new", "r") for i in touched])}, "one")
    assert files(ledger) == before  # a merge writes to the log alone
    assert ledger.compact(share=0.0) == slices
    after = files(ledger)
    assert {f for f in before if before[f] not in slices} == {f for f in after if after[f] not in slices}
    assert not {f for f in before if before[f] in slices} & set(after)
    assert ledger.loads() == {} and ledger.read().where("title = 'new' AND tries = 1").count() == 3


def test_slices_below_the_share_wait(spark, ledger):
    ledger.append({"titles": results(spark, [("1", "a", "r")])}, "one")
    assert ledger.compact(share=0.5) == [] and list(ledger.loads()) == ["one"]
    assert [r["title"] for r in ledger.read().where("id = '1'").collect()] == ["a"]


def test_order_of_loads_tries_nulls_and_new_ids(spark, ledger):
    ledger.append({"titles": results(spark, [("1", "a", "r1"), ("x", None, None), (None, "lost", "r"), ("1", "b", "r2")])}, "one")
    ledger.compact(share=0.0)
    ledger.append({"titles": results(spark, [("1", None, "r3")]), "highlights": results(spark, [("1", "h", "r4")])}, "two")
    assert not ledger.append({"titles": results(spark, [("1", "again", "r9")])}, "two")
    for _ in range(2):
        rows = {r["id"]: r for r in ledger.read().where("tries > 0").collect()}
        assert set(rows) == {"1", "x"} and ledger.read().count() == 301
        one = rows["1"]
        assert (one["title"], one["raw_response_title"], one["highlights"], one["tries"]) == ("a", "r3", "h", 3)
        assert (rows["x"]["title"], rows["x"]["tries"], rows["x"]["raw_response_title"]) == (None, 1, "")
        ledger.compact(share=0.0)
    assert ledger.append({"titles": results(spark, [("1", "late", "r5")])}, "three")
    assert [r["title"] for r in ledger.read().where("id = '1'").collect()] == ["late"]


def test_a_load_counts_a_try_even_if_it_says_the_same_again(spark, ledger):
    for load in ("one", "two"):
        ledger.append({"titles": results(spark, [("5", None, "no answer")])}, load)
    assert [r["tries"] for r in ledger.read().where("id = '5'").collect()] == [2]


def test_names_of_loads(spark, ledger):
    with pytest.raises(ValueError):
        ledger.append({"titles": results(spark, [])}, "it's one")


def test_rows_without_id_and_repeated_ids_stay(spark):
    rows = spark.createDataFrame([(None,), (None,), ("1",), ("1",)], "id string")
    made = Ledger(spark, f"t{uuid.uuid4().hex}", buckets=2, slices=2).create(M.init_output(rows))
    made.append({"titles": results(spark, [("1", "a", "r")])}, "one")
    made.compact(share=0.0)
    assert sorted((r["id"] or "", r["title"] or "") for r in made.read().collect()) == [("", ""), ("", ""), ("1", "a"), ("1", "a")]
    made.drop()


def moves(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_meet_without_an_exchange(spark, ledger):
    feed = spark.range(300).select(F.col("id").cast("string"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    name = f"t{uuid.uuid4().hex}"
    stored = store_bucketed(feed, name, 4)
    base = spark.table(ledger.base_name).select(*[f.name for f in S.OUTPUT.fields])
    assert not moves(X.full_feed(stored, base.hint("merge")))
    assert not moves(ledger.read())
    assert moves(X.full_feed(feed, base.hint("merge")))
    spark.sql(f"DROP TABLE {name}")


def test_every_reply_file_is_merged_once(spark, ledger, tmp_path):
    line = '{"id":"%d","response":{"candidates":[{"content":{"parts":[{"text":"generated title: %s"}]}}]}}\n'
    folder, checkpoint = tmp_path / "replies", str(tmp_path / "checkpoint")
    (folder / "run1").mkdir(parents=True)
    (folder / "run1" / "a.jsonl").write_text(line % (1, "one") + "\nno reply\n" + line % (2, "two"))
    (folder / "run1" / "notes.txt").write_text(line % (9, "not a reply"))
    assert load_new_replies(ledger, str(folder), "titles", checkpoint) == 1
    assert load_new_replies(ledger, str(folder), "titles", checkpoint) == 0
    (folder / "deep" / "run2").mkdir(parents=True)
    (folder / "deep" / "run2" / "b.jsonl").write_text(line % (1, "again"))
    (folder / "deep" / "run2" / "part-00000").write_text(line % (3, "three"))
    assert load_new_replies(ledger, str(folder), "titles", checkpoint, files_per_batch=1) == 2
    rows = {r["id"]: (r["title"], r["tries"]) for r in ledger.read().where("tries > 0").collect()}
    assert rows == {"1": ("again", 2), "2": ("two", 1), "3": ("three", 1)}
    # A batch that runs again under its number is one load.
    assert not ledger.append({"titles": results(spark, [("1", "x", "y")])}, "titles-000000000")
