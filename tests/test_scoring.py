"""Worked title-score cases and the record built from them."""

import json

import pytest
from pyspark.sql import functions as F

from shelfloom.generator import ColumnGenerator
from shelfloom.operators.scoring import Scoring, title_metrics, title_parts, with_item
from shelfloom.plans.optimise import optimise

TITLE = "2XU Men's Swim Compression Long Sleeve Top"
BASE = {
    "id": "1",
    "title": TITLE,
    "description": "2XU top, lightweight, breathable PWX fabric, UPF 50+ in Black",
    "Brand": "2XU",
    "Gender": "Men's",
    "Category": "Swim",
    "Size": "M",
    "Color": "Black",
}
ORIGINAL = "Brand | Gender | Category | Kind"


def reply(keys, values, original=ORIGINAL, replaced=None, title="t", category="Swim"):
    lines = [
        f"product attribute keys in original title: {original}",
        f"product category: {category}",
        f"product attribute keys: {keys}",
        f"product attribute values: {values}",
    ]
    if replaced is not None:
        lines.append(f"replaced keys: {replaced}")
    return "\n".join([*lines, f"generated title: {title}"])


def scored(spark, item, text, settings=Scoring()):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in item.items()])
    items = with_item(rows, settings).withColumn("title_reply", F.lit(text))
    return title_metrics(title_parts(items, settings), settings).first()


KIND = "Compression Long Sleeve Top"


@pytest.mark.parametrize(
    "change, keys, values, score",
    [
        # New words that the feed does not know.
        ({}, "Brand|Gender|Category|Kind|Extra", f"2XU|Men's|Swim|{KIND}|UV Protection", -1.0),
        # Lost words.
        ({}, "Brand|Gender|Category|Kind|Size", "2XU|Men's|Swim|Compression Top|M", -0.5),
        # An attribute was added.
        ({}, "Brand|Gender|Category|Kind|Size", f"2XU|Men's|Swim|{KIND}|M", 0.5),
        # An attribute was added and a gap filled.
        ({"Color": ""}, "Brand|Gender|Category|Kind|Color", f"2XU|Men's|Swim|{KIND}|Black", 1.0),
        # Nothing changed.
        ({}, "Brand|Gender|Category|Kind", f"2XU|Men's|Swim|{KIND}", 0.0),
    ],
)
def test_worked_title_scores(spark, change, keys, values, score):
    assert scored(spark, {**BASE, **change}, reply(keys, values))["title_score"] == score


def test_gap_needs_a_known_word_or_an_allowed_one(spark):
    item = {**BASE, "Color": "", "description": "plain"}
    text = reply("Brand|Gender|Category|Kind|Color", f"2XU|Men's|Swim|{KIND}|Black")
    assert scored(spark, item, text)["title_score"] == -1.0
    assert scored(spark, item, text, Scoring(allowed_words=("BLACK",)))["title_score"] == 1.0


def test_features_bring_their_words(spark):
    text = reply("Brand|Gender|Category|Kind|Image Features", f"2XU|Men's|Swim|{KIND}|glossy hem")
    found = scored(spark, BASE, text)
    assert found["new_words"] == [] and found["title_score"] == 1.0
    assert found["gaps"] == {"Image Features": "glossy hem"}


def test_values_that_repeat_their_key_are_dropped(spark):
    found = scored(spark, BASE, reply("Brand|Finish|Weight|Kind", f"2XU|finish|Weight ,|{KIND}"))
    assert found["title_keys"] == ["Brand", "Kind"]
    assert found["title_generated"] == f"2XU {KIND}"


def test_generated_values_can_be_preferred(spark):
    text = reply("Brand|Size|Kind", "Two XU|Size M|x")
    assert scored(spark, BASE, text)["title_generated"] == "2XU M x"
    preferred = scored(spark, BASE, text, Scoring(prefer_generated_values=True))
    assert preferred["title_generated"] == "Two XU Size M x"
    model = scored(spark, BASE, reply("Brand", "2XU", title=" Model's own "), Scoring(use_model_titles=True))
    assert model["title_generated"] == "Model's own"


def test_gaps_of_the_original_title_count_only_for_columns(spark):
    item = {**BASE, "Color": ""}
    text = reply("Color|Kind|Shape", "Black,|Top|Round", original="Color|Kind")
    assert scored(spark, item, text)["gaps"] == {"Color": "Black", "Shape": "Round"}


def test_replaced_keys_override_known_values(spark):
    text = reply("Color|Brand|Color", "Red|2XU|Blue", replaced="COLOR")
    assert scored(spark, BASE, text)["gaps"] == {"Color": "Blue"}
    assert scored(spark, BASE, reply("Color", "Red", replaced="none"))["gaps"] == {}


def test_trailing_comma_of_the_title_goes(spark):
    assert scored(spark, BASE, reply("Brand|Kind", "2XU|Top,"))["title_generated"] == "2XU Top"


def test_records_and_failure_rows(spark):
    rows = spark.createDataFrame(
        [("1", "red top", "old text", "S"), ("2", "blue top", "x", "M"), ("3", "top", "y" * 3, "L")],
        "id string, title string, description string, size string",
    )
    title = F.when(F.col("id") == "2", "no title").otherwise(
        F.concat(
            F.lit("product attribute keys in original title: kind\nproduct category: c\n"),
            F.lit("product attribute keys: kind | size\nproduct attribute values: "),
            F.col("item")["title"], F.lit(" | M\ngenerated title: z"),
        )
    )
    body = F.when(F.col("id") == "3", F.repeat(F.lit("long"), 2000)).otherwise("new text")
    text = F.concat(F.lit("description: "), body, F.lit("\nscore: 4\nreasoning: good"))
    settings = Scoring(min_title_score=0.5, min_description_score=4)
    found = {
        r["id"]: r
        for r in optimise(
            rows, ColumnGenerator(lambda: title), ColumnGenerator(lambda: text), settings
        ).collect()
    }
    good, failed, long = found["1"], found["2"], found["3"]
    assert len(good) == 23 and good["approval"] and good["status"] == "Success"
    assert good["score"] == "0.5" and good["title_generated"] == "red top S"
    assert good["description_changed"] and good["description_length"] == "8"
    assert good["full_response"].endswith("Description evaluation: Score: 4\ngood")
    assert json.loads(good["original_input"])["size"] == "S"
    assert failed["status"].startswith("Failed.") and failed["approval"] is None
    assert failed["full_response"] == "Incomplete title reply: no title"
    assert long["status"] == "Failed compliance checks" and long["score"] == "-1"
    assert long["approval"] is False


def test_rows_with_a_finished_result_are_left_out(spark):
    rows = spark.createDataFrame([("1", "a", "b"), ("2", "a", "b"), ("3", "a", "b")],
                                 "id string, title string, description string")
    before = spark.createDataFrame([(1, "Success"), (2, "Failed. See response.")], "id int, status string")
    off = Scoring(titles=False, descriptions=False)
    none = ColumnGenerator(lambda: F.lit(None))
    found = optimise(rows, none, none, off, generated=before).collect()
    assert sorted(r["id"] for r in found) == ["2", "3"]


def test_rows_are_dealt_once_and_texts_are_written_within_the_item(spark, monkeypatch):
    from shelfloom.operators import export as X
    from shelfloom.plans import optimise as O
    from shelfloom.workload.stub import marked_description_reply, marked_title_reply

    written, plain = [], O.materialise
    monkeypatch.setattr(O, "materialise", lambda df, label: written.append((label, df)) or plain(df, label))
    rows = spark.createDataFrame(
        [("1", "red top", None, "b", "SMALL", "S", ""), ("2", "big hat", "text", "b", "LARGE", "M", "red")],
        "id string, title string, description string, brand string, category string, size string, color string",
    )
    made = [ColumnGenerator(marked_title_reply), ColumnGenerator(marked_description_reply)]
    records = optimise(rows, *made, tasks=4)
    assert [label for label, _ in written] == ["titles", "descriptions"]
    assert not any(c.endswith("_original") for _, df in written for c in df.columns)
    # The rows are dealt before the first step, and read from its files afterwards.
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for _, df in written]
    plans.append(records._jdf.queryExecution().optimizedPlan().toString())
    assert ["Repartition" in p for p in plans] == [True, False, False]
    found = {r["id"]: r for r in records.collect()}
    assert found["2"]["title_original"] == "big hat" and found["2"]["description_original"] == "text"
    # Derived attributes are written before they are filtered.
    stored = []
    monkeypatch.setattr(X, "materialise", lambda df, label: stored.append(df.columns) or plain(df, label))
    X.approved_long(records).collect()
    X.attribute_keys(records).collect()
    assert stored == [["id", "approval", "gap_attributes"], ["_at", "original_input", "gap_attributes"]]
