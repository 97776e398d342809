"""Passes, batches and merges on small tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.generator import CallGenerator, ColumnGenerator
from shelfloom.operators import merge as M
from shelfloom.operators.examples import example_blocks, examples_by_metric, literal_examples
from shelfloom.plans import generation as G
from shelfloom.sources import records
from shelfloom.workload.stub import stub_generator


def feed(spark, n, copies=()):
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"))
    for item, times in copies:
        rows = rows.union(spark.range(times).select(F.lit(item).alias("id")))
    return rows.select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit("d").alias("description"))


def examples(spark):
    return literal_examples(spark, [("e", '{"a":1}', "Good", "Better")])


def run(spark, rows, output=None, generator=None, ids=None, **settings):
    output = M.init_output(rows.select("id").distinct()) if output is None else output
    passes = G.Passes(**{"buckets": 4, **settings})
    made = generator or stub_generator(passes.target.column, passes.layout)
    return G.generate(output, rows, examples(spark), made, passes, ids)


def failing():
    return ColumnGenerator(lambda: F.lit(None))


def test_every_row_is_done_or_out_of_tries(spark):
    done = run(spark, feed(spark, 300)).collect()
    assert len(done) == 300
    assert all((r["title"] is None) == (r["tries"] == 3) or r["title"] for r in done)
    # The text, then the mark of the prompt that the stand-in read.
    titles = {r["id"]: r["title"] for r in done if r["title"]}
    assert all(re.fullmatch(rf"Item {i}, new title #[0-9a-f]{{8}}", t) for i, t in titles.items())
    assert {r["tries"] for r in done} >= {1, 2}


def test_a_dead_model_costs_exactly_three_tries(spark):
    done = run(spark, feed(spark, 40), generator=failing()).collect()
    assert {(r["title"], r["tries"]) for r in done} == {(None, 3)}


@pytest.mark.parametrize("layout", ["lines", "blocks", "single"])
def test_small_batches_reach_the_same_end(spark, layout):
    rows = feed(spark, 23)
    done = run(spark, rows, batch_rows=10, layout=layout, items_per_prompt=3).collect()
    assert len(done) == 23 and all(r["title"] or r["tries"] == 3 for r in done)


def test_passes_of_a_drawn_order_write_each_row_once_a_round(spark, monkeypatch):
    written, plain = [], G.materialise_counted

    def counted(df, label, counts, by=None):
        state, seen = plain(df, label, counts | {"n": F.count(F.lit(1))}, by)
        written.append(seen["n"])
        return state, seen

    monkeypatch.setattr(G, "materialise_counted", counted)
    done = run(spark, feed(spark, 60), batch_rows=7, layout="single").collect()
    assert len(done) == 60 and all(r["title"] or r["tries"] == 3 for r in done)
    failed = sum(1 for r in done if r["tries"] == 3)
    # The start, one row written per row asked, and those that fail once more in either further round.
    assert sum(written) == 60 + 60 + 2 * failed and max(written[1:]) <= 7


def test_several_passes_go_through_one_job(spark, monkeypatch):
    calls, plain = [], G.materialise_counted

    def counted(df, label, counts, by=None):
        state, seen = plain(df, label, counts | {"n": F.count(F.lit(1))}, by)
        calls.append(seen["n"])
        return state, seen

    monkeypatch.setattr(G, "materialise_counted", counted)
    rows, results = feed(spark, 60), []
    for at_once in (1, 4):
        done = run(spark, rows, batch_rows=7, at_once=at_once, layout="single").collect()
        results.append(sorted((r["id"], r["title"] or "", r["tries"]) for r in done))
        if at_once == 1:
            assert calls[1:10] == [7] * 8 + [4]
            calls.clear()
    assert results[0] == results[1] and calls[1:4] == [28, 28, 4]
    with pytest.raises(ValueError, match="one item per prompt"):
        G.Passes(batch_rows=7, at_once=4)


def test_a_union_of_many_tables_stays_shallow(spark):
    one = spark.range(1)
    many = G._together([one] * 200)
    assert many.count() == 200 and G._together([one]) is one


def test_counting_active_rows_takes_no_job(spark, monkeypatch):
    def jobs(name):
        spark.sparkContext.setJobGroup(name, name)
        run(spark, feed(spark, 20), generator=failing())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    plain, splits = G._split, []

    def asking(rows, columns):
        state, _ = plain(rows, columns)
        splits.append(1)
        return state, int(not state.where("_active").isEmpty())

    new = jobs("observed")
    monkeypatch.setattr(G, "_split", asking)
    assert new + len(splits) <= jobs("asked") and len(splits) == 4


def test_answers_meet_rows_without_their_texts(spark, monkeypatch):
    plain, seen, results = G._split, [], []

    def watched(rows, columns):
        seen.append("properties" in rows.columns)
        return plain(rows, columns)

    monkeypatch.setattr(G, "_split", watched)
    # Ids are sent to the texts up to a limit, and shuffled beyond it.
    for most in (1_000_000, 0):
        monkeypatch.setattr(G, "_SENT_IDS", most)
        done = run(spark, feed(spark, 20), generator=failing()).collect()
        results.append(sorted((r["id"], r["title"] or "", r["tries"]) for r in done))
        assert seen[0] and not any(seen[1:]) and len(seen) > 2
        seen.clear()
    assert results[0] == results[1]


def test_examples_move_the_texts_of_their_own_rows_alone(spark):
    items = spark.range(100).select("id", (F.col("id") % 7).alias("clicks"))
    texts = spark.range(100).select("id", F.concat(F.lit("text "), F.col("id")).alias("title"))
    raw = items.join(texts, "id", "left").select(F.col("id").cast("string").alias("id"), "clicks", "title")
    best = examples_by_metric(raw.withColumn("description", F.col("title")), "clicks", ["title"], 3)
    # The ids are named on both sides of the join.
    assert best._jdf.queryExecution().optimizedPlan().toString().count("IN (13,20,27)") >= 2
    assert [r["id"] for r in best.collect()] == ["13", "20", "27"]
    unnamed = spark.createDataFrame([(None, 9, "a", "b"), ("1", 5, "c", "d")], "id string, n int, title string, description string")
    assert [r["id"] for r in examples_by_metric(unnamed, "n", ["title"], 2).collect()] == [None, "1"]


def test_repeated_items_are_asked_once_in_batches(spark):
    rows = feed(spark, 20, copies=[("7", 40)])
    done = run(spark, rows, M.init_output(rows.select("id")), batch_rows=6).collect()
    assert len(done) == rows.count()
    assert len({(r["title"], r["tries"]) for r in done if r["id"] == "7"}) == 1


def test_progress_is_counted_by_the_write(spark, tmp_path):
    output = run(spark, feed(spark, 30))
    path, counts = M.save_with_progress(output, str(tmp_path))
    assert counts == spark.read.parquet(path).transform(M.progress).first().asDict()
    assert counts["total"] == 30 and counts["descriptions"] == 0


def test_rows_without_input_are_left_alone(spark):
    rows = feed(spark, 5)
    output = M.init_output(rows.select("id").union(spark.range(50, 52).select(F.col("id").cast("string"))))
    done = {r["id"]: r for r in run(spark, rows, output).collect()}
    assert len(done) == 7 and done["50"]["tries"] == 0


def test_a_heavily_repeated_item_is_asked_once(spark):
    rows = feed(spark, 20, copies=[("7", 400)])
    output = M.init_output(rows.select("id").distinct())
    done = run(spark, rows, output).collect()
    assert len(done) == 20 and len({r["id"] for r in done}) == 20
    # An output table that itself repeats an id keeps all its rows.
    repeated = M.init_output(rows.select("id"))
    done = run(spark, rows, repeated).collect()
    assert len(done) == 420
    assert len({(r["title"], r["tries"]) for r in done if r["id"] == "7"}) == 1


def test_explicit_ids_take_one_pass_and_ignore_tries(spark):
    rows = feed(spark, 30)
    output = M.init_output(rows).withColumn("tries", F.lit(3).cast("long")).withColumn("title", F.lit("old"))
    ids = spark.range(5).select(F.col("id").cast("string"))
    done = {r["id"]: r for r in run(spark, rows, output, ids=ids, layout="single").collect()}
    assert len(done) == 30
    assert all(done[str(i)]["tries"] == 4 for i in range(5))
    assert all(done[str(i)]["title"] == "old" and done[str(i)]["tries"] == 3 for i in range(5, 30))


def test_tries_are_shared_by_default_and_separate_on_request(spark):
    rows = feed(spark, 12)
    spent = run(spark, rows, target=S.DESCRIPTIONS, generator=failing())
    shared = run(spark, rows, spent).collect()
    assert {(r["title"], r["tries"]) for r in shared} == {(None, 3)}
    apart = run(spark, rows, spent, per_target_tries=True).collect()
    assert any(r["title"] for r in apart) and min(r["tries"] for r in apart) == 4


def test_parts_partition_the_feed(spark):
    rows = feed(spark, 60)
    first = run(spark, rows, parts=3, part=0).where("tries > 0").select("id")
    others = [run(spark, rows, parts=3, part=p).where("tries > 0").select("id") for p in (1, 2)]
    found = [r["id"] for d in (first, *others) for r in d.collect()]
    assert sorted(found) == sorted(str(i) for i in range(60))


def test_debug_keeps_replies_and_errors(spark):
    done = run(spark, feed(spark, 60), layout="single", debug=True).collect()
    assert {r["raw_response_title"] for r in done if r["title"] is None} == {"ERROR: failed"}
    assert all("Item" in r["raw_response_title"] for r in done if r["title"])


def test_client_calls_retry_and_report(spark):
    def connect():
        tries = {}

        def ask(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            if "bad" in prompt or tries[prompt] < 2:
                raise ValueError(f"no answer to {prompt}")
            return prompt.upper()

        return ask

    rows = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    found = {r["prompt"]: r for r in CallGenerator(connect, calls=2).generate(rows).collect()}
    assert (found["a"]["reply"], found["a"]["status"]) == ("A", "")
    assert (found["bad"]["reply"], found["bad"]["status"]) == (None, "no answer to bad")


def test_calls_keep_within_a_quota_over_all_tasks(spark):
    def connect():
        import time

        def ask(prompt):
            at = time.time()
            if prompt.endswith("7"):
                raise RuntimeError(f"{at}")
            return f"{at}"

        return ask

    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("prompt"))
    paced = CallGenerator(connect, attempts=1, calls=4, in_flight=3, quota=24, window=2.0)
    found = paced.generate(rows).collect()
    times = sorted(float(r["reply"] or r["status"]) for r in found)
    assert len(times) == 40
    # Clocks of a few processes and a sleep that ends late: a hundredth of a second.
    assert max(sum(t <= x < t + 1.99 for x in times) for t in times) <= 24
    with pytest.raises(ValueError):
        CallGenerator(connect, calls=4, quota=7).generate(rows)
    with pytest.raises(ValueError):
        CallGenerator(connect, quota=7).generate(rows)


def test_examples_must_fit_a_prompt(spark):
    with pytest.raises(ValueError):
        example_blocks(examples(spark), max_bytes=5)


def test_prompts_leave_out_the_section_of_missing_examples(spark):
    rows = feed(spark, 3).withColumn("image_url", F.lit(None).cast("string")).withColumn(
        "webpage_content", F.lit("page")
    )
    none = spark.createDataFrame([], S.EXAMPLES)
    settings = G.Batch(language="French", web_done=True)
    prompts = G.batch_prompts(rows, example_blocks(none), S.TITLES, settings).collect()
    assert all("## Examples" not in r["prompt"] and "French" in r["prompt"] for r in prompts)
    some = G.batch_prompts(rows, example_blocks(examples(spark)), S.HIGHLIGHTS, settings).first()
    assert "**User:**\n{\"a\":1}\n\n**Model:**\nBetter\n\n" in some["prompt"]
    assert some["prompt"].endswith("\nwebpage_content: page\n")
    assert '"id"' not in some["prompt"].split("## Input")[1]


def test_partner_requests(spark):
    rows = feed(spark, 1).withColumns(
        {"image_url": F.lit(None).cast("string"), "webpage_content": F.lit(None).cast("string")}
    )
    settings = G.Batch(model="claude-x", targets=("titles",), extra=(("some_version", "v"),))
    line = G.batch_requests(rows, examples(spark), settings)["titles"].first()["request"]
    record = json.loads(line)
    assert record["custom_id"] == "0" and record["request"]["max_tokens"] == 1000
    assert record["request"]["messages"][0]["role"] == "user" and record["request"]["some_version"] == "v"


def write_lines(path, lines):
    path.mkdir(parents=True)
    (path / "x.jsonl").write_text("\n".join(lines) + "\n")


def test_reply_files_with_bad_lines(spark, tmp_path):
    payload = {"candidates": [{"content": {"parts": [{"text": "generated title: New"}]}}]}
    lines = [
        json.dumps({"id": "1", "response": payload}),
        "",
        "{broken",
        json.dumps({"instance": {"id": "2"}, "prediction": json.dumps(payload)}),
        json.dumps({"id": "3", "response": {}}),
        json.dumps({"response": payload}),
        json.dumps({"custom_id": 4, "response": payload}),
    ]
    write_lines(tmp_path / "replies" / "titles" / "run-1", lines)
    folder = str(tmp_path)
    replies = records.read_replies(spark, f"{folder}/replies/titles")
    assert replies.count() == 6 and records.bad_lines(replies).count() == 1
    old = M.init_output(spark.createDataFrame([("1",), ("3",), ("9",)], "id string"))
    old = old.withColumn("title", F.lit("old"))
    with pytest.raises(FileNotFoundError, match="descriptions"):
        G.load_and_merge(old, folder, ("titles", "descriptions"))
    first = G.load_and_merge(old, folder, ("titles",))
    done = {r["id"]: r for r in first.collect()}
    assert {k: (v["title"], v["tries"]) for k, v in done.items()} == {
        "1": ("New", 1), "2": ("New", 1), "3": ("old", 1), "4": ("New", 1), "9": ("old", 0),
    }
    again = {r["id"]: r["tries"] for r in G.load_and_merge(first, folder, ("titles",)).collect()}
    assert again == {k: v["tries"] for k, v in done.items()}
    strict = {r["id"]: r for r in G.load_and_merge(old, folder, ("titles",), strict=True).collect()}
    assert strict["3"]["title"] == "" and strict["9"]["title"] == "old"


def test_replies_at_any_depth_and_only_finished(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (deep / "predictions.jsonl").write_text("one\n")
    (tmp_path / "a" / "notes.txt").write_text("stray\n")
    for name, finished in (("done", True), ("half", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_text(f"{name}\n")
        if finished:
            (tmp_path / name / "_SUCCESS").write_text("")
    rows = [r.value for r in records.read_replies(spark, str(tmp_path)).collect()]
    assert sorted(rows) == ["done", "one"]
    with pytest.raises(FileNotFoundError):
        records.read_replies(spark, str(tmp_path / "half"))


def test_null_ids_stay_with_tries_of_their_own(spark):
    output = M.init_output(spark.createDataFrame([("1",), (None,), (None,)], "id string"))
    rows = spark.createDataFrame([("1", "t")], "id string, title string")
    examples = spark.createDataFrame([], "id string, properties string, title string, description string")
    passes = G.Passes(per_target_tries=True)
    done = G.generate(output, rows, examples, stub_generator("title", "lines"), passes)
    assert done.count() == 3 and done.where("id IS NULL").count() == 2


def test_snapshots_ignore_unfinished_versions(spark, tmp_path):
    root = str(tmp_path / "out")
    assert M.latest_snapshot(spark, root).count() == 0
    M.save_snapshot(M.init_output(spark.createDataFrame([("1",)], "id string")), root)
    M.save_snapshot(M.init_output(spark.createDataFrame([("1",), ("2",)], "id string")), root)
    (tmp_path / "out" / "v=000003").mkdir()
    assert M.latest_snapshot(spark, root).count() == 2


def test_newest_run_and_csv(spark, tmp_path):
    for run_name in ("run-1", "run-2"):
        (tmp_path / run_name).mkdir()
        (tmp_path / run_name / "predictions.jsonl").write_text("{}\n")
    assert "run-2" in records.newest_run(spark, str(tmp_path))
    rows = spark.createDataFrame([("1", 'a "quoted"\nline, two'), ("2", None)], "id string, text string")
    path = str(tmp_path / "feed")
    records.write_csv(rows, path)
    back = {r["id"]: r["text"] for r in records.read_csv(spark, path, breaks=True).collect()}
    assert back == {"1": 'a "quoted"\nline, two', "2": None}


def test_examples_file(spark, tmp_path):
    from shelfloom.operators.examples import clean_examples

    path = tmp_path / "ex.csv"
    path.write_text('title,properties,description\nT,"{""a"": 1}",D\nU,invalid json,E\n,,\n')
    found = clean_examples(records.read_examples(spark, str(path))).collect()
    assert [(r["properties"], r["title"], r["description"]) for r in found] == [('{"a": 1}', "T", "D")]
    path.write_text('"{""a"": 1}",T,D\n')
    assert clean_examples(records.read_examples(spark, str(path), header=False)).count() == 1


def test_sql_prompts_equal_the_column_prompts(spark):
    from shelfloom.functions.prompts import chunk_prompt
    from shelfloom.functions.sql import register_functions

    register_functions(spark)
    rows = spark.range(1).select(F.array(F.lit('{"a":"it\'s"}'), F.lit(None)).alias("p"))
    block = example_blocks(examples(spark))
    for target, name in ((S.TITLES, "titles_prompt"), (S.DESCRIPTIONS, "descriptions_prompt")):
        given = "array(named_struct('id','e','properties','{\"a\":1}','title','Good','description','Better'))"
        sql = rows.selectExpr(f"{name}('Polish', {given}, p) AS r").first()["r"]
        assert sql == rows.select(chunk_prompt(target, "Polish", block, F.col("p"))).first()[0]


def test_batch_run_from_input_to_output(spark, tmp_path):
    rows = feed(spark, 9).withColumns(
        {"image_url": F.lit("http://x/i.png"), "webpage_content": F.lit(None).cast("string")}
    )
    settings = G.Batch(targets=("titles", "highlights"), use_images=True, bucket_name="b")
    model = ColumnGenerator(lambda: F.concat(F.lit("Generated highlights: "), F.length("prompt")))
    done = G.run_batch(rows, examples(spark), model, str(tmp_path), settings).collect()
    assert len(done) == 9
    assert all(r["tries"] == 2 and r["title"].isdigit() and r["highlights"] and not r["description"] for r in done)
    lines = spark.read.text(f"{tmp_path}/requests/titles").collect()
    assert all("image_url: gs://b/images/i.png" in r["value"] for r in lines)


def test_stored_images(spark, tmp_path):
    from shelfloom.functions.envelopes import multimodal_request
    from shelfloom.operators.images import object_stats
    from shelfloom.plans.reports import describe_images, register_images

    (tmp_path / "a.jpg").write_bytes(b"x" * 100)
    (tmp_path / "b.jpg").write_bytes(b"y" * 200)
    objects = records.read_objects(spark, str(tmp_path), "*.jpg")
    assert tuple(object_stats(objects).first()) == (2, 300)
    model = ColumnGenerator(lambda: F.concat(F.lit(" seen "), "name", F.lit(" ")))
    assert {r["description"] for r in describe_images(objects, model).collect()} == {"seen a.jpg", "seen b.jpg"}
    links = spark.createDataFrame([("h/a.jpg",), ("h/c.jpg",), ("h/c.jpg",), (None,)], "image_url string")
    todo, report = register_images(links, objects)
    assert [tuple(r) for r in todo.collect()] == [("h/c.jpg", "c.jpg")]
    assert tuple(report.first()) == (2, 1, 1)
    request = objects.select(
        multimodal_request(F.lit("p"), F.lit("h/a"), F.col("content"), F.lit("image/jpeg")).alias("r")
    ).first()["r"]
    assert json.loads(request)["contents"]["parts"][1]["inlineData"]["mimeType"] == "image/jpeg"


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"))
    assert records.replace_table(rows, path).count() == 3
    assert records.replace_table(rows.limit(1), path).count() == 1
    records.clear_table(spark, path, "id string")
    assert records.read_table(spark, path, "id string").count() == 0
    # A table may be made from itself; a version that was not finished is not seen.
    records.replace_table(rows, path)
    old = records.read_table(spark, path, rows.schema)
    assert records.replace_table(old.where("id < '2'"), path).count() == 2 and old.count() == 3
    (tmp_path / "t" / "v=000099").mkdir()
    assert records.read_table(spark, path, rows.schema).count() == 2
    assert records.table_versions(spark, path) == [4, 5]
    assert records.read_table(spark, str(tmp_path / "none"), rows.schema).count() == 0
    (tmp_path / "w.txt").write_text("Write in {{LANGUAGE}}.\nNow.")
    assert records.read_wording(spark, str(tmp_path / "w.txt")) == "Write in {{LANGUAGE}}.\nNow."


def test_client_embedder(spark):
    from shelfloom.generator import CallEmbedder

    def connect():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([("1", "abc")], "id string, content string")
    assert CallEmbedder(connect).embed(rows).first()["vec"] == [3.0, 1.0]


def test_examples_preview(spark):
    from shelfloom.operators.examples import examples_preview

    total, first = examples_preview(examples(spark))
    assert total == 1 and first.first()["title"] == "Good"


@pytest.mark.parametrize("layout, wording", [("lines", "You name products"), ("single", "You keep the product data")])
def test_the_model_step_reads_the_whole_prompt(spark, layout, wording):
    rows = feed(spark, 20).select("id", F.col("title").alias("properties"), F.lit(None).cast("string").alias("image_url"))
    block = example_blocks(literal_examples(spark, [("e", "{}", "t", "d")]))
    prompts = G.build_prompts(rows, block, G.Passes(layout=layout, buckets=4))
    replied = stub_generator("title", layout).generate(prompts).select("chunk_id", "ids", "reply", "status")
    assert wording in replied._jdf.queryExecution().optimizedPlan().toString()


def test_client_gets_the_image_and_is_asked_again(spark):
    def connect():
        failed = set()

        def ask(prompt, uri):
            if prompt.endswith("3") and prompt not in failed:
                failed.add(prompt)
                raise OSError("busy")
            if prompt.endswith("7"):
                raise ValueError("never")
            return f"{prompt} with {uri}"

        return ask

    prompts = spark.range(20).select(
        F.concat(F.lit("p"), "id").alias("prompt"), F.when(F.col("id") < 10, "gs://b/x").alias("uri")
    )
    model = CallGenerator(connect, with_images=True, pause=0.001)
    rows = {r.prompt: r for r in model.generate(prompts).collect()}
    assert rows["p3"].reply == "p3 with gs://b/x" and rows["p13"].reply == "p13 with None"
    assert rows["p7"].reply is None and rows["p7"].status == "never"
    assert len(rows) == 20


def test_plain_csv_is_split_among_tasks(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("id,text\n" + "1,some text\n" * 20_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        assert records.read_csv(spark, str(tmp_path / "feed.csv")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_request_files_are_compressed_and_dealt_over_tasks(spark, tmp_path):
    import os

    from shelfloom.workload import results
    from shelfloom.workload.views import Tables

    prepared = results._batch_input(Tables(spark, "/root/testdata/sf0.001"))
    assert prepared.rdd.getNumPartitions() == results.BATCH_TASKS
    line = F.concat(F.lit("the same words in every request " * 50), F.col("id").cast("string"))
    lines = spark.range(2000).repartition(4).select(line.alias("request"))
    for compression, folder in (("gzip", "packed"), ("none", "plain")):
        G.write_requests({"titles": lines}, str(tmp_path / folder), compression)
    G.write_requests({"titles": lines}, str(tmp_path / "default"))

    def size(folder):
        place = tmp_path / folder / "requests" / "titles"
        read = spark.read.text(str(place))
        assert read.count() == 2000 and read.select("value").exceptAll(lines).isEmpty()
        return sum(os.path.getsize(place / n) for n in os.listdir(place) if n.startswith("part-"))

    assert size("default") == size("packed") < size("plain") / 20
