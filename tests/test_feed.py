"""Preparation, numbering, images, pages and exports on small tables."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfloom.functions.pages import parse_selector, select_text
from shelfloom.operators import export as X
from shelfloom.operators import numbering as N
from shelfloom.operators import prepare as P
from shelfloom.operators import quality as Q
from shelfloom.operators import images as images_module
from shelfloom.operators.images import with_image_text
from shelfloom.plans import reports
from shelfloom.plans.enrich import merge_attribute


@pytest.mark.parametrize(
    "columns, expected",
    [
        (["product_id", "product_title", "product_desc"], ("product_id", "product_title", "product_desc", "skip", "skip")),
        (["a", "b"], ("a", "b", "a", "skip", "skip")),
        (["Name", "SKU", "Summary", "page_link", "photo"], ("SKU", "Name", "Summary", "page_link", "photo")),
        ([], ("skip",) * 5),
    ],
)
def test_roles(columns, expected):
    assert tuple(P.guess_roles(columns).values()) == expected


def test_profile_and_item_lookup(spark):
    rows = spark.createDataFrame([("1", "x", None)], "id string, title string, description string")
    found = P.profile(rows)
    assert found["num_rows"] == 1 and found["preview"] == [("1", "x", "None")]
    assert P.item_json(rows, "1").first()[0] == '{"id":"1","title":"x","description":null}'


def test_projection_keeps_order_and_renames(spark):
    rows = spark.createDataFrame([(1, "t", "d", "u", "i", "b")], "c1 int, c2 string, c3 string, c4 string, c5 string, brand string")
    found = P.project_roles(rows, "c1", "c2", "c3", "skip", "c5", "brand, c2, price".replace(", price", ""), limit=1)
    assert found.columns == ["id", "title", "description", "image_url", "brand"]
    assert P.project_roles(rows, "c1", "c2", "c3", include="*").columns == rows.columns


@pytest.mark.parametrize("kind", ["unique", "hot", "few", "none"])
def test_metric_band_is_exact_and_never_gathers_the_values(spark, kind):
    draw = random.Random(11)
    metrics = {
        "unique": [draw.uniform(-50, 900) for _ in range(1501)] + [None] * 40,
        "hot": [7.0] * 900 + [float(n) for n in range(100)] + [None],
        "few": [3.0, 1.0, 2.0],
        "none": [None, None],
    }[kind]
    feed = spark.createDataFrame(list(enumerate(metrics)), "id long, `my metric` double")
    known = sorted(m for m in metrics if m is not None)
    expected = []
    if known:
        least, most = known[0], known[-(-99 * len(known) // 100) - 1]
        low, high = (least + share * (most - least) for share in (0.1, 0.9))
        expected = [i for i, m in enumerate(metrics) if m is not None and low <= m <= high]
    band = P.metric_band(feed, "my metric")
    assert sorted(r["id"] for r in band.collect()) == expected
    assert "percentile" not in band._jdf.queryExecution().toString().lower()


def test_completed_input_adds_only_what_is_missing(spark):
    rows = spark.createDataFrame([("1", "t", "d", "u")], "sku string, title string, text string, pic string")
    found = P.complete_input(rows, None, "sku", "title", "text", "pic")
    assert found.columns == ["sku", "title", "text", "pic", "id", "description", "image_url", "webpage_content"]
    assert found.first()["image_url"] == "u" and found.first()["webpage_content"] is None


def test_row_index_spreads_a_run_of_equal_keys(spark):
    """A third of the rows share one key; numbers stay exact and no task holds them all."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("x").alias("v"),
    )
    indexed = N.with_row_index(rows, ["id"])
    found = [(r["row_index"], r["id"]) for r in indexed.orderBy("row_index").collect()]
    assert [i for i, _ in found] == list(range(3000))
    assert [k for _, k in found] == sorted(k for _, k in found)
    spread = indexed.where("id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1


@pytest.mark.parametrize("buckets", [None, 7])
def test_chunks_are_whole_and_bounded(spark, buckets):
    rows = spark.range(503).select(F.col("id").cast("string").alias("id"), F.lit("{}").alias("properties"))
    chunks = N.gather_chunks(N.chunk(rows, 10, buckets)).collect()
    ids = list(itertools.chain.from_iterable(r["ids"] for r in chunks))
    assert sorted(ids) == sorted(str(i) for i in range(503))
    assert all(len(r["ids"]) <= 10 and list(r["ids"]) == sorted(r["ids"]) for r in chunks)
    assert len({r["chunk_id"] for r in chunks}) == len(chunks)
    assert len(chunks) == 51 if buckets is None else len(chunks) <= 51 + buckets


def test_bucketed_chunks_need_one_shuffle(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("{}").alias("properties"))
    plan = N.gather_chunks(N.chunk(rows, 10, 7))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def like(link, name):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in name)
    return re.search(pattern, link, re.S) is not None


@pytest.mark.parametrize("piece", [4, 1, 50])
def test_names_in_links_agree_with_like(spark, piece, monkeypatch):
    monkeypatch.setattr(images_module, "PIECE", piece)
    random.seed(5)
    letters = "ab_%.1"
    names = {"".join(random.choices(letters, k=random.randint(1, 6))) for _ in range(80)}
    names = sorted(n for n in names if n.strip("%_"))
    links = ["".join(random.choices("ab.1/", k=random.randint(0, 14))) for _ in range(120)] + [None]
    feed = spark.createDataFrame([(i, l) for i, l in enumerate(links)], "id int, image_link string")
    images = spark.createDataFrame([(f"gs://b/{n}", n) for n in names], "uri string, description string")
    found = sorted(
        ((r["id"], r["image_description"]) for r in with_image_text(feed, images).collect()), key=repr
    )
    expected = []
    for i, link in enumerate(links):
        hits = [n for n in names if link is not None and like(link, n)]
        expected += [(i, n) for n in hits] or [(i, None)]
    assert found == sorted(expected, key=repr)
    assert len(found) > 500


def test_name_join_has_no_cross_join(spark):
    feed = spark.createDataFrame([("1", "http://x/1.jpg")], "id string, image_link string")
    images = spark.createDataFrame([("gs://b/1.jpg", "d")], "uri string, description string")
    plan = with_image_text(feed, images)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_left_join_spreads_missing_keys(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("0", "a"), ("2", "b"), (None, "c")], "k string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = P.spread_left_join(left, right, "k")
        assert joined.count() == 1000
        assert joined.where("v is not null").count() == 2
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_spread") and all(
            "_spread" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_of_a_left_join_is_split_at_run_time(spark):
    """A third of the rows share a key; the adaptive join cuts its partition."""
    keep = {}
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
    }
    for k, v in small.items():
        keep[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
            F.sha2(F.col("id").cast("string"), 256).alias("pad"),
        )
        right = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit("w").alias("content"))
        right = right.union(spark.createDataFrame([("hot", "w")], "id string, content string"))
        joined = P.with_web_text(left, right)
        assert joined.where("webpage_content = 'w'").count() == 20000 + 13333
        rows = joined.select("id", "pad", "webpage_content")
        rows.collect()
        assert "skewed" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_empty_rows_and_samples(spark):
    rows = spark.createDataFrame([("", None), ("a", None), (None, "b")], "x string, y string")
    assert P.drop_empty_rows(rows).count() == 2
    assert P.sample_rows(spark.range(50), 7, seed=1).count() == 7


HTML = (
    "<html><body><article id=main><p class='desc big'>One <b>two</b><br>three"
    "<p>four<script>var x;</script></article><p>out</p><div data-x=ab1>a&amp;b</div></body></html>"
)


@pytest.mark.parametrize(
    "selector, text",
    [
        (".desc", "One twothreefour"),
        ("p.desc.big b", "two"),
        ("article p", "One twothreefour four"),
        ("#main p", "One twothreefour four"),
        ("div[data-x]", "a&b"),
        ("[data-x^=ab]", "a&b"),
        ("[data-x=ab]", ""),
        ("script", "var x;"),
        ("b, div", "two a&b"),
        ("nav", ""),
    ],
)
def test_selected_text(selector, text):
    assert select_text(HTML, parse_selector(selector)) == text


@pytest.mark.parametrize("selector", ["p:first-child", "a > b", "", "p[=x]"])
def test_unsupported_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def test_page_jobs(spark):
    pages = spark.createDataFrame(
        [("1", HTML), ("2", "<p>plain</p>"), ("3", None)], "id string, html string"
    )
    texts, report = reports.page_texts(pages, ".desc")
    assert {r["id"]: r["content"] for r in texts.collect()} == {"1": "One twothreefour", "2": "", "3": ""}
    assert tuple(report.first()) == (3, 2, 1, 2)
    from shelfloom.generator import ColumnGenerator

    named = pages.withColumnRenamed("id", "page_id")
    picked = reports.suggest_selector(named, ColumnGenerator(lambda: F.lit(" `.desc` ")), seed=1)
    assert picked == ".desc"


def test_page_text_by_line(spark):
    from shelfloom.functions.pages import page_text

    html = "<head><p>no</p>\n</head>\n<p >yes <b>bold</b></p>\n<span x>first</span>\n<script async>x</script>\n<a href=1>l</a>"
    rows = spark.createDataFrame([(html, "text/html"), ("{}", "application/json")], "h string, t string")
    assert [r[0] for r in rows.select(page_text(F.col("h"), F.col("t"))).collect()] == [
        "first yes <b>bold</b>", "{}",
    ]


def test_exports(spark, tmp_path):
    raw = spark.createDataFrame(
        [("1", "t1", "d1", "h1"), ("2", "t2", "d2", None)],
        "id string, title string, description string, product_highlight string",
    )
    output = spark.createDataFrame(
        [("1", 'new "t"', None, "x")], "id string, title string, description string, highlights string"
    )
    full = {r["id"]: r for r in X.full_feed(raw, output).collect()}
    assert X.full_feed(raw, output).columns == ["id", "structured_title", "structured_description", "product_highlight"]
    assert full["1"]["structured_title"] == 'trained_algorithmic_media:"new ""t"""'
    assert full["1"]["structured_description"] == ':"d1"'
    assert full["1"]["product_highlight"] == "trained_algorithmic_media:x"
    assert full["2"]["structured_title"] == ':"t2"' and full["2"]["product_highlight"] is None
    assert X.supplemental_feed(output, mode="all").count() == 0
    none = X.Flags(False, False, False)
    assert X.supplemental_feed(output, none).columns == ["id"]
    with pytest.raises(ValueError):
        reports.export_feed("other", raw, output)


def test_wide_export_refuses_too_many_columns(spark):
    rows = spark.createDataFrame(
        [("1", True, "t", "d", '{"a":"1","b":"2"}', '{"id":"1","a":""}')],
        "id string, approval boolean, title_generated string, description_generated string, "
        "gap_attributes string, original_input string",
    )
    wide = X.approved_feed(rows)
    assert wide.columns == ["modified", "Item ID", "Title", "Description", "a", "new-b"]
    with pytest.raises(ValueError):
        X.approved_feed(rows, max_columns=1)
    assert sorted(tuple(r) for r in X.approved_long(rows).collect()) == [("1", "a", "1"), ("1", "b", "2")]


def test_quality_check(spark):
    class Lengths:
        def embed(self, texts):
            size = F.length("content").cast("float")
            return texts.select("id", F.array(size, F.lit(1.0).cast("float")).alias("vec"))

    output = spark.createDataFrame([("1", "abc"), ("2", None), ("3", "abcd")], "id string, title string")
    prepared = spark.createDataFrame([("1", "abc"), ("2", "b"), ("3", "a")], "id string, title string")
    found = {r["distance_bucket"]: r["items"] for r in reports.quality_check(output, prepared, Lengths()).collect()}
    assert sum(found.values()) == 2
    vectors = spark.createDataFrame([("1", [1.0, 0.0], [0.0, 2.0])], "id string, vec_a array<float>, vec_b array<float>")
    assert Q.distances(vectors).first()["distance"] == 1.0


def test_known_attribute_values_stay(spark):
    feed = spark.createDataFrame([(1, "red"), (2, ""), (3, None)], "id int, color string")
    values = spark.createDataFrame([("1", "blue"), ("2", "green")], "id string, color string")
    found = {r["id"]: r["color"] for r in merge_attribute(feed, values, "id", "color").collect()}
    assert found == {1: "red", 2: "green", 3: None}


def test_new_images_and_names(spark):
    from shelfloom.functions.text import file_name
    from shelfloom.operators.images import new_images

    urls = spark.createDataFrame([("h/a.jpg",), ("h/b.jpg",)], "url string")
    objects = spark.createDataFrame([("a.jpg",)], "name string")
    assert [r["url"] for r in new_images(urls, objects).collect()] == ["h/b.jpg"]
    rows = urls.select(file_name(F.col("url")).alias("n"), file_name(F.lit("plain")).alias("none"))
    assert tuple(rows.orderBy("n").first()) == ("a.jpg", None)


def test_gaps_split_into_filled_and_invented(spark):
    from shelfloom.functions.attributes import split_gaps

    gaps = F.create_map(F.lit("color"), F.lit("red"), F.lit("shape"), F.lit("round"))
    item = F.create_map(F.lit("color"), F.lit(""))
    filled, invented = split_gaps(gaps, item)
    row = spark.range(1).select(filled.alias("f"), invented.alias("i")).first()
    assert (row["f"], row["i"]) == ({"color": "red"}, {"shape": "round"})


def test_candidates_of_roles_and_plain_projection(spark):
    feed = spark.createDataFrame([("1", "n", None, "t", "x"), ("2", None, "p", "u", "y")], "sku string, name string, pic string, title string, product_id string")
    assert P.role_candidates(feed.columns) == {
        "id": ["sku", "product_id"], "title": ["name", "title"], "description": [], "url": [], "image_url": ["pic"],
    }
    rows = [tuple(r) for r in P.candidate_report(feed).collect()]
    assert rows == [
        ("id", 0, "sku", 2), ("id", 1, "product_id", 2), ("title", 0, "name", 1), ("title", 1, "title", 2), ("image_url", 0, "pic", 1),
    ]
    assert P.candidate_report(spark.range(2).withColumnRenamed("id", "zzz")).count() == 0
    plain = P.project_plain(feed, "sku", "title", "title", " name, sku ,pic", where="sku = '1'")
    assert plain.columns == ["sku", "title", "name", "pic"] and plain.count() == 1
    assert P.project_plain(feed, "sku", "title", "name", "*").columns == feed.columns
