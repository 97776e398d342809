"""Row-level cases of the text functions."""

import re

import pytest
from pyspark.sql import functions as F

from shelfloom.functions import parsing as R
from shelfloom.functions import text as X
from shelfloom.functions.pages import selected_text


def one(spark, value, build):
    row = spark.range(1).select(F.lit(value).cast("string").alias("x"))
    return row.select(build(F.col("x")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("https://a/b/c.jpg", "c.jpg"),
        ("https://a/b/", "image_" + "86eccbfc72f30dfcf2a5a0d9ac3ae7a9" + ".jpg"),
        ("https://a/c.jpg?x=1", None),
    ],
)
def test_object_names(spark, value, expected):
    import hashlib

    digest = "image_" + hashlib.md5(value.encode()).hexdigest() + ".jpg"
    name = one(spark, value, X.image_object_name)
    assert name == (expected if value.endswith("c.jpg") else digest)


def test_image_uri_is_null_without_images(spark):
    assert one(spark, "https://a/c.jpg", lambda c: X.image_uri(c, "b", enabled=False)) is None
    assert one(spark, None, lambda c: X.image_uri(c, "b")) is None
    assert one(spark, "https://a/c.jpg", lambda c: X.image_uri(c, "b")) == "gs://b/images/c.jpg"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a | b||  |c ", ["a", "b", "", "c"]),
        ("  ", []),
        ("|x|", ["x"]),
        ("red | | M", ["red", "", "M"]),
    ],
)
def test_split_list_drops_empty_items_but_keeps_blanks(spark, value, expected):
    assert one(spark, value, X.split_list) == expected


@pytest.mark.parametrize(
    "value, expected", [("Color, Size", ["color", "size"]), ("none", []), ("", []), (None, [])]
)
def test_split_keys(spark, value, expected):
    assert one(spark, value, X.split_keys) == expected


def test_strip_and_squash(spark):
    assert one(spark, " \t\n x y ﻿\r\n", X.strip) == "x y"
    assert one(spark, " a\n\t b c ", X.squash) == "a b c"


@pytest.mark.parametrize(
    "value, valid", [('{"a": 1}', True), ("[1]", True), ("invalid json", False), ("", False), (None, False)]
)
def test_is_json(spark, value, valid):
    assert one(spark, value, X.is_json) is valid


def test_embed_for_feed(spark):
    assert one(spark, 'a "b"', lambda c: X.embed_for_feed(c, True)) == 'trained_algorithmic_media:"a ""b"""'
    assert one(spark, "a", lambda c: X.embed_for_feed(c, False)) == ':"a"'
    assert one(spark, None, lambda c: X.embed_for_feed(c, True)) is None


def test_part_of_is_the_published_digest(spark):
    assert one(spark, "2480", lambda c: X.part_of(c, 2**40)) == 2959824193


@pytest.mark.parametrize(
    "line, expected",
    [
        ("12: A title", ("12", "A title")),
        ("12: A title: with colon", ("12", "A title: with colon")),
        ("12", ("12", None)),
        ("12:no blank", (None, None)),
        ("12: ", ("12", "")),
        ("12: crlf\r", ("12", "crlf\r")),
        ("", (None, None)),
    ],
)
def test_parse_line(spark, line, expected):
    assert tuple(one(spark, line, R.parse_line)) == expected


def test_failed_reply_falls_back_to_the_ids(spark):
    rows = spark.createDataFrame([(None, ["1", "2"]), ("a\nb", ["1"])], "r string, ids array<string>")
    found = [x[0] for x in rows.select(R.reply_lines(F.col("r"), F.col("ids"))).collect()]
    assert found == [["1", "2"], ["a", "b"]]


def test_blocks(spark):
    reply = "Sure!\nID: 7\nkeys: x\nGenerated Title: A b\n\nid: 8\nGENERATED TITLE:   C\nid: 9\nnothing"
    assert [tuple(r) for r in one(spark, reply, R.parse_title_blocks)] == [("7", "A b"), ("8", "C")]
    reply = "id: 7\ngenerated description: one\ntwo\n score: 4\nid: 8\ngenerated description: x\nscore: 1"
    found = [tuple(r) for r in one(spark, reply, R.parse_description_blocks)]
    assert found == [("7", "one\ntwo"), ("8", "x")]


@pytest.mark.parametrize(
    "reply, title",
    [
        ("**Generated Title:** Red shoe", "Red shoe"),
        ("generated title : *Red* shoe\nmore", "Red* shoe"),
        ("Just a title", "Just a title"),
        ("generated title:", None),
        ("Generated title:", "Generated title:"),
        (None, None),
    ],
)
def test_markdown_title(spark, reply, title):
    assert one(spark, reply, R.parse_title_markdown) == title


@pytest.mark.parametrize(
    "reply, text",
    [
        ("**generated description:** a\nb\n**score:** 4", "a\nb"),
        ("generated description: a\nb", "a\nb"),
        ("generated description:", ""),
        ("plain", "plain"),
    ],
)
def test_markdown_description(spark, reply, text):
    assert one(spark, reply, R.parse_description_markdown) == text


@pytest.mark.parametrize(
    "reply, value",
    [
        ("Generated Highlights: \"a\",\"b\"\nmore", '"a","b"'),
        ("mock title", "mock title"),
        ("  \n", ""),
        ("generated title:\nnext line", "next line"),
    ],
)
def test_parse_label(spark, reply, value):
    assert one(spark, reply, R.parse_label) == value


def test_batch_value_keeps_lines_of_descriptions_and_nulls_blanks(spark):
    assert one(spark, "generated description: a\nb", lambda c: R.batch_value(c, "description")) == "a\nb"
    assert one(spark, "generated description: a\nb", lambda c: R.batch_value(c, "description", True)) == "a"
    assert one(spark, " ", lambda c: R.batch_value(c, "title")) is None
    assert one(spark, " ", lambda c: R.batch_value(c, "title", True)) == ""


TITLE_REPLY = (
    "Intro\n**Product attribute keys in original title:** Brand | Kind\n"
    "Product category: Swim\nproduct attribute keys: Brand | Color\n"
    "product attribute values: 2XU | Black\n%sgenerated title:** 2XU Black\n"
)


def test_title_reply_with_and_without_replaced_keys(spark):
    found = one(spark, TITLE_REPLY % "replaced keys: Color\n", R.parse_title_reply)
    assert found["original_keys"] == "Brand | Kind"
    assert (found["category"], found["replaced_keys"], found["title"]) == ("Swim", "Color", "2XU Black")
    found = one(spark, TITLE_REPLY % "", R.parse_title_reply)
    assert (found["values"], found["replaced_keys"], found["error"]) == ("2XU | Black", None, None)


@pytest.mark.parametrize(
    "reply", [None, "", "generated title: x", "generated title: x\nproduct category: y"]
)
def test_incomplete_title_reply_is_an_error(spark, reply):
    found = one(spark, reply, R.parse_title_reply)
    assert found["title"] is None and found["error"].startswith("Incomplete title reply")


def test_sections_on_the_same_line_do_not_count(spark):
    reply = "description: a score: 3\nreasoning: r"
    assert one(spark, reply, R.parse_description_reply)["error"] is not None


def test_sections_agree_with_a_greedy_pattern(spark):
    """Random replies against the greedy pattern that defines the reading."""
    import random
    import re

    from shelfloom import constants as C

    random.seed(3)
    bits = ["description:", "score:", "reasoning:", "x", " ", "\n", "**", "Score:", "y\n"]
    replies = ["".join(random.choices(bits, k=random.randint(8, 30))) for _ in range(3000)]
    pattern = re.compile(
        r"^.*description:\**(.*)^.*score:\**(.*)^.*reasoning:\**(.*)$", re.I | re.M | re.S
    )
    rows = spark.createDataFrame([(r,) for r in replies], "x string").select(
        "x", R.labelled_sections(F.col("x"), C.DESCRIPTION_REPLY_KEYS).alias("found")
    )
    hits = 0
    for reply, found in rows.collect():
        m = pattern.match(reply)
        expected = [g.strip() for g in m.groups()] if m else None
        assert found == expected, reply
        hits += m is not None
    assert hits > 100


def test_description_score(spark):
    reply = "Description: Nice.\nTwo lines\n\n**Score:** 3.5 of 5\nreasoning: fine"
    found = one(spark, reply, R.parse_description_reply)
    assert tuple(found) == ("Nice.\nTwo lines", 3.5, "fine", None)
    found = one(spark, "description: a\nscore: good\nreasoning: b", R.parse_description_reply)
    assert found["score"] is None and found["error"] is None


def paragraphs_by_hand(page):
    """Texts of ``article p`` from a tree that is built tag by tag; an open paragraph holds what follows."""
    import html as markup

    void = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
    root = {"tag": "", "parent": None, "parts": []}
    at, found = root, []
    tokens = re.finditer(
        r"(?is)<!--.*?-->|<!.*?>|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)\b([^>]*)>|([^<]+|<)", page or ""
    )
    for token in tokens:
        if token.group(5) is not None:
            at["parts"].append(markup.unescape(token.group(5)))
        elif token.group(3):
            tag = token.group(3).lower()
            if not token.group(2):
                node = {"tag": tag, "parent": at, "parts": []}
                at["parts"].append(node)
                if tag not in void and not token.group(4).endswith("/"):
                    at = node
                up = node["parent"]
                while up and up["tag"] != "article":
                    up = up["parent"]
                if tag == "p" and up:
                    found.append(node)
            else:
                up = at
                while up and up["tag"] != tag:
                    up = up["parent"]
                at = up["parent"] if up else at

    def text(node):
        return "".join(p if isinstance(p, str) else text(p) for p in node["parts"])

    return re.sub(r"\s+", " ", " ".join(text(n) for n in found).replace("\r", "")).strip()


def test_paragraphs_of_all_pages_as_by_hand(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", selected_text(F.col("html"), "article p").alias("text")).collect()
    assert len(rows) >= 50
    unclosed = 0
    for row in rows:
        assert row["text"] == paragraphs_by_hand(row["html"])
        unclosed += len(re.findall(r"<p\b", row["html"])) != row["html"].count("</p>")
    assert unclosed > 10  # the pages in question


def test_nested_and_broken_paragraphs(spark):
    cases = {
        "<article><p>a<p>b</p>c</article><p>out</p>": "abc b",
        "<article><p>a</article>tail": "a",
        "<article><p>x &amp; <b>y</b><br>z<script>p</script></p></article>": "x & yz",
        "<p>none</p>": "",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "html string")
    found = dict(map(tuple, frame.select("html", selected_text(F.col("html"), "article p")).collect()))
    for page, wanted in cases.items():
        assert found[page] == wanted == paragraphs_by_hand(page)


def test_pages_of_a_batch_become_texts_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from shelfloom.functions.pages import parse_selector, select_texts

    pages = pa.array(["<p>a</p><!--" + "x" * 20_000 + "-->", None, "", "<p>b"] * 250)
    tracemalloc.start()
    found = select_texts(pages, parse_selector("p"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == ["a", "", "", "b"] * 250
    # The batch holds 5 MB.
    assert pages.nbytes > 5_000_000 and peak < 1_000_000
