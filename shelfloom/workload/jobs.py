"""Queries over sources, samples, images and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.functions.attributes import split_gaps
from shelfloom.functions.pages import page_text
from shelfloom.functions.prompts import load_template
from shelfloom.functions.text import file_name
from shelfloom.generator import CallEmbedder, ColumnGenerator
from shelfloom.operators import examples as E
from shelfloom.operators import images as I
from shelfloom.operators import merge as M
from shelfloom.operators import prepare as P
from shelfloom.operators.scoring import Scoring, title_metrics, title_parts
from shelfloom.plans import generation, reports
from shelfloom.plans.optimise import optimise
from shelfloom.session import materialise, shared_folder
from shelfloom.sources import records
from shelfloom.workload.prompting import _ITEM_JSON, FAILS, sectioned
from shelfloom.workload.registry import query, text
from shelfloom.workload.results import (
    _CLEANED,
    _RECORD_SETTINGS,
    _START,
    _STATUS,
    _finished,
    _mark,
    _passes_sql,
    _replied,
    _run,
    _status,
)
from shelfloom.workload.stub import marked_description_reply, marked_title_reply, stub_generator
from shelfloom.workload.views import PROPERTIES, Tables


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _one_row(t: Tables, **values) -> DataFrame:
    return t.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@query(
    """
    SELECT link, description FROM feed_raw
    WHERE length(coalesce(link, '') || coalesce(description, '')) > 0
    """
)
def rows_with_content(t: Tables) -> DataFrame:
    return P.drop_empty_rows(t.raw().select("link", "description"))


@query("SELECT id, title, CAST(clicks AS VARCHAR) AS clicks FROM feed_raw ORDER BY id LIMIT 5")
def preview_rows(t: Tables) -> DataFrame:
    return P.preview(t.raw().orderBy("id"), ["id", "title", "clicks"])


@query(
    """
    SELECT 'feed: ' || (SELECT COUNT(*) FROM feed_raw)
             || ' rows, 10 columns (id, title, description, brand, category, ...)' AS summary,
           'id title description' AS roles,
           (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM feed_raw ORDER BY id LIMIT 5))
             AS previewed
    """
)
def feed_summary(t: Tables) -> DataFrame:
    found = P.profile(t.raw().orderBy("id"))
    roles = " ".join(found["roles"][r] for r in ("id", "title", "description"))
    shown = ",".join(row[0] for row in found["preview"])
    return _one_row(t, summary=found["summary"], roles=roles, previewed=shown)


@query(
    """
    SELECT to_json({'id': id, 'title': title, 'description': description, 'brand': brand,
                    'category': category, 'size': size, 'color': color, 'link': link,
                    'image_link': image_link, 'clicks': clicks})::VARCHAR AS context
    FROM feed_raw WHERE id = '7'
    """
)
def item_as_json(t: Tables) -> DataFrame:
    return P.item_json(t.raw(), "7")


@query(
    """
    SELECT (SELECT COUNT(*) FROM item_properties) AS stored, CAST(0 AS BIGINT) AS cleared
    """
)
def stored_table(t: Tables) -> DataFrame:
    """A table replaced, read, cleared and read again."""
    path = _folder(t, "stored")
    properties = t.properties()
    records.replace_table(properties.limit(1), path)
    stored = records.replace_table(properties, path).count()
    records.clear_table(t.spark, path, properties.schema)
    return _one_row(t, stored=stored, cleared=records.read_table(t.spark, path, properties.schema).count())


@query("SELECT id, title FROM feed_raw ORDER BY md5('3|' || id), id LIMIT 50")
def sampled_rows(t: Tables) -> DataFrame:
    return P.sample_rows(t.raw(), 50, 3).select("id", "title")


_OBJECTS = "(SELECT regexp_extract(image_link, '[^/]+$') AS name FROM feed_raw WHERE CAST(id AS BIGINT) % 50 < 30)"


@query(
    f"""
    SELECT DISTINCT image_link AS url, regexp_extract(image_link, '[^/]+$') AS name, true AS is_new
    FROM feed_raw WHERE regexp_extract(image_link, '[^/]+$') NOT IN {_OBJECTS}
    """
)
def images_to_fetch(t: Tables) -> DataFrame:
    """Links whose image is not stored yet, by the registry and by the plain anti join."""
    name = F.element_at(F.split("image_link", "/"), -1).alias("name")
    objects = t.raw().where("cast(id as bigint) % 50 < 30").select(name)
    wanted, _ = reports.register_images(t.raw(), objects, "image_link")
    plain = I.new_images(I.image_urls(t.raw(), "image_link"), objects)
    flagged = plain.select("url", F.lit(True).alias("is_new"))
    return wanted.join(flagged, "url", "full_outer").select("url", "name", "is_new")


@query(
    lambda: f"""
    SELECT uri, 'shown in ' || uri || ' ' || md5({text(load_template("image").strip())}) AS description
    FROM images
    """
)
def described_images(t: Tables) -> DataFrame:
    said = ColumnGenerator(lambda: F.concat(F.lit(" shown in "), "uri", F.lit(" "), F.md5("prompt")))
    return reports.describe_images(t.images().select("uri"), said)


@query("SELECT CAST(SUM(strlen(description) + 1) AS BIGINT) AS bytes FROM images")
def stored_objects(t: Tables) -> DataFrame:
    """Objects written to storage and found there again by name."""
    folder = _folder(t, "objects")
    t.images().select("description").write.text(folder)
    objects = records.read_objects(t.spark, folder, "part-*")
    return I.object_stats(objects.where(F.col("name").startswith("part-"))).select("bytes")


@query("SELECT id, properties, title, description, CAST(3 AS INT) AS total FROM examples")
def inline_examples(t: Tables) -> DataFrame:
    """Examples handed over as rows of the program, counted and shown."""
    rows = t.examples().select("id", "properties", "title", "description").collect()
    total, shown = E.examples_preview(E.literal_examples(t.spark, [tuple(r) for r in rows]))
    return shown.withColumn("total", F.lit(total))


@query("SELECT 'second ' || id AS value FROM feed_raw")
def newest_replies(t: Tables) -> DataFrame:
    """The replies of the last of several run folders, which lie deeper than their root."""
    root = _folder(t, "runs")
    for run, name in (("2024-01", "first"), ("2024-02", "second")):
        lines = t.raw().select(F.concat(F.lit(f"{name} "), "id").alias("value"))
        lines.write.text(f"{root}/{run}/predictions.jsonl")
    return records.read_replies(t.spark, records.newest_run(t.spark, root))


@query(
    lambda: f"""
    SELECT 'div.' || md5({text(load_template("selector"))}
             || string_agg('--- Page ' || n || ' ---' || chr(10) || {_CLEANED} || chr(10) || chr(10),
                           '' ORDER BY n)) AS selector
    FROM (SELECT html, ROW_NUMBER() OVER (ORDER BY page_id) AS n
          FROM (SELECT page_id, html FROM pages WHERE html IS NOT NULL
                ORDER BY md5('0|' || page_id), page_id LIMIT 5))
    """
)
def suggested_selector(t: Tables) -> DataFrame:
    """The selector of a model that answers with quotes around it."""
    model = ColumnGenerator(lambda: F.concat(F.lit("`div."), F.md5("prompt"), F.lit("`\n")))
    return _one_row(t, selector=reports.suggest_selector(t.read("pages"), model))


@query(
    """
    SELECT p.page_id, CASE WHEN p.page_id % 3 = 0 THEN p.html ELSE w.content END AS body,
           nullif(regexp_extract(p.url, '/([^/]+)$', 1), '') AS file
    FROM pages p JOIN web w ON w.id = CAST(p.page_id AS VARCHAR)
    """
)
def page_bodies(t: Tables) -> DataFrame:
    """JSON documents as they are, pages as text, and the file names of the links."""
    kind = F.when(F.col("page_id") % 3 == 0, "application/json").otherwise("text/html")
    return t.read("pages").select(
        "page_id", page_text(F.col("html"), kind).alias("body"), file_name(F.col("url")).alias("file")
    )


@query(
    """
    SELECT id, CASE WHEN gap_attributes = '' OR contains(gap_attributes, 'Material') THEN '{}'
                    ELSE gap_attributes END AS present,
           CASE WHEN contains(gap_attributes, 'Material') THEN gap_attributes ELSE '{}' END AS invented
    FROM title_scores_allowed
    """
)
def gap_kinds(t: Tables) -> DataFrame:
    """Gaps of columns that the feed has, and attributes it has no column for."""
    settings = Scoring(allowed_words=("Steel",))
    scored = title_metrics(title_parts(_replied(t), settings), settings)
    present, invented = split_gaps(F.col("gaps"), F.col("item"))
    return scored.select("id", F.to_json(present).alias("present"), F.to_json(invented).alias("invented"))


@query(f"SELECT * FROM records WHERE id NOT IN (SELECT id FROM ({_STATUS}) WHERE status <> 'Failed')")
def optimise_unprocessed(t: Tables) -> DataFrame:
    """Titles and descriptions of the rows alone that have no finished result yet."""
    return optimise(
        t.scoring_feed(),
        ColumnGenerator(marked_title_reply),
        ColumnGenerator(marked_description_reply),
        _RECORD_SETTINGS,
        generated=_status(t),
        title_wording="Title it. ",
        description_wording="Describe it. ",
    )


_WEBSITE = "CASE WHEN w.content <> '' THEN 'Website: ' || w.content || chr(10) || chr(10) ELSE '' END"


@query(
    f"""
    SELECT f.id, 'Success' AS status, md5('Describe it. Context: {{"Generated Title":' || to_json(f.title)::VARCHAR || ','
             || substr({_ITEM_JSON}, 2) || chr(10) || chr(10) || {_WEBSITE}) AS description_generated
    FROM feed_filtered f
    LEFT JOIN (SELECT g.url, MIN(w.content) AS content
               FROM pages g JOIN web w ON w.id = CAST(g.page_id AS VARCHAR) GROUP BY g.url) w ON w.url = f.link
    WHERE f.id NOT IN (SELECT id FROM ({_STATUS}) WHERE status <> 'Failed')
    """
)
def optimise_with_pages(t: Tables) -> DataFrame:
    """Descriptions of unprocessed rows from prompts that hold the text of each row's page."""
    pages = t.read("pages").select("url", "html", F.lit("text/html").alias("content_type"))
    reply = lambda: F.concat(F.lit("description: "), F.md5("prompt"), F.lit("\nscore: 4\nreasoning: as asked"))
    done = optimise(
        t.filtered(),
        ColumnGenerator(marked_title_reply),
        ColumnGenerator(reply),
        Scoring(titles=False),
        generated=_status(t),
        pages=pages,
        url_col="link",
        description_wording="Describe it. ",
        tasks=8,
    )
    return done.select("id", "status", "description_generated")


def _counting_client():
    """A client whose vectors count characters of a text."""
    return lambda texts: [[float(len(x)), float(x.count("a")), float(x.count("e") + 1)] for x in texts]


_VECTOR = "[length({0})::DOUBLE, (length({0}) - length(replace({0}, 'a', '')))::DOUBLE, " \
    "(length({0}) - length(replace({0}, 'e', '')) + 1)::DOUBLE]"


@query(
    f"""
    WITH s AS (SELECT id, title FROM finished WHERE title IS NOT NULL
               ORDER BY md5('1|' || id), id LIMIT 200),
    v AS (SELECT {_VECTOR.format("f.title")} AS a, {_VECTOR.format("s.title")} AS b
          FROM s JOIN feed_raw f ON f.id = s.id)
    SELECT ceil((1 - list_dot_product(a, b)
                     / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) * 10) / 10
             AS distance_bucket, COUNT(*) AS items
    FROM v GROUP BY 1
    """
)
def quality_job(t: Tables) -> DataFrame:
    """The quality check of a sample, with vectors from a client."""
    return reports.quality_check(
        _finished(t), t.raw().select("id", "title"), CallEmbedder(_counting_client), 200, 1
    )


_TITLE_BLOCKS = sectioned("titles", "English", "title", "array_to_string(properties, chr(10))")


@query(
    f"""
    WITH {_passes_sql("t", _START, 4, _TITLE_BLOCKS)}
    SELECT id, CASE WHEN done THEN 'Item ' || id || ', new title' || mark END AS title, tries FROM t_result
    """
)
def generate_title_blocks(t: Tables) -> DataFrame:
    """All passes with block replies for titles."""
    return _run(t, S.TITLES, "blocks", items_per_prompt=4).select("id", "title", "tries")


_IMAGE_ITEM = """
    to_json({'id': f.id, 'title': f.title, 'description': f.description, 'brand': f.brand,
             'category': f.category, 'size': f.size, 'color': f.color,
             'image_url': f.image_link})::VARCHAR
    || chr(10) || 'image_url: gs://b/images/' || string_split(f.image_link, '/')[-1]
"""


@query(
    f"""
    WITH single AS (
      SELECT f.id, [f.id] AS ids, 'Item ' || f.id || ', new title' || {_mark(sectioned(
        "titles", "English", "title", _IMAGE_ITEM))} AS new_title
      FROM feed_filtered f)
    SELECT id, CASE WHEN NOT ({FAILS}) THEN new_title END AS title,
           CAST(CASE WHEN {FAILS} THEN 3 ELSE 1 END AS BIGINT) AS tries
    FROM single
    """
)
def generate_with_images(t: Tables) -> DataFrame:
    """One item per prompt, each with the place of its image."""
    feed = materialise(
        t.filtered().select("id", *PROPERTIES, F.col("image_link").alias("image_url")), "with-images"
    )
    settings = generation.Passes(target=S.TITLES, layout="single", use_images=True, bucket_name="b")
    done = generation.generate(
        M.init_output(feed), feed, t.examples(), stub_generator("title", "single"), settings
    )
    return done.select("id", "title", "tries")
