"""Queries over the feed: choosing, joining, numbering and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import text as X
from shelfloom.operators import numbering as N
from shelfloom.operators import prepare as P
from shelfloom.operators.examples import (
    clean_examples,
    examples_by_ids,
    examples_by_metric,
    examples_from_texts,
)
from shelfloom.operators.images import image_registry, image_report, image_urls, object_stats, with_image_text
from shelfloom.workload.registry import query
from shelfloom.workload.views import PROPERTIES, Tables


@query(
    """
    SELECT COUNT(*) AS num_rows, 10 AS num_cols,
           'id, title, description, brand, category, ...' AS columns,
           'id id, title title, description description, url link, image_url image_link' AS roles
    FROM feed_raw
    """
)
def feed_profile(t: Tables) -> DataFrame:
    feed = t.raw()
    roles = ", ".join(f"{role} {column}" for role, column in P.guess_roles(feed.columns).items())
    return feed.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.lit(len(feed.columns)).alias("num_cols"),
        F.lit(", ".join(feed.columns[:5]) + ", ...").alias("columns"),
        F.lit(roles).alias("roles"),
    )


@query(
    """
    SELECT id, title, description, link AS url, image_link AS image_url, brand, size
    FROM feed_raw WHERE link IS NOT NULL OR size > '3'
    """
)
def filter_project(t: Tables) -> DataFrame:
    return P.project_roles(
        t.raw(), "id", "title", "description", "link", "image_link", "brand, title, size",
        where="link is not null or size > '3'",
    )


@query("SELECT id, brand, title, size FROM feed_raw WHERE size > '3'")
def filter_project_plain(t: Tables) -> DataFrame:
    """Columns as they are named, repeated ones once."""
    return P.project_plain(t.raw(), "id", "brand", "title", "title, size, id", where="size > '3'")


@query(
    """
    SELECT * FROM (
        SELECT 'id' AS role, 0 AS place, 'id' AS "column", COUNT(id) AS filled FROM feed_raw
        UNION ALL SELECT 'title', 0, 'title', COUNT(title) FROM feed_raw
        UNION ALL SELECT 'description', 0, 'description', COUNT(description) FROM feed_raw
        UNION ALL SELECT 'url', 0, 'link', COUNT(link) FROM feed_raw
        UNION ALL SELECT 'url', 1, 'image_link', COUNT(image_link) FROM feed_raw
        UNION ALL SELECT 'image_url', 0, 'image_link', COUNT(image_link) FROM feed_raw)
    """
)
def role_candidates(t: Tables) -> DataFrame:
    """All columns that could play each role."""
    return P.candidate_report(t.raw())


@query(
    """
    SELECT id, title, brand FROM feed_raw
    WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)
    """
)
def filter_ids(t: Tables) -> DataFrame:
    wanted = t.read("labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return P.restrict_to(t.raw(), wanted).select("id", "title", "brand")


@query("SELECT * FROM feed_filtered")
def band_by_clicks(t: Tables) -> DataFrame:
    return t.filtered()


@query(
    """
    SELECT id, ('0x' || substr(md5(id), 1, 8))::BIGINT % 4 AS part FROM feed_raw
    """
)
def hash_parts(t: Tables) -> DataFrame:
    return t.raw().select("id", X.part_of(F.col("id"), 4).alias("part"))


@query(
    """
    SELECT f.id, f.title, f.description, f.brand, f.category, f.size, f.color, f.link,
           f.image_link, f.image_link AS image_url, w.content AS webpage_content
    FROM feed_filtered f LEFT JOIN web w ON f.id = w.id
    """
)
def prepare_input(t: Tables) -> DataFrame:
    return P.complete_input(t.filtered(), t.web(), image_col="image_link")


@query(
    """
    SELECT f.id, f.image_link, i.description AS image_description
    FROM feed_raw f
    LEFT JOIN images i
      ON f.image_link LIKE '%' || regexp_extract(i.uri, '.*/([^/]+)', 1) || '%'
    """
)
def image_contains_join(t: Tables) -> DataFrame:
    return with_image_text(t.raw().select("id", "image_link"), t.images())


@query(
    """
    SELECT DISTINCT g.url, i.description
    FROM (SELECT DISTINCT url FROM pages) g
    JOIN (SELECT DISTINCT 'gs://b/' || replace(p_name, ' ', '%') AS uri, p_name AS description
          FROM part
          UNION
          SELECT DISTINCT 'gs://b/' || substr(source, 1, 1) || '%page' || right(source, 1) AS uri,
                 source AS description FROM documents
          UNION
          SELECT DISTINCT 'gs://b/' || lang || '_' || right(source, 1) AS uri,
                 lang || right(source, 1) AS description FROM documents) i
      ON g.url LIKE '%' || regexp_extract(i.uri, '.*/([^/]+)', 1) || '%'
    """
)
def image_wildcard_join(t: Tables) -> DataFrame:
    """File names with ``%`` and ``_``, which match as wildcards, against page links."""
    documents = t.read("documents")
    last = F.right(F.col("source"), F.lit(1))
    part = t.read("part").select(
        F.concat(F.lit("gs://b/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%"))).alias("uri"),
        F.col("p_name").alias("description"),
    )
    run = documents.select(
        F.concat(F.lit("gs://b/"), F.left("source", F.lit(1)), F.lit("%page"), last).alias("uri"),
        F.col("source").alias("description"),
    )
    single = documents.select(
        F.concat(F.lit("gs://b/"), "lang", F.lit("_"), last).alias("uri"),
        F.concat("lang", last).alias("description"),
    )
    images = part.union(run).union(single).distinct()
    links = t.read("pages").select("url").distinct()
    matched = with_image_text(links, images, "url").where("image_description is not null")
    return matched.select("url", F.col("image_description").alias("description")).distinct()


@query(
    """
    SELECT id, to_json({'title': title, 'description': description, 'brand': brand,
                        'category': category, 'size': size, 'color': color})::VARCHAR AS properties,
           title, description
    FROM prepared WHERE id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)
    """
)
def examples_of_ids(t: Tables) -> DataFrame:
    ids = t.read("lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return examples_by_ids(t.prepared(), ids)[0]


@query(
    """
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem
    WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT id FROM prepared)
    """
)
def examples_missing_ids(t: Tables) -> DataFrame:
    ids = t.read("lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return examples_by_ids(t.prepared(), ids)[1]


@query("SELECT * FROM examples")
def examples_top_metric(t: Tables) -> DataFrame:
    return examples_by_metric(t.raw(), "clicks", PROPERTIES, 3)


@query(
    """
    SELECT p.id, to_json({'title': p.title, 'description': p.description, 'brand': p.brand,
                          'category': p.category, 'size': p.size, 'color': p.color})::VARCHAR
             AS properties, 'Good ' || b.item_id AS title, b.text AS description
    FROM benchmark b JOIN prepared p ON p.id = CAST(b.item_id AS VARCHAR)
    """
)
def examples_from_written_texts(t: Tables) -> DataFrame:
    texts = t.read("benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.concat(F.lit("Good "), F.col("item_id").cast("string")).alias("title"),
        F.col("text").alias("description"),
    )
    return examples_from_texts(texts, t.prepared())


@query(
    """
    SELECT md5(properties) AS id, properties, title, description
    FROM (SELECT trim(props) AS properties, event_type AS title, '' AS description FROM events
          UNION ALL
          SELECT text AS properties, role AS title, '' AS description FROM conversations)
    WHERE json_valid(properties)
    """
)
def examples_of_file_rows(t: Tables) -> DataFrame:
    good = t.read("events").select(
        F.concat(F.lit(" "), "props").alias("properties"), F.col("event_type").alias("title")
    )
    bad = t.read("conversations").select(
        F.col("text").alias("properties"), F.col("role").alias("title")
    )
    rows = good.union(bad).withColumn("description", F.lit(" "))
    return clean_examples(rows, stable_ids=True)


@query(
    """
    SELECT id, 3 + ROW_NUMBER() OVER (ORDER BY id) - 1 AS position FROM feed_raw
    """
)
def row_positions(t: Tables) -> DataFrame:
    return N.with_position(t.raw().select("id"), ["id"], start=3)


@query(
    """
    SELECT id, (ROW_NUMBER() OVER (ORDER BY id) - 1) // 30 AS batch_no FROM feed_raw
    """
)
def batch_numbers(t: Tables) -> DataFrame:
    return N.with_batch_no(t.raw().select("id"), ["id"])


@query(
    """
    SELECT id FROM feed_raw ORDER BY md5('0' || id), id LIMIT 600
    """
)
def next_pending_batch(t: Tables) -> DataFrame:
    return N.next_batch(t.raw().select("id"), 600)


@query(
    r"""
    SELECT id, array_to_string(list_sort(list_distinct(w1)), ' ') AS words,
           array_to_string(list_sort(list_distinct(list_filter(w1, lambda x: NOT list_contains(w2, x)))), ' ')
             AS only_title,
           array_to_string(list_sort(list_distinct(list_filter(w1, lambda x: list_contains(w2, x)))), ' ')
             AS shared
    FROM (SELECT id, regexp_extract_all(title, '(\w+)', 1) AS w1,
                 regexp_extract_all(description, '(\w+)', 1) AS w2 FROM feed_raw
          WHERE description IS NOT NULL)
    """
)
def word_sets(t: Tables) -> DataFrame:
    title, body = X.word_set(F.col("title")), X.word_set(F.col("description"))
    return t.raw().where("description is not null").select(
        "id",
        F.array_join(F.array_sort(title), " ").alias("words"),
        F.array_join(F.array_sort(F.array_except(title, body)), " ").alias("only_title"),
        F.array_join(F.array_sort(F.array_intersect(title, body)), " ").alias("shared"),
    )


def _objects(t: Tables) -> DataFrame:
    """Stored images: one per page link, sized by the page."""
    return t.read("pages").select(
        X.image_object_name(F.col("url")).alias("name"), F.length("html").alias("length")
    )


_OBJECTS = """
    SELECT CASE WHEN base = '' OR contains(base, '?') THEN 'image_' || md5(url) || '.jpg'
                ELSE base END AS name, url, length(html) AS length
    FROM (SELECT url, html, string_split(url, '/')[-1] AS base FROM pages)
"""


@query(
    f"""
    WITH objects AS ({_OBJECTS}),
    links AS (SELECT DISTINCT image_link AS url FROM feed_raw
              UNION SELECT DISTINCT url FROM objects),
    named AS (SELECT url, CASE WHEN base = '' OR contains(base, '?')
                               THEN 'image_' || md5(url) || '.jpg' ELSE base END AS name
              FROM (SELECT url, string_split(url, '/')[-1] AS base FROM links))
    SELECT url, name, name IN (SELECT name FROM objects) AS stored FROM named
    """
)
def image_links(t: Tables) -> DataFrame:
    links = image_urls(t.raw(), "image_link").union(t.read("pages").select("url")).distinct()
    return image_registry(links, _objects(t))


@query(
    f"""
    WITH objects AS ({_OBJECTS}),
    links AS (SELECT DISTINCT image_link AS url FROM feed_raw
              UNION SELECT DISTINCT url FROM objects),
    named AS (SELECT url, CASE WHEN base = '' OR contains(base, '?')
                               THEN 'image_' || md5(url) || '.jpg' ELSE base END AS name
              FROM (SELECT url, string_split(url, '/')[-1] AS base FROM links))
    SELECT COUNT(*) AS total,
           COUNT(*) FILTER (WHERE name NOT IN (SELECT name FROM objects)) AS success,
           COUNT(*) FILTER (WHERE name IN (SELECT name FROM objects)) AS skipped
    FROM named
    """
)
def image_ingest_report(t: Tables) -> DataFrame:
    return image_report(image_links(t))


@query("SELECT COUNT(*) AS objects, CAST(SUM(length(html)) AS BIGINT) AS bytes FROM pages")
def image_stats(t: Tables) -> DataFrame:
    return object_stats(_objects(t))
