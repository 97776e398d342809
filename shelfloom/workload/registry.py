"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfloom.workload.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Register a function of ``Tables`` under its name, with its SQL twin if there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            TWINS[name] = with_views(sql() if callable(sql) else sql)
        return build

    return register


def text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


# Views of the twins, each written over the given tables and the views before it.
VIEWS = {
    "feed_raw": """
        SELECT CAST(p.p_partkey AS VARCHAR) AS id, p.p_name AS title, d.text AS description,
               p.p_brand AS brand, p.p_type AS category, CAST(p.p_size AS VARCHAR) AS size,
               regexp_extract(p.p_name, '^([a-z]+)', 1) AS color, g.url AS link,
               'https://img.example.com/' || lower(p.p_type) || '/'
                 || CAST(p.p_partkey % 50 AS VARCHAR) || '.jpg' AS image_link,
               COALESCE(c.n, 0) AS clicks
        FROM part p
        LEFT JOIN documents d ON d.doc_id = p.p_partkey
        LEFT JOIN pages g ON g.page_id = p.p_partkey
        LEFT JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey) c
          ON c.l_partkey = p.p_partkey""",
    "click_range": """
        SELECT MIN(clicks) AS q0, quantile_disc(clicks, 0.99) AS q99 FROM feed_raw""",
    "feed_filtered": """
        SELECT id, title, description, brand, category, size, color, link, image_link
        FROM feed_raw, click_range
        WHERE clicks BETWEEN q0 + 0.1 * (q99 - q0) AND q0 + 0.9 * (q99 - q0)""",
    "web": r"""
        SELECT CAST(page_id AS VARCHAR) AS id,
          array_to_string(list_filter(
            list_transform(regexp_extract_all(cleaned, '<span[^</span](.*)', 0)
                           || regexp_extract_all(cleaned, '<p[^</p](.*)', 0),
                           lambda x: regexp_extract(x, '(?s)>(.*)<', 1)),
            lambda x: x <> ''), ' ') AS content
        FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(regexp_replace(html, '(?s)<head.*</head>', '', 'g'),
                '<script[^</script].*', '', 'g'), '<svg[^</svg].*', '', 'g'),
                '<path[^</path].*', '', 'g'), '<iframe[^</iframe].*', '', 'g'),
                '<a [^</a].*', '', 'g') AS cleaned
              FROM pages)""",
    "images": """
        SELECT DISTINCT 'gs://b/images/' || regexp_extract(image_link, '[^/]+$') AS uri,
               'image of ' || regexp_extract(image_link, '[^/]+$') AS description
        FROM feed_raw""",
    "prepared": """
        SELECT id, title, description, brand, category, size, color FROM feed_filtered""",
    "item_properties": """
        SELECT id, to_json({'id': id, 'title': title, 'description': description, 'brand': brand,
                            'category': category, 'size': size, 'color': color})::VARCHAR
                   AS properties
        FROM prepared""",
    "examples": """
        SELECT id, to_json({'title': title, 'description': description, 'brand': brand,
                            'category': category, 'size': size, 'color': color})::VARCHAR
                   AS properties, title, description
        FROM feed_raw ORDER BY clicks DESC, id LIMIT 3""",
    "output": """
        SELECT id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description,
               CAST(NULL AS VARCHAR) AS highlights, CAST(0 AS BIGINT) AS tries,
               CAST(NULL AS VARCHAR) AS raw_response_title,
               CAST(NULL AS VARCHAR) AS raw_response_description,
               CAST(NULL AS VARCHAR) AS raw_response_highlights
        FROM feed_filtered""",
    "scoring_feed": """
        SELECT id, title, description, brand, category, size,
               CASE WHEN category = 'PROMO' THEN '' ELSE color END AS color
        FROM feed_raw""",
}


def with_views(sql: str) -> str:
    """Put the views a twin uses in front of it, each one once and after those it reads."""
    used: list[str] = []

    def need(body: str) -> None:
        own = set(re.findall(r"\b(\w+)\s+AS\s+(?:MATERIALIZED\s+)?\(\s*SELECT", body))
        for name, view in VIEWS.items():
            reads = re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*\()", body)
            if reads and name not in used and name not in own:
                need(view)
                used.append(name)

    need(sql)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
