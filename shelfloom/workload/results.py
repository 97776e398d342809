"""Queries that merge, loop, export, score and report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.functions.pages import clean_html, page_text_regex, selected_text
from shelfloom.functions.prompts import load_template
from shelfloom.functions.text import highlight
from shelfloom.generator import ColumnGenerator
from shelfloom.operators import export as X
from shelfloom.operators import merge as M
from shelfloom.operators import quality as Q
from shelfloom.operators import webtext as W
from shelfloom.operators.numbering import chunk, gather_chunks
from shelfloom.operators.prepare import complete_input, restrict_to, unprocessed
from shelfloom.operators.replies import answers, debug_rows
from shelfloom.operators.scoring import Scoring, title_metrics, title_parts, with_item
from shelfloom.plans import enrich, generation, reports
from shelfloom.plans.optimise import optimise
from shelfloom.session import materialise, shared_folder
from shelfloom.sources.ledger import store_bucketed
from shelfloom.sources.records import read_csv
from shelfloom.workload.prompting import (
    ANSWERED,
    BUCKET_CHUNKS,
    CHUNKS,
    EXAMPLE_INPUTS,
    FAILS,
    _batch_sql,
    example_outputs,
    filled,
    sectioned,
)
from shelfloom.workload.registry import VIEWS, query, text
from shelfloom.workload.stub import (
    StoredVectors,
    description_reply,
    line_reply,
    marked_description_reply,
    marked_title_reply,
    stub_generator,
    title_reply,
)
from shelfloom.workload.views import PROPERTIES, Tables

OUTPUT_COLUMNS = [f.name for f in S.OUTPUT.fields if f.name != "updated_at"]


@query("SELECT * FROM output")
def init_output(t: Tables) -> DataFrame:
    return t.output().select(*OUTPUT_COLUMNS)


def _generated(t: Tables, column: str) -> DataFrame:
    """Replies of the stub to the chunks of the whole feed."""
    chunks = gather_chunks(chunk(t.properties(), 10)).select("chunk_id", "ids")
    reply = line_reply(column)
    status = F.when(F.col("reply").isNull(), "quota").otherwise("")
    return chunks.withColumn("mark", F.lit("")).withColumn("reply", reply).withColumn("status", status)


@query(
    f"""
    WITH chunks AS ({CHUNKS.format(size=10, source="item_properties")}),
    got AS (SELECT unnest({ANSWERED}) AS id FROM chunks WHERE NOT ({FAILS}))
    SELECT id, CASE WHEN id IN (SELECT id FROM got) THEN 'Item ' || id || ', new title' END AS title,
           CAST(1 AS BIGINT) AS tries
    FROM output
    """
)
def merge_matched(t: Tables) -> DataFrame:
    results = answers(_generated(t, "title"), "title", "lines")
    return M.merge_matched(t.output(), results, "title").select("id", "title", "tries")


@query(
    f"""
    WITH chunks AS ({CHUNKS.format(size=10, source="item_properties")}),
    replied AS (SELECT ids, CASE WHEN {FAILS} THEN 'ERROR: quota' ELSE array_to_string(
                  list_transform({ANSWERED}, lambda i: i || ': Item ' || i || ', new title'),
                  chr(10)) END AS raw FROM chunks)
    SELECT unnest(ids) AS id, raw AS raw_response_title FROM replied
    """
)
def debug_capture(t: Tables) -> DataFrame:
    raw = debug_rows(_generated(t, "title"))
    return M.capture_raw(t.output(), raw, S.TITLES).select("id", "raw_response_title")


@query(
    """
    SELECT coalesce(o.id, d.id, g.id) AS id, nullif(d.text, '') AS title, g.url AS description,
           CASE WHEN d.id IS NOT NULL OR g.id IS NOT NULL
                THEN coalesce(o.tries, 0) + (d.id IS NOT NULL)::BIGINT + (g.id IS NOT NULL)::BIGINT
                ELSE o.tries END AS tries,
           d.raw AS raw_response_title, g.raw AS raw_response_description
    FROM output o
    FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, lang || '!' AS raw,
                      CASE WHEN lang = 'es' THEN '' ELSE source END AS text FROM documents) d
      ON d.id = o.id
    FULL JOIN (SELECT CAST(conv_id AS VARCHAR) AS id, MIN(role || text) AS raw,
                      MIN(role) AS url FROM conversations GROUP BY conv_id) g
      ON g.id = coalesce(o.id, d.id)
    """
)
def merge_upsert(t: Tables) -> DataFrame:
    """Two targets in one join; conversations bring several results per id."""
    titles = t.read("documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("lang") != "es", F.col("source")).alias("text"),
        F.concat("lang", F.lit("!")).alias("raw"),
    )
    descriptions = t.read("conversations").select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("role").alias("text"),
        F.concat("role", "text").alias("raw"),
    )
    merged = M.upsert(t.output(), {"titles": titles, "descriptions": descriptions})
    return merged.select(
        "id", "title", "description", "tries", "raw_response_title", "raw_response_description"
    )


# Hash buckets of the registered passes: an explicit setting, the same at every size.
BUCKETS = 64


def _line_prompt_sql(target: S.Target) -> str:
    return filled(
        f"{target.column}_lines",
        "English",
        {
            "EXAMPLE_INPUTS": EXAMPLE_INPUTS,
            "EXAMPLE_OUTPUTS": example_outputs(target.example_field),
            "INPUTS": "array_to_string(properties, chr(10))",
        },
    )


def _mark(prompt: str) -> str:
    return f"' #' || substr(md5({prompt}), 1, 8)"


def _passes_sql(prefix: str, start: str, size: int, prompt: str, items: str = "item_properties") -> str:
    """Three passes over the ids of ``start`` (id, used: tries so far) as views.

    ``{prefix}_result`` tells for each id whether it was answered, its tries afterwards and the
    mark of the prompt that was answered.
    """
    views = [f"{prefix}_1 AS ({start})"]
    for k in (1, 2, 3):
        source = (
            f"(SELECT p.id, i.properties FROM {prefix}_{k} p JOIN {items} i ON i.id = p.id"
            " WHERE used < 3)"
        )
        chunks = BUCKET_CHUNKS.format(size=size, buckets=BUCKETS, source=source)
        views.append(f"{prefix}_chunks_{k} AS MATERIALIZED ({chunks})")
        views.append(
            f"{prefix}_got_{k} AS MATERIALIZED (SELECT unnest({ANSWERED}) AS id, {_mark(prompt)} AS mark"
            f" FROM {prefix}_chunks_{k} WHERE NOT ({FAILS}))"
        )
        views.append(
            f"{prefix}_{k + 1} AS MATERIALIZED (SELECT id, used + 1 AS used FROM {prefix}_{k}"
            f" WHERE used < 3 AND id NOT IN (SELECT id FROM {prefix}_got_{k}))"
        )
    got = " UNION ALL ".join(
        f"SELECT g.id, true AS done, p.used + 1 AS tries, g.mark FROM {prefix}_got_{k} g"
        f" JOIN {prefix}_{k} p ON p.id = g.id"
        for k in (1, 2, 3)
    )
    left = " UNION ALL ".join(
        f"SELECT id, false, used, NULL FROM {prefix}_{k} WHERE used >= 3" for k in (1, 2, 3, 4)
    )
    views.append(f"{prefix}_result AS MATERIALIZED ({got} UNION ALL {left})")
    return ",\n".join(views)


_START = "SELECT id, CAST(0 AS BIGINT) AS used FROM output"
_TITLE_PROMPT = _line_prompt_sql(S.TITLES)
_TITLES_SQL = f"""
    WITH {_passes_sql("t", _START, 10, _TITLE_PROMPT)}
    SELECT id, CASE WHEN done THEN 'Item ' || id || ', new title' || mark END AS title, tries FROM t_result
"""


def _stored_feed(t: Tables) -> DataFrame:
    """The filtered feed as a table of its own, from which input and output are made."""
    return materialise(t.filtered().select("id", *PROPERTIES), "filtered")


def _run(t: Tables, target: S.Target, layout: str = "lines", ids=None, **settings) -> DataFrame:
    run = generation.Passes(target=target, layout=layout, **{"buckets": BUCKETS, **settings})
    feed = _stored_feed(t)
    return generation.generate(
        M.init_output(feed),
        feed,
        t.examples(),
        stub_generator(target.column, layout),
        run,
        ids,
    )


@query(_TITLES_SQL)
def generate_titles(t: Tables) -> DataFrame:
    """All passes over the whole feed, ten items per prompt."""
    return _run(t, S.TITLES).select("id", "title", "tries")


@query(
    f"""
    WITH {_passes_sql("t", _START, 4, sectioned(
        "descriptions", "English", "description", "array_to_string(properties, chr(10))"))}
    SELECT id, CASE WHEN done THEN 'All about item ' || id || mark || chr(10) || 'in two lines' END
             AS description, tries FROM t_result
    """
)
def generate_description_blocks(t: Tables) -> DataFrame:
    """All passes with block replies."""
    return _run(t, S.DESCRIPTIONS, "blocks", items_per_prompt=4).select("id", "description", "tries")


@query(
    f"""
    WITH single AS (
      SELECT o.id, [o.id] AS ids, 'Item ' || o.id || ', new title' || {_mark(sectioned(
        "titles", "English", "title", "i.properties || chr(10)"))} AS new_title
      FROM output o JOIN item_properties i ON i.id = o.id)
    SELECT id, CASE WHEN NOT ({FAILS}) THEN new_title END AS title,
           CAST(CASE WHEN {FAILS} THEN 3 ELSE 1 END AS BIGINT) AS tries,
           CASE WHEN {FAILS} THEN 'ERROR: failed'
                WHEN substr(md5(id), 1, 1) IN ('2', '4', '6', '8')
                THEN '**generated title:**' || new_title
                ELSE 'generated title: ' || new_title END AS raw_response_title
    FROM single
    """
)
def generate_single_items(t: Tables) -> DataFrame:
    """One item per prompt, with the raw replies kept."""
    done = _run(t, S.TITLES, "single", debug=True)
    plain = F.replace("raw_response_title", F.lit(":** "), F.lit(":**"))
    return done.select("id", "title", "tries", plain.alias("raw_response_title"))


@query(
    f"""
    WITH asked AS (SELECT id, properties FROM item_properties
                   WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)),
    chunks AS ({BUCKET_CHUNKS.format(size=10, buckets=BUCKETS, source="asked")}),
    got AS (SELECT unnest({ANSWERED}) AS id, {_mark(_TITLE_PROMPT)} AS mark
            FROM chunks WHERE NOT ({FAILS}))
    SELECT o.id, 'Item ' || g.id || ', new title' || mark AS title,
           CAST(o.id IN (SELECT id FROM asked) AS BIGINT) AS tries
    FROM output o LEFT JOIN got g ON g.id = o.id
    """
)
def generate_ids(t: Tables) -> DataFrame:
    """A single pass over explicit ids."""
    ids = t.read("labels").select(F.col("doc_id").cast("string").alias("id"))
    return _run(t, S.TITLES, ids=ids).select("id", "title", "tries")


@query(_TITLES_SQL)
def generate_parts(t: Tables) -> DataFrame:
    """Four parts, each on its own; the buckets lie within the parts, so the result is the same."""
    run = generation.Passes(target=S.TITLES, parts=4, buckets=BUCKETS)
    feed = _stored_feed(t)
    done = generation.generate_parts(
        M.init_output(feed), feed, t.examples(), stub_generator("title", "lines"), run
    )
    return done.select("id", "title", "tries")


VIEWS["completed_properties"] = """
    SELECT p.id, to_json({'id': p.id, 'title': title, 'description': description, 'brand': brand,
                          'category': category, 'size': size, 'color': color, 'image_url': NULL,
                          'webpage_content': w.content})::VARCHAR AS properties
    FROM prepared p LEFT JOIN web w ON w.id = p.id"""

_END_TO_END = f"""
    {_passes_sql("t", _START, 10, _TITLE_PROMPT, "completed_properties")},
    {_passes_sql("d", "SELECT id, tries AS used FROM t_result WHERE tries < 3", 10,
                 _line_prompt_sql(S.DESCRIPTIONS), "completed_properties")}
"""


@query(
    f"""
    WITH {_END_TO_END}
    SELECT r.id, CASE WHEN r.done THEN 'trained_algorithmic_media:"Item ' || r.id || ', new title'
             || r.mark || '"' END AS structured_title,
           CASE WHEN d.done THEN 'trained_algorithmic_media:"All about item ' || r.id || d.mark || '"'
             END AS structured_description
    FROM t_result r LEFT JOIN d_result d ON d.id = r.id
    WHERE r.done OR coalesce(d.done, false)
    """
)
def end_to_end(t: Tables) -> DataFrame:
    """Band, page text, examples, titles, descriptions and the supplemental feed."""
    feed = t.filtered().select("id", *PROPERTIES)
    # Both targets join the input where it lies.
    completed = complete_input(feed.repartition(BUCKETS, "id"), t.web())
    prepared = store_bucketed(completed, f"prepared_{uuid.uuid4().hex}", BUCKETS)
    examples = materialise(t.examples(), "examples")
    output = M.init_output(feed)
    for target in (S.TITLES, S.DESCRIPTIONS):
        output = generation.generate(
            output,
            prepared,
            examples,
            stub_generator(target.column, "lines"),
            generation.Passes(target=target, buckets=BUCKETS),
        )
    return X.supplemental_feed(output, X.Flags(highlights=False))


@query(
    f"""
    WITH {_passes_sql("t", _START, 10, _TITLE_PROMPT)}
    SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE done) AS titles,
           CAST(0 AS BIGINT) AS descriptions, CAST(0 AS BIGINT) AS highlights
    FROM t_result
    """
)
def progress_counts(t: Tables) -> DataFrame:
    return M.progress(_run(t, S.TITLES))


_BATCH = generation.Batch(
    language="Spanish", bucket_name="b", use_images=True, web_done=True,
    targets=("titles", "descriptions"),
)


# Tasks that batch requests are written by: an explicit setting, the same at every size.
BATCH_TASKS = 64


def _batch_input(t: Tables) -> DataFrame:
    """The completed feed, dealt over tasks: rows are small, but each becomes a request with all examples."""
    return complete_input(t.filtered(), t.web(), image_col="image_link").repartition(BATCH_TASKS, "id")


def _batch_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _echo(label: str) -> ColumnGenerator:
    return ColumnGenerator(lambda: F.concat(F.lit(label), F.md5("prompt")))


def _raw_sql(label: str, prompt: str) -> str:
    return (
        "'{\"candidates\":[{\"content\":{\"parts\":[{\"text\":\"" + label
        + f"' || md5({prompt}) || '\"}}]}}}}]}}'"
    )


@query(
    f"""
    WITH t AS ({_batch_sql("titles", "title")}), d AS ({_batch_sql("descriptions", "description")})
    SELECT t.id, md5(t.prompt) AS title, md5(d.prompt) AS description, CAST(2 AS BIGINT) AS tries,
           {_raw_sql("Generated title: ", "t.prompt")} AS raw_response_title
    FROM t JOIN d ON d.id = t.id
    """
)
def batch_roundtrip(t: Tables) -> DataFrame:
    """Request files, replies and merge for two targets."""
    folder = _batch_folder(t, "batch")
    prepared = materialise(_batch_input(t), "completed")
    generation.write_requests(generation.batch_requests(prepared, t.examples(), _BATCH), folder)
    generation.answer_batch(t.spark, folder, "titles", _echo("Generated title: "))
    generation.answer_batch(t.spark, folder, "descriptions", _echo("generated description: "))
    done = generation.load_and_merge(M.empty_output(t.spark), folder, _BATCH.targets)
    return done.select("id", "title", "description", "tries", "raw_response_title")


@query(
    f"""
    WITH t AS ({_batch_sql("titles", "title")}), d AS ({_batch_sql("descriptions", "description")})
    SELECT t.id, md5(t.prompt) AS title, md5(d.prompt) AS description, CAST(2 AS BIGINT) AS tries,
           CAST(NULL AS VARCHAR) AS waiting
    FROM t JOIN d ON d.id = t.id
    """
)
def batch_resume(t: Tables) -> DataFrame:
    """A run resumed with the replies of one target, and again once those of both are there."""
    folder = _batch_folder(t, "resume")
    prepared = materialise(_batch_input(t), "completed")
    generation.write_requests(generation.batch_requests(prepared, t.examples(), _BATCH), folder)
    generation.answer_batch(t.spark, folder, "titles", _echo("generated title: "))
    half = materialise(generation.resume(t.output(), folder, _BATCH), "half")
    generation.answer_batch(t.spark, folder, "descriptions", _echo("generated description: "))
    done = generation.resume(half.withColumn("waiting", F.col("description")), folder, _BATCH)
    return done.select("id", "title", "description", "tries", "waiting")


VIEWS["finished"] = """
    SELECT f.id, CASE WHEN l.quality = 1 THEN 'New "' || f.title || '"' END AS title,
           CASE WHEN l.toxic = 0 THEN f.description END AS description,
           CASE WHEN l.quality = 1 AND l.toxic = 0
                THEN '"' || f.brand || '","' || f.color || '"' END AS highlights
    FROM feed_filtered f LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = f.id"""


def _finished(t: Tables) -> DataFrame:
    """An output table with some texts, as the labels have it."""
    labels = t.read("labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    list_text = F.concat(F.lit('"'), "brand", F.lit('","'), "color", F.lit('"'))
    return t.filtered().join(labels, "id", "left").select(
        "id",
        F.when(good, F.concat(F.lit('New "'), "title", F.lit('"'))).alias("title"),
        F.when(clean, F.col("description")).alias("description"),
        F.when(good & clean, list_text).alias("highlights"),
    )


def _embedded(value: str, flag: str) -> str:
    return (
        f"CASE WHEN {flag} THEN 'trained_algorithmic_media' ELSE '' END || ':\"'"
        f" || replace({value}, '\"', '\"\"') || '\"'"
    )


@query(
    f"""
    SELECT id, {_embedded("title", "true")} AS structured_title,
           {_embedded("description", "true")} AS structured_description,
           'trained_algorithmic_media:' || highlights AS product_highlight
    FROM finished WHERE title IS NOT NULL OR description IS NOT NULL OR highlights IS NOT NULL
    """
)
def export_supplemental(t: Tables) -> DataFrame:
    return X.supplemental_feed(_finished(t))


@query(
    f"""
    SELECT id, {_embedded("title", "true")} AS structured_title,
           {_embedded("description", "true")} AS structured_description
    FROM finished WHERE title IS NOT NULL AND description IS NOT NULL
    """
)
def export_supplemental_complete(t: Tables) -> DataFrame:
    return X.supplemental_feed(_finished(t), X.Flags(highlights=False), mode="all")


_FULL_SQL = f"""
    SELECT r.id, r.brand, r.category, r.size, r.color, r.link, r.image_link, r.clicks,
           {_embedded("coalesce(o.title, r.title)", "o.title IS NOT NULL")} AS structured_title,
           {_embedded("coalesce(o.description, r.description)", "o.description IS NOT NULL")}
             AS structured_description,
           coalesce('trained_algorithmic_media:' || o.highlights, r.color) AS product_highlight
    FROM feed_raw r LEFT JOIN finished o ON o.id = r.id
"""


@query(_FULL_SQL)
def export_full(t: Tables) -> DataFrame:
    raw = t.raw().withColumn("product_highlight", F.col("color"))
    return X.full_feed(raw, _finished(t))


@query(
    f"""
    SELECT r.id, r.description, r.brand, r.category, r.size, r.color, r.link, r.image_link, r.clicks,
           {_embedded("coalesce(o.title, r.title)", "o.title IS NOT NULL")} AS structured_title
    FROM feed_raw r LEFT JOIN finished o ON o.id = r.id
    """
)
def export_selective(t: Tables) -> DataFrame:
    return X.full_feed(t.raw(), _finished(t), X.Flags(description=False, highlights=False))


@query(
    f"""
    SELECT id, {_embedded("title", "true")} AS structured_title,
           {_embedded("description", "true")} AS structured_description,
           'trained_algorithmic_media:' || highlights AS product_highlight
    FROM finished WHERE title IS NOT NULL OR description IS NOT NULL OR highlights IS NOT NULL
    """
)
def export_file(t: Tables) -> DataFrame:
    """The supplemental feed written as a tab-separated file and read back."""
    folder = _batch_folder(t, "export")
    reports.export_feed("supplemental", t.raw(), _finished(t), folder, sep="\t")
    return read_csv(t.spark, folder, sep="\t", breaks=True)


# The structured replies of the stub, as SQL over the scoring feed.
VIEWS["title_replies"] = """
    SELECT *, coalesce(description, '') <> '' AS has_text,
           'product attribute keys in original title: color | Kind' || chr(10)
           || 'product category: ' || category || chr(10)
           || 'product attribute keys: color | Kind | brand | size'
           || CASE WHEN coalesce(description, '') <> '' THEN ' | Material' ELSE '' END || chr(10)
           || 'product attribute values: ' || string_split(title, ' ')[1] || ' | '
           || CASE WHEN category = 'SMALL' THEN 'Kind' ELSE string_split(title, ' ')[2] END
           || ' | ' || brand || ' | Size ' || size
           || CASE WHEN coalesce(description, '') = '' THEN ''
                   WHEN category = 'ECONOMY' THEN ' | steel' ELSE ' |  ' END
           || CASE category WHEN 'SMALL' THEN chr(10) || 'replaced keys: none'
                            WHEN 'LARGE' THEN chr(10) || 'replaced keys: size' ELSE '' END
           || chr(10) || 'generated title: ' || title || ', ' || brand AS title_reply,
           CASE WHEN coalesce(description, '') <> '' THEN
             'description: ' || description || chr(10) || 'score: '
             || CASE WHEN category = 'PROMO' THEN '2.5' ELSE '4' END || chr(10)
             || 'reasoning: follows ' || id
           ELSE 'no description possible' END AS description_reply
    FROM scoring_feed"""

# The word pattern and the labels of the reply contract.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
_HEAD = (
    r"(?ims)^.*product attribute keys in original title:\**(.*)^.*product category:\**(.*)"
    r"^.*product attribute keys:\**(.*)^.*product attribute values:\**(.*)"
)
_WHOLE = _HEAD + r"^.*replaced keys:\**(.*)^.*generated title:\**(.*)$"
_SHORT = _HEAD + r"^.*generated title:\**(.*)$"


def _section(whole: int | None, short: int) -> str:
    tested = f"regexp_matches(title_reply, {text(_WHOLE)})"
    first = f"regexp_extract(title_reply, {text(_WHOLE)}, {whole})"
    second = f"regexp_extract(title_reply, {text(_SHORT)}, {short})"
    return f"trim(CASE WHEN {tested} THEN {first} ELSE {second} END, ' ' || chr(10))"


def _items(section: str, sep: str) -> str:
    return (
        f"list_transform(list_filter(string_split({section}, '{sep}'), lambda x: x <> ''),"
        " lambda x: trim(x))"
    )


VIEWS["title_fields"] = f"""
    SELECT *, {_section(2, 2)} AS reply_category, {_items(_section(1, 1), "|")} AS original_keys,
           {_items(_section(3, 3), "|")} AS reply_keys, {_items(_section(4, 4), "|")} AS reply_values,
           CASE WHEN regexp_matches(title_reply, {text(_WHOLE)})
                THEN list_filter({_items(f"lower(trim(regexp_extract(title_reply, {text(_WHOLE)}, 5), ' ' || chr(10)))", ",")},
                                 lambda x: x <> 'none')
                ELSE [] END AS replaced_keys
    FROM title_replies"""

# Gaps: a missing color, replaced sizes, and an invented material.
VIEWS["title_scores"] = f"""
    SELECT *, CASE WHEN new_count > 0 THEN -1.0 WHEN lost_count > 0 THEN -0.5
                   ELSE ((gap_attributes <> '')::INT + 1) / 2.0 END AS title_score
    FROM (
      SELECT *, len(new_list) AS new_count, len(lost_list) AS lost_count,
             array_to_string(new_list, ' | ') AS new_words_added,
             array_to_string(lost_list, ' | ') AS words_removed
      FROM (
        SELECT *,
          list_distinct(list_filter(regexp_extract_all(replace(title_generated, '''s', ''), '{_LETTERS}'),
            lambda w: NOT list_contains(known, lower(w)))) AS new_list,
          list_distinct(list_filter(regexp_extract_all(replace(title, '''s', ''), '{_LETTERS}'),
            lambda w: NOT list_contains(list_transform(regexp_extract_all(
                        replace(title_generated, '''s', ''), '{_LETTERS}'), lambda x: lower(x)), lower(w))
                      AND NOT contains(replace(title_generated, '''', ''), w))) AS lost_list
        FROM (
          SELECT *,
            CASE WHEN color = '' THEN string_split(title, ' ')[1] ELSE color END
              || CASE WHEN category = 'SMALL' THEN '' ELSE ' ' || string_split(title, ' ')[2] END
              || ' ' || brand || ' ' || size
              || CASE WHEN has_text AND category = 'ECONOMY' THEN ' steel' ELSE '' END
              AS title_generated,
            '<color>' || CASE WHEN category = 'SMALL' THEN '' ELSE ' <Kind>' END || ' <brand> <size>'
              || CASE WHEN has_text AND category = 'ECONOMY' THEN ' <Material>' ELSE '' END
              AS generated_template,
            '<brand> <size>' || CASE WHEN has_text AND category = 'ECONOMY' THEN ' <Material>' ELSE '' END
              AS added_attributes,
            CASE WHEN category = 'SMALL' THEN '<Kind>' ELSE '' END AS removed_attributes,
            CASE WHEN color = '' THEN '{{"color":"' || string_split(title, ' ')[1] || '"}}'
                 WHEN category = 'LARGE' THEN '{{"size":"Size ' || size || '"}}'
                 WHEN has_text AND category = 'ECONOMY' THEN '{{"Material":"steel"}}'
                 ELSE '' END AS gap_attributes,
            list_transform(regexp_extract_all(replace(
              'id ' || id || ' title ' || title || ' description ' || coalesce(description, '')
              || ' brand ' || brand || ' category ' || category || ' size ' || size || ' color '
              || color, '''s', ''), '{_LETTERS}'), lambda x: lower(x)) || %ALLOWED% AS known
          FROM title_replies)))"""
VIEWS["title_scores"], VIEWS["title_scores_allowed"] = (
    VIEWS["title_scores"].replace("%ALLOWED%", allowed) for allowed in ("['none']", "['steel']")
)


# Tasks of the scoring queries: an explicit setting, the same at every size.
TASKS = 32


def _replied(t: Tables) -> DataFrame:
    items = with_item(t.scoring_feed()).repartition(TASKS, "id")
    return items.withColumn("title_reply", title_reply())


@query(
    """
    SELECT id, reply_category AS category, array_to_string(original_keys, '|') AS original_keys,
           array_to_string(reply_keys, '|') AS keys, array_to_string(reply_values, '|') AS vals,
           array_to_string(replaced_keys, '|') AS replaced
    FROM title_fields
    """
)
def title_attributes(t: Tables) -> DataFrame:
    """The fields of the structured replies and their lists."""
    from shelfloom.functions.parsing import parse_title_reply
    from shelfloom.functions.text import split_keys, split_list

    fields = _replied(t).select("id", parse_title_reply(F.col("title_reply")).alias("r"))
    return fields.select(
        "id",
        "r.category",
        F.array_join(split_list(F.col("r.original_keys")), "|").alias("original_keys"),
        F.array_join(split_list(F.col("r.keys")), "|").alias("keys"),
        F.array_join(split_list(F.col("r.values")), "|").alias("vals"),
        F.array_join(split_keys(F.col("r.replaced_keys")), "|").alias("replaced"),
    )


_SCORE_COLUMNS = """
    id, title_generated, gap_attributes, new_words_added, words_removed, added_attributes,
    removed_attributes, CAST(title_score AS DOUBLE) AS title_score
"""


@query(f"SELECT {_SCORE_COLUMNS} FROM title_scores_allowed")
def title_scores(t: Tables) -> DataFrame:
    """Composed titles, gaps, word and attribute changes and scores, one allowed word given."""
    from shelfloom.functions.attributes import render_template

    settings = Scoring(allowed_words=("Steel",))
    scored = title_metrics(title_parts(_replied(t), settings), settings)
    return scored.select(
        "id",
        "title_generated",
        F.when(F.size("gaps") > 0, F.to_json("gaps")).otherwise("").alias("gap_attributes"),
        F.array_join("new_words", " | ").alias("new_words_added"),
        F.array_join("removed_words", " | ").alias("words_removed"),
        render_template(F.col("added_keys")).alias("added_attributes"),
        render_template(F.col("removed_keys")).alias("removed_attributes"),
        "title_score",
    )


_STRUCTURED = r"(?ims).*description:\**(.*)\n+.*score:\**(.*)\n+.*reasoning:\**(.*)"
VIEWS["records"] = f"""
    SELECT
      CASE WHEN ok THEN score >= 0 AND description_score >= 3 END AS approval,
      CASE WHEN ok THEN status
           ELSE 'Failed. Check the ''Full API Response'' column for details.' END AS status,
      id, CASE WHEN ok THEN title_generated END AS title_generated,
      CASE WHEN ok THEN title END AS title_original,
      CASE WHEN ok THEN CASE WHEN score = -0.5 THEN '-0.5' WHEN score = 0.5 THEN '0.5'
                             ELSE CAST(CAST(score AS INT) AS VARCHAR) END END AS score,
      CASE WHEN ok THEN CASE WHEN title_score <> 0 THEN 'true' ELSE 'false' END END AS title_changed,
      CASE WHEN ok THEN CAST(length(title_generated) AS VARCHAR) END AS title_length,
      CASE WHEN ok THEN new_words_added END AS new_words_added,
      CASE WHEN ok THEN words_removed END AS words_removed,
      CASE WHEN ok THEN '<color> <Kind>' END AS original_template,
      CASE WHEN ok THEN generated_template END AS generated_template,
      CASE WHEN ok THEN added_attributes END AS added_attributes,
      CASE WHEN ok THEN removed_attributes END AS removed_attributes,
      CASE WHEN ok THEN gap_attributes END AS gap_attributes,
      CASE WHEN ok THEN description_generated END AS description_generated,
      CASE WHEN ok THEN description END AS description_original,
      CASE WHEN ok THEN description_generated <> description END AS description_changed,
      CASE WHEN ok THEN CAST(length(description_generated) AS VARCHAR) END AS description_length,
      CASE WHEN ok THEN description_score END AS description_score,
      CASE WHEN ok THEN category END AS category,
      CASE WHEN ok THEN 'prompt ' || md5('Title it. Context: ' || item || chr(10) || chr(10)) || chr(10)
             || title_reply || chr(10) || 'Product description: ' || description_generated
             || chr(10) || 'Description evaluation: Score: '
             || CASE WHEN description_score = 4 THEN '4' ELSE '2.5' END || chr(10) || 'follows ' || id
             || ' ' || second_mark
           ELSE 'Incomplete description reply: no description possible ' || second_mark END
        AS full_response,
      CASE WHEN ok THEN item END AS original_input
    FROM (SELECT *, md5('Describe it. Context: {{"Generated Title":' || to_json(title_generated)::VARCHAR
                        || ',' || substr(item, 2) || chr(10) || chr(10)) AS second_mark
    FROM (SELECT *, to_json({{'id': id, 'title': title, 'description': coalesce(description, ''),
             'brand': brand, 'category': category, 'size': size, 'color': color}})::VARCHAR AS item
    FROM (SELECT *, CASE WHEN status = 'Success' THEN title_score ELSE -1 END AS score
          FROM (SELECT *, CASE WHEN length(title_generated) BETWEEN 1 AND 150
                                AND length(description_generated) BETWEEN 1 AND 5000
                               THEN 'Success' ELSE 'Failed compliance checks' END AS status
                FROM (SELECT *, regexp_matches(description_reply, '{_STRUCTURED}') AS ok,
                             trim(regexp_extract(description_reply, '{_STRUCTURED}', 1),
                                  ' ' || chr(10) || chr(9)) AS description_generated,
                             TRY_CAST(trim(regexp_extract(description_reply, '{_STRUCTURED}', 2))
                                      AS DOUBLE) AS description_score
                      FROM title_scores)))))"""

_RECORD_SETTINGS = Scoring(min_title_score=0, min_description_score=3)


def _records(t: Tables) -> DataFrame:
    return optimise(
        t.scoring_feed(),
        ColumnGenerator(marked_title_reply),
        ColumnGenerator(marked_description_reply),
        _RECORD_SETTINGS,
        title_wording="Title it. ",
        description_wording="Describe it. ",
        tasks=TASKS,
    )


@query("SELECT * FROM records")
def generated_records(t: Tables) -> DataFrame:
    """Titles and descriptions of the whole feed, scored, checked and approved."""
    return _records(t)


@query(
    """
    SELECT id, length(coalesce(description, '')) BETWEEN 1 AND 5000 AS approval,
           CASE WHEN length(coalesce(description, '')) BETWEEN 1 AND 5000
                THEN 'Success' ELSE 'Failed compliance checks' END AS status,
           title AS title_generated,
           CASE WHEN length(coalesce(description, '')) BETWEEN 1 AND 5000 THEN '1' ELSE '-1' END
             AS score, '[]' AS added_attributes, coalesce(description, '') AS description_generated,
           CAST(-1 AS DOUBLE) AS description_score
    FROM scoring_feed
    """
)
def records_without_generation(t: Tables) -> DataFrame:
    """Both kinds of generation switched off: the compliance check of the feed as it is."""
    off = Scoring(titles=False, descriptions=False)
    done = optimise(t.scoring_feed(), ColumnGenerator(title_reply), ColumnGenerator(description_reply), off)
    return done.select(
        "id", "approval", "status", "title_generated", "score", "added_attributes",
        "description_generated", "description_score",
    )


_STATUS = """
    SELECT CAST(doc_id AS VARCHAR) AS id,
           CASE WHEN quality = 1 THEN 'Success' WHEN toxic = 1 THEN 'Failed'
                ELSE 'Failed compliance checks' END AS status FROM labels
"""


def _status(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("quality") == 1, "Success")
        .when(F.col("toxic") == 1, "Failed")
        .otherwise("Failed compliance checks")
    )
    return t.read("labels").select(F.col("doc_id").alias("id"), status.alias("status"))


@query(
    f"""
    SELECT id, title FROM feed_raw
    WHERE id NOT IN (SELECT id FROM ({_STATUS}) WHERE status <> 'Failed')
    """
)
def unprocessed_rows(t: Tables) -> DataFrame:
    return unprocessed(t.raw(), _status(t)).select("id", "title")


@query(
    f"""
    SELECT id, status, status = 'Failed compliance checks' OR id IN (SELECT id FROM prepared)
             AS approval
    FROM ({_STATUS})
    """
)
def approve_rows(t: Tables) -> DataFrame:
    rows = _status(t).withColumn("id", F.col("id").cast("string"))
    marked = rows.join(t.prepared().select("id", F.lit(True).alias("approval")), "id", "left")
    first = marked.withColumn("approval", F.coalesce("approval", F.lit(False)))
    return X.approve_where(first, "status = 'Failed compliance checks'")


_APPROVED_SQL = """
    SELECT id AS "Item ID", title_generated AS "Title", description_generated AS "Description",
           coalesce(gap_attributes->>'$.color', '') AS color,
           coalesce(gap_attributes->>'$.size', '') AS size,
           coalesce(gap_attributes->>'$.Material', '') AS "new-Material"
    FROM (SELECT id, title_generated, description_generated,
                 CASE WHEN gap_attributes = '' THEN '{}' ELSE gap_attributes END AS gap_attributes
          FROM records WHERE approval OR status = 'Success')
"""


# What the feed of approved rows reads of the records; the others hold their texts up to three times more.
_FEED_COLUMNS = (
    "id", "approval", "title_generated", "description_generated", "gap_attributes", "original_input",
)


@query(_APPROVED_SQL)
def approved_feed(t: Tables) -> DataFrame:
    """Compliant and approved rows, with one column per filled or invented attribute."""
    rows = X.approve_where(_records(t), "status = 'Success'").select(*_FEED_COLUMNS)
    rows = materialise(rows, "records")
    return X.approved_feed(rows).drop("modified")


@query(
    """
    SELECT key, key <> 'Material' AS in_input, MIN(id) AS first_id
    FROM (SELECT id, regexp_extract(gap_attributes, '"([^"]+)"', 1) AS key FROM records
          WHERE gap_attributes <> '')
    GROUP BY key
    """
)
def attribute_keys(t: Tables) -> DataFrame:
    keys = X.attribute_keys(_records(t))
    return keys.select("key", "in_input", F.col("first._at").alias("first_id"))


@query(
    """
    SELECT id, regexp_extract(gap_attributes, '"([^"]+)":"([^"]*)"', 1) AS key,
           regexp_extract(gap_attributes, '"([^"]+)":"([^"]*)"', 2) AS value
    FROM records WHERE approval AND gap_attributes <> ''
    """
)
def approved_attributes(t: Tables) -> DataFrame:
    return X.approved_long(_records(t))


@query("SELECT * FROM web")
def page_texts_by_line(t: Tables) -> DataFrame:
    return t.pages().select("id", page_text_regex(F.col("html")).alias("content"))


def _clean(expression: str) -> str:
    """Tags removed, entities read and white space collapsed."""
    plain = f"regexp_replace({expression}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = f"regexp_replace({plain}, '{entity}?', '{char}', 'g')"
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"


@query(
    rf"""
    SELECT CAST(page_id AS VARCHAR) AS id,
           {_clean("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
           {_clean('''array_to_string(regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1), ' ')''')}
             AS ads
    FROM pages
    """
)
def page_texts_by_selector(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages().select(
        "id",
        selected_text(html, "article h1").alias("heading"),
        selected_text(html, "div.ad").alias("ads"),
    )


@query()
def page_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of articles; unclosed ones nest, which a pattern cannot tell."""
    return W.extract_by_selector(t.pages(), "article p")


@query(
    """
    SELECT COUNT(*) AS total, COUNT(html) AS success,
           COUNT(*) FILTER (WHERE html LIKE '%<div class="ad">%') AS extracted,
           COUNT(*) FILTER (WHERE html NOT LIKE '%<div class="ad">%') AS failed
    FROM pages
    """
)
def page_report(t: Tables) -> DataFrame:
    return reports.page_texts(t.pages(), "div.ad")[1]


_CLEANED = """
    regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')
"""


@query(f"SELECT CAST(page_id AS VARCHAR) AS id, {_CLEANED} AS html FROM pages")
def cleaned_pages(t: Tables) -> DataFrame:
    return t.pages().select("id", clean_html(F.col("html"), None).alias("html"))


@query(
    lambda: f"""
    SELECT {text(load_template("selector"))} || string_agg('--- Page ' || n || ' ---' || chr(10)
             || {_CLEANED} || chr(10) || chr(10), '' ORDER BY n) AS prompt
    FROM (SELECT html, ROW_NUMBER() OVER (ORDER BY page_id) AS n
          FROM (SELECT page_id, html FROM pages WHERE html IS NOT NULL ORDER BY md5('0|' || page_id), page_id LIMIT 5))
    """
)
def selector_prompt(t: Tables) -> DataFrame:
    """The request for a selector; five sample pages are what it shows to the model."""
    return W.selector_prompt(load_template("selector"), t.read("pages"))


@query(
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT ceil(round(d, 6) * 10) / 10 AS distance_bucket, COUNT(*) AS items
    FROM (SELECT 1 - list_dot_product(a.e, b.e)
                     / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d
          FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
          WHERE CAST(a.vec_id AS VARCHAR) IN (SELECT id FROM feed_raw))
    GROUP BY 1 ORDER BY 1
    """
)
def similarity_histogram(t: Tables) -> DataFrame:
    """Distances between the vectors of each item and of its neighbour, over the whole feed."""
    vectors = t.read("embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").alias("vec")
    )
    texts = restrict_to(t.raw().select("id", F.col("title").alias("content")), t.raw())
    pairs = Q.pair_vectors(
        StoredVectors(vectors).embed(texts), StoredVectors(vectors, 1).embed(texts)
    )
    return Q.similarity_histogram(Q.distances(pairs), digits=6)


@query(
    """
    SELECT id, title, CASE WHEN category = 'PROMO' THEN 'summer'
                           WHEN link IS NOT NULL THEN 'N/A' ELSE 'season of ' || id END AS season
    FROM feed_raw
    """
)
def enrich_attribute(t: Tables) -> DataFrame:
    """One attribute for the whole feed; values that are there stay, missing replies show."""
    known = F.when(F.col("category") == "PROMO", "summer").otherwise("")
    feed = t.raw().withColumn("season", known)
    lines = enrich.attribute_requests(feed, "id", "title", "description", "season", "English")
    request = F.get_json_object("value", "$.request")
    asked = lines.select(request.alias("request"), enrich.id_from_request(request).alias("id"))
    answered = asked.join(feed.select("id", "link"), "id")
    reply = F.when(F.col("link").isNull(), F.concat(F.lit("season of "), "id"))
    payload = F.to_json(enrich.candidates_payload(reply))
    line = F.concat(
        F.lit('{"request":'), "request", F.lit(',"response":'), payload, F.lit(',"status":""}')
    )
    replies = enrich.read_attribute_replies(answered.select(line.alias("value")))
    values = enrich.attribute_values(replies, "id", "season")
    return enrich.merge_attribute(feed.select("id", "title", "season"), values, "id", "season")


@query(
    """
    SELECT item_id, 'trained_algorithmic_media:' || text AS highlight FROM benchmark
    """
)
def highlights(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", highlight(F.col("text")).alias("highlight"))


@query(
    """
    SELECT id, title, description, CASE WHEN left(md5(id), 1) < '8' THEN 'warm' ELSE 'N/A' END AS tone
    FROM feed_raw
    """
)
def enrich_job(t: Tables) -> DataFrame:
    """The attribute job as a whole, with a model that leaves some requests unanswered."""
    number = enrich.id_from_request(F.get_json_object("prompt", "$.request"))
    model = ColumnGenerator(lambda: F.when(F.left(F.md5(number), F.lit(1)) < "8", "warm"))
    feed = t.raw().select("id", "title", "description")
    return enrich.enrich(feed, model, "id", "title", "description", "tone", "English")


@query(
    f"""
    SELECT id, {_embedded("title", "title IS NOT NULL")} AS structured_title
    FROM finished WHERE title IS NOT NULL
    """
)
def sql_functions(t: Tables) -> DataFrame:
    """The feed function called from SQL."""
    from shelfloom.functions.sql import register_functions

    register_functions(t.spark)
    return t.spark.sql(
        "SELECT id, embed_for_feed(title, true) AS structured_title FROM {rows} WHERE title IS NOT NULL",
        rows=_finished(t),
    )
