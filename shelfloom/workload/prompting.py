"""Queries that build prompts and requests and read replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.functions import envelopes as E
from shelfloom.functions import parsing as R
from shelfloom.functions import prompts as P
from shelfloom.functions import text as X
from shelfloom.operators.examples import example_blocks
from shelfloom.operators.numbering import chunk, gather_chunks
from shelfloom.operators.replies import explode_replies, first_answer, parsed_entries
from shelfloom.operators.scoring import with_item
from shelfloom.plans import generation as G
from shelfloom.plans.enrich import attribute_requests
from shelfloom.plans.optimise import description_prompts, title_prompts, with_landing_page
from shelfloom.session import materialise
from shelfloom.workload.registry import query, text
from shelfloom.workload.stub import answered, block_reply, fails, line_reply, single_reply
from shelfloom.workload.views import Tables

EXAMPLE_INPUTS = "(SELECT string_agg(properties, chr(10) ORDER BY id) FROM examples)"


def example_outputs(field: str) -> str:
    return (
        f"(SELECT string_agg(coalesce(id || ': ' || {field}, ''), chr(10) ORDER BY id)"
        " FROM examples)"
    )


def filled(template: str, language: str, slots: dict[str, str]) -> str:
    """A template as an SQL expression."""
    parts = P.pieces(P.load_template(template), language)
    return " || ".join(text(v) if kind == "text" else slots[v] for kind, v in parts)


def sectioned(template: str, language: str, field: str, inputs: str) -> str:
    """A sectioned prompt as an SQL expression."""
    wording = P.load_template(template).replace("{{LANGUAGE}}", language)
    head = text(f"## System Instructions\n\n{wording}\n\n## Examples\n\n")
    turns = (
        "(SELECT string_agg('**User:**' || chr(10) || properties || chr(10) || chr(10)"
        f" || '**Model:**' || chr(10) || {field}, chr(10) || chr(10) ORDER BY id) FROM examples)"
    )
    return f"{head} || {turns} || {text(chr(10) * 2 + '## Input' + chr(10) * 2)} || {inputs}"


# Chunks over the whole table in order of id, and within hash buckets.
CHUNKS = """
    SELECT (row_id // {size}) AS chunk_id, list(id ORDER BY id) AS ids,
           list(properties ORDER BY id) AS properties
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY id) - 1 AS row_id FROM {source}) GROUP BY 1
"""
BUCKET_CHUNKS = """
    SELECT (row_id // {size}) * {buckets} + bucket AS chunk_id, list(id ORDER BY id) AS ids,
           list(properties ORDER BY id) AS properties
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bucket ORDER BY id) - 1 AS row_id
          FROM (SELECT *, ('0x' || substr(md5(id), 1, 8))::BIGINT % {buckets} AS bucket
                FROM {source}))
    GROUP BY 1
"""


def _chunk_query(t: Tables, target: S.Target, language: str, size: int, buckets: int | None):
    chunks = gather_chunks(chunk(t.properties(), size, buckets))
    prompt = P.chunk_prompt(target, language, example_blocks(t.examples()), F.col("properties"))
    return chunks.select("chunk_id", F.array_join("ids", ",").alias("ids"), prompt.alias("prompt"))


def _chunk_sql(template: str, field: str, language: str, chunks: str) -> str:
    prompt = filled(
        template,
        language,
        {
            "EXAMPLE_INPUTS": EXAMPLE_INPUTS,
            "EXAMPLE_OUTPUTS": example_outputs(field),
            "INPUTS": "array_to_string(properties, chr(10))",
        },
    )
    return f"""
    WITH chunks AS ({chunks})
    SELECT chunk_id, array_to_string(ids, ',') AS ids, {prompt} AS prompt FROM chunks
    """


@query(_chunk_sql("title_lines", "title", "German", CHUNKS.format(size=10, source="item_properties")))
def chunk_prompts(t: Tables) -> DataFrame:
    return _chunk_query(t, S.TITLES, "German", 10, None)


@query(
    _chunk_sql(
        "description_lines", "description", "English",
        BUCKET_CHUNKS.format(size=5, buckets=8, source="item_properties"),
    )
)
def chunk_prompts_bucketed(t: Tables) -> DataFrame:
    return _chunk_query(t, S.DESCRIPTIONS, "English", 5, 8)


@query(
    f"""
    WITH chunks AS ({CHUNKS.format(size=4, source="item_properties")})
    SELECT chunk_id,
           {sectioned("descriptions", "French", "description",
                      "array_to_string(properties, chr(10))")} AS prompt
    FROM chunks
    """
)
def sectioned_prompts(t: Tables) -> DataFrame:
    chunks = gather_chunks(chunk(t.properties(), 4))
    prompt = P.sectioned_prompt(
        S.DESCRIPTIONS, "French", example_blocks(t.examples()), P.lines(F.col("properties"))
    )
    return chunks.select("chunk_id", prompt.alias("prompt"))


@query(
    f"""
    WITH chunks AS (
      SELECT (row_id // 3) AS chunk_id, list(properties || chr(10) || note ORDER BY id) AS products
      FROM (SELECT f.id, p.properties, coalesce('image_url: gs://b/images/'
                     || string_split(f.image_link, '/')[-1], '') AS note,
                   ROW_NUMBER() OVER (ORDER BY f.id) - 1 AS row_id
            FROM feed_filtered f JOIN item_properties p ON p.id = f.id)
      GROUP BY 1)
    SELECT chunk_id, {sectioned("titles", "French", "title",
                                "array_to_string(products, chr(10) || chr(10))")} AS prompt
    FROM chunks
    """
)
def product_prompts(t: Tables) -> DataFrame:
    """Several items per prompt, each with a note on its image."""
    notes = t.filtered().select(
        "id",
        F.concat(F.lit("image_url: "), X.image_uri(F.col("image_link"), "b")).alias("note"),
    )
    rows = t.properties().join(notes, "id").select(
        "id",
        F.struct("properties", F.coalesce("note", F.lit("")).alias("image_info")).alias("properties"),
    )
    chunks = gather_chunks(chunk(rows, 3))
    prompt = P.sectioned_prompt(
        S.TITLES, "French", example_blocks(t.examples()), P.products_with_images(F.col("properties"))
    )
    return chunks.select("chunk_id", prompt.alias("prompt"))


_BATCH_INPUT = """
    to_json({'title': f.title, 'description': f.description, 'brand': f.brand,
             'category': f.category, 'size': f.size, 'color': f.color, 'link': f.link,
             'image_link': f.image_link})::VARCHAR || chr(10)
    || 'image_url: gs://b/images/' || string_split(f.image_link, '/')[-1] || chr(10)
    || CASE WHEN w.content <> '' THEN 'webpage_content: ' || w.content || chr(10) ELSE '' END
"""


def _batch_sql(name: str, field: str) -> str:
    return f"""
    SELECT '{name}' AS target, f.id, {sectioned(name, "Spanish", field, _BATCH_INPUT)} AS prompt
    FROM feed_filtered f LEFT JOIN web w ON w.id = f.id
    """


def _completed(t: Tables) -> DataFrame:
    from shelfloom.operators.prepare import complete_input

    return complete_input(t.filtered(), t.web(), image_col="image_link")


_SETTINGS = G.Batch(
    language="Spanish", targets=("titles", "descriptions", "highlights"), bucket_name="b",
    use_images=True, web_done=True,
)


@query(
    " UNION ALL ".join(
        [
            _batch_sql("titles", "title"),
            _batch_sql("descriptions", "description"),
            _batch_sql("highlights", "description"),
        ]
    )
)
def batch_prompts(t: Tables) -> DataFrame:
    block = example_blocks(t.examples())
    completed = materialise(_completed(t), "completed")
    prompts = [
        G.batch_prompts(completed, block, S.TARGETS[name], _SETTINGS).select(
            F.lit(name).alias("target"), "id", "prompt"
        )
        for name in _SETTINGS.targets
    ]
    return prompts[0].unionByName(prompts[1]).unionByName(prompts[2])


@query(
    f"""
    WITH p AS ({_batch_sql("titles", "title")})
    SELECT id, to_json({{'id': id, 'request': {{'contents': [{{'role': 'user',
             'parts': [{{'text': prompt}}]}}]}}}})::VARCHAR AS contents,
           to_json({{'custom_id': id, 'request': {{'messages': [{{'role': 'user',
             'content': prompt}}], 'version': 'v1', 'max_tokens': 1000}}}})::VARCHAR AS messages,
           to_json({{'instances': [{{'prompt': prompt}}], 'parameters': {{'temperature': 0.5::DOUBLE,
             'maxOutputTokens': 100}}}})::VARCHAR AS predict
    FROM p
    """
)
def batch_requests(t: Tables) -> DataFrame:
    """One prompt per item in the three request shapes."""
    prompts = G.batch_prompts(_completed(t), example_blocks(t.examples()), S.TITLES, _SETTINGS)
    prompt = F.col("prompt")
    return prompts.select(
        "id",
        E.batch_request(F.col("id"), prompt, E.request_shape("other")).alias("contents"),
        E.batch_request(F.col("id"), prompt, "messages", {"version": "v1"}).alias("messages"),
        E.predict_request(prompt, E.Params(0.5, 100)).alias("predict"),
    )


@query(
    """
    SELECT id, '{"contents":{"role":"user","parts":[{"text":' || to_json(title)::VARCHAR || '}'
      || CASE WHEN size > '5' THEN ',{"fileData":{"mimeType":"image/png","fileUri":"gs://b/'
                || id || '"}}'
              WHEN link IS NOT NULL THEN ',{"inlineData":{"mimeType":"image/jpeg","data":"'
                || base64(encode(color)) || '"}}' ELSE '' END
      || ']},"generationConfig":{"temperature":0.1,"maxOutputTokens":2048},"safetySettings":['
      || '{"category":"HARM_CATEGORY_DANGEROUS_CONTENT","threshold":"BLOCK_ONLY_HIGH"},'
      || '{"category":"HARM_CATEGORY_HARASSMENT","threshold":"BLOCK_ONLY_HIGH"},'
      || '{"category":"HARM_CATEGORY_HATE_SPEECH","threshold":"BLOCK_ONLY_HIGH"},'
      || '{"category":"HARM_CATEGORY_SEXUALLY_EXPLICIT","threshold":"BLOCK_ONLY_HIGH"}]}' AS request
    FROM feed_raw
    """
)
def multimodal_requests(t: Tables) -> DataFrame:
    """Images by reference, inline, or none at all."""
    stored = F.concat(F.lit("gs://b/"), "id")
    uri = F.when(F.col("size") > "5", stored).otherwise(F.col("link"))
    request = E.multimodal_request(
        F.col("title"), uri, F.encode("color", "utf-8"), F.lit("image/jpeg")
    )
    return t.raw().select("id", request.alias("request"))


@query(
    lambda: f"""
    SELECT to_json({{'request': {{'contents': [{{'role': 'user', 'parts': [
             {{'text': {text(P.attribute_instructions("season", "English", "when it's worn"))}}},
             {{'text': 'Title: ' || title}}, {{'text': 'Id: ' || id}},
             {{'text': 'Description: ' || coalesce(description, '')}}]}}],
             'generationConfig': {{'temperature': 0.9::DOUBLE}}}}}})::VARCHAR AS value
    FROM feed_raw
    """
)
def attribute_request_lines(t: Tables) -> DataFrame:
    return attribute_requests(
        t.raw(), "id", "title", "description", "season", "English", "when it's worn"
    )


_ITEM_JSON = """
    to_json({'id': f.id, 'title': f.title, 'description': coalesce(f.description, ''),
             'brand': f.brand, 'category': f.category, 'size': f.size, 'color': f.color,
             'link': coalesce(f.link, ''), 'image_link': f.image_link})::VARCHAR
"""


@query(
    f"""
    SELECT f.id, 'Title it. Context: ' || {_ITEM_JSON} || chr(10) || chr(10)
             || CASE WHEN w.content <> '' THEN 'Website: ' || w.content || chr(10) || chr(10)
                     ELSE '' END AS title_prompt,
           'Describe it. Context: {{"Generated Title":' || to_json(upper(f.title))::VARCHAR || ','
             || substr({_ITEM_JSON}, 2) || chr(10) || chr(10)
             || CASE WHEN w.content <> '' THEN 'Website: ' || w.content || chr(10) || chr(10)
                     ELSE '' END AS description_prompt
    FROM feed_filtered f
    LEFT JOIN (SELECT g.url, MIN(w.content) AS content
               FROM pages g JOIN web w ON w.id = CAST(g.page_id AS VARCHAR) GROUP BY g.url) w
      ON w.url = f.link
    """
)
def context_prompts(t: Tables) -> DataFrame:
    pages = t.read("pages").select("url", "html", F.lit("text/html").alias("content_type"))
    feed = t.filtered()
    paged = with_landing_page(feed, pages, "link")
    items = with_item(paged, columns=feed.columns, keep=("page_info",))
    titled = title_prompts(items, "Title it. ").withColumnRenamed("prompt", "title_prompt")
    ready = titled.withColumn("title_generated", F.upper("title_original"))
    return description_prompts(ready, "Describe it. ").select(
        "id", "title_prompt", F.col("prompt").alias("description_prompt")
    )


def _reply_lines(t: Tables) -> DataFrame:
    """Reply lines of a batch over the documents, with every kind of irregularity.

    The label of a document decides how its record looks: the id at the top, under ``instance`` or
    as ``custom_id``; the payload as an object, as an encoded string, empty, or cut off.
    """
    rows = t.read("documents").join(t.read("labels"), "doc_id", "left")
    key = F.col("doc_id").cast("string")
    part = F.array(F.struct(F.col("text")))
    content = F.struct(part.alias("parts"))
    full = F.to_json(F.struct(F.array(F.struct(content.alias("content"))).alias("candidates")))
    quoted = F.to_json(F.struct(full.alias("prediction")))
    lang = F.col("lang")
    record = (
        F.when(lang == "de", F.concat(F.lit('{"instance":{"id":"'), key, F.lit('"},"response":'), full, F.lit("}")))
        .when(lang == "fr", F.concat(F.lit('{"custom_id":"'), key, F.lit('",'), F.substr(quoted, F.lit(2))))
        .when(lang == "es", F.concat(F.lit('{"id":"'), key, F.lit('","response":{"candidates":[]}}')))
        .when(F.col("quality") == 0, F.concat(F.lit('{"id":"'), key, F.lit('","response":{"cand')))
        .otherwise(F.concat(F.lit('{"id":"'), key, F.lit('","response":'), full, F.lit("}")))
    )
    return rows.select(record.alias("value"))


@query(
    """
    SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN d.lang = 'es' THEN '' ELSE d.text END AS text,
           CASE WHEN d.lang = 'es' THEN 'N/A' ELSE d.text END AS answer
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE NOT (d.lang NOT IN ('de', 'fr', 'es') AND coalesce(l.quality, 1) = 0)
    """
)
def decode_replies(t: Tables) -> DataFrame:
    lines = _reply_lines(t).select(
        E.decode_candidates(F.col("value")).alias("r"),
        E.decode_candidates(F.col("value"), "N/A")["text"].alias("answer"),
    )
    return lines.where("r.readable").select("r.id", "r.text", "answer")


@query(
    """
    SELECT COUNT(*) AS bad FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE d.lang NOT IN ('de', 'fr', 'es') AND l.quality = 0
    """
)
def unreadable_replies(t: Tables) -> DataFrame:
    from shelfloom.sources.records import bad_lines

    return bad_lines(_reply_lines(t)).agg(F.count(F.lit(1)).alias("bad"))


@query(
    """
    SELECT conv_id, turn,
           CASE WHEN role <> 'system' THEN nullif(replace(text, chr(10), ''), '') END AS text,
           CASE WHEN role = 'system' THEN 'blocked by safety filters' END AS error
    FROM conversations
    """
)
def decode_streams(t: Tables) -> DataFrame:
    """Turns as replies streamed line by line; those of the system count as blocked."""
    reason = F.when(F.col("role") == "system", "SAFETY").otherwise("STOP")

    def piece(line):
        part = F.array(F.struct(line.alias("text")))
        candidate = F.struct(
            reason.alias("finishReason"), F.struct(part.alias("parts")).alias("content")
        )
        return F.struct(F.array(candidate).alias("candidates"))

    reply = F.to_json(F.transform(F.split("text", "\n"), piece))
    return t.read("conversations").select(
        "conv_id", "turn", E.decode_stream(reply).alias("r")
    ).select("conv_id", "turn", "r.text", "r.error")


@query(
    """
    SELECT d.doc_id, CASE WHEN l.toxic = 1 OR d.lang = 'es' THEN NULL ELSE d.text END AS text,
           CASE WHEN l.toxic = 1 THEN 'blocked by safety filters'
                WHEN d.lang = 'es' THEN 'empty reply' END AS error
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """
)
def decode_predictions(t: Tables) -> DataFrame:
    rows = t.read("documents").join(t.read("labels"), "doc_id", "left")
    blocked = F.struct((F.coalesce("toxic", F.lit(0)) == 1).alias("blocked"))
    content = F.when(F.col("lang") == "es", "").otherwise(F.col("text"))
    prediction = F.struct(content.alias("content"), blocked.alias("safetyAttributes"))
    reply = F.to_json(F.struct(F.array(prediction).alias("predictions")))
    return rows.select("doc_id", E.decode_predict(reply).alias("r")).select(
        "doc_id", "r.text", "r.error"
    )


@query(
    """
    SELECT id, id AS recovered FROM feed_raw
    """
)
def recover_request_ids(t: Tables) -> DataFrame:
    """The id a request was made for, from its parts."""
    from shelfloom.functions.envelopes import id_from_request, parts_request

    line = parts_request("Say it.", F.col("title"), F.col("id"), F.coalesce("description", F.lit("")))
    request = F.get_json_object(line, "$.request")
    return t.raw().select("id", id_from_request(request).alias("recovered"))


# What the stub leaves unanswered, as SQL over a chunk's ids.
FAILS = "md5(array_to_string(ids, ',')) LIKE '0%'"
ANSWERED = (
    "CASE WHEN md5(array_to_string(ids, ',')) LIKE '1%' THEN ids[1:len(ids) - 1] ELSE ids END"
)


def _answers_sql(layout: str, title: bool) -> str:
    """All ids of a chunk with the text the stub gave them."""
    made = {
        ("lines", True): "'Item ' || id || ', new title'",
        ("lines", False): "'All about item ' || id",
        ("blocks", True): "'Item ' || id || ', new title'",
        ("blocks", False): "'All about item ' || id || chr(10) || 'in two lines'",
    }[layout, title]
    return f"""
    WITH chunks AS ({CHUNKS.format(size=10, source="item_properties")})
    SELECT id, {made} AS text
    FROM (SELECT unnest({ANSWERED}) AS id FROM chunks WHERE NOT ({FAILS}))
    """


def _parsed(t: Tables, column: str, layout: str) -> DataFrame:
    chunks = gather_chunks(chunk(t.properties(), 10)).select("chunk_id", "ids")
    reply = line_reply(column) if layout == "lines" else block_reply(column)
    generated = chunks.withColumn("mark", F.lit("")).withColumn("reply", reply)
    entries = explode_replies(
        generated, parsed_entries(F.col("reply"), F.col("ids"), column, layout)
    )
    return first_answer(entries, layout == "lines").where("text is not null")


@query(_answers_sql("lines", True))
def parse_title_lines(t: Tables) -> DataFrame:
    return _parsed(t, "title", "lines")


@query(_answers_sql("lines", False))
def parse_description_lines(t: Tables) -> DataFrame:
    return _parsed(t, "description", "lines")


@query(_answers_sql("blocks", True))
def parse_title_blocks(t: Tables) -> DataFrame:
    return _parsed(t, "title", "blocks")


@query(_answers_sql("blocks", False))
def parse_description_blocks(t: Tables) -> DataFrame:
    return _parsed(t, "description", "blocks")


@query(
    r"""
    SELECT conv_id, turn, line,
           CASE WHEN regexp_matches(line, '^([^:]+): .*$') THEN regexp_extract(line, '^([^:]+): .*$', 1)
                WHEN regexp_matches(line, '^([^:]+)$') THEN line END AS id,
           CASE WHEN regexp_matches(line, '^[^:]+: (.*)$')
                THEN regexp_extract(line, '^[^:]+: (.*)$', 1) END AS text
    FROM (SELECT conv_id, turn, unnest(string_split(replace(text, ',', ':'), chr(10))) AS line
          FROM conversations)
    """
)
def parse_free_lines(t: Tables) -> DataFrame:
    """Lines of real text, with colons where commas stood."""
    lines = t.read("conversations").select(
        "conv_id", "turn", F.explode(F.split(F.replace("text", F.lit(","), F.lit(":")), "\n")).alias("line")
    )
    return lines.select("conv_id", "turn", "line", R.parse_line(F.col("line")).alias("p")).select(
        "conv_id", "turn", "line", "p.id", "p.text"
    )


@query(
    r"""
    WITH replies AS (
      SELECT doc_id, CASE lang WHEN 'de' THEN text
               WHEN 'fr' THEN '**Generated Title:** ' || text
               WHEN 'es' THEN 'id: 1' || chr(10) || '*generated title*: no'
               ELSE 'generated title: ' || text END AS title_reply,
             CASE lang WHEN 'de' THEN text
               WHEN 'fr' THEN '**Generated Description:** ' || text || chr(10) || '**score:** 3'
               WHEN 'es' THEN 'generated description:' || chr(10) || text
               ELSE text || chr(10) || 'generated description: ' || text || chr(10) || 'Score: 4'
             END AS description_reply
      FROM documents)
    SELECT doc_id,
      CASE WHEN regexp_matches(title_reply, '(?is)(?:\*\*|\*)*\s*generated title\s*:\s*(?:\*\*|\*)*\s*([^\n]+)')
           THEN regexp_extract(title_reply, '(?is)(?:\*\*|\*)*\s*generated title\s*:\s*(?:\*\*|\*)*\s*([^\n]+)', 1)
           WHEN NOT contains(title_reply, 'generated title:') THEN title_reply END AS title,
      CASE WHEN regexp_matches(description_reply, '(?is)(?:\*\*|\*)*\s*generated description\s*:\s*(?:\*\*|\*)*\s*(.*?)(?:\n\s*(?:\*\*|\*)*\s*score:|$)')
           THEN regexp_extract(description_reply, '(?is)(?:\*\*|\*)*\s*generated description\s*:\s*(?:\*\*|\*)*\s*(.*?)(?:\n\s*(?:\*\*|\*)*\s*score:|$)', 1)
           WHEN NOT contains(description_reply, 'generated description:') THEN description_reply
      END AS description,
      CASE WHEN regexp_matches(title_reply, '(?i)generated (?:title|description|highlights):\s*(.*)')
           THEN trim(regexp_extract(title_reply, '(?i)generated (?:title|description|highlights):\s*(.*)', 1), ' ' || chr(10))
           ELSE trim(title_reply, ' ' || chr(10)) END AS label
    FROM replies
    """
)
def parse_markdown(t: Tables) -> DataFrame:
    """Whole documents as labelled, bold, wrongly labelled and unlabelled replies."""
    lang, body = F.col("lang"), F.col("text")
    title = (
        F.when(lang == "de", body)
        .when(lang == "fr", F.concat(F.lit("**Generated Title:** "), body))
        .when(lang == "es", "id: 1\n*generated title*: no")
        .otherwise(F.concat(F.lit("generated title: "), body))
    )
    description = (
        F.when(lang == "de", body)
        .when(lang == "fr", F.concat(F.lit("**Generated Description:** "), body, F.lit("\n**score:** 3")))
        .when(lang == "es", F.concat(F.lit("generated description:\n"), body))
        .otherwise(F.concat(body, F.lit("\ngenerated description: "), body, F.lit("\nScore: 4")))
    )
    return t.read("documents").select(
        "doc_id",
        R.parse_title_markdown(title).alias("title"),
        R.parse_description_markdown(description).alias("description"),
        R.parse_label(title).alias("label"),
    )


@query(
    f"""
    WITH chunks AS (SELECT id, [id] AS ids FROM feed_filtered)
    SELECT id, 'Item ' || id || ', new title' AS title,
           'All about item ' || id AS description
    FROM chunks WHERE NOT ({FAILS})
    """
)
def parse_single_items(t: Tables) -> DataFrame:
    rows = t.filtered().select("id", F.array("id").alias("ids"))
    replied = rows.where(~fails(F.col("ids"))).withColumn("mark", F.lit("")).select(
        "id",
        R.parse_title_markdown(single_reply("title")).alias("title"),
        R.parse_description_markdown(single_reply("description")).alias("description"),
    )
    return replied


@query(
    f"""
    WITH chunks AS ({CHUNKS.format(size=10, source="item_properties")})
    SELECT COUNT(*) AS prompts, COUNT(*) FILTER (WHERE {FAILS}) AS failed,
           CAST(SUM(len({ANSWERED})) FILTER (WHERE NOT ({FAILS})) AS BIGINT) AS answered
    FROM chunks
    """
)
def reply_report(t: Tables) -> DataFrame:
    chunks = gather_chunks(chunk(t.properties(), 10))
    failed = fails(F.col("ids"))
    return chunks.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.count_if(failed).alias("failed"),
        F.sum(F.when(~failed, F.size(answered(F.col("ids"))))).alias("answered"),
    )
