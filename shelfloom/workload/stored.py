"""Queries over stored tables: incremental merges, joins of buckets, streams of replies."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.functions.envelopes import candidates_payload
from shelfloom.functions.sql import register_table_functions
from shelfloom.functions.text import part_of
from shelfloom.generator import CallGenerator
from shelfloom.operators import export as X
from shelfloom.operators import merge as M
from shelfloom.operators import sketches as K
from shelfloom.operators import variants as V
from shelfloom.operators.numbering import chunk, gather_chunks
from shelfloom.plans import generation
from shelfloom.session import shared_folder
from shelfloom.sources.ledger import Ledger, store_bucketed
from shelfloom.sources.reply_stream import load_new_replies
from shelfloom.sources.request_files import read_request_files, request_files_report, write_request_files
from shelfloom.workload.prompting import BUCKET_CHUNKS, FAILS, _answers_sql, _batch_sql, sectioned
from shelfloom.workload.registry import VIEWS, query
from shelfloom.workload.results import (
    _APPROVED_SQL,
    _BATCH,
    _FEED_COLUMNS,
    _FULL_SQL,
    _batch_input,
    _echo,
    _finished,
    _mark,
    _records,
    _run,
)
from shelfloom.workload.stub import block_reply
from shelfloom.workload.views import Tables

BUCKETS, SLICES = 8, 4


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def _loads(t: Tables) -> list[dict[str, DataFrame]]:
    """Three loads: titles of every third document, descriptions of every fifth, both of every seventh."""
    docs = t.read("documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "lang", "source")

    def part(every: int, rest: int, mark: str) -> DataFrame:
        picked = docs.where(F.col("doc_id") % every == rest)
        text = F.when(F.col("lang") != "es", F.concat("source", F.lit(mark)))
        return picked.select("id", text.alias("text"), F.concat("lang", F.lit(mark)).alias("raw"))

    return [
        {"titles": part(3, 0, " one")},
        {"descriptions": part(5, 1, " two")},
        {"titles": part(7, 2, " three"), "descriptions": part(7, 3, " three")},
    ]


VIEWS["loads"] = """
    SELECT CAST(doc_id AS VARCHAR) AS id, k.seq, k.target, lang || k.mark AS raw,
           CASE WHEN lang <> 'es' THEN source || k.mark END AS text
    FROM documents d
    JOIN (VALUES (1, 'titles', 3, 0, ' one'), (2, 'descriptions', 5, 1, ' two'), (3, 'titles', 7, 2, ' three'),
                 (3, 'descriptions', 7, 3, ' three')) k(seq, target, every, rest, mark)
      ON d.doc_id % k.every = k.rest"""

_MERGED_SQL = """
    SELECT coalesce(o.id, n.id) AS id, n.title, n.description, coalesce(o.tries, 0) + coalesce(n.tries, 0) AS tries,
           n.raw_response_title, n.raw_response_description
    FROM output o FULL JOIN (
        SELECT id, COUNT(*) AS tries,
               arg_max(text, seq) FILTER (target = 'titles' AND text IS NOT NULL) AS title,
               arg_max(text, seq) FILTER (target = 'descriptions' AND text IS NOT NULL) AS description,
               arg_max(raw, seq) FILTER (target = 'titles') AS raw_response_title,
               arg_max(raw, seq) FILTER (target = 'descriptions') AS raw_response_description
        FROM loads GROUP BY id) n ON n.id = o.id
"""
_MERGED = ["id", "title", "description", "tries", "raw_response_title", "raw_response_description"]


@query(_MERGED_SQL)
def merge_incremental(t: Tables) -> DataFrame:
    """Three small merges to a stored table, one compaction between them, none of them a rewrite."""
    ledger = Ledger(t.spark, _name("merged"), BUCKETS, SLICES).create(t.output())
    for number, load in enumerate(_loads(t)):
        ledger.append(load, f"load-{number}")
        ledger.append(load, f"load-{number}")  # a repeated load changes nothing
        if number == 1:
            ledger.compact(share=0.3)
    return ledger.read().select(*_MERGED)


@query(_MERGED_SQL)
def merge_compacted(t: Tables) -> DataFrame:
    """The same merges, each folded into the slices that it touched at once."""
    ledger = Ledger(t.spark, _name("compacted"), BUCKETS, SLICES).create(t.output())
    for number, load in enumerate(_loads(t)):
        ledger.append(load, f"load-{number}")
        ledger.compact(share=0.0)
    return ledger.read().select(*_MERGED)


@query(_FULL_SQL)
def export_full_stored(t: Tables) -> DataFrame:
    """The full feed from two stored tables of the same buckets, joined where they lie."""
    raw = store_bucketed(t.raw().withColumn("product_highlight", F.col("color")), _name("feed"), BUCKETS)
    made = store_bucketed(_finished(t), _name("made"), BUCKETS)
    return X.full_feed(raw, made.hint("merge"))


def _drop(t: Tables, folder: str, every: int, label: str) -> None:
    """Reply files for some documents: one each time, as a service leaves them."""
    docs = t.read("documents").where(F.col("doc_id") % every == 0)
    reply = F.concat(F.lit(f"generated title: {label} "), F.col("source"))
    record = F.struct(F.col("doc_id").cast("string").alias("id"), candidates_payload(reply).alias("response"))
    docs.select(F.to_json(record).alias("value")).write.text(f"{folder}/{label}", lineSep="\n")


@query(
    """
    WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS id,
                      CASE WHEN doc_id % 3 = 0 THEN 'second ' ELSE 'first ' END || source AS title,
                      (doc_id % 2 = 0)::BIGINT + (doc_id % 3 = 0)::BIGINT AS tries
               FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
    SELECT coalesce(o.id, n.id) AS id, n.title, coalesce(o.tries, 0) + coalesce(n.tries, 0) AS tries
    FROM output o FULL JOIN n ON n.id = o.id
    """
)
def stream_replies(t: Tables) -> DataFrame:
    """Two drops of reply files and three starts of the load: each file is merged once."""
    folder = f"{shared_folder(t.spark)}/{_name('stream')}"
    ledger = Ledger(t.spark, _name("streamed"), BUCKETS, SLICES).create(t.output())
    for every, label in ((2, "first"), (3, "second")):
        _drop(t, f"{folder}/replies", every, label)
        load_new_replies(ledger, f"{folder}/replies", "titles", f"{folder}/checkpoint")
    load_new_replies(ledger, f"{folder}/replies", "titles", f"{folder}/checkpoint")
    return ledger.read().select("id", "title", "tries")


# A single request with its examples may take several hundred kilobytes.
_LIMITS = {"max_lines": 7, "max_bytes": 2 << 20}


def _requests(t: Tables) -> DataFrame:
    return generation.batch_requests(_batch_input(t), t.examples(), _BATCH)["titles"].select("request")


@query(f"SELECT id, md5(prompt) AS prompt FROM ({_batch_sql('titles', 'title')})")
def request_files(t: Tables) -> DataFrame:
    """Request files of a few lines each, read back by their manifest."""
    folder = f"{shared_folder(t.spark)}/{_name('requests')}"
    write_request_files(_requests(t), folder, **_LIMITS)
    request = F.from_json(
        "value", "id STRING, request STRUCT<contents: ARRAY<STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>"
    )
    read = read_request_files(t.spark, folder).select(request.alias("r"))
    return read.select("r.id", F.md5(F.col("r.request.contents")[0]["parts"][0]["text"]).alias("prompt"))


@query(f"SELECT COUNT(*) AS lines, true AS within FROM ({_batch_sql('titles', 'title')})")
def request_file_limits(t: Tables) -> DataFrame:
    """What the manifest says of the same files: every line is in one, and no file exceeds a limit."""
    folder = f"{shared_folder(t.spark)}/{_name('limits')}"
    write_request_files(_requests(t), folder, **_LIMITS)
    report = request_files_report(t.spark, folder)
    within = (F.col("most_lines") <= _LIMITS["max_lines"]) & (F.col("most_bytes") <= _LIMITS["max_bytes"])
    return report.select("lines", (within & (F.col("files") >= F.col("lines") / _LIMITS["max_lines"])).alias("within"))


# Passes that go through one job: an explicit setting, the same at every size.
_AT_ONCE = 256


@query(
    f"""
    WITH single AS (
      SELECT o.id, [o.id] AS ids, 'Item ' || o.id || ', new title' || {_mark(sectioned(
        "titles", "English", "title", "i.properties || chr(10)"))} AS new_title
      FROM output o JOIN item_properties i ON i.id = o.id)
    SELECT id, CASE WHEN NOT ({FAILS}) THEN new_title END AS title,
           CAST(CASE WHEN {FAILS} THEN 3 ELSE 1 END AS BIGINT) AS tries
    FROM single
    """
)
def generate_in_batches(t: Tables) -> DataFrame:
    """Passes over a bounded number of items each, in an order that is drawn and written once a round."""
    return _run(t, S.TITLES, "single", batch_rows=600, at_once=_AT_ONCE).select("id", "title", "tries")


@query(
    """
    SELECT COUNT(*) AS total, COUNT(title) AS titles, COUNT(description) AS descriptions,
           COUNT(highlights) AS highlights
    FROM finished
    """
)
def progress_observed(t: Tables) -> DataFrame:
    """The counts of an output table, taken while a snapshot of it is written."""
    made = _finished(t)
    missing = [f for f in S.OUTPUT.fields if f.name not in made.columns]
    output = made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    output = output.select(*[f.name for f in S.OUTPUT.fields])
    _, counts = M.save_with_progress(output, f"{shared_folder(t.spark)}/{_name('progress')}")
    return t.spark.createDataFrame([counts], "total long, titles long, descriptions long, highlights long")


@query(_APPROVED_SQL)
def approved_feed_variants(t: Tables) -> DataFrame:
    """The feed of approved rows from attributes stored as variants."""
    records = V.store_variants(X.approve_where(_records(t), "status = 'Success'").select(*_FEED_COLUMNS))
    return V.approved_variants(records).drop("modified")


@query(
    """
    SELECT id, regexp_extract(gap_attributes, '"([^"]+)":"([^"]*)"', 1) AS key,
           regexp_extract(gap_attributes, '"([^"]+)":"([^"]*)"', 2) AS value
    FROM records WHERE approval AND gap_attributes <> ''
    """
)
def approved_variants_long(t: Tables) -> DataFrame:
    rows = _records(t).select("id", "approval", "gap_attributes")
    return V.variants_long(V.store_variants(rows, ("gap_attributes",)))


@query(_answers_sql("blocks", True))
def parse_title_blocks_sql(t: Tables) -> DataFrame:
    """Block replies read by SQL alone: a table function, and the first answer of each id."""
    chunks = gather_chunks(chunk(t.properties(), 10)).select("chunk_id", "ids")
    replies = chunks.withColumn("mark", F.lit("")).withColumn("reply", block_reply("title"))
    register_table_functions(t.spark)
    return t.spark.sql(
        """
        SELECT id, text FROM (
            SELECT b.id, b.text, ROW_NUMBER() OVER (PARTITION BY b.id ORDER BY chunk_id, position) AS nth
            FROM {replies}, LATERAL title_blocks(reply) b)
        WHERE nth = 1 AND text IS NOT NULL
        """,
        replies=replies,
    )


@query(_answers_sql("lines", True))
def parse_title_lines_sql(t: Tables) -> DataFrame:
    """Line replies read by SQL alone; only ids that were asked count."""
    from shelfloom.workload.stub import line_reply

    chunks = gather_chunks(chunk(t.properties(), 10)).select("chunk_id", "ids")
    replies = chunks.withColumn("mark", F.lit("")).withColumn("reply", line_reply("title"))
    register_table_functions(t.spark)
    return t.spark.sql(
        """
        SELECT id, text FROM (
            SELECT a.id, a.text, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY chunk_id, position) AS nth
            FROM {replies}, LATERAL reply_answers(reply, ids) a WHERE array_contains(ids, a.id))
        WHERE nth = 1 AND text IS NOT NULL
        """,
        replies=replies,
    )


@query("SELECT id, upper(title) AS reply, '' AS status FROM feed_filtered")
def paced_replies(t: Tables) -> DataFrame:
    """A client called by a few tasks that share a quota."""
    prompts = t.filtered().select("id", F.col("title").alias("prompt"))
    client = CallGenerator(lambda: str.upper, calls=4, quota=600_000)
    return client.generate(prompts).select("id", "reply", "status")


_FEW = 3


@query(
    f"""
    WITH chunks AS ({BUCKET_CHUNKS.format(size=10, buckets=_FEW, source="item_properties")})
    SELECT array_to_string(ids, ',') AS ids, len(ids) AS n FROM chunks
    """
)
def chunk_ids_spread(t: Tables) -> DataFrame:
    """Chunks of few large buckets, numbered over pieces of buckets."""
    chunks = gather_chunks(chunk(t.properties(), 10, _FEW, spread=True))
    return chunks.select(F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("SELECT COUNT(*) AS n, true AS within FROM feed_raw")
def sketched_quantile(t: Tables) -> DataFrame:
    """The 99th percentile of clicks from merged sketches of four parts, held against true ranks."""
    feed = t.raw().select("id", "clicks")
    parts = K.metric_sketches(feed.withColumn("part", part_of(F.col("id"), 4)), "clicks", ["part"])
    value = K.merged(parts).select(K.quantile(0.99)).scalar()
    below, upto = F.count_if(F.col("clicks") < value), F.count_if(F.col("clicks") <= value)
    ranks = feed.agg(F.count(F.lit(1)).alias("n"), below.alias("below"), upto.alias("upto"))
    error = F.lit(K.rank_error()) * F.col("n")
    within = (F.col("below") <= 0.99 * F.col("n") + error) & (F.col("upto") >= 0.99 * F.col("n") - error)
    return ranks.select("n", within.alias("within"))


@query(
    f"""
    WITH h AS ({_batch_sql("highlights", "description")})
    SELECT id, md5(prompt) AS highlights, CAST(NULL AS VARCHAR) AS title, CAST(1 AS BIGINT) AS tries FROM h
    """
)
def batch_highlights(t: Tables) -> DataFrame:
    """The third target as a batch of files: requests, replies and merge."""
    folder = f"{shared_folder(t.spark)}/{_name('highlights')}"
    settings = dataclasses.replace(_BATCH, targets=("highlights",))
    done = generation.run_batch(_batch_input(t), t.examples(), _echo("generated highlights: "), folder, settings)
    return done.select("id", "highlights", "title", "tries")
