"""Generate, parse and merge texts, in passes or as batches of files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom import schemas as S
from shelfloom.functions import prompts as P
from shelfloom.functions.envelopes import (
    batch_request,
    candidates_payload,
    decode_candidates,
    request_shape,
)
from shelfloom.functions.parsing import batch_value
from shelfloom.functions.text import image_uri, part_of
from shelfloom.generator import Generator
from shelfloom.operators import merge as M
from shelfloom.operators.examples import example_blocks
from shelfloom.operators.numbering import chunk, draw_order, gather_chunks
from shelfloom.operators.prepare import in_part
from shelfloom.operators.replies import answers, debug_rows
from shelfloom.session import materialise, materialise_counted
from shelfloom.sources.records import read_replies, reply_folders


@dataclass(frozen=True)
class Passes:
    """Settings of the passes over pending rows.

    ``layout`` is how replies are laid out: ``lines``, ``blocks``, or ``single`` for one item per
    prompt. ``batch_rows`` limits the ids of a pass; by default a pass takes all pending ones.
    Chunks are numbered within ``buckets``, which bounds a task's share and is fixed for a run, so
    that which items share a prompt does not depend on the size of the feed; large feeds take
    thousands. By default chunks run through all rows in order of id.

    With one item per prompt, ``at_once`` passes go through one job, so that a large feed takes few
    jobs however small its passes are; what a lost job asks again is bounded by both settings.
    """

    target: S.Target = S.TITLES
    items_per_prompt: int = 10
    language: str = "English"
    parts: int | None = None
    part: int | None = None
    layout: str = "lines"
    batch_rows: int | None = None
    at_once: int = 1
    buckets: int | None = None
    max_tries: int = C.MAX_TRIES
    bucket_name: str = ""
    use_images: bool = False
    debug: bool = False
    per_target_tries: bool = False

    def __post_init__(self):
        if self.at_once > 1 and self.layout != "single":
            # A prompt of several items would mix the items of several passes.
            raise ValueError("several passes at once take one item per prompt")


def pending(settings: Passes) -> Column:
    """Whether a row still needs the text and has tries left."""
    tries = F.coalesce(F.col("tries"), F.lit(0))
    waiting = F.col(settings.target.column).isNull() & (tries < settings.max_tries)
    if settings.parts is not None:
        waiting = waiting & (part_of(F.col("id"), settings.parts) == settings.part)
    return F.coalesce(waiting, F.lit(False))


def repeats(rows: DataFrame) -> bool:
    """Whether an id occurs more than once; only ids are read and moved."""
    return not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def join_pending(output: DataFrame, prepared: DataFrame) -> DataFrame:
    """Output rows with the properties of their items, null where the input lacks them.

    Where the input repeats ids, one row per id is taken; copies are reduced within each task before
    the shuffle that the join needs anyway. An input of unique ids is joined as it is.
    """
    columns = prepared.columns
    image = F.col("image_url") if "image_url" in columns else F.lit(None).cast("string")
    rows = prepared.select("id", P.row_json(columns).alias("properties"), image.alias("image_url"))
    if repeats(prepared):
        single = rows.groupBy("id").agg(F.min(F.struct("properties", "image_url")).alias("_row"))
        rows = single.select("id", "_row.*")
    return output.join(rows, "id", "left")


def build_prompts(rows: DataFrame, examples: Column, settings: Passes) -> DataFrame:
    """Prompts of a pass: chunk_id, ids, prompt and, with images, the uri to send along."""
    if settings.layout == "single":
        uri = image_uri(F.col("image_url"), settings.bucket_name, settings.use_images)
        note = F.coalesce(F.concat(F.lit("image_url: "), F.col("uri")), F.lit(""))
        product = F.struct(F.col("properties"), note.alias("image_info"))
        prompt = P.sectioned_prompt(
            settings.target,
            settings.language,
            examples,
            P.products_with_images(F.array(product)),
        )
        return rows.withColumn("uri", uri).select(
            F.xxhash64("id").alias("chunk_id"),
            F.array("id").alias("ids"),
            prompt.alias("prompt"),
            "uri",
        )
    chunked = gather_chunks(
        chunk(rows.select("id", "properties"), settings.items_per_prompt, settings.buckets)
    )
    properties = F.col("properties")
    if settings.layout == "lines":
        prompt = P.chunk_prompt(settings.target, settings.language, examples, properties)
    else:
        prompt = P.sectioned_prompt(
            settings.target, settings.language, examples, P.lines(properties)
        )
    return chunked.select(
        "chunk_id", "ids", prompt.alias("prompt"), F.lit(None).cast("string").alias("uri")
    )


# What active rows carry along besides the columns of the output table.
CARRIED = ("properties", "image_url")

# The most ids that are sent to every task to pick the texts of a pass; beyond, they meet the texts in a shuffle.
_SENT_IDS = 1_000_000


def run_pass(
    active: DataFrame,
    asked: DataFrame,
    examples: Column,
    generator: Generator,
    settings: Passes,
) -> DataFrame:
    """Ask for some rows once and merge the answers into the active rows.

    The replies are written out before they are read again for parsing and for the raw capture, so
    the model is called once per prompt. Every asked id counts a try, answered or not.
    """
    prompts = build_prompts(asked.select("id", *CARRIED), examples, settings)
    generated = materialise(
        generator.generate(prompts).select("chunk_id", "ids", "reply", "status"), "replies"
    )
    column = settings.target.column
    results = answers(generated, column, settings.layout, settings.layout != "blocks")
    if settings.debug:
        active = M.capture_raw(active, debug_rows(generated), settings.target)
    return M.merge_matched(active, results, column)


def _once(rows: DataFrame) -> DataFrame:
    """Each id once; several rows of an id are reduced within each task first."""
    first = F.min(F.struct(*CARRIED)).alias("_row")
    return rows.groupBy("id").agg(first).select("id", "_row.*")


def generate(
    output: DataFrame,
    prepared: DataFrame,
    examples: DataFrame | Column,
    generator: Generator,
    settings: Passes = Passes(),
    ids: DataFrame | None = None,
) -> DataFrame:
    """The output table after all passes, or after one pass over explicit ids.

    Input and output meet once, before the first pass. Rows that are done leave the loop: a pass
    reads and rewrites only the rows that are still active, and the result is the union of what the
    passes left behind. Properties are written once, with the active rows; a pass shuffles them into
    its prompts, while answers meet rows without them, and the next pass picks its own by id. The loop
    ends because every asked row either gets its text or comes one try closer to the limit.
    """
    columns = output.columns
    if settings.per_target_tries:
        # Tries of other targets do not count: start from zero and add them back at the end.
        # They travel with their row, so rows of null or repeated ids keep their own.
        earlier = F.coalesce("tries", F.lit(0)).cast("long")
        fresh = output.withColumn("_before", earlier).withColumn("tries", F.lit(0).cast("long"))
        single = replace(settings, per_target_tries=False)
        done = generate(fresh, prepared, examples, generator, single, ids)
        return done.withColumn("tries", F.col("tries") + F.col("_before")).select(*columns)

    block = examples if isinstance(examples, Column) else example_blocks(examples)
    if ids is None:
        prepared = in_part(prepared, settings.parts, settings.part)
    joined = join_pending(output, prepared)
    if ids is None:
        wanted = pending(settings)
    else:
        listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
        joined = joined.join(listed, "id", "left")
        wanted = F.col("_listed").isNotNull()
    # Ids the input does not know are never asked, so they are done from the start.
    active_now = wanted & F.col("properties").isNotNull()
    state, waiting = _split(joined.withColumn("_active", active_now), columns)
    settled, active = [_settled(state, columns)], _active(state)
    repeated = repeats(active)
    rows, texts = active.select(*columns), active.select("id", *CARRIED)
    number = 0
    while waiting:
        if settings.batch_rows is None or ids is not None:
            shares = [(rows, texts)]
        else:
            size = settings.batch_rows * settings.at_once
            active = active if number == 0 else rows.join(texts, "id")
            drawn = _shares(active, size, number, waiting, repeated)
            shares = [(s.select(*columns), s.select("id", *CARRIED)) for s in drawn]
        left, waiting = [], 0
        for share, own in shares:
            asked = _once(own) if repeated else own
            merged = run_pass(share, asked, block, generator, settings)
            if ids is not None:
                return reduce(DataFrame.unionByName, [*settled, merged.select(*columns)])
            state, still = _split(merged.withColumn("_active", pending(settings)), columns)
            settled.append(_settled(state, columns))
            remaining = _active(state)
            left.append((remaining, _picked(asked, remaining, still)))
            waiting += still
        rows, texts = (_together(list(frames)) for frames in zip(*left))
        number += 1
    return _together(settled)


def _together(frames: list[DataFrame]) -> DataFrame:
    """The union of any number of tables, nested no deeper than the logarithm of their number."""
    while len(frames) > 1:
        frames = [reduce(DataFrame.unionByName, frames[i : i + 2]) for i in range(0, len(frames), 2)]
    return frames[0]


def _shares(active: DataFrame, size: int, seed: int, waiting: int, repeated: bool) -> list[DataFrame]:
    """The active rows in jobs of ``size`` ids, in an order drawn and written once.

    A job reads its range of the draw and writes what it asked, so all jobs over the rows together
    read and write each of them once; rows that fail wait for the next draw.
    """
    drawn = draw_order(active, seed, once=repeated)
    if repeated:
        waiting = drawn.agg(F.max("turn")).first()[0] + 1
    return [
        drawn.where((F.col("turn") >= start) & (F.col("turn") < start + size)).drop("turn")
        for start in range(0, waiting, size)
    ]


def _picked(texts: DataFrame, remaining: DataFrame, count: int) -> DataFrame:
    """The texts of the rows that remain. Their ids are counted: up to a limit they go to the texts."""
    ids = remaining.select("id")
    return texts.join(F.broadcast(ids) if count <= _SENT_IDS else ids, "id", "left_semi")


def _split(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Write rows out, the active ones apart from the others and alone with any properties.

    Also returns how many are active, as counted by the write itself.
    """
    carried = [F.when(F.col("_active"), F.col(c)).alias(c) for c in CARRIED if c in rows.columns]
    active = {"active": F.count_if(F.col("_active"))}
    state, seen = materialise_counted(rows.select(*columns, *carried, "_active"), "output", active, by="_active")
    return state, seen["active"]


def _active(state: DataFrame) -> DataFrame:
    return state.where("_active").drop("_active")


def _settled(state: DataFrame, columns: list[str]) -> DataFrame:
    return state.where("not _active").select(*columns)


def generate_parts(
    output: DataFrame,
    prepared: DataFrame,
    examples: DataFrame,
    generator: Generator,
    settings: Passes,
    at_once: int = 4,
) -> DataFrame:
    """All parts of the feed, each as its own run, put together again.

    ``at_once`` parts run side by side, so that a cluster is busy while a part waits for its last
    tasks; all of them share the stored examples.
    """
    block = example_blocks(examples)

    def run(part: int) -> DataFrame:
        mine = in_part(output, settings.parts, part)
        return generate(mine, prepared, block, generator, replace(settings, part=part))

    with ThreadPoolExecutor(at_once) as pool:
        # Each part keeps the context of the caller, such as the folder of its run.
        runs = [pool.submit(copy_context().run, run, part) for part in range(settings.parts)]
        return reduce(DataFrame.unionByName, [r.result() for r in runs])


@dataclass(frozen=True)
class Batch:
    """Settings of a batch run over files."""

    language: str = "English"
    targets: tuple[str, ...] = ("titles", "descriptions")
    bucket_name: str = ""
    use_images: bool = False
    web_done: bool = False
    model: str = ""
    extra: tuple[tuple[str, str], ...] = ()
    strict: bool = False


def batch_prompts(
    prepared: DataFrame, examples: Column, target: S.Target, settings: Batch
) -> DataFrame:
    """One prompt per row: id and prompt."""
    kept = [c for c in prepared.columns if c not in ("id", "image_url", "webpage_content")]
    text = P.batch_input(
        P.row_json(kept),
        F.col("image_url"),
        F.col("webpage_content"),
        settings.bucket_name,
        settings.use_images,
        settings.web_done,
    )
    prompt = P.sectioned_prompt(target, settings.language, examples, text)
    return prepared.select("id", prompt.alias("prompt"))


def batch_requests(
    prepared: DataFrame, examples: DataFrame, settings: Batch
) -> dict[str, DataFrame]:
    """Request lines per target: id, prompt and request."""
    block = example_blocks(examples)
    shape = request_shape(settings.model)
    requests = {}
    for name in settings.targets:
        prompts = batch_prompts(prepared, block, S.TARGETS[name], settings)
        line = batch_request(F.col("id"), F.col("prompt"), shape, dict(settings.extra))
        requests[name] = prompts.withColumn("request", line)
    return requests


def write_requests(requests: dict[str, DataFrame], folder: str, compression: str = "gzip") -> None:
    """Request files per target, for a batch service to pick up.

    Every line repeats the wording and the examples, so files are written compressed; ``none`` serves
    a service that reads plain lines alone.
    """
    for name, lines in requests.items():
        written = lines.select(F.col("request").alias("value")).write.mode("overwrite")
        written.option("compression", compression).text(f"{folder}/requests/{name}")


def decoded(replies: DataFrame, target: S.Target, strict: bool = False) -> DataFrame:
    """id, text and raw of reply lines; lines that cannot be read and rows without id go."""
    readable = F.filter(
        F.array(decode_candidates(F.col("value"))), lambda r: r["readable"] & r["id"].isNotNull()
    )
    # As a generator, so that a line is decoded once and not again by a pushed-down filter.
    return replies.select(F.inline(readable)).select(
        "id", batch_value(F.col("text"), target.column, strict).alias("text"), "raw"
    )


def load_and_merge(
    output: DataFrame, folder: str, targets: tuple[str, ...], strict: bool = False
) -> DataFrame:
    """Read the reply files of the targets and merge them; a target without any is an error.

    Running it again gives the same texts and tries, so a broken run is resumed by calling it once
    the replies are there.
    """
    spark = output.sparkSession
    results = {
        name: decoded(read_replies(spark, f"{folder}/replies/{name}"), S.TARGETS[name], strict)
        for name in targets
    }
    return M.upsert(output, results, keep_old=not strict) if results else output


def answer_batch(spark: SparkSession, folder: str, target: str, generator: Generator) -> None:
    """Stand-in for a batch service: answer the request files of a target and write replies."""
    lines = spark.read.text(f"{folder}/requests/{target}")
    request = F.from_json(
        "value",
        "id STRING, custom_id STRING, request STRUCT<contents: ARRAY<STRUCT<parts: ARRAY<STRUCT<"
        "text: STRING>>>>, messages: ARRAY<STRUCT<content: STRING>>>",
    )
    prompts = lines.select(request.alias("r")).select(
        F.coalesce("r.id", "r.custom_id").alias("id"),
        F.coalesce(
            F.col("r.request.contents")[0]["parts"][0]["text"],
            F.col("r.request.messages")[0]["content"],
        ).alias("prompt"),
    )
    replied = generator.generate(prompts)
    record = F.struct("id", candidates_payload(F.col("reply")).alias("response"))
    replied.select(F.to_json(record).alias("value")).write.mode("overwrite").text(
        f"{folder}/replies/{target}", lineSep="\n"
    )


def finished_targets(spark: SparkSession, folder: str, targets: tuple[str, ...]) -> tuple[str, ...]:
    """The targets that have finished replies by now."""
    return tuple(n for n in targets if any(reply_folders(spark, f"{folder}/replies/{n}")))


def resume(output: DataFrame, folder: str, settings: Batch) -> DataFrame:
    """Go on with a run whose requests were sent: no new requests, only the replies that are there.

    Targets that are still waiting stay as they are; ``finished_targets`` tells which they are not.
    """
    ready = finished_targets(output.sparkSession, folder, settings.targets)
    return load_and_merge(output, folder, ready, settings.strict)


def run_batch(
    feed: DataFrame, examples: DataFrame, generator: Generator, folder: str, settings: Batch
) -> DataFrame:
    """Requests, replies and merge for a completed input; returns the filled output table."""
    write_requests(batch_requests(feed, examples, settings), folder)
    for name in settings.targets:
        answer_batch(feed.sparkSession, folder, name, generator)
    return load_and_merge(
        M.empty_output(feed.sparkSession), folder, settings.targets, settings.strict
    )
