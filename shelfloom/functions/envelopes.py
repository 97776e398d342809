"""Request and reply records of a model service, built and read as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom import schemas as S
from shelfloom.functions.text import let

# Model-name prefixes whose batches use the messages shape, and its token limit.
MESSAGES_MODELS = ("claude-",)
MESSAGES_MAX_TOKENS = 1000


@dataclass(frozen=True)
class Params:
    """Sampling settings sent along with a request."""

    temperature: float = 0.1
    max_output_tokens: int = 2048
    top_k: int | None = None
    top_p: float | None = None

    def as_struct(self) -> Column:
        fields = [
            F.lit(self.temperature).alias("temperature"),
            F.lit(self.max_output_tokens).alias("maxOutputTokens"),
        ]
        if self.top_k is not None:
            fields.append(F.lit(self.top_k).alias("topK"))
        if self.top_p is not None:
            fields.append(F.lit(self.top_p).alias("topP"))
        return F.struct(*fields)


def _text(col: Column) -> Column:
    return F.struct(col.alias("text"))


def request_shape(model: str) -> str:
    return "messages" if model.startswith(MESSAGES_MODELS) else "contents"


def batch_request(
    id_col: Column, prompt: Column, shape: str = "contents", extra: dict[str, str] | None = None
) -> Column:
    """One line of a batch file. ``extra`` holds service-specific fields of the messages shape,
    such as the version field a partner model asks for."""
    if shape == "messages":
        message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
        fields = [F.array(message).alias("messages")]
        fields += [F.lit(v).alias(k) for k, v in (extra or {}).items()]
        fields.append(F.lit(MESSAGES_MAX_TOKENS).alias("max_tokens"))
        return F.to_json(
            F.struct(id_col.cast("string").alias("custom_id"), F.struct(*fields).alias("request"))
        )
    content = F.struct(F.lit("user").alias("role"), F.array(_text(prompt)).alias("parts"))
    request = F.struct(F.array(content).alias("contents"))
    return F.to_json(F.struct(id_col.cast("string").alias("id"), request.alias("request")))


def parts_request(
    prompt: str, title: Column, id_col: Column, description: Column, temperature: float = 0.9
) -> Column:
    """A request with the instructions and the item's fields as separate parts."""
    parts = F.array(
        _text(F.lit(prompt)),
        _text(F.concat(F.lit("Title: "), title)),
        _text(F.concat(F.lit(C.ID_PREFIX), id_col.cast("string"))),
        _text(F.concat(F.lit("Description: "), description)),
    )
    content = F.struct(F.lit("user").alias("role"), parts.alias("parts"))
    config = F.struct(F.lit(temperature).alias("temperature"))
    request = F.struct(F.array(content).alias("contents"), config.alias("generationConfig"))
    return F.to_json(F.struct(request.alias("request")))


def multimodal_request(
    prompt: Column,
    image_uri: Column | None = None,
    image_bytes: Column | None = None,
    mime_type: Column | None = None,
    params: Params = Params(),
) -> Column:
    """Prompt plus image: a stored image by reference, any other one inline."""
    none = F.lit(None).cast("string")
    uri = image_uri if image_uri is not None else none
    data = F.base64(image_bytes) if image_bytes is not None else none
    mime = mime_type if mime_type is not None else none
    stored = uri.startswith("gs://")
    file_part = F.struct(F.lit("image/png").alias("mimeType"), uri.alias("fileUri"))
    inline_part = F.struct(mime.alias("mimeType"), data.alias("data"))
    no_file = F.lit(None).cast("struct<mimeType: string, fileUri: string>")
    no_inline = F.lit(None).cast("struct<mimeType: string, data: string>")

    def part(text: Column, file: Column, inline: Column) -> Column:
        return F.struct(text.alias("text"), file.alias("fileData"), inline.alias("inlineData"))

    prompt_part = part(prompt, no_file, no_inline)
    parts = (
        F.when(stored, F.array(prompt_part, part(none, file_part, no_inline)))
        .when(
            uri.isNotNull() & data.isNotNull() & mime.isNotNull(),
            F.array(prompt_part, part(none, no_file, inline_part)),
        )
        .otherwise(F.array(prompt_part))
    )
    safety = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(C.SAFETY_THRESHOLD).alias("threshold"))
            for c in C.SAFETY_CATEGORIES
        ]
    )
    contents = F.struct(F.lit("user").alias("role"), parts.alias("parts"))
    return F.to_json(
        F.struct(
            contents.alias("contents"),
            params.as_struct().alias("generationConfig"),
            safety.alias("safetySettings"),
        )
    )


def predict_request(prompt: Column, params: Params = Params()) -> Column:
    """A plain text request."""
    instances = F.array(F.struct(prompt.alias("prompt")))
    return F.to_json(F.struct(instances.alias("instances"), params.as_struct().alias("parameters")))


def decode_record(line: Column) -> Column:
    """The outer fields of one reply line; ``_corrupt`` holds a line that is not a record."""
    return F.from_json(line, S.REPLY_RECORD, {"columnNameOfCorruptRecord": "_corrupt"})


def decode_candidates(line: Column, default: str = "") -> Column:
    """Id, first text and raw payload of a reply line, and whether the line could be read.

    The id may stand at the top, under ``instance``, or as ``custom_id``; the payload under
    ``response`` or ``prediction``.
    """

    def some(col: Column) -> Column:
        return F.when(col != "", col)

    def read(record: Column) -> Column:
        full = [F.when(~record[f].isin("", "{}"), record[f]) for f in ("response", "prediction")]
        payload = F.coalesce(*full)
        return F.struct(
            F.coalesce(
                some(record["id"]), some(record["instance"]["id"]), some(record["custom_id"])
            ).alias("id"),
            F.coalesce(first_text(payload), F.lit(default)).alias("text"),
            payload.alias("raw"),
            record["request"].alias("request"),
            (record.isNotNull() & record["_corrupt"].isNull()).alias("readable"),
        )

    return let(decode_record(line), read)


def candidates_payload(text: Column) -> Column:
    """A reply payload with one text, or without candidates where the text is null."""
    part = F.array(F.struct(text.alias("text")))
    candidate = F.struct(F.struct(part.alias("parts")).alias("content"))
    return F.struct(F.when(text.isNotNull(), F.array(candidate)).alias("candidates"))


def first_text(payload: Column) -> Column:
    """Text of the first part of the first candidate, null where there is none."""
    candidates = F.from_json(payload, S.CANDIDATES)["candidates"]
    return F.get(F.get(candidates, F.lit(0))["content"]["parts"], F.lit(0))["text"]


def id_from_request(request: Column) -> Column:
    """The id a parts request was made for."""
    contents = F.from_json(request, S.REQUEST_PARTS)["contents"]
    texts = F.flatten(F.transform(contents, lambda c: F.transform(c["parts"], lambda p: p["text"])))
    marked = F.filter(texts, lambda t: t.startswith(C.ID_PREFIX))
    found = F.replace(F.get(marked, F.lit(0)), F.lit(C.ID_PREFIX), F.lit(""))
    return F.coalesce(found, F.lit(C.NO_ANSWER))


def _outcome(text: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def decode_stream(reply: Column) -> Column:
    """Text of a streamed reply, or why there is none: an error, a block, or nothing at all."""

    def read(chunks: Column) -> Column:
        reasons = F.transform(
            chunks,
            lambda c: F.when(c["error"].isNotNull(), F.lit("error")).when(
                F.get(c["candidates"], F.lit(0))["finishReason"].isin(*C.BLOCKED_REASONS),
                F.lit("blocked"),
            ),
        )
        first = F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))
        texts = F.transform(
            chunks,
            lambda c: F.get(
                F.get(c["candidates"], F.lit(0))["content"]["parts"], F.lit(0)
            )["text"],
        )
        text = F.array_join(texts, "")
        error = (
            F.when(reply.isNull(), F.lit("no reply"))
            .when(first == "blocked", F.lit("blocked by safety filters"))
            .when((first == "error") | chunks.isNull() | (text == ""), reply)
        )
        return _outcome(text, error)

    return let(F.from_json(reply, S.STREAM_CHUNKS), read)


def decode_predict(reply: Column) -> Column:
    """Text of a plain reply, or why there is none."""

    def read(record: Column) -> Column:
        first = F.get(record["predictions"], F.lit(0))
        error = (
            F.when(first["safetyAttributes"]["blocked"], F.lit("blocked by safety filters"))
            .when(F.coalesce(first["content"], F.lit("")) != "", F.lit(None).cast("string"))
            .when(first.isNotNull(), F.lit("empty reply"))
            .otherwise(F.coalesce(reply, F.lit("no reply")))
        )
        return _outcome(first["content"], error)

    return let(F.from_json(reply, S.PREDICT_REPLY), read)


def raw_capture(text: Column, status: Column) -> Column:
    """What to keep for debugging: the reply, or the error that came instead."""
    return F.coalesce(text, F.concat(F.lit("ERROR: "), status))
