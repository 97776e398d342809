"""Table layouts and the three generation targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

OUTPUT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("highlights", T.StringType()),
        T.StructField("tries", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("raw_response_title", T.StringType()),
        T.StructField("raw_response_description", T.StringType()),
        T.StructField("raw_response_highlights", T.StringType()),
    ]
)

EXAMPLES = "id STRING, properties STRING, title STRING, description STRING"

# One line of a reply file. Payloads stay text here and are decoded in a second step, so a payload
# that arrives as an encoded string reads the same as one that arrives as an object.
REPLY_RECORD = (
    "id STRING, custom_id STRING, instance STRUCT<id: STRING>, response STRING, "
    "prediction STRING, request STRING, _corrupt STRING"
)
CANDIDATES = (
    "candidates ARRAY<STRUCT<finishReason: STRING, "
    "content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>"
)
STREAM_CHUNKS = (
    "ARRAY<STRUCT<error: STRING, candidates: ARRAY<STRUCT<finishReason: STRING, "
    "content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>>>"
)
PREDICT_REPLY = (
    "predictions ARRAY<STRUCT<content: STRING, safetyAttributes: STRUCT<blocked: BOOLEAN>>>"
)
REQUEST_PARTS = "contents ARRAY<STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>"


@dataclass(frozen=True)
class Target:
    """What one kind of generated text reads and writes."""

    name: str
    column: str
    example_field: str

    @property
    def raw_column(self) -> str:
        return f"raw_response_{self.column}"


TITLES = Target("titles", "title", "title")
DESCRIPTIONS = Target("descriptions", "description", "description")
HIGHLIGHTS = Target("highlights", "highlights", "description")
TARGETS = {t.name: t for t in (TITLES, DESCRIPTIONS, HIGHLIGHTS)}
