"""The same functions for SQL texts, as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfloom import constants as C
from shelfloom.functions.prompts import load_template, pieces

_EXAMPLES = "ARRAY<STRUCT<id: STRING, properties: STRING, title: STRING, description: STRING>>"


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prompt(template: str, field: str) -> str:
    slots = {
        "LANGUAGE": "language",
        "EXAMPLE_INPUTS": "array_join(transform(examples, e -> e.properties), '\\n', '')",
        "EXAMPLE_OUTPUTS": (
            f"array_join(transform(examples, e -> concat(e.id, ': ', e.{field})), '\\n', '')"
        ),
        "INPUTS": "array_join(properties, '\\n', '')",
    }
    parts = pieces(load_template(template), "{{LANGUAGE}}")
    return ", ".join(_literal(v) if kind == "text" else slots[v] for kind, v in parts)


def register_functions(spark: SparkSession) -> None:
    """Create ``embed_for_feed(value, is_ai)``, ``titles_prompt(language, examples, properties)``
    and ``descriptions_prompt(language, examples, properties)`` in the session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION embed_for_feed(value STRING, is_ai BOOLEAN) "
        f"RETURNS STRING RETURN concat(if(is_ai, '{C.AI_MARKER}', ''), ':\"', "
        "replace(value, '\"', '\"\"'), '\"')"
    )
    for name, template, field in (
        ("titles_prompt", "title_lines", "title"),
        ("descriptions_prompt", "description_lines", "description"),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(language STRING, "
            f"examples {_EXAMPLES}, properties ARRAY<STRING>) "
            f"RETURNS STRING RETURN concat({_prompt(template, field)})"
        )


def _group(text: str, pattern: str) -> str:
    """SQL for the first group of a pattern, null where nothing matches."""
    return f"CASE WHEN regexp_like({text}, {_literal(pattern)}) THEN regexp_extract({text}, {_literal(pattern)}, 1) END"


def register_table_functions(spark: SparkSession) -> None:
    """Create the table functions ``title_blocks(reply)``, ``description_blocks(reply)`` and
    ``reply_answers(reply, ids)`` in the session, to be called as LATERAL.

    Each gives ``position, id, text``, a row per answer of a reply in its order. They are SQL
    themselves, so a query that calls them is planned as one.
    """
    answers = "RETURNS TABLE (position INT, id STRING, text STRING)"
    for name, block, text in (
        ("title_blocks", C.TITLE_BLOCK, C.BLOCK_TITLE),
        ("description_blocks", C.DESCRIPTION_BLOCK, C.BLOCK_DESCRIPTION),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(reply STRING) {answers} RETURN "
            f"SELECT position, id, text FROM (SELECT position, {_group('block', C.BLOCK_ID)} AS id, "
            f"{_group('block', text)} AS text FROM "
            f"posexplode(regexp_extract_all(reply, {_literal(block)}, 0)) AS b(position, block)) WHERE id IS NOT NULL"
        )
    whole, alone = _literal(C.LINE_ID_AND_TEXT), _group("line", C.LINE_ID_ONLY)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION reply_answers(reply STRING, ids ARRAY<STRING>) {answers} RETURN "
        f"SELECT position, coalesce({_group('line', C.LINE_ID_AND_TEXT)}, {alone}) AS id, "
        f"CASE WHEN regexp_like(line, {whole}) THEN regexp_extract(line, {whole}, 2) END AS text "
        "FROM posexplode(coalesce(split(reply, '\n'), ids)) AS l(position, line)"
    )
