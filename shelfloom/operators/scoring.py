"""Structured replies to scored, checked and approved records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom.functions import attributes as A
from shelfloom.functions.parsing import parse_description_reply, parse_title_reply
from shelfloom.functions.text import number_text, split_keys, split_list, strip


@dataclass(frozen=True)
class Scoring:
    """Settings of the title and description step."""

    titles: bool = True
    descriptions: bool = True
    prefer_generated_values: bool = False
    use_model_titles: bool = False
    allowed_words: tuple[str, ...] = ()
    min_title_score: float = 0.0
    min_description_score: float = 0.0
    separator: str = C.LIST_SEPARATOR
    id_col: str = "id"
    title_col: str = "title"
    description_col: str = "description"


def item_map(columns: list[str]) -> Column:
    """A row as a map from column name to text, '' where it holds nothing."""
    pairs = []
    for c in columns:
        pairs += [F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def with_item(
    feed: DataFrame,
    settings: Scoring = Scoring(),
    columns: list[str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id, original texts and the row as a map ``item`` of the given columns, by default all."""
    return feed.select(
        F.col(settings.id_col).cast("string").alias("id"),
        F.coalesce(F.col(settings.title_col), F.lit("")).alias("title_original"),
        F.coalesce(F.col(settings.description_col), F.lit("")).alias("description_original"),
        item_map(columns or feed.columns).alias("item"),
        *keep,
    )


# The texts of a row that its item holds as well.
ORIGINALS = ("title_original", "description_original")


def with_originals(items: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """The original texts read out of an item of all columns, as ``with_item`` gives them."""
    columns = (settings.title_col, settings.description_col)
    return items.withColumns({name: F.col("item")[c] for name, c in zip(ORIGINALS, columns)})


def title_parts(df: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """Read ``title_reply`` into category, keys, values, gaps, features and the composed title."""
    sep = settings.separator
    parsed = df.withColumn("_reply", parse_title_reply(F.col("title_reply")))
    listed = parsed.withColumns(
        {
            "title_error": F.col("_reply.error"),
            "category": F.col("_reply.category"),
            "original_keys": split_list(F.col("_reply.original_keys"), sep),
            "_keys": split_list(F.col("_reply.keys"), sep),
            "_values": split_list(F.col("_reply.values"), sep),
            "_replaced": split_keys(F.col("_reply.replaced_keys")),
            "_model_title": F.col("_reply.title"),
        }
    )
    valued = listed.withColumns(
        {
            "gaps": A.gap_attributes(
                F.col("item"),
                F.col("original_keys"),
                F.col("_keys"),
                F.col("_values"),
                F.col("_replaced"),
            ),
            "features": A.title_features(
                F.col("item"), F.col("_keys"), F.col("_values"), settings.prefer_generated_values
            ),
        }
    )
    titled = valued.withColumns(
        {
            "title_keys": F.transform("features", lambda e: e["key"]),
            "title_generated": A.compose_title(
                F.col("features"), F.col("_model_title"), settings.use_model_titles
            ),
        }
    )
    return titled.drop("_reply", "_keys", "_values", "_replaced", "_model_title")


def title_metrics(df: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """Add new and removed words, attribute changes and the title score."""
    known = A.known_words(F.col("item"), F.col("features"), list(settings.allowed_words))
    added, removed = A.attribute_diff(F.col("original_keys"), F.col("title_keys"))
    worded = df.withColumn("_known", known).withColumns(
        {
            "new_words": A.new_words(F.col("title_generated"), F.col("_known")),
            "removed_words": A.removed_words(F.col("title_original"), F.col("title_generated")),
            "added_keys": added,
            "removed_keys": removed,
        }
    )
    score = A.title_score(
        F.col("new_words"), F.col("removed_words"), F.col("gaps"), F.col("added_keys")
    )
    return worded.withColumn("title_score", score).drop("_known")


def _keep_title(df: DataFrame) -> DataFrame:
    """What stands in the record when titles are not generated."""
    return df.select(
        "*",
        F.lit(None).cast("string").alias("title_error"),
        F.col("title_original").alias("title_generated"),
        F.lit(1.0).alias("title_score"),
        F.lit("FALSE").alias("title_changed"),
        F.lit("0").alias("new_words_added"),
        F.lit("0").alias("words_removed"),
        F.lit("").alias("original_template"),
        F.lit("").alias("generated_template"),
        F.lit("[]").alias("added_attributes"),
        F.lit("[]").alias("removed_attributes"),
        F.lit("").alias("gap_attributes"),
        F.lit("").alias("category"),
        F.lit("N/A").alias("_title_response"),
    )


def _describe_title(df: DataFrame) -> DataFrame:
    """The metrics of a generated title as the texts of the record."""
    glue = f" {C.LIST_SEPARATOR} "
    shown = df.withColumns(
        {
            "title_changed": F.when(F.col("title_score") != 0, "true").otherwise("false"),
            "new_words_added": F.array_join("new_words", glue),
            "words_removed": F.array_join("removed_words", glue),
            "original_template": A.render_template(F.col("original_keys")),
            "generated_template": A.render_template(F.col("title_keys")),
            "added_attributes": A.render_template(F.col("added_keys")),
            "removed_attributes": A.render_template(F.col("removed_keys")),
            "gap_attributes": F.when(F.size("gaps") > 0, F.to_json("gaps")).otherwise(""),
            "_title_response": strip(F.col("title_reply")),
        }
    )
    return shown.drop(
        "new_words", "removed_words", "original_keys", "title_keys", "added_keys", "removed_keys",
        "features", "gaps",
    )


def scored_titles(df: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """Rows of ``with_item`` and ``title_reply`` with everything the record says about titles."""
    if not settings.titles:
        return _keep_title(df)
    return _describe_title(title_metrics(title_parts(df, settings), settings))


def described(df: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """Read ``description_reply``; without generation the original description stays."""
    if not settings.descriptions:
        return df.select(
            "*",
            F.lit(None).cast("string").alias("description_error"),
            F.col("description_original").alias("description_generated"),
            F.lit(-1.0).alias("description_score"),
            F.lit("No Evaluation").alias("_evaluation"),
        )
    return df.withColumn("_reply", parse_description_reply(F.col("description_reply"))).select(
        *[F.col(c) for c in df.columns],
        F.col("_reply.error").alias("description_error"),
        F.col("_reply.description").alias("description_generated"),
        F.col("_reply.score").alias("description_score"),
        F.col("_reply.reasoning").alias("_evaluation"),
    )


def generated_record(df: DataFrame, settings: Scoring = Scoring()) -> DataFrame:
    """The 23 columns of a result row; a reply that could not be read gives a failure row."""
    error = F.coalesce("title_error", "description_error")
    failed = error.isNotNull()
    status = A.compliance(F.col("title_generated"), F.col("description_generated"))
    score = F.when(status == C.NON_COMPLIANT, F.lit(-1.0)).otherwise(F.col("title_score"))
    approval = A.approve(
        score,
        F.col("description_score"),
        settings.min_title_score,
        settings.min_description_score,
        settings.descriptions,
    )
    # A score that is no number reads NaN, as text and in the response.
    description_score = F.coalesce(number_text(F.col("description_score")), F.lit("NaN"))
    response = F.concat(
        F.col("_title_response"),
        F.lit("\nProduct description: "),
        F.col("description_generated"),
        F.lit("\nDescription evaluation: Score: "),
        description_score,
        F.lit("\n"),
        F.col("_evaluation"),
    )
    regular = {
        "approval": approval,
        "status": status,
        "title_generated": F.col("title_generated"),
        "title_original": F.col("title_original"),
        "score": number_text(score),
        "title_changed": F.col("title_changed"),
        "title_length": F.length("title_generated").cast("string"),
        "new_words_added": F.col("new_words_added"),
        "words_removed": F.col("words_removed"),
        "original_template": F.col("original_template"),
        "generated_template": F.col("generated_template"),
        "added_attributes": F.col("added_attributes"),
        "removed_attributes": F.col("removed_attributes"),
        "gap_attributes": F.col("gap_attributes"),
        "description_generated": F.col("description_generated"),
        "description_original": F.col("description_original"),
        "description_changed": F.col("description_generated") != F.col("description_original"),
        "description_length": F.length("description_generated").cast("string"),
        "description_score": F.col("description_score"),
        "category": F.col("category"),
        "full_response": response,
        "original_input": F.to_json("item"),
    }
    on_failure = {"status": F.lit(C.FAILED_TEXT), "full_response": error}
    columns = {
        name: F.when(failed, on_failure.get(name)).otherwise(col)
        if name in on_failure
        else F.when(~failed, col)
        for name, col in regular.items()
    }
    order = ["approval", "status", "id", *[c for c in regular if c not in ("approval", "status")]]
    return df.select(*[(F.col("id") if c == "id" else columns[c]).alias(c) for c in order])
