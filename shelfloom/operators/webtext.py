"""Page text per item, its report, and the request for a selector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.pages import clean_html, selected_text
from shelfloom.operators.prepare import sample_rows


def extract_by_selector(pages: DataFrame, selector: str) -> DataFrame:
    """id and content of every page (id, html); pages that were not fetched have no content."""
    return pages.select("id", selected_text(F.col("html"), selector).alias("content"))


def extraction_report(extracted: DataFrame) -> DataFrame:
    """Total, fetched, extracted and failed pages of rows (html, content)."""
    found = F.coalesce(F.col("content") != "", F.lit(False))
    return extracted.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("html").alias("success"),
        F.count_if(found).alias("extracted"),
        F.count_if(~found).alias("failed"),
    )


def selector_prompt(
    instructions: str, pages: DataFrame, sample: int = 5, limit: int | None = None, seed: int = 0
) -> DataFrame:
    """One prompt out of a few pages (page_id, html), each under its own heading, in order of id.

    ``sample`` pages are drawn by a digest of their id and the seed, so the prompt stays small
    however many pages there are. ``limit`` cuts each page; without it pages are shown whole.
    """
    picked = sample_rows(pages.where("html is not null"), sample, seed, "page_id")
    cleaned = picked.select("page_id", clean_html(F.col("html"), limit).alias("html"))
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("page_id", "html"))),
        lambda p, i: F.concat(
            F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p["html"], F.lit("\n\n")
        ),
    )
    return cleaned.agg(F.concat(F.lit(instructions), F.array_join(listed, "")).alias("prompt"))
