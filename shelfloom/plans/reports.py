"""Quality check, page text, images and export as whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.pages import selected_text
from shelfloom.functions.prompts import load_template
from shelfloom.functions.text import clean_selector
from shelfloom.generator import Embedder, Generator
from shelfloom.operators import images as I
from shelfloom.operators import quality as Q
from shelfloom.operators import webtext as W
from shelfloom.operators.export import Flags, full_feed, supplemental_feed
from shelfloom.operators.prepare import restrict_to, sample_rows
from shelfloom.session import materialise
from shelfloom.sources.records import write_csv


def quality_check(
    output: DataFrame, prepared: DataFrame, embedder: Embedder, sample: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Distances between original and generated titles of a sample, as a histogram."""
    titled = output.where("title is not null").select("id", F.col("title").alias("content"))
    generated = materialise(sample_rows(titled, sample, seed), "sample")
    originals = restrict_to(
        prepared.select("id", F.col("title").alias("content")), generated
    )
    pairs = Q.pair_vectors(embedder.embed(originals), embedder.embed(generated))
    return Q.similarity_histogram(Q.distances(pairs))


def suggest_selector(
    pages: DataFrame, generator: Generator, sample: int = 5, seed: int = 0
) -> str:
    """Ask for the selector of the product description, from a few sample pages."""
    prompt = W.selector_prompt(load_template("selector"), pages, sample, seed=seed)
    reply = generator.generate(prompt).select(clean_selector(F.col("reply")).alias("selector"))
    return reply.first()["selector"]


def page_texts(pages: DataFrame, selector: str) -> tuple[DataFrame, DataFrame]:
    """Text per page and the report of the extraction."""
    fetched = F.when(F.col("html").isNotNull(), "").alias("html")
    content = selected_text(F.col("html"), selector).alias("content")
    extracted = materialise(pages.select("id", fetched, content), "web")
    return extracted.select("id", "content"), W.extraction_report(extracted)


def register_images(
    feed: DataFrame, objects: DataFrame, link_col: str = "image_url"
) -> tuple[DataFrame, DataFrame]:
    """Links to fetch and the report; fetching itself is left to the caller."""
    urls = I.image_urls(feed, link_col)
    registry = I.image_registry(urls, objects)
    return registry.where(~F.col("stored")).select("url", "name"), I.image_report(registry)


def describe_images(images: DataFrame, generator: Generator) -> DataFrame:
    """A description per stored image."""
    asked = images.withColumn("prompt", F.lit(load_template("image").strip()))
    return generator.generate(asked).select("uri", F.trim("reply").alias("description"))


def export_feed(
    kind: str, raw: DataFrame, output: DataFrame, path: str | None = None,
    flags: Flags = Flags(), sep: str = ",", mode: str = "any",
) -> DataFrame:
    """A supplemental or full feed, written as a file where a path is given."""
    if kind == "supplemental":
        feed = supplemental_feed(output, flags, mode)
    elif kind == "full":
        feed = full_feed(raw, output, flags)
    else:
        raise ValueError(f"unknown feed type: {kind}")
    if path is not None:
        write_csv(feed, path, sep)
    return feed
