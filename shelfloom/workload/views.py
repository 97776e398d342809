"""The feed, pages, images and examples, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.functions.pages import page_text_regex
from shelfloom.functions.prompts import row_json
from shelfloom.operators.examples import examples_by_metric
from shelfloom.operators.merge import init_output
from shelfloom.operators.prepare import metric_band

PROPERTIES = ["title", "description", "brand", "category", "size", "color"]
FILTERED = ["id", *PROPERTIES, "link", "image_link"]


class Tables:
    """The given tables and what is derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw(self) -> DataFrame:
        """One row per part; documents and pages cover some of them, so nulls occur."""
        part = self.read("part").select(
            F.col("p_partkey").alias("_key"),
            F.col("p_partkey").cast("string").alias("id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_size").cast("string").alias("size"),
            F.regexp_extract("p_name", "^([a-z]+)", 1).alias("color"),
            F.concat(
                F.lit("https://img.example.com/"),
                F.lower("p_type"),
                F.lit("/"),
                F.pmod(F.col("p_partkey"), F.lit(50)).cast("string"),
                F.lit(".jpg"),
            ).alias("image_link"),
        )
        texts = self.read("documents").select(
            F.col("doc_id").alias("_key"), F.col("text").alias("description")
        )
        links = self.read("pages").select(F.col("page_id").alias("_key"), F.col("url").alias("link"))
        clicks = (
            self.read("lineitem")
            .groupBy(F.col("l_partkey").alias("_key"))
            .agg(F.count(F.lit(1)).alias("clicks"))
        )
        joined = part.join(texts, "_key", "left").join(links, "_key", "left")
        return joined.join(clicks, "_key", "left").select(
            *FILTERED, F.coalesce("clicks", F.lit(0)).alias("clicks")
        )

    def filtered(self) -> DataFrame:
        """The feed rows with a middling number of clicks."""
        return metric_band(self.raw(), "clicks").select(*FILTERED)

    def web(self) -> DataFrame:
        return self.read("pages").select(
            F.col("page_id").cast("string").alias("id"),
            page_text_regex(F.col("html")).alias("content"),
        )

    def pages(self) -> DataFrame:
        return self.read("pages").select(F.col("page_id").cast("string").alias("id"), "url", "html")

    def images(self) -> DataFrame:
        """One stored image per file name of the feed."""
        names = self.raw().select(F.element_at(F.split("image_link", "/"), -1).alias("name"))
        return names.distinct().select(
            F.concat(F.lit("gs://b/images/"), "name").alias("uri"),
            F.concat(F.lit("image of "), "name").alias("description"),
        )

    def prepared(self) -> DataFrame:
        """What prompts may see: the filtered feed without links."""
        return self.filtered().select("id", *PROPERTIES)

    def examples(self) -> DataFrame:
        return examples_by_metric(self.raw(), "clicks", PROPERTIES, 3)

    def output(self) -> DataFrame:
        return init_output(self.filtered())

    def scoring_feed(self) -> DataFrame:
        """The raw feed with some colors missing, so that there are gaps to fill."""
        color = F.when(F.col("category") == "PROMO", "").otherwise(F.col("color"))
        return self.raw().select(
            "id", "title", "description", "brand", "category", "size", color.alias("color")
        )

    def properties(self) -> DataFrame:
        rows = self.prepared()
        return rows.select("id", row_json(rows.columns).alias("properties"))
