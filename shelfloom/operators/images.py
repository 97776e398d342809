"""Image links, stored images and the descriptions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions.text import image_object_name, match
from shelfloom.operators.prepare import spread_left_join, without
from shelfloom.session import materialise


# Length of the pieces by which names are looked up in links.
PIECE = 4


def image_urls(feed: DataFrame, link_col: str = "image_url") -> DataFrame:
    """The distinct image links of a feed."""
    return feed.select(F.col(link_col).alias("url")).where("url is not null").distinct()


def image_registry(urls: DataFrame, objects: DataFrame) -> DataFrame:
    """Each link with the object it belongs to and whether that object exists (``name`` rows)."""
    named = urls.select("url", image_object_name(F.col("url")).alias("name"))
    present = objects.select("name").distinct().withColumn("_there", F.lit(True))
    return named.join(present, "name", "left").select(
        "url", "name", F.coalesce("_there", F.lit(False)).alias("stored")
    )


def new_images(urls: DataFrame, objects: DataFrame) -> DataFrame:
    """Links whose object does not exist yet."""
    named = urls.select("url", image_object_name(F.col("url")).alias("name"))
    return without(named, objects, "name")


def image_report(registry: DataFrame) -> DataFrame:
    """How many links there are, how many are to be stored and how many are skipped."""
    return registry.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("stored")).alias("success"),
        F.count_if(F.col("stored")).alias("skipped"),
    )


def object_stats(objects: DataFrame) -> DataFrame:
    """Number and total size of stored objects."""
    return objects.agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
    )


def uri_name(col: Column) -> Column:
    """The file name of a stored object."""
    return match(col, r"(?s).*/([^/]+)")


def with_image_text(
    feed: DataFrame,
    images: DataFrame,
    link_col: str = "image_link",
) -> DataFrame:
    """The feed with the description of every image whose file name occurs in the item's link.

    A link matches a name as in ``link LIKE '%name%'``: ``_`` in a name stands for any character and
    ``%`` for any run of them; items without a match keep one row without a description. A row may
    match several images.
    """
    links = feed.select(F.col(link_col).alias("_link")).where("_link is not null").distinct()
    named = images.select(uri_name(F.col("uri")).alias("name"), "description")
    names = materialise(named.where("name is not null"), "image-names")
    pairs = names_in_links(links, names.select("name").distinct())
    texts = pairs.join(names, "name").select(
        F.col("_link").alias(link_col), F.col("description").alias("image_description")
    )
    return spread_left_join(feed, texts, link_col)


def _pieces(texts: Column, size: Column) -> Column:
    """All distinct substrings of a length of an array of texts."""
    longer = F.filter(texts, lambda s: F.length(s) >= size)
    cut = F.transform(
        longer,
        lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s) - size + 1), lambda i: F.substring(s, i, size)
        ),
    )
    return F.array_distinct(F.flatten(cut))


def names_in_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """All pairs of a link and a name it contains, found by an equality join.

    A name that occurs in a link brings every piece of its literal parts with it. So each name is
    looked up by one piece alone, the one that the fewest names have, and each link offers its pieces:
    one row per place and piece length, however many names there are. Names without ``PIECE``
    literal characters in a row are looked up by the longest run they have. The pairs that meet are
    checked against the full pattern. A name made of wildcards alone says nothing about a link and
    is left out; a backslash in a name is taken literally.
    """
    literals = F.filter(F.split("name", "[%_]"), lambda s: s != "")
    longest = F.array_max(F.transform(literals, lambda s: F.length(s)))
    sized = names.select("name", literals.alias("_literals"), F.least(F.lit(PIECE), longest).alias("_size"))
    pieces = sized.where("_size > 0").select(
        "name", "_size", F.explode(_pieces(F.col("_literals"), F.col("_size"))).alias("piece")
    )
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("_names"))
    rarest = pieces.join(shared, "piece").groupBy("name").agg(F.min(F.struct("_names", "piece")).alias("_best"))
    index = materialise(rarest.select("name", F.col("_best.piece").alias("piece")), "name-pieces")
    # At most as many lengths as a piece has characters.
    sizes = index.agg(F.collect_set(F.length("piece")).alias("sizes")).scalar()
    offered = links.select("_link", F.explode(sizes).alias("_size")).select(
        "_link", F.explode(_pieces(F.array("_link"), F.col("_size"))).alias("piece")
    )
    met = offered.join(index, "piece")
    return met.where(r"_link LIKE concat('%', replace(name, '\\', '\\\\'), '%')").select("_link", "name")
