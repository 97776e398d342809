"""Small text expressions shared by the other modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom import constants as C


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(col, F.lit(C.WHITESPACE))


def squash(col: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(strip(col)) > 0, col)


def match(col: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches.

    The pattern is searched a second time only where the group came out empty.
    """
    found = F.regexp_extract(col, pattern, group)
    return F.coalesce(F.nullif(found, F.lit("")), F.when(col.rlike(pattern), F.lit("")))


def let(*values_and_body) -> Column:
    """``let(a, b, body)``: ``body(a, b)`` with each value computed once per row.

    An expression that a lambda refers to is otherwise computed again for every element.
    """
    *values, body = values_and_body
    names = [f"v{i}" for i in range(len(values))]
    packed = F.struct(*[v.alias(n) for v, n in zip(values, names)])
    return F.transform(F.array(packed), lambda s: body(*[s[n] for n in names]))[0]


def words(col: Column) -> Column:
    """All words of a text, letters and digits only, in order."""
    return F.regexp_extract_all(col, F.lit(C.WORD_PATTERN), F.lit(1))


def word_set(col: Column) -> Column:
    """The distinct runs of ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(C.PLAIN_WORD_PATTERN), F.lit(1)))


def drop_possessive(col: Column) -> Column:
    return F.replace(col, F.lit("'s"), F.lit(""))


def split_list(col: Column, sep: str = C.LIST_SEPARATOR) -> Column:
    """Items of a separated list: empty items go before trimming, so a blank holds its place."""
    items = F.split(strip(col), r"\Q" + sep + r"\E")
    return F.transform(F.filter(items, lambda x: x != ""), strip)


def split_keys(col: Column) -> Column:
    """Lower-cased keys of a comma list; the word ``none`` stands for an empty list."""
    keys = F.transform(split_list(col, ","), F.lower)
    return F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda x: x != "none")


def file_name(col: Column) -> Column:
    """What follows the last slash, null where there is nothing."""
    return match(col, r"/([^/]+)\z")


def image_object_name(col: Column) -> Column:
    """The object an image is stored under; a digest replaces names that are not usable."""
    name = F.element_at(F.split(col, "/"), -1)
    digest = F.concat(F.lit("image_"), F.md5(col), F.lit(".jpg"))
    return F.when((name == "") | name.contains("?"), digest).otherwise(name)


def image_uri(col: Column, bucket: str, enabled: bool = True) -> Column:
    """Where the copy of an image lies, null without a link or with images switched off."""
    if not enabled:
        return F.lit(None).cast("string")
    return F.concat(F.lit(f"gs://{bucket}/images/"), image_object_name(col))


def is_json(col: Column) -> Column:
    """Whether a text is one JSON value."""
    return F.coalesce(F.try_parse_json(col).isNotNull(), F.lit(False))


def part_of(id_col: Column, parts: int) -> Column:
    """A stable part number from the id alone, the same on every engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(id_col), 1, 8), 16, 10).cast("long"), F.lit(parts))


def number_text(col: Column) -> Column:
    """A number as plain text, whole numbers without a decimal point."""
    whole = col == F.floor(col)
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def clean_selector(col: Column) -> Column:
    """A suggested selector without quotes and back-ticks."""
    return strip(F.translate(col, "`\"'", ""))


def embed_for_feed(value: Column, is_ai: Column | bool) -> Column:
    """A structured feed value: optional marker, then the quoted text."""
    flag = is_ai if isinstance(is_ai, Column) else F.lit(is_ai)
    marker = F.when(flag, F.lit(C.AI_MARKER)).otherwise("")
    return F.concat(marker, F.lit(':"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def highlight(col: Column) -> Column:
    return F.concat(F.lit(C.AI_MARKER + ":"), col)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine of the angle between two vectors."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
