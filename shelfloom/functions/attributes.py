"""Attribute logic, title metrics, compliance and approval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfloom import constants as C
from shelfloom.functions.text import drop_possessive, let, strip, words


def clean_value(key: Column, value: Column, strip_comma: bool = False) -> Column:
    """The value, or '' when it only repeats its key or is a lone comma."""
    val = strip(value)
    cut = F.when(val.endswith(","), F.substring(val, F.lit(1), F.length(val) - 1)).otherwise(val)
    empty = (F.lower(key) == F.lower(val)) | (F.lower(key) == F.lower(strip(cut))) | (val == ",")
    return F.when(empty, F.lit("")).otherwise(cut if strip_comma else val)


def _present(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def key_values(keys: Column, values: Column) -> Column:
    """Keys with the values of the same position, null where there are fewer values."""
    return let(
        keys,
        values,
        lambda ks, vs: F.transform(
            ks, lambda k, i: F.struct(k.alias("key"), F.get(vs, i).alias("value"))
        ),
    )


def map_keeping_last(entries: Column) -> Column:
    """A map of key/value structs: keys in order of first appearance, the last value wins."""

    def build(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["key"]))
        values = F.transform(
            keys, lambda k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1)["value"]
        )
        return F.map_from_arrays(keys, values)

    return let(entries, build)


def gap_attributes(
    item: Column, original_keys: Column, keys: Column, values: Column, replaced: Column
) -> Column:
    """Attributes the reply fills in or invents, as a map.

    Taken are keys without a value in the item that got one and are either not part of the original
    title or a column of the item, and all keys reported as replaced.
    """

    def wanted(e: Column, row: Column, originals: Column, corrected: Column) -> Column:
        gap = (F.coalesce(row[e["key"]], F.lit("")) == "") & (
            F.coalesce(e["value"], F.lit("")) != ""
        )
        known = ~F.array_contains(originals, e["key"]) | F.map_contains_key(row, e["key"])
        named = F.array_contains(corrected, F.lower(e["key"])) & e["value"].isNotNull()
        return F.coalesce((gap & known) | named, F.lit(False))

    chosen = let(
        item,
        original_keys,
        replaced,
        key_values(keys, values),
        lambda row, originals, corrected, pairs: F.filter(
            pairs, lambda e: wanted(e, row, originals, corrected)
        ),
    )
    taken = F.transform(
        chosen,
        lambda e: F.struct(
            e["key"].alias("key"),
            strip(clean_value(e["key"], e["value"], strip_comma=True)).alias("value"),
        ),
    )
    return map_keeping_last(F.filter(taken, lambda e: e["value"] != ""))


def title_features(
    item: Column, keys: Column, values: Column, prefer_generated: bool = False
) -> Column:
    """Key and value of each attribute that goes into the title."""

    def choose(e: Column, row: Column) -> Column:
        if prefer_generated:
            return e["value"]
        own = row[e["key"]]
        return F.when(F.length(own) > 0, own).otherwise(e["value"])

    chosen = let(
        item,
        key_values(keys, values),
        lambda row, pairs: F.transform(
            pairs, lambda e: F.struct(e["key"].alias("key"), choose(e, row).alias("value"))
        ),
    )
    cleaned = F.transform(
        F.filter(chosen, lambda e: _present(e["value"])),
        lambda e: F.struct(
            e["key"].alias("key"), strip(clean_value(e["key"], e["value"])).alias("value")
        ),
    )
    return F.filter(cleaned, lambda e: e["value"] != "")


def compose_title(features: Column, model_title: Column, use_model_title: bool = False) -> Column:
    """The attribute values in order, or the title the model wrote."""
    if use_model_title:
        return strip(model_title)
    return F.regexp_replace(
        F.array_join(F.transform(features, lambda e: e["value"]), " "), r",\z", ""
    )


def render_template(keys: Column) -> Column:
    """Keys as ``<a> <b>``."""
    shown = F.filter(keys, lambda k: k != "")
    return F.array_join(F.transform(shown, lambda k: F.concat(F.lit("<"), k, F.lit(">"))), " ")


def known_words(item: Column, features: Column, allowed: list[str]) -> Column:
    """Lower-cased words a title may use: those of the item's keys and values, the allowed words,
    and the words of features taken from an image or a page."""
    entries = F.transform(
        F.map_entries(item),
        lambda e: F.concat(e["key"], F.lit(" "), drop_possessive(F.coalesce(e["value"], F.lit("")))),
    )
    extra = F.transform(
        F.filter(features, lambda e: e["key"].isin(*C.FEATURE_KEYS)), lambda e: e["value"]
    )
    found = F.transform(words(F.array_join(F.concat(entries, extra), " ")), F.lower)
    listed = [w.strip().lower() for w in allowed if w]
    return F.concat(found, F.array(*[F.lit(w) for w in listed]).cast("array<string>"))


def new_words(title: Column, known: Column) -> Column:
    """Words of the generated title that the item does not know."""

    def build(ws: Column, ks: Column) -> Column:
        # One hash lookup over the item's words, however many there are.
        unknown = F.array_except(F.transform(ws, F.lower), ks)
        return let(unknown, lambda us: F.filter(ws, lambda w: F.array_contains(us, F.lower(w))))

    return F.array_distinct(let(words(drop_possessive(title)), known, build))


def removed_words(original: Column, title: Column) -> Column:
    """Words of the original title that the generated one lost."""

    def build(ws: Column, kept: Column, plain: Column) -> Column:
        return F.filter(
            ws, lambda w: ~F.array_contains(kept, F.lower(w)) & ~F.contains(plain, w)
        )

    kept = F.transform(words(drop_possessive(title)), F.lower)
    plain = F.replace(title, F.lit("'"), F.lit(""))
    return F.array_distinct(let(words(drop_possessive(original)), kept, plain, build))


def attribute_diff(original_keys: Column, keys: Column) -> tuple[Column, Column]:
    """Keys that were added to a title and keys that were removed from it, blanks left out."""

    def difference(a: Column, b: Column) -> Column:
        return F.filter(F.array_except(a, b), lambda k: k != "")

    return difference(keys, original_keys), difference(original_keys, keys)


def split_gaps(gaps: Column, item: Column) -> tuple[Column, Column]:
    """Gaps of existing columns, and invented attributes."""
    return (
        F.map_filter(gaps, lambda k, v: F.map_contains_key(item, k)),
        F.map_filter(gaps, lambda k, v: ~F.map_contains_key(item, k)),
    )


def title_score(new: Column, removed: Column, gaps: Column, added_keys: Column) -> Column:
    """-1 for new words, -0.5 for lost words, else half a point each for gaps and attributes."""
    bonus = (F.size(gaps) > 0).cast("double") + (F.size(added_keys) > 0).cast("double")
    return F.when(F.size(new) > 0, -1.0).when(F.size(removed) > 0, -0.5).otherwise(bonus / 2)


def compliance(title: Column, description: Column) -> Column:
    """Whether both texts are there and within their length limits."""
    fits = F.length(title).between(1, C.TITLE_MAX_LENGTH) & F.length(description).between(
        1, C.DESCRIPTION_MAX_LENGTH
    )
    return F.when(F.coalesce(fits, F.lit(False)), C.SUCCESS).otherwise(C.NON_COMPLIANT)


def approve(
    score: Column,
    description_score: Column,
    min_score: float,
    min_description_score: float,
    descriptions: bool = True,
) -> Column:
    """Whether the scores reach their minimums; a score that is no number does not."""
    enough = score >= min_score
    if descriptions:
        enough = enough & (description_score >= min_description_score)
    return F.coalesce(enough, F.lit(False))
