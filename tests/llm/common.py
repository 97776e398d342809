"""Small documents for the corpus operators, and what more than one test needs."""

import re
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return WORD.findall(text or "")


def documents(spark, texts, sources=None):
    """A documents table from ``(doc_id, text)`` pairs."""
    rows = [
        (i, t, "en", (sources or {}).get(i, f"src{(i or 0) % 3}"), len(t or "")) for i, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_extra(df):
    """The table with columns whose names operators use or return themselves."""
    from pyspark.sql import functions as F

    names = ["size", "kept", "keep_id", "_row", "_id", "_text", "shard", "node", "target", "score"]
    return df.withColumns({n: F.lit("x") for n in names})


def found(df, *columns):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
