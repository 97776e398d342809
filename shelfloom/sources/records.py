"""Request and reply files, CSV feeds, staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.functions.envelopes import decode_record
from shelfloom.session import files_below, list_paths, remove


def reply_folders(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """Folders at any depth that hold replies: with finished parts, and with .jsonl files.

    Parts count once their folder says that it was written to its end.
    """
    parts, done, lines = set(), set(), set()
    for path in files_below(spark, folder):
        place, _, name = path.rpartition("/")
        if name == "_SUCCESS":
            done.add(place)
        elif name.startswith("part-"):
            parts.add(place)
        elif name.endswith(".jsonl"):
            lines.add(place)
    return sorted(parts & done), sorted(lines)


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all finished reply files below a folder, blank ones left out.

    Other files are not read. It is an error if there are no replies at all.
    """
    parts, lines = reply_folders(spark, folder)
    found = [(p, "part-*") for p in [parts] if p] + [(p, "*.jsonl") for p in [lines] if p]
    if not found:
        raise FileNotFoundError(f"no finished replies below {folder}")
    read = [spark.read.option("pathGlobFilter", glob).text(places) for places, glob in found]
    both = read[0] if len(read) == 1 else read[0].unionByName(read[1])
    return both.where(F.length(F.trim("value")) > 0)


def bad_lines(replies: DataFrame) -> DataFrame:
    """The lines that are not reply records."""
    record = decode_record(F.col("value"))
    return replies.where(record.isNull() | record["_corrupt"].isNotNull())


def newest_run(spark: SparkSession, root: str) -> str:
    """The reply file of the last run folder below a root."""
    found = list_paths(spark, f"{root}/*/predictions.jsonl")
    if not found:
        raise FileNotFoundError(f"no replies below {root}")
    return found[-1]


def read_csv(
    spark: SparkSession, path: str, header: bool = True, sep: str = ",", breaks: bool = False
) -> DataFrame:
    """A feed as text columns; cells may hold doubled quotes.

    ``breaks`` lets them hold line breaks too, and then a file cannot be split among tasks.
    """
    return spark.read.csv(
        path, header=header, sep=sep, multiLine=breaks, quote='"', escape='"', inferSchema=False
    )


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A feed with a header; quotes are doubled and null cells stay empty."""
    df.write.mode("overwrite").csv(
        path, header=True, sep=sep, quote='"', escape='"', emptyValue="", escapeQuotes=True
    )


def read_examples(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """properties, title and description of an examples file, by name or by position."""
    rows = read_csv(spark, path, header, breaks=True)
    names = ("properties", "title", "description")
    picked = [
        F.col(f"`{n}`") if header and n in rows.columns else F.col(f"`{rows.columns[i]}`")
        for i, n in enumerate(names)
    ]
    return rows.select(*[c.alias(n) for c, n in zip(picked, names)])


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a stored table and read it back; ``df`` may read from it.

    The rows become the next version below ``path``, which readers take once it is whole; until
    then they see the one before. That one stays for readers that began with it, older ones go.
    """
    spark = df.sparkSession
    versions = table_versions(spark, path)
    number = versions[-1] + 1 if versions else 1
    df.write.mode("overwrite").parquet(f"{path}/v={number:06d}")
    for old in versions[:-1]:
        remove(spark, f"{path}/v={old:06d}")
    return read_table(spark, path, df.schema)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest whole version of a stored table; no rows if there is none."""
    versions = table_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={versions[-1]:06d}")


def clear_table(spark: SparkSession, path: str, schema) -> None:
    """Replace a stored table by an empty one."""
    replace_table(spark.createDataFrame([], schema), path)


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end, in order."""
    done = list_paths(spark, f"{path}/v=*/_SUCCESS")
    return sorted(int(p.split("/v=")[-1].split("/")[0]) for p in done)


def read_objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Stored images: path, name, length, modification time and content (read only if used)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.select(
        F.col("path").alias("uri"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        "modificationTime",
        "content",
    )


def read_wording(spark: SparkSession, path: str) -> str:
    """A prompt template kept as one file."""
    return spark.read.text(path, wholetext=True).first()[0]
