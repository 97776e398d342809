"""The output table as stored buckets with a log of changes: a merge writes only what changed.

Two catalog tables share one bucketing by id, so they meet without an exchange, as does any other
table that ``store_bucketed`` lays out the same way. The base is also parted into slices by a second
hash of the id, the unit that compaction rewrites. Results of a load are appended to the log as one
partition of it, named by the load: a load that runs again finds its partition and does nothing.
A reader folds the log into the base row by row; compaction does the same for the slices where the log
has grown, and a row remembers up to which load it holds the log.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom import schemas as S
from shelfloom.session import materialise


def store_bucketed(df: DataFrame, name: str, buckets: int, key: str = "id", parts: tuple[str, ...] = ()) -> DataFrame:
    """Create a table bucketed and sorted by ``key``, a file per bucket and part; returns the table."""
    writer = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd")
    writer = writer.bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def add_rows(rows: DataFrame, name: str, buckets: int, key: str = "id", replace: bool = False) -> None:
    """Add rows to a bucketed table, or ``replace`` the parts that they have and no others.

    Replaced parts must not be what ``rows`` reads from.
    """
    spark, setting = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    ordered = rows.select(*spark.table(name).columns).repartition(buckets, key)
    before = spark.conf.get(setting)
    # Only the session says that other parts stay.
    spark.conf.set(setting, "dynamic")
    try:
        ordered.write.mode("overwrite" if replace else "append").insertInto(name)
    finally:
        spark.conf.set(setting, before)


class Ledger:
    """A stored output table under a name of the catalog.

    ``buckets`` bounds a task's share of a join and ``slices`` the least that compaction rewrites; both
    are fixed when the table is created. Rows without an id stay as they are.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, slices: int = 16):
        self.spark, self.buckets, self.slices = spark, buckets, slices
        self.base_name, self.log_name = f"{name}_base", f"{name}_log"

    def slice_of(self, key: str = "id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slices)).cast("int")

    def create(self, output: DataFrame) -> Ledger:
        """Store an output table and an empty log."""
        rows = output.select(*[f.name for f in S.OUTPUT.fields])
        rows = rows.withColumns({"folded": F.lit(-1).cast("long"), "slice": self.slice_of()})
        store_bucketed(rows, self.base_name, self.buckets, parts=("slice",))
        log = "id string, target string, text string, raw string, slice int, seq long, load string"
        empty = self.spark.createDataFrame([], log)
        store_bucketed(empty, self.log_name, self.buckets, parts=("seq", "load"))
        return self

    def loads(self) -> dict[str, int]:
        """Loads in the log by name with their place in order; one entry per load not yet trimmed."""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.log_name}").collect()
        found = [re.fullmatch(r"seq=(\d+)/load=(.*)", r[0]) for r in rows]
        return {m[2]: int(m[1]) for m in found}

    def append(self, results: dict[str, DataFrame], load: str) -> bool:
        """Log the results of a load (id, text and raw per target); False if it is there already.

        Several results of a load for one id and target come down to the smallest raw reply. Every id
        counts one try per target and load, whatever the reply says.
        """
        if not re.fullmatch(r"[\w.-]+", load, re.ASCII):
            raise ValueError(f"a load is named by letters, digits, dots and dashes, not {load!r}")
        held = self.loads()
        if load in held:
            return False
        folded = self.spark.table(self.base_name).agg(F.max("folded")).first()[0]
        seq = max([-1 if folded is None else folded, *held.values()]) + 1
        stacked = reduce(
            DataFrame.unionByName,
            [df.where("id IS NOT NULL").select("id", F.lit(n).alias("target"), "text", "raw") for n, df in results.items()],
        )
        single = stacked.groupBy("id", "target").agg(F.min(F.struct("raw", "text")).alias("r"))
        single = single.select(
            "id", "target", "r.text", F.coalesce("r.raw", F.lit("")).alias("raw"), self.slice_of().alias("slice"),
            F.lit(seq).cast("long").alias("seq"), F.lit(load).alias("load"),
        )
        add_rows(single, self.log_name, self.buckets)
        return True

    def _folded(self, condition: Column | None = None) -> DataFrame:
        """Base and log of some slices in one, with the columns of the base; no rows are moved."""
        base, log = self.spark.table(self.base_name), self.spark.table(self.log_name)
        if condition is not None:
            base, log = base.where(condition), log.where(condition)
        # As many entries per id as there are loads between two compactions.
        news = log.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "target", "text", "raw"))).alias("_news"))
        joined = base.join(news.hint("merge"), "id", "full_outer")
        since = F.coalesce("folded", F.lit(-1))
        joined = joined.withColumn("_news", F.filter(F.coalesce("_news", F.array()), lambda c: c["seq"] > since))
        changed = F.size("_news") > 0
        values = {
            "tries": F.when(changed, F.coalesce("tries", F.lit(0)) + F.size("_news")).otherwise(F.col("tries")).cast("long"),
            "updated_at": F.when(changed, F.current_timestamp()).otherwise(F.col("updated_at")),
            "slice": F.coalesce("slice", self.slice_of()),
            "folded": F.when(changed, F.get("_news", F.size("_news") - 1)["seq"]).otherwise(since),
        }
        for target in S.TARGETS.values():
            name = target.name
            own = F.filter("_news", lambda c: c["target"] == name)  # noqa: B023
            text, raw = F.filter(own, lambda c: c["text"].isNotNull()), own
            last = lambda xs: F.get(xs, F.size(xs) - 1)
            values[target.column] = F.coalesce(last(text)["text"], F.col(target.column))
            values[target.raw_column] = F.coalesce(last(raw)["raw"], F.col(target.raw_column))
        return joined.select(*[values.get(c, F.col(c)).alias(c) for c in base.columns])

    def read(self) -> DataFrame:
        """The output table with all loads merged."""
        return self._folded().select(*[f.name for f in S.OUTPUT.fields])

    def compact(self, share: float = 0.1) -> list[int]:
        """Fold the log into the slices where it holds at least ``share`` of the base's rows.

        Returns the slices that were rewritten; the files of all others stay. A broken compaction
        leaves rows that know what they hold, so it can be run again. Log partitions that no row
        needs any more are dropped.
        """
        base, log = self.spark.table(self.base_name), self.spark.table(self.log_name)
        known = base.select("id", "folded")
        waiting = log.join(known.hint("merge"), "id", "left").where(F.col("seq") > F.coalesce("folded", F.lit(-1)))
        sizes = base.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
        grown = waiting.groupBy("slice").agg(F.count(F.lit(1)).alias("m")).join(sizes, "slice", "left")
        due = sorted(r[0] for r in grown.where(F.col("m") >= share * F.coalesce("n", F.lit(0))).select("slice").collect())
        if due:
            rows = materialise(self._folded(F.col("slice").isin(due)), "compacted")
            add_rows(rows, self.base_name, self.buckets, replace=True)
            self.spark.catalog.refreshTable(self.base_name)
        needed = {r[0] for r in waiting.select("load").distinct().collect()}
        for load, seq in self.loads().items():
            if load not in needed:
                self.spark.sql(f"ALTER TABLE {self.log_name} DROP PARTITION (seq={seq}, load='{load}')")
        return due

    def drop(self) -> None:
        """Remove both tables."""
        for name in (self.base_name, self.log_name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
