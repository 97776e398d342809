"""Reply files as a stream: every start takes up only the files that came since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfloom import schemas as S
from shelfloom.plans.generation import decoded
from shelfloom.sources.ledger import Ledger

# Finished part files of a job and single files of a service; those in progress begin with a
# dot or an underscore, which the source leaves out.
REPLY_FILES = "{part-*,*.jsonl}"


def load_new_replies(
    ledger: Ledger, folder: str, target: str, checkpoint: str, strict: bool = False, files_per_batch: int | None = None
) -> int:
    """Merge the reply files of a target that no earlier start has merged; returns how many batches ran.

    The stream's checkpoint knows the files, at any depth below the folder, so none is listed or read
    again by the caller. A batch is a load of the ledger under its own number, and a batch that is
    repeated after a failure is merged once. Lines that are no replies are left out.
    """
    spark = ledger.spark
    source = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", REPLY_FILES)
    if files_per_batch is not None:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    merged = []

    def merge(batch: DataFrame, number: int) -> None:
        replies = decoded(batch.where("length(trim(value)) > 0"), S.TARGETS[target], strict)
        if ledger.append({target: replies}, f"{target}-{number:09d}"):
            merged.append(number)

    stream = source.load(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return len(merged)
