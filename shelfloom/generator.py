"""The model behind a small interface: a table of prompts in, the same table with replies out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Generator(Protocol):
    """Adds ``reply`` and ``status`` to rows that have a ``prompt``."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    """Adds ``vec`` to rows that have ``content``."""

    def embed(self, texts: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ColumnGenerator:
    """Replies computed by a column expression; null stands for a failed request."""

    reply: Callable[[], Column]
    failure: str = "failed"

    def generate(self, prompts: DataFrame) -> DataFrame:
        replied = prompts.withColumn("reply", self.reply().cast("string"))
        return replied.withColumn(
            "status", F.when(F.col("reply").isNull(), self.failure).otherwise("")
        )


@dataclass(frozen=True)
class CallGenerator:
    """Replies of a client that is opened once per task and asked with several calls in flight.

    ``connect`` runs on the executor and returns the function that answers one prompt; with
    ``with_images`` that function also gets the ``uri`` of the prompt's image, or None. A failing
    prompt is tried ``attempts`` times, with a pause that doubles each time, and then yields a null
    reply with the error as status, so one bad prompt never fails the job. ``in_flight`` bounds the
    calls of a task at the same time, ``calls`` the tasks.

    With a ``quota`` the prompts are dealt over ``calls`` tasks, and each paces its calls, repeated
    ones too, to its equal share: however many of them run at once, no span of ``window`` seconds holds
    more calls than the quota. A share has to be two calls at least, so there can be half as many
    tasks as calls; a task that runs again after a lost executor starts anew.
    """

    connect: Callable[[], Callable[..., str]]
    attempts: int = 3
    calls: int | None = None
    in_flight: int = 4
    pause: float = 0.5
    with_images: bool = False
    quota: int | None = None
    window: float = 60.0

    def interval(self) -> float:
        """Seconds between two calls of a task."""
        if self.quota is None:
            return 0.0
        if not self.calls or self.quota < 2 * self.calls:
            raise ValueError("a quota takes a number of tasks (calls), of which each has a share of two calls")
        # A span may begin just before one call and end just after another: one less fits in between.
        return self.window / (self.quota // self.calls - 1)

    def generate(self, prompts: DataFrame) -> DataFrame:
        interval = self.interval()
        connect, attempts, pause, in_flight = self.connect, self.attempts, self.pause, self.in_flight
        columns = ["prompt", "uri"] if self.with_images else ["prompt"]

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = _paced(connect(), interval)
            with ThreadPoolExecutor(in_flight) as pool:
                for rows in batches:
                    asked = rows[columns].itertuples(index=False, name=None)
                    replies = list(pool.map(lambda a: _ask(ask, a, attempts, pause), asked))
                    yield rows.assign(
                        reply=pd.Series([r for r, _ in replies], index=rows.index, dtype="object"),
                        status=pd.Series([s for _, s in replies], index=rows.index, dtype="object"),
                    )

        schema = T.StructType(
            [*prompts.schema.fields, T.StructField("reply", T.StringType()),
             T.StructField("status", T.StringType())]
        )
        spread = prompts.repartition(self.calls) if self.calls else prompts
        return spread.mapInPandas(answer, schema)


def _paced(ask: Callable[..., str], interval: float) -> Callable[..., str]:
    """The same client, whose calls begin at least ``interval`` seconds apart."""
    if not interval:
        return ask
    lock, free = Lock(), [0.0]

    def wait(*asked) -> str:
        with lock:
            at = max(time.monotonic(), free[0])
            free[0] = at + interval
        time.sleep(max(0.0, at - time.monotonic()))
        return ask(*asked)

    return wait


def _ask(
    ask: Callable[..., str], asked: tuple, attempts: int, pause: float
) -> tuple[str | None, str]:
    error = ""
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        try:
            return ask(*asked), ""
        except Exception as problem:  # whatever a client raises becomes the row's status
            error = str(problem) or type(problem).__name__
    return None, error


@dataclass(frozen=True)
class CallEmbedder:
    """Vectors of a client that is opened once per task and called batch by batch."""

    connect: Callable[[], Callable[[list[str]], list[list[float]]]]

    def embed(self, texts: DataFrame) -> DataFrame:
        connect = self.connect

        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            embed = connect()
            for rows in batches:
                yield rows.assign(vec=embed(list(rows["content"])))

        schema = T.StructType(
            [*texts.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))]
        )
        return texts.mapInPandas(vectors, schema)
