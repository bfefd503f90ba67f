"""Latest generation wins: of the requests of a session only the newest one's result is accepted."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_requests(requests: DataFrame, session: str = "session", generation: str = "generation", request: str = "request") -> DataFrame:
    """One row a session: its newest generation and that one's request. The same for a table and for a stream (update mode)."""
    return requests.groupBy(session).agg(F.max(generation).alias("generation"), F.max_by(request, generation).alias("request"))


def accepted(results: DataFrame, latest: DataFrame, session: str = "session", generation: str = "generation") -> DataFrame:
    """Results of a generation that is still the newest; stale ones are dropped."""
    newest = latest.select(F.col(session).alias("_s"), F.col("generation").alias("_g"))
    return results.join(newest, (F.col(session) == F.col("_s")) & (F.col(generation) == F.col("_g")), "left_semi")


def start_latest(stream: DataFrame, name: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """A running query that keeps the newest request of each session in a table in memory."""
    return latest_requests(stream, **columns).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


class Generations:
    """Requests of one session on the driver: a newer one cancels the Spark jobs of the one before, whose result is never delivered."""

    def __init__(self, spark: SparkSession, session: str):
        self.spark, self.session, self.generation, self.lock = spark, session, 0, threading.Lock()

    def tag(self, generation: int) -> str:
        return f"{self.session}-generation-{generation}"

    def newest(self, generation: int) -> bool:
        with self.lock:
            return generation == self.generation

    def request(self, work: Callable[[Callable[[], bool]], Any]) -> Future:
        """Runs ``work`` in a thread of its own. It gets a check that says whether it is still wanted; its future is cancelled if it is not."""
        with self.lock:
            self.generation += 1
            own = self.generation
        context = self.spark.sparkContext
        context.cancelJobsWithTag(self.tag(own - 1))
        future: Future = Future()

        def run() -> None:
            context.addJobTag(self.tag(own))
            try:
                result, error = work(lambda: self.newest(own)), None
            except Exception as e:  # given on to whoever waits, or dropped with its generation
                result, error = None, e
            if not self.newest(own):
                future.cancel()
            elif error is not None:
                future.set_exception(error)
            else:
                future.set_result(result)

        InheritableThread(target=run, daemon=True).start()
        return future
