"""Request streams: the latest request of a session wins, answers to older ones are stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(requests: DataFrame) -> DataFrame:
    """The request with the largest id of each session. Works on tables and, as a stateful aggregation, on streams."""
    rest = [c for c in requests.columns if c != "session"]
    return requests.groupBy("session").agg(F.max_by(F.struct(*rest), "request").alias("r")).select("session", "r.*")


def fresh(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to the latest request of their session."""
    return answers.join(latest(requests).select("session", "request"), ["session", "request"], "left_semi")


def serve(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch's latest requests (a stream) into a Parquet table; a batch that runs again replaces its own part."""

    def batch(df: DataFrame, number: int) -> None:
        answer(latest(df)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
