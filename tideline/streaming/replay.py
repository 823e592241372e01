"""The pipeline as Structured Streaming: file source, event-time windows, keyed state. Batch and stream give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int = 4) -> DataFrame:
    """Parquet files of a folder as they arrive, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_counts(events: DataFrame, key: str, at: str, size: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """Counts per key and tumbling window; a watermark bounds the state on a stream."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    if late is not None and e.isStreaming:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.window("_at", size), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), key, "n")


def gap_sessions(events: DataFrame, key: str, at: str, gap: str = "6 hours", late: str | None = "1 day") -> DataFrame:
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    if late is not None and e.isStreaming:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), "n")


def running_scores(counts: DataFrame, key: str, at: str, value: str, width: int = 24, late: str = "1 day", idle_days: int = 90) -> DataFrame:
    """Rolling z of every new window of a key against its last ``width``: keyed state holds those counts and nothing more, and is dropped
    when the key has been silent for ``idle_days`` of event time.

    Rows of one trigger are taken in order of time; a key's windows must arrive in order between triggers."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("t")
        out = []
        for t, n in zip(rows["t"], rows["n"]):
            if len(past) == width:
                mean = sum(past) / width
                std = (sum((x - mean) ** 2 for x in past) / width) ** 0.5
                out.append((k[0], t, int(n), None if std == 0 else round((n - mean) / std, 6)))
            past = [*past, float(n)][-width:]
        state.update((past,))
        state.setTimeoutTimestamp(max(int(rows["t"].max().timestamp() * 1000) + idle_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "t", "n", "z"])

    rows = counts.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("t"), F.col(value).cast("long").alias("n"))
    return rows.withWatermark("t", late).groupBy("key").applyInPandasWithState(step, "key string, t timestamp, n long, z double", "past array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def into_relations(batch_writer, folder: str, checkpoint: str, stream: DataFrame):
    """Starts a query that hands every micro-batch to ``batch_writer(df, epoch, folder)``; restarts go on from the checkpoint."""
    return stream.writeStream.foreachBatch(lambda df, epoch: batch_writer(df, epoch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving(df: DataFrame, folder: str) -> None:
    """Puts a table's rows into a stream's folder as further files."""
    df.write.mode("append").parquet(folder)


def closing(like: DataFrame, folder: str, at: str, days: int = 400) -> None:
    """Puts one last row into a stream's folder, null but for a time ``days`` after the latest: the watermark passes it and closes what is open."""
    last = like.agg((F.max(at) + F.make_dt_interval(F.lit(days))).alias(at))
    last.select(*[F.col(at) if c == at else F.lit(None).cast(kind).alias(c) for c, kind in like.dtypes]).coalesce(1).write.mode("append").parquet(folder)


def drained(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it put out, as a written table that outlives the query.

    Results are appended once they are final, so state lasts no longer than the watermark; run again with the same checkpoint, it goes on
    where it stopped, and the table has the rows of both runs."""
    out = f"{checkpoint}/out-{name}"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
