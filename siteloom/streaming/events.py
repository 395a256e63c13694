"""Windows over an event stream. Each function works on a batch and on a stream alike; a stream needs a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream with the columns of ``like``; times get the session's zone."""
    s = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums a type and fixed window: the analogue of scattering by chunks."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events without a pause of ``gap``: the analogue of chains of close sites."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("user_id", F.col("w.start").alias("start"), "n", "top")


def joined(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    """Pairs of two streams' events of one user, the right one at most ``within`` after the left."""
    a = left.withWatermark("ts", within).select(F.col("user_id").alias("l_user"), F.col("ts").alias("l_ts"), F.col("event_id").alias("l_id"))
    b = right.withWatermark("ts", within).select(F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"))
    return a.join(b, (F.col("l_user") == F.col("r_user")) & (F.col("r_ts") >= F.col("l_ts")) & (F.col("r_ts") <= F.col("l_ts") + F.expr(f"INTERVAL {within}")))


def type_runs(events: DataFrame) -> DataFrame:
    """Per user the changes of event type seen so far, with state kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, changes = state.get if state.exists else ("", 0)
        for p in batches:
            for t in p.sort_values(["ts", "event_id"])["event_type"]:
                if t != last:
                    changes += 1
                last = t
        state.update((last, changes))
        yield pd.DataFrame({"user_id": [key[0]], "changes": [changes]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, changes long", "last string, changes long", "update", GroupStateTimeout.NoTimeout)


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream run to its present end, as a table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
