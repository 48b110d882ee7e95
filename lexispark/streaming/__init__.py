"""Structured Streaming: manifest ingestion, sessions and gluing with keyed state. Extensions, since the batch operators have no time semantics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexispark.session import ship

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling_totals(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and type: rows and summed value; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Sessions of a user, closed after a pause of `gap`."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dedup(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def glue(segments: DataFrame, gap: float = 1.0, longest: float = 30.0) -> DataFrame:
    """rec, start, end, text, n: segments (rec, start, end, text) glued as they come; a recording's open piece is its state, given out
    when a later segment closes it."""
    ship(segments.sparkSession)
    out = "rec string, start double, end double, text string, n long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["start", "end", "text"])
        for s, e, t in zip(rows["start"], rows["end"], rows["text"], strict=True):
            if last and s - last[1] <= gap and max(e, last[1]) - last[0] <= longest:
                last = (last[0], float(max(e, last[1])), f"{last[2]} {t}", last[3] + 1)
            else:
                done += [last] if last else []
                last = (float(s), float(e), t, 1)
        state.update(last)
        yield pd.DataFrame([(key[0], *x) for x in done], columns=["rec", "start", "end", "text", "n"])

    return segments.groupBy("rec").applyInPandasWithState(step, out, "start double, end double, text string, n long", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now to a Parquet folder, and back; a rerun takes up where this one stopped."""
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
