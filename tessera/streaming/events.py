"""Event streams: ingestion, idempotent consumption, windows, and a 24-hour gap with state."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.scratch import scratch


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """M1: a stream of the parquet files at ``path``, their schema taken from the table there."""
    schema = spark.read.parquet(path).schema
    if "." in path.rsplit("/", 1)[-1]:  # the table may be one file or a folder; a glob reads either
        path = path[:-1] + "[" + path[-1] + "]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What the stream gives until its source is empty, as a table in the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        write: Callable[[DataFrame, int], None] = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        writer = stream.writeStream.outputMode(mode).foreachBatch(write)
    writer.option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def daily_counts(events: DataFrame) -> DataFrame:
    """M6: events of each day and type."""
    day = F.window("ts", "1 day")
    rows = events.withWatermark("ts", "1 day").groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.to_date("w.start").alias("day"), "event_type", "n")


def once(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """M2: each event id once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def accepted(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """M3: events over ``seconds`` after the last accepted one of their user and type; the state is one time a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A key has few rows, and there are many keys: plain arrays, no frames but the one that goes out.
        pairs = [(b["ts"].to_numpy().astype("datetime64[us]").astype("int64"), b["event_id"].to_numpy()) for b in batches]
        micros, ids = (np.concatenate(x) for x in zip(*pairs, strict=True))
        # Events without a time come last, and are accepted only where a key has no other before.
        never = np.iinfo(np.int64).max
        micros = np.where(micros == np.iinfo(np.int64).min, never, micros)
        order = np.lexsort((ids, micros))
        micros, ids = micros[order], ids[order]
        last = state.get[0] if state.exists else None
        past = lambda at: int(np.searchsorted(micros, min(at + seconds * 1_000_000, int(never)), "right"))
        keep, at = [], 0 if last is None else past(last)
        while at < len(micros) and (micros[at] < never or last is None):
            keep.append(at)
            last = int(micros[at])
            at = past(last)
        state.update((last,))
        if keep:
            yield pd.DataFrame({"event_id": ids[keep], "user_id": key[0], "event_type": key[1]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(
        run, "event_id long, user_id long, event_type string", "last long", "append", GroupStateTimeout.NoTimeout
    )


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """M1: ``line`` read by ``schema`` as ``row``; ``corrupt`` where it is no such document, and the stream goes on."""
    row = F.from_json("line", schema)
    return lines.select("line", row.alias("row")).withColumn("corrupt", F.col("row").isNull() | F.col("row.event_id").isNull())


def visits(events: DataFrame) -> DataFrame:
    """Of each page view a visit with the campaign that its URL names, and a ``page_view`` event."""
    tag = lambda name: F.nullif(F.regexp_extract("url", rf"[?&]utm_{name}=([^&#]*)", 1), F.lit("")).alias(name)
    kinds = F.explode(F.array(F.lit("visit"), F.lit("page_view"))).alias("kind")
    return events.select("event_id", "user_id", tag("source"), tag("campaign"), kinds)


def timeouts(events: DataFrame, hours: int = 2) -> DataFrame:
    """M4: users whose last event is over ``hours`` old by the stream's own clock, as ``user_id, heartbeat, state``; a later event starts anew.

    The state is one time a user; the timer is the watermark, so a run over old files fails the same users as a live one.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "heartbeat": [last], "state": ["failed"]})
            return
        last = max(int(b["ts"].astype("datetime64[us]").astype("int64").max()) for b in batches)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", "0 seconds").groupBy("user_id").applyInPandasWithState(
        run, "user_id long, heartbeat long, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
