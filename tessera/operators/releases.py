"""Releases as an append-only log: what was valid when, what a withdrawal brings back, and hashes that freeze the order."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(events: DataFrame) -> DataFrame:
    """``entity, seq, active, sha256`` after each event of ``entity, seq, kind, target, payload``.

    ``kind`` is ``release`` or ``withdraw``; the latter takes back the release ``target``, wherever in the chain it stands. ``active`` is the last release
    that has not been withdrawn. A hash covers the event and the hash before it, so nothing in the past
    can be changed or left out. Events arrive sorted; an entity's state are its releases that still stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, alive, last = None, True, {}, ""
        for batch in batches:
            active, sha = [], []
            for row in batch.to_pylist():
                if first or row["entity"] != of:
                    of, first, alive, last = row["entity"], False, {}, ""
                if row["kind"] == "release":
                    alive[row["seq"]] = None
                else:
                    alive.pop(row["target"], None)
                told = "|".join("" if row[c] is None else str(row[c]) for c in ("seq", "kind", "target", "payload"))
                last = hashlib.sha256(f"{last}|{told}".encode()).hexdigest()
                active.append(next(reversed(alive), None))
                sha.append(last)
            yield pa.RecordBatch.from_arrays([batch.column("entity"), batch.column("seq"), pa.array(active, pa.int64()), pa.array(sha, pa.string())], names=["entity", "seq", "active", "sha256"])

    kind = dict(events.dtypes)["entity"]
    rows = events.select("entity", F.col("seq").cast("bigint").alias("seq"), "kind", F.col("target").cast("bigint").alias("target"), "payload")
    return rows.repartition("entity").sortWithinPartitions("entity", "seq").mapInArrow(run, f"entity {kind}, seq bigint, active bigint, sha256 string")


def versions(times: DataFrame, fields: DataFrame) -> DataFrame:
    """``entity, field, value, release, valid_from, valid_to, previous`` of every value that was ever valid.

    ``fields``: ``entity, release, field, value``. A release replaces the one before as a whole, so a field that it lacks ends
    with it; once a release is withdrawn, what stood before is valid again from there. ``valid_to`` is null for what is valid
    still; ``previous`` is the value that the field had up to ``valid_from``, null if it had none.
    """
    own = Window.partitionBy("entity").orderBy("seq")
    turn = times.withColumn("_before", F.lag("active").over(own)).filter(~F.col("active").eqNullSafe(F.col("_before")))
    spans = turn.withColumn("valid_to", F.lead("seq").over(own)).filter("active IS NOT NULL").select("entity", F.col("active").alias("release"), F.col("seq").alias("valid_from"), "valid_to")
    rows = spans.join(fields.select("entity", "release", "field", "value"), ["entity", "release"])
    past = Window.partitionBy("entity", "field").orderBy("valid_from")
    previous = F.when(F.lag("valid_to").over(past) == F.col("valid_from"), F.lag("value").over(past))
    return rows.withColumn("previous", previous).select("entity", "field", "value", "release", "valid_from", "valid_to", "previous")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """``entity, field, value`` that were valid right after the event ``seq``."""
    return log.filter((F.col("valid_from") <= seq) & (F.col("valid_to").isNull() | (F.col("valid_to") > seq))).select("entity", "field", "value")
