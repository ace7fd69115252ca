"""Streams over several micro-batches: what is late, repeated, broken or silent."""

import datetime

from pyspark.sql import functions as F

from tessera.streaming import events, latches

START = datetime.datetime(2024, 1, 1)


def _files(spark, tmp_path, *batches):
    """A folder of one file a micro-batch: ``event_id, hours after the start, user_id``."""
    for batch in batches:
        rows = [(e, START + datetime.timedelta(hours=h), u, "view") for e, h, u in batch]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "e"))
    return events.read_events(spark, str(tmp_path / "e"), files_per_trigger=1)


def test_silent_users_fail_once_their_time_is_over(spark, tmp_path):
    stream = _files(spark, tmp_path, [(1, 0, 7), (2, 0, 8)], [(3, 1.5, 8)], [(4, 3, 9)], [(5, 3.2, 9)], [(6, 9, 9)], [(7, 9.1, 9)])
    rows = events.drained(events.timeouts(stream), "append", "timeouts").collect()
    at = {r.user_id: START + datetime.timedelta(microseconds=r.heartbeat - int(START.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)) for r in rows}
    assert {u: t for u, t in at.items() if u != 9} == {7: START, 8: START + datetime.timedelta(hours=1.5)}
    assert {r.state for r in rows} == {"failed"} and len([r for r in rows if r.user_id in (7, 8)]) == 2


def test_repeats_count_once_over_batches(spark, tmp_path):
    stream = _files(spark, tmp_path, [(1, 0, 7)], [(1, 0, 7), (2, 1, 7)], [(2, 1, 7)])
    rows = events.drained(events.once(stream).select("event_id"), "append", "once").collect()
    assert sorted(r.event_id for r in rows) == [1, 2]


def test_the_gap_holds_over_batches(spark, tmp_path):
    stream = _files(spark, tmp_path, [(1, 0, 7), (2, 10, 7)], [(3, 24, 7), (4, 24.5, 7)], [(5, 30, 7), (6, 49, 7)])
    rows = events.drained(events.accepted(stream), "append", "accepted").collect()
    assert sorted(r.event_id for r in rows) == [1, 4, 6]


def test_broken_lines_are_kept_apart(spark):
    lines = spark.createDataFrame([('{"event_id": 1}',), ("{broken",), ('{"other": 2}',), (None,)], "line string")
    got = events.parsed(lines, "event_id bigint").select(F.col("row.event_id").alias("e"), "corrupt").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, False), (None, True), (None, True), (None, True)], key=str)


def _valued(spark, tmp_path, *batches):
    """A folder of one file a micro-batch: ``event_id, hours after the start, user_id, value``."""
    for batch in batches:
        rows = [(e, START + datetime.timedelta(hours=h), u, v) for e, h, u, v in batch]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "e"))
    return events.read_events(spark, str(tmp_path / "e"), files_per_trigger=1)


def _told(spark, stream, processor, name):
    with latches.typed_state(spark):
        return sorted((r.user_id, r.event_id) for r in events.drained(latches.told(stream, processor), "append", name).collect())


def test_an_alarm_latches_over_batches_and_starts_anew_after_silence(spark, tmp_path):
    before = spark.conf.get(latches._PROVIDER)
    stream = _valued(
        spark, tmp_path,
        [(1, 0, 7, 50.0), (2, 0.1, 7, 100.0), (3, 0, 8, 10.0)],  # 7 rises to a mean of 75 at its second event
        [(4, 0.2, 7, 0.0), (5, 0.3, 7, 500.0), (6, 0.4, 8, 20.0)],  # falls and rises again: told once
        [(7, 9, 9, 1.0), (8, 9.1, 9, 1.0)],  # the clock moves on; 7 is forgotten
        [(9, 9.5, 7, 90.0), (10, 9.6, 7, 90.0)],  # 7 starts anew
        [(11, 0.5, 8, 999.0), (12, 0.6, 8, 999.0)],  # 8's events come too late
    )
    assert _told(spark, stream, latches.Latch(60.0, 2, 3_600_000), "latch") == [(7, 2), (7, 10)]
    assert spark.conf.get(latches._PROVIDER) == before


def test_an_expiring_gap_holds_over_batches(spark, tmp_path):
    stream = _valued(spark, tmp_path, [(1, 0, 7, 0.0), (2, 10, 7, 0.0)], [(3, 24, 7, 0.0), (4, 24.5, 7, 0.0)], [(5, 30, 7, 0.0), (6, 49, 7, 0.0)])
    assert _told(spark, stream, latches.Gap(86_400_000), "gap") == [(7, 1), (7, 4), (7, 6)]


def test_events_without_a_time_come_last(spark, tmp_path):
    rows = [(1, 1, "a", "2024-01-01 00:00:00"), (2, 1, "a", None), (3, 1, "a", "2024-01-03 00:00:00"), (4, 2, "a", None), (5, 2, "a", None), (6, None, "a", "2024-01-01 00:00:00")]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at string").selectExpr("event_id", "user_id", "event_type", "cast(at AS timestamp) AS ts").coalesce(1).write.parquet(path)
    got = events.drained(events.accepted(events.read_events(spark, path)), "append", "accepted").collect()
    assert sorted((r.event_id, r.user_id) for r in got) == [(1, 1), (3, 1), (4, 2), (6, None)]
