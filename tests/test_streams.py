"""Streams over several micro-batches equal the batch result."""

import datetime
import time

from pyspark.sql import functions as F

from skirmish.operators.aggregates import beta_posteriors
from skirmish.streaming import streams, turns

SF = "/root/testdata/sf0.001"


def split_events(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    for i in range(3):
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    return ev, streams.file_stream(spark, src, ev.schema, "*.parquet", files_per_trigger=1)


def test_snapshots(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    facts = {"kind": F.col("event_type"), "value": F.when(F.col("event_type") == "error", F.col("value"))}
    live = streams.run_update(streams.live_snapshots(stream, ["user_id"], ["ts", "event_id"], facts), ["user_id"],
                              str(tmp_path / "o"), str(tmp_path / "c"))
    batch = streams.live_snapshots(ev, ["user_id"], ["ts", "event_id"], facts)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_posteriors(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    r = F.when(F.col("event_type") == "view", "WIN").when(F.col("event_type") == "error", "LOSS").otherwise("DRAW")
    live = streams.run_update(streams.live_posteriors(stream, "user_id", r), ["user_id"], str(tmp_path / "o"), str(tmp_path / "c"))
    batch = beta_posteriors(ev, "user_id", r).select("user_id", "alpha", "beta", "wins", "losses")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_new_files_are_read_once(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    args = (str(tmp_path / "o"), str(tmp_path / "c"))
    assert streams.run_append(stream, *args).count() == ev.count()
    ev.limit(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = streams.file_stream(spark, str(tmp_path / "in"), ev.schema)
    assert streams.run_append(again, *args).count() == ev.count() + 5


def test_repeats_within_watermark(spark, tmp_path):
    ev, stream = split_events(spark, tmp_path)
    out = streams.run_append(streams.first_results(stream, "user_id", "ts", "4000 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert out.count() == ev.select("user_id").distinct().count()


def test_turns_ends_silence_and_late_messages(spark, tmp_path):
    """Four triggers: state is carried over them, silent battles expire, late messages are dropped, an ended battle starts anew."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    frame = lambda rows: spark.createDataFrame([(b, at(m), i, k, v) for b, m, i, k, v in rows], "b int, ts timestamp, id int, kind string, v string")
    source = str(tmp_path / "in")
    for rows in ([(1, 2, 4, "turn", "2"), (1, 0, 1, "turn", "1"), (1, 1, 2, "switch", "A"), (2, 1, 3, "turn", "1")],
                 [(1, 3, 5, "switch", "B"), (1, 4, 6, "end", ""), (3, 100, 7, "turn", "1"), (None, 99, 20, "turn", "1")],
                 [(2, 2, 8, "turn", "2"), (3, 101, 9, "turn", "2"), (4, 300, 10, "turn", "1"), (1, 299, 11, "say", "")],
                 [(5, 3, 12, "end", ""), (4, 301, 13, "say", "")]):
        frame(rows).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in the order of their times
    stream = streams.file_stream(spark, source, frame([(1, 0, 1, "", "")]).schema, files_per_trigger=1)
    kind = F.col("kind")
    out = turns.live_turns(stream, "b", "ts", "id", F.when(kind == "turn", F.col("v").cast("int")), F.when(kind == "switch", F.col("v")), kind == "end")
    rows = streams.run_append(out, str(tmp_path / "o"), str(tmp_path / "c")).collect()
    # The message of battle 2 at minute 2 is behind the newest, but no trigger had passed a watermark beyond it; that of battle 5 is late.
    assert sorted(map(tuple, rows), key=repr) == sorted([
        (1, 1, 1, "A", 2, "turn"), (1, 2, 2, "B", 5, "end"), (2, 1, 1, None, 1, "turn"), (2, 2, 2, None, 2, "expired"),
        (None, 1, 1, None, 1, "expired"), (3, 1, 1, None, 1, "turn"), (3, 2, 2, None, 2, "expired")], key=repr)
