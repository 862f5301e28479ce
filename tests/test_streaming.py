"""Stages of a stream whose events arrive late, in batches, over restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cellforge.streaming.telemetry import record_stream, stage_stream, stages

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    random.seed(12)
    rows = [(i, START + datetime.timedelta(seconds=random.randrange(40_000), microseconds=random.randrange(4)), random.randrange(5), random.choice("abc")) for i in range(1200)]
    rows += [(5000 + i, START + datetime.timedelta(seconds=60), 2, random.choice("ab")) for i in range(20)]  # ties in time
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").cache()


def plain(events):
    return {(r.user_id, r.stage, r.event_type, r.start, r.next_start, r.events) for r in stages(events).collect()}


def read(spark, path):
    rows = [(r.user_id, r.stage, r.event_type, r.start, r.next_start, r.events) for r in spark.read.parquet(path).where("user_id >= 0").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_batches_out_of_order_and_restarts(spark, events, tmp_path):
    """Five batches, each event up to an hour late; the query is stopped after each and goes on from its checkpoint."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrival = (F.unix_seconds("ts") - int(events.agg(F.min(F.unix_seconds("ts"))).first()[0]) + F.pmod(F.col("event_id") * 7919, F.lit(3600))) / 9000
    dealt = events.withColumn("part", F.floor(arrival)).cache()
    want, seen = plain(events), set()
    for n in range(int(dealt.agg(F.max("part")).first()[0]) + 1):
        dealt.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        record_stream(stage_stream(stream, idle=10**6), out, state).awaitTermination()
        now = read(spark, out)
        assert seen <= now <= want
        seen = now
    assert len(seen) > len(want) // 2 and len(seen) < len(want)
    # a key of its own far ahead moves the watermark past all: last stages come without an end
    spark.createDataFrame([(9999, START + datetime.timedelta(days=90), -1, "z")], events.schema).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        record_stream(stage_stream(stream, idle=10**6), out, state).awaitTermination()
        assert read(spark, out) == want


def test_a_silent_key_is_forgotten(spark, tmp_path):
    """After an hour of silence a key's last stage comes out; a return counts from 1."""
    rows = [(1, START, 1, "a"), (2, START + datetime.timedelta(minutes=1), 1, "a"), (3, START + datetime.timedelta(hours=9), 2, "b"), (4, START + datetime.timedelta(hours=10), 1, "a"), (5, START + datetime.timedelta(days=9), -1, "z")]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for r in rows:
        spark.createDataFrame([r], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
    record_stream(stage_stream(stream, idle=3600), out, state).awaitTermination()
    assert read(spark, out) == {(1, 1, "a", START, None, 2), (2, 1, "b", rows[2][1], None, 1), (1, 1, "a", rows[3][1], None, 1)}


def test_a_part_of_the_arrivals_is_several_files_and_one_batch(spark, monkeypatch):
    """Files of a part are written by tasks of their own; a stream that reads them together drops none of their events."""
    from cellforge.plans import fixtures
    from cellforge.plans.catalog import QUERIES

    monkeypatch.setattr(fixtures, "ARRIVING_ROWS", 400)
    read, sf = [], "/root/testdata/sf0.01"
    plain = fixtures.arriving_events
    monkeypatch.setattr("cellforge.plans.queries_mesh.arriving_events", lambda spark, sf, path: read.append(path) or plain(spark, sf, path))
    got = QUERIES["event_stream"](spark, sf).collect()
    files = [f.rsplit("/", 1)[1] for f in spark.read.parquet(read[0]).inputFiles()]
    assert len(files) > fixtures.ARRIVALS + 1 and (len(files) - 1) % fixtures.ARRIVALS == 0
    assert len(got) == len(set(got)) and set(got) == set(QUERIES["event_samples"](spark, sf).collect())


def test_state_is_held_and_called_for_buckets_not_for_keys(spark, tmp_path):
    """Many keys, ids that floats do not hold and unknown kinds: the stages of stages(), with a few rows of state."""
    random.seed(3)
    rows = [(i, START + datetime.timedelta(seconds=random.randrange(9000)), 2**60 + random.randrange(300), random.choice(["a", "b", None])) for i in range(3000)]
    end = (10_000, START + datetime.timedelta(days=90), None, "z")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for part in (rows[:1500], rows[1500:], [end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = record_stream(stage_stream(stream, late="3 hours", idle=10**6), out, state, parts=2)
    query.awaitTermination()
    want = plain(spark.createDataFrame(rows, schema))
    assert len(want) > 1500 and read(spark, out) == want
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    few = record_stream(stage_stream(stream, late="3 hours", idle=10**6, buckets=8), f"{out}-8", f"{state}-8", parts=2)
    few.awaitTermination()
    assert read(spark, f"{out}-8") == want
    states = [s for p in few.recentProgress for s in p["stateOperators"]]
    assert states and {s["numShufflePartitions"] for s in states} == {2} and 8 <= max(s["numRowsTotal"] for s in states) < 100
