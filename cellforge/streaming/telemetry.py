"""Stages and samples of a run's telemetry, over a stored event table and over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _micros(t: Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros(t.cast("timestamp"))


def stages(events: DataFrame, by: str = "user_id", kind: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(by, stage, kind, start, next_start, seconds, events): runs of equal events, and the time until the next run starts."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    changed = F.when(F.coalesce(F.lag(kind).over(w) != F.col(kind), F.lit(True)), 1).otherwise(0)
    marked = events.withColumn("stage", F.sum(changed).over(w))
    runs = marked.groupBy(by, "stage").agg(F.first(kind).alias(kind), F.min(ts).alias("start"), F.count("*").alias("events"))
    after = F.lead("start").over(Window.partitionBy(by).orderBy("stage"))
    return runs.select(by, "stage", kind, "start", after.alias("next_start"), (_micros(after) - _micros(F.col("start"))).cast("double").__truediv__(1e6).alias("seconds"), "events")


def samples(events: DataFrame, every: str = "10 seconds", late: str | None = None, kind: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """(start, kind, n, total, largest) per sampling period; with `late` set, state of a stream is dropped behind that watermark."""
    if late is not None:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, every).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), kind, "n", "total", "largest")


#: The state store that state with timers needs, and the setting that names it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


#: Rows that wait in a bucket, and stages that are open in one, as its state holds them; a key that is null is not known.
WAITING = pa.schema([("known", pa.bool_()), ("key", pa.int64()), ("us", pa.int64()), ("tie", pa.int64()), ("kind", pa.string())])
OPEN = pa.schema([("known", pa.bool_()), ("key", pa.int64()), ("stage", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("last", pa.int64()), ("events", pa.int64())])


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts] or [schema.empty_table()]).to_pandas()


def run_on(before: pd.DataFrame, events: pd.DataFrame, passed: int, idle_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(finished stages with their `next`, open ones): open stages of many keys (OPEN) taken on by events after them (WAITING), in
    any order, up to the time `passed`. A null kind is a stage of its own, as in stages()."""
    rows = pd.concat([before.assign(us=before["last"], tie=0, new=False), events.assign(stage=1, start=events["us"], events=1, new=True)])
    codes = pd.factorize(rows["kind"], sort=True)[0]
    order = np.lexsort((codes, *[rows[c].to_numpy() for c in ("tie", "us", "new", "key", "known")]))
    rows, codes = rows.iloc[order], codes[order]
    known, key, us = (rows[c].to_numpy() for c in ("known", "key", "us"))
    same = np.append(False, (key[1:] == key[:-1]) & (known[1:] == known[:-1]))[: len(us)]
    fresh = ~same | np.append(False, np.diff(us) > idle_us)[: len(us)]  # counts anew, as the timer would have had it
    first = np.flatnonzero(fresh | np.append(False, codes[1:] != codes[:-1])[: len(us)] | (codes < 0))
    runs, at = rows.iloc[first], np.arange(len(first))
    anew = np.maximum.accumulate(np.where(fresh[first], at, 0))
    count = np.add.reduceat(rows["events"].to_numpy(), first) if len(first) else at
    last = us[np.append(first[1:], len(us))[: len(first)] - 1]
    after = lambda x, end: np.append(x[first[1:]], end)[: len(first)]
    runs = runs[["known", "key", "kind", "start"]].assign(stage=runs["stage"].to_numpy()[anew] + at - anew, last=last, events=count)
    runs["next"] = pd.arrays.IntegerArray(after(us, 0).astype("int64"), after(fresh, True).astype(bool))
    is_open = ~after(same, False).astype(bool) & (passed - last <= idle_us)
    return runs[~is_open], runs[is_open]


class OpenStages(StatefulProcessor):
    """State of a bucket of keys: the events that an earlier one may still precede, and the stages that are open before them.

    A timer goes off when the watermark has passed the first waiting event; then all events behind the watermark are taken in
    order, those of all the bucket's keys at once. A key that has been silent for `idle` gives its last stage, without an end,
    and leaves no state. A bucket has one timer, the earliest that one of its keys needs.
    """

    def __init__(self, columns: list[str], idle_ms: int):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", "rows binary")
        self.wake = handle.getValueState("wake", "ms long")

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for frame in rows:
            self.waiting.appendValue((_packed(frame[WAITING.names], WAITING),))
            firsts.append(int(frame["us"].min()) // 1000 + 1)
        now = self.wake.get()
        if firsts and (now is None or min(firsts) < now[0]):
            if now is not None:
                self.handle.deleteTimer(now[0])
            self._wake(min(firsts))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked([bytes(x[0]) for x in self.waiting.get()], WAITING)
        before = self.open.get()
        late = waiting["us"] > passed
        later = waiting[late]
        done, still = run_on(_unpacked([bytes(before[0])] if before else [], OPEN), waiting[~late], passed, self.idle_ms * 1000)
        wakes = []
        if len(later):
            wakes.append(int(later["us"].min()) // 1000 + 1)
            if len(later) < len(waiting):
                self.waiting.put([(_packed(later, WAITING),)])
        elif len(waiting):
            self.waiting.clear()
        if len(still):
            wakes.append(int(still["last"].min()) // 1000 + self.idle_ms + 2)
            self.open.update((_packed(still[OPEN.names], OPEN),))
        elif before:
            self.open.clear()
        if wakes:
            self._wake(min(wakes))
        else:
            self.wake.clear()
        if len(done):
            key_ = pd.arrays.IntegerArray(done["key"].to_numpy(), ~done["known"].to_numpy())
            yield pd.DataFrame(dict(zip(self.columns, [key_, *[done[c].array for c in ("stage", "kind", "start", "next", "events")]])))

    def close(self) -> None:
        pass


#: Buckets that keys are dealt to unless told otherwise.
BUCKETS = 1024


def stage_stream(events: DataFrame, by: str = "user_id", kind: str = "event_type", ts: str = "ts", tie: str = "event_id", late: str = "1 hour", idle: int = 24 * 3600, buckets: int = BUCKETS) -> DataFrame:
    """Finished stages of a stream of events: (by, stage, kind, start, next_start, events), as stages() gives them.

    Events may come in any order up to `late` behind the newest; a stage ends when the watermark has passed the first event of
    another kind after it. A key without an event for `idle` seconds gives its last stage, with no next_start, and is
    forgotten, so state is bounded by the keys that are active; its stages count from 1 again if it comes back. Events later
    than `late` are dropped, as behind any watermark; those without a time or a key's type of `by` other than long are not
    supported. Needs the state store STORE (see record_stages).

    Keys share state by a hash, in so many `buckets`: a task holds one bucket, and calls for state and timers are made for a
    bucket, not for a key. Some thousands of events that wait in each are a good number; it must not change between starts.
    """
    rows = events.select(F.col(by).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(kind).alias("kind"), F.col(tie).cast("long").alias("tie"))
    rows = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    # no nulls in numbers, which pandas would make floats
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)), "known": F.col("key").isNotNull(), "key": F.coalesce("key", F.lit(0)), "tie": F.coalesce("tie", F.lit(-(1 << 63)))})
    columns = ["key", "stage", "kind", "start_us", "next_us", "events"]
    schema = "key long, stage long, kind string, start_us long, next_us long, events long"
    out = rows.groupBy("bucket").transformWithStateInPandas(OpenStages(columns, idle * 1000), schema, "Append", "EventTime")
    return out.select(F.col("key").alias(by), "stage", F.col("kind").alias(kind), F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("next_us").alias("next_start"), "events")


def record_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True, parts: int | None = None) -> StreamingQuery:
    """Starts a query that appends the rows of a stream to Parquet files at `path`, each once: what is done is kept at `checkpoint`,
    and a new start goes on from there. With `once` it ends when it has read all that is there. Every batch opens and stores each
    part of the state, which costs some half a second however little is in it, so `parts` may name fewer than Spark's shuffle
    partitions; it counts at the first start only."""
    conf = rows.sparkSession.conf
    own = {STORE_SETTING: STORE} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():  # a query keeps the settings that it was started under
        conf.set(k, v)
    try:
        writer = rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


class RunAccount:
    """What passes through the marked places of a run: rows, and bytes of chosen columns, counted while the run goes on."""

    def __init__(self):
        self._places: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame, sized: str | None = None) -> DataFrame:
        """The same rows; those that pass count under `name`, and with `sized` the bytes of that text or binary column."""
        if name in self._places:
            raise ValueError(f"place {name} is watched already")
        self._places[name] = Observation()
        size = F.coalesce(F.sum(F.octet_length(sized)), F.lit(0)) if sized else F.lit(0)
        return df.observe(self._places[name], F.count(F.lit(1)).alias("rows"), size.cast("long").alias("bytes"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, rows, bytes) of all places, after the run's action has ended; waits for it if it has not."""
        rows = [(n, o.get["rows"], o.get["bytes"]) for n, o in self._places.items()]
        return spark.createDataFrame(rows, "place string, rows long, bytes long")


def record_events(events: DataFrame, path: str) -> None:
    """Appends events to the event table."""
    events.write.mode("append").parquet(path)
