"""Streams of files, status events and requests, and runners that take a folder of events through them.

Inputs are streaming DataFrames; ts must be TIMESTAMP with the session in UTC. Every operator here has a batch twin in
stats, ranking or below, and agrees with it on windows that the watermark has closed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from ..sources.shared import settled
from .known import KnownContents

#: State lives in an embedded store on the executors' disks, of which checkpoints hold the changes; memory does not bound it.
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Calls a minute for each kind of route.
LIMITS = {"search": 30, "search-vector": 60, "stream": 60, "thumbnail": 120, "ask": 10, "playlist": 5, "default": 200}


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """All that is there now, in micro-batches; then stop. With each, batches go to it instead of a Parquet folder."""
    conf = df.sparkSession.conf
    before = conf.get(_PROVIDER[0], None)
    conf.set(*_PROVIDER)
    try:
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    finally:
        conf.unset(_PROVIDER[0]) if before is None else conf.set(_PROVIDER[0], before)
    query.awaitTermination()


_EPOCH, _MILLISECOND = datetime(1970, 1, 1), timedelta(milliseconds=1)


class _InOrder(StatefulProcessor):
    """Rows (ts, seq, ...) of one key in the order of ts and seq, however they come: they wait in a list until the watermark
    has passed their ts, so that rows late by less than the watermark's delay change the outcome as they would in a batch.
    What a key needs of its past is one row of state; it leaves when no row has come for the idle time, and rows after such
    a rest count as those of a new key, wherever batches are cut. Timers are in event time, and a key has one for the earliest
    of the rows that a batch brings or leaves waiting, however many they are: when it rings, all rows that are due go."""

    waits = "ts timestamp, seq long, status string, point_id long"
    keeps = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.past = handle.getValueState("past", self.keeps + ", last_ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        columns = [new[c].astype(object).where(new[c].notna(), None) if c in new else pd.Series([None] * len(new), dtype=object) for c in ("status", "point_id")]
        told = list(zip([t.to_pydatetime() for t in new["ts"]], [int(x) for x in new["seq"]], columns[0], [None if x is None else int(x) for x in columns[1]], strict=True))
        self.waiting.appendList(told)
        self.handle.registerTimer(max(min(_ms(t[0]) for t in told), timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        times = [_ms(r[0]) for r in waiting]
        due = waiting[: bisect_right(times, now)]
        past = self.past.get() if self.past.exists() else None
        if due:
            late = waiting[len(due) :]
            if late:
                self.waiting.put(late)
                self.handle.registerTimer(times[len(due)])
            else:
                self.waiting.clear()
            last = past[-1] if past else None
            begun = 0
            for i, r in enumerate(due):  # runs of rows without a rest of the idle time between them
                if last is not None and times[i] - last > self.idle_ms:
                    if i > begun:
                        yield self.step(key, past, due[begun:i])[0]
                    past, begun = None, i
                last = max(times[i], last or 0)
            made, kept = self.step(key, past, due[begun:])
            self.past.update((*kept, last))
            self.handle.registerTimer(last + self.idle_ms)
            yield made
        elif past and not waiting and past[-1] + self.idle_ms <= now:
            self.past.clear()

    def step(self, key, past: tuple | None, due: list[tuple]) -> tuple[pd.DataFrame, tuple]:
        """The output of rows that are due, and what is kept."""
        raise NotImplementedError


def _ms(t) -> int:
    """Whole milliseconds since the epoch, in which the watermark counts, of a time without a zone in UTC or with one."""
    return ((t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t) - _EPOCH) // _MILLISECOND


class _Changes(_InOrder):
    """Rows that are a key's first or whose status differs from the one before."""

    keeps = "status string"

    def step(self, key, past, due):
        known, last, out = past is not None, past[0] if past else None, []
        for ts, seq, status, _ in due:
            if not known or status != last:
                out.append((key[0], seq, pd.Timestamp(ts), last, status))
            known, last = True, status
        return pd.DataFrame(out, columns=["id", "seq", "ts", "old_status", "status"]), (last,)


class _First(_InOrder):
    """The update that gives a key its first point; an insert with a point counts as indexed without a word."""

    keeps = "done boolean"

    def step(self, key, past, due):
        seen, done, out = past is not None, bool(past and past[0]), []
        for ts, seq, _, point in due:
            if point is not None and not done:
                done = True
                if seen:
                    out.append((key[0], seq, pd.Timestamp(ts), point))
            seen = True
        return pd.DataFrame(out, columns=["id", "seq", "ts", "point_id"]), (done,)


class _Newest(_InOrder):
    """Every change of a key's newest row."""

    keeps = "status string"

    def step(self, key, past, due):
        ts, seq, status, _ = due[-1]
        return pd.DataFrame([(key[0], pd.Timestamp(ts), seq, status)], columns=["id", "ts", "seq", "status"]), (status,)


def _keyed(events: DataFrame, processor: type[_InOrder], schema: str, mode: str, lateness: str, idle_days: float) -> DataFrame:
    columns = [c for c in ("id", "ts", "seq", "status", "point_id") if c in events.columns]
    rows = events.select(*columns).withWatermark("ts", lateness)
    return rows.groupBy("id").transformWithStateInPandas(processor(int(idle_days * 86_400_000)), schema, mode, "EventTime")


def status_changes(events: DataFrame, lateness: str = "0 seconds", idle_days: float = 365) -> DataFrame:
    """(id, seq, ts, old_status, status) of (id, seq, ts, status): first rows and changes of status, in the order of event
    time for rows at most so late. State of an id that rests for the idle days goes."""
    return _keyed(events, _Changes, "id long, seq long, ts timestamp, old_status string, status string", "append", lateness, idle_days)


def status_changes_batch(events: DataFrame) -> DataFrame:
    by = Window.partitionBy("id").orderBy("ts", "seq")
    old = F.lag("status").over(by)
    first = F.row_number().over(by) == 1
    return events.select("id", "seq", "ts", old.alias("old_status"), "status", first.alias("__first")).where(F.col("__first") | ~F.col("status").eqNullSafe(F.col("old_status"))).drop("__first")


def first_indexed(events: DataFrame, lateness: str = "0 seconds", idle_days: float = 365) -> DataFrame:
    return _keyed(events, _First, "id long, seq long, ts timestamp, point_id long", "append", lateness, idle_days)


def first_indexed_batch(events: DataFrame) -> DataFrame:
    by = Window.partitionBy("id").orderBy("ts", "seq")
    before = F.max(F.col("point_id").isNotNull()).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("__before", before).where(F.col("point_id").isNotNull() & (F.col("__before") == F.lit(False))).select("id", "seq", "ts", "point_id")


def channel(status: Column, point_id: Column) -> Column:
    """The channels a row goes to: status news to media_updates, new points to vector_indexed as well."""
    return F.filter(F.array(F.when(status.isNotNull(), F.lit("media_updates")), F.when(point_id.isNotNull(), F.lit("vector_indexed"))), lambda x: x.isNotNull())


def fan_out(batch: DataFrame) -> DataFrame:
    """A row for each channel of each event."""
    return batch.withColumn("channel", F.explode(channel(F.col("status"), F.col("point_id"))))


def fan_out_to(paths: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink with one folder for each channel; a batch that comes again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        rows = fan_out(batch).persist()
        for name, path in paths.items():
            rows.where(F.col("channel") == name).drop("channel").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.unpersist()

    return write


def latest_status(events: DataFrame, lateness: str = "0 seconds", idle_days: float = 365) -> DataFrame:
    """Update-mode stream of each id's newest row; count by status over its sink for a snapshot."""
    return _keyed(events, _Newest, "id long, ts timestamp, seq long, status string", "update", lateness, idle_days)


def ingest_stream(found: DataFrame, decide: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Discovered files through decisions, a micro-batch at a time. apply must be idempotent, as a keyed write is: after
    a failure the last batch comes again."""

    def each(batch: DataFrame, number: int) -> None:
        apply(decide(batch.dropDuplicates(["file_path"])), number)

    run_to_end(found, "", checkpoint, each=each)


@F.pandas_udf(StringType())
def file_digest(paths: pd.Series, kinds: pd.Series) -> pd.Series:
    """SHA-256 of files that the executors see: all bytes of an image, the first 8192 of a video; null where a file cannot
    be read."""
    out = []
    for path, kind in zip(paths, kinds, strict=True):
        digest = hashlib.sha256()
        try:
            with open(path, "rb") as f:
                while block := f.read(8192):
                    digest.update(block)
                    if kind == "video":
                        break
            out.append(digest.hexdigest())
        except (OSError, TypeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def ingest_contents(found: DataFrame, path: str, checkpoint: str, key: str = "file_path", content: str = "file_hash", opened: Callable[[int, list[str]], None] | None = None) -> DataFrame:
    """(key, content, action) of all files so far: inserted for the least key of a content that no earlier batch holds,
    duplicate_copy for the rest. path is a log of decisions with a folder for each micro-batch, and beside it are the known
    contents by prefix, of which a batch opens the folders that may hold one of its own; opened is told their names. A
    batch is decided against the batches before it and overwrites its own folders, so one that comes again after a failure
    does no harm."""
    spark = found.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    log = f"`{key}` {kinds[key]}, `{content}` {kinds[content]}, action string, batch bigint"
    known = KnownContents(spark, f"{path.rstrip('/')}-known")

    def decide(batch: DataFrame, number: int) -> None:
        known.merge(number)
        rows = batch.select(key, content).dropDuplicates([key]).persist()
        first = rows.groupBy(content).agg(F.min(key).alias("__first"))
        before, names = known.probe(first.select(content), number, content)
        if opened:
            opened(number, names)
        first = settled(first.join(before, content, "left_anti"))
        action = F.when(F.col(key) == F.col("__first"), "inserted").otherwise("duplicate_copy")
        rows.join(first, content, "left").select(key, content, action.alias("action")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        known.add(first.select(content), number, content)
        rows.unpersist()

    run_to_end(found, "", checkpoint, each=decide)
    try:
        return spark.read.schema(log).parquet(path).drop("batch")
    except AnalysisException:  # no file has come yet
        return spark.createDataFrame([], log).drop("batch")


#: The width of a quantile sketch: windows of up to as many rows are exact, larger ones within about 1.5 / width in rank.
SKETCH = 4_096


def tumbling_requests(log: DataFrame, minutes: int = 10, lateness: str = "1 hour") -> DataFrame:
    """(window_start, endpoint, requests, rate, errors, p95_ms): requests a second, and the least duration that 95 in 100
    do not exceed, from a sketch that merges."""
    rows = log.withWatermark("ts", lateness) if log.isStreaming else log
    sketch = F.kll_sketch_agg_bigint(F.col("response_ms").cast("long"), F.lit(SKETCH))
    made = rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("response_status") >= 400).alias("errors"), F.count("response_ms").alias("timed"), sketch.alias("sketch"))
    p95 = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.95)))
    return made.select(F.col("w.start").alias("window_start"), "endpoint", "requests", F.round(F.col("requests") / F.lit(60.0 * minutes), 6).alias("rate"), "errors", p95.alias("p95_ms"))


def limit_breaches(log: DataFrame, limits: dict[str, int], minutes: int = 1, slide: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(window_start, client_ip, endpoint, n, allowed) where a client calls a route more often than allowed."""
    rows = log.withWatermark("ts", lateness) if log.isStreaming else log
    window = F.window("ts", f"{minutes} minutes", f"{slide} minutes") if slide else F.window("ts", f"{minutes} minutes")
    allowed = F.coalesce(*[F.when(F.col("endpoint") == k, F.lit(v)) for k, v in limits.items() if k != "default"], F.lit(limits.get("default", 200)))
    made = rows.groupBy(window.alias("w"), "client_ip", "endpoint").agg(F.count("*").alias("n")).withColumn("allowed", allowed)
    return made.where(F.col("n") > F.col("allowed")).select(F.col("w.start").alias("window_start"), "client_ip", "endpoint", "n", "allowed")


def sessions(events: DataFrame, key: str, minutes: int = 10, lateness: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    made = rows.groupBy(F.session_window("ts", f"{minutes} minutes").alias("w"), key).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return made.drop("w")


def once(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Redelivered events (equal keys) count once; later than the watermark they may count again in a stream."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


#: How long a file may be in processing, in hours of event time.
STUCK_HOURS = 2


def _stuck(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Every processing row, the one kept from before included, whose next row comes too late; the last row waits for an
    event-time timer if it is one of processing. A row that is older than the kept one leaves that in place."""
    if state.hasTimedOut:
        since = state.get[0]
        state.remove()
        yield pd.DataFrame({"id": [key[0]], "since": [since]})
        return
    kept = [pd.DataFrame({"ts": [pd.Timestamp(state.get[0])], "seq": [state.get[1]], "status": ["processing"]})] if state.exists else []
    rows = pd.concat([*kept, *(f[["ts", "seq", "status"]] for f in frames)]).sort_values(["ts", "seq"])
    wait = pd.Timedelta(hours=STUCK_HOURS)
    late = (rows["status"] == "processing") & (rows["ts"].shift(-1) - rows["ts"] > wait)
    last = rows.iloc[-1]
    if last.status == "processing":
        state.update((last.ts, int(last.seq)))
        state.setTimeoutTimestamp(max(int((last.ts + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    since = rows.loc[late.to_numpy(bool), "ts"]
    yield pd.DataFrame({"id": [key[0]] * len(since), "since": since})


def stuck_alerts(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """(id, since) of files whose processing has gone on for two hours of event time, as stuck_batch has them once the
    watermark has passed those hours."""
    return events.withWatermark("ts", lateness).groupBy("id").applyInPandasWithState(_stuck, "id long, since timestamp", "since timestamp, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def stuck_batch(events: DataFrame, hours: int = STUCK_HOURS) -> DataFrame:
    """Ends of processing that came later than that, or not by the last event of all."""
    by = Window.partitionBy("id").orderBy("ts", "seq")
    end = events.agg(F.max("ts").alias("__end"))
    rows = events.withColumn("__next", F.lead("ts").over(by)).where("status = 'processing'").crossJoin(F.broadcast(end))
    return rows.where(F.coalesce("__next", "__end") > F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")).select("id", F.col("ts").alias("since"))
