"""Structured Streaming twins of ingest, daily aggregates and state machines.

State is kept for a documented bound: watermarks of `late` (default two days), timers of event time, or a row for each channel.
Results equal the batch twins for rows that come within it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def journal_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New Parquet files of event rows as a stream; the checkpoint is the cursor."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.select("event_id", F.col("user_id").alias("channel_id"), F.col("ts").alias("event_time"), (F.col("event_type") == "error").alias("alarm"), F.col("value").alias("value_numeric"), F.col("event_type").alias("value_state"))


def once(stream: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once while its watermark stands; retries within it are dropped."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def not_from_future(stream: DataFrame, minutes: int = 5) -> DataFrame:
    return stream.where(F.col("event_time") <= F.current_timestamp() + F.make_dt_interval(mins=F.lit(minutes)))


def alarm_notices(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """A notice for each new alarm event."""
    return once(stream, ["event_id"], late).where("alarm").select(F.col("event_id").alias("ref"), "channel_id", "event_time", F.lit("observed_alarm").alias("kind"))


def with_channels(stream: DataFrame, channels: DataFrame) -> DataFrame:
    """Stream rows of known channels, with their object; the catalogue is static."""
    return stream.join(channels, "channel_id")


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling days: observations and alarms."""
    days = stream.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day"))
    return days.agg(F.count("*").alias("observations"), F.count_if(F.col("alarm")).alias("alarms")).select(F.to_date("window.start").alias("day"), "observations", "alarms")


def sliding_activity(stream: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each channel over sliding windows."""
    return stream.withWatermark("event_time", late).groupBy("channel_id", F.window("event_time", length, step)).agg(F.count("*").alias("n")).select("channel_id", F.to_date("window.end").alias("day_after"), "n")


def source_lag(batch: DataFrame, now: Column | None = None, *by: str) -> DataFrame:
    """Largest lag of a batch in seconds (of each source, by), and whether it is within 300."""
    lag = F.max(F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(F.col("event_time").cast("timestamp")))
    return batch.groupBy(*by).agg(lag.alias("lag_s"), (lag <= 300).alias("in_time"))


def routed(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each sink the rows of its kind; a batch is read once."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, sink in sinks.items():
                sink(batch.where(F.col("kind") == kind), number)
        finally:
            batch.unpersist()

    return run


class FirstHash(StatefulProcessor):
    """Keeps the first payload hash of each id and tells of rows that repeat it or conflict with it.

    With a bound (keep_ms), an id is forgotten that long after its first row was seen, by a timer of event time: state holds
    the ids of that span only, and the id counts as new after it."""

    def __init__(self, keep_ms: int | None = None, zone: str = "UTC"):
        self.keep_ms, self.zone = keep_ms, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.first.get()[0] if self.first.exists() else None
        for pdf in rows:
            out = []
            for r in pdf.sort_values(["seen", "payload_hash"]).itertuples():
                if held is None:
                    held, verdict = r.payload_hash, "new"
                    self.first.update((held,))
                    if self.keep_ms is not None:
                        self.handle.registerTimer(epoch_ms(r.seen, self.zone) + self.keep_ms)
                else:
                    verdict = "retry" if r.payload_hash == held else "conflict"
                out.append((r.external_id, r.payload_hash, verdict))
            yield pd.DataFrame(out, columns=["external_id", "payload_hash", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def epoch_ms(time, zone: str) -> int:
    """Milliseconds since 1970 of a local time of the session's zone."""
    return int(pd.Timestamp(time).tz_localize(zone).timestamp() * 1000)


def zone_of(stream: DataFrame) -> str:
    return stream.sparkSession.conf.get("spark.sql.session.timeZone")


def payload_verdicts(stream: DataFrame, keep: timedelta | None = None, late: str = "1 minute") -> DataFrame:
    """external_id, payload_hash, verdict (new, retry, conflict) for a stream of external_id, seen, payload.

    keep: how long an id is remembered, by the watermark of seen (rows come in order of it, but for late). Without it, every id is kept."""
    rows = stream.select("external_id", "seen", F.sha2("payload", 256).alias("payload_hash"))
    out = "external_id string, payload_hash string, verdict string"
    if keep is None:
        return rows.groupBy("external_id").transformWithStateInPandas(FirstHash(), out, "Append", "None")
    held = FirstHash(int(keep.total_seconds() * 1000), zone_of(stream))
    return rows.withWatermark("seen", late).groupBy("external_id").transformWithStateInPandas(held, out, "Append", "EventTime")


SECOND, DAY = 1_000_000, 86_400_000_000
_CHANGE = {"channel_id": "long", "kind": "string", "start": "long", "end": "long", "strict": "boolean", "sustained": "int", "event_id": "long"}
CHANGE = Row(*_CHANGE)


class ChannelState(StatefulProcessor):
    """What a channel's past says about its next event: the open cell, the state and onset of a fault, the last readings, the last day.

    Emits a fault when it ends, a crossing when its cell is over, and a silence when a reading ends it. Events older than the open cell,
    or of a cell that is over, are emitted as late. With timers (wait_ms is given), a cell is over once rows seen wait_ms after its end have come,
    and a silence that has lasted silent_days is told of as lasting, without an end; a reading of one of these days that comes later
    makes it undone. Without them, the newest cell stays open until a later
    one comes, in this trigger or another. State is one row for each channel.

    Rows come one by one, not as frames: a channel has few in a trigger, and a frame of its own would cost many times its work.
    Times are microseconds, and days their number, of the session's local time."""

    SCHEMA = "cell long, low double, high double, fault boolean, ok boolean, unknown boolean, state string, onset long, strict boolean, last_low double, last_high double, day long, over boolean, told boolean"
    NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
    OUT = ", ".join(f"{name} {kind}" for name, kind in _CHANGE.items())

    def __init__(self, classes: dict[str, tuple[str, ...]], reading: str, threshold: float, tau_seconds: float, silent_days: int, grain: str, wait_ms: int | None = None, zone: str = "UTC"):
        self.classes, self.reading, self.threshold, self.tau, self.silent_days, self.wait_ms, self.zone = classes, reading, threshold, tau_seconds, silent_days, wait_ms, zone
        self.grain = pd.Timedelta(1, grain) // pd.Timedelta(1, "us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.SCHEMA)

    def _load(self) -> dict:
        held = self.held.get()
        return dict(zip(self.NAMES, held, strict=True)) if held is not None else dict.fromkeys(self.NAMES)

    def _close(self, s: dict, out: list[Row], channel: int) -> None:
        """The open cell is over: its state and readings are final."""
        t, f, o, u = s["cell"], s["fault"], s["ok"], s["unknown"]
        state = "A" if (f and o) or u else "F" if f else "O" if o else None
        if state and state != s["state"]:
            if s["state"] == "F":
                exact = state == "O"
                out.append(CHANGE(channel, "fault", s["onset"], t, s["strict"], int((t - s["onset"]) / SECOND >= self.tau) if exact else None, None))
            if state == "F":
                s["onset"], s["strict"] = t, s["state"] == "O"
            s["state"] = state
        if s["high"] is not None:
            if s["last_high"] is not None and s["low"] >= self.threshold > s["last_high"]:
                out.append(CHANGE(channel, "crossing", t, t, None, None, None))
            s["last_low"], s["last_high"] = s["low"], s["high"]
        s["over"] = True

    def _cell_ends(self, s: dict) -> int:
        return epoch_ms(pd.Timestamp(s["cell"] + self.grain, unit="us"), self.zone) + self.wait_ms

    def _silence_lasts(self, s: dict) -> int:
        return epoch_ms(pd.Timestamp((s["day"] + self.silent_days + 1) * DAY, unit="us"), self.zone)

    def _timers(self, s: dict) -> set[int]:
        """One timer for each thing that the channel waits for."""
        if self.wait_ms is None or s["cell"] is None:
            return set()
        return (set() if s["over"] else {self._cell_ends(s)}) | (set() if s["told"] else {self._silence_lasts(s)})

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        s, out = self._load(), []
        set_before = self._timers(s)
        # A key's rows of one trigger; the number of files in it bounds them.
        for r in sorted(rows, key=lambda r: (r.at, r.event_id is None, r.event_id)):
            cell = r.at // self.grain * self.grain
            if s["cell"] is not None and (cell < s["cell"] or (cell == s["cell"] and s["over"])):
                out.append(CHANGE(key[0], "late", r.at, None, None, None, r.event_id))
                continue
            if s["cell"] != cell:
                if s["cell"] is not None and not s["over"]:
                    self._close(s, out, key[0])
                s.update(cell=cell, low=None, high=None, fault=False, ok=False, unknown=False, over=False)
            for name, values in self.classes.items():
                s[name] = s[name] or r.value_state in values
            value = r.value_numeric
            if r.value_state == self.reading and value is not None and value == value:
                s["low"] = value if s["low"] is None else min(s["low"], value)
                s["high"] = value if s["high"] is None else max(s["high"], value)
            day = cell // DAY
            if s["day"] is not None and day - s["day"] - 1 >= self.silent_days:
                out.append(CHANGE(key[0], "silence", (s["day"] + 1) * DAY, (day - 1) * DAY, None, None, None))
            elif s["day"] != day and s["told"]:
                out.append(CHANGE(key[0], "undone", (s["day"] + 1) * DAY, None, None, None, None))
            if s["day"] != day:
                s.update(day=day, told=False)
        self.held.update(tuple(s.values()))
        set_now = self._timers(s)
        for t in set_before - set_now:
            self.handle.deleteTimer(t)
        for t in set_now - set_before:
            self.handle.registerTimer(t)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        s, out, now = self._load(), [], expiredTimerInfo.getExpiryTimeInMs()
        if not s["over"] and now >= self._cell_ends(s):
            self._close(s, out, key[0])
        if not s["told"] and now >= self._silence_lasts(s):
            out.append(CHANGE(key[0], "lasting", (s["day"] + 1) * DAY, None, None, None, None))
            s["told"] = True
        self.held.update(tuple(s.values()))
        yield from out

    def close(self) -> None:
        pass


def channel_changes(stream: DataFrame, classes: dict[str, tuple[str, ...]], reading: str, threshold: float, tau_seconds: float, silent_days: int, grain: str = "s", wait: timedelta | None = None, late: str = "1 minute") -> DataFrame:
    """channel_id, kind (fault, crossing, silence, lasting, undone, late), start, end, strict, sustained, event_id for a stream of events.

    wait: events have a column seen, the time at which they came. Rows come in order of it (but for `late`), so none is lost to its
    watermark, and those whose event time is behind what the channel has closed are told of. Without wait there are no timers."""
    zone = zone_of(stream)
    at = F.unix_micros(F.from_utc_timestamp(F.col("event_time"), zone)).alias("at")
    columns = ["channel_id", "event_id", at, "value_state", F.col("value_numeric").cast("double").alias("value_numeric")]
    make = lambda *more: ChannelState(classes, reading, threshold, tau_seconds, silent_days, grain, *more)
    if wait is None:
        found = stream.select(*columns).groupBy("channel_id").transformWithState(make(), ChannelState.OUT, "Append", "None")
    else:
        held = make(int(wait.total_seconds() * 1000), zone)
        found = stream.select(*columns, "seen").withWatermark("seen", late).groupBy("channel_id").transformWithState(held, ChannelState.OUT, "Append", "EventTime")
    return found.withColumns({c: F.to_utc_timestamp(F.timestamp_micros(c), zone) for c in ("start", "end")})


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Take all there is and stop; a second run with the same checkpoint takes only what is new."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", name: str | None = None) -> None:
    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    writer.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
