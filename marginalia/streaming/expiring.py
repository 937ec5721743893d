"""Keyed state that leaves when its time is over: request limits and the states of uploads, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Types of files with their endings, states of an upload and the steps between them.
MIME_TYPES = {"application/pdf": ".pdf", "application/epub+zip": ".epub"}
STEPS = {"pending": ("processing", "failed"), "processing": ("validated", "failed"), "validated": (), "failed": ()}


def use_state_store(spark: SparkSession) -> None:
    """Processors with timers need the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(frames, *columns: str) -> list[tuple]:
    """All rows of a key's batch in the order of ``columns``, tuples of them, frame by frame into one sorted list."""
    return sorted(tuple(r) for f in frames for r in f[list(columns)].itertuples(index=False, name=None))


def _timed(df: DataFrame, late: str, *columns: Column) -> DataFrame:
    """The columns with ``ts`` under a watermark and ``at``, the same in seconds, which knows no time zone."""
    ts = F.col("ts").cast("timestamp")
    return df.select(*columns, ts.alias("ts"), (F.unix_micros(ts) / 1e6).alias("at")).withWatermark("ts", late)


def _time() -> Column:
    return F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")).alias("ts")


class _Limiter(StatefulProcessor):
    def __init__(self, key: str, limit: int, seconds: int, block: int) -> None:
        self.key, self.limit, self.seconds, self.block = key, limit, seconds, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "ts double")
        self.until = handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N803
        import pandas as pd

        recent = [t for (t,) in self.recent.get()] if self.recent.exists() else []
        until, out = self.until.get()[0] if self.until.exists() else 0.0, []
        for (now,) in _rows(rows, "at"):
            recent = [t for t in recent if t > now - self.seconds]
            ok = now >= until and len(recent) < self.limit
            if ok:
                recent.append(now)
            elif now >= until:
                until = now + self.block
            out.append((key[0], now, ok))
        self.recent.put([(t,) for t in recent]) if recent else self.recent.clear()
        self.until.update((until,)) if until else self.until.clear()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(1000 * max(until, max(recent, default=0.0) + self.seconds)) + 1)
        yield pd.DataFrame(out, columns=[self.key, "at", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N803
        self.recent.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int = 60, seconds: int = 60, block_seconds: int = 60, late: str = "1 minute", key: str = "client") -> DataFrame:
    """Each request with whether it passes: at most ``limit`` in any window of ``seconds``, then a block.

    requests: key (string), ts. A client's state is the times that still count and its block; a timer clears it once the
    watermark is past both, so clients that are gone cost nothing. Requests later than ``late`` behind the newest are
    dropped by the watermark; within a batch they are taken in the order of their times.
    """
    use_state_store(requests.sparkSession)
    r = _timed(requests, late, F.col(key).cast("string").alias(key))
    out = r.groupBy(key).transformWithStateInPandas(_Limiter(key, limit, seconds, block_seconds), f"{key} string, at double, allowed boolean", "Append", "EventTime")
    return out.select(key, _time(), "allowed")


class _Uploads(StatefulProcessor):
    """The uploads of one bucket: their states are one value and their next deadline is one timer, as each access costs a message."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<string>, statuses array<string>, since array<double>")

    def _load(self) -> dict[str, tuple[str, float]]:
        if not self.open.exists():
            return {}
        ids, statuses, since = self.open.get()
        return dict(zip(ids, zip(statuses, since, strict=True), strict=True))

    def _deadline(self, since: float) -> int:
        return int(1000 * (since + self.timeout))

    def _keep(self, states: dict[str, tuple[str, float]]) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if states:
            statuses, since = zip(*states.values(), strict=True)
            self.open.update((list(states), list(statuses), list(since)))
            self.handle.registerTimer(self._deadline(min(since)))
        else:
            self.open.clear()

    def _said(self, out: list[tuple]):
        import pandas as pd

        return pd.DataFrame(out, columns=["doc_id", "at", "status", "accepted", "reason"])

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N803
        states, out = self._load(), []
        for doc, now, to in _rows(rows, "doc_id", "at", "status"):
            status, since = states.get(doc, (None, 0.0))
            if status == "processing" and now >= since + self.timeout:  # its time was over before this row
                out.append((doc, since + self.timeout, "failed", True, "timeout"))
                status = "failed"
                states[doc] = (status, since)
            ok = to == "pending" if status is None else to in STEPS.get(status, ())
            out.append((doc, now, to, ok, None if ok else f"{status or 'nothing'} to {to}"))
            if ok:
                states[doc] = (to, now)
        self._keep(states)
        yield self._said(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N803
        states, out = self._load(), []
        past = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        for doc, (status, since) in list(states.items()):
            if self._deadline(since) < past:
                del states[doc]
                if status == "processing":
                    out.append((doc, since + self.timeout, "failed", True, "timeout"))
        self._keep(states)
        if out:
            yield self._said(out)

    def close(self) -> None:
        pass


def upload_states(steps: DataFrame, timeout: int = 600, late: str = "1 minute", buckets: int = 4096) -> DataFrame:
    """(doc_id, ts, status, accepted, reason): each step of an upload, taken or refused, and the failure of those that stay in processing.

    steps: doc_id, ts, status. An upload begins as pending, goes to processing and ends as validated or failed; any other
    step is refused with a reason (the side output: ``accepted`` is false) and changes nothing. What is in processing for
    ``timeout`` seconds fails by a timer. State is dropped ``timeout`` after the last step taken. Uploads are kept in
    ``buckets`` by a hash of their ids: a bucket holds its share of the open uploads and of a batch's rows in memory.
    """
    use_state_store(steps.sparkSession)
    s = _timed(steps, late, F.col("doc_id").cast("string").alias("doc_id"), F.col("status"))
    s = s.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    out = s.groupBy("bucket").transformWithStateInPandas(_Uploads(timeout), "doc_id string, at double, status string, accepted boolean, reason string", "Append", "EventTime")
    return out.select("doc_id", _time(), "status", "accepted", "reason")


def known_type(content_type):
    """The ending of a file of this MIME type, null where it isn't taken."""
    table = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    return F.try_element_at(table, F.lower(content_type))
