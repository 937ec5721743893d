"""Keyed state machines as Structured Streaming: reading sessions, daily counts, card schedules, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.streaming.expiring import rate_limited  # noqa: F401  (limits, with state that expires)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events, span and last event of each session; events later than ``late`` behind the newest are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended")).select(user, "started", "ended", "events")


def daily_counts(events: DataFrame, late: str = "1 day", kind: str = "event_type", ts: str = "ts") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n")


def card_schedule(reviews: DataFrame, key: str = "card_id") -> DataFrame:
    """A row for each review with the card's new state. reviews: key (string), ts, quality; order by arrival, then ts."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ease, interval, reps, n, right = state.get if state.exists else (2.5, 0, 0, 0, 0)
        rows = []
        for r in pd.concat(frames).sort_values("ts").itertuples():
            n += 1
            if r.quality < 3:
                reps, interval = 0, 1
            else:
                right += 1
                miss = 5 - r.quality
                ease = max(1.3, ease + 0.1 - miss * (0.08 + miss * 0.02))
                interval = (1, 6)[reps] if reps < 2 else round(interval * ease)
                reps += 1
            rows.append((k[0], r.ts, ease, interval, reps, n, right))
        state.update((ease, interval, reps, n, right))
        yield pd.DataFrame(rows, columns=[key, "ts", "ease", "interval", "repetitions", "reviews", "correct"])

    out = f"{key} string, ts timestamp, ease double, interval int, repetitions int, reviews int, correct int"
    kept = "ease double, interval int, repetitions int, reviews int, correct int"
    return reviews.groupBy(key).applyInPandasWithState(run, out, kept, "append", "NoTimeout")


def merged_annotations(ops: DataFrame, key: str = "annotation_id") -> DataFrame:
    """The state of each annotation after every batch of its operations. ops: key, seq, op, content, clock (JSON of counts)."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there, deleted, content, clock = state.get if state.exists else (False, False, None, "{}")
        for r in pd.concat(frames).sort_values("seq").itertuples():
            mine, theirs = json.loads(clock), json.loads(r.clock)
            diff = [theirs.get(x, 0) - mine.get(x, 0) for x in mine.keys() | theirs.keys()]
            older = any(d < 0 for d in diff) and not any(d > 0 for d in diff)
            if r.op == "insert" and not there:
                there, content, clock = True, r.content, r.clock
            elif r.op == "update" and there and not older:
                content, clock = r.content if r.content is not None else content, r.clock
            elif r.op == "delete" and there:
                deleted, clock = True, r.clock
        state.update((there, deleted, content, clock))
        yield pd.DataFrame([(k[0], there, deleted, content)], columns=[key, "present", "deleted", "content"])

    return ops.groupBy(key).applyInPandasWithState(run, f"{key} string, present boolean, deleted boolean, content string", "present boolean, deleted boolean, content string, clock string", "update", "NoTimeout")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives over all that is there now, from the memory sink (small results and tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
