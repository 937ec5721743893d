"""Spaced repetition, reading engagement and reflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_EASE, FIRST_EASE = 1.3, 2.5
#: Fixed value: the longest interval in days whose due date a timestamp holds.
MOST_DAYS = 100_000_000
_STATE = "struct<ease:double,interval:bigint,repetitions:int,reviews:int,correct:int>"


def review_step(state: Column, q: Column) -> Column:
    """The state after a review of quality ``q`` (0 to 5).

    Below 3 the repetitions start again and the interval is a day; from 3 on the ease changes first, and the interval
    is 1, then 6, then the last one times the new ease, rounded half to even. The change of ease is counted in whole
    hundredths, so that it is the double nearest to it and products on a half round as they should.
    """
    missed = 5 - q
    ease = F.greatest(F.lit(LEAST_EASE), state["ease"] + (10 - missed * (8 + missed * 2)) / F.lit(100.0))
    interval = F.when(state["repetitions"] == 0, 1).when(state["repetitions"] == 1, 6).otherwise(F.bround(state["interval"] * ease, 0).cast("long"))
    right = q >= 3
    return F.struct(
        F.when(right, ease).otherwise(state["ease"]).alias("ease"), F.when(right, interval).otherwise(1).alias("interval"),
        F.when(right, state["repetitions"] + 1).otherwise(0).alias("repetitions"), (state["reviews"] + 1).alias("reviews"),
        (state["correct"] + right.cast("int")).alias("correct"),
    ).cast(_STATE)


def new_card() -> Column:
    return F.struct(F.lit(FIRST_EASE).alias("ease"), F.lit(0).alias("interval"), F.lit(0).alias("repetitions"), F.lit(0).alias("reviews"), F.lit(0).alias("correct")).cast(_STATE)


def card_states(reviews: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id", quality: str = "quality") -> DataFrame:
    """State of each card after all its reviews in the order of time, and when it is next due."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(quality).cast("int").alias("q"))))
    folded = reviews.groupBy(*key).agg(ordered.alias("log"))
    s = folded.select(*key, F.aggregate("log", new_card(), lambda a, r: review_step(a, r["q"])).alias("s"), F.element_at("log", -1)["ts"].alias("last_review"))
    return s.select(*key, "s.*", "last_review", (F.col("last_review") + F.make_dt_interval(F.least("s.interval", F.lit(MOST_DAYS)).cast("int"))).alias("next_review"))


def due(cards: DataFrame, as_of: Column, *key: str) -> DataFrame:
    return cards.where(F.col("next_review") <= as_of).orderBy("next_review", *key)


def upcoming(cards: DataFrame, as_of: Column, days: int) -> DataFrame:
    return cards.where((F.col("next_review") > as_of) & (F.col("next_review") <= as_of + F.make_dt_interval(F.lit(days))))


def study_stats(cards: DataFrame, as_of: Column) -> DataFrame:
    """Totals, due now and today, mean ease (2 places) and retention in percent (1 place), mature and learning cards."""
    today = F.date_trunc("day", as_of) + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))
    retention = F.when(F.col("reviews") > 0, F.col("correct") / F.col("reviews"))
    mature = F.count_if(F.col("interval") > 21)
    return cards.agg(
        F.count("*").alias("total_cards"), F.count_if(F.col("next_review") <= as_of).alias("due_now"), F.count_if(F.col("next_review") <= today).alias("due_today"),
        F.round(F.coalesce(F.avg("ease"), F.lit(0.0)), 2).alias("average_ease"), F.round(F.coalesce(F.avg(retention), F.lit(0.0)) * 100, 1).alias("average_retention"),
        mature.alias("mature_cards"), (F.count("*") - mature).alias("learning_cards"),
    )


def optimal_reviews(minutes: Column, due_cards: Column, seconds_each: int = 30) -> Column:
    return F.least(F.floor(minutes * 60 / seconds_each), due_cards)


def retention(days: Column, interval: Column, ease: Column) -> Column:
    """exp(-days / (interval x ease)) to 3 places; 0 without stability."""
    stability = interval * ease
    return F.when(stability > 0, F.round(F.exp(-days / stability), 3)).otherwise(0.0)


def reading_sessions(events: DataFrame, gap_minutes: int = 30, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with a session number: a pause longer than the gap begins the next one."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    return events.withColumn("_new", (F.coalesce(pause, F.lit(0)) > gap_minutes * 60_000_000).cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def comprehension(minutes: Column, scroll: Column, highlights: Column, questions: Column, flashcards: Column, expanded: Column) -> Column:
    """0.5 moved by duration, scroll depth, interactions and expanded sections, held in [0, 1]."""
    time = F.when((minutes >= 5) & (minutes <= 30), 0.1).when(minutes < 2, -0.1).when(minutes > 60, -0.05).otherwise(0.0)
    depth = F.when(scroll >= 0.9, 0.15).when(scroll >= 0.7, 0.1).when(scroll >= 0.5, 0.05).otherwise(0.0)
    acts = F.least(F.lit(0.2), (highlights * 2 + questions * 3 + flashcards * 2) * 0.02)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + time + depth + acts + F.least(F.lit(0.1), expanded * 0.02)))


def session_summary(events: DataFrame, user: str = "user_id") -> DataFrame:
    """A row a session: duration, scroll depth, counts by interaction and the comprehension estimate.

    events: session, ts, interaction (highlight, scroll, expand_section, create_flashcard, ask_question), depth, section.
    """
    kind = lambda k: F.count_if(F.col("interaction") == k)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    s = events.groupBy(user, "session").agg(
        ((F.max(micros) - F.min(micros)) / 60_000_000).alias("minutes"), F.coalesce(F.max(F.when(F.col("interaction") == "scroll", F.col("depth"))), F.lit(0.0)).alias("scroll"),
        kind("highlight").alias("highlights"), kind("ask_question").alias("questions"), kind("create_flashcard").alias("flashcards"),
        F.count_distinct(F.when(F.col("interaction") == "expand_section", F.col("section"))).alias("expanded"), F.count("*").alias("events"), F.min("ts").alias("started"),
    )
    estimate = comprehension(*(F.col(c) for c in ("minutes", "scroll", "highlights", "questions", "flashcards", "expanded")))
    return s.withColumn("comprehension", estimate)


def user_profile(sessions: DataFrame, user: str = "user_id") -> DataFrame:
    """Totals and means over a user's sessions; the estimate is the last session's."""
    return sessions.groupBy(user).agg(
        F.count("*").alias("documents_read"), F.sum("minutes").alias("total_minutes"), F.avg("minutes").alias("avg_minutes"), F.avg("scroll").alias("avg_scroll"),
        F.sum("highlights").alias("total_highlights"), F.sum("flashcards").alias("total_flashcards"), F.max_by("comprehension", F.struct("started", "session")).alias("comprehension"),
    )


def preferred_complexity(sessions: DataFrame, user: str = "user_id", start: float = 50.0) -> DataFrame:
    """Fold in session order: sessions with adjustments move the preference, weighted by the session's number.

    sessions: session (the order) and adjustment (mean of the session's adjustments, or null).
    """
    log = F.array_sort(F.collect_list(F.struct(F.col("session").alias("n"), F.col("adjustment").alias("x"))))
    s = sessions.groupBy(user).agg(log.alias("log"))
    init = F.struct(F.lit(start).alias("v"), F.lit(0).alias("n"))
    step = lambda a, r: F.struct(F.when(r["x"].isNull(), a["v"]).otherwise((a["v"] * a["n"] + r["x"]) / (a["n"] + 1)).alias("v"), (a["n"] + 1).alias("n"))
    return s.select(user, F.aggregate("log", init, step, lambda a: a["v"]).alias("preferred_complexity"))


def running_means(sessions: DataFrame, user: str = "user_id") -> DataFrame:
    w = Window.partitionBy(user).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return sessions.select(user, "session", F.avg("minutes").over(w).alias("avg_minutes"), F.avg("scroll").over(w).alias("avg_scroll"))


def reading_tips(profiles: DataFrame, user: str = "user_id") -> DataFrame:
    tips = F.array_compact(F.array(
        F.when(F.col("avg_scroll") < 0.5, "Read sections to their end"),
        F.when(F.col("total_highlights") < F.col("documents_read"), "Highlight key concepts"),
        F.when(F.col("total_flashcards") < F.col("documents_read"), "Create flashcards"),
    ))
    return profiles.select(user, F.array_join(tips, "; ").alias("tips"))


def section_attention(sections: DataFrame) -> DataFrame:
    """review: seen, but under five seconds; focus: expanded more than twice. sections: section, views, dwell_ms, expands."""
    state = F.when((F.col("views") > 0) & (F.col("dwell_ms") < 5000), "review").when(F.col("expands") > 2, "focus")
    return sections.select("section", state.alias("attention")).where("attention is not null")


def snapshot_comprehension(minutes: Column, scroll: Column, highlights: Column, takeaways: Column, questions: Column) -> Column:
    base = F.when((minutes >= 10) & (minutes <= 30), 0.45).when(minutes > 5, 0.4).otherwise(0.3)  # 0.3 and the time's share, as 0.3 + 0.15 is less than 0.45 in doubles
    acts = F.least(F.lit(0.15), highlights * 0.03) + F.least(F.lit(0.15), takeaways * 0.05) + F.least(F.lit(0.05), questions * 0.01)
    return F.least(F.lit(1.0), base + scroll * 0.2 + acts)


def snapshot_diffs(snapshots: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each snapshot against the one before: new takeaways, resolved and new questions, velocity and trend.

    snapshots: key, order, ts, comprehension, takeaways and questions (arrays of strings).
    """
    w = Window.partitionBy(*key).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    j = snapshots.select("*", *(before(c).alias(f"_{c}") for c in (order, "ts", "comprehension", "takeaways", "questions"))).where(F.col(f"_{order}").isNotNull())
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))) / 3_600_000_000
    change = F.col("comprehension") - F.col("_comprehension")
    trend = F.when(change > 0.1, "increasing").when(change < -0.1, "decreasing").otherwise("stable")
    return j.select(
        *key, F.col(f"_{order}").alias("from_snapshot"), F.col(order).alias("to_snapshot"), change.alias("comprehension_change"),
        F.array_sort(F.array_except("takeaways", "_takeaways")).alias("new_takeaways"), F.array_sort(F.array_except("_questions", "questions")).alias("resolved_questions"),
        F.array_sort(F.array_except("questions", "_questions")).alias("new_questions"), F.when(hours > 0, change / hours).otherwise(0.0).alias("velocity"), trend.alias("trend"),
    )


def learning_journey(snapshots: DataFrame, key: list[str], order: str) -> DataFrame:
    """First against last snapshot of each key, with totals and the days between."""
    days = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 86_400_000_000
    growth = F.max_by("comprehension", order) - F.min_by("comprehension", order)
    return snapshots.groupBy(*key).agg(F.count("*").alias("snapshots"), growth.alias("growth"), F.sum(F.size("takeaways")).alias("takeaways"), days.alias("span_days"))


def reflection_prompts(latest: DataFrame, key: list[str], as_of: Column) -> DataFrame:
    """Up to four prompts from the newest snapshot. latest: questions, comprehension, ts, snapshots (how many)."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    prompts = F.array_compact(F.array(
        F.when(F.size("questions") > 0, F.concat(F.lit("Have you answered: "), F.try_element_at("questions", F.lit(1)), F.lit("?"))),
        F.when(F.col("comprehension") < 0.5, "Which parts are unclear?").otherwise("How does this connect to what you knew?"),
        F.when((F.col("snapshots") >= 2) & (days > 7), "What do you remember without looking?"),
        F.lit("What is the most important thing you learned?"), F.lit("How might you apply it?"),
    ))
    return latest.select(*key, F.slice(prompts, 1, 4).alias("prompts"))


def snapshot_hash(summary: Column, *lists: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("\u001f", summary, *(F.array_join(x, "\u001e") for x in lists))), 1, 8)


def dwell_by_section(events: DataFrame, user: str = "user_id", section: str = "section") -> DataFrame:
    """(user, section, views, dwell_ms, expands, last_seen). events: user, section, kind (view, dwell, expand), dwell_ms, ts.

    Times below zero or null count as none; a section that was only dwelt on has no views.
    """
    at = lambda k: F.col("kind") == k
    ms = F.when(at("dwell"), F.greatest(F.coalesce("dwell_ms", F.lit(0)), F.lit(0))).otherwise(0)
    return events.groupBy(user, section).agg(F.count_if(at("view")).alias("views"), F.sum(ms).alias("dwell_ms"), F.count_if(at("expand")).alias("expands"), F.max("ts").alias("last_seen"))


def latest_snapshots(snapshots: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest snapshot of each key, and how many there are."""
    return snapshots.groupBy(*key).agg(F.max_by(F.struct(*(c for c in snapshots.columns if c not in key)), order).alias("s"), F.count("*").alias("snapshots")).select(*key, "s.*", "snapshots")
