"""Queries over events and conversations: schedules, engagement, reflection, ethics, privacy, collaboration."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import catalog, ethics, learning, privacy
from marginalia.plans.base import SQL_REVIEWS, events, query, read, reviews

AS_OF = "2024-02-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


_SQL_STATES = f"""WITH RECURSIVE {SQL_REVIEWS},
o AS (SELECT card_id, ts, quality AS q, row_number() OVER (PARTITION BY card_id ORDER BY ts, event_id) AS n FROM reviews),
st AS (SELECT card_id, 0::BIGINT AS n, 2.5::DOUBLE AS ease, 0::BIGINT AS interval, 0::BIGINT AS reps, 0::BIGINT AS correct, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT card_id FROM o)
UNION ALL SELECT o.card_id, o.n, CASE WHEN q >= 3 THEN greatest(1.3, ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))) ELSE ease END,
CASE WHEN q < 3 THEN 1 WHEN reps = 0 THEN 1 WHEN reps = 1 THEN 6 ELSE round_even(interval * greatest(1.3, ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))), 0)::BIGINT END,
CASE WHEN q >= 3 THEN reps + 1 ELSE 0 END, correct + (q >= 3)::INT, o.ts FROM st JOIN o ON o.card_id = st.card_id AND o.n = st.n + 1),
cards AS (SELECT card_id, ease, interval, reps AS repetitions, n AS reviews, correct, ts AS last_review, ts + to_days(interval::INTEGER) AS next_review FROM st QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY n DESC) = 1)"""


def _cards(spark, sf):
    return learning.card_states(reviews(spark, sf), ["card_id"])


def _clip(c):
    """Intervals can grow past what dates hold; both sides compare them up to ten years."""
    return F.least(F.col(c), F.lit(3650)).cast("long").alias(c)


@query(f"{_SQL_STATES} SELECT card_id, round(ease, 6) AS ease, least(interval, 3650) AS interval, repetitions, reviews, correct FROM cards")
def sm2_fold(spark, sf):
    return _cards(spark, sf).select("card_id", F.round("ease", 6).alias("ease"), _clip("interval"), *(F.col(c).cast("long").alias(c) for c in ("repetitions", "reviews", "correct")))


@query(f"{_SQL_STATES} SELECT card_id, strftime(next_review, '%Y-%m-%d %H:%M') AS next_review FROM cards WHERE next_review <= TIMESTAMP '{AS_OF}'")
def sm2_due(spark, sf):
    return learning.due(_cards(spark, sf), _as_of(), "card_id").select("card_id", F.date_format("next_review", "yyyy-MM-dd HH:mm").alias("next_review"))


@query(f"{_SQL_STATES} SELECT card_id, strftime(next_review, '%Y-%m-%d %H:%M') AS next_review FROM cards WHERE next_review > TIMESTAMP '{AS_OF}' AND next_review <= TIMESTAMP '{AS_OF}' + to_days(7)")
def sm2_upcoming(spark, sf):
    return learning.upcoming(_cards(spark, sf), _as_of(), 7).select("card_id", F.date_format("next_review", "yyyy-MM-dd HH:mm").alias("next_review"))


@query(f"""{_SQL_STATES} SELECT count(*) AS total_cards, count(*) FILTER (WHERE next_review <= TIMESTAMP '{AS_OF}') AS due_now, count(*) FILTER (WHERE next_review <= date_trunc('day', TIMESTAMP '{AS_OF}') + INTERVAL '23:59:59') AS due_today,
round(avg(ease), 2) AS average_ease, round(avg(correct / reviews) * 100, 1) AS average_retention, count(*) FILTER (WHERE interval > 21) AS mature_cards, count(*) FILTER (WHERE interval <= 21) AS learning_cards FROM cards""")
def sm2_stats(spark, sf):
    return learning.study_stats(_cards(spark, sf), _as_of())


@query(f"{_SQL_STATES} SELECT card_id, CASE WHEN interval * ease > 0 THEN round(exp(-7 / (interval * ease)), 3) ELSE 0 END AS retention FROM cards")
def retention_predict(spark, sf):
    return _cards(spark, sf).select("card_id", learning.retention(F.lit(7), F.col("interval"), F.col("ease")).alias("retention"))


@query(f"{_SQL_STATES} SELECT least(20 * 60 // 30, count(*) FILTER (WHERE next_review <= TIMESTAMP '{AS_OF}'))::BIGINT AS cards FROM cards")
def optimal_reviews(spark, sf):
    stats = learning.study_stats(_cards(spark, sf), _as_of())
    return stats.select(learning.optimal_reviews(F.lit(20), F.col("due_now")).cast("long").alias("cards"))


_SQL_SESSIONS = """e AS (SELECT user_id, event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000 AS gap FROM events),
s AS (SELECT *, coalesce(sum(gap::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS session FROM e),
sm AS (SELECT user_id, session, (max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000 AS minutes, coalesce(max(CASE WHEN event_type = 'view' THEN least(value, 100) / 100 END), 0) AS scroll,
count(*) FILTER (WHERE event_type = 'click') AS highlights, count(*) FILTER (WHERE event_type = 'error') AS questions, count(*) FILTER (WHERE event_type = 'purchase') AS flashcards,
count(DISTINCT CASE WHEN event_type = 'signup' THEN k END) AS expanded, count(*) AS events, min(ts) AS started FROM s GROUP BY ALL),
se AS (SELECT *, (greatest(0, least(1, 0.5 + CASE WHEN minutes BETWEEN 5 AND 30 THEN 0.1 WHEN minutes < 2 THEN -0.1 WHEN minutes > 60 THEN -0.05 ELSE 0 END
+ CASE WHEN scroll >= 0.9 THEN 0.15 WHEN scroll >= 0.7 THEN 0.1 WHEN scroll >= 0.5 THEN 0.05 ELSE 0 END + least(0.2, (highlights * 2 + questions * 3 + flashcards * 2) * 0.02) + least(0.1, expanded * 0.02))))::DOUBLE AS comprehension FROM sm)"""
_KINDS = {"click": "highlight", "view": "scroll", "signup": "expand_section", "purchase": "create_flashcard", "error": "ask_question"}


def _sessions(spark, sf):
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv)), F.col("event_type"))
    e = events(spark, sf).select("event_id", "ts", "user_id", kind.alias("interaction"), (F.least("value", F.lit(100)) / 100).alias("depth"), F.get_json_object("props", "$.k").cast("long").alias("section"))
    return learning.session_summary(learning.reading_sessions(e))


@query(f"WITH {_SQL_SESSIONS} SELECT user_id, session::BIGINT AS session, round(minutes, 4) AS minutes, round(scroll, 4) AS scroll, highlights, questions, flashcards, expanded, events, round(comprehension, 4) AS comprehension FROM se")
def session_summary(spark, sf):
    return _sessions(spark, sf).select("user_id", "session", F.round("minutes", 4).alias("minutes"), F.round("scroll", 4).alias("scroll"), "highlights", "questions", "flashcards", "expanded", "events", F.round("comprehension", 4).alias("comprehension"))


@query(f"""WITH {_SQL_SESSIONS} SELECT user_id, count(*) AS documents_read, round(sum(minutes), 3) AS total_minutes, round(avg(minutes), 3) AS avg_minutes, round(avg(scroll), 9) AS avg_scroll, sum(highlights)::BIGINT AS total_highlights, sum(flashcards)::BIGINT AS total_flashcards,
round(max_by(comprehension, session), 4) AS comprehension FROM se GROUP BY user_id""")
def engagement_profile(spark, sf):
    p = learning.user_profile(_sessions(spark, sf))
    return p.select("user_id", "documents_read", F.round("total_minutes", 3).alias("total_minutes"), F.round("avg_minutes", 3).alias("avg_minutes"), F.round("avg_scroll", 9).alias("avg_scroll"), "total_highlights", "total_flashcards", F.round("comprehension", 4).alias("comprehension"))


@query(f"""WITH {_SQL_SESSIONS}, p AS (SELECT user_id, count(*) AS d, avg(scroll) AS sc, sum(highlights) AS h, sum(flashcards) AS f FROM se GROUP BY user_id)
SELECT user_id, array_to_string(list_filter([CASE WHEN sc < 0.5 THEN 'Read sections to their end' END, CASE WHEN h < d THEN 'Highlight key concepts' END, CASE WHEN f < d THEN 'Create flashcards' END], lambda x: x IS NOT NULL), '; ') AS tips FROM p""")
def reading_tips(spark, sf):
    return learning.reading_tips(learning.user_profile(_sessions(spark, sf)))


@query(f"WITH {_SQL_SESSIONS} SELECT user_id, session::BIGINT AS session, round(avg(minutes) OVER w, 6) AS avg_minutes, round(avg(scroll) OVER w, 12) AS avg_scroll FROM se WINDOW w AS (PARTITION BY user_id ORDER BY session ROWS UNBOUNDED PRECEDING)")
def running_avg(spark, sf):
    return learning.running_means(_sessions(spark, sf)).select("user_id", "session", F.round("avg_minutes", 6).alias("avg_minutes"), F.round("avg_scroll", 12).alias("avg_scroll"))


@query(f"""WITH RECURSIVE {_SQL_SESSIONS}, a AS (SELECT user_id, session, CASE WHEN highlights > 0 THEN scroll * 100 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY session) AS n FROM se),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 50.0::DOUBLE AS v FROM a UNION ALL SELECT a.user_id, a.n, CASE WHEN x IS NULL THEN v ELSE (v * (a.n - 1) + x) / a.n END FROM f JOIN a ON a.user_id = f.user_id AND a.n = f.n + 1)
SELECT user_id, round(v, 4) AS preferred_complexity FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def complexity_fold(spark, sf):
    s = _sessions(spark, sf).withColumn("adjustment", F.when(F.col("highlights") > 0, F.col("scroll") * 100))
    return learning.preferred_complexity(s).select("user_id", F.round("preferred_complexity", 4).alias("preferred_complexity"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS section, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 AND sum(value) * 10 < 5000 THEN 'review' WHEN count(*) FILTER (WHERE event_type = 'signup') > 2 THEN 'focus' END AS attention FROM events GROUP BY 1 HAVING attention IS NOT NULL""")
def section_attention(spark, sf):
    s = events(spark, sf).groupBy(F.get_json_object("props", "$.k").cast("long").alias("section")).agg(F.count_if(F.col("event_type") == "view").alias("views"), (F.sum("value") * 10).alias("dwell_ms"), F.count_if(F.col("event_type") == "signup").alias("expands"))
    return learning.section_attention(s)


_SQL_SNAPSHOTS = r"""sn AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_hours(turn::INTEGER) AS ts, least(1.0, 0.3 + CASE WHEN length(text) BETWEEN 10 AND 30 THEN 0.15 WHEN length(text) > 5 THEN 0.1 ELSE 0 END + (length(text) % 100) / 100 * 0.2)::DOUBLE AS comprehension,
list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 6)) AS takeaways, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) = 5)) AS questions FROM conversations)"""


def _snapshots(spark, sf):
    c = read(spark, sf, "conversations")
    ws = F.split(F.lower("text"), r"\s+")
    score = learning.snapshot_comprehension(F.length("text"), (F.length("text") % 100) / 100, F.lit(0), F.lit(0), F.lit(0))
    return c.select("conv_id", "turn", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))).alias("ts"), score.alias("comprehension"), F.array_distinct(F.filter(ws, lambda w: F.length(w) > 6)).alias("takeaways"), F.array_distinct(F.filter(ws, lambda w: F.length(w) == 5)).alias("questions"))


@query(f"""WITH {_SQL_SNAPSHOTS}, p AS (SELECT *, lag(turn) OVER w AS t0, lag(comprehension) OVER w AS c0, lag(ts) OVER w AS ts0, lag(takeaways) OVER w AS k0, lag(questions) OVER w AS q0 FROM sn WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, t0 AS from_snapshot, turn AS to_snapshot, round(comprehension - c0, 6) AS comprehension_change, array_to_string(list_sort(list_filter(takeaways, lambda x: NOT list_contains(k0, x))), ' ') AS new_takeaways,
array_to_string(list_sort(list_filter(q0, lambda x: NOT list_contains(questions, x))), ' ') AS resolved_questions, round((comprehension - c0) / ((epoch_us(ts) - epoch_us(ts0)) / 3600000000), 6) AS velocity,
CASE WHEN comprehension - c0 > 0.1 THEN 'increasing' WHEN comprehension - c0 < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM p WHERE t0 IS NOT NULL""")
def snapshot_diff(spark, sf):
    d = learning.snapshot_diffs(_snapshots(spark, sf), ["conv_id"], "turn")
    return d.select("conv_id", "from_snapshot", "to_snapshot", F.round("comprehension_change", 6).alias("comprehension_change"), F.array_join("new_takeaways", " ").alias("new_takeaways"), F.array_join("resolved_questions", " ").alias("resolved_questions"), F.round("velocity", 6).alias("velocity"), "trend")


@query(f"""WITH {_SQL_SNAPSHOTS} SELECT conv_id, count(*) AS snapshots, round(max_by(comprehension, turn) - min_by(comprehension, turn), 6) AS growth, sum(len(takeaways))::BIGINT AS takeaways, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000, 6) AS span_days FROM sn GROUP BY conv_id""")
def journey_summary(spark, sf):
    return learning.learning_journey(_snapshots(spark, sf), ["conv_id"], "turn").select("conv_id", "snapshots", F.round("growth", 6).alias("growth"), "takeaways", F.round("span_days", 6).alias("span_days"))


@query(f"""WITH {_SQL_SNAPSHOTS}, l AS (SELECT conv_id, max_by(questions, turn) AS q, max_by(comprehension, turn) AS c, max(ts) AS ts, count(*) AS n FROM sn GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter([CASE WHEN len(q) > 0 THEN 'asked' END, CASE WHEN c < 0.5 THEN 'unclear' ELSE 'connect' END, CASE WHEN n >= 2 THEN 'remember' END, 'learned', 'apply'], lambda x: x IS NOT NULL)[1:4], ',') AS prompts FROM l""")
def reflection_prompts(spark, sf):
    s = _snapshots(spark, sf).groupBy("conv_id").agg(F.max_by("questions", "turn").alias("questions"), F.max_by("comprehension", "turn").alias("comprehension"), F.max("ts").alias("ts"), F.count("*").alias("snapshots"))
    p = learning.reflection_prompts(s, ["conv_id"], F.lit("2024-03-01").cast("timestamp"))
    short = F.transform("prompts", lambda x: F.when(x.startswith("Have you"), "asked").when(x.startswith("Which"), "unclear").when(x.startswith("How does"), "connect").when(x.startswith("What do you"), "remember").when(x.startswith("What is"), "learned").otherwise("apply"))
    return p.select("conv_id", F.array_join(short, ",").alias("prompts"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_rate_60s(spark, sf):
    return ethics.requests_in_last(events(spark, sf), 60, 60).select("event_id", "in_window")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def ops_by_day(spark, sf):
    return ethics.operations_by_day(events(spark, sf), "user_id")


@query("SELECT event_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def type_distribution_pct(spark, sf):
    return ethics.operations_by_type(events(spark, sf))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 10")
def recent_ops_topk(spark, sf):
    return ethics.recent(events(spark, sf), 10, "user_id").select("user_id", "event_id", F.col("place").cast("long").alias("place"))


def _ops(spark, sf):
    return events(spark, sf).withColumns({"confidence": F.least(F.col("value") / 100, F.lit(1.0)), "needs_review": F.col("event_type") == "error"})


_SQL_DASH = f"""d AS (SELECT user_id, count(*) AS operations, count(DISTINCT event_type) AS types, count(*) FILTER (WHERE least(value / 100, 1) < 0.7) AS low_confidence, count(*) FILTER (WHERE event_type = 'error') AS to_review
FROM events WHERE ts > TIMESTAMP '{AS_OF}' - to_days(30) AND ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id)"""


@query(f"WITH {_SQL_DASH} SELECT * FROM d")
def ethics_dashboard(spark, sf):
    return ethics.dashboard(_ops(spark, sf), _as_of()).drop("last_operation")


@query(f"""WITH {_SQL_DASH} SELECT user_id, CASE WHEN low_confidence = 0 AND to_review = 0 THEN 'No action needed' ELSE array_to_string(list_filter([CASE WHEN low_confidence > 0 THEN 'Review ' || low_confidence || ' operations of low confidence' END,
CASE WHEN to_review > 0 THEN to_review || ' operations need human review' END], lambda x: x IS NOT NULL), '; ') END AS advice FROM d""")
def ethics_advice(spark, sf):
    return ethics.ethics_advice(ethics.dashboard(_ops(spark, sf), _as_of()))


@query("""WITH m AS (SELECT user_id, count(*) AS n, sum(least(value / 100, 1)) AS c FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id)
SELECT count(*) AS users, coalesce(sum(n), 0)::BIGINT AS operations, round(coalesce(avg(n), 0), 6) AS mean_per_user, round(coalesce(sum(c) / sum(n), 0), 6) AS mean_confidence FROM m""")
def aggregated_report(spark, sf):
    ops = _ops(spark, sf)
    return ethics.aggregated_report(ops, ops.where("event_type = 'signup'"))


@query("SELECT user_id, greatest(0, least(100, 100 - CASE user_id % 4 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 0 ELSE 5 END + least(10, 2 * n)))::DOUBLE AS score FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id)")
def privacy_score(spark, sf):
    u = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    level = F.element_at(F.array(*map(F.lit, ("full", "minimal", "redacted", "full"))), (F.col("user_id") % 4 + 1).cast("int"))
    return u.select("user_id", ethics.privacy_score(level, F.col("user_id") % 3 == 0, F.col("n")).alias("score"))


_KIND = ("analytics", "personalization", "third_party", "research", "marketing")
_SQL_CONSENT = f"""c AS (SELECT user_id, {list(_KIND)}[CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1] AS consent_type, ts, event_id, event_type <> 'error' AS granted FROM events),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, consent_type ORDER BY ts DESC, event_id DESC) = 1)"""


def _consents(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _KIND)), (F.get_json_object("props", "$.k").cast("int") % 5 + 1))
    c = events(spark, sf).select("user_id", kind.alias("consent_type"), "ts", "event_id", (F.col("event_type") != "error").alias("granted"), F.concat_ws(".", F.lit("10.0.7"), F.col("user_id") % 256).alias("ip"), F.col("event_type").alias("agent"))
    return privacy.current_consents(privacy.consent_log(c), "event_id")


@query(f"WITH {_SQL_CONSENT} SELECT user_id, consent_type, CASE WHEN granted THEN 'granted' ELSE 'denied' END AS status, event_id, '10.0.7.0' AS ip FROM l")
def latest_consent(spark, sf):
    return _consents(spark, sf).select("user_id", "consent_type", "status", "event_id", "ip")


@query(f"WITH {_SQL_CONSENT} SELECT user_id, count(*) FILTER (WHERE granted) AS active FROM l GROUP BY user_id")
def active_consents(spark, sf):
    ok = privacy.active(F.col("status"), F.col("expires_at"), _as_of())
    return _consents(spark, sf).groupBy("user_id").agg(F.count_if(ok).alias("active"))


@query(f"""WITH {_SQL_CONSENT}, u AS (SELECT user_id, count(*) AS n, coalesce(bool_or(consent_type = 'analytics' AND granted), false) AS a, coalesce(bool_or(consent_type = 'personalization' AND granted), false) AS p, coalesce(bool_or(consent_type = 'third_party' AND granted), false) AS t FROM l GROUP BY user_id)
SELECT user_id, n AS n_consents, 'identifier; preferences' || CASE WHEN a THEN '; behavioral' ELSE '' END AS categories, 'accounts; documents; knowledge graph' || CASE WHEN p THEN '; recommendations' ELSE '' END || CASE WHEN a THEN '; usage analytics' ELSE '' END AS activities,
CASE WHEN t THEN 'storage providers; model providers' ELSE '' END AS recipients, 7 AS n_rights FROM u""")
def privacy_report(spark, sf):
    return privacy.privacy_report(_consents(spark, sf), _as_of())


@query(f"""SELECT event_id, CASE WHEN age >= d THEN 'delete' WHEN age >= a THEN 'anonymize' ELSE 'keep' END AS action FROM (SELECT event_id, date_diff('day', ts::DATE, DATE '2024-12-01') AS age, CASE event_type WHEN 'view' THEN 730 WHEN 'click' THEN 180 WHEN 'signup' THEN 730 ELSE 730 END AS d,
CASE event_type WHEN 'view' THEN 180 WHEN 'click' THEN 30 WHEN 'signup' THEN 365 ELSE 180 END AS a FROM events)""")
def retention_classify(spark, sf):
    category = F.when(F.col("event_type") == "view", "identifier").when(F.col("event_type") == "click", "behavioral").when(F.col("event_type") == "signup", "preferences").otherwise("other")
    age = F.datediff(F.lit("2024-12-01").cast("date"), F.col("ts").cast("date"))
    return events(spark, sf).select("event_id", privacy.retention_action(category, age).alias("action"))


@query("""SELECT c_custkey, CASE WHEN length(l) <= 2 THEN repeat('*', length(l)) ELSE l[1] || repeat('*', length(l) - 2) || l[-1] END || '@example.org' AS email, '10.' || c_nationkey || '.1.0' AS ip, substring(sha256(c_name || 's'), 1, 16) AS pseudonym
FROM (SELECT *, replace(lower(c_name), '#', '.') AS l FROM customer)""")
def mask_identifiers(spark, sf):
    c = read(spark, sf, "customer")
    email = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.org"))
    ip = F.concat_ws(".", F.lit("10"), "c_nationkey", F.lit("1"), F.col("c_custkey") % 256)
    return c.select("c_custkey", privacy.masked_email(email).alias("email"), privacy.anonymous_ip(ip).alias("ip"), privacy.pseudonym(F.col("c_name"), "s").alias("pseudonym"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def histogram_noise_free(spark, sf):
    return privacy.private_histogram(events(spark, sf), "event_type", None)


@query("SELECT round(avg(greatest(0, least(100, value))), 6) AS mean FROM events")
def mean_noise_free(spark, sf):
    return privacy.private_mean(events(spark, sf), "value", 0.0, 100.0, None).select(F.round("mean", 6).alias("mean"))


@query()
def dp_count_seeded(spark, sf):
    return privacy.private_count(events(spark, sf), 1.0, 7)


@query()
def dp_histogram_seeded(spark, sf):
    return privacy.private_histogram(events(spark, sf), "event_type", 1.0, 7)


@query()
def randomized_response(spark, sf):
    return events(spark, sf).select("event_id", privacy.randomized_response(F.col("event_type") == "error", 0.75, 11).alias("answer"))


@query("""SELECT axis, value, n FROM (SELECT 'total' AS axis, NULL AS value, count(*) AS n FROM conversations UNION ALL SELECT 'type', role, count(*) FROM conversations GROUP BY role UNION ALL SELECT 'user', CAST(conv_id % 7 AS VARCHAR), count(*) FROM conversations GROUP BY conv_id % 7
UNION ALL SELECT 'section', CAST(turn % 3 AS VARCHAR), count(*) FROM conversations WHERE turn % 3 > 0 GROUP BY turn % 3)""")
def annotation_stats_grouping_sets(spark, sf):
    n = read(spark, sf, "conversations").select("role", (F.col("conv_id") % 7).alias("user"), F.when(F.col("turn") % 3 > 0, F.col("turn") % 3).alias("section"))
    return ethics.annotation_stats(n, "role", "user", "section")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1 OR conv_id % 7 = 2")
def visible_annotations(spark, sf):
    n = read(spark, sf, "conversations").withColumns({"user": F.col("conv_id") % 7, "visibility": F.element_at(F.array(*map(F.lit, ("public", "private", "shared"))), (F.col("turn") % 3 + 1).cast("int"))})
    return ethics.visible(n, F.lit(2)).select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN a = b AND c = d THEN 0 WHEN a <= b AND c <= d THEN -1 WHEN a >= b AND c >= d THEN 1 ELSE 0 END AS cmp, greatest(a, b) AS top_a, greatest(c, d) AS top_b FROM (SELECT event_id, event_id % 3 AS a, user_id % 3 AS b, event_id % 2 AS c, user_id % 2 AS d FROM events)")
def vector_clock_compare(spark, sf):
    e = events(spark, sf)
    clock = lambda c: F.create_map(F.lit("a"), (F.col(c) % 3).cast("int"), F.lit("b"), (F.col(c) % 2).cast("int"))
    m = ethics.merge_clocks(clock("event_id"), clock("user_id"))
    return e.select("event_id", ethics.compare_clocks(clock("event_id"), clock("user_id")).alias("cmp"), m["a"].cast("long").alias("top_a"), m["b"].cast("long").alias("top_b"))


@query("SELECT conv_id::VARCHAR AS annotation_id, max_by(text, turn) FILTER (WHERE turn % 4 <> 3 OR turn = 0) AS content, coalesce(bool_or(turn % 4 = 3), false) AS deleted FROM conversations GROUP BY conv_id")
def crdt_merge(spark, sf):
    c = read(spark, sf, "conversations")
    op = F.when(F.col("turn") == 0, "insert").when(F.col("turn") % 4 == 3, "delete").otherwise("update")
    ops = c.select(F.col("conv_id").cast("string").alias("annotation_id"), F.col("turn").alias("seq"), op.alias("op"), F.col("text").alias("content"), F.create_map(F.lit("r"), (F.col("turn") + 1).cast("int")).alias("clock"))
    return ethics.merge_annotations(ops).select("annotation_id", "content", "deleted")


@query("SELECT conv_id % 11 AS annotation_id, role AS emoji, array_to_string(list_sort(list_distinct(list(conv_id % 13))), ',') AS users, count(DISTINCT conv_id % 13) AS n FROM conversations GROUP BY ALL")
def reaction_sets(spark, sf):
    c = read(spark, sf, "conversations").select((F.col("conv_id") % 11).alias("annotation_id"), F.col("role").alias("emoji"), (F.col("conv_id") % 13).alias("user"))
    return ethics.reactions(c).select("annotation_id", "emoji", F.array_join(F.transform("users", lambda x: x.cast("string")), ",").alias("users"), "n")


@query("SELECT doc_id, quality = 1 OR doc_id % 2 = 0 AS valid, CASE WHEN quality = 1 OR doc_id % 2 = 0 THEN 'content integrity verified' ELSE 'content has been modified' END AS message FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def provenance_verify(spark, sf):
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    now = docs.withColumn("text", F.when((F.col("quality") == 1) | (F.col("doc_id") % 2 == 0), F.col("text")).otherwise(F.concat("text", F.lit("x"))))
    return ethics.verify(ethics.credentials(docs, "loader"), now)


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'verified' WHEN quality <> 1 AND toxic <> 0 THEN 'unverified' ELSE 'pending' END AS status FROM labels")
def validation_status(spark, sf):
    return read(spark, sf, "labels").select("doc_id", ethics.validation_status(F.col("quality") == 1, F.col("toxic") == 0).alias("status"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS chain FROM conversations GROUP BY conv_id")
def provenance_chain(spark, sf):
    return ethics.chain(read(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("chain.role", ">").alias("chain"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}') AS manifest_hash FROM documents")
def manifest_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ethics.manifest_hash(F.struct("doc_id", "lang", "n_chars")).alias("manifest_hash"))


@query("SELECT event_id, event_type <> '' AND event_type IN ('Concept') OR regexp_matches(event_type, '^[A-Za-z][A-Za-z0-9_]*$') AS valid, regexp_matches(props, '^[A-Za-z][A-Za-z0-9_]*$') AS props_valid FROM events")
def identifier_check(spark, sf):
    return events(spark, sf).select("event_id", catalog.valid_identifier(F.col("event_type")).alias("valid"), catalog.valid_identifier(F.col("props")).alias("props_valid"))
