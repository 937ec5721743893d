"""Operation logs, dashboards and reports; provenance of documents; merging of collaborative annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_window(ops: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    return ops.where((F.col(ts) > as_of - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= as_of))


def operations_by_day(ops: DataFrame, *key: str, ts: str = "ts") -> DataFrame:
    return ops.groupBy(*key, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def operations_by_type(ops: DataFrame, *key: str, kind: str = "event_type") -> DataFrame:
    """Counts and percentages of each type inside its key (over all without one)."""
    n = ops.groupBy(*key, kind).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key)) if key else None
    if key:
        return n.withColumn("percent", F.round(100 * F.col("n") / total, 6))
    whole = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(whole)).withColumn("percent", F.round(100 * F.col("n") / F.col("total"), 6)).drop("total")  # one row


def recent(ops: DataFrame, k: int, *key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest ``k`` rows of each key, with their place."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts), F.desc(tie))
    return ops.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def privacy_score(level: Column, aggregated: Column, actions: Column) -> Column:
    """100 less 10 (minimal) or 20 (redacted), plus 5 without aggregated analytics and up to 10 for actions; in [0, 100]."""
    cut = F.when(level == "minimal", 10).when(level == "redacted", 20).otherwise(0)
    s = 100.0 - cut + F.when(aggregated, 0).otherwise(5) + F.least(F.lit(10), F.greatest(F.lit(0), actions) * 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s))


def dashboard(ops: DataFrame, as_of: Column, days: int = 30, user: str = "user_id") -> DataFrame:
    """Operations, low confidence and needed reviews of each user in the window. ops: confidence, needs_review."""
    return in_window(ops, as_of, days).groupBy(user).agg(
        F.count("*").alias("operations"), F.count_distinct("event_type").alias("types"), F.count_if(F.col("confidence") < 0.7).alias("low_confidence"),
        F.count_if(F.col("needs_review")).alias("to_review"), F.max("ts").alias("last_operation"),
    )


def ethics_advice(dash: DataFrame, user: str = "user_id") -> DataFrame:
    tips = F.array_compact(F.array(
        F.when(F.col("low_confidence") > 0, F.concat(F.lit("Review "), F.col("low_confidence"), F.lit(" operations of low confidence"))),
        F.when(F.col("to_review") > 0, F.concat(F.col("to_review"), F.lit(" operations need human review"))),
    ))
    return dash.select(user, F.when(F.size(tips) > 0, F.array_join(tips, "; ")).otherwise("No action needed").alias("advice"))


def aggregated_report(ops: DataFrame, consenting: DataFrame, user: str = "user_id") -> DataFrame:
    """Totals, mean per user and mean confidence over the users that agree."""
    mine = ops.join(consenting.select(user).distinct(), user, "left_semi")
    per_user = mine.groupBy(user).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    return per_user.agg(
        F.count("*").alias("users"), F.coalesce(F.sum("n"), F.lit(0)).alias("operations"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean_per_user"),
        F.round(F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)), 6).alias("mean_confidence"),
    )


def requests_in_last(events: DataFrame, seconds: int, limit: int, client: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests of each client in the seconds up to each event, and whether the limit is reached."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(client).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("_us", micros).withColumn("in_window", F.count("*").over(w)).withColumn("blocked", F.col("in_window") >= limit).drop("_us")


def annotation_stats(notes: DataFrame, kind: str, user: str, section: str) -> DataFrame:
    """Counts in all, by type, by user and by section in one pass (grouping sets); null sections are left out."""
    g = notes.groupingSets([[], [kind], [user], [section]], kind, user, section).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    axis = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "type").when(F.col("gid") == 5, "user").otherwise("section")
    value = F.coalesce(F.col(kind).cast("string"), F.col(user).cast("string"), F.col(section).cast("string"))
    return g.select(axis.alias("axis"), value.alias("value"), "n").where((F.col("axis") == "total") | F.col("value").isNotNull())


def visible(notes: DataFrame, viewer: Column | str, owner: str = "user", visibility: str = "visibility") -> DataFrame:
    """Everything but others' private notes."""
    return notes.where((F.col(visibility) != "private") | (F.col(owner) == viewer))


def thread(notes: DataFrame, parent: Column, viewer: Column | str, parent_col: str = "parent_id", owner: str = "user", visibility: str = "visibility") -> DataFrame:
    """Replies to a note that the viewer may see."""
    return visible(notes.where(F.col(parent_col) == parent), viewer, owner, visibility)


# Logs and profiles


def appended(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A log (of operations, metrics or assertions) with new rows; a row that comes again is taken once."""
    return log.unionByName(new.join(log.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def profiles(users: DataFrame, preferences: DataFrame, ops: DataFrame, alerts: Column, actions: Column, user: str = "user_id") -> DataFrame:
    """Each user's preferences (full logging, analytics and explanations unless said otherwise) and counters over the log.

    alerts, actions: which rows of the log are alerts and privacy actions.
    """
    n = ops.groupBy(user).agg(F.count("*").alias("operations"), F.count_if(alerts).alias("alerts"), F.count_if(actions).alias("privacy_actions"))
    p = users.select(user).distinct().join(preferences, user, "left").join(n, user, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.select(
        user, F.coalesce("transparency", F.lit("full")).alias("transparency"), F.coalesce("analytics", F.lit(True)).alias("analytics"),
        F.coalesce("explanations", F.lit(True)).alias("explanations"), zero("operations"), zero("alerts"), zero("privacy_actions"),
    )


# Provenance


def credentials(docs: DataFrame, actor: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    h = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return docs.select(id_col, F.concat(F.lit("cred_"), F.substring(F.sha2(F.concat(F.col(id_col).cast("string"), h), 256), 1, 12)).alias("credential_id"), h.alias("content_hash"), F.lit(actor).alias("actor"), F.lit("created").alias("action"))


def verify(creds: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whether each credential's content is still what was signed."""
    now = docs.select(id_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("now_hash"))
    ok = F.coalesce(F.col("content_hash") == F.col("now_hash"), F.lit(False))
    message = F.when(F.col("now_hash").isNull(), "no document").when(ok, "content integrity verified").otherwise("content has been modified")
    return creds.join(now, id_col, "left").select(id_col, ok.alias("valid"), message.alias("message"))


def validation_status(doi_ok: Column, license_ok: Column) -> Column:
    return F.when(doi_ok & license_ok, "verified").when(~doi_ok & ~license_ok, "unverified").otherwise("pending")


def chain(assertions: DataFrame, key: str, ts: str, *fields: str) -> DataFrame:
    """Assertions of each document in order of time."""
    return assertions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ts, *fields))).alias("chain"))


def manifest_hash(record: Column) -> Column:
    """Hash of a struct's JSON; the struct's fields decide the canonical order."""
    return F.sha2(F.to_json(record), 256)


def manifest_json(record: Column) -> Column:
    """A manifest for export: the struct's JSON with its hash beside it."""
    return F.to_json(F.struct(record.alias("manifest"), manifest_hash(record).alias("sha256")))


# Vector clocks and annotations


def merge_clocks(a: Column, b: Column) -> Column:
    """The larger count of each replica."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_clocks(a: Column, b: Column) -> Column:
    """-1 before, 1 after, 0 equal or concurrent."""
    diff = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(diff, lambda d: d < 0), F.exists(diff, lambda d: d > 0)
    return F.when(less & ~more, -1).when(more & ~less, 1).otherwise(0)


def merge_annotations(ops: DataFrame, key: str = "annotation_id", order: str = "seq") -> DataFrame:
    """Each annotation after its operations in order: inserts once, updates unless older, deletes always.

    ops: key, order, op (insert, update, delete), content, clock (map of replica to count).
    """
    log = F.array_sort(F.collect_list(F.struct(F.col(order).alias("seq"), "op", "content", F.map_entries("clock").alias("clock"))))
    init = F.struct(F.lit(False).alias("there"), F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("content"), F.array().cast("array<struct<key:string,value:int>>").alias("clock"))

    def step(s, o):
        newer = compare_clocks(F.map_from_entries(o["clock"]), F.map_from_entries(s["clock"])) >= 0
        insert, update, delete = (o["op"] == "insert") & ~s["there"], (o["op"] == "update") & s["there"] & newer, (o["op"] == "delete") & s["there"]
        return F.struct(
            (s["there"] | insert).alias("there"), (s["deleted"] | delete).alias("deleted"),
            F.when(insert | (update & o["content"].isNotNull()), o["content"]).otherwise(s["content"]).alias("content"),
            F.when(insert | update | delete, o["clock"]).otherwise(s["clock"]).alias("clock"),
        )

    return ops.groupBy(key).agg(log.alias("log")).select(key, F.aggregate("log", init, step).alias("s")).where("s.there").select(key, "s.content", "s.deleted", F.map_from_entries("s.clock").alias("clock"))


def reactions(events: DataFrame, key: str = "annotation_id") -> DataFrame:
    """Users of each reaction on an annotation."""
    return events.groupBy(key, "emoji").agg(F.array_sort(F.collect_set("user")).alias("users"), F.count_distinct("user").alias("n"))


def updated_profiles(profiles: DataFrame, changes: DataFrame, user: str = "user_id", seq: str = "seq") -> DataFrame:
    """Profiles with, for each field, the newest change that isn't null; users without a profile get one from their changes."""
    fields = [c for c in profiles.columns if c != user]
    newest = changes.groupBy(user).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in fields if c in changes.columns))
    j = profiles.join(newest, user, "full")
    return j.select(user, *(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields))


def metric_summary(metrics: DataFrame, user: str = "user_id", name: str = "metric", value: str = "value", ts: str = "ts", tie: str = "metric_id") -> DataFrame:
    """(user, metric, n, mean, newest): recorded metrics by name; nulls are no values."""
    return metrics.where(F.col(value).isNotNull()).groupBy(user, name).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max_by(value, F.struct(ts, tie)).alias("newest"))
