"""Queries over logs, profiles, threads, erasure, comparisons, exports and further relation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import credibility, ethics, exports, extraction, privacy, vectors
from marginalia.plans import learning, tables, text
from marginalia.plans.base import events, query, read


@query("SELECT conv_id, turn FROM conversations WHERE turn = 2 AND (turn % 3 <> 1 OR conv_id % 7 = 2)")
def annotation_thread(spark, sf):
    n = read(spark, sf, "conversations").withColumns({
        "user": F.col("conv_id") % 7, "visibility": F.element_at(F.array(*map(F.lit, ("public", "private", "shared"))), (F.col("turn") % 3 + 1).cast("int")),
        "parent_id": F.col("turn") - 1,
    })
    return ethics.thread(n, F.lit(1), F.lit(2)).select("conv_id", "turn")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY event_type")
def record_operations(spark, sf):
    e = events(spark, sf)
    log = ethics.appended(e.where("event_id % 3 > 0"), e.where("event_id % 3 < 2"), "event_id")  # a third comes again
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""WITH n AS (SELECT user_id, count(*) AS operations, count(*) FILTER (event_type = 'error') AS alerts, count(*) FILTER (event_type = 'signup') AS privacy_actions FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'minimal' ELSE 'full' END AS transparency, c_custkey % 4 <> 0 AS analytics, true AS explanations, coalesce(operations, 0) AS operations,
coalesce(alerts, 0) AS alerts, coalesce(privacy_actions, 0) AS privacy_actions FROM customer LEFT JOIN n ON user_id = c_custkey""")
def ethics_profiles(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    preferences = users.where("user_id % 4 = 0").withColumns({"transparency": F.lit("minimal"), "analytics": F.lit(False), "explanations": F.lit(None).cast("boolean")})
    ops = events(spark, sf).withColumn("user_id", F.col("user_id").cast("long"))
    return ethics.profiles(users, preferences, ops, F.col("event_type") == "error", F.col("event_type") == "signup")


@query("""SELECT doc_id, '{"manifest":{"doc_id":' || doc_id || ',"lang":"' || lang || '"},"sha256":"' || sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') || '"}' AS manifest FROM documents""")
def manifest_export(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ethics.manifest_json(F.struct("doc_id", "lang")).alias("manifest"))


@query("""WITH a AS (SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'reviewed' FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS chain FROM a GROUP BY conv_id""")
def provenance_assertion(spark, sf):
    log = read(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("assertion_id", F.concat_ws("-", "conv_id", "turn"))
    new = log.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("reviewed").alias("role"), F.concat_ws("-", "conv_id", "turn").alias("assertion_id"))
    whole = ethics.appended(log, new.unionByName(log), "assertion_id")
    return ethics.chain(whole, "conv_id", "turn", "role").select("conv_id", F.array_join("chain.role", ">").alias("chain"))


@query("""SELECT 'events' AS store, count(*) AS n FROM events WHERE user_id % 5 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 5 <> 0""")
def user_erasure(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).union(events(spark, sf).select("user_id")).where("user_id % 5 = 0")
    names = (("events", "user_id"), ("orders", "o_custkey"), ("customer", "c_custkey"))
    left = privacy.erased(users, *((read(spark, sf, n), k) for n, k in names))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("store"), "n") for (n, _), df in zip(names, left, strict=True)]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {tables._SQL_CRED} SELECT id AS paper_id, overall, row_number() OVER (ORDER BY overall DESC, id) <= 10 AS among_ten FROM o ORDER BY overall DESC, id LIMIT 25")
def papers_compared(spark, sf):
    top = credibility.compared(tables.credibility_score(spark, sf)).limit(25)
    tenth = [r.paper_id for r in top.limit(10).collect()]  # ten ids
    return top.select("paper_id", "overall", F.col("paper_id").isin(*tenth).alias("among_ten"))


@query(f"""{learning._SQL_STATES} SELECT card_id, '{{"' || card_id || '":{{"interval":' || least(interval, 3650) || ',"repetitions":' || repetitions || ',"reviews":' || reviews || '}}}}' AS entry FROM cards""")
def scheduler_export(spark, sf):
    return exports.scheduler_json(learning.sm2_fold(spark, sf).select("card_id", "interval", "repetitions", "reviews"))


@query(f"""WITH {text._SQL_PAIRS} SELECT a.doc_id, a.text AS source, b.text AS target, count(*) AS n, 0.3::DOUBLE AS confidence FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.sent_id = a.sent_id + 1
WHERE lower(a.text) <> lower(b.text) GROUP BY ALL""")
def adjacent_pairs(spark, sf):
    docs = read(spark, sf, "documents")
    hits = extraction.in_sentence(extraction.sentence_rows(docs), extraction.capitalised_entities(docs, None))
    return extraction.adjacent_pairs(hits).groupBy("doc_id", "source", "target").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


_LADDER = " ".join("WHEN ({}){} THEN '{}'".format(" OR ".join(f"contains(lower(sentence), '{w}')" for w in ws), " AND st IN ('PERSON', 'ORGANIZATION')" if r == "ENABLES" else "", r) for ws, r in extraction.CONTEXT_LADDER)


@query(f"""WITH {text._SQL_TYPED}, l AS (SELECT doc_id, CASE {_LADDER} WHEN st = 'METHOD' AND tt = 'TECHNOLOGY' THEN 'PART_OF' WHEN st = 'TECHNOLOGY' AND tt = 'CONCEPT' THEN 'ENABLES' ELSE 'RELATED_TO' END AS type,
least(0.95, 0.6 + CASE WHEN gap < 50 THEN 0.1 WHEN gap < 100 THEN 0.05 ELSE 0 END) * 0.8 AS c FROM tp) SELECT doc_id, type, count(*) AS n, round(sum(c), 6)::DOUBLE AS confidence FROM l GROUP BY ALL""")
def context_relations(spark, sf):
    r = extraction.context_relations(text._typed(spark, sf))
    return r.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"""WITH {text._SQL_TYPED} SELECT doc_id, lower(source) AS source, lower(target) AS target, type, round(least(0.99, arg_min(confidence, sent_id * 1000000 + instr(lower(source), 'a')) + 0.1 * (count(*) - 1)), 6)::DOUBLE AS confidence, count(*) AS repeats
FROM (SELECT doc_id, sent_id, lower(source) AS source, lower(target) AS target, type, min(confidence) AS confidence FROM co GROUP BY ALL) GROUP BY ALL""")
def merged_relations(spark, sf):
    r = extraction.typed_cooccurrence(text._typed(spark, sf))
    once = r.groupBy("doc_id", "sent_id", F.lower("source").alias("source"), F.lower("target").alias("target"), "type").agg(F.min("confidence").alias("confidence"))
    return extraction.merged_relations(once, "sent_id").withColumn("confidence", F.round("confidence", 6))


@query("""SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS least_length, max(len(embedding)) AS most_length FROM embeddings WHERE NOT coalesce(label = 1, false)""")
def vector_store(spark, sf):
    rows = read(spark, sf, "embeddings")
    store = vectors.Store(rows.where("vec_id % 2 = 0")).add(rows).delete(F.col("label") == 1)
    return store.health().select("vectors", "ids", F.col("least_length").cast("long").alias("least_length"), F.col("most_length").cast("long").alias("most_length"))
