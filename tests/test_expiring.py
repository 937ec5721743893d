"""Streams whose state expires, and how good extractions are, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evaluation, extraction
from marginalia.streaming import expiring

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, make, batches=4):
    """(rows out, rows of state after each batch) of a stream that gets the rows in so many files, in the order of their times."""
    df = spark.createDataFrame(rows, schema)
    for i in range(batches):
        part = sorted(rows, key=lambda r: r[1])[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect(), sizes


def limited(times, limit, seconds, block):
    recent, until, out = [], 0.0, []
    for t in times:
        recent = [x for x in recent if x > t - seconds]
        ok = t >= until and len(recent) < limit
        if ok:
            recent.append(t)
        elif t >= until:
            until = t + block
        out.append(ok)
    return out


def test_limits_hold_and_state_leaves(spark, tmp_path):
    rnd = random.Random(1)
    at = {c: sorted(rnd.sample(range(600), 12)) for c in "abcdef"} | {"z": [36_000, 36_001, 36_002, 72_000]}
    rows = [(c, START + dt.timedelta(seconds=s)) for c, ss in at.items() for s in ss]
    got, sizes = run(spark, tmp_path, rows, "client string, ts timestamp", lambda s: expiring.rate_limited(s, 3, 60, 120, "1 second"))
    want = {(c, s): ok for c, ss in at.items() for s, ok in zip(ss, limited(ss, 3, 60, 120), strict=True)}
    assert {(r.client, int((r.ts - START).total_seconds())): r.allowed for r in got} == want
    assert not all(want.values()) and sizes[-1] < max(sizes)


def test_uploads_take_their_steps_or_time_out(spark, tmp_path):
    t = lambda s: START + dt.timedelta(seconds=s)
    rows = [
        ("good", t(0), "pending"), ("good", t(5), "processing"), ("good", t(9), "validated"), ("good", t(12), "processing"),
        ("odd", t(1), "processing"), ("odd", t(2), "pending"), ("odd", t(3), "validated"), ("odd", t(4), "failed"), ("odd", t(6), "pending"),
        ("slow", t(2), "pending"), ("slow", t(7), "processing"), ("slow", t(300), "validated"), ("lost", t(3), "pending"), ("lost", t(8), "processing"), ("late", t(1000), "pending"),
    ]
    got, sizes = run(spark, tmp_path, rows, "doc_id string, ts timestamp, status string", lambda s: expiring.upload_states(s, 60, "1 second"), 3)
    out = {d: sorted((int((r.ts - START).total_seconds()), r.status, r.accepted, r.reason) for r in got if r.doc_id == d) for d in {r[0] for r in rows}}
    assert out["good"] == [(0, "pending", True, None), (5, "processing", True, None), (9, "validated", True, None), (12, "processing", False, "validated to processing")]
    assert out["odd"] == [(1, "processing", False, "nothing to processing"), (2, "pending", True, None), (3, "validated", False, "pending to validated"), (4, "failed", True, None), (6, "pending", False, "failed to pending")]
    assert (67, "failed", True, "timeout") in out["slow"] and [x[2] for x in out["slow"] if x[0] == 300] == [False]
    assert out["lost"] == [(3, "pending", True, None), (8, "processing", True, None), (68, "failed", True, "timeout")]
    assert sizes[-1] < max(sizes)


def test_known_types(spark):
    df = spark.createDataFrame([("application/pdf",), ("Application/EPUB+zip",), ("text/plain",), (None,)], "t string")
    assert [r[0] for r in df.select(expiring.known_type(F.col("t"))).collect()] == [".pdf", ".epub", None, None]


def test_evaluation_with_half_credit(spark):
    found = spark.createDataFrame([(1, "A", "b", "USES"), (1, "c", "d", "RELATED_TO"), (2, "x", "y", "CITES")], "doc_id int, source string, target string, type string")
    want = spark.createDataFrame([(1, "a", "B", "USES"), (1, "a", "b", "CITES"), (1, "d", "c", "CITES"), (1, "q", "r", "USES"), (3, "q", "r", "USES")], "doc_id int, source string, target string, type string")
    met, shares = evaluation.lenient(found, want)
    assert sorted((r.doc_id, r.source, r.type, r.met) for r in met.collect()) == [(1, "a", "CITES", "partial"), (1, "a", "USES", "exact"), (1, "d", "CITES", "reversed"), (1, "q", "USES", "missed"), (3, "q", "USES", "missed")]
    assert {r.doc_id: (r.recall, r.precision) for r in shares.collect()} == {1: (0.75, 0.5), 2: (0.0, 1.0), 3: (0.0, 0.0)}
    typed = spark.createDataFrame([(1, "PERSON", "TECHNOLOGY", "ENABLES"), (1, "PERSON", "TECHNOLOGY", "USES"), (1, "X", "Y", "RELATED_TO"), (1, "X", "Y", "USES")], "doc_id int, source_type string, target_type string, type string")
    c = evaluation.coherence(typed).first()
    assert (c.relations, c.meaningful, c.ratio) == (4, 2.2, 0.55)
    nodes = spark.createDataFrame([(1, 1, "Big Lab", "ORGANIZATION"), (1, 2, "lab rat", "CONCEPT")], "doc_id int, ord int, label string, type string")
    q = evaluation.graph_quality(nodes, typed, ["LAB", "zoo"], [("lab", "ORGANIZATION"), ("rat", "PERSON")]).first()
    assert (q.covered, q.accuracy, q.ratio) == (0.5, 0.5, 0.55) and q.overall == pytest.approx(0.515)
    valid = spark.createDataFrame([("X", "Y", "USES")], "source_type string, target_type string, type string")
    assert evaluation.type_coherence(typed.withColumn("rank", F.monotonically_increasing_id()), valid).first().precision == 0.5


def test_uploads_share_buckets(spark, tmp_path):
    """Many uploads of few buckets, over several batches: each has its own states and deadline, and no bucket costs a timer an upload."""
    t = lambda s: START + dt.timedelta(seconds=s)
    rows = [r for i in range(60) for r in [(f"u{i}", t(10 * i), "pending"), (f"u{i}", t(10 * i + 2), "processing"), *([(f"u{i}", t(10 * i + 5), "validated")] if i % 3 else [])]]
    rows.append(("last", t(5000), "pending"))
    got, sizes = run(spark, tmp_path, rows, "doc_id string, ts timestamp, status string", lambda s: expiring.upload_states(s, 60, "1 second", 3))
    want = [(d, int((at - START).total_seconds()), s, True, None) for d, at, s in rows] + [(f"u{i}", 10 * i + 62, "failed", True, "timeout") for i in range(0, 60, 3)]
    assert sorted((r.doc_id, int((r.ts - START).total_seconds()), r.status, r.accepted, r.reason or "") for r in got) == sorted((*w[:4], w[4] or "") for w in want)
    assert max(sizes) <= 4 * 3


def test_null_names_meet_nothing(spark):
    found = spark.createDataFrame([(1, None, "b", "USES"), (1, "b", "b", "USES"), (1, "x", "y", None)], "doc_id int, source string, target string, type string")
    want = spark.createDataFrame([(1, None, "b", "USES"), (1, "x", "y", None), (1, "y", "x", "USES")], "doc_id int, source string, target string, type string")
    met = evaluation.lenient(found, want)[0]
    assert {(r.source, r.target): r.met for r in met.collect()} == {(None, "b"): "missed", ("x", "y"): "partial", ("y", "x"): "reversed"}


def test_pairs_carry_types_without_a_join(spark):
    docs = spark.createDataFrame([(1, "Alpha met Beta. Gamma met nobody.")], "doc_id int, text string")
    names = spark.createDataFrame([(1, 1, "Alpha", "PERSON"), (1, 2, "Beta", "METHOD")], "doc_id int, ord int, text string, type string")
    p = extraction.pairs_in_sentence(extraction.sentence_hits(docs, names))
    assert [(r.source, r.source_type, r.target, r.target_type) for r in p.collect()] == [("Alpha", "PERSON", "Beta", "METHOD")]
