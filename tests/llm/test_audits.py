"""Source divergence, importance resampling and sharding against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import divergence, resampling, shards
from tests.llm.conftest import awkward_rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_divergence(rows, least, best=10):
    """rows: (text, lang, source)."""
    rows = [((t or "").translate(LOWER), lang or "", source or "") for t, lang, source in rows]
    terms = [(re.findall(divergence.TERM, t), lang, s) for t, lang, s in rows]
    df, n = Counter(), Counter()
    for ts, lang, s in terms:
        df.update({(lang, t) for t in ts})
        n.update((lang, s, t) for t in ts)
    out = []
    for lang in {lang for _, lang, _ in terms}:
        kept = sorted(t for (g, t), k in df.items() if g == lang and k >= least)
        sources = sorted({s for _, g, s in terms if g == lang})
        counts = {s: [n[lang, s, t] for t in kept] for s in sources}
        counts[None] = [sum(counts[s][i] for s in sources) for i in range(len(kept))]
        p = {s: [1 + 1_000_000_000 * (c + 2) // (sum(cs) + 2 * len(kept)) for c in cs] for s, cs in counts.items()}
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            own = [(f(x, y), t) for x, y, t, c in zip(p[s], p[None], kept, counts[s], strict=True) if c > 0 and x > y]
            for part, items, most in (("pair", pairs, None), ("term", own, best)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def test_divergence_is_brute_forces(spark, awkward, none_at_all):
    rnd = random.Random(4)
    rows = [(" ".join(rnd.choice("Aa b c É ö 12x x_y the The".split()) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice(["web", "book", None, "é"])) for _ in range(150)]
    rows += [(None, "fr", "web"), ("", "fr", "news"), ("lone words", "it", "web")] + rows[:20]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 3, 10):
        assert sorted(map(tuple, divergence.divergence(df, least, 10).collect())) == plain_divergence(rows, least)
    assert sorted(map(tuple, divergence.divergence(awkward, 2, 3).collect())) == plain_divergence([(t, lang, s) for _, t, lang, s, *_ in awkward_rows()], 2, 3)
    assert divergence.divergence(none_at_all).count() == 0


def test_divergence_shares_do_not_overflow(spark):
    df = spark.createDataFrame([(5_000_000_000_000, 9_000_000_000_000, 7)], "n long, total long, kept long")
    assert df.select(divergence._share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (5 * 10**12 + 2) // (9 * 10**12 + 14)


def test_run_crcs_are_the_strings(spark):
    rnd = random.Random(7)
    words = ["a", "straße", "日本", "x" * 63, "y" * 64, "z" * 65, "q" * 3000, "0"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(60)] + ["", "AbC--dEf", "é", " "]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    row, crc, lengths = resampling.words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    of, got = resampling.run_buckets(row, crc, lengths, 4, 1 << 32)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        want = sorted(zlib.crc32(" ".join(w[k : k + n]).encode()) for n in range(1, 5) for k in range(len(w) - n + 1))
        assert sorted(got[of == i].tolist()) == want
    assert resampling.shifted(np.array([zlib.crc32(b"ab")], np.uint32), np.array([0]))[0] == zlib.crc32(b"ab")


def plain_resampling(rows, target, longest, buckets, least, percent, seed):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    docs = [(i, *found(t)) for i, t in rows]
    s, t = Counter(b for *_, bs in docs for b in bs), Counter(b for x in target for b in found(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_t * 0 + n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for i, n, bs in docs:
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n >= least, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(bs), weight))
    order = sorted(out, key=lambda x: (not x[0], -x[1], (0, 0) if x[2] is None else (1, x[2]), -x[4]))
    drawn = percent * sum(x[0] for x in out) // 100
    return Counter((i, n, w, score, k + 1 if k < drawn else None) for k, (_, score, i, n, w) in enumerate(order))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_brute_forces(spark, awkward, none_at_all, longest):
    rnd = random.Random(8)
    target = spark.createDataFrame([(None,), ("the quick Fox jumps over the lazy dog",), ("",)], "text string")
    texts = [t for (t,) in target.collect()]
    rows = [(i, " ".join(rnd.choice("the quick fox jumps a b c d e f".split()) for _ in range(rnd.randint(0, 60)))) for i in range(200)] + [(7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.importance_resample(df, target, longest, 100, 20, 30, 5).collect()
    assert Counter(map(tuple, got)) == plain_resampling(rows, texts, longest, 100, 20, 30, 5)
    odd = resampling.importance_resample(awkward, target, longest, 100_000, 2, 50).collect()
    assert Counter(map(tuple, odd)) == plain_resampling([r[:2] for r in awkward_rows()], texts, longest, 100_000, 2, 50, 2024)
    assert resampling.importance_resample(none_at_all, target).count() == 0
    assert len(resampling.importance_resample(df, none_at_all).collect()) == len(rows)


def test_long_texts_are_chunks_of_their_own(spark, monkeypatch):
    rows = [(i, "one two three " * k) for i, k in enumerate((0, 400, 1, 0, 900, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    import pyarrow as pa

    monkeypatch.setattr(resampling, "CHUNK_BYTES", 1000)
    out = list(resampling._featured(iter([pa.RecordBatch.from_pandas(df.toPandas())]), 2, 100))
    assert len(out) > 2 and [(r["id"], r["n_words"]) for b in out for r in b.to_pylist()] == [(i, len(t.split())) for i, t in rows]


def shard_rows(df, **how):
    return [r.asDict() for r in shards.shard_table(df, **how).collect()]


def held(rows, texts, n):
    """Groups whole, slots gapless, sizes and checksums right."""
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert all([r["doc_id"] is not None for r in sorted(v, key=lambda r: r["slot"])] == sorted(r["doc_id"] is not None for r in v) for v in by.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    of = defaultdict(set)
    for r in rows:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    return [sum(r["size"] for r in by[s]) for s in range(n)]


def test_shards_are_equal_in_bytes_and_keep_copies_together(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 400)))) for i in range(3000)]
    texts += [(5000 + i, "copied text " * 20) for i in range(100)] + [(6000 + i, "") for i in range(1500)] + [(7000 + i, None) for i in range(500)]
    df = spark.createDataFrame([(i, t, rnd.choice("abc"), f"s{rnd.randint(0, 9)}") for i, t in texts], "doc_id long, text string, lang string, source string")
    for n in (1, 2, 7, 16):
        sizes = held(shard_rows(df, shards=n), texts, n)
        assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / n + 400
    many = held(shard_rows(df, target_bytes=60_000), texts, math.ceil(sum(sizes) / 60_000))
    assert max(many) < 60_000 * 1.03 and max(many) - min(many) < 0.03 * 60_000 + 400


def test_a_text_that_outweighs_shards_has_its_own(spark):
    texts = [(i, "heavy " * 100) for i in range(50)] + [(100 + i, f"light {i:03}") for i in range(900)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, lang string, source string")
    sizes = held(shard_rows(df, shards=8), texts, 8)
    assert sorted(sizes)[-1] == 50 * 601 and max(sorted(sizes)[:-1]) - min(sizes) < 40


def test_trees_are_cut_along_the_widest_dimension(spark):
    """Two sources far apart and ids near together: the first cut parts the sources."""
    docs = spark.createDataFrame([(1, f"text {i}", "en", "left" if i % 2 else "right") for i in range(400)], "doc_id long, text string, lang string, source string")
    of = defaultdict(set)
    for r in shards.sharded(docs, shards=2).collect():
        of[r.source].add(r.shard)
    spread = {s: len(v) for s, v in of.items()}
    assert sorted(spread.values())[0] == 1


def test_awkward_and_empty_tables_are_sharded(spark, awkward, none_at_all):
    texts = [r[:2] for r in awkward_rows()]
    held(shard_rows(awkward, shards=4), texts, 4)
    assert shards.shard_table(none_at_all, shards=16).count() == 0 and shards.sharded(none_at_all, target_bytes=10).count() == 0
    full = shards.sharded(awkward.withColumn("_key", F.lit(1)).withColumn("shard", F.lit("old")), shards=3, dimensions=("lang", "row", "source"))
    assert sorted(full.columns) == sorted({*awkward.columns, "_key", "shard"}) and full.count() == len(texts) and dict(full.dtypes)["shard"] == "int"
    with pytest.raises(ValueError):
        shards.shard_table(awkward)


def test_weighted_medians_against_sorting(spark):
    rnd = random.Random(6)
    rows = [(rnd.getrandbits(63), rnd.randint(1, 50), 1, [rnd.choice([3, 700, 4000]), rnd.randint(0, 4095)]) for _ in range(2000)]
    g = spark.createDataFrame(rows, "key long, w long, n long, dims array<int>")
    total = sum(r[1] for r in rows)
    for dim, share in itertools.product((0, 1), (0.1, 0.5, 0.9)):
        cut = shards._medians(g.withColumn("node", F.lit(0).cast("long")), {0: (dim, total * share)}, 0)[0]
        below = sum(w for key, w, _, dims in rows if (dims[dim] << 48) + (key & ((1 << 48) - 1)) < cut)
        assert abs(below - total * share) <= 25
