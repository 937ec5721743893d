"""Near-duplicates, WARC, neighbours, packing, mixing and toxicity against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import ann, mixing, neardup, packing, toxicity, warc
from marginalia.llm.common import file_system
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, percent=80, words=4):
    """Smallest id of each row's group, row by row; equal rows apart."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(rows))], [len(s) for s in sets]


def variants(n, seed=3):
    """Families of copies with growing edits, whose links form chains."""
    rnd = random.Random(seed)
    out = []
    for f in range(6):
        w = [f"w{rnd.randrange(3000)}" for _ in range(150)]
        for _ in range(n):
            v = list(w)
            for _ in range(rnd.randrange(14)):
                v[rnd.randrange(len(v))] = f"x{rnd.randrange(10**6)}"
            out.append((len(out), " ".join(v)))
            if rnd.random() < 0.3:
                w = v
    return out


@pytest.mark.parametrize(("rows", "percent"), [([(i, t) for i, t, *_ in awkward_rows()], 80), (variants(25), 80), (variants(25), 60), (variants(25), 90)], ids=["awkward", "families", "at 60", "at 90"])
def test_near_duplicates(spark, rows, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 6)  # families of many blocks
    want, sizes = groups(rows, percent)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, key int").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in neardup.near_duplicates(df, words=4, percent=percent).collect())
    assert got == sorted((i is None, i or 0, n, -1 if c is None else c, i is None or i == c) for (i, _), n, c in zip(rows, sizes, want, strict=True))


@pytest.mark.parametrize("few", [True, False])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, few):
    rnd = random.Random(8)
    edges = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(1500)] + [(i, i + 1) for i in range(5000, 5400)] + [(9, 9)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for x, y in edges:
        if x != y:
            p, q = find(x), find(y)
            top[max(p, q)] = min(p, q)
    rounds, by_rounds = [], getattr(neardup, "_by_rounds", None)
    if not few:
        monkeypatch.setattr(neardup, "SENT_ROWS", 50)
    monkeypatch.setattr(neardup, "_by_rounds", lambda e: rounds.append(1) or by_rounds(e))
    got = neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in top)
    assert bool(rounds) is not few


def test_intersections_of_blocks_join_components():
    rnd = random.Random(8)
    sets = [np.array(sorted(rnd.sample(range(40), rnd.randint(1, 40))), np.uint64) for _ in range(60)]
    side, root = np.array([rnd.randrange(2) for _ in sets]), np.array([rnd.randrange(20) for _ in sets])

    def parts(links):
        top = dict(zip(range(20), range(20), strict=True))
        for a, b in links:
            x, y = top[root[a]], top[root[b]]
            top = {k: x if v == y else v for k, v in top.items()}
        return sorted(map(sorted, ({k for k in top if top[k] == v} for v in set(top.values()))))

    pairs = [(a, b) for a in range(60) for b in range(60) if side[a] < side[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))]
    got = neardup.joining(sets, side, root, 50)
    assert set(got) <= set(pairs) and parts(got) == parts(pairs) and len(got) < 20 < len(pairs)


def test_near_duplicates_take_one_python_worker_a_task(spark, monkeypatch):
    chains, stored = [], neardup.stored

    def spied(df, tag):
        at = 0  # Python steps since the last exchange or scan, going down the plan
        for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
            at = 0 if re.search(r"Exchange|Scan", line) else at + bool(re.search(r"MapInArrow|ArrowEvalPython", line))
            chains.append(at)
        return stored(df, tag)

    monkeypatch.setattr(neardup, "stored", spied)
    df = spark.createDataFrame(variants(25), "doc_id long, text string").repartition(3)
    assert len({r.component_id for r in neardup.near_duplicates(df, words=4).collect()}) == len(set(groups(variants(25))[0]))
    assert max(chains) == 1


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    key, seen, stored = "spark.sql.execution.arrow.maxBytesPerBatch", {}, neardup.stored
    before, sizes = spark.conf.get(key), lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs)

    def spied(df, tag):
        if tag == "neardup-sets":
            seen[tag] = [r.n for r in big.mapInArrow(sizes, "n long").collect()]
        return stored(df, tag)

    big = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))  # 24 MB
    assert max(r.n for r in big.mapInArrow(sizes, "n long").collect()) > 20e6
    monkeypatch.setattr(neardup, "stored", spied)
    neardup.near_duplicates(spark.createDataFrame(variants(2), "doc_id long, text string"))
    assert max(seen["neardup-sets"]) < 5e6 and spark.conf.get(key) == before


def test_deduplicated_keeps_one_row_of_each_group(spark):
    rows = [(i, t) for i, t, *_ in awkward_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in neardup.deduplicated(df, words=4).collect()]
    want, _ = groups(rows)
    assert len(kept) == len(set(zip(want, [i if c == i or i is None else c for (i, _), c in zip(rows, want, strict=True)], strict=True)))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_keys_find_every_pair_within_the_distance():
    g = np.random.default_rng(1)
    a = g.integers(0, 256, (300, 2 * neardup.KEYED + neardup.MORE), dtype=np.uint8)
    b = a.copy()
    s = b[:, : 2 * neardup.KEYED].view("<u2")
    lay = neardup.Layout(80)
    for row in range(len(b)):
        for j in g.choice(neardup.KEYED, 2 * lay.chunks - 1, replace=False):
            s[row, j] ^= 1
    assert all(set(x) & set(y) for x, y in zip(lay.keys(a), lay.keys(b), strict=True))
    assert (neardup.distances(a, b) == 2 * lay.chunks - 1).all()
    for percent in range(50, 101, 5):
        lay, j = neardup.Layout(percent), percent / 100
        assert (1 - j**lay.length - lay.length * j ** (lay.length - 1) * (1 - j)) ** lay.chunks <= 5e-5
    with pytest.raises(ValueError, match="percent"):
        neardup.Layout(30)


def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/ b%é", big), (5, None, big), (3, "u", big), (3, "u", big), (2, "u", "tiny"), (4, "u", "tiny"), (6, "u", None), (None, "u", big), (7, "u", "é" * 700 + "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int").repartition(3)
    got = sorted((r.page_id is None, r.page_id or 0, r.target_uri or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.warc_round_trip(df).collect())
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        revisit = h == big and i != 5
        want.append((i is None, i or 0, u or "", len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else 0))
    assert got == sorted(want)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_revisits_refer_to_records(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "z" * 2000) for i in range(3)], "page_id long, url string, html string")
    fs, base = file_system(warc.write_warc(warc.classify(df)))
    data = b"".join(fs.open_input_file(f.path).read() for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".warc"))
    names, refers = (re.findall(rb"\r\n%b: (<urn:uuid:[^>]+>)" % h, data) for h in (b"WARC-Record-ID", b"WARC-Refers-To"))
    response = re.search(rb"WARC-Type: response\r\nWARC-Record-ID: (\S+)", data)[1]
    assert len(names) == len(set(names)) >= 4 and set(refers) == {response} and len(refers) == 2


def test_warc_headers_decide_before_payloads(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "y" * (2000 if i % 2 else 50) + str(i % 4)) for i in range(40)], "page_id long, url string, html string")
    root = warc.write_warc(warc.classify(df), block_bytes=5000)
    r = warc.read_warc(spark, root, (F.col("record_type") == "revisit") & (F.col("page_id") > 5))
    assert r.count() == df.where("page_id % 2 = 1 and page_id > 5 and page_id < 36").count()
    assert warc.read_warc(spark, root, F.col("target_uri").startswith("http://h/3"), payload=False).where("payload is null").count() == 11
    reader = warc.WarcReader({"path": root})
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == 18 and reader.skipped > 0 and len(reader.partitions()) > 3


def test_neighbours(spark):
    g = np.random.default_rng(2)
    x = g.standard_normal((600, 12)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0, 2.0]), (None, [1.0] * 12), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=10, block=100, query_block=7).collect()
    hit = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(best.tolist()))
    assert hit >= 0.95 * 300 and {r.query_id for r in got} == set(range(0, 600, 20))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]


def test_neighbours_among_many_copies(spark):
    g = np.random.default_rng(6)
    n, near = 6000, 12
    x = g.standard_normal((n, 12)).astype(np.float32)
    order = g.permutation(n)
    x[order[:2000]] = x[order[0]]
    for j in range(near):  # queries close to the copies, each with six neighbours that are closer
        mine = order[2000 + 7 * j : 2007 + 7 * j]
        x[mine] = x[order[0]] + g.standard_normal(12) * 0.1 + g.standard_normal((7, 12)) * 0.01
    asked = sorted([*order[:40].tolist(), *(int(order[2000 + 7 * j]) for j in range(near)), *order[5000:5030].tolist()])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, F.col("vec_id").isin(asked), k=10, block=1000, query_block=32).collect()
    hit = 0
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(n), d))[:10].tolist()
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 10
        if q in order[: 2000 + 7 * near]:
            assert mine == best
        hit += len(set(mine) & set(best))
    assert hit >= 0.95 * 10 * len(asked)


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding is not None}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    for depth, least in ((200, 0.99), (40, 0.9)):
        got = {}
        for r in ann.search(df, F.col("vec_id") % 20 == 0, depth=depth, block=400, query_block=16).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hit = 0
        for q in ids[ids % 20 == 0]:
            d = np.sqrt(((x - rows[q]) ** 2).sum(1))
            d[ids == q] = np.inf
            hit += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert hit >= least * 10 * (ids % 20 == 0).sum()


def awkward_vectors():
    g = np.random.default_rng(12)
    noise = g.standard_normal((4000, 16))
    wide = noise * 10.0 ** np.linspace(-4, 4, 16)
    tight = np.repeat(g.standard_normal((4, 16)), 1000, 0) + noise * 1e-4
    mixed = np.concatenate([noise[:3000] * 1e-3, noise[3000:] * 1e3])
    return {"far from zero": (noise + 1000).astype(np.float32), "tight clusters": tight.astype(np.float32), "few large ones": mixed, "odd scales": wide, "doubles that floats can't tell apart": 1 + noise * 1e-9}


@pytest.mark.parametrize("kind", awkward_vectors())
def test_nearest_are_found_whatever_the_rows(spark, kind):
    x = awkward_vectors()[kind]
    numbers = "float" if x.dtype == np.float32 else "double"
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"vec_id long, embedding array<{numbers}>").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, block=1500, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 40
    for q, mine in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert [v for _, v, _ in sorted(mine)] == best.tolist() and np.allclose([s for *_, s in sorted(mine)], d[best], rtol=1e-12)


def test_a_repeated_id_hides_no_other(spark):
    g = np.random.default_rng(13)
    x = np.concatenate([[[9.0] * 8], 9 + g.standard_normal((500, 8)) * 0.01, g.standard_normal((300, 8))])
    ids = [0, *[7] * 500, *range(100, 400)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    got = [r.vec_id for r in ann.search(df, F.col("vec_id") == 0, block=200).orderBy("rank").collect()]
    assert got == [7, *(100 + np.argsort(d[501:], kind="stable")[:9]).tolist()]


def test_parallel_error_is_penalised():
    x = np.random.default_rng(4).standard_normal((2000, 16))
    share = []
    for t in (0.01, 0.5):
        q = ann.Quantizer(x, threshold=t)
        c = q.encode(x, packed=False)
        r = x - np.concatenate([q.books[s][c[:, s]] for s in range(q.spaces)], 1)
        share.append((((r * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean())
    assert share[1] < share[0]


def padding(bounds, lengths):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_boundaries_are_the_best():
    from itertools import combinations

    rnd = random.Random(1)
    lengths = [rnd.randint(0, 40) for _ in range(200)]
    sizes = sorted(set(lengths))
    counts = [lengths.count(s) for s in sizes]
    for k in (1, 2, 3):
        bounds, cost = packing.best_boundaries(sizes, counts, k)
        assert cost == padding(bounds, lengths) == min(padding([*c, sizes[-1]], lengths) for c in combinations(sizes[:-1], k - 1))
    assert packing.best_boundaries([], [], 3) == ([], 0)


def test_packing_keeps_all_texts_and_fills_its_budget(spark, awkward, none_at_all):
    lib = Tokenizer.from_file(PATH)
    got = packing.pack(awkward, PATH, buckets=4, longest=500, budget=2000, group_batches=2).collect()
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    texts = {}
    for r in sorted(got, key=lambda r: (r.doc_id or 0, r.segment)):
        assert r.n_tokens == count(r.text) <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
        if r.doc_id not in (2, None):  # ids of one row
            texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert texts == {i: t or "" for i, t, *_ in awkward_rows() if i not in (2, None)}
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and len(b) <= max(1, 2000 // max(1, b[0].bucket_tokens)) and sorted(r.slot for r in b) == list(range(len(b)))
    assert packing.pack(none_at_all, PATH).count() == 0
    many = spark.createDataFrame([(None, "one two three four")] * 5000, "doc_id long, text string")
    full = packing.pack(many, PATH, budget=400, group_batches=4).groupBy("batch").count().collect()
    assert sum(r["count"] for r in full) == 5000 and sum(r["count"] == 100 for r in full) >= 0.6 * len(full)


def test_mixing_meets_targets(spark, awkward, none_at_all):
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice("red rose ruby and the of".split() if i % 4 else "blue bird bay and the of".split()) for _ in range(rnd.randint(5, 60)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(0, 400, 3)] + [(None, "a"), (5, None)], "doc_id long, domain string")
    for share in (0.5, 0.95):
        r = mixing.mix(df, labels, {"a": 1 - share, "b": share}).collect()
        total = sum(x.n_tokens for x in r)
        assert len(r) == 400 and all(x.rate >= 0 and abs(x.p_a + x.p_b - 1) < 1e-9 for x in r)
        assert abs(sum(x.rate * x.n_tokens * x.p_b for x in r) / total - share) < 1e-5 and r[0].gap < 1e-5
        assert sum((x.domain == "b") == (x.doc_id % 4 == 0) for x in r) > 390
    copies = mixing.mixed(df, spark.createDataFrame(r)).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in copies} == {x.doc_id: x.copies for x in r if x.copies}
    assert mixing.mix(none_at_all, labels, {"a": 1, "b": 1}).count() == 0
    odd = mixing.mix(awkward, labels, {"a": 1, "b": 1}).collect()
    assert len(odd) == len({i for i, *_ in awkward_rows()})


def test_rates_are_the_best_that_bounds_allow(spark):
    g = np.random.default_rng(2)
    p = g.dirichlet([1, 1, 1], 200)
    n = g.integers(1, 100, 200)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    for targets, most in (([9000.0, 500.0, 500.0], None), ([100.0, 100.0, 1e5], 2.0)):
        rated, course = mixing.fit_rates(df, targets, most)
        rate = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
        a = (rate * n) @ p
        assert (rate >= 0).all() and rate.max() <= (most or np.inf) and abs(np.abs(a - targets).sum() / sum(targets) - course[-1]) < 1e-6
        if most is None:  # brute force: long projected gradient in the plain metric
            x = np.ones(200)
            for _ in range(20_000):
                x = np.maximum(0, x - 2e-7 * n * (p @ ((x * n) @ p - targets)))
            assert np.abs((x * n) @ p - targets).sum() >= np.abs(a - targets).sum() - 1e-3 and course[-1] < 1e-6
        else:
            assert course[-1] > 0.5  # twice all tokens are far fewer: said, not hidden


def test_a_target_without_documents_is_warned_of(spark):
    df = spark.createDataFrame([(i, "word") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="misses"):
        mixing.mix(df, labels, {"a": 0.0, "b": 1.0}, most=2.0)


def toxic_corpus(n=300):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 5)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(10, 200))]
        y = int(i % 5 == 0)
        for _ in range(3 * y):
            w[rnd.randrange(len(w))] = rnd.choice(["vilez" + word(), "nastyq"])
        out.append((i, " ".join(w), y))
    return out


def test_toxicity(spark, awkward, none_at_all):
    rows = toxic_corpus(1000)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    r = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in r if r[i].held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r.values())
    odd = toxicity.toxicity(awkward, labels).collect()
    assert len(odd) == len(awkward_rows()) and all(0 <= x.score <= 1 for x in odd)
    assert all(x.score == 0 and x.predicted == 0 for x in odd if x.doc_id in (4, 5, 6))  # null, empty and blank
    assert toxicity.toxicity(none_at_all, labels).count() == 0
    assert toxicity.not_toxic(docs, labels).columns == docs.columns


def test_toxicity_keeps_the_balance_of_all_labels(spark):
    rows = toxic_corpus(1000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    kept = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    seen = []
    for limits in ({}, {"toxic": 100, "other": 40}):
        y = [r.toxic for r in toxicity.training_rows(docs, labels, **limits).collect()]
        seen.append((y.count(0), y.count(1), toxicity.class_weights(labels, **limits)))
    assert seen == [(len(kept) - sum(kept), sum(kept), (1.0, 1.0)), (40, 100, ((len(kept) - sum(kept)) / 40, sum(kept) / 100))]
    texts, y = zip(*((t, y) for _, t, y in rows[:200]), strict=True)
    even, rare = (toxicity.train(list(texts), list(y), epochs=1, least_steps=4, weights=w).scale for w in ((1.0, 1.0), (20.0, 1.0)))
    assert -rare[1] / rare[0] > -even[1] / even[0]  # a rarer class needs a higher logit


def test_long_labelled_texts_train_by_pieces(spark):
    docs = spark.createDataFrame([(1, "a" * 10 + " middle " + "z" * 100_000 + " end"), (2, "short"), (3, None)], "doc_id long, text string")
    r = {x.doc_id: x.text for x in toxicity.training_rows(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as toxic"), most_chars=800).collect()}
    held = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert set(r) == {1, 2} - held and (1 in held or len(r[1]) == 807 and r[1].startswith("aaa") and r[1].endswith(" end"))


def test_weighted_fit_of_a_sample_is_that_of_all_rows():
    g = np.random.default_rng(5)
    y = np.repeat([0.0, 1.0], [9000, 1000])
    x = g.standard_normal(10_000) + 2 * y
    part = np.concatenate([g.choice(9000, 900, replace=False), np.arange(9000, 10_000)])
    full, plain = toxicity.platt(x, y), toxicity.platt(x[part], y[part])
    fit = toxicity.platt(x[part], y[part], np.where(y[part] == 1, 1.0, 10.0))
    cut = lambda b: -b[1] / b[0]
    assert abs(cut(fit) - cut(full)) < 0.2 < 0.8 < abs(cut(plain) - cut(full))


def test_windows_cover_the_whole_text():
    for n in (1, 15, 16, 31, 32, 33, 48, 49, 1000):
        at = toxicity.windows(n)
        covered = {k for a in at for k in range(a, min(n, a + toxicity.WIDTH))}
        assert covered == set(range(n)) and (np.diff(at) == toxicity.STRIDE).all()
    assert len(toxicity.windows(0)) == 0


def test_gradient_of_the_network():
    net = toxicity.Network()
    feats = toxicity.features([b"abc", b"de", b"fghij", b"x"])
    ids = np.array([[0, 1, 2, 3] + [-1] * (toxicity.WIDTH - 4), [3, 3, 1] + [-1] * (toxicity.WIDTH - 3)])
    y = np.array([1.0, 0.0], np.float32)
    loss = lambda: float(-np.mean(y * np.log(p := toxicity.sigmoid(net.forward(net.project(net.inputs(feats)), ids))) + (1 - y) * np.log(1 - p)))
    before = {k: v.copy() for k, v in net.p.items()}
    for k in net.sums:
        net.sums[k][...] = 1e12  # steps are then proportional to the gradient
    net.step(feats, ids, y, 1e6)
    grad = {k: before[k] - v for k, v in net.p.items()}
    for k in ("wf", "uf", "bb", "ub", "wa", "va", "wo", "c"):
        net.p = {n: v.copy() for n, v in before.items()}
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        net.p[k][at] += 1e-2
        up = loss()
        net.p[k][at] -= 2e-2
        assert abs((up - loss()) / 2e-2 - grad[k][at]) < 2e-3 + 0.05 * abs(grad[k][at]), k


def test_long_texts_are_packed_in_their_length(spark):
    """A text of 20 MB costs its length, not its square: its parts are the text."""
    import time

    line = "some words of a text that goes on and on, line after line.\n"
    df = spark.createDataFrame([(1, line * (20_000_000 // len(line))), (2, "short")], "doc_id long, text string")
    begun = time.time()
    parts = packing.segments(df, PATH, 64)
    got = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("n_tokens").alias("most")).collect()
    took = time.time() - begun
    assert {r.doc_id: r.chars for r in got} == {1: len(line) * (20_000_000 // len(line)), 2: 5} and max(r.most for r in got) <= 64 and max(r.n for r in got) > 50_000
    assert took < 60
