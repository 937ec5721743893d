"""Automata, sweeps, bounded as-of joins, global places, betweenness, providers, alike names and stored payloads against brute force."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import extraction, graph, matching, phrases, places, providers
from marginalia.sources import payloads


def text_rows(rnd, n):
    return [(i, "".join(rnd.choice("abAB .é") for _ in range(rnd.randint(0, 60)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "no entity here 😀 ab")]


def test_hits_are_all_occurrences(spark):
    rnd = random.Random(1)
    texts = text_rows(rnd, 60)
    names = [(i, k, "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 3)))) for i, _ in texts for k in range(rnd.randint(0, 5))] + [(0, 90, ""), (0, 91, None), (1, 92, "AB"), (1, 93, "ab")]
    t = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.array(F.struct(F.col("text").alias("sentence"))).alias("texts"))
    e = spark.createDataFrame(names, "doc_id long, ord int, text string")
    for mode in ("all", "apart", "longest"):
        got = {(r.doc_id, r.ord, r.text, tuple(r.starts)) for r in extraction.each_hit(matching.hits(t, e, "doc_id", mode)).collect()}
        want = set()
        for i, text in texts:
            low, mine, taken = (text or "").lower(), [(k, x) for d, k, x in names if d == i and x], []
            for k, x in sorted(mine, key=lambda m: (-len(m[1]), m[0])):
                at = [p for p in range(len(low)) if low.startswith(x.lower(), p)]
                if mode == "apart":
                    keep, end = [], 0
                    for p in at:
                        if p >= end:
                            keep, end = [*keep, p], p + len(x)
                    at = keep
                if mode == "longest":
                    keep = []
                    for p in at:
                        if all(p + len(x) <= a or p >= b for a, b in taken):
                            taken.append((p, p + len(x)))
                            keep.append(p)
                    at = keep
                if at:
                    want.add((i, k, x, tuple(at)))
        assert got == want and len(want) > 50


def test_best_names_are_brute_forces(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abAB") for _ in range(rnd.randint(1, 4)))
    words, names = [(i % 7, word()) for i in range(150)] + [(1, ""), (2, None)], [(i % 7, word()) for i in range(40)] + [(3, ""), (3, None)]
    got = Counter(map(tuple, matching.best_names(spark.createDataFrame(words, "d int, w string"), spark.createDataFrame(names, "d int, text string"), "w", "d").select("d", "w", "w_entity").collect()))
    want = Counter()
    for d, w in words:
        fits = [(n.lower() == w.lower(), len(n), n) for k, n in names if k == d and n and w and (n.lower() in w.lower() or w.lower() in n.lower())]
        if fits:
            want[d, w, max(fits)[2]] += 1
    assert got == want


def test_points_find_their_interval(spark):
    rnd = random.Random(3)
    spans = []
    for d in range(20):
        at = 0
        for s in range(rnd.randint(0, 8)):
            a = at + rnd.randint(0, 3)
            at = a + rnd.randint(1, 6)
            spans.append((d, s, a, at))
    points = [(rnd.randrange(22), rnd.randint(-2, 60)) for _ in range(400)]
    got = Counter((r.doc_id, r.place, r.sent_id) for r in matching.in_interval(spark.createDataFrame(points, "doc_id int, place int"), spark.createDataFrame(spans, "doc_id int, sent_id int, start int, end int"), at="place").collect())
    assert got == Counter((d, p, s) for d, p in points for e, s, a, b in spans if d == e and a <= p < b) and len(got) > 50


def test_antecedents_are_the_full_joins(spark):
    rnd = random.Random(4)
    kinds = [("it", "it"), ("this", "this"), ("they", "they"), ("definite", "the model"), ("definite", "the layer"), ("demonstrative", "this method"), ("definite", "the odd")]
    refs, mentions = [], []
    for d in range(25):
        bounds = sorted(rnd.sample(range(1, 900), 9))
        sent = lambda p, b=bounds: sum(p >= x for x in b)
        for _ in range(rnd.randint(0, 12)):
            p, (k, r) = rnd.randrange(900), rnd.choice(kinds)
            refs.append((d, r, k, p, sent(p)))
        for _ in range(rnd.randint(0, 60)):
            p = rnd.randrange(900)
            mentions.append((d, rnd.choice(["Ann", "Net", "Box", "Zed"]), rnd.choice(["PERSON", "model", "METHOD", "COMPONENT", "odd", "other"]), p, p + 3, sent(p), rnd.choice([0.7, 0.85, 0.9, 1.0])))
    refs, mentions = list(dict.fromkeys(refs)), [m for m in mentions if m[5] == m[5]]
    r = spark.createDataFrame(refs, "doc_id int, ref string, kind string, start int, sent_id int")
    m = spark.createDataFrame(mentions, "doc_id int, text string, type string, start int, end int, sent_id int, salience double")
    got = {(x.doc_id, x.start, x.ref): (x.score, x.antecedent) for x in extraction.antecedents(r, m).collect()}
    e = m.select("doc_id", F.col("text").alias("antecedent"), F.col("type").alias("etype"), F.col("end").alias("e_end"), F.col("sent_id").alias("e_sent"), "salience")
    j = r.join(e, "doc_id").where("e_end <= start")
    score = F.round(extraction.candidate_score(F.col("kind"), F.col("ref"), F.col("etype"), F.lit(0.0), F.col("sent_id") - F.col("e_sent"), F.col("start") - F.col("e_end")) + F.round(F.col("salience") * 0.3, 6), 6)
    best = {}
    for x in j.withColumn("score", score).collect():
        key = (x.doc_id, x.start, x.ref)
        rank = (x.score, x.e_end, [-ord(c) for c in x.antecedent])
        if key not in best or rank > best[key][0]:
            best[key] = (rank, (x.score, x.antecedent))
    assert got == {k: v for k, (_, v) in best.items()} and len(got) > 80


def test_places_are_the_order(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3]), i, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, _at string").repartition(5)
    got = places.with_places(df, F.desc("a"), "b", partitions=7)
    assert got.columns == ["a", "b", "_at", "place"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [tuple(r)[:3] for r in got.orderBy("place").collect()] == want and got.agg(F.max("place")).first()[0] == 499
    assert places.with_places(df.limit(0), "a", "b").count() == 0


def brandes(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
        out.setdefault(a, set()), out.setdefault(b, set())
    total = dict.fromkeys(out, 0.0)
    for s in out:
        depth, count, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in out[v]:
                if w not in depth:
                    depth[w], count[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    count[w] += count[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in out[v] and depth[w] == depth[v] + 1:
                    share[v] += count[v] / count[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(out)
    return {v: x / max(1, (n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_of_random_graphs(spark):
    rnd = random.Random(6)
    graphs = {g: [(rnd.randrange(12), rnd.randrange(12)) for _ in range(25)] for g in "ab"}
    df = spark.createDataFrame([(g, f"n{a}", f"n{b}") for g, es in graphs.items() for a, b in es], "g string, src string, dst string")
    got = {(r.g, r.node): r.betweenness for r in graph.betweenness(df, "g", block=9).collect()}
    want = {(g, f"n{v}"): x for g, es in graphs.items() for v, x in brandes(es).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = graph.betweenness(df.where("g = 'a'"), sample=0.6, block=3).collect()
    assert {r.node for r in some} == {n for g, n in want if g == "a"} and all(r.betweenness >= 0 and (r.error is None or r.error >= 0) for r in some)
    assert graph.betweenness(df.limit(0)).count() == 0


def test_kept_results_ask_nobody(spark):
    calls = spark.sparkContext.accumulator(0)

    def ask(name, wants):
        def answer(batches):
            for b in batches:
                calls.add(len(b))
                yield b[b["context"].str.contains(wants, na=False)].assign(type=name.upper(), confidence=0.9 if name == "a" else 0.4)[["key", "type", "confidence"]]

        return providers.Provider(name, lambda df: df.mapInPandas(answer, "key string, type string, confidence double"))

    pairs = spark.createDataFrame([("x", "y", "one"), ("x", "y", "one"), ("x", "z", "two"), (None, "z", None)], "source string, target string, context string")
    none = spark.createDataFrame([], providers.KEPT)
    off = providers.Provider("off", lambda df: 1 / 0, lambda: False)
    each = [off, ask("b", "two"), ask("a", "one|two")]
    first, kept = providers.relations(pairs, none, each, preferred="a")
    assert sorted((r.context, r.provider, r.type) for r in first.collect()) == [("one", "a", "A"), ("one", "a", "A"), ("two", "a", "A")] and calls.value == 3 + 1
    again, same = providers.relations(pairs.where("context is not null"), kept, each, preferred="a")
    assert calls.value == 4 and sorted(map(tuple, same.collect())) == sorted(map(tuple, kept.collect())) and again.count() == 3
    low = providers.relations(pairs, none, [ask("b", "two")])[0]
    assert low.count() == 0  # 0.4 is too little


def test_full_tables_drop_their_oldest_quarter(spark):
    for n, most in ((5, 10), (10, 10), (11, 10), (40, 12), (13, 3)):
        kept = []
        for i in range(n):
            if len(kept) >= most:
                kept = kept[max(1, most // 4) :]
            kept.append(i)
        df = spark.createDataFrame([(f"k{i}", "p", "T", 0.9, i) for i in range(n)], providers.KEPT)
        assert sorted(r.seq for r in providers.trimmed(df, most).collect()) == kept


def test_similar_names_are_brute_forces(spark):
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 9)))
    left, right = [(name(),) for _ in range(80)] + [(None,), ("",), ("AAA",)], [(name(),) for _ in range(80)] + [("aaa",)]
    grams = lambda s: {("##" + s + "##")[i : i + 3] for i in range(len(s) + 2)}
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.left, r.right): r.similarity for r in providers.similar_names(spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string"), least).collect()}
        want = {}
        for a in {x.lower() for (x,) in left if x}:
            for b in {x.lower() for (x,) in right}:
                s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                if s >= least - 1e-9:
                    want[a, b] = s
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_payload_pages_are_pruned_and_errors_give_no_rows(spark, tmp_path):
    bodies = [(i, "paper", 404 if i % 10 == 3 else 200, json.dumps({"paperId": f"p{i}", "title": None, "authors": [{"name": "A"}], "year": 2000 + i, "externalIds": {"DOI": f"10.1/{i}"}})) for i in range(200)]
    bodies += [(500, "references", 200, json.dumps({"data": [{"citedPaper": {"paperId": "x"}}, {"citedPaper": None}, {"citedPaper": {"title": "no id"}}]})), (501, "work", 200, "not json"), (502, "paper", 200, None), (503, "attention", 200, '{"doi": "10.1/9", "score": 12.5}')]
    root = payloads.write_pages(spark.createDataFrame(bodies, "request_id long, kind string, status int, body string"), f"file://{tmp_path}/p", 6)
    all_rows = payloads.read_payloads(spark, root).collect()
    assert {r.request_id for r in all_rows} == {i for i in range(200) if i % 10 != 3} | {500, 503}
    assert next(r for r in all_rows if r.request_id == 1).title == "Unknown" and [x.paper_id for x in next(r for r in all_rows if r.request_id == 500).refs] == ["x"]
    few = payloads.read_payloads(spark, root, (F.col("request_id") < 20) & (F.col("kind") == "paper") & (F.col("year") > 2010))
    assert sorted(r.request_id for r in few.collect()) == [i for i in range(11, 20) if i != 13]
    reader = payloads.PayloadReader({"path": root})
    from pyspark.sql.datasource import EqualTo, LessThan

    assert len(reader.partitions()) == 6 and list(reader.pushFilters([LessThan(("request_id",), 20), EqualTo(("kind",), "paper"), EqualTo(("title",), "x")])) == [EqualTo(("title",), "x")]
    assert len(reader.partitions()) < 6
    assert [tuple(r) for r in payloads.citation_edges(payloads.read_payloads(spark, root)).collect()] == [("500", "x")]


def test_noun_phrases_and_parse_relations(spark):
    df = spark.createDataFrame([(1, "The new parser uses a fast grammar. Graphs were explained by the Model. Nova is a tool. It."), (2, None), (3, "")], "doc_id int, text string")
    t = extraction.tagged_tokens(extraction.sentence_rows(df))
    chunks = {(r.sent_id, r.text) for r in phrases.noun_chunks(t).collect()}
    assert {(0, "The new parser"), (0, "a fast grammar"), (1, "Graphs"), (1, "the Model"), (2, "Nova"), (2, "a tool")} <= chunks
    e = phrases.chunk_entities(phrases.noun_chunks(t))
    assert "It" not in {r.text for r in e.collect()}
    edges = {(r.sent_id, r.relation, r.head, r.dependent) for r in phrases.parse_edges(t).collect()}
    assert {(0, "nsubj", "uses", "parser"), (0, "dobj", "uses", "grammar"), (1, "nsubjpass", "explained", "Graphs"), (1, "pobj", "explained", "Model"), (2, "nsubj", "is", "Nova"), (2, "attr", "is", "tool")} <= edges
    rel = {(r.source, r.target, r.type, r.confidence) for r in phrases.parse_relations(t, e).collect()}
    assert {("The new parser", "a fast grammar", "USES_METHOD", 0.6), ("Graphs", "the Model", "EXPLAINS", 0.6), ("Nova", "a tool", "RELATED_TO", 0.6)} <= rel


def test_slots_are_taken_apart_into_pairs(spark):
    told = [
        (1, 0, "Vega et al. at Blue Lab introduced the Graphnet in 2020."), (1, 1, "The Parser, introduced by Mira et al. at Open Lab, is fast."),
        (1, 2, "Graphnet reached good results on Corpus and Treebank."), (1, 3, "Graphnet rivals Parser on Imageset classification."), (2, 0, None),
    ]
    kinds = {"Vega et al.": "PERSON", "Mira et al.": "PERSON", "Blue Lab": "ORGANIZATION", "Open Lab": "ORGANIZATION", "Graphnet": "TECHNOLOGY", "Parser": "TECHNOLOGY", "Corpus": "DATASET", "Treebank": "DATASET", "Imageset": "DATASET"}
    sents = spark.createDataFrame(told, "doc_id int, sent_id int, sentence string")
    ents = spark.createDataFrame([(d, s, n, k) for d, s, t in told for n, k in kinds.items() if n in (t or "")], "doc_id int, sent_id int, text string, type string")
    got = {(r.source, r.target, r.type) for r in phrases.slot_relations(sents, ents).collect()}
    assert got == {
        ("Vega et al.", "Graphnet", "INTRODUCES"), ("Vega et al.", "Blue Lab", "AFFILIATED_WITH"), ("Mira et al.", "Parser", "INTRODUCES"), ("Mira et al.", "Open Lab", "AFFILIATED_WITH"),
        ("Graphnet", "Corpus", "EVALUATED_ON"), ("Graphnet", "Treebank", "EVALUATED_ON"), ("Graphnet", "Imageset", "EVALUATED_ON"),
    }


@pytest.mark.parametrize("text", ["", "no references", None])
def test_awkward_texts_have_no_antecedents(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    ents = spark.createDataFrame([(1, 1, "It")], "doc_id int, ord int, text string")
    assert extraction.placed_references(df).count() == 0 and extraction.resolved(df, ents).first().text == text


def test_betweenness_takes_twin_sources_once(spark):
    """A hundred leaves at three hubs are three sources; what they stand for is counted in full, in each graph apart."""
    ring = [("h0", "h1"), ("h1", "h2"), ("h2", "h0"), ("h1", "top"), ("h2", "top")]
    edges = [(g, a, b) for g in "ab" for a, b in [*ring, *((f"l{i}", f"h{i % 3}") for i in range(100 if g == "a" else 7)), ("m1", "h0"), ("m1", "h1"), ("m2", "h1"), ("m2", "h0")]]
    df = spark.createDataFrame(edges, "g string, src string, dst string")
    nodes = df.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    twins = {(r.g, r.node): r.times for r in graph._twins(df, nodes).collect()}
    assert {g: sorted(t for (h, _), t in twins.items() if h == g) for g in "ab"} == {"a": [1, 1, 1, 1, 2, 33, 33, 34], "b": [1, 1, 1, 1, 2, 2, 2, 3]}
    got = {(r.g, r.node): r.betweenness for r in graph.betweenness(df, "g").collect()}
    want = {(g, v): x for g in "ab" for v, x in brandes([(a, b) for h, a, b in edges if h == g]).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
