"""Queries over the catalogue, the graph of orders, vectors, papers and citations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators import catalog, credibility, exports, graph, vectors
from marginalia.plans.base import SQL_WORDS, query, read


@query(f"SELECT 'sha256:' || sha256(text) AS content_id, min(doc_id) AS first_id, max(len({SQL_WORDS})) AS word_count, count(*) AS copies FROM documents GROUP BY 1")
def doc_content_hash_dedupe(spark, sf):
    return catalog.content_addressed(read(spark, sf, "documents")).withColumn("word_count", F.col("word_count").cast("long"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def doc_page_listing(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", "n_chars").where("lang = 'en'")
    return catalog.page(docs, 2, 50, F.desc("n_chars"), "doc_id")


@query("SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS total_pages FROM documents")
def doc_page_counts(spark, sf):
    return catalog.page_counts(read(spark, sf, "documents"), 20)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def doc_search_like(spark, sf):
    return catalog.search(read(spark, sf, "documents"), ["text", "source", "missing"], "License").select("doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 500 AND contains(lower(text), 'que') ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 5")
def query_builder(spark, sf):
    q = catalog.Query(read(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text"))
    return q.filter(F.col("n_chars") > 500).filter_by(lang="fr", unknown=1).search(["text"], "que").order_by("n_chars", True).order_by("doc_id").offset(5).limit(25).build().drop("text")


@query("SELECT conv_id, len(list(turn)) AS turns, array_to_string(list(role ORDER BY role, turn), ' ') AS roles FROM conversations GROUP BY conv_id")
def eager_load(spark, sf):
    c = read(spark, sf, "conversations")
    q = catalog.Query(c.select("conv_id").distinct()).load(c.select("conv_id", "role", "turn"), "conv_id", "turns")
    return q.build().select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_join("turns.role", " ").alias("roles"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def doc_exists_semi(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'flagged' ELSE d.lang END AS lang, d.n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def merge_update(spark, sf):
    up = read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("flagged").alias("lang")).distinct()
    return catalog.merge_update(read(spark, sf, "documents").select("doc_id", "lang", "n_chars"), up, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_delete(spark, sf):
    return catalog.delete(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query("SELECT DISTINCT l.doc_id * 2 AS doc_id, coalesce(d.lang, 'xx') AS lang, d.doc_id IS NULL AS created FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2")
def get_or_create(spark, sf):
    wanted = read(spark, sf, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return catalog.get_or_create(read(spark, sf, "documents").select("doc_id", "lang"), wanted, "doc_id", {"lang": F.lit("xx")})


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus) || list(substring(o_orderpriority, 1, 1)))), ',') AS marks FROM orders GROUP BY o_custkey""")
def array_union_update(spark, sf):
    o = read(spark, sf, "orders")
    base = o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("marks"))
    more = o.select("o_custkey", F.array(F.substring("o_orderpriority", 1, 1)).alias("marks"))
    return catalog.add_to_arrays(base, more, "o_custkey", "marks").select("o_custkey", F.array_join("marks", ",").alias("marks"))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def argmax_dedupe(spark, sf):
    return catalog.latest(read(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT c_custkey::VARCHAR AS node_id, c_name AS label FROM customer WHERE contains(lower(c_name), '99') ORDER BY node_id LIMIT 20")
def node_search(spark, sf):
    n = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_name").alias("label"))
    return catalog.search_nodes(n, "99", 20)


# The graph: customers and suppliers to nations, nations to regions, and nations in a ring inside each region


_SQL_GRAPH = """edges AS (SELECT 'c' || c_custkey AS edge_id, 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'lives_in' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'S' || s_suppkey, 'N' || s_nationkey, 'based_in' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'N' || n_nationkey, 'R' || n_regionkey, 'part_of' FROM nation UNION ALL SELECT 'r' || n_nationkey, 'N' || n_nationkey, 'N' || (n_nationkey + 5) % 25, 'next_to' FROM nation),
nodes AS (SELECT DISTINCT unnest([src, dst]) AS node_id FROM edges)"""


def _edges(spark, sf):
    c, s, n = (read(spark, sf, t) for t in ("customer", "supplier", "nation"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    row = lambda df, e, p, k, to, d, t: df.select(key(e, k).alias("edge_id"), key(p, k).alias("src"), (F.concat(F.lit(to), d.cast("string"))).alias("dst"), F.lit(t).alias("type"))
    out = row(c, "c", "C", "c_custkey", "N", F.col("c_nationkey"), "lives_in").unionByName(row(s, "s", "S", "s_suppkey", "N", F.col("s_nationkey"), "based_in"))
    out = out.unionByName(row(n, "n", "N", "n_nationkey", "R", F.col("n_regionkey"), "part_of"))
    return out.unionByName(row(n, "r", "N", "n_nationkey", "N", (F.col("n_nationkey") + 5) % 25, "next_to"))


def _nodes(edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


@query(f"""WITH RECURSIVE {_SQL_GRAPH}, p AS (SELECT node_id AS start, node_id AS pos, []::VARCHAR[] AS used, 0 AS d FROM nodes WHERE node_id LIKE 'S%'
UNION ALL SELECT start, dst, list_append(used, edge_id), d + 1 FROM p JOIN edges ON pos = src AND NOT list_contains(used, edge_id) WHERE d < 3) SELECT DISTINCT start, pos AS node FROM p WHERE d > 0""")
def graph_traverse_k(spark, sf):
    e = _edges(spark, sf)
    return graph.traverse(e, _nodes(e).where("node_id like 'S%'").withColumnRenamed("node_id", "node"), 3)


@query(f"""WITH RECURSIVE {_SQL_GRAPH}, b AS (SELECT edge_id, src AS a, dst AS b FROM edges WHERE type <> 'lives_in' UNION ALL SELECT edge_id, dst, src FROM edges WHERE type <> 'lives_in'),
p AS (SELECT node_id AS start, node_id AS pos, []::VARCHAR[] AS used, 0 AS d FROM nodes WHERE node_id LIKE 'R%' UNION ALL SELECT start, b, list_append(used, edge_id), d + 1 FROM p JOIN b ON pos = a AND NOT list_contains(used, edge_id) WHERE d < 2)
SELECT DISTINCT start, pos AS node FROM p WHERE d > 0""")
def graph_traverse_both(spark, sf):
    e = _edges(spark, sf)
    return graph.traverse(e, _nodes(e).where("node_id like 'R%'").withColumnRenamed("node_id", "node"), 2, "both", ["based_in", "part_of", "next_to"])


@query(f"""WITH RECURSIVE {_SQL_GRAPH}, p AS (SELECT node_id AS start, node_id AS node, 0 AS depth FROM nodes WHERE node_id LIKE 'N%' UNION SELECT start, dst, depth + 1 FROM p JOIN edges ON node = src WHERE depth < 3)
SELECT start, node, min(depth) AS depth FROM p GROUP BY ALL""")
def shortest_hops(spark, sf):
    e = _edges(spark, sf)
    return graph.distances(e, _nodes(e).where("node_id like 'N%'").withColumnRenamed("node_id", "node"), 3)


@query(f"""WITH RECURSIVE {_SQL_GRAPH}, e AS (SELECT src, dst FROM (SELECT DISTINCT dst AS src, src AS dst FROM edges) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 4),
p AS (SELECT 'R0' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM p JOIN e ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM p GROUP BY node""")
def bfs_tree_capped(spark, sf):
    back = _edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.capped_tree(back, "R0", 3, 4)[0]


@query(f"""WITH RECURSIVE {_SQL_GRAPH}, p AS (SELECT ['C1'] AS path, 'C1' AS pos UNION ALL SELECT list_append(path, dst), dst FROM p JOIN (SELECT DISTINCT src, dst FROM edges) ON pos = src AND NOT list_contains(path, dst) WHERE len(path) <= 6)
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM p WHERE pos = (SELECT 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1) ORDER BY hops, path LIMIT 1""")
def citation_path(spark, sf):
    e = _edges(spark, sf)
    target = read(spark, sf, "customer").where("c_custkey = 1").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).first()[0]
    p = graph.shortest_path(e, "C1", target, 6)
    return p.select(F.array_join("path", ">").alias("path"), F.col("hops").cast("long").alias("hops"))


@query(f"""WITH {_SQL_GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src AS node_id, count(*) AS o FROM e GROUP BY src), i AS (SELECT dst AS node_id, count(*) AS i FROM e GROUP BY dst)
SELECT node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round((coalesce(i, 0) + coalesce(o, 0)) / ((SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM nodes LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id)""")
def degree_centrality(spark, sf):
    e = _edges(spark, sf)
    d = graph.degrees(e, _nodes(e))
    return d.select("node_id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"), "centrality")


@query(f"WITH {_SQL_GRAPH} SELECT n AS nodes, m AS edges, round(m / (n * (n - 1)), 9) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM (SELECT DISTINCT src, dst FROM edges))")
def graph_density(spark, sf):
    e = _edges(spark, sf)
    return graph.density(e, _nodes(e))


@query("""SELECT 'C' || c_custkey AS node_id, min('C' || c_custkey) OVER (PARTITION BY c_nationkey % 5) AS component FROM customer""")
def weak_components(spark, sf):
    e = _edges(spark, sf).where("type in ('lives_in', 'next_to')")
    w = graph.weak_components(e, _nodes(e))
    return w.where("node_id like 'C%'")


@query(f"WITH {_SQL_GRAPH} SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_types(spark, sf):
    return graph.type_histogram(_edges(spark, sf))


@query(f"WITH {_SQL_GRAPH} SELECT edge_id FROM edges WHERE src LIKE 'N%' AND dst LIKE 'N%'")
def induced_subgraph(spark, sf):
    e = _edges(spark, sf)
    return graph.induced(e, _nodes(e).where("node_id like 'N%'").withColumnRenamed("node_id", "node")).select("edge_id")


@query(f"WITH {_SQL_GRAPH} SELECT edge_id FROM edges WHERE src NOT IN ('N3', 'N4') AND dst NOT IN ('N3', 'N4')")
def delete_nodes(spark, sf):
    e = _edges(spark, sf)
    n = _nodes(e)
    return graph.delete_nodes(n, e, n.where("node_id in ('N3', 'N4')"))[1].select("edge_id")


@query("SELECT substring(md5(lower(n_name)), 1, 12) AS src, substring(md5(lower(r_name)), 1, 12) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_build(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    ents = n.select(F.col("n_name").alias("text"), F.lit("nation").alias("type")).unionByName(r.select(F.col("r_name").alias("text"), F.lit("region").alias("type")))
    rels = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("part_of").alias("type"), F.lit(1.0).alias("weight"))
    rels = rels.unionByName(n.select(F.col("n_name").alias("source"), F.lit("nowhere").alias("target"), F.lit("x").alias("type"), F.lit(1.0).alias("weight")))
    return graph.build(ents, rels)[1].select("src", "dst")


@query("SELECT DISTINCT 'N' || c_nationkey AS node_id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def missing_endpoints(spark, sf):
    e = _edges(spark, sf).where("type = 'lives_in'")
    n = read(spark, sf, "nation").where("n_regionkey < 3").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return graph.missing_endpoints(e, n.unionByName(e.select(F.col("src").alias("node_id"))))


_SQL_BETWEEN = f"""RECURSIVE {_SQL_GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
far AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM nodes UNION SELECT s, dst, d + 1 FROM far JOIN e ON v = src WHERE d < 9),
dist AS (SELECT s, v, min(d) AS d FROM far GROUP BY ALL),
walk AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM nodes UNION ALL SELECT w.s, dst, w.d + 1 FROM walk w JOIN e ON w.v = src JOIN dist t ON t.s = w.s AND t.v = dst AND t.d = w.d + 1),
paths AS (SELECT s, v, d, count(*) AS k FROM walk GROUP BY ALL),
x AS (SELECT a.v, sum(a.k * b.k / c.k) AS x FROM paths a JOIN paths b ON a.v = b.s AND b.d > 0 AND a.d > 0 JOIN paths c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d GROUP BY a.v),
between AS (SELECT node_id AS node, coalesce(x, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2) AS b FROM nodes LEFT JOIN x ON node_id = v)"""


@query(f"WITH {_SQL_BETWEEN} SELECT node, round(b, 9)::DOUBLE AS betweenness FROM between")
def betweenness(spark, sf):
    return graph.betweenness(_edges(spark, sf)).select("node", F.round("betweenness", 9).alias("betweenness"))


@query(f"WITH {_SQL_BETWEEN} SELECT node, round(b, 9)::DOUBLE AS betweenness FROM between WHERE round(b, 12) > 0 ORDER BY round(b, 12) DESC, node LIMIT 5")
def bridge_nodes(spark, sf):
    return graph.top_bridges(graph.betweenness(_edges(spark, sf)))


@query(f"""WITH {_SQL_GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src AS node_id, count(*) AS o FROM e GROUP BY src), i AS (SELECT dst AS node_id, count(*) AS i FROM e GROUP BY dst)
SELECT node_id, round((coalesce(i, 0) + coalesce(o, 0)) / ((SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM nodes LEFT JOIN o USING (node_id) LEFT JOIN i USING (node_id) ORDER BY centrality DESC, node_id LIMIT 10""")
def central_nodes(spark, sf):
    e = _edges(spark, sf)
    return graph.top_central(graph.degrees(e, _nodes(e))).select("node_id", "centrality")


# Vectors


_SQL_D = "list_sum(list_transform(list_zip(s.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def _first_vector(spark, sf):
    return [float(x) for x in read(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"SELECT s.vec_id, round({_SQL_D}, 6) AS distance, round(1 / (1 + {_SQL_D}), 6) AS score FROM embeddings s, embeddings q WHERE q.vec_id = 0 ORDER BY {_SQL_D}, s.vec_id LIMIT 10")
def knn_l2(spark, sf):
    r = vectors.knn(read(spark, sf, "embeddings"), _first_vector(spark, sf), 10)
    return r.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"SELECT s.vec_id, round({_SQL_D}, 6) AS distance FROM embeddings s, embeddings q WHERE q.vec_id = 0 AND s.label = 1 AND s.vec_id % 7 <> 3 ORDER BY {_SQL_D}, s.vec_id LIMIT 10")
def knn_filtered(spark, sf):
    r = vectors.knn(read(spark, sf, "embeddings"), _first_vector(spark, sf), 10, F.col("label") == 1, F.col("vec_id") % 7 == 3)
    return r.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, s.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SQL_D}, s.vec_id) AS rank FROM embeddings s, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def knn_batch(spark, sf):
    e = read(spark, sf, "embeddings")
    return vectors.knn_batch(e, e.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, s.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(s.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, s.vec_id) AS rank FROM embeddings s, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10")
def knn_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    r = vectors.knn_batch(e, e.where("vec_id % 20 = 0"), 10, by_cosine=True)
    return r.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "label")
    return vectors.upsert(e, e.where("vec_id % 10 = 0").withColumn("label", F.lit(99)))


# Papers: customers as papers, their orders as citations


_SQL_CRED = """p AS (SELECT c_custkey AS id, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' Science' ELSE '' END AS venue, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, CASE WHEN c_custkey % 10 > 0 THEN 1990 + c_custkey % 34 END AS y FROM customer),
x AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 13 END AS impact, coalesce(id % 4 <> 0 AND id % 2 = 1, false) AS rev, id % 4 <> 0 AND id % 97 = 1 AS ret, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 1500 END AS att FROM p),
s AS (SELECT *, CASE WHEN n = 0 THEN 20 ELSE CASE WHEN r < 1 THEN 30 WHEN r < 5 THEN 50 WHEN r < 20 THEN 70 WHEN r < 50 THEN 85 ELSE 95 END END AS cs,
least(100, CASE WHEN contains(lower(venue), 'science') THEN least(95, b + 20) ELSE b END) AS vs, CASE WHEN y IS NULL THEN 50 WHEN 2024 - y <= 1 THEN 95 WHEN 2024 - y <= 3 THEN 85 WHEN 2024 - y <= 5 THEN 75 WHEN 2024 - y <= 10 THEN 60 WHEN 2024 - y <= 20 THEN 45 ELSE 30 END AS rs,
CASE WHEN att = 0 THEN 0 WHEN att >= 1000 THEN 95 WHEN att >= 500 THEN 85 WHEN att >= 100 THEN 70 WHEN att >= 50 THEN 60 WHEN att >= 20 THEN 50 WHEN att >= 5 THEN 35 ELSE 20 END AS a
FROM (SELECT *, n / CASE WHEN y IS NULL THEN 5 ELSE greatest(1, 2024 - y) END AS r, 30 + CASE WHEN rev THEN 20 ELSE 0 END + CASE WHEN impact > 10 THEN 40 WHEN impact > 5 THEN 30 WHEN impact > 2 THEN 20 WHEN impact > 1 THEN 10 ELSE 0 END AS b FROM x)),
o AS (SELECT id, round(CASE WHEN ret THEN 0 ELSE 0.3 * cs + 0.25 * vs + 0.15 * 50 + 0.15 * rs + 0.15 * a END, 6)::DOUBLE AS overall FROM s)"""


@query(f"WITH {_SQL_CRED} SELECT id AS paper_id, overall, CASE WHEN overall >= 70 THEN 'high' WHEN overall >= 45 THEN 'medium' WHEN overall >= 20 THEN 'low' ELSE 'unknown' END AS level FROM o")
def credibility_score(spark, sf):
    c = read(spark, sf, "customer")
    n = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.count("*").alias("citations"))
    k = F.col("paper_id")
    papers = c.select(F.col("c_custkey").alias("paper_id"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, " Science").otherwise("")).alias("venue")).join(n, "paper_id", "left").withColumn("year", F.when(k % 10 > 0, 1990 + k % 34))
    works = papers.where(k % 4 != 0).select("paper_id", (k % 13).cast("double").alias("impact"), (k % 2 == 1).alias("reviewed"), (k % 97 == 1).alias("retracted"))
    attention = papers.where(k % 5 != 0).select("paper_id", (k % 1500).alias("attention"))
    return credibility.credibility(papers, 2024, works, attention).select("paper_id", "overall", "level")


# Citations: parts as items


def _items(spark, sf):
    p = read(spark, sf, "part")
    names = F.array(*(F.struct(F.col(a).alias("last"), b.alias("first")) for a, b in (("p_brand", F.lit("B.")), ("p_type", F.lit("")))))
    kinds = F.array(*map(F.lit, ("journalArticle", "book", "webpage", "unheard")))
    return p.select(
        F.col("p_partkey").alias("item_id"), F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("item_type"), F.col("p_name").alias("title"), names.alias("authors"),
        F.concat((F.lit(1990) + F.col("p_size")).cast("string"), F.lit("-05-01")).alias("date"), F.when(F.col("p_partkey") % 2 == 0, F.lit("Parts")).alias("journal"), F.lit("7").alias("volume"), F.lit(None).cast("string").alias("issue"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("10-19")).otherwise("e5").alias("pages"), F.concat(F.lit("10.1000/"), F.col("p_partkey").cast("string")).alias("doi"), F.lit(None).cast("string").alias("url"),
        F.lit("").alias("publisher"), F.lit("{x}").alias("abstract"), F.array(F.col("p_brand")).alias("tags"),
    )


_NL = " || chr(10) || "
_SQL_ITEMS = "i AS (SELECT *, p_partkey % 4 AS k, (1990 + p_size)::VARCHAR AS y FROM part)"


@query(f"""WITH {_SQL_ITEMS} SELECT p_partkey AS item_id, 'TY  - ' || ['JOUR', 'BOOK', 'ELEC', 'GEN'][k + 1] || chr(10) || 'TI  - ' || p_name || chr(10) || 'AU  - ' || p_brand || ', B.' || chr(10) || 'AU  - ' || p_type || chr(10) || 'AB  - {{x}}' || chr(10) || 'PY  - ' || y || chr(10) || 'DA  - ' || y || '-05-01' || chr(10)
|| CASE WHEN p_partkey % 2 = 0 THEN 'JO  - Parts' || chr(10) || 'T2  - Parts' || chr(10) ELSE '' END || 'VL  - 7' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'SP  - 10' || chr(10) || 'EP  - 19' ELSE 'SP  - e5' END || chr(10) || 'DO  - 10.1000/' || p_partkey || chr(10) || 'KW  - ' || p_brand || chr(10) || 'ER  - ' AS entry FROM i""")
def ris_export(spark, sf):
    return exports.ris(_items(spark, sf))


@query(f"""WITH {_SQL_ITEMS} SELECT p_partkey AS item_id, '@' || t || '{{' || lower(p_brand) || y || '_' || (row_number() OVER (ORDER BY p_partkey) - 1) || ',' || chr(10) || '  title = {{' || p_name || '}},' || chr(10) || '  author = {{' || p_brand || ', B. and ' || p_type || '}},' || chr(10) || '  year = {{' || y || '}},' || chr(10)
|| CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN t = 'article' THEN '  journal' ELSE '  booktitle' END || ' = {{Parts}},' || chr(10) ELSE '' END || '  volume = {{7}},' || chr(10) || '  pages = {{' || CASE WHEN p_partkey % 3 = 0 THEN '10-19' ELSE 'e5' END || '}},' || chr(10) || '  doi = {{10.1000/' || p_partkey || '}},' || chr(10)
|| '  abstract = {{\\{{x\\}}}},' || chr(10) || '  keywords = {{' || p_brand || '}},' || chr(10) || '}}' AS entry FROM (SELECT *, ['article', 'book', 'misc', 'misc'][k + 1] AS t FROM i)""")
def bibtex_export(spark, sf):
    return exports.bibtex(_items(spark, sf))


@query(f"""WITH {_SQL_ITEMS} SELECT p_partkey AS item_id, '{{"id":"item_' || p_partkey || '","type":"' || ['article-journal', 'book', 'webpage', 'document'][k + 1] || '","title":"' || p_name || '","author":[{{"family":"' || p_brand || '","given":"B."}},{{"family":"' || p_type || '","given":""}}],"issued":{{"date-parts":[[' || y || ',5,1]]}}'
|| CASE WHEN p_partkey % 2 = 0 THEN ',"container-title":"Parts"' ELSE '' END || ',"volume":"7","page":"' || CASE WHEN p_partkey % 3 = 0 THEN '10-19' ELSE 'e5' END || '","DOI":"10.1000/' || p_partkey || '"}}' AS entry FROM i""")
def csl_export(spark, sf):
    return exports.csl_json(_items(spark, sf))


@query("""WITH u AS (SELECT c_custkey AS user_id, c_mktsegment FROM customer),
o AS (SELECT o_custkey AS user_id, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey, o_orderstatus) || ']' AS j FROM orders GROUP BY o_custkey),
c AS (SELECT user_id, '[' || string_agg('{"purpose":"' || event_type || '","granted":' || (n % 2 = 1) || '}', ',' ORDER BY event_type) || ']' AS j FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id),
m AS (SELECT user_id, '[{"events":' || count(*) || ',"last_event":' || max(event_id) || '}]' AS j FROM events GROUP BY user_id)
SELECT user_id, '{' || array_to_string(list_filter(['"profile":[{"segment":"' || c_mktsegment || '"}]', '"orders":' || o.j, '"consents":' || c.j, '"metrics":' || m.j], lambda x: x IS NOT NULL), ',') || '}' AS export FROM u LEFT JOIN o USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN m USING (user_id)""")
def user_data_export(spark, sf):
    """Each customer's profile, orders, consents (for each type of event) and metrics."""
    users = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("user_id"), "o_orderkey", "o_orderstatus")
    e = read(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_type", "event_id")
    consents = e.groupBy("user_id", F.col("event_type").alias("purpose")).agg((F.count("*") % 2 == 1).alias("granted"))
    metrics = e.groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
    return exports.user_export(users, ("profile", users), ("orders", o), ("consents", consents), ("metrics", metrics))


# Relational shapes


@query("SELECT o_custkey, o_orderkey, (SELECT max(p.o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey AND (p.o_orderdate < o.o_orderdate OR p.o_orderdate = o.o_orderdate AND p.o_orderkey < o.o_orderkey) AND p.o_orderdate = (SELECT max(m.o_orderdate) FROM orders m WHERE m.o_custkey = o.o_custkey AND (m.o_orderdate < o.o_orderdate OR m.o_orderdate = o.o_orderdate AND m.o_orderkey < o.o_orderkey))) AS before FROM orders o")
def asof_previous_order(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"))
