"""Property graphs as node and edge tables: edits, traversal, citation trees, metrics.

Iterative operators write each level to the checkpoint folder where one is set, so that a lost executor costs a reread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators.places import stored


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder if the session has one; else keep the level's rows for the next one."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def node_id(text: Column) -> Column:
    return F.substring(F.md5(F.lower(text)), 1, 12)


def build(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from entities (text, type) and relations (source, target, type, weight); self loops and unknown ends go."""
    nodes = entities.select(node_id(F.col("text")).alias("node_id"), F.col("text").alias("label"), "type").groupBy("node_id").agg(F.min("label").alias("label"), F.min("type").alias("type"))
    e = relations.select(node_id(F.col("source")).alias("src"), node_id(F.col("target")).alias("dst"), "type", "weight").where("src <> dst")
    known = lambda c: nodes.select(F.col("node_id").alias(c))
    return nodes, e.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and all edges at them removed. gone: node_id."""
    g = gone.select("node_id").distinct()
    e = edges.join(g.withColumnRenamed("node_id", "src"), "src", "left_anti").join(g.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), e


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.unionByName(new.join(nodes.select("node_id"), "node_id", "left_anti"))


def _directed(edges: DataFrame, direction: str, types: list[str] | None) -> DataFrame:
    e = edges if types is None else edges.where(F.col("type").isin(types))
    e = e.select(F.col("edge_id"), F.col("src").alias("a"), F.col("dst").alias("b"))
    back = e.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return e if direction == "out" else back if direction == "in" else e.unionByName(back)


def traverse(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(start, node): ends of paths of 1 to ``depth`` edges, none used twice on a path (nodes may be). starts: node.

    With one direction, whether a walk of distinct edges ends at a node does depend on its path, so paths carry their
    edges; ``depth`` is at most 5.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    e = _directed(edges, direction, types)
    paths = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array().cast("array<string>").alias("used"))
    ends = None
    for _ in range(depth):
        step = paths.join(e, paths["at"] == e["a"]).where(~F.array_contains("used", F.col("edge_id").cast("string")))
        paths = step.select("start", F.col("b").alias("at"), F.array_append("used", F.col("edge_id").cast("string")).alias("used"))
        found = paths.select("start", F.col("at").alias("node"))
        ends = found if ends is None else ends.unionByName(found)
    return ends.distinct()


def distances(edges: DataFrame, starts: DataFrame, cutoff: int, direction: str = "out") -> DataFrame:
    """(start, node, depth): fewest edges to every node within ``cutoff``; the start itself at 0. starts: node."""
    e = _directed(edges, direction, None).select("a", "b").distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, cutoff + 1):
        step = frontier.join(e, frontier["node"] == e["a"]).select("start", F.col("b").alias("node")).distinct()
        frontier = _cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def capped_tree(edges: DataFrame, root: str, depth: int, fan_out: int, order: str = "dst") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a breadth-first citation tree: at most ``fan_out`` edges a node, depth of the first visit.

    Edges to nodes that were visited before are kept too.
    """
    w = Window.partitionBy("src").orderBy(order, "dst")
    e = edges.select("src", "dst").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= fan_out).drop("_n")
    nodes = edges.sparkSession.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"))
    frontier, taken = nodes, None
    for d in range(1, depth + 1):
        step = _cut(frontier.join(e, frontier["node"] == e["src"]).select("src", "dst", F.lit(d).alias("level")))
        taken = step if taken is None else taken.unionByName(step)
        frontier = step.select(F.col("dst").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        nodes = nodes.unionByName(frontier)
    return nodes, taken


def shortest_path(edges: DataFrame, source: str, target: str, most: int, fan_out: int = 20) -> DataFrame:
    """One row with the nodes of a shortest outgoing path, or none; ties to the smaller nodes."""
    w = Window.partitionBy("src").orderBy("dst")
    e = edges.select("src", "dst").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= fan_out).select("src", "dst")
    paths = edges.sparkSession.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("at"))
    seen = paths.select("at")
    found = paths.where(F.col("at") == target)
    for _ in range(most):
        step = paths.join(e, paths["at"] == e["src"]).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))
        paths = _cut(step.join(seen, "at", "left_anti").groupBy("at").agg(F.min("path").alias("path")).select("path", "at"))
        seen = seen.unionByName(paths.select("at"))
        found = found.unionByName(paths.where(F.col("at") == target))
    return found.select("path", (F.size("path") - 1).alias("hops")).orderBy("hops", "path").limit(1)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In- and out-degree over distinct ordered pairs, and centrality (in + out) / (n - 1); nodes without edges have 0."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.agg(F.count("*").alias("n"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = nodes.select("node_id").join(d, "node_id", "left").select("node_id", z("in_degree"), z("out_degree")).crossJoin(F.broadcast(n))  # one row
    return j.select("node_id", "in_degree", "out_degree", F.round((F.col("in_degree") + F.col("out_degree")) / F.greatest(F.lit(1), F.col("n") - 1), 9).alias("centrality"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    m = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    n = nodes.agg(F.count("*").alias("nodes"))
    d = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.crossJoin(m).select("nodes", "edges", F.round(d, 9).alias("density"))  # one row each


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable when directions are ignored; by large and small stars."""
    spark = edges.sparkSession
    e = _cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = None
    while True:  # each round at least halves what is left of the longest path
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        j = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = _cut(j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    return nodes.select("node_id").join(roots, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))


def _levels(e: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Forward rounds: level d holds (g, source, node, paths) for nodes whose shortest paths from the source have d edges, with their number."""
    levels = [stored(sources.select("g", F.col("node").alias("source"), "node", "times", F.lit(1.0).alias("paths")), "paths")]
    seen = levels[0].select("g", "source", "node")
    step = e.select("g", F.col("src").alias("node"), "dst")
    while True:
        ahead = levels[-1].join(step, ["g", "node"]).groupBy("g", "source", F.col("dst").alias("node")).agg(F.first("times").alias("times"), F.sum("paths").alias("paths"))
        level = stored(ahead.join(seen, ["g", "source", "node"], "left_anti"), "paths")
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = seen.unionByName(level.select("g", "source", "node"))


def _dependencies(e: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Backward rounds: (g, node, x), how much of each source's shortest paths to other nodes runs through the node, times the nodes that the source stands for."""
    below, parts = levels[-1].withColumn("x", F.lit(0.0)), []
    back = e.select("g", F.col("dst").alias("node"), "src")
    for level in reversed(levels[1:-1]):
        share = below.join(back, ["g", "node"]).groupBy("g", "source", F.col("src").alias("node")).agg(F.sum((1 + F.col("x")) / F.col("paths")).alias("share"))
        below = stored(level.join(share, ["g", "source", "node"], "left").select("g", "source", "node", "times", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("x")), "paths")
        parts.append(below.groupBy("g", "node").agg(F.sum(F.col("x") * F.col("times")).alias("x")))
    return reduce(DataFrame.unionByName, parts) if parts else levels[0].select("g", "node", F.lit(0.0).alias("x")).limit(0)


def _twins(e: DataFrame, nodes: DataFrame, most: int = 16) -> DataFrame:
    """(g, node, times): the nodes as sources, where one stands for all that no edge leads to and whose edges go to the same nodes (``most`` at most)."""
    into = e.select("g", F.col("dst").alias("node")).distinct()
    few = e.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") <= most).join(into, ["g", "node"], "left_anti")
    alike = e.withColumnRenamed("src", "node").join(few.select("g", "node"), ["g", "node"], "left_semi").groupBy("g", "node").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    merged = alike.groupBy("g", "to").agg(F.min("node").alias("node"), F.count("*").alias("times")).select("g", "node", "times")
    return nodes.join(few.select("g", "node"), ["g", "node"], "left_anti").select("g", "node", F.lit(1).cast("long").alias("times")).unionByName(merged)


def betweenness(edges: DataFrame, group: str | None = None, sample: float | None = None, block: int = 1000, seed: int = 1) -> DataFrame:
    """(group, node, betweenness[, error]): the share of shortest directed paths that run through each node, over (n - 1)(n - 2).

    edges: src, dst and perhaps ``group``, whose graphs stand apart. Shortest paths are counted level by level from many
    sources at once and their shares summed level by level back, all by joins on (source, node); ``block`` sources at a time
    bound what is kept (block x nodes rows). All nodes are sources, those that no edge leads to and whose few edges go to
    the same nodes once, with their number; or the ``sample`` share of them that a hash with the seed picks: then the sums are scaled up, and ``error`` is the standard error of the estimate. Loops and repeated edges
    count nothing; a graph of one or two nodes has 0; an empty table gives no rows.
    """
    e = stored(edges.select((F.col(group) if group else F.lit(0)).alias("g"), "src", "dst").where("src <> dst").distinct(), "edges")
    ends = edges.select((F.col(group) if group else F.lit(0)).alias("g"), F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").isNotNull()).distinct()
    nodes = stored(ends, "nodes")
    picked = F.lit(True) if sample is None else F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000)) < int(sample * 1_000_000)
    # a sample's error comes from the spread between blocks of single sources, so there each stands for itself
    sources = stored(_twins(e, nodes), "sources") if sample is None else nodes.where(picked).withColumn("times", F.lit(1).cast("long"))
    blocks = -(-sources.count() // block)
    sums = []
    for i in range(blocks):
        some = sources.where(F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.lit(blocks)) == i)
        sums.append(_dependencies(e, _levels(e, some)).withColumn("block", F.lit(i)))
    size = nodes.groupBy("g").agg(F.count("*").alias("n"), F.count_if(picked).alias("m"))
    scale = F.col("n") / F.col("m") / F.greatest(F.lit(1), (F.col("n") - 1) * (F.col("n") - 2))
    j = nodes.join(size, "g")
    if not sums:
        return j.select(*([F.col("g").alias(group)] if group else []), "node", F.lit(0.0).alias("betweenness")).limit(0 if sample is None else 2**31 - 1)
    through = reduce(DataFrame.unionByName, sums).groupBy("g", "node", "block").agg(F.sum("x").alias("x")).groupBy("g", "node").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("k"))
    j = j.join(through, ["g", "node"], "left")
    out = [F.coalesce(F.col("x") * scale, F.lit(0.0)).alias("betweenness")]
    if sample is not None:  # from the spread between blocks of sources
        spread = F.greatest(F.lit(0.0), F.col("xx") - F.col("x") * F.col("x") / blocks) * blocks / F.greatest(F.lit(1), F.lit(blocks - 1))
        out.append((F.sqrt(F.coalesce(spread, F.lit(0.0))) * scale).alias("error") if blocks > 1 else F.lit(None).cast("double").alias("error"))
    return j.select(*([F.col("g").alias(group)] if group else []), "node", *out)


def top_bridges(between: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nodes through which most shortest paths run, of those that any runs through; ties to the smaller node."""
    return between.where(F.round("betweenness", 12) > 0).orderBy(F.desc(F.round("betweenness", 12)), "node").limit(k).select("node", F.round("betweenness", 9).alias("betweenness"))


def top_central(degrees: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nodes with the highest degree centrality; ties to the smaller node."""
    return degrees.orderBy(F.desc("centrality"), "node_id").limit(k)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges whose ends are both kept. keep: node."""
    k = keep.select("node").distinct()
    return edges.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi")


def type_histogram(df: DataFrame, column: str = "type") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def delete_documents(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Nodes of the documents removed, and all edges of theirs or at such nodes. nodes, edges: ``key``; gone: ``key``."""
    g = gone.select(key).distinct()
    dead = nodes.join(g, key, "left_semi").select("node_id")
    alive = edges.join(g, key, "left_anti") if key in edges.columns else edges
    return delete_nodes(nodes, alive, dead)
