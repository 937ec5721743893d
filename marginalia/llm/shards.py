"""K-d tree sharding: shards of nearly equal bytes that hold documents of like metadata, equal texts together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import free_names, stored
from marginalia.operators.places import with_places

PLACES, HASH_BITS, BIN_BITS = 4096, 48, 12  # a position is 12 bits of the dimension over 48 of the text's hash
_END = PLACES << HASH_BITS


def _keyed(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """The rows with their text's key (its hash: rows of one key stay together) and size in bytes plus 1."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({names[0]: F.xxhash64(text), names[1]: (F.octet_length(text) + 1).cast("long")})


def _number(kind: str) -> bool:
    return kind.split("(")[0] in {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}


def text_groups(keyed: DataFrame, key: str, size: str, dimensions: tuple[str, ...]) -> DataFrame:
    """(key, w, n, dims): one row for each text, its bytes and rows, and its places from 0 to 4095 in each dimension and in log size.

    A text's metadata are the smallest among its rows. Numbers stand on a line from the smallest to the largest, other
    values where their hash says; null stands at 0.
    """
    kinds = dict(keyed.dtypes)
    number = lambda c: _number(kinds[c])
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if number(c) else F.col(c).cast("string")
    least = [F.min(value(c)).alias(f"d{i}") for i, c in enumerate(dimensions)]
    g = keyed.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("w"), F.count("*").alias("n"), F.max(size).alias("size"), *least)
    g = stored(g, "shards-groups")
    spans = g.agg(F.lit(0).alias("_"), *(f(f"d{i}").alias(f"{f.__name__}{i}") for i, c in enumerate(dimensions) if number(c) for f in (F.min, F.max))).first()

    def place(i: int, c: str) -> Column:
        if not number(c):
            return F.pmod(F.xxhash64(f"d{i}"), F.lit(PLACES))
        low, high = spans[f"min{i}"], spans[f"max{i}"]
        return F.floor((F.col(f"d{i}") - low) / (high - low) * (PLACES - 1)) if high is not None and high > low and math.isfinite(high - low) else F.lit(0)

    dims = [F.coalesce(place(i, c).cast("int"), F.lit(0)) for i, c in enumerate(dimensions)]
    dims.append(F.least(F.lit(PLACES - 1), F.floor(F.log2("size") * (PLACES / 40))).cast("int"))
    return g.select("key", "w", "n", F.array(*dims).alias("dims"))


def _position(dim: Column) -> Column:
    return F.shiftleft(F.element_at("dims", dim + 1).cast("long"), HASH_BITS) + F.col("key").bitwiseAND((1 << HASH_BITS) - 1)


def _medians(lights: DataFrame, wanted: dict[int, tuple[int, float]], exact: float) -> dict[int, int]:
    """The cut of each node: the position below which ``wanted`` bytes (node: dimension, bytes) of it lie, to within ``exact`` bytes or one text.

    Each round sums the bytes of 4096 bins a node and keeps the bin that holds the wanted byte; where that bin is still
    too heavy, the next round parts it into 4096.
    """
    spark, cuts = lights.sparkSession, {}
    state = {node: (dim, t, 0, HASH_BITS) for node, (dim, t) in wanted.items()}  # dimension, bytes still to find, prefix, bits below it
    while state:
        asked = spark.createDataFrame([(node, dim, low, shift, float(t)) for node, (dim, t, low, shift) in state.items()], "node long, dim int, low long, shift int, t double")
        j = lights.join(F.broadcast(asked), "node").withColumn("at", _position(F.col("dim")))  # a row for each node of the level
        upper = F.call_function("shiftright", F.col("at"), F.col("shift"))
        bins = j.select("node", "w", "t", upper.alias("bin"), "low").where(F.shiftright("bin", BIN_BITS) == F.col("low")).groupBy("node", "t", "bin").agg(F.sum("w").alias("w"))
        below = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) - F.col("w")
        found = bins.withColumn("below", below).where("below < t AND t <= below + w").collect()
        after = {}
        for r in found:
            dim, t, _, shift = state.pop(r["node"])
            rest = t - r["below"]
            if r["w"] <= exact or shift == 0:
                cuts[r["node"]] = (r["bin"] + (1 if rest * 2 >= r["w"] else 0)) << shift
            else:
                after[r["node"]] = (dim, rest, r["bin"], shift - BIN_BITS)
        cuts |= {node: 0 if t <= 0 else _END for node, (_, t, *_) in state.items()}  # all or nothing is wanted
        state = after
    return cuts


def kd_tree(groups: DataFrame, shards: int, apart: tuple[int, ...] = (), fine: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(lights, heavies), each (key, shard): the leaves of a tree cut at weighted medians along the widest dimension.

    In the dimensions ``apart`` two values lie as far from each other as any: their order means nothing.
    Texts of over a hundredth of a shard, by bytes or rows, are heavy: at most 200 a shard, so they are dealt on the
    driver, and light ones fill up what is left on each side. A text as heavy as a whole shard has one of its own.
    """
    spark = groups.sparkSession
    total, rows = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    is_heavy = (F.col("w") * 100 * shards > total) | (F.col("n") * 100 * shards > rows)
    heavy = sorted(((r["w"], r["key"], r["dims"]) for r in groups.where(is_heavy).collect()), key=lambda h: (-h[0], h[1]))
    placed: dict[int, int] = {}
    rest, left = total, shards
    while heavy and left > 1 and heavy[0][0] * left >= rest:
        w, key, _ = heavy.pop(0)
        left -= 1
        placed[key], rest = left, rest - w
    lights = groups.where(~is_heavy).withColumn("node", F.lit(0).cast("long"))
    width = lambda d: F.struct(F.min(F.element_at("dims", d + 1)).alias("lo"), F.max(F.element_at("dims", d + 1)).alias("hi")).alias(f"s{d}")
    n_dims = len(groups.select("dims").first()["dims"]) if total else 0
    nodes, leaves, depth = {0: (0, left, heavy)}, {}, 0
    while nodes and total:
        stats = {r["node"]: r for r in lights.groupBy("node").agg(F.sum("w").alias("w"), *map(width, range(n_dims))).collect()}
        wanted, halves = {}, {}
        for node, (first, k, held) in nodes.items():
            if k == 1:
                leaves[node] = first
                placed |= {key: first for _, key, _ in held}
                continue
            s = stats.get(node)
            wide = lambda d: s[f"s{d}"]["hi"] - s[f"s{d}"]["lo"] if s else 0  # noqa: E731, B023
            span = lambda d: (PLACES if d in apart and wide(d) else wide(d), -d)  # noqa: E731, B023
            dim, kl = max(range(n_dims), key=span), (k + 1) // 2
            light, at = s["w"] if s else 0, sorted(held, key=lambda h: (h[2][dim], h[1]))  # noqa: B023
            sums = [0]
            for h in at:
                sums.append(sums[-1] + h[0])
            cut = min(range(len(sums)), key=lambda i: abs(sums[i] - sums[-1] * kl / k))  # noqa: B023
            wanted[node] = (dim, min(light, max(0.0, (light + sums[-1]) * kl / k - sums[cut])))
            halves[node] = ((first, kl, at[:cut]), (first + kl, k - kl, at[cut:]))
        cuts = _medians(lights, wanted, fine * total / shards) if wanted else {}
        if cuts:
            table = spark.createDataFrame([(node, wanted[node][0], cut) for node, cut in cuts.items()], "node long, dim int, cut long")
            side = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + (_position(F.col("dim")) >= F.col("cut")).cast("long"))
            lights = lights.join(F.broadcast(table), "node", "left").withColumn("node", side).drop("dim", "cut")
            depth += 1
            if depth % 8 == 0:
                lights = stored(lights, "shards-nodes")
        nodes = {2 * node + 1 + i: half for node, pair in halves.items() for i, half in enumerate(pair)}
    names = spark.createDataFrame(list(leaves.items()), "node long, shard int")
    heavies = spark.createDataFrame(list(placed.items()), "key long, shard int")
    return lights.join(F.broadcast(names), "node").select("key", "shard"), heavies  # a row for each shard


def _assigned(keyed: DataFrame, rows: DataFrame, key: str, size: str, dimensions: tuple[str, ...], shards: int | None, target_bytes: int | None) -> DataFrame:
    """``rows`` with the shard of their key; heavy texts come by broadcast, so no key of the shuffled join is hot."""
    groups = stored(text_groups(keyed, key, size, dimensions), "shards-texts")
    if shards is None:
        if not target_bytes or target_bytes < 1:
            raise ValueError("say shards or target_bytes")
        shards = max(1, math.ceil((groups.agg(F.sum("w")).first()[0] or 0) / target_bytes))
    kinds = dict(keyed.dtypes)
    lights, heavies = kd_tree(groups, shards, tuple(i for i, c in enumerate(dimensions) if not _number(kinds[c])))
    few = F.broadcast(heavies.withColumnRenamed("key", key))  # at most 200 a shard
    many = rows.join(few, key, "left_anti").join(lights.withColumnRenamed("key", key), key)
    return rows.join(few, key).unionByName(many)


def sharded(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("lang", "source", "doc_id"), text_col: str = "text") -> DataFrame:
    """The documents with ``shard``: ``shards`` of them, or as many as bring each one near to ``target_bytes``.

    Sizes are UTF-8 bytes plus 1. Rows of equal text share a shard; null text counts as empty text. Null metadata stand at
    0, repeated rows count each time, an empty table gives no rows, and there may be fewer texts than shards (some stay
    empty). A text as heavy as a shard, copies together, fills one alone, and the others share what is left. A column
    named ``shard`` is replaced.
    """
    key, size = free_names(docs.columns, "_key", "_size")
    keyed = _keyed(docs, text_col, [key, size])
    return _assigned(keyed, keyed.drop("shard"), key, size, dimensions, shards, target_bytes).drop(key, size)


def shard_table(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("lang", "source", "doc_id"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each document; slots count from 0 in each shard, in the order of ids.

    As ``sharded``; only sizes, checksums and hashes of the texts are shuffled. Among equal ids, and null ones (first),
    slots go by checksum and size.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), *dict.fromkeys(c for c in dimensions if c != id_col), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_crc"), F.xxhash64(text).alias("_key"))
    slim = stored(slim, "shards-rows")
    every = _assigned(slim, slim.select("_id", "_size", "_crc", "_key"), "_key", "_size", tuple("_id" if c == id_col else c for c in dimensions), shards, target_bytes).drop("_key")
    placed = with_places(every, "shard", "_id", "_crc", "_size", keep=lambda df: stored(df, "shards-places"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
