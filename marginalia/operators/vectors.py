"""Exact vector search over array columns; tombstones and metadata are honoured before the top k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, d: s + d)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def upsert(store: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """New vectors over stored ones of the same id."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def knn(store: DataFrame, query: list[float], k: int, where: Column | None = None, deleted: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest to one query by squared distance, score 1 / (1 + d); ties to the smaller id."""
    s = store
    if deleted is not None:
        s = s.where(~deleted)
    if where is not None:
        s = s.where(where)
    d = squared_l2(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return s.withColumn("distance", d).orderBy("distance", key).limit(k).select(key, "distance", (1 / (1 + F.col("distance"))).alias("score"))


def knn_batch(store: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048, by_cosine: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank) for every query row, exactly; ties to the smaller id.

    The distance is the squared one, or with ``by_cosine`` one less the cosine (a zero vector is at distance 1). Blocks of
    queries meet blocks of the store's rows on a grid of keys, one pair of blocks a key, and are compared as matrices;
    each pair hands on the ``k`` best of its queries.
    """
    n_blocks = lambda n: max(1, -(-n // block))
    nq, ns = n_blocks(queries.count()), n_blocks(store.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda df, id_name, blocks, name: df.select(F.col(key).cast("long").alias(id_name), F.col(vector).alias(f"{name}v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name)).groupBy(name).agg(F.collect_list(id_name).alias(id_name), F.flatten(F.collect_list(f"{name}v")).alias(f"{name}v"))
    left, right = part(queries, "qid", nq, "qb").withColumn("sb", every(ns)), part(store, "sid", ns, "sb").withColumn("qb", every(nq))
    pairs = left.join(right, ["sb", "qb"]).select("qid", "qbv", "sid", "sbv")

    def unit(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches):
        for t in batches:
            for qid, qv, sid, sv in zip(*(t.column(c).to_pylist() for c in ("qid", "qbv", "sid", "sbv")), strict=True):
                x, y, ids = np.array(qv, float).reshape(len(qid), -1), np.array(sv, float).reshape(len(sid), -1), np.array(sid)
                if by_cosine:
                    x, y = unit(x), unit(y)
                for q, row in zip(qid, x, strict=True):
                    d = 1 - y @ row if by_cosine else ((y - row) ** 2).sum(1)
                    top = np.lexsort((ids, d))[:k]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array([q] * len(top), pa.int64()), "vec_id": pa.array(ids[top]), "distance": pa.array(d[top])})

    near = pairs.mapInArrow(run, "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Store:
    """A table of vectors with one interface for adding, searching, deleting and a health report; each call gives a new store."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        self.rows, self.key, self.vector = rows, key, vector

    def add(self, new: DataFrame) -> Store:
        return Store(upsert(self.rows, new, self.key), self.key, self.vector)

    def delete(self, where: Column) -> Store:
        """Without the rows that the condition surely holds for."""
        return Store(self.rows.where(~F.coalesce(where, F.lit(False))), self.key, self.vector)

    def search(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        return knn(self.rows, query, k, where, None, self.key, self.vector)

    def health(self) -> DataFrame:
        """Vectors, distinct ids and lengths in one row."""
        return self.rows.agg(F.count("*").alias("vectors"), F.count_distinct(self.key).alias("ids"), F.min(F.size(self.vector)).alias("least_length"), F.max(F.size(self.vector)).alias("most_length"))
