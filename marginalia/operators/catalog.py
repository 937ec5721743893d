"""The document catalogue: listing, search, existence, keyed updates, and a fluent query builder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.text import content_id, word_count

#: Labels and relationship names that need no further test.
NODE_LABELS = ("Concept", "Method", "Person", "Author", "Entity", "Definition", "Paper", "Dataset", "Organization", "Location", "Event", "Term", "Topic")
RELATIONSHIPS = (
    "RELATES_TO", "DEFINES", "CREATED_BY", "CITED_BY", "CITES", "DEPENDS_ON", "EXPLAINS", "CONTAINS", "PART_OF", "AUTHORED_BY",
    "PUBLISHED_IN", "REFERENCES", "SIMILAR_TO", "DERIVED_FROM", "INFLUENCES", "PRECEDES", "FOLLOWS",
)
IDENTIFIER = "^[A-Za-z][A-Za-z0-9_]*$"


def content_addressed(docs: DataFrame, catalogue: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each content, under its hash; contents that ``catalogue`` (content_id) has are left out.

    Only hashes and ids are shuffled; the smallest id stands for its copies.
    """
    d = docs.select(content_id(F.col(text_col)).alias("content_id"), F.col(id_col).alias("first_id"), word_count(F.col(text_col)).alias("word_count"))
    out = d.groupBy("content_id").agg(F.min("first_id").alias("first_id"), F.max("word_count").alias("word_count"), F.count("*").alias("copies"))
    return out if catalogue is None else out.join(catalogue.select("content_id"), "content_id", "left_anti")


def contains_any(columns: list[str], term: str, case_sensitive: bool = False) -> Column:
    """Whether one of the columns holds the term; false for nulls."""
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    return reduce(lambda a, b: a | b, [F.coalesce(fold(c).contains(term if case_sensitive else term.lower()), F.lit(False)) for c in columns])


def search(df: DataFrame, columns: list[str], term: str, case_sensitive: bool = False) -> DataFrame:
    """Rows whose text columns hold the term; unknown columns are passed over, none left finds nothing."""
    known = [c for c in columns if c in df.columns]
    return df.where(contains_any(known, term, case_sensitive)) if known else df.limit(0)


def search_nodes(nodes: DataFrame, query: str, limit: int, limit_first: bool = False) -> DataFrame:
    """Nodes whose label holds the query; ``limit_first`` cuts before filtering, as a store that filters late would."""
    hit = F.lower("label").contains(query.lower())
    ordered = nodes.orderBy("node_id")
    return ordered.limit(limit).where(hit) if limit_first else nodes.where(hit).orderBy("node_id").limit(limit)


def page(df: DataFrame, number: int, size: int, *order: Column | str, largest: int = 100) -> DataFrame:
    """Rows of a page (from 1); ``order`` must decide ties. Sizes are held between 1 and ``largest``."""
    size, number = max(1, min(size, largest)), max(1, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """Rows and pages in all."""
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("total_pages"))


def exists(df: DataFrame, **equal) -> bool:
    """Whether a row has all the given values; false without any known column."""
    known = {k: v for k, v in equal.items() if k in df.columns}
    return bool(known) and not df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in known.items()])).limit(1).isEmpty()


def merge_update(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Values of ``updates`` over those of ``df`` by key, where they are given; keys unknown to ``df`` change nothing."""
    new = [c for c in updates.columns if c != key and c in df.columns]
    u = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in new))
    return df.join(u, df[key] == u["_key"], "left").select(*(F.coalesce(f"_new_{c}", df[c]).alias(c) if c in new else df[c] for c in df.columns))


def add_to_arrays(df: DataFrame, additions: DataFrame, key: str, array: str) -> DataFrame:
    """The array column united with the additions of the same key."""
    a = additions.groupBy(F.col(key).alias("_key")).agg(F.flatten(F.collect_list(array)).alias("_more"))
    joined = F.array_union(F.coalesce(df[array], F.array()), F.coalesce("_more", F.array()))
    return df.join(a, df[key] == a["_key"], "left").select(*(F.array_sort(joined).alias(array) if c == array else df[c] for c in df.columns))


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def get_or_create(df: DataFrame, wanted: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """A row for each wanted key: the one there is, or a new one with the defaults; ``created`` tells which."""
    have = df.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in defaults))
    w = wanted.select(key).distinct()
    return w.join(have, w[key] == have["_key"], "left").select(key, *(F.when(F.col("_key").isNull(), d).otherwise(F.col(f"_{c}")).alias(c) for c, d in defaults.items()), F.col("_key").isNull().alias("created"))


def latest(df: DataFrame, keys: list[str], *newest_first: Column | str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).where("_n = 1").drop("_n")


def valid_identifier(name: Column, allowed: tuple[str, ...] = NODE_LABELS) -> Column:
    """Not empty, and on the list or shaped like an identifier."""
    return F.coalesce((name != "") & (name.isin(*allowed) | name.rlike(IDENTIFIER)), F.lit(False))


class Query:
    """Conditions, search, order, limit and offset, put on a table when it is built. Unknown columns are passed over."""

    def __init__(self, df: DataFrame):
        self.df, self.conditions, self.keys, self._limit, self._offset, self.loads = df, [], [], None, None, []

    def filter(self, *conditions: Column) -> Query:
        self.conditions += conditions
        return self

    def filter_by(self, **equal) -> Query:
        return self.filter(*(F.col(k) == v for k, v in equal.items() if k in self.df.columns))

    def search(self, columns: list[str], term: str, case_sensitive: bool = False) -> Query:
        known = [c for c in columns if c in self.df.columns]
        return self.filter(contains_any(known, term, case_sensitive)) if term and known else self

    def order_by(self, column: str, descending: bool = False) -> Query:
        if column in self.df.columns:
            self.keys.append(F.desc(column) if descending else F.asc(column))
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        self._offset = n
        return self

    def load(self, children: DataFrame, key: str, name: str) -> Query:
        """Child rows of the same key as an array of structs."""
        self.loads.append((children, key, name))
        return self

    def build(self) -> DataFrame:
        out = self.df
        for c in self.conditions:
            out = out.where(c)
        for children, key, name in self.loads:
            rest = [c for c in children.columns if c != key]
            out = out.join(children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
        if self.keys:
            out = out.orderBy(*self.keys)
        if self._offset:
            out = out.offset(self._offset)
        return out if self._limit is None else out.limit(self._limit)

    def count(self) -> int:
        return self.build().count()

    def first(self):
        return self.build().first()

    def paginate(self, number: int, size: int) -> tuple[DataFrame, int]:
        whole = self.build()
        return whole.offset((max(1, number) - 1) * size).limit(size), whole.count()
