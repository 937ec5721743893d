"""Term statistics, TF-IDF relevance and keyword ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import preview, term_counts, topic_tokens
from marginalia.operators.places import with_places


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, total, terms): each document's topic terms counted in its own row."""
    t = docs.select(id_col, topic_tokens(F.col(text_col)).alias("tokens"))
    return t.select(id_col, F.size("tokens").alias("total"), term_counts(F.col("tokens")).alias("terms"))


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, n): how often each topic term stands in a row's text; no shuffle."""
    return _counted(docs, id_col, text_col).select(id_col, F.explode("terms").alias("t")).select(id_col, "t.term", F.col("t.n").cast("long").alias("n"))


def term_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Share of each term in its row's text; no shuffle."""
    return _counted(docs, id_col, text_col).select(id_col, "total", F.explode("terms").alias("t")).select(id_col, "t.term", (F.col("t.n") / F.col("total")).alias("tf"))


def inverse_document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1 of every term."""
    n = docs.agg(F.count("*").alias("n_docs"))
    df = docs.select(F.explode(F.array_distinct(topic_tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def cosine_to_query(docs: DataFrame, query: str, idf: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cosine of TF-IDF vectors between each document and a query; idf 1 for all terms unless given.

    With idf 1, norms and products are sums over each row's own terms, so nothing is shuffled; rows without terms go.
    """
    spark = docs.sparkSession
    q = term_frequency(spark.createDataFrame([(0, query)], f"{id_col} long, {text_col} string"), id_col, text_col)
    if idf is None:
        weights = {r.term: r.tf for r in q.collect()}  # as many rows as the query has words
        norm = sum(v * v for v in weights.values()) ** 0.5
        each = _counted(docs, id_col, text_col).where("total > 0")
        weight = lambda t: reduce(lambda w, kv: w.when(t == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
        dot = F.aggregate(F.filter("terms", lambda x: x["term"].isin(*weights)), F.lit(0.0), lambda a, x: a + x["n"] * weight(x["term"])) if weights else F.lit(0.0)
        square = F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["n"])
        return each.select(id_col, (dot / (F.sqrt(square) * norm) if norm else F.lit(0.0)).alias("tfidf"))
    wq = q.join(idf, "term", "left").select("term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("wq"))
    wd = term_frequency(docs, id_col, text_col).join(idf, "term", "left").withColumn("wd", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norm = wq.agg(F.sqrt(F.sum(F.col("wq") ** 2)).alias("nq"))
    joined = wd.join(F.broadcast(wq), "term", "left").groupBy(id_col).agg(F.sum(F.col("wd") * F.coalesce("wq", F.lit(0.0))).alias("dot"), F.sum(F.col("wd") ** 2).alias("sq"))
    return joined.crossJoin(F.broadcast(norm)).select(id_col, F.when((F.col("sq") > 0) & (F.col("nq") > 0), F.col("dot") / (F.sqrt("sq") * F.col("nq"))).otherwise(0.0).alias("tfidf"))


def combined(tfidf, semantic=None):
    """0.3 TF-IDF and 0.7 semantic, or TF-IDF alone where there is no model."""
    return tfidf if semantic is None else 0.3 * tfidf + 0.7 * semantic


def relevance_label(score):
    return F.when(score >= 0.8, "highly relevant").when(score >= 0.6, "relevant").when(score >= 0.4, "moderate").when(score >= 0.2, "low").otherwise("minimal")


def rank_passages(docs: DataFrame, query: str, k: int = 10, idf: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` most relevant passages with a short preview; ties to the smaller id."""
    scored = cosine_to_query(docs, query, idf, id_col, text_col).withColumn("score", F.round("tfidf", 4))
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return docs.join(F.broadcast(top), id_col).select(id_col, "score", relevance_label(F.col("score")).alias("label"), preview(F.col(text_col), 200).alias("preview"))  # k rows


def focus_order(docs: DataFrame, query: str, threshold: float = 0.5, group: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections in the order of focus inside each group, and whether each should be expanded."""
    scored = docs.select(id_col, group).join(cosine_to_query(docs, query, None, id_col, text_col), id_col, "left")
    scored = scored.withColumn("focus_score", F.round(F.coalesce("tfidf", F.lit(0.0)), 4))
    placed = with_places(scored.select(group, id_col, "focus_score"), group, F.desc("focus_score"), id_col, name="_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))  # places run through the groups one after another
    j = placed.join(first, placed[group].eqNullSafe(first[group])).drop(first[group])
    return j.select(group, id_col, "focus_score", (F.col("focus_score") >= threshold).alias("should_expand"), (F.col("_place") - F.col("_first") + 1).alias("focus_order"))


def keywords(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Most frequent topic terms of each row's text, frequencies over the largest one; ranked inside the row."""
    most = F.slice(F.sort_array(F.transform("terms", lambda x: F.struct((-x["n"]).alias("less"), x["term"].alias("term")))), 1, k)
    ranked = _counted(docs, id_col, text_col).select(id_col, most.alias("most")).select(id_col, F.get("most", F.lit(0))["less"].alias("top"), F.posexplode("most").alias("place", "m"))
    return ranked.select(id_col, "m.term", F.round(F.col("m.less") / F.col("top"), 6).alias("score"), (F.col("place") + 1).alias("rank"))
