"""Source divergence audit: how far each source's words lie from those of the other sources of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = TERM.replace("[^", "[")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): a term's occurrences in a group, and its documents; a text is split once.

    Each row gives all its terms and, marked, its distinct ones, which partial sums fold before the shuffle. What matches
    ``TERM`` is what stands between the matches of its complement, by which texts are split several times faster.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    whole = text("text")
    low = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))  # the same for ASCII, and faster
    terms = F.split(low, _BETWEEN)
    both = docs.select(text("lang"), text("source"), terms.alias("terms")).select("lang", "source", F.explode(F.array(F.struct("terms", F.lit(0).alias("mark")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(1).alias("mark")))).alias("x"))
    each = both.select("lang", "source", F.explode("x.terms").alias("term"), "x.mark").where("term <> ''")  # before the first and after the last separator
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("mark")).alias("n"), F.sum("mark").cast("long").alias("df"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exactly."""
    top, low = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, low)


def _distance(p: str, q: str) -> Column:
    p, q = F.col(p), F.col(q)
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_docs: int = 10, best: int = 10, salts: int = 16) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance to the other sources of its language, and its ``best`` own terms.

    docs: lang, source, text. Null text, lang or source counts as empty; a repeated row is one more document; a group
    without terms still stands, with smoothed shares; a language without a kept term has distances of 0 and no terms; an
    empty table gives no rows; ties go to the smaller item in UTF-8 order. All arithmetic is on integers.

    The kept vocabulary of a language meets its groups by (lang, salt), so that no language is one task; zeros are filled
    in, and the dense table joins itself on (lang, term), each pair of sources once, summed before it is shuffled.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least_docs).drop("df"), "divergence-kept")
    sparse = stored(counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "divergence-sparse")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct().join(langs, "lang", "left").join(sparse.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", zero("kept"), zero("lang_total"), zero("total")), "divergence-groups")

    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    vocabulary = kept.select("lang", "term", F.col("total").alias("lang_n"), F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int").alias("salt"))
    every = vocabulary.join(salted, ["lang", "salt"]).join(sparse, ["lang", "source", "term"], "left")
    p = _share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("kept"))
    dense = stored(every.select("lang", "source", "term", F.coalesce("n", F.lit(0)).alias("n"), p.alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "divergence-dense")

    a = dense.select("lang", "term", F.col("source").alias("a"), "p")
    b = dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
    sums = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(_distance("p", "q")).alias("value"))
    none = groups.where("kept = 0")
    flat = none.select("lang", F.col("source").alias("a")).join(none.select("lang", F.col("source").alias("b")), "lang").where("a < b").withColumn("value", F.lit(0).cast("long"))
    side = lambda s, t: F.struct(F.col(s).alias("source"), F.col(t).alias("item"))
    pairs = sums.unionByName(flat).select("lang", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x"), "value").select("lang", "x.*", F.lit("pair").alias("part"), "value")
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), F.lit("term").alias("part"), _distance("p", "q").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).unionByName(terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
