"""Credibility of papers from citations, venue, age and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Venues that count as high impact, and the weights of the parts.
VENUES = ("nature", "science", "cell", "lancet", "nejm", "jama", "pnas", "acm", "ieee", "neurips", "icml")
WEIGHTS = {"citation": 0.30, "venue": 0.25, "author": 0.15, "recency": 0.15, "altmetric": 0.15}


def _ladder(value: Column, steps: list[tuple[float, float]], other: float) -> Column:
    """The score of the first bound that the value reaches."""
    out = None
    for bound, score in steps:
        out = (F if out is None else out).when(value >= bound, score)
    return out.otherwise(other)


def citation_score(count: Column, year: Column, now: int) -> Column:
    rate = count / F.when(year.isNull() | (year == 0), 5).otherwise(F.greatest(F.lit(1), F.lit(now) - year))
    return F.when(count == 0, 20.0).otherwise(_ladder(rate, [(50, 95.0), (20, 85.0), (5, 70.0), (1, 50.0)], 30.0))


def venue_score(venue: Column, impact: Column, reviewed: Column) -> Column:
    base = 30.0 + F.when(reviewed, 20.0).otherwise(0.0) + F.when(impact > 10, 40.0).when(impact > 5, 30.0).when(impact > 2, 20.0).when(impact > 1, 10.0).otherwise(0.0)
    known = F.exists(F.array(*map(F.lit, VENUES)), lambda v: F.lower(venue).contains(v))
    return F.least(F.lit(100.0), F.when(F.coalesce(known, F.lit(False)), F.least(F.lit(95.0), base + 20)).otherwise(base))


def recency_score(year: Column, now: int) -> Column:
    age = F.lit(now) - year
    s = F.when(age <= 1, 95.0).when(age <= 3, 85.0).when(age <= 5, 75.0).when(age <= 10, 60.0).when(age <= 20, 45.0).otherwise(30.0)
    return F.when(year.isNull() | (year == 0), 50.0).otherwise(s)


def attention_score(attention: Column) -> Column:
    s = _ladder(attention, [(1000, 95.0), (500, 85.0), (100, 70.0), (50, 60.0), (20, 50.0), (5, 35.0)], 20.0)
    return F.when(attention.isNull() | (attention == 0), 0.0).otherwise(s)


def level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").when(score >= 20, "low").otherwise("unknown")


def credibility(papers: DataFrame, now: int, works: DataFrame | None = None, attention: DataFrame | None = None, id_col: str = "paper_id") -> DataFrame:
    """Overall score of each paper; retracted ones score 0.

    papers: id, citations, year, venue. works (id, impact, reviewed, retracted) and attention (id, attention) may lack rows.
    """
    p = papers
    if works is not None:
        p = p.join(works, id_col, "left")
    if attention is not None:
        p = p.join(attention, id_col, "left")
    get = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in p.columns else F.lit(d)
    parts = {
        "citation": citation_score(get("citations", 0), F.col("year"), now),
        "venue": venue_score(F.col("venue"), get("impact", 0.0), get("reviewed", False)),
        "author": F.lit(50.0), "recency": recency_score(F.col("year"), now), "altmetric": attention_score(get("attention", 0)),
    }
    s = p.select(id_col, *(v.alias(f"{k}_score") for k, v in parts.items()), get("retracted", False).alias("retracted"))
    overall = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    s = s.withColumn("overall", F.round(F.when(F.col("retracted"), 0.0).otherwise(overall), 6))
    return s.withColumn("level", level(F.col("overall")))


def compared(scores: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Papers from the most credible on, ties to the smaller id; a range sort, so no task takes all rows."""
    return scores.orderBy(F.desc("overall"), id_col)
