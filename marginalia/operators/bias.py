"""Bias audits of texts: sentiment by keywords, gendered terms, patterns, inclusivity, risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import simple_sentences

#: Words and patterns of the audit.
POSITIVE = ("good", "great", "excellent", "positive", "beneficial", "helpful")
NEGATIVE = ("bad", "poor", "negative", "harmful", "problematic", "concerning")
GENDERED = {
    "he": "they", "she": "they", "his": "their", "her": "their", "him": "them", "himself": "themselves",
    "herself": "themselves", "mankind": "humankind", "manmade": "artificial", "fireman": "firefighter",
    "policeman": "police officer", "chairman": "chairperson", "businessman": "businessperson", "man-hours": "person-hours",
    "manpower": "workforce",
}
PATTERNS = {
    "gender": [r"\bmen are\b", r"\bwomen are\b", r"\bgirls are\b", r"\bboys are\b", r"\btypically male\b", r"\btypically female\b"],
    "racial": [r"\bill?egals?\b", r"\balien\b", r"\bexotic\b"],
    "ageism": [r"\bold people are\b", r"\byoung people are\b", r"\belderly\b", r"\bsenile\b", r"\bover the hill\b"],
    "ableism": [r"\bcrippled?\b", r"\blame\b", r"\bhandicapped\b", r"\bsuffering from\b", r"\bconfined to\b", r"\bwheelchair.?bound\b"],
}
#: What a text holds, in small letters, if a category's patterns can match; it spares most texts the patterns.
STEMS = {
    "gender": ("men are", "girls are", "boys are", "typically male", "typically female"),
    "racial": ("legal", "alien", "exotic"),
    "ageism": ("people are", "elderly", "senile", "over the hill"),
    "ableism": ("cripple", "lame", "handicapped", "suffering from", "confined to", "wheelchair"),
}
COMPLEX = ("paradigm", "synergy", "leverage", "utilize", "operationalize", "methodology", "heretofore", "aforementioned", "notwithstanding", "pursuant", "vis-à-vis", "ergo", "ipso facto")
PASSIVE = r"(?iU)\b(was|were|been|being|is|are)\s+\w+ed\b"
WEIGHTS = {"low": 1, "medium": 3, "high": 7, "critical": 15}


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def _words_among(low: Column, tokens: Column, terms) -> Column:
    """How often whole words (and listed phrases) of small letters stand in a text; phrases are sought where they can be."""
    single = [t for t in terms if t.isalpha()]
    found = F.size(F.filter(tokens, lambda t: t.isin(*single)))
    for t in set(terms) - set(single):
        found = found + F.when(low.contains(t), _count(low, rf"(?U)\b{t}\b")).otherwise(0)
    return found


def sentiment(text: Column) -> Column:
    """struct(label, score) from how many of the positive and negative words stand in the text."""
    low = F.lower(text)
    hits = lambda ws: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in ws])
    d = hits(POSITIVE) - hits(NEGATIVE)
    label = F.when(d > 0, "positive").when(d < 0, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.when(d == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.6 + F.abs(d) * 0.05)).alias("score"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each category and match: what was found, how it is rated, and the text around it."""
    rules = [("gendered_language", rf"(?iU)\b{t}\b", "low", 30) for t in GENDERED]
    rules += [(c, "(?iU)" + p, "medium", 50) for c, ps in PATTERNS.items() for p in ps]
    text = F.coalesce(F.col(text_col), F.lit(""))

    def found(category: str, pattern: str, severity: str, around: int) -> Column:
        near = F.regexp_extract_all(text, F.lit(f"(?isU).{{0,{around}}}?" + pattern[5:]), F.lit(0))
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        each = F.transform(hits, lambda h, i: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), h.alias("matched"), F.coalesce(F.try_element_at(near, i + 1), h).alias("excerpt")))
        return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<category:string,severity:string,matched:string,excerpt:string>>"))

    parts = [found(*r) for r in rules]
    return docs.select(id_col, F.explode(F.concat(*parts)).alias("f")).select(id_col, "f.*")


def finding_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings by category for each document: words are counted among the tokens, patterns sought where their stems stand."""
    low = docs.select(id_col, F.col(text_col).alias("text"), F.lower(text_col).alias("low"))
    low = low.withColumn("tokens", F.regexp_extract_all("low", F.lit(r"(?U)\w+"), F.lit(0)))
    cols = [F.coalesce(_words_among(F.col("low"), F.col("tokens"), GENDERED), F.lit(0)).alias("gendered_language")]
    for c, ps in PATTERNS.items():
        there = reduce(lambda a, b: a | b, [F.col("low").contains(x) for x in STEMS[c]])
        cols.append(F.when(there, _count(F.col("text"), "(?iU)" + "|".join(ps))).otherwise(0).alias(c))
    return low.select(id_col, *cols)


def inclusivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gender neutrality, accessibility, passive voice, lengths, reading level and their blend."""
    low = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = low.withColumn("low", F.lower("text")).withColumn("tokens", F.regexp_extract_all("low", F.lit(r"(?U)\w+"), F.lit(0)))
    t, low_text, tokens = F.col("text"), F.col("low"), F.col("tokens")
    base = low.select(
        id_col, _count(t, r"\S+").alias("n_words"), F.length(F.translate(t, " \t\n\x0b\f\r", "")).alias("letters"),
        F.size(simple_sentences(t)).alias("n_sentences"), _count(t, r"[^\s.!?]+").alias("sentence_words"),
        _words_among(low_text, tokens, GENDERED).alias("gendered"), _words_among(low_text, tokens, COMPLEX).alias("complex_terms"),
        F.when(F.exists(tokens, lambda w: w.endswith("ed")), _count(t, PASSIVE)).otherwise(0).alias("passives"),
    )
    one = lambda c: F.greatest(F.lit(1), F.col(c))
    step = base.withColumns({
        "gender_neutral": F.greatest(F.lit(0.0), 100 - F.col("gendered") / one("n_words") * 1000),
        "word_length": F.col("letters") / one("n_words"), "sentence_length": F.col("sentence_words") / one("n_sentences"),
        "passive_ratio": F.col("passives") / one("n_sentences"),
    })
    step = step.withColumn("accessible", F.greatest(F.lit(0.0), 100 - (F.col("word_length") - 4) * 10 - F.col("complex_terms") * 2))
    level = (
        F.when((F.col("sentence_length") < 15) & (F.col("word_length") < 5), "elementary")
        .when((F.col("sentence_length") < 25) & (F.col("word_length") < 6), "intermediate").otherwise("advanced")
    )
    overall = F.col("gender_neutral") * 0.3 + F.col("accessible") * 0.4 + F.greatest(F.lit(0.0), 100 - F.col("passive_ratio") * 50) * 0.3
    r = lambda c: F.round(c, 4)
    return step.select(id_col, r("gender_neutral").alias("gender_neutral"), r("accessible").alias("accessible"), "complex_terms", r("passive_ratio").alias("passive_ratio"), r("sentence_length").alias("sentence_length"), level.alias("reading_level"), r(overall).alias("overall"))


def risk(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Risk min(100, 2 x weighted findings) and transparency max(0, 100 - risk / 2)."""
    weight = F.col("gendered_language") * WEIGHTS["low"] + reduce(lambda a, b: a + b, [F.col(c) for c in PATTERNS]) * WEIGHTS["medium"]
    score = F.least(F.lit(100), weight * 2)
    return counts.select(id_col, score.cast("double").alias("bias_risk"), F.greatest(F.lit(0.0), 100 - score * 0.5).alias("transparency"))


def recommendations(metrics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Advice that a document's metrics call for."""
    advice = F.array_compact(F.array(
        F.when(F.col("gender_neutral") < 80, "Use gender-neutral language"),
        F.when(F.col("accessible") < 60, "Use simpler words"),
        F.when(F.col("passive_ratio") > 0.5, "Prefer the active voice"),
        F.when(F.col("sentence_length") > 25, "Shorten sentences"),
        F.when(F.col("complex_terms") > 3, "Replace jargon"),
    ))
    return metrics.select(id_col, F.array_join(advice, "; ").alias("advice"))


def by_severity(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS))
