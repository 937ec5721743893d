"""Column functions over text: sentences, tokens, tags, cloze terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "and", "but", "if", "or", "because", "until", "while", "this", "that", "these", "those", "it",
)
#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("et al.", "i.e.", "e.g.", "vs.")
_DOT = "․"  # stands for a protected point while sentences are split


def words(text: Column) -> Column:
    """Pieces between white space; null for null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


SENTENCE_GAP = r"(?<=[.!?])\s+"


def protected(text: Column) -> Column:
    """The text with other characters, as many, for the points of abbreviations."""
    for a in ABBREVIATIONS:
        text = F.regexp_replace(text, r"\b" + a.replace(".", r"\."), a.replace(".", _DOT))
    return text


def unprotected(text: Column) -> Column:
    return F.replace(text, F.lit(_DOT), F.lit("."))


def sentences(text: Column) -> Column:
    """Trimmed sentences, cut after . ! ? before white space; points of abbreviations don't count."""
    parts = F.transform(F.split(protected(text), SENTENCE_GAP), lambda s: F.trim(unprotected(s)))
    return F.filter(parts, lambda s: s != "")


def simple_sentences(text: Column) -> Column:
    """Trimmed runs between sentence marks."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def topic_tokens(text: Column) -> Column:
    """Lower-case words of three characters or more that aren't stop words; punctuation separates."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{3,}"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.transform(F.array(value), body)[0]


def term_counts(tokens: Column) -> Column:
    """array<struct(term, n)> of an array's distinct terms, in their order: runs of the sorted array, so nothing is shuffled."""
    none = F.array().cast("array<struct<term:string,n:int>>")

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).alias("n"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(none)


def rule_tokens(text: Column) -> Column:
    """Words (hyphens inside) and single marks."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w(?:[\w\-]*\w)?|[.,;:!?]"), F.lit(0))


def content_id(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def preview(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


#: What a cloze deletion may hide.
CLOZE_PATTERNS = (
    r'"([^"]+)"',
    r"called\s+(\w+)",
    r"known\s+as\s+(\w+)",
    r"(\w+)\s+is\s+defined",
    r"the\s+(\w+)\s+(?:process|method|technique|approach)",
)


def cloze_terms(text: Column) -> Column:
    """Distinct terms in the order of the patterns, then of the text."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in CLOZE_PATTERNS)))


def paraphrase(text: Column, complexity: Column) -> Column:
    """The text itself from complexity 80 on, else its first 50 pieces between points that are longer than 20 characters."""
    pieces = F.transform(F.slice(F.split(text, r"\."), 1, 50), lambda s: F.trim(s))
    short = F.concat(F.array_join(F.filter(pieces, lambda s: F.length(s) > 20), ". "), F.lit("."))
    return F.when(complexity >= 80, text).otherwise(short)
