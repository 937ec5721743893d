"""Noun phrases, the relations that a rule parse gives between them, and patterns with more than two slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.matching import best_names, sums_before
from marginalia.operators.places import stored

#: Base forms of verbs with the relations they stand for in parse relations.
PARSE_VERBS = {
    "explain": "EXPLAINS", "describe": "EXPLAINS", "define": "EXPLAINS", "illustrate": "EXPLAINS", "clarify": "EXPLAINS",
    "cite": "CITES", "reference": "CITES", "mention": "CITES", "quote": "CITES",
    "derive": "DERIVES_FROM", "base": "DERIVES_FROM", "build": "DERIVES_FROM", "extend": "DERIVES_FROM", "develop": "DERIVES_FROM",
    "contrast": "CONTRASTS_WITH", "differ": "CONTRASTS_WITH", "oppose": "CONTRASTS_WITH", "compare": "CONTRASTS_WITH",
    "use": "USES_METHOD", "apply": "USES_METHOD", "employ": "USES_METHOD", "utilize": "USES_METHOD",
    "include": "PART_OF", "contain": "PART_OF", "comprise": "PART_OF", "consist": "PART_OF",
}
#: Noun phrases that name nothing.
EMPTY_PHRASES = ("it", "this", "that", "they")
#: Patterns over a lower-case sentence: pattern, what each slot holds, confidence.
SLOT_PATTERNS = (
    (r"(\w+(?:\s+et\s+al\.)?)\s+at\s+(\w+(?:\s+\w+)?)\s+introduced\s+(?:the\s+)?(\w+(?:\s+\w+)?)", ("author", "org", "tech"), 0.8),
    (r"(\w+(?:\s+\w+)?),?\s+introduced\s+by\s+(\w+(?:\s+et\s+al\.)?)\s+at\s+(\w+(?:\s+\w+)?)", ("tech", "author", "org"), 0.8),
    (r"(\w+),?\s+introduced\s+by\s+(\w+(?:\s+et\s+al\.)?)", ("tech", "author"), 0.7),
    (r"(\w+),?\s+developed\s+by\s+(\w+)", ("developed", "developer"), 0.7),
    (r"(\w+),?\s+created\s+by\s+(\w+)", ("created", "creator"), 0.7),
    (r"(\w+)\s+relies\s+(?:entirely\s+)?on\s+(\w+)", ("user", "used"), 0.7),
    (r"results\s+on\s+(\w+)(?:\s+and\s+(\w+))?", ("dataset", "dataset"), 0.65),
    (r"(\w+)\s+(?:on|rivals.*?on)\s+(\w+)\s+classification", ("evaluated", "dataset"), 0.7),
)
#: Relations between what two slots of one match hold.
SLOT_RELATIONS = (
    ("author", "tech", "INTRODUCES"), ("author", "org", "AFFILIATED_WITH"), ("developer", "developed", "DEVELOPS"), ("creator", "created", "CREATES"),
    ("user", "used", "USES"), ("evaluated", "dataset", "EVALUATED_ON"),
)

_LETTERS = {"DET": "D", "NOUN": "N", "PROPN": "N", "VERB": "V", "AUX": "A", "ADP": "P", "ADV": "R", "CCONJ": "C", "PUNCT": "."}


def _letters(tags: Column) -> Column:
    """The tags as a string of one letter each, over which patterns are finite-state passes."""
    table = F.create_map(*(F.lit(x) for kv in _LETTERS.items() for x in kv))
    return F.array_join(F.transform(tags, lambda t: table[t]), "")


def _chunks(tagged: DataFrame) -> Column:
    """array<struct(first, last, text)>: phrases of a determiner, if any, and nouns; places of tokens from 0."""
    s = _letters(F.col("tags"))
    z = F.arrays_zip(F.split(s, "D?N+", -1).alias("gap"), F.regexp_extract_all(s, F.lit("D?N+"), F.lit(0)).alias("m"))
    before = sums_before(F.transform(z, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
    at = lambda x, b: F.when(x["m"].isNotNull(), F.struct((b + F.length(x["gap"])).cast("int").alias("first"), F.length(x["m"]).alias("n")))
    spans = F.filter(F.zip_with(z, before, at), lambda x: x.isNotNull())
    return F.transform(spans, lambda x: F.struct(x["first"].alias("first"), (x["first"] + x["n"] - 1).alias("last"), F.array_join(F.slice("tokens", x["first"] + 1, x["n"]), " ").alias("text")))


def noun_chunks(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_id, first, last, text): noun phrases of each sentence, their words joined by one space."""
    return tagged.select(id_col, "sent_id", F.explode(_chunks(tagged)).alias("c")).select(id_col, "sent_id", "c.*")


def chunk_entities(chunks: DataFrame, least: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, text, type, confidence, n): distinct phrases (case ignored) as concepts, written as they first stand."""
    named = chunks.where((F.length("text") >= least) & ~F.lower("text").isin(*EMPTY_PHRASES))
    g = named.groupBy(id_col, F.lower("text").alias("_low")).agg(F.min(F.struct("sent_id", "first", "text")).alias("f"), F.count("*").alias("n"))
    return g.select(id_col, "f.text", F.lit("CONCEPT").alias("type"), F.lit(0.6).alias("confidence"), "n")


def _parsed(tagged: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(sentences with a head, the edge of the noun on its left, that of the phrase on its right); null edges where there are none.

    The head is the first verb, or where there is none the first auxiliary. The noun next on its left is its subject: of a
    form in -ed (or a listed one) after an auxiliary, nsubjpass, else nsubj. The last noun of the first phrase on its right
    is dobj of a verb, attr of an auxiliary, or, where the phrase follows a preposition, pobj.
    """
    t, n = F.col("tags"), F.size("tags")
    at = lambda tag: F.array_position(t, tag).cast("int")
    verb, aux = at("VERB"), at("AUX")
    head = F.when(verb > 0, verb).when(aux > 0, aux)
    s = _letters(t)
    left = F.length(F.regexp_extract(F.substring("_s", F.lit(1), F.col("_h") - 1), "^(.*)N", 0))
    rest = F.substring("_s", F.col("_h") + 1, n)
    right = F.col("_h") + F.length(F.regexp_extract(rest, "^[^N]*N+", 0))
    p = tagged.withColumns({"_s": s, "_h": head}).where(F.col("_h").isNotNull()).withColumns({"_l": left, "_r": right, "_u": F.regexp_extract(rest, "^[^N]*", 0).rlike("PD?$")})
    word = lambda i: F.element_at("tokens", i)
    low = F.lower(word(F.col("_h")))
    passive = (F.substring("_s", F.col("_h"), F.lit(1)) == "V") & (F.col("_h") > 1) & (F.substring("_s", F.col("_h") - 1, F.lit(1)) == "A") & (low.endswith("ed") | low.isin("built"))
    edge = lambda i, rel: F.struct(rel.alias("relation"), word(F.col("_h")).alias("head"), word(i).alias("dependent"), (F.col("_h") - 1).alias("head_idx"), (i - 1).alias("dep_idx"))
    subject = F.when(F.col("_l") > 0, edge(F.col("_l"), F.when(passive, "nsubjpass").otherwise("nsubj")))
    other = F.when(F.col("_u"), "pobj").when(F.substring("_s", F.col("_h"), F.lit(1)) == "A", "attr").otherwise("dobj")
    found = F.when(F.col("_r") > F.col("_h"), edge(F.col("_r"), other))
    return p, subject, found


def parse_edges(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_id, relation, head, dependent, head_idx, dep_idx), places from 0."""
    p, subject, found = _parsed(tagged)
    return p.select(id_col, "sent_id", F.explode(F.array_compact(F.array(subject, found))).alias("e")).select(id_col, "sent_id", "e.*")


def _parse_type(verb: Column) -> Column:
    """The relation of a verb's base form: the word itself, or without an ending."""
    table = F.create_map(*(F.lit(x) for kv in PARSE_VERBS.items() for x in kv))
    low = F.lower(verb)
    forms = [low, *(F.regexp_replace(low, e, w) for e, w in (("s$", ""), ("d$", ""), ("ed$", ""), ("ing$", ""), ("ing$", "e"), ("ied$", "y"), ("ies$", "y"), ("^built$", "build")))]
    return F.coalesce(*(F.try_element_at(table, f) for f in forms), F.lit("RELATED_TO"))


def parse_relations(tagged: DataFrame, entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_id, source, target, type, confidence): subject and object of one head, as whole phrases that are entities (text) of the document."""
    p, subject, found = _parsed(tagged)
    p = p.select(id_col, "sent_id", subject.alias("a"), found.alias("b"), "tags", "tokens").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    p = p.select(id_col, "sent_id", "a", "b", _chunks(p).alias("c"))
    # a token's phrase is the one that holds it, in its sentence's own row: phrases lie apart
    phrase = lambda side: F.get(F.filter("c", lambda c: (c["first"] <= F.col(f"{side}.dep_idx")) & (F.col(f"{side}.dep_idx") <= c["last"])), F.lit(0))["text"]
    r = p.select(id_col, "sent_id", phrase("a").alias("source"), phrase("b").alias("target"), _parse_type(F.col("a.head")).alias("type"))
    known = entities.select(id_col, F.lower("text").alias("_low")).distinct()
    for end in ("source", "target"):
        r = r.withColumn("_low", F.lower(end)).join(known, [id_col, "_low"], "left_semi").drop("_low")
    return r.select(id_col, "sent_id", "source", "target", "type", F.lit(0.6).alias("confidence"))


def slot_matches(sents: DataFrame, id_col: str = "doc_id", text_col: str = "sentence") -> DataFrame:
    """(id, sent_id, pattern, match, evidence, slot, word): what each slot of each match of the patterns holds; evidence is the whole match."""
    low = F.lower(text_col)

    def found(i: int, pattern: str, slots: tuple[str, ...]) -> Column:
        group = lambda k: F.regexp_extract_all(low, F.lit("(?U)" + pattern), F.lit(k))
        z = F.arrays_zip(group(0).alias("g0"), *(group(k + 1).alias(f"g{k + 1}") for k in range(len(slots))))
        held = lambda x: F.array(*(F.struct(F.lit(s).alias("slot"), x[f"g{k + 1}"].alias("word")) for k, s in enumerate(slots)))
        return F.transform(z, lambda x, n: F.struct(F.lit(i).alias("pattern"), n.alias("match"), x["g0"].alias("evidence"), held(x).alias("held")))

    every = reduce(F.concat, (found(i, p, slots) for i, (p, slots, _) in enumerate(SLOT_PATTERNS)))
    m = sents.select(id_col, "sent_id", F.explode(every).alias("m")).select(id_col, "sent_id", "m.*")
    return m.select(id_col, "sent_id", "pattern", "match", "evidence", F.explode("held").alias("h")).select("*", "h.*").drop("h").where("word <> ''")


def slot_relations(sents: DataFrame, entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_id, source, target, type, confidence, evidence): matches of several slots taken apart into pairs that share their evidence.

    entities: id, sent_id, text, type, those that stand in the sentence. A slot's word stands for the entity of the sentence
    that fits it best. Datasets without a subject of their own go to every TECHNOLOGY of the sentence.
    """
    key = [id_col, "sent_id"]
    named = stored(best_names(stored(slot_matches(sents, id_col), "slots"), entities, "word", *key), "slots")  # both are read several times
    sure = reduce(lambda c, x: c.when(F.col("pattern") == x[0], x[1][2]), enumerate(SLOT_PATTERNS), F.when(F.lit(False), 0.0))
    m = [*key, "pattern", "match", "evidence"]
    a = named.select(*m, F.col("slot").alias("a"), F.col("word_entity").alias("source"))
    b = named.select(*m, F.col("slot").alias("b"), F.col("word_entity").alias("target"))
    kinds = F.create_map(*(x for s, t, r in SLOT_RELATIONS for x in (F.lit(f"{s}>{t}"), F.lit(r))))
    pairs = a.join(b, m).withColumn("type", F.try_element_at(kinds, F.concat("a", F.lit(">"), "b"))).where(F.col("type").isNotNull())  # a match has three slots at most
    tech = entities.where("type = 'TECHNOLOGY'").select(*key, F.col("text").alias("source")).distinct()
    alone = named.where(F.col("pattern") == [s for _, s, _ in SLOT_PATTERNS].index(("dataset", "dataset")))
    data = alone.join(tech, key).select(*m, "source", F.col("word_entity").alias("target"), F.lit("EVALUATED_ON").alias("type"))
    every = pairs.select(*m, "source", "target", "type").unionByName(data).where(F.lower("source") != F.lower("target"))
    return every.select(*key, "source", "target", "type", sure.alias("confidence"), "evidence").distinct()
