"""Queries over texts: relevance, sentences, tags, bias, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import bias, exports, extraction, relevance
from marginalia.plans.base import SQL_SENTENCES, SQL_SIMPLE, SQL_TOPIC, SQL_WORDS, WORD, query, read
from marginalia.sources import readers

QUESTION = "ouwhea rend threlyes edoution onharent tionthe"
_QUERY_WORDS = QUESTION.split()


_TF = f"""
tokens AS (SELECT doc_id, {SQL_TOPIC} AS ts FROM documents),
each AS (SELECT doc_id, len(ts) AS total, unnest(ts) AS term FROM tokens),
tf AS (SELECT doc_id, term, count(*) / max(total) AS tf FROM each GROUP BY ALL)"""
_SCORES = f"""
q AS (SELECT unnest({_QUERY_WORDS}) AS term, {1 / len(_QUERY_WORDS)!r} AS w),
scores AS (SELECT doc_id, sum(tf * coalesce(w, 0)) / (sqrt(sum(tf * tf)) * sqrt({len(_QUERY_WORDS)} * {1 / len(_QUERY_WORDS)!r} * {1 / len(_QUERY_WORDS)!r})) AS s FROM tf LEFT JOIN q USING (term) GROUP BY doc_id)"""
_LABEL = "CASE WHEN {0} >= 0.8 THEN 'highly relevant' WHEN {0} >= 0.6 THEN 'relevant' WHEN {0} >= 0.4 THEN 'moderate' WHEN {0} >= 0.2 THEN 'low' ELSE 'minimal' END"


@query(f"""WITH {_TF}, {_SCORES}, top AS (SELECT doc_id, round(s, 4) AS score FROM scores ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, score, {_LABEL.format('score')} AS label, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM top JOIN documents USING (doc_id)""")
def tfidf_topk(spark, sf):
    return relevance.rank_passages(read(spark, sf, "documents"), QUESTION, 20)


@query(f"""WITH {_TF}, {_SCORES}, f AS (SELECT doc_id, lang, round(coalesce(s, 0), 4) AS focus_score FROM documents LEFT JOIN scores USING (doc_id))
SELECT lang, doc_id, focus_score, focus_score >= 0.5 AS should_expand, row_number() OVER (PARTITION BY lang ORDER BY focus_score DESC, doc_id) AS focus_order FROM f""")
def focus_order(spark, sf):
    return relevance.focus_order(read(spark, sf, "documents"), QUESTION)


@query(f"""WITH t AS (SELECT unnest(list_distinct({SQL_TOPIC})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT term, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 6) AS idf FROM d""")
def term_df_idf(spark, sf):
    return relevance.inverse_document_frequency(read(spark, sf, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TF} SELECT doc_id, term, round(tf, 9) AS tf FROM tf")
def term_frequency(spark, sf):
    return relevance.term_frequency(read(spark, sf, "documents")).select("doc_id", "term", F.round("tf", 9).alias("tf"))


@query(f"""WITH {_TF}, n AS (SELECT doc_id, term, count(*) AS n FROM each GROUP BY ALL),
r AS (SELECT doc_id, term, n, max(n) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM n)
SELECT doc_id, term, round(n / top, 6) AS score, rank FROM r WHERE rank <= 5""")
def keyword_norm_topk(spark, sf):
    return relevance.keywords(read(spark, sf, "documents"), 5)


@query(f"SELECT doc_id, i - 1 AS sent_id, s[i] AS sentence FROM (SELECT doc_id, {SQL_SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def sentence_split(spark, sf):
    return extraction.sentence_rows(read(spark, sf, "documents")).withColumn("sent_id", F.col("sent_id").cast("long"))


@query(f"""WITH s AS (SELECT doc_id, {SQL_SENTENCES} AS s FROM documents)
SELECT doc_id, len(s) AS sentences, true AS in_order, true AS verbatim FROM s WHERE len(s) > 0""")
def sentence_spans(spark, sf):
    docs = read(spark, sf, "documents")
    spans = extraction.sentence_spans(docs)
    ok = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("sentence")
    j = spans.join(docs.select("doc_id", "text"), "doc_id")
    starts = F.array_sort(F.collect_list(F.struct("sent_id", "start")))["start"]
    return j.groupBy("doc_id").agg(F.count("*").alias("sentences"), (F.array_sort(starts) == starts).alias("in_order"), F.bool_and(ok).alias("verbatim"))


@query(f"SELECT doc_id, len({SQL_SIMPLE}) AS n FROM documents")
def simple_sentences(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(T.simple_sentences(F.col("text"))).cast("long").alias("n"))


_SQL_TAG = f"""CASE WHEN regexp_matches(t, '^[.,;:!?]$') THEN 'PUNCT' WHEN lower(t) IN {tuple(extraction.VERBS)} THEN 'VERB' WHEN lower(t) IN {extraction.DETERMINERS} THEN 'DET'
WHEN lower(t) IN {(*extraction.PREPOSITIONS, *extraction.MORE_PREPOSITIONS)} THEN 'ADP' WHEN lower(t) IN {extraction.AUXILIARIES} THEN 'AUX' WHEN lower(t) IN {extraction.CONJUNCTIONS} THEN 'CCONJ'
WHEN regexp_matches(t, '^\\p{{Lu}}') AND i > 1 THEN 'PROPN' WHEN regexp_matches(t, '^\\p{{Lu}}') THEN 'NOUN' WHEN lower(t) LIKE '%ly' THEN 'ADV' WHEN lower(t) LIKE '%ing' OR lower(t) LIKE '%ed' THEN 'VERB' ELSE 'NOUN' END"""
_SQL_TAGGED = f"""sents AS (SELECT doc_id, unnest({SQL_SENTENCES}) AS s, generate_subscripts({SQL_SENTENCES}, 1) - 1 AS sent_id FROM documents),
toks AS (SELECT doc_id, sent_id, regexp_extract_all(s, '{WORD}(?:[\\p{{L}}\\p{{N}}\\p{{M}}_\\-]*{WORD})?|[.,;:!?]') AS ts FROM sents),
tok AS (SELECT doc_id, sent_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM toks),
tagged AS (SELECT doc_id, sent_id, i, t, {_SQL_TAG} AS tag FROM tok)"""


@query(f"WITH {_SQL_TAGGED} SELECT doc_id, tag, count(*) AS n FROM tagged GROUP BY ALL")
def pos_tags(spark, sf):
    t = extraction.tagged_tokens(extraction.sentence_rows(read(spark, sf, "documents")))
    return t.select("doc_id", F.explode("tags").alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


_SQL_DEPS = f"""{_SQL_TAGGED}, verb AS (SELECT doc_id, sent_id, min(i) AS v FROM tagged WHERE tag = 'VERB' GROUP BY ALL),
l AS (SELECT doc_id, sent_id, v, max(i) AS i FROM tagged JOIN verb USING (doc_id, sent_id) WHERE i < v AND tag IN ('NOUN', 'PROPN') GROUP BY ALL),
r AS (SELECT doc_id, sent_id, v, min(i) AS i FROM tagged JOIN verb USING (doc_id, sent_id) WHERE i > v AND tag IN ('NOUN', 'PROPN') GROUP BY ALL),
under AS (SELECT r.*, p.tag = 'ADP' AS adp FROM r JOIN tagged p ON p.doc_id = r.doc_id AND p.sent_id = r.sent_id AND p.i = r.i - 1),
deps AS (SELECT doc_id, sent_id, v AS head_idx, i AS dep_idx, 'nsubj' AS relation FROM l UNION ALL SELECT doc_id, sent_id, v, i, 'dobj' FROM under WHERE NOT adp
UNION ALL SELECT doc_id, sent_id, i - 1, i, 'pobj' FROM under WHERE adp UNION ALL SELECT doc_id, sent_id, v, i - 1, 'prep' FROM under WHERE adp)"""


@query(f"""WITH {_SQL_DEPS} SELECT d.doc_id, d.sent_id, h.t AS head, e.t AS dependent, relation FROM deps d
JOIN tagged h ON h.doc_id = d.doc_id AND h.sent_id = d.sent_id AND h.i = head_idx JOIN tagged e ON e.doc_id = d.doc_id AND e.sent_id = d.sent_id AND e.i = dep_idx""")
def dependency_edges(spark, sf):
    t = extraction.tagged_tokens(extraction.sentence_rows(read(spark, sf, "documents")))
    return extraction.dependencies(t).select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), "head", "dependent", "relation")


@query(f"""WITH {_SQL_DEPS} SELECT a.doc_id, count(*) AS relations, count(*) FILTER (WHERE b.relation = 'dobj') AS direct FROM deps a JOIN deps b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.head_idx = b.head_idx
WHERE a.relation = 'nsubj' AND b.relation IN ('dobj', 'prep') GROUP BY a.doc_id""")
def svo_relations(spark, sf):
    t = extraction.tagged_tokens(extraction.sentence_rows(read(spark, sf, "documents")))
    r = extraction.svo_relations(extraction.dependencies(t))
    return r.groupBy("doc_id").agg(F.count("*").alias("relations"), F.count_if(F.col("confidence") == 0.8).alias("direct"))


_SQL_ENTITIES = r"""ents AS (SELECT doc_id, text, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, text) AS ord FROM
(SELECT doc_id, text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{Lu}\p{L}{2,}')) AS text FROM documents) GROUP BY ALL))"""
_SQL_PAIRS = f"""{_SQL_ENTITIES}, sents AS (SELECT doc_id, unnest({SQL_SENTENCES}) AS sentence, generate_subscripts({SQL_SENTENCES}, 1) - 1 AS sent_id FROM documents),
hits AS (SELECT s.doc_id, sent_id, sentence, ord, text FROM sents s JOIN ents e ON s.doc_id = e.doc_id AND contains(lower(sentence), lower(text))),
pairs AS (SELECT a.doc_id, a.sent_id, a.sentence, a.ord AS source_ord, a.text AS source, b.ord AS target_ord, b.text AS target FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.ord < b.ord AND lower(a.text) <> lower(b.text))"""


def _pairs(spark, sf):
    docs = read(spark, sf, "documents")
    entities = extraction.capitalised_entities(docs, None)
    return extraction.pairs_in_sentence(extraction.with_verbs(extraction.sentence_hits(docs, entities)))


@query(f"WITH {_SQL_ENTITIES} SELECT doc_id, ord, text, n FROM ents WHERE ord <= 6")
def entity_topk(spark, sf):
    return extraction.capitalised_entities(read(spark, sf, "documents"), 6).select("doc_id", "ord", "text", "n")


@query(f"""WITH {_SQL_PAIRS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, least(lower(source), lower(target)), greatest(lower(source), lower(target)) ORDER BY sent_id, source_ord, target_ord) AS r FROM pairs)
SELECT doc_id, source, target, 'RELATED_TO' AS type, 0.5::DOUBLE AS confidence, substring(sentence, 1, 100) AS context FROM f WHERE r = 1""")
def cooccurrence_pairs(spark, sf):
    return extraction.cooccurrence(_pairs(spark, sf)).select("doc_id", "source", "target", "type", "confidence", "context")


_TYPES = ("PERSON", "ORGANIZATION", "TECHNOLOGY", "METHOD", "DATASET", "CONCEPT")
_VALID_SQL = ", ".join(f"('{a}', '{b}', {'true' if 'RELATED_TO' in ts else 'false'}, '{ts[0]}')" for (a, b), ts in extraction.VALID_TYPES.items())
_SQL_TYPED = f"""{_SQL_PAIRS}, v(st, tt, free, first) AS (VALUES {_VALID_SQL}),
tp AS (SELECT *, {list(_TYPES)}[(source_ord - 1) % 6 + 1] AS st, {list(_TYPES)}[(target_ord - 1) % 6 + 1] AS tt, abs(instr(lower(sentence), lower(source)) - instr(lower(sentence), lower(target))) AS gap FROM pairs),
co AS (SELECT doc_id, sent_id, source, target, CASE WHEN free THEN 'RELATED_TO' ELSE first END AS type, (least(0.95, 0.6 + CASE WHEN gap < 50 THEN 0.1 WHEN gap < 100 THEN 0.05 ELSE 0 END) * 0.7)::DOUBLE AS confidence FROM tp JOIN v USING (st, tt))"""


def _typed(spark, sf):
    kind = lambda c: F.element_at(F.array(*map(F.lit, _TYPES)), (F.col(c) - 1).cast("int") % 6 + 1)
    p = _pairs(spark, sf).withColumns({"source_type": kind("source_ord"), "target_type": kind("target_ord")})
    return p.withColumn("base", extraction.base_confidence(F.lit(0.6), F.lit(0.7), F.col("sentence"), F.col("source"), F.col("target")))


@query(f"WITH {_SQL_TYPED} SELECT doc_id, type, count(*) AS n, round(sum(confidence), 6) AS confidence FROM co GROUP BY ALL")
def typed_cooccurrence(spark, sf):
    r = extraction.typed_cooccurrence(_typed(spark, sf))
    return r.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"""WITH {_SQL_TYPED}, c AS (SELECT doc_id, source, target, type, greatest(0, least(0.99, confidence + 0.05 * (count(*) OVER (PARTITION BY doc_id, lower(source), lower(target), type) - 1))) AS confidence FROM co),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(source), lower(target), type ORDER BY confidence DESC) AS r FROM c)
SELECT doc_id, lower(source) AS source, lower(target) AS target, type, round(confidence, 6) AS confidence FROM b WHERE r = 1""")
def confidence_calibration(spark, sf):
    r = extraction.best_of_each(extraction.calibrate(extraction.typed_cooccurrence(_typed(spark, sf))))
    return r.select("doc_id", F.lower("source").alias("source"), F.lower("target").alias("target"), "type", F.round("confidence", 6).alias("confidence"))


_SQL_MATCHES = " UNION ALL ".join("SELECT doc_id, '{}' AS raw_type, unnest(regexp_extract_all(lower(text), '{}', 1)) AS m FROM documents".format(t, p.replace(r"\w", WORD)) for p, t in extraction.PATTERNS)


@query(f"WITH m AS ({_SQL_MATCHES}) SELECT doc_id, raw_type, count(*) AS n FROM m GROUP BY ALL")
def pattern_matches(spark, sf):
    return extraction.pattern_matches(read(spark, sf, "documents")).groupBy("doc_id", "raw_type").agg(F.count("*").alias("n"))


_COUNT_IN = "len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: w IN ({terms})))"
_GENDERED = ", ".join(f"'{t}'" for t in bias.GENDERED if "-" not in t)
_COMPLEX = ", ".join(f"'{t}'" for t in bias.COMPLEX if t.isalpha())
_SQL_GENDERED = _COUNT_IN.format(terms=_GENDERED)
_PAT = {c: "len(regexp_extract_all(text, '(?i)" + "|".join(ps) + "'))" for c, ps in bias.PATTERNS.items()}


@query("SELECT doc_id, {} AS gendered_language, {} FROM documents".format(_SQL_GENDERED, ", ".join(f"{s} AS {c}" for c, s in _PAT.items())))
def bias_findings(spark, sf):
    return bias.finding_counts(read(spark, sf, "documents")).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("gendered_language", *bias.PATTERNS)))


@query("SELECT doc_id, least(100, 2 * w)::DOUBLE AS bias_risk, greatest(0, 100 - least(100, 2 * w) * 0.5)::DOUBLE AS transparency FROM (SELECT doc_id, {} + 3 * ({}) AS w FROM documents)".format(_SQL_GENDERED, " + ".join(_PAT.values())))
def bias_risk(spark, sf):
    return bias.risk(bias.finding_counts(read(spark, sf, "documents")))


@query("WITH c AS (SELECT {} AS low, {} AS medium FROM documents) SELECT sum(low)::BIGINT AS low, sum(medium)::BIGINT AS medium, 0::BIGINT AS high, 0::BIGINT AS critical FROM c".format(_SQL_GENDERED, " + ".join(_PAT.values())))
def findings_by_severity(spark, sf):
    return bias.by_severity(bias.findings(read(spark, sf, "documents")))


_SQL_INCLUSIVITY = f"""b AS (SELECT doc_id, len({SQL_WORDS}) AS nw, length(regexp_replace(text, '\\s+', '', 'g')) AS letters, len({SQL_SIMPLE}) AS ns,
coalesce(list_sum(list_transform({SQL_SIMPLE}, lambda s: len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')))), 0) AS sw,
{_SQL_GENDERED} AS g, {_COUNT_IN.format(terms=_COMPLEX)} AS cx,
len(list_filter(range(1, len(tk) - 1), lambda i: tk[i] IN ('was', 'were', 'been', 'being', 'is', 'are') AND regexp_full_match(tk[i + 1], '\\s+') AND tk[i + 2] LIKE '_%ed' AND regexp_full_match(tk[i + 2], '{WORD}+'))) AS pv FROM (SELECT *, regexp_extract_all(lower(text), '{WORD}+|\\s+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]+') AS tk FROM documents)),
m AS (SELECT *, greatest(0, 100 - g / greatest(1, nw) * 1000) AS gn, letters / greatest(1, nw) AS wl, sw / greatest(1, ns) AS sl FROM b),
k AS (SELECT *, greatest(0, 100 - (wl - 4) * 10 - cx * 2) AS ac FROM m)"""


@query(f"""WITH {_SQL_INCLUSIVITY} SELECT doc_id, round(gn, 4) AS gender_neutral, round(ac, 4) AS accessible, cx AS complex_terms, round(sl, 4) AS sentence_length,
CASE WHEN sl < 15 AND wl < 5 THEN 'elementary' WHEN sl < 25 AND wl < 6 THEN 'intermediate' ELSE 'advanced' END AS reading_level,
round(pv / greatest(1, ns), 4) AS passive_ratio, round(gn * 0.3 + ac * 0.4 + greatest(0, 100 - pv / greatest(1, ns) * 50) * 0.3, 4) AS overall FROM k""")
def inclusivity(spark, sf):
    m = bias.inclusivity(read(spark, sf, "documents"))
    return m.select("doc_id", "gender_neutral", "accessible", F.col("complex_terms").cast("long").alias("complex_terms"), "sentence_length", "reading_level", "passive_ratio", "overall")


@query(f"""WITH {_SQL_INCLUSIVITY} SELECT doc_id, array_to_string(list_filter([CASE WHEN round(gn, 4) < 80 THEN 'Use gender-neutral language' END, CASE WHEN round(ac, 4) < 60 THEN 'Use simpler words' END,
CASE WHEN round(pv / greatest(1, ns), 4) > 0.5 THEN 'Prefer the active voice' END, CASE WHEN round(sl, 4) > 25 THEN 'Shorten sentences' END, CASE WHEN cx > 3 THEN 'Replace jargon' END], lambda x: x IS NOT NULL), '; ') AS advice FROM k""")
def inclusivity_advice(spark, sf):
    return bias.recommendations(bias.inclusivity(read(spark, sf, "documents")))


_HITS = " + ".join("contains(lower(text), '{}')::INT".format(w) for w in bias.POSITIVE), " + ".join("contains(lower(text), '{}')::INT".format(w) for w in bias.NEGATIVE)


@query(f"""SELECT doc_id, CASE WHEN d > 0 THEN 'positive' WHEN d < 0 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN d = 0 THEN 0.5 ELSE least(1.0, 0.6 + abs(d) * 0.05) END, 6)::DOUBLE AS score
FROM (SELECT doc_id, ({_HITS[0]}) - ({_HITS[1]}) AS d FROM documents)""")
def sentiment_keywords(spark, sf):
    s = read(spark, sf, "documents").select("doc_id", bias.sentiment(F.col("text")).alias("s"))
    return s.select("doc_id", "s.label", F.round("s.score", 6).alias("score"))


@query(r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '\n\n')) + 1 AS paragraphs FROM documents")
def text_profile(spark, sf):
    return readers.text_profile(read(spark, sf, "documents")).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("chars", "words", "paragraphs")))


@query(r"""SELECT doc_id, CASE WHEN n_chars % 100 >= 80 THEN text ELSE array_to_string(list_filter(list_transform((string_split(text, '.'))[1:50], lambda s: trim(s)), lambda s: length(s) > 20), '. ') || '.' END AS paraphrase FROM documents""")
def paraphrase(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.paraphrase(F.col("text"), F.col("n_chars") % 100).alias("paraphrase"))


_SQL_CARDS = rf"""s AS (SELECT doc_id, list_filter({SQL_SIMPLE}, lambda s: length(s) > 30)[1:3] AS ss FROM documents),
c AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS place, unnest(ss) AS sentence FROM s),
t AS (SELECT *, regexp_extract(sentence, '"([^"]+)"|([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)', 0) AS m FROM c),
card AS (SELECT doc_id, place, sentence, CASE WHEN m LIKE '"%' THEN substring(m, 2, length(m) - 2) ELSE m END AS term FROM t)"""
_SQL_CARD = "SELECT doc_id, place, CASE WHEN term <> '' THEN replace(sentence, term, '_____') ELSE 'What does this statement describe? ''' || substring(sentence, 1, 100) || '...''' END AS question, CASE WHEN term <> '' THEN term ELSE sentence END AS answer, CASE WHEN term <> '' THEN 'recall' ELSE 'concept' END AS kind FROM card"


@query(f"WITH {_SQL_CARDS} {_SQL_CARD}")
def fallback_cards(spark, sf):
    return exports.fallback_cards(read(spark, sf, "documents"), 3).withColumn("place", F.col("place").cast("long"))


def cards(spark, sf):
    """Cards of the documents, with their source and two tags."""
    docs = read(spark, sf, "documents")
    c = exports.fallback_cards(docs, 3).join(docs.select("doc_id", "lang", "source"), "doc_id")
    return c.select(F.concat_ws("-", "doc_id", "place").alias("card_id"), "question", "answer", F.when(F.col("kind") == "recall", "one term").alias("hint"), "source", F.array("lang", "kind").alias("tags"), "lang")


_SQL_DECK = f"WITH {_SQL_CARDS}, k AS ({_SQL_CARD}), d AS (SELECT doc_id || '-' || place AS card_id, question, answer, kind, source, lang FROM k JOIN documents USING (doc_id))"


@query(f"""{_SQL_DECK} SELECT card_id, question || CASE WHEN kind = 'recall' THEN chr(10) || chr(10) || '<i>Hint: one term</i>' ELSE '' END AS front, answer || chr(10) || chr(10) || '<small>Source: ' || source || '</small>' AS back, lang || ' ' || kind AS tags FROM d""")
def anki_export(spark, sf):
    return exports.anki_fields(cards(spark, sf))


@query(f"""{_SQL_DECK} SELECT card_id, '| ' || CASE WHEN length(q) > 100 THEN substring(q, 1, 97) || '...' ELSE q END || ' | ' || CASE WHEN length(a) > 100 THEN substring(a, 1, 97) || '...' ELSE a END || ' | ' || lang || ', ' || kind || ' |' AS entry
FROM (SELECT *, replace(replace(question, '|', '\\|'), chr(10), ' ') AS q, replace(replace(answer, '|', '\\|'), chr(10), ' ') AS a FROM d)""")
def markdown_table_export(spark, sf):
    return exports.table_rows(cards(spark, sf))


@query(f"""{_SQL_DECK} SELECT card_id, 'Q: ' || question || chr(10) || 'A: ' || answer || chr(10) || 'Tags: ' || lang || ', ' || kind || chr(10) AS entry FROM d""")
def anki_text_export(spark, sf):
    return exports.anki_text(cards(spark, sf))


@query(f"""{_SQL_DECK} SELECT card_id, '> [!question]- ' || question || chr(10) || CASE WHEN kind = 'recall' THEN '> *Hint: one term*' || chr(10) || '>' || chr(10) ELSE '' END || '> ' || replace(answer, chr(10), chr(10) || '> ') || chr(10) || '>' || chr(10) || '> *Source: ' || source || '*' || chr(10) || '>' || chr(10) || '> Tags: ' || lang || ', ' || kind || chr(10) AS entry FROM d""")
def callout_export(spark, sf):
    return exports.callouts(cards(spark, sf))


@query(f"{_SQL_DECK} SELECT card_id, '#flashcard' || chr(10) || question || chr(10) || '?' || chr(10) || answer || chr(10) || '#' || lang || ' #' || kind || chr(10) AS entry FROM d")
def spaced_markdown_export(spark, sf):
    return exports.spaced_markdown(cards(spark, sf))


@query(f"""{_SQL_DECK} SELECT card_id, '{{"question":' || to_json(question) || ',"answer":' || to_json(answer) || CASE WHEN kind = 'recall' THEN ',"hint":"one term"' ELSE '' END || ',"source":' || to_json(source) || ',"tags":[' || to_json(lang) || ',' || to_json(kind) || ']}}' AS entry FROM d""")
def card_json_export(spark, sf):
    return exports.card_json(cards(spark, sf))


_SQL_CLOZE = " UNION ALL ".join(
    "SELECT doc_id, {0} AS rule, generate_subscripts(m, 1) AS i, unnest(m) AS term FROM (SELECT doc_id, regexp_extract_all(text, '(?i){1}', 1) AS m FROM documents)".format(k, p.replace(r"\w", WORD)) for k, p in enumerate(T.CLOZE_PATTERNS)
)


@query(f"""WITH m AS ({_SQL_CLOZE}), u AS (SELECT doc_id, term, min(rule * 1000000 + i) AS at_ FROM m GROUP BY ALL), k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1 AS place FROM u QUALIFY place < 3),
s AS (SELECT k.*, list_filter(string_split_regex(text, '[.!?]+'), lambda x: contains(lower(x), lower(term)))[1] AS sentence FROM k JOIN documents USING (doc_id))
SELECT doc_id, place, trim(sentence[:instr(lower(sentence), lower(term)) - 1] || '{{{{c1::' || term || '}}}}' || sentence[instr(lower(sentence), lower(term)) + length(term):]) AS cloze, term AS answer FROM s WHERE sentence IS NOT NULL""")
def cloze_cards(spark, sf):
    return exports.cloze_cards(read(spark, sf, "documents")).withColumn("place", F.col("place").cast("long"))


@query()
def hashed_embeddings(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", readers.hashed_embedding(F.col("text"), 16).alias("embedding"))
