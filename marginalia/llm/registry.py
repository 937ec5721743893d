"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marginalia.llm.tokens import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars", "prefix_table")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.mixing import mix, quality_domains

    domains = quality_domains(table(spark, sf_dir, "labels"))
    return mix(table(spark, sf_dir, "documents"), domains, {"clean_high": 0.8, "clean_low": 0.15, "toxic": 0.05})


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marginalia.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("own", "row")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least_docs=10, best=10)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.resampling import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.shards import shard_table

    return shard_table(table(spark, sf_dir, "documents"), shards=16)


def queries() -> dict:
    return {f.__name__: f for f in (op11_source_divergence, op12_importance_resampling, op13_sharding, op1_source_mixing, op2_ann, op3_toxicity, op4_packing, op5_license_scan, op6_token_counts, op7_warc, op8_secret_scan, op9_near_dedup, op10_media_columns)}


SQL_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN k ON p.d = k.d AND n >= 1000"""

#: Each kind's matches with their values; places are running sums of the pieces between and the matches themselves.
_SQL_KIND = """SELECT doc_id, source, lang, {kind} AS kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS start, length(found[i]) AS n, vals[i] AS value
FROM (SELECT doc_id, source, lang, regexp_extract_all(t, {p}) AS found, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, {group}) AS vals FROM d), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)"""
_SQL_ASSIGN = "'([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)'"
SQL_SECRETS = f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
f AS ({_SQL_KIND.format(kind=0, p=_SQL_ASSIGN, group=2)} UNION ALL {_SQL_KIND.format(kind=1, p="'AKIA[A-Z0-9]+'", group=0)} UNION ALL {_SQL_KIND.format(kind=2, p="'[0-9a-f]+'", group=0)}),
c AS (SELECT *, start + n AS stop FROM f WHERE length(value) >= [6, 20, 24][kind + 1]),
o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM c GROUP BY value),
k AS (SELECT c.*, owners >= 3 AS example, owners = 1 AND len(list_distinct(string_split(value, ''))) >= 8 AS live FROM c JOIN o USING (value)),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (example) AS n_example,
string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS base FROM k GROUP BY doc_id),
a AS (SELECT DISTINCT doc_id, stop - length(value) AS start, 3 AS kind, stop FROM k WHERE live),
m AS (SELECT doc_id, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans, count(*) FILTER (kind = 3) AS n_live
FROM (SELECT doc_id, start, kind, stop FROM k UNION ALL SELECT doc_id, start, kind, stop FROM a) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: Exact: all pairs that share a shingle are counted, and components follow the links to their smallest id.
SQL_NEAR_DEDUP = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w),
cls AS (SELECT min(doc_id) AS node, any_value(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
e AS (SELECT node, len(g) AS n, unnest(g) AS x FROM cls),
p AS (SELECT a.node AS u, b.node AS v FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
reach AS (SELECT node, node AS seen FROM cls UNION SELECT r.node, b.v FROM reach r JOIN links b ON r.seen = b.u),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
of AS (SELECT s.doc_id, len(s.g) AS n, k.node FROM s LEFT JOIN cls k ON list_sort(s.g) = list_sort(k.g))
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM of LEFT JOIN c USING (node)"""


_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_DIVERGENCE = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, regexp_extract_all({_SQL_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT lang, source, row, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
lt AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lt.total, 0) AS lang_total, coalesce(gt.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN lt USING (lang) LEFT JOIN gt USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * g.v) AS p, 1 + (1000000000 * (k.n + 2)::HUGEINT) // (g.lang_total + 2 * g.v) AS q
FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(f), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN (SELECT x.lang AS l, x.source AS s, y.source AS t, (x.p - y.p) * (x.p - y.p) // (x.p + y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) ON a.lang = l AND a.source = s AND b.source = t GROUP BY ALL),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every QUALIFY part = 'pair' OR rank <= 10"""

#: CRCs by a table of 256 entries, once for each distinct word.
SQL_RESAMPLING = rf"""WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT row, unnest(ws) AS w FROM d), be AS (SELECT unnest(regexp_extract_all({_SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hexes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM e UNION SELECT w FROM be)),
b AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substring(h, i, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexes, tab),
s AS (SELECT bucket, count(*) AS s FROM e JOIN b USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM be JOIN b USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM be) + 10000)::DOUBLE))) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT row, floor(sum(gain) / count(*))::BIGINT AS weight FROM e JOIN b USING (w) JOIN gain USING (bucket) GROUP BY row),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS FIRST, weight DESC) AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM x WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r"""


def oracle_sql() -> dict:
    """SQL of the operators whose whole result SQL can say; the others are held against brute force in the tests."""
    return {"op7_warc": SQL_WARC, "op8_secret_scan": SQL_SECRETS, "op9_near_dedup": SQL_NEAR_DEDUP, "op11_source_divergence": SQL_DIVERGENCE, "op12_importance_resampling": SQL_RESAMPLING}
