"""Mixing sources to target weights by soft membership: DataFrame and SQL functions only.

A multinomial naive Bayes classifier, counted from labelled documents over hashed words whose counts differ between the
domains by more than chance, gives every document its domain posteriors; labelled documents kept out of the counts
decide how far its evidence is to be trusted. Projected-gradient least squares then fits a nonnegative rate a document,
so that the expected tokens of each domain (rate x tokens x posterior) match the targets.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_names, stored

BUCKETS = 1 << 15
_SCALE = 1_000_000  # log-probabilities are kept as whole millionths, so that sums don't depend on their order


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    return docs.select(*keep, F.explode_outer(words).alias("w")).select(*keep, F.when(F.col("w").isNotNull(), F.pmod(F.hash("w"), F.lit(BUCKETS))).alias("bucket"))


def evidence(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = 4000) -> tuple[DataFrame, list[float], list[float]]:
    """(bucket table with a column of log-ratios a domain, log priors, scale of each domain's sum of log-ratios).

    Counted on at most ``per_domain`` labelled documents of each domain, in the order of their ids' hash; the priors come
    from all labels. A bucket counts for a domain where its number there lies three deviations off what its share of all
    counted words lets expect. The scales are those of least log-loss on labelled documents of a fifth of the ids, which
    aren't counted (a quarter of ``per_domain`` at most). The table has ``BUCKETS`` rows.
    """
    labels = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    n = {r.domain: r["count"] for r in labels.groupBy("domain").count().collect()}
    out = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    k = range(len(domains))

    def some(part: DataFrame, most: int) -> DataFrame:
        each = [part.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for d in domains]
        ids = reduce(DataFrame.union, each)
        return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # as many ids as the bound

    counts = _words(some(labels.where(~out), per_domain), "domain").where(F.col("bucket").isNotNull()).groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)))
    counts = stored(counts, "mixing-counts")
    sums = counts.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in k)).first()
    whole = sum((F.col(f"n{i}") for i in k), F.lit(0)) / max(1, sum(sums))

    def ratio(i: int) -> Column:
        found, expected = F.col(f"n{i}"), whole * sums[i]
        sure = F.abs(found - expected) > 3 * F.sqrt(expected + 1)
        return F.when(sure, F.round(F.log((found + 1) / (expected + 1)) * _SCALE)).otherwise(0).cast("long").alias(f"l{i}")

    table = stored(counts.select("bucket", *map(ratio, k)).where(F.greatest(*(F.abs(f"l{i}") for i in k), F.lit(0)) > 0).coalesce(1), "mixing-table")
    total = sum(n.values()) + len(domains)
    prior = [math.log((n.get(d, 0) + 1) / total) for d in domains]
    told = stored(_summed(some(labels.where(out), per_domain // 4), table, len(domains), "domain"), "mixing-told")
    scales, steps = [1 / 16] * len(domains), (0.0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
    for i in (*k, *k):  # one domain's scale after the other, twice
        tries = [[x if j == i else scales[j] for j in k] for x in steps]
        got = told.agg(*(F.coalesce(F.sum(_loss(t, prior, domains)), F.lit(0.0)) for t in tries)).first()
        scales = min(zip(got, tries, strict=True))[1]
    return table, prior, scales


def _loss(scales: list[float], prior: list[float], domains: list[str]) -> Column:
    z = [F.col(f"s{i}") * (x / _SCALE) + prior[i] for i, x in enumerate(scales)]
    top = reduce(F.greatest, z)
    own = F.coalesce(*(F.when(F.col("domain") == d, z[i]) for i, d in enumerate(domains)))
    return F.log(sum((F.exp(x - top) for x in z), F.lit(0.0))) + top - own


def _summed(docs: DataFrame, table: DataFrame, k: int, *keep: str) -> DataFrame:
    """Tokens and sums of log-ratios of every document id; words are summed before the shuffle."""
    words = _words(docs, "doc_id", *keep).join(F.broadcast(table), "bucket", "left")  # BUCKETS rows at most
    return words.groupBy("doc_id", *keep).agg(F.count("bucket").alias("n_tokens"), *(F.coalesce(F.sum(f"l{i}"), F.lit(0)).alias(f"s{i}") for i in range(k)))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = 4000) -> DataFrame:
    """Tokens and domain posteriors of every document id.

    Rows that share an id (null ids too) are one document; a text without words has no tokens and the priors as posteriors.
    """
    table, prior, scales = evidence(docs, labelled, domains, per_domain)
    k = range(len(domains))
    scored = _summed(docs, table, len(domains))
    logits = scored.select("doc_id", "n_tokens", *((F.col(f"s{i}") * (scales[i] / _SCALE) + prior[i]).alias(f"z{i}") for i in k))
    top = F.greatest(*(F.col(f"z{i}") for i in k)) if len(domains) > 1 else F.col("z0")
    e = logits.select("doc_id", "n_tokens", *(F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in k))
    total = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return e.select("doc_id", "n_tokens", *((F.col(f"e{i}") / total).alias(f"p{i}") for i in k))


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None, tolerance: float = 1e-6, steps: int = 200, each: int = 8) -> tuple[DataFrame, list[float]]:
    """(members with their rate, the gap before each step: missing and surplus tokens over all target tokens).

    Minimises (A - T)' W (A - T) over rates of 0 or more (of ``most`` at most, if given), A being the expected domain
    tokens. Rates start at 1; a step moves each by -p . W (A - T), the gradient in the metric of the documents' tokens,
    and is projected back. W is the inverse of the second moments of the posteriors of the documents whose rate is not
    0, those of all added while a step would overshoot. Each pass over the documents aggregates one row; every ``each``
    steps the rates are written, so that their expression stays short. It ends within the tolerance, or where ``each``
    steps bring nothing more.
    """
    k = len(targets)
    p = [F.col(f"p{i}") for i in range(k)]
    n = F.col("n_tokens")
    rated, course, damp = members.withColumn("rate", F.lit(1.0)), [], 0.0
    ij = [(i, j) for i in range(k) for j in range(k)]
    whole = None
    for step in range(steps):
        row = rated.agg(
            *(F.coalesce(F.sum(n * F.col("rate") * p[i]), F.lit(0.0)).alias(f"a{i}") for i in range(k)),
            *(F.coalesce(F.sum(F.when(F.col("rate") > 0, n * p[i] * p[j])), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in ij),
        ).first()
        gap, moments = np.array(row[:k], float) - np.array(targets), np.array(row[k:], float).reshape(k, k)
        whole = moments if whole is None else whole
        course.append(float(np.abs(gap).sum() / max(sum(targets), 1e-12)))
        if course[-1] < tolerance or len(course) > each and course[-1 - each] - course[-1] < tolerance * 1e-2:
            break
        damp = 2 * damp + 0.1 if step and course[-1] > course[-2] else damp / 2
        w = np.linalg.pinv(moments + damp * whole + np.eye(k) * max(np.trace(whole), 1e-12) * 1e-9)
        moved = F.col("rate") + sum((p[i] * float(x) for i, x in enumerate(-w @ gap)), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), moved if most is None else F.least(F.lit(float(most)), moved)))
        if step % each == each - 1:
            rated = stored(rated, "mixing-rates")
    return rated, course


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_tokens: int | None = None, most: float | None = None, **classifier) -> DataFrame:
    """Posteriors, rate and whole copies of every document id, for target ``weights`` of the domains.

    The targets share ``total_tokens`` (the corpus's own tokens unless given). ``copies`` is the rate rounded up with
    the chance of its fraction, decided by the id's hash, so that its expectation is the rate. Targets that no rates can
    meet (a domain without any posterior, or a bound ``most``) are met as nearly as can be: ``gap`` says in every row
    what share of the target tokens is missing or surplus, and more than a thousandth is warned of. An empty table
    gives no rows.
    """
    domains = sorted(weights)
    members = stored(posteriors(docs.select("doc_id", "text"), labelled, domains, **classifier), "mixing-members")
    if total_tokens is None:
        total_tokens = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    share = [weights[d] / sum(weights.values()) * total_tokens for d in domains]
    rated, course = fit_rates(members, share, most)
    if total_tokens and course[-1] > 1e-3:
        warnings.warn(f"the mixture misses {course[-1]:.1%} of its target tokens", stacklevel=2)
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    best = F.greatest(*(F.col(f"p{i}") for i in range(len(domains)))) if len(domains) > 1 else F.col("p0")
    domain = F.coalesce(*(F.when(F.col(f"p{i}") == best, d) for i, d in enumerate(domains)))
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select("doc_id", "n_tokens", domain.alias("domain"), *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies.cast("long").alias("copies"), F.lit(course[-1]).alias("gap"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains of the label table: toxic, else clean of high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean_high").when(F.col("quality") == 0, "clean_low")
    return labels.select("doc_id", domain.alias("domain"))


def mixed(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as its document's copies; columns as before, whatever their names."""
    key, times, copy = free_names(docs.columns, "id", "times", "copy")
    r = rates.where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(times))
    j = docs.join(r, F.col("doc_id").eqNullSafe(F.col(key)))
    return j.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*(f"`{c}`" for c in docs.columns))
