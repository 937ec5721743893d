"""How good extracted relations and graphs are: lenient recall, meaningful shares, coherence of types, coverage of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relations that make sense from one entity type to another, and the credit of all others.
SENSIBLE = {("PERSON", "TECHNOLOGY"): ("ENABLES", "RELATED_TO"), ("METHOD", "TECHNOLOGY"): ("PART_OF", "USES", "RELATED_TO")}
GENERIC_CREDIT, OTHER_CREDIT = 0.5, 0.7


def lenient(found: DataFrame, expected: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(each expected relation with how it was met, a document's shares).

    found, expected: source, target, type (case of names ignored). Met is ``exact``, ``partial`` (another type), ``reversed``
    or ``missed``; recall counts all but missed ones, precision the share of found relations that say more than RELATED_TO.
    Documents with only found or only expected relations stand too, with 0 for what they lack.
    """
    ends = [F.lower("source"), F.lower("target")]
    both = ends[0].isNotNull() & ends[1].isNotNull()  # least and greatest pass over nulls
    pair = [F.when(both, F.least(*ends)).alias("_x"), F.when(both, F.greatest(*ends)).alias("_y")]
    forth = (ends[0] <= ends[1]).alias("forth")
    # one row for each pair of names, whatever its direction: all that was found between them
    f = found.select(id_col, *pair, F.struct(forth, "type").alias("way")).groupBy(id_col, "_x", "_y").agg(F.collect_set("way").alias("ways"))
    e = expected.select(id_col, "source", "target", "type", *pair, forth).distinct().join(f, [id_col, "_x", "_y"], "left")
    same = F.exists("ways", lambda w: w["forth"] == F.col("forth"))
    exact = F.exists("ways", lambda w: (w["forth"] == F.col("forth")) & (w["type"] == F.col("type")))
    # names that differ in nothing but case stand in both directions, and so exactly or partially
    how = F.when(exact, "exact").when(same, "partial").when(F.col("ways").isNotNull(), "reversed").otherwise("missed")
    met = e.select(id_col, "source", "target", "type", how.alias("met"))
    recall = met.groupBy(id_col).agg((F.count_if(F.col("met") != "missed") / F.count("*")).alias("recall"))
    precise = found.groupBy(id_col).agg((F.count_if(F.col("type") != "RELATED_TO") / F.count("*")).alias("precision"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return met, recall.join(precise, id_col, "full").select(id_col, share("recall"), share("precision"))


def credit(source_type: Column, target_type: Column, relation: Column) -> Column:
    """What a relation counts towards coherence: 1 or 0 where its types have sensible relations, else half for RELATED_TO and 0.7."""
    c = F.when(F.lit(False), 0.0)
    for (a, b), good in SENSIBLE.items():
        c = c.when((source_type == a) & (target_type == b), F.when(relation.isin(*good), 1.0).otherwise(0.0))
    return c.when(relation == "RELATED_TO", GENERIC_CREDIT).otherwise(OTHER_CREDIT)


def coherence(relations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, relations, meaningful, ratio) from type, source_type and target_type."""
    c = credit(F.col("source_type"), F.col("target_type"), F.col("type"))
    g = relations.groupBy(id_col).agg(F.count("*").alias("relations"), F.round(F.sum(c), 6).alias("meaningful"))
    return g.withColumn("ratio", F.round(F.col("meaningful") / F.col("relations"), 6))


def coverage(nodes: DataFrame, terms: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, covered): the share of the terms that some label of the document's graph holds, case ignored."""
    hit = [F.max(F.lower("label").contains(t.lower()).cast("int")) for t in terms]
    total = hit[0]
    for h in hit[1:]:
        total = total + h
    return nodes.groupBy(id_col).agg(F.round(total / len(terms), 6).alias("covered"))


def type_accuracy(nodes: DataFrame, checks: list[tuple[str, str]], id_col: str = "doc_id") -> DataFrame:
    """(id, accuracy): for how many terms the first node (by ``ord``) that holds the term has the type it should have."""
    right = [F.coalesce(F.min_by(F.col("type") == kind, F.when(F.lower("label").contains(term.lower()), F.col("ord"))), F.lit(False)).cast("int") for term, kind in checks]
    total = right[0]
    for r in right[1:]:
        total = total + r
    return nodes.groupBy(id_col).agg(F.round(total / len(checks), 6).alias("accuracy"))


def graph_quality(nodes: DataFrame, relations: DataFrame, terms: list[str], checks: list[tuple[str, str]], id_col: str = "doc_id") -> DataFrame:
    """(id, covered, accuracy, ratio, overall): 0.4 coverage, 0.3 accuracy, 0.3 coherence; what a document lacks is 0."""
    parts = coverage(nodes, terms, id_col).join(type_accuracy(nodes, checks, id_col), id_col).join(coherence(relations, id_col).select(id_col, "ratio"), id_col, "left")
    ratio = F.coalesce("ratio", F.lit(0.0))
    tenths = (4 * F.col("covered") + 3 * F.col("accuracy") + 3 * ratio).cast("decimal(18,6)")  # exact, so that halves round up
    return parts.select(id_col, "covered", "accuracy", ratio.alias("ratio"), F.round(tenths * F.lit(0.1).cast("decimal(2,1)"), 3).cast("double").alias("overall"))


def type_coherence(relations: DataFrame, valid: DataFrame, most: int = 50, id_col: str = "doc_id") -> DataFrame:
    """(id, precision): of the first ``most`` relations (by ``rank``), the share whose type the pair of types allows, or RELATED_TO.

    valid: source_type, target_type, type.
    """
    w = Window.partitionBy(id_col).orderBy("rank")
    first = relations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    v = valid.select("source_type", "target_type", "type").distinct().withColumn("ok", F.lit(1))
    j = first.join(F.broadcast(v), ["source_type", "target_type", "type"], "left")  # some fifty rows
    return j.groupBy(id_col).agg(F.round(F.count_if(F.col("ok").isNotNull() | (F.col("type") == "RELATED_TO")) / F.count("*"), 6).alias("precision"))
