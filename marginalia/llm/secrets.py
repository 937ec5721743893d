"""Secret scans with corpus-wide ownership: DataFrame and SQL functions only.

Candidates are found by patterns and placed by the lengths of the pieces between them. Each value's hash is counted
over distinct repositories and owners: a value that many owners hold is an example; one that a single owner holds and
that looks random is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import free_names, stored

#: Kinds in their order, with pattern, the group that holds the value, and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ORDER = ("assign", "access", "hex", "live")


def _pieces(text: Column, kind: int) -> Column:
    """Matches of one kind: for each the length of the text since the match before, its own length and its value."""
    _, pattern, group, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("len"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["value"].alias("value")))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(empty)


def find(docs: DataFrame, owner: Column | str = "source", repository: Column | str | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): one row a document and one a candidate with its code-point span, joined by ``row``.

    ``owner`` and ``repository`` say whose a document is (columns or names); where a table knows no better, its source
    stands for the owner, and source and language together for the repository. Positions are running sums over a row's
    matches, so that thousands of matches in one text cost no more each.
    """
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = F.concat_ws("/", owner, F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        F.concat(*(_pieces(text, k) for k in range(len(KINDS)))).alias("found"), (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"),
    )
    rows = stored(narrow, "secrets")
    each = rows.where(F.size("found") > 0).select("row", "doc_id", "owner", "repository", F.explode("found").alias("f")).select("row", "doc_id", "owner", "repository", "f.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(so_far)
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where(F.length("value") >= least)
    return rows.drop("found"), placed.withColumn("value_hash", F.sha2("value", 256))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate hash; each level is aggregated before its shuffle.

    A missing owner or repository counts as one more, unnamed one.
    """
    named = candidates.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    by_repo = named.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_places"))


def scan(docs: DataFrame, owner: Column | str = "source", repository: Column | str | None = None, example_owners: int = 3, least_symbols: int = 8, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """A row a document with its spans, by the kinds' order at equal starts, and the spans' classes.

    A value is an ``example`` if at least ``example_owners`` owners hold it, ``live`` if one owner alone does and it has
    at least ``least_symbols`` different characters, else ``unclear``. Live values add spans of kind ``live``. Null texts
    are empty; texts without candidates have empty spans; repeated rows each keep their own.
    """
    rows, found = find(docs, owner, repository, id_col, text_col, row_col)
    found = stored(found, "secrets-found")  # a row a candidate, without texts
    owned = ownership(found)
    symbols = F.size(F.array_distinct(F.split("value", "")))
    kind = (
        F.when(F.col("n_owners") >= example_owners, "example")
        .when((F.col("n_owners") == 1) & (symbols >= least_symbols), "live").otherwise("unclear")
    )
    classed = found.join(owned, "value_hash").withColumn("class", kind)
    span = lambda start, no: F.struct(F.col(start).alias("start"), no.cast("int").alias("kind"), F.col("end").alias("end"))
    classed = classed.withColumn("value_start", F.col("end") - F.length("value"))
    live = F.lit(len(KINDS))
    per_row = classed.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)),
        F.array_sort(F.collect_list(span("start", F.col("kind")))).alias("base"),
        F.collect_set(F.when(F.col("class") == "live", span("value_start", live))).alias("added"),
        F.count_if(F.col("class") == "example").alias("n_example"),
        F.array_sort(F.collect_set(F.when(F.col("class") != "example", F.struct(F.col("value_start").alias("start"), F.col("end"))))).alias("own"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    r = rows.join(per_row, "row", "left")
    names = F.array(*map(F.lit, ORDER))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))
    base, added = F.coalesce("base", none), F.coalesce("added", none)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.select(
        "doc_id", count("n_assign"), count("n_access"), count("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.array_sort(F.concat(base, added))).alias("spans"),
        count("n_example"), F.size(added).cast("long").alias("n_live"), "own", "row",
    )


def masked(docs: DataFrame, owner: Column | str = "source", mask: str = "[secret]", text_col: str = "text", **scan_options) -> DataFrame:
    """``docs`` with every value that is not a widely copied example replaced by ``mask``; columns as before.

    Rows without such values pass as they are. Values that overlap are masked as one. The columns may have any names.
    """
    row, own = free_names(docs.columns, "row", "own")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "secrets-docs")
    found = scan(rows, owner, text_col=text_col, row_col=row, **scan_options).where(F.size("own") > 0)
    values = stored(found.select(F.col("row").alias(row), F.col("own").alias(own)), "secrets-own")
    t, none = F.col(f"`{text_col}`"), F.lit("")
    start = F.struct(none.alias("out"), F.lit(0).cast("long").alias("at"))
    between = lambda acc, s: F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.when(s["start"] < acc["at"], none).otherwise(F.concat(between(acc, s), F.lit(mask)))).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    text = F.aggregate(F.col(own), start, step, lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    new = F.when(F.col(own).isNotNull(), text).otherwise(t).alias(text_col)
    return rows.join(values, row, "left").select(*(new if c == text_col else F.col(f"`{c}`") for c in docs.columns))
