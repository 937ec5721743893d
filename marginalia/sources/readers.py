"""Sources: tables, stored payloads, scheduler states, citation items, and an optional document parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def binary_documents(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[str, int, str, list[str]]]) -> DataFrame:
    """(path, doc_id, text, pages, title, authors) of files; ``parse`` gives text, pages, title and authors of one.

    A file that can't be parsed keeps its row with an empty text.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((p, *parse(bytes(data))))
                except Exception:  # a damaged file fails in its parser's own ways
                    rows.append((p, "", 0, "", []))
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "title", "authors"])

    files = spark.read.format("binaryFile").load(path)
    ids = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("doc_id"))
    return files.select("path", "content").mapInPandas(run, "path string, text string, pages int, title string, authors array<string>").join(ids, "path")


def plain_text(data: bytes) -> tuple[str, int, str, list[str]]:
    """Parser of text files: pages are parted by form feeds, the first line is the title."""
    text = data.decode("utf-8", "replace")
    return text, text.count("\f") + 1, text.split("\n", 1)[0].strip(), []


def scheduler_states(spark: SparkSession, path: str) -> DataFrame:
    """Card states from JSON lines of {card_id: state}."""
    state = "struct<ease:double,interval:int,repetitions:int,reviews:int,correct:int,next_review:timestamp>"
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{state}>")).alias("card_id", "s")).select("card_id", "s.*")


def citation_items(raw: DataFrame) -> DataFrame:
    """Items with authors as (last, first), the date or year as text, and the journal or venue.

    raw: title, authors (``Last, First`` or ``First Last``), date, year, journal, venue, and others as they are.
    """
    author = lambda a: F.when(a.contains(","), F.struct(F.trim(F.split_part(a, F.lit(","), F.lit(1))).alias("last"), F.trim(F.split_part(a, F.lit(","), F.lit(2))).alias("first"))).otherwise(F.struct(F.element_at(F.split(F.trim(a), r"\s+"), -1).alias("last"), F.array_join(F.slice(F.split(F.trim(a), r"\s+"), 1, F.greatest(F.lit(0), F.size(F.split(F.trim(a), r"\s+")) - 1)), " ").alias("first")))
    return raw.withColumns({"authors": F.transform("authors", author), "date": F.coalesce("date", F.col("year").cast("string")), "journal": F.coalesce("journal", "venue")})


def text_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Characters, words and paragraphs."""
    t = F.col(text_col)
    return docs.select(id_col, F.length(t).alias("chars"), F.regexp_count(t, F.lit(r"\S+")).alias("words"), (F.regexp_count(t, F.lit("\n\n")) + 1).alias("paragraphs"))


def link_lookup(entities: DataFrame, links: DataFrame, by: str = "text") -> DataFrame:
    """External link of each entity by its name (case ignored): offline stand-in of encyclopedia and paper lookups."""
    known = links.select(F.lower("title").alias("_t"), "url").groupBy("_t").agg(F.min("url").alias("url"))
    return entities.join(known, F.lower(by) == F.col("_t"), "left").drop("_t")


def salvage_json(text, schema: str):
    """An array of JSON from a model's answer: fences off, else the outermost brackets."""
    bare = F.regexp_replace(text, r"(?s)```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), schema)


def hashed_embedding(text, dim: int = 64):
    """A deterministic embedding: signed counts of hashed words over their norm."""
    ws = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hit = lambda i: F.aggregate(ws, F.lit(0.0), lambda a, w: a + F.when(F.pmod(F.xxhash64(w), F.lit(dim)) == i, F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), hit)
    return F.transform(raw, lambda x: (x / F.greatest(F.lit(1e-12), F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, y: a + y * y)))).cast("float"))


def with_provider(df: DataFrame, provider: Callable[[list[dict]], list[dict]], schema: str, batch: int = 10) -> DataFrame:
    """Rows sent in batches through a plug-in (a model's client); it returns rows of ``schema``."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = b.to_dict("records")
            for s in range(0, len(rows), batch):
                yield pd.DataFrame(provider(rows[s : s + batch]))

    return df.mapInPandas(run, schema)
