"""Registration of queries with their SQL, and the inputs that several queries derive from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD = r"[\p{L}\p{N}\p{M}_]"
#: SQL forms of column functions.
SQL_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
SQL_TOPIC = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], w))"
SQL_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
SQL_SIMPLE = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '')"


def query(sql: str | None = None):
    """Register the function under its name, with SQL for the oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Card reviews: a card for each user and event type, quality from the value."""
    return events(spark, sf).select("event_id", "ts", F.concat_ws(":", "user_id", "event_type").alias("card_id"), (F.floor("value").cast("int") % 6).alias("quality"))


SQL_REVIEWS = "reviews AS (SELECT event_id, ts, user_id || ':' || event_type AS card_id, CAST(floor(value) AS INTEGER) % 6 AS quality FROM events)"
