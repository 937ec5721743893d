"""Packing by optimal length buckets.

Texts are cut into segments of at most ``longest`` tokens. The histogram of the segments' lengths is aggregated over all
of them; dynamic programming over it places the bucket boundaries of least padding; inside each bucket, batches are
filled up to a token budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import stored
from marginalia.llm.tokens import counter_of

SCHEMA = "doc_id long, segment int, n_tokens long, bucket int, bucket_tokens long, batch string, slot int, padding long, text string"


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """(ascending boundaries, padding) of least total padding with at most ``buckets`` buckets.

    cost[j] is the least padding of the lengths up to the j-th when a bucket ends there; a bucket over (i, j] pads each
    of its segments to the j-th length.
    """
    order = np.argsort(lengths)
    v, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n, number, total = len(v), np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(v * c)])
    if not n:
        return [], 0
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        now, choice = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            each = cost[:j] + v[j - 1] * (number[j] - number[:j]) - (total[j] - total[:j])
            i = int(each.argmin())
            if each[i] < now[j]:
                now[j], choice[j] = each[i], i
        back.append(choice)
        cost = now
    bounds, j = [], n
    for choice in reversed(back):
        if choice[j] >= 0:
            bounds.append(int(v[j - 1]))
            j = choice[j]
    return bounds[::-1], int(cost[n])


def segments(docs: DataFrame, tokenizer_path: str, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, segment, n_tokens, text): the parts of every text, whose concatenation is the text.

    Counts are the tokenizer library's for the part by itself. A document without tokens (null or blank) is one part.
    """

    @F.arrow_udf("array<struct<n:long,part:string>>")
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = counter_of(tokenizer_path)
        for texts in batches:
            ends, counts, pieces = [0], [], []
            for s in range(0, len(texts), 500):
                for t in texts.slice(s, 500).to_pylist():
                    found = counter.segments(t or "", longest)
                    counts += [n for *_, n in found]
                    pieces += [t[a:b] for a, b, _ in found] if len(found) > 1 else [None] * len(found)  # a whole text stays where it is
                    ends.append(len(counts))
            each = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(pieces, pa.string())], names=["n", "part"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), parts(F.col(text_col)).alias("parts"))
    each = cut.select("doc_id", F.when(F.size("parts") == 1, F.col("text")).alias("text"), F.posexplode_outer("parts").alias("segment", "part"))  # no part carries its whole text along; outer: no filter on the parts computes them twice
    return each.select("doc_id", "segment", F.col("part.n").alias("n_tokens"), F.coalesce("part.part", "text").alias("text"))


def pack(docs: DataFrame, tokenizer_path: str, buckets: int = 12, longest: int = 2048, budget: int = 65_536, group_batches: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a segment with its text, bucket, batch and slot.

    A document longer than ``longest`` tokens becomes several segments, so nothing is cut off. The histogram has
    ``longest`` + 1 lengths at most. A batch holds budget // bucket_tokens segments, each padded to the bucket's length.
    Segments of a bucket are dealt by hash over groups of about ``group_batches`` batches, and only the last batch of a
    group may be less than full, so no task takes a bucket. Rows are numbered, so repeated rows and null ids are dealt
    like any others.
    """
    rows = stored(segments(docs, tokenizer_path, longest, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "packing-segments")
    histogram = {r.n_tokens: r["count"] for r in rows.groupBy("n_tokens").count().collect()}  # longest + 1 rows at most
    if not histogram:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    bounds, _ = best_boundaries(list(histogram), list(histogram.values()), buckets)
    in_bucket = np.zeros(len(bounds), np.int64)
    for size, count in histogram.items():
        in_bucket[np.searchsorted(bounds, size)] += count
    rooms = np.array([max(1, budget // max(1, b)) for b in bounds])
    index = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("n_tokens")))
    at = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("bucket") + 1)
    groups = np.maximum(1, in_bucket // (rooms * group_batches))
    dealt = rows.withColumn("bucket", index).withColumn("group", F.pmod(F.xxhash64("uid"), at(groups)))
    place = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("uid")) - 1
    placed = dealt.withColumn("place", place)
    return placed.select(
        "doc_id", "segment", "n_tokens", "bucket", at(bounds).cast("long").alias("bucket_tokens"),
        F.concat_ws("-", "bucket", "group", F.floor(F.col("place") / at(rooms))).alias("batch"), (F.col("place") % at(rooms)).cast("int").alias("slot"),
        (at(bounds) - F.col("n_tokens")).alias("padding"), "text",
    )
