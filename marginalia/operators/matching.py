"""Names in texts, points in intervals and the best row before a place: each in one pass, without pairs that are no hits."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _automaton(names: list[str]):
    """An automaton over the distinct names that aren't empty; each gives its length and its places in the list."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for j, name in enumerate(names):
        if name:
            places.setdefault(name, []).append(j)
    a = ahocorasick.Automaton()
    for name, js in places.items():
        a.add_word(name, (len(name), js))
    if places:
        a.make_automaton()
    return a


def occurrences(a, text: str, mode: str) -> dict[int, list[int]]:
    """{name: its starts} in the text: ``all`` of them, those ``apart`` from the same name's, or the ``longest`` that overlap with no longer name's.

    Of equally long names the one that comes first in the list wins, then the place further left.
    """
    found: dict[int, list[int]] = {}
    if not len(a):
        return found
    if mode == "longest":
        spots = sorted((-n, j, end + 1 - n) for end, (n, js) in a.iter(text) for j in js)
        starts, ends = [], []  # of what is taken, in the text's order
        for less, j, start in spots:
            i = bisect_left(starts, start)
            if (i == len(starts) or starts[i] >= start - less) and (i == 0 or ends[i - 1] <= start):
                starts.insert(i, start)
                ends.insert(i, start - less)
                found.setdefault(j, []).append(start)
        return found
    for end, (n, js) in a.iter(text):
        for j in js:
            at = found.setdefault(j, [])
            if mode == "all" or not at or at[-1] + n <= end + 1 - n:
                at.append(end + 1 - n)
    return found


def _lists(lengths: list[int], values: pa.Array) -> pa.ListArray:
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


# Spark infers from an explode that its array isn't empty and would compute it a second time for that filter; what is
# marked nondeterministic is computed once.


def _scanner(kind: T.DataType, mode: str):
    hit = T.StructType().add("name", kind).add("starts", T.ArrayType(T.IntegerType()))

    @F.arrow_udf(T.ArrayType(T.ArrayType(hit)))
    def scan(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lows, names in columns:
            flat, base = names.flatten(), 0
            per_row, per_text, taken, per_name, starts = [], [], [], [], []
            for ts, ns in zip(texts.to_pylist(), lows.to_pylist(), strict=True):
                a = _automaton(ns or [])
                for t in ts or []:
                    found = occurrences(a, t or "", mode)
                    per_text.append(len(found))
                    for j in sorted(found):
                        taken.append(base + j)
                        per_name.append(len(found[j]))
                        starts += found[j]
                per_row.append(len(ts or []))
                base += len(ns or [])
            hits = pa.StructArray.from_arrays([flat.take(pa.array(taken, pa.int64())), _lists(per_name, pa.array(starts, pa.int32()))], ["name", "starts"])
            yield _lists(per_row, _lists(per_text, hits))

    return scan.asNondeterministic()


def hits(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", mode: str = "all") -> DataFrame:
    """(id, place, text's columns, found): the names of its own document in each text, case ignored; texts without one go.

    texts: id and ``texts``, an array of structs with ``sentence`` and whatever belongs to it; names: id, ``text`` and more
    columns, ``ord`` deciding their order where there is one. found: array of (name: all columns of ``names``, starts:
    code points from 0). A document's automaton is built once and each of its texts is read once, so the work is the text
    and its hits. Empty names are found nowhere.
    """
    first = [c for c in ("ord", "text") if c in names.columns]
    payload = F.struct(*first, *(c for c in names.columns if c not in (*first, id_col)))
    listed = names.where(F.col("text").isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(payload)).alias("_names"))
    kind = listed.schema["_names"].dataType.elementType
    j = texts.select(id_col, F.col("texts").alias("_texts")).join(listed, id_col)
    low = lambda c, f: F.transform(c, lambda x: F.lower(x[f]))
    found = _scanner(kind, mode)(low("_texts", "sentence"), low("_names", "text"), F.col("_names"))
    z = j.select(id_col, F.explode(F.arrays_zip(F.col("_texts").alias("t"), found.alias("found"))).alias("z"))
    return z.select(id_col, "z.t.*", "z.found").where(F.size("found") > 0)


@F.arrow_udf(T.ArrayType(T.StructType().add("w", T.StringType()).add("text", T.StringType())))
def _best_names(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For each word the name that equals it, or holds it or is held by it: the longest, then the largest."""
    for words, names, lows in columns:
        out = []
        for ws, ns, ls in zip(words.to_pylist(), names.to_pylist(), lows.to_pylist(), strict=True):
            rank = [(len(n), n) for n in ns]
            best: dict[str, tuple] = {}

            def offer(w: str, j: int, equal: bool, rank=rank, best=best) -> None:
                key = (equal, *rank[j])
                if w not in best or key > best[w]:
                    best[w] = key

            inside = _automaton(ls)
            if len(inside):
                for w in ws:
                    for _, (n, js) in inside.iter(w):
                        for j in js:
                            offer(w, j, n == len(w))
            around = _automaton(ws)
            if len(around):
                for j, low in enumerate(ls):
                    for _, (_, places) in around.iter(low):
                        offer(ws[places[0]], j, len(ws[places[0]]) == len(low))
            out.append([{"w": w, "text": key[2]} for w, key in best.items()])
        yield pa.array(out, pa.list_(pa.struct([("w", pa.string()), ("text", pa.string())])))


def best_names(words: DataFrame, names: DataFrame, word: str, *keys: str) -> DataFrame:
    """Words with the name that fits each one best among those with the same keys, as ``{word}_entity``; words without one go.

    Equal (case ignored) first, then the longest name that holds the word or is held by it, then the largest. Two automata
    a key, over the names and over the distinct words, find all of them in one pass each. Empty words fit nothing.
    """
    w = words.groupBy(*keys).agg(F.collect_set(F.lower(F.col(word))).alias("_w"))
    n = names.where(F.col("text").isNotNull()).groupBy(*keys).agg(F.collect_set("text").alias("_n"))
    best = w.join(n, list(keys)).select(*keys, F.explode(_best_names.asNondeterministic()("_w", "_n", F.transform("_n", lambda x: F.lower(x)))).alias("b"))
    best = best.select(*keys, F.col("b.w").alias("_low"), F.col("b.text").alias(f"{word}_entity"))
    return words.withColumn("_low", F.lower(F.col(word))).join(best, [*keys, "_low"]).drop("_low")


def in_interval(points: DataFrame, intervals: DataFrame, id_col: str = "doc_id", at: str = "start", start: str = "start", end: str = "end") -> DataFrame:
    """Points with the columns of the interval [start, end) of their document that holds them; points between intervals go.

    Intervals of a document don't overlap. Points and interval beginnings are swept together in the order of their places,
    so each point looks at the last beginning before it and at no other.
    """
    extra = [c for c in intervals.columns if c != id_col]
    held = F.struct(*(F.col(c) for c in extra)).alias("_i")
    kept = F.struct(*(F.col(c) for c in points.columns if c != id_col)).alias("_p")
    nothing = lambda df, c: F.lit(None).cast(df.select(c).schema[0].dataType)
    a = intervals.select(id_col, F.col(start).cast("long").alias("_at"), F.lit(0).alias("_k"), held, nothing(points, kept).alias("_p"))
    b = points.select(id_col, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_k"), nothing(intervals, held).alias("_i"), kept)
    w = Window.partitionBy(id_col).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b).withColumn("_i", F.last("_i", ignorenulls=True).over(w)).where("_k = 1").where(F.col("_at") < F.col(f"_i.{end}"))
    return swept.select(id_col, "_p.*", *(F.col(f"_i.{c}").alias(c) for c in extra if c not in points.columns))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sums_before(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import numpy as np

    for lengths in columns:
        flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(flat)])
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(lengths).to_pylist()], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        yield _lists(sizes.tolist(), pa.array(ends[:-1] - np.repeat(ends[first[:-1]], sizes)))


def sums_before(lengths: Column) -> Column:
    """array<long>: for each number of an array the sum of those before it."""
    return _sums_before.asNondeterministic()(F.coalesce(lengths, F.array().cast("array<int>")))


@F.arrow_udf(T.StringType())
def _with_inserts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, ends, puts in columns:
        out = []
        for t, es, ps in zip(texts.to_pylist(), ends.to_pylist(), puts.to_pylist(), strict=True):
            if t is None or not es:
                out.append(t)
                continue
            pieces, last = [], 0
            for e, p in zip(es, ps, strict=True):
                pieces += [t[last:e], p]
                last = e
            out.append("".join([*pieces, t[last:]]))
        yield pa.array(out, pa.string())


def with_inserts(text: Column, ends: Column, puts: Column) -> Column:
    """The text with ``puts`` set in after ``ends`` code points (ascending), put together once."""
    return _with_inserts(text, ends, puts)
