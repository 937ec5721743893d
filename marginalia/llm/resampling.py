"""Importance resampling towards a target's distribution of hashed word runs, by the algebra of CRCs.

A word's CRC is computed once. The CRC of a run is put together from its words' CRCs: appending ``k`` bytes to a text
multiplies its CRC by a 32 x 32 matrix over GF(2), and powers of that matrix for 1, 2, 4, ... bytes make every length; so
no run is ever written out as a string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored
from marginalia.operators.places import with_places

CHUNK_BYTES = 4 << 20
_SPACE = zlib.crc32(b" ")
_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
_IN_WORD = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_FEW = 64  # bytes of a word up to which all words are taken along together


@cache
def byte_table() -> np.ndarray:
    """The CRC register after one byte, for each of the 256."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


@cache
def length_matrix(power: int) -> np.ndarray:
    """The matrix of appending 2**power zero bytes, as four tables that map each byte of a CRC to its image: (4, 256)."""
    if power == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = (bits >> 8) ^ byte_table()[bits & 255]
    else:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = _times(length_matrix(power - 1), _times(length_matrix(power - 1), bits))
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where((_CODES >> bit) & 1, columns[8 * byte + bit], 0).astype(np.uint32)
    return out


def _times(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return matrix[0][crc & 255] ^ matrix[1][(crc >> 8) & 255] ^ matrix[2][(crc >> 16) & 255] ^ matrix[3][crc >> 24]


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC times the matrix of its own length in bytes."""
    out, rest, power = crc.copy(), lengths.astype(np.int64), 0
    while rest.any():
        on = (rest & 1).astype(bool)
        out[on] = _times(length_matrix(power), out[on])
        rest, power = rest >> 1, power + 1
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, CRC, bytes) of each word of texts that stand one after another in ``data``; only A-Z are lower-cased."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True  # a word ends where its text does
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    lengths = np.flatnonzero(inside & (~after | cut[1:])) + 1 - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    table, left = byte_table(), np.flatnonzero(lengths <= _FEW)
    for k in range(_FEW):
        left = left[lengths[left] > k]
        if not len(left):
            break
        c = crc[left]
        crc[left] = table[(c ^ low[starts[left] + k]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _FEW):
        crc[i] = zlib.crc32(low[starts[i] : starts[i] + lengths[i]].tobytes())
    return np.searchsorted(offsets, starts, "right") - 1, crc, lengths


def run_buckets(row: np.ndarray, crc: np.ndarray, lengths: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``longest`` words of one text, joined by one space, in the rows' order."""
    rows, found, run = [row], [crc.astype(np.int64) % buckets], crc
    for n in range(2, longest + 1):
        same = row[n - 1 :] == row[: len(row) - n + 1]
        last, size = crc[n - 1 :], lengths[n - 1 :]
        run = shifted(run[: len(last)], size + 1) ^ shifted(np.full(len(last), _SPACE, np.uint32), size) ^ last
        rows.append(row[n - 1 :][same])
        found.append(run[same].astype(np.int64) % buckets)
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable") if longest > 1 else slice(None)
    return rows[order], found[order]


def _views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings without nulls."""
    texts = texts.cast(pa.large_binary())
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def _featured(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("")
        offsets, data = _views(texts)
        a = 0
        while a < len(texts):  # whole texts, some MB at a time
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
            row, crc, lengths = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            of, found = run_buckets(row, crc, lengths, longest, buckets)
            counts = np.bincount(of, minlength=b - a)
            ends = np.concatenate([[0], np.cumsum(counts)]) * kind().itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.astype(kind))])
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.bincount(row, minlength=b - a)), pa.array(counts), packed.cast(pa.binary())], ["id", "n_words", "n_features", "buckets"])
            a = b


def features(df: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets): every run's bucket, packed as 16-bit numbers (32-bit beyond 65,536 buckets)."""
    kind = df.schema[id_col].dataType.simpleString()
    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(lambda it: _featured(it, longest, buckets), f"id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds; a task sends one row a bucket, so ``buckets`` rows reach the driver."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            offsets, data = _views(batch.column(0))
            total += np.bincount(data[offsets[0] : offsets[-1]].view(kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share of each bucket over the raw one)."""
    k, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighted(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    for batch in batches:
        offsets, data = _views(batch.column(3))
        each = gain[data[offsets[0] : offsets[-1]].view(kind)]
        sums = np.concatenate([[0], np.cumsum(each)])
        at = (offsets - offsets[0]) // kind().itemsize
        n = batch.column(2).to_numpy()
        weight = np.where(n > 0, (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], ["id", "n_words", "n_features", "weight"])


def importance_resample(
    docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_features, weight, score, rank): every document, with its rank among the ``percent`` drawn or null.

    Features are the runs of 1 to ``longest`` words, hashed into ``buckets``; a document's weight is the floored mean of
    its buckets' gains (target over raw, smoothed), and Gumbel noise from the seed and id makes the highest scores a
    sample without replacement. Texts are read once; between the passes stand their packed buckets.

    Null texts are empty: no features, weight 0, never drawn (they have fewer than ``least_words`` words), nor are other
    short texts. A null id draws the noise of an empty one; repeated rows count each time and get ranks of their own; ties
    in score go to the smaller id, null first, then to the larger weight. Empty tables: no documents give no rows, an
    empty target leaves the smoothed shares of nothing.
    """
    found = stored(features(docs, id_col, text_col, longest, buckets), "resampling-features")
    wanted = bucket_counts(features(target.withColumn("_id", F.lit(0)), "_id", text_col, longest, buckets), buckets)
    gain = gains(bucket_counts(found, buckets), wanted)
    kind = found.schema["id"].dataType.simpleString()
    weighed = found.mapInArrow(lambda it: _weighted(it, gain), f"id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("long"))
    draw = percent * found.where(F.col("n_words") >= least_words).count() // 100
    placed = with_places(scored, F.desc("long"), F.desc("score"), F.asc("id"), F.desc("weight"), keep=lambda df: stored(df, "resampling-places"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("place") < draw, F.col("place") + 1).alias("rank"))
