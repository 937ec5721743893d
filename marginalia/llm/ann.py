"""Nearest neighbours: anisotropic four-bit product quantisation, table scans, bounds, exact reranking.

The product of a query and a vector is read from four-bit codes whose training and encoding weigh the part of the
residual along x by ``eta``, as that part moves the product most. Finer layers code what is left, scaled by its own size,
so that they resolve clusters of any width. Each row keeps how far it lies from what its codes say, which bounds its
distance to a query from both sides. Queries and codes meet in blocks: a block of queries scans a block of codes with one
table lookup for two codes; what the bound of the coarse codes leaves meets the fine ones, and what their bounds leave goes
on to exact distances, however much it is. So no near vector is lost, whatever the rows look like; rows that the codes
tell badly apart cost more exact distances. Equal vectors are scanned as one, so that copies take one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CODES = 16
WIDTH = 2  # dimensions of a subspace
FINE = 5  # finer layers at most
FINE_SAMPLE = 4096  # vectors that a finer layer is fitted on
EMITTED = 500_000  # pairs that a task holds before it hands them on
_BLOCK = "block long, ids binary, data binary, extra binary"


class Quantizer:
    """Codebooks (subspaces x 16 x 2) for vectors of ``dim`` components, padded with zeros to a multiple of four."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 3):
        n, self.dim = sample.shape
        self.pad = -self.dim % (2 * WIDTH)
        x = self.padded(sample)
        self.spaces = x.shape[1] // WIDTH
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        g = np.random.default_rng(seed)
        pick = g.choice(n, CODES, replace=n < CODES)
        self.books = x[pick].reshape(CODES, self.spaces, WIDTH).transpose(1, 0, 2) + g.standard_normal((self.spaces, CODES, WIDTH)) * 1e-4 * (x.std() + 1e-12)
        for _ in range(rounds):
            self._update(x, self.encode(sample, packed=False))

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, np.float64), ((0, 0), (0, self.pad)))

    def encode(self, vectors: np.ndarray, packed: bool = True, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss from the nearest centroids; two codes a byte if packed."""
        x = self.padded(vectors)
        step = max(16, 1_000_000 // (self.spaces * CODES))
        codes = np.concatenate([np.zeros((0, self.spaces), np.uint8), *(self._chosen(x[s : s + step], passes) for s in range(0, len(x), step))])
        return codes[:, 0::2] | codes[:, 1::2] << 4 if packed else codes

    def _chosen(self, x: np.ndarray, passes: int) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        parts, along = (a.reshape(len(x), self.spaces, WIDTH).transpose(1, 0, 2) for a in (x, unit))
        rest = [parts[:, :, w, None] - self.books[:, None, :, w] for w in range(WIDTH)]
        cost, side = sum(r**2 for r in rest), sum(r * along[:, :, w, None] for w, r in enumerate(rest))
        codes = cost.argmin(2)
        par = np.take_along_axis(side, codes[:, :, None], 2)[:, :, 0]
        for _ in range(passes if self.eta > 1 else 0):
            total = par.sum(0)
            for s in range(self.spaces):
                codes[s] = (cost[s] + (self.eta - 1) * ((total - par[s])[:, None] + side[s]) ** 2).argmin(1)
                now = np.take_along_axis(side[s], codes[s][:, None], 1)[:, 0]
                total += now - par[s]
                par[s] = now
        return codes.T.astype(np.uint8)

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centroid to the least anisotropic loss of its members, the other subspaces held."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        rest = x - np.concatenate([self.books[k][codes[:, k]] for k in range(self.spaces)], 1)
        along = (rest * unit).sum(1)
        for s in range(self.spaces):
            cols = slice(s * WIDTH, (s + 1) * WIDTH)
            others = along - (rest[:, cols] * unit[:, cols]).sum(1)
            for c in np.unique(codes[:, s]):
                m = codes[:, s] == c
                u = unit[m, cols]
                a = np.eye(WIDTH) * m.sum() + (self.eta - 1) * u.T @ u
                b = x[m, cols].sum(0) + (self.eta - 1) * (u * ((x[m, cols] * u).sum(1) + others[m])[:, None]).sum(0)
                self.books[s][c] = np.linalg.solve(a, b)
            rest[:, cols] = x[:, cols] - self.books[s][codes[:, s]]
            along = others + (rest[:, cols] * unit[:, cols]).sum(1)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The padded vectors that packed codes stand for."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), self.spaces)
        return self.books[np.arange(self.spaces), codes].reshape(len(packed), self.spaces * WIDTH)

    def tables(self, queries: np.ndarray, dtype=np.float32) -> np.ndarray:
        """(byte tables, 256, queries): the product of each query with the two centroids that a byte names."""
        q = self.padded(queries).reshape(len(queries), self.spaces, WIDTH)
        each = np.einsum("qsw,scw->scq", q, self.books).astype(dtype)
        low, high = each[0::2], each[1::2]
        return (high[:, :, None] + low[:, None, :]).reshape(self.spaces // 2, CODES * CODES, len(queries))


class Layers:
    """A coarse quantizer around the sample's mean, and finer ones on what is left of a vector, scaled by its own size.

    There are as many finer layers (one at least, FINE at most) as it takes to leave nine tenths of the sample within a
    tenth of the distance to their tenth nearest in it.
    """

    def __init__(self, sample: np.ndarray, k: int = 10):
        sample = np.asarray(sample, np.float64)
        self.center = sample.mean(0)
        x = sample - self.center
        self.coarse, self.fine = Quantizer(x), []
        x = x[:: math.ceil(len(x) / FINE_SAMPLE)]
        asked = x[:: math.ceil(len(x) / 256)]
        square = (asked**2).sum(1)[:, None] + (x**2).sum(1) - 2 * asked @ x.T
        near = np.sqrt(np.maximum(np.partition(square, min(k, len(x) - 1), 1)[:, min(k, len(x) - 1)], 0))
        rest = self.coarse.padded(x) - self.coarse.decode(self.coarse.encode(x))
        for _ in range(FINE):
            size = self._size(rest)
            layer = Quantizer(rest / np.where(size > 0, size, 1), threshold=0.0, seed=5)
            self.fine.append(layer)
            rest = self._finer(layer, rest)[2]
            left = np.linalg.norm(rest, axis=1)[:: math.ceil(len(x) / 256)]
            if np.quantile(left - near / 10, 0.9) <= 0:
                break
        self.width = self.coarse.spaces // 2  # bytes of a layer

    @staticmethod
    def _size(rest: np.ndarray) -> np.ndarray:
        return np.sqrt((rest**2).mean(1, keepdims=True))

    def _finer(self, layer: Quantizer, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, sizes, what is left); a size of 0 where the layer would not come nearer."""
        size = self._size(rest)
        codes = layer.encode(rest / np.where(size > 0, size, 1), passes=0)
        less = rest - size * layer.decode(codes)
        size = np.where((less**2).sum(1, keepdims=True) < (rest**2).sum(1, keepdims=True), size, 0.0)
        return codes, size, rest - size * layer.decode(codes)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all layers, numbers of each row): coarse norm, distances from the coarse and the fine codes, sizes."""
        vectors = np.asarray(vectors, np.float64)
        codes = [self.coarse.encode(vectors - self.center)]
        told = self.coarse.decode(codes[0])
        rest = self.coarse.padded(vectors - self.center) - told
        room = 1e-12 * (np.linalg.norm(vectors, axis=1) + np.linalg.norm(self.center))  # for rounding
        off, sizes = [np.linalg.norm(rest, axis=1)], []
        for layer in self.fine:
            c, size, rest = self._finer(layer, rest)
            codes.append(c)
            sizes.append(size[:, 0])
        off.append(np.linalg.norm(rest, axis=1))
        return np.concatenate(codes, 1), np.stack([(told**2).sum(1), *(o * (1 + 1e-9) + room for o in off), *sizes], 1)

    def decode(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        w = self.width
        x = self.coarse.decode(codes[:, :w])
        for k, layer in enumerate(self.fine):
            x += sizes[:, k, None] * layer.decode(codes[:, (k + 1) * w : (k + 2) * w])
        return x

    def scan(self, codes: np.ndarray, numbers: np.ndarray, counts: np.ndarray, queries: np.ndarray, k: int):
        """Yields (rows, queries, low, high): the pairs that can be among the ``k`` nearest, with bounds of their distances.

        counts: whether a row may set a bound; others may only be found.
        """
        q = self.coarse.padded(queries - self.center)
        square = (q**2).sum(1)
        top = math.sqrt(numbers[:, 0].max()) + math.sqrt(square.max())
        tables = self.coarse.tables(queries - self.center, np.float32 if top < 1e17 else np.float64)
        lengths, off = np.sqrt(square), (self.coarse.spaces + 8) * 1.2e-7
        near, held, found = np.full((k, len(q)), np.inf), 0, []

        def handed():
            r, c, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
            ok = low <= near.max(0)[c]
            return r[ok], c[ok], low[ok], high[ok]

        for s in range(0, len(codes), 2048):
            code, number, least = codes[s : s + 2048], numbers[s : s + 2048], near.max(0)
            rows = np.arange(len(code))
            if np.isfinite(least).any():
                dot = np.zeros((len(code), len(q)), tables.dtype)
                for j in range(self.width):
                    dot += tables[j][code[:, j]]
                far = number[:, :1] + square - 2.0 * dot
                far -= off * (np.sqrt(number[:, :1]) + lengths) ** 2 + 1e-37
                rows = np.flatnonzero((far <= (least + number[:, 1:2]) ** 2).any(1))
            if not len(rows):
                continue
            x = self.decode(code[rows], number[rows, 3:])
            norm = (x**2).sum(1)[:, None]
            far, room = norm + square - 2 * x @ q.T, 1e-13 * (np.sqrt(norm) + lengths) ** 2
            low = np.sqrt(np.maximum(far - room, 0)) - number[rows, 2:3]
            high = np.sqrt(np.maximum(far + room, 0)) + number[rows, 2:3]
            setting = counts[s : s + 2048][rows]
            near = np.partition(np.concatenate([near, high[setting]]), k - 1, axis=0)[:k]
            high[~setting] = np.inf
            r, c = np.nonzero(low <= near.max(0))
            found.append((s + rows[r], c, low[r, c], high[r, c]))
            held += len(r)
            if held > EMITTED:
                found = [handed()]
                held = len(found[0][0])
                if held > EMITTED // 2:
                    yield found.pop()
                    held = 0
        if found:
            yield handed()


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, not all zeros."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 10, depth: int = 200, sample: int = 16_384, block: int = 65_536, query_block: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest for each query row, by Euclidean distance on the original vectors, in double precision.

    The codebooks are fitted on at most ``sample`` vectors (by the hash of their ids); every row is coded. All candidates
    that the codes' bounds can't rule out are reranked, and the best of others up to ``depth``. Rows without an id, with an
    unusable vector or with another than the commonest length take no part; rows that repeat an id count once, with the
    nearest of their vectors; ties go to the smaller id; an empty table gives no rows. Candidates are distinct vectors:
    each brings the smallest ids of its copies.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes).get(vec_col) == "array<float>" else "double"
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = all_rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("q")).orderBy(F.desc("n"), "dim").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes or not sizes[0].q:
        return spark.createDataFrame([], out)
    dim, n, n_queries = sizes[0]
    rows = all_rows.where(F.size("v") == dim)
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    shared = spark.sparkContext.broadcast(Layers(np.unique(np.stack(fit["v"].to_numpy()), axis=0), k))  # fixed size: 16 centroids a subspace and layer
    n_blocks, n_query_blocks = math.ceil(n / block), math.ceil(n_queries / query_block)
    # Equal vectors stand under the smallest of their ids; of the others k can matter, as one may be the query itself.
    by_id = Window.partitionBy("hash", "v").orderBy("id")
    first = rows.select("id", "v", F.xxhash64("v").alias("hash")).withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1)
    groups = first.groupBy("hash", "v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    groups = groups.select("hash", "v", F.col("ids")[0].alias("vec_id"), F.when(F.size("ids") > 1, F.slice("ids", 2, k)).alias("more"))
    # A repeated id may lead several groups, one of which counts, so that k + 1 bounds stand for as many ids.
    groups = groups.withColumn("counts", F.row_number().over(Window.partitionBy("vec_id").orderBy("hash")) == 1)

    def matrix(b, c="v"):
        flat = b.column(c).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c)
        return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)

    def coded(batches):
        for b in batches:
            if b.num_rows:
                codes, numbers = shared.value.encode(matrix(b))
                numbers = np.concatenate([numbers, np.asarray(b.column("counts").cast(pa.int8()), np.float64)[:, None]], 1)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "code": [c.tobytes() for c in codes], "numbers": [x.tobytes() for x in numbers]})

    def packed(limit, data, extra):
        def run(batches):
            ids, parts, more = [], [], []

            def full(m):
                i, d, e = np.concatenate(ids), b"".join(parts), b"".join(more)
                ids[:], parts[:], more[:] = [i[m:]], [d[m * len(d) // len(i) :]], [e[m * len(e) // len(i) :]]
                name = int(i[0] & 0x7FFFFFFF) * 1_000_003 + int(i[m - 1] & 0xFFFF)
                return pa.RecordBatch.from_pydict({"block": [name], "ids": [i[:m].tobytes()], "data": [d[: m * len(d) // len(i)]], "extra": [e[: m * len(e) // len(i)]]}, schema=shape)

            shape = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("extra", pa.binary())])
            for b in batches:
                if b.num_rows:
                    ids.append(np.asarray(b.column("id"), np.int64))
                    parts.append(data(b))
                    more.append(extra(b))
                while sum(map(len, ids)) >= limit:
                    yield full(limit)
            if left := sum(map(len, ids)):
                yield full(left)

        return run

    codes = groups.select(F.col("vec_id").alias("id"), "v", "counts").mapInArrow(coded, "id long, code binary, numbers binary").repartition(n_blocks)
    code_blocks = codes.mapInArrow(packed(block, lambda b: b"".join(b.column("code").to_pylist()), lambda b: b"".join(b.column("numbers").to_pylist())), _BLOCK)
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = queries.repartition(n_query_blocks).mapInArrow(packed(query_block, lambda b: matrix(b).tobytes(), lambda b: b""), _BLOCK)
    # Every block of queries scans every block of codes: a grid of tasks, each with one share of the codes and one of the queries.
    rows_of, columns_of = n_blocks, math.ceil(n_query_blocks / 16)
    share = lambda c, ways: F.pmod(F.xxhash64(c), F.lit(ways)).cast("int")
    every = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    left = code_blocks.withColumn("i", share("block", rows_of)).select("i", every(columns_of).alias("j"), "ids", "data", "extra")
    right = query_blocks.withColumn("j", share("block", columns_of)).select(every(rows_of).alias("i"), "j", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    pairs = left.join(right, ["i", "j"]).select("ids", "data", "extra", "qids", "qdata")

    def scanned(batches):
        layers = shared.value
        for b in batches:
            for ids, data, extra, qids, qdata in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i, qi = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                code, numbers = np.frombuffer(data, np.uint8).reshape(len(i), -1), np.frombuffer(extra, np.float64).reshape(len(i), -1)
                for r, q, low, high in layers.scan(code, numbers[:, :-1], numbers[:, -1] > 0, np.frombuffer(qdata, np.float64).reshape(len(qi), dim), k + 1):  # one more, as the query finds its own vector
                    yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(i[r]), pa.array(low), pa.array(high)], names=["query_id", "vec_id", "low", "high"])

    found = pairs.mapInArrow(scanned, "query_id long, vec_id long, low double, high double")
    by_high = Window.partitionBy("query_id").orderBy("high", "vec_id")
    bounded = found.withColumn("n", F.row_number().over(by_high)).withColumn("bound", F.max(F.when(F.col("n") <= k + 1, F.col("high"))).over(Window.partitionBy("query_id")))
    short = bounded.where((F.col("low") <= F.col("bound")) | (F.col("n") <= depth + 1)).select("query_id", "vec_id")
    both = short.join(groups.select("vec_id", "v", "more"), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")

    def exact(batches):
        for b in batches:
            t = [matrix(b, c) for c in ("v", "w")]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), b.column("more"), pa.array(np.sqrt(((t[0] - t[1]) ** 2).sum(1)))], names=["query_id", "vec_id", "more", "score"])

    each = both.select("query_id", "vec_id", "more", "v", "w").mapInArrow(exact, "query_id long, vec_id long, more array<long>, score double")
    # A repeated id may lead several groups, which stay together; k + 1 leading ids are enough, with their copies.
    led = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.collect_list(F.struct("score", "more")).alias("groups"))
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = led.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k + 1).select("query_id", F.col("vec_id").alias("lead"), F.explode("groups").alias("g"))
    copies = best.select("query_id", F.col("g.score").alias("score"), F.explode(F.concat(F.array("lead"), F.coalesce("g.more", F.array().cast("array<bigint>")))).alias("vec_id"))
    ranked = copies.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
