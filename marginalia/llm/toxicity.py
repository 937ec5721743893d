"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a hashed word embedding, the mean of hashed embeddings of its character pieces (4-grams and
beginnings), and two fixed statistics: the log-odds of the word and the largest log-odds among its pieces over the
training texts. The network
reads windows of words that overlap by half and cover the whole text; a text's logit is its highest window's, scaled on
the training texts. Training starts from the window with the strongest words of each text and then follows the network's
own choice of window.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_names

WIDTH, STRIDE = 32, 16  # words of a window, words from one window to the next
HIDDEN, DIM, BUCKETS, ATTEND = 8, 8, 1 << 16, 8
CELLS = 1 << 21  # of the tables of log-odds, so many that a piece seldom shares its cell; a hash's low bits are its bucket
PREFIXES = (5, 6, 7, 8, 10)  # bytes of a word's beginnings
_CACHE_WORDS = 120_000  # projections of words that a worker keeps: 25 MB
_PART_WORDS = 200_000  # words scored at once; one longer text is a part of its own


#: ASCII characters other than letters and digits part words; all bytes from 0x80 on belong to them.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split()


def windows(n: int) -> np.ndarray:
    """First words of the windows over ``n`` words; the last one reaches the end. A text without words has none."""
    return np.arange(0, max(1, -(-(n - WIDTH) // STRIDE) + 1) * STRIDE, STRIDE) if n else np.zeros(0, np.int64)


def features(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each word, cells of its character pieces word by word, where each word's pieces begin).

    Pieces are all 4-grams of bytes (word ends marked) and the word's beginnings of the lengths in ``PREFIXES``.
    """
    own = np.fromiter((zlib.crc32(w) & (CELLS - 1) for w in ws), np.int64, len(ws))
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x01\x01\x01" for w in ws), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 1 for w in ws), np.int64, len(ws))
    begin = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
    whose = np.repeat(np.arange(len(ws)), sizes)
    at = np.arange(sizes.sum()) + whose * 3
    pieces, owners = [_bucket(data, at, 4)], [whose]
    for n in PREFIXES:
        long = np.flatnonzero(sizes > n)
        pieces.append(_bucket(data, begin[long] + 1, n))
        owners.append(long)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(ws)))
    return own, np.concatenate(pieces)[order], first


def features_in_parts(ws: list[bytes], part: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``features``, in four-byte numbers and without large arrays in between."""
    parts, before = [], 0
    for s in range(0, len(ws), part):
        own, grams, first = features(ws[s : s + part])
        parts.append((own.astype(np.int32), grams.astype(np.int32), (first + before).astype(np.int64)))
        before += len(grams)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bucket(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    code = np.full(len(at), n, np.uint32)
    for j in range(n):
        code = (code ^ data[at + j]) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return (code ^ (code >> np.uint32(13))).astype(np.int64) & (CELLS - 1)


def spread(first: np.ndarray, end: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pieces of some words, one word after the other, and how many each has."""
    sizes = np.diff(np.append(first, end))[rows]
    return np.repeat(first[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, scoring of windows, and one gradient step."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        inputs, init = 2 * DIM + 2, lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"ew": init(BUCKETS, DIM) * 8, "ec": init(BUCKETS, DIM) * 8, "wa": init(2 * HIDDEN, ATTEND), "va": init(ATTEND), "wo": init(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(inputs, 3 * HIDDEN), f"u{d}": init(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.odds_w = self.odds_c = np.zeros(CELLS, np.int8)  # sixteenths
        self.scale = np.array([1.0, 0.0])
        self.sums = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def inputs(self, feats) -> np.ndarray:
        own, grams, first = feats
        counts = np.diff(np.append(first, len(grams)))[:, None]
        mean = np.add.reduceat(self.p["ec"][grams & (BUCKETS - 1)], first) / counts
        odds = [self.odds_w[own] / 16, np.maximum.reduceat(self.odds_c[grams], first) / 16]
        return np.concatenate([self.p["ew"][own & (BUCKETS - 1)], mean, np.stack(odds, 1)], 1).astype(np.float32)

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        """Input parts of the gates, forwards and backwards."""
        return [(x @ self.p[f"w{d}"] + self.p[f"b{d}"]).astype(np.float32) for d in "fb"]

    def forward(self, proj: list[np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. ids: windows x WIDTH rows of ``proj``, -1 after a window's end."""
        n, mask, at = len(ids), ids >= 0, np.maximum(ids, 0)
        states = np.zeros((n, WIDTH, 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"]
            part, steps = proj[k], []
            for t in range(WIDTH) if d == "f" else reversed(range(WIDTH)):
                x, hu = part[at[:, t]], h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                out = (new + z * (h - new)) * mask[:, t : t + 1]
                if keep is not None:
                    steps.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
                h = out
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
            if keep is not None:
                keep[d] = steps
        a = np.tanh(states @ self.p["wa"])
        e = np.where(mask, a @ self.p["va"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        att = e / e.sum(1, keepdims=True)
        pooled = (att[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep |= {"mask": mask, "states": states, "a": a, "att": att, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["c"][0]

    def step(self, vocab: tuple, ids: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adagrad step on windows; vocab: the features of the rows that ids number."""
        used, local = np.unique(np.where(ids >= 0, ids, ids.max()), return_inverse=True)
        own, grams, first = vocab
        flat, sizes = spread(first, len(grams), used)
        mine = (own[used], grams[flat], np.cumsum(sizes) - sizes)
        local = np.where(ids >= 0, local.reshape(ids.shape), -1)
        x = self.inputs(mine)
        keep: dict = {}
        logit = self.forward(self.project(x), local, keep)
        prob, p, g = sigmoid(logit), self.p, {}
        d_logit = ((prob - y) / len(y)).astype(np.float32)
        states, att, a, mask = keep["states"], keep["att"], keep["a"], keep["mask"]
        g["wo"], g["c"] = keep["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * p["wo"]
        d_states = att[:, :, None] * d_pool[:, None, :]
        d_att = (states @ d_pool[:, :, None])[:, :, 0]
        d_e = att * (d_att - (att * d_att).sum(1, keepdims=True))
        g["va"] = np.einsum("ntk,nt->k", a, d_e)
        d_a = d_e[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.tensordot(states, d_a, ((0, 1), (0, 1)))
        d_states += d_a @ p["wa"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, w = p[f"u{d}"], p[f"w{d}"]
            d_u, d_proj, d_h = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32), 0
            for t, h, z, r, new, hn in reversed(keep[d]):
                d_out = (d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN] + d_h) * mask[:, t : t + 1]
                d_new = d_out * (1 - z) * (1 - new * new)
                d_z = d_out * (h - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
                d_u += h.T @ d_hu
                d_h = d_hu @ u.T + d_out * z
                np.add.at(d_proj, np.maximum(local[:, t], 0), np.concatenate([d_z, d_r, d_new], 1))
            g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = d_u, x.T @ d_proj, d_proj.sum(0)
            d_x += d_proj @ w.T
        for k, v in g.items():
            self.sums[k] += v * v
            p[k] -= rate * v / np.sqrt(self.sums[k])
        for k, rows, v in (("ew", mine[0] & (BUCKETS - 1), d_x[:, :DIM]), ("ec", mine[1] & (BUCKETS - 1), np.repeat(d_x[:, DIM : 2 * DIM] / np.maximum(sizes, 1)[:, None], sizes, 0))):
            touched, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, back, v)
            self.sums[k][touched] += total * total
            p[k][touched] -= rate * total / np.sqrt(self.sums[k][touched])
        return float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))


def window_ids(ids: np.ndarray) -> np.ndarray:
    """Windows over one text's word numbers, -1 beyond its end."""
    at = windows(len(ids))
    grid = at[:, None] + np.arange(WIDTH)
    return np.where(grid < len(ids), ids[np.minimum(grid, len(ids) - 1)], -1).astype(np.int32) if len(ids) else np.zeros((0, WIDTH), np.int32)


def train(texts: list[str], labels: list[int], epochs: int = 4, least_steps: int = 160, batch: int = 128, rate: float = 0.05, seed: int = 7, weights: tuple[float, float] = (1.0, 1.0)) -> Network | None:
    """A network from labelled texts; None where one label is missing.

    ``weights`` of other and toxic texts say how many labelled rows each stands for: scores follow their balance.
    """
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32) for t in texts]
    y = np.array([v for v, i in zip(labels, ids, strict=True) if len(i)], np.float32)
    ids = [i for i in ids if len(i)]
    if not len(y) or y.min() == y.max():
        return None
    vocab = own, grams, first = features_in_parts(list(number))
    number.clear()
    net = Network(seed)
    net.odds_w = log_odds(ids, y, lambda u: own[u])
    net.odds_c = log_odds(ids, y, lambda u: grams[spread(first, len(grams), u)[0]])
    strong = net.odds_w[own].astype(int) + np.maximum.reduceat(net.odds_c[grams], first)
    wins = [window_ids(i) for i in ids]
    chosen = [w[[np.where(w >= 0, strong[w], -999).max(1).argmax()]] for w in wins]
    g = np.random.default_rng(seed)
    times = max(1, min(3, round(float((1 - y).sum() / y.sum()))))
    epochs = max(epochs, -(-least_steps // -(-len(y) // batch)))  # few texts are seen more often
    for epoch in range(epochs):
        if epoch in (epochs * 2 // 5, epochs * 4 // 5):  # follow the network's own choice
            chosen = [w[[s.argmax()]] for w, s in zip(wins, scores_of(net, vocab, wins), strict=True)]
        extra = [w[g.integers(len(w), size=1)] for w, v in zip(wins, y, strict=True) if v == 0]
        more = [w for w, v in zip(chosen, y, strict=True) if v == 1] * (times - 1)  # a balance, not so strong that single texts are learned by heart
        x = np.concatenate(chosen + extra + more)
        t = np.concatenate([y, np.zeros(len(extra), np.float32), np.ones(len(more), np.float32)])
        order = g.permutation(len(x))
        for s in range(0, len(x), batch):
            net.step(vocab, x[order[s : s + batch]], t[order[s : s + batch]], rate)
    top = np.array([s.max() for s in scores_of(net, vocab, wins)])
    net.scale = platt(top, y, np.where(y == 1, weights[1], weights[0]))
    return net


def log_odds(ids, y, cells) -> np.ndarray:
    """Log-odds (in sixteenths) of a cell among toxic against other texts, counted once a text and smoothed."""
    seen = np.zeros((2, CELLS), np.int32)
    for i, v in zip(ids, y, strict=True):
        seen[int(v), np.unique(cells(np.unique(i)))] += 1
    out = np.zeros(CELLS, np.int8)
    at = np.flatnonzero(seen.any(0))
    there = seen[:, at].astype(np.float32)
    odds = np.log((there[1] + 1) / (y.sum() + 2)) - np.log((there[0] + 1) / ((1 - y).sum() + 2))
    odds *= there.sum(0) / (there.sum(0) + 8)  # of pieces in few texts little is known
    out[at] = np.rint(np.clip(odds, -3, 6) * 16)
    return out


def scores_of(net: Network, vocab, wins: list[np.ndarray], part: int = 20_000) -> list[np.ndarray]:
    own, grams, first = vocab
    parts = []
    for s in range(0, len(own), part):
        e = min(len(own), s + part)
        ends = first[e] if e < len(own) else len(grams)
        parts.append(net.project(net.inputs((own[s:e], grams[first[s] : ends], first[s:e] - first[s]))))
    proj = [np.concatenate(x) for x in zip(*parts, strict=True)]
    every = np.concatenate(wins)
    got = np.concatenate([net.forward(proj, every[s : s + 2048]) for s in range(0, len(every), 2048)])
    return np.split(got, np.cumsum([len(w) for w in wins])[:-1])


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Slope and offset of a logistic fit, by Newton's steps with a small ridge; weights count by their proportions."""
    w = np.ones(len(x)) if weight is None else weight * (len(x) / weight.sum())
    b, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1).astype(np.float64)
    for _ in range(30):
        p = sigmoid(design @ b)
        hess = design.T @ (design * (w * p * (1 - p))[:, None]) + np.diag([1e-2, 1e-2])
        b = b - np.linalg.solve(hess, design.T @ (w * (p - y)) + 1e-2 * (b - [1, 0]))
    return b if b[0] > 0 else np.array([1.0, 0.0])


class Scorer:
    """Scores whole texts; keeps the projections of words that it has met, up to a bound."""

    def __init__(self, net: Network | None):
        self.net, self.number, self.proj, self.used = net, {}, [np.zeros((1024, 3 * HIDDEN), np.float32)] * 2, 0

    def _numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        get = self.number.get
        out = [[get(w, -1) for w in ws] for ws in texts]
        new = list({w for ws, o in zip(texts, out, strict=True) if -1 in o for w, k in zip(ws, o, strict=True) if k < 0})
        if self.used + len(new) > _CACHE_WORDS:
            self.number.clear()
            self.used, new = 0, list({w for ws in texts for w in ws})
            out = [[-1] * len(ws) for ws in texts]
        if new:
            while len(self.proj[0]) < self.used + len(new):
                self.proj = [np.concatenate([x, np.zeros_like(x)]) for x in self.proj]
            for s in range(0, len(new), 20_000):
                part = new[s : s + 20_000]
                for x, got in zip(self.proj, self.net.project(self.net.inputs(features(part))), strict=True):
                    x[self.used : self.used + len(part)] = got
                self.number.update(zip(part, range(self.used, self.used + len(part)), strict=True))
                self.used += len(part)
            number = self.number
            out = [[number[w] for w in ws] if -1 in o else o for ws, o in zip(texts, out, strict=True)]
        return [np.array(o, np.int64) for o in out]

    def __call__(self, texts: pa.Array, some: int = 400) -> np.ndarray:
        """Scores from 0 to 1; texts without words (null ones too) get the score of the lowest logit (0)."""
        result = np.zeros(len(texts))
        if self.net is None:
            return result
        for s in range(0, len(texts), some):
            split = [words(t or "") for t in texts.slice(s, some).to_pylist()]
            order = [i for i, ws in enumerate(split) if ws]
            while order:
                part, total = [], 0
                while order and (not part or total + len(split[order[-1]]) <= _PART_WORDS):
                    part.append(order.pop())
                    total += len(split[part[-1]])
                ids = self._numbers([split[i] for i in part])
                for i in part:
                    split[i] = []
                best = np.full(len(part), -np.inf)
                counts = [len(windows(len(x))) for x in ids]
                flat, start = np.concatenate(ids), np.cumsum([0, *map(len, ids)])
                whose = np.repeat(np.arange(len(part)), counts)
                at = np.concatenate([windows(len(x)) for x in ids])
                for w in range(0, len(at), 2048):
                    grid, own = at[w : w + 2048, None] + np.arange(WIDTH), whose[w : w + 2048]
                    inside = grid < np.diff(start)[own][:, None]
                    rows = np.where(inside, flat[np.minimum(start[own][:, None] + grid, len(flat) - 1)], -1)
                    np.maximum.at(best, own, self.net.forward(self.proj, rows))
                result[s + np.array(part)] = sigmoid(self.net.scale[0] * best + self.net.scale[1])
        return result


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labelled rows that are not held out; toxic if any label of the document says so."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_weights(labels: DataFrame, toxic: int = 1500, other: int = 2500) -> tuple[float, float]:
    """How many labelled rows a sampled other and a sampled toxic row stand for; the limits are those of ``training_rows``."""
    n = {r.toxic: r["count"] for r in training_ids(labels).groupBy("toxic").count().collect()}  # two rows
    return max(1.0, n.get(0, 0) / other), max(1.0, n.get(1, 0) / toxic)


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = 1500, other: int = 2500, most_chars: int = 32_000) -> DataFrame:
    """(doc_id, toxic, text) rows, at most ``toxic`` and ``other`` of them; scores are learned from these alone.

    The ids are taken in the order of their hash from all labelled rows that are not held out; a document labelled more
    than once counts as toxic if any label says so. A text longer than ``most_chars`` takes part with so many of its
    characters, as eight pieces evenly spaced from its beginning to its end.
    """
    ids = training_ids(labels)
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    some = ids.where("toxic = 1").orderBy(*by_hash).limit(toxic).union(ids.where("toxic = 0").orderBy(*by_hash).limit(other))
    piece = most_chars // 8
    starts = [(F.floor((F.length("text") - piece) * (k / 7)) + 1).cast("int") for k in range(8)]
    spread_out = F.concat_ws(" ", *(F.col("text").substr(at, F.lit(piece)) for at in starts))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")  # as many ids as the limits
    texts = texts.select("doc_id", "toxic", F.when(F.length("text") > most_chars, spread_out).otherwise(F.col("text")).alias("text"))
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, **limits) -> Network | None:
    """The network, trained by one task on the bounded rows of ``training_rows``; the driver only sees its tables."""
    weights = class_weights(labels, **{k: v for k, v in limits.items() if k != "most_chars"})

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            y += b.column("toxic").to_pylist()
        net = train(texts, y, weights=weights)
        if net is not None:
            del net.sums
        yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    rows = training_rows(docs, labels, **limits).repartition(1).sortWithinPartitions("doc_id")
    return pickle.loads(bytes(rows.mapInArrow(run, "net binary").collect()[0].net))


def scored(docs: DataFrame, labels: DataFrame, name: str, **limits) -> DataFrame:
    """``docs`` with all its columns and a last one, ``name``, its score; see ``toxicity``. Only the text goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, **limits))  # fixed size: four tables, 8 MB

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pa.array(scorer(texts))

    return docs.withColumn(name, score("text"))


def toxicity(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Score of every whole text, learned from a bounded sample of the labelled rows that are not held out.

    Where a class exceeds its limit, the scores still follow the balance of all labelled rows, not the sample's.
    A null or blank text scores 0, as does every text where the labels lack one of the classes. A null id counts as not
    held out. Repeated rows score alike; only id and text are read, other columns are left out.
    """
    s = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "score", **limits)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return s.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The rows that are not predicted toxic, with their columns, whatever these are called."""
    (score,) = free_names(docs.columns, "score")
    return scored(docs, labels, score, **limits).where(F.col(score) < 0.5).select(*(f"`{c}`" for c in docs.columns))
