"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A text's set of word shingles gets a signature of b-bit minima. Its first symbols are split into chunks; a key leaves
one symbol of a chunk out, so two signatures share a key exactly where some chunk differs in one symbol at most. By the
pigeonhole principle every pair within 2 * chunks - 1 differing symbols does. The chunks' length follows the similarity
asked for, so that a pair of that similarity misses all keys with a chance of 5e-5 at most (2e-5 at 80 percent), and the
later cut on all symbols lies five deviations out.

Members of a bucket are first held against its smallest member, one partner each; confirmed links join components.
After that only buckets that still hold several components are searched. Their candidate pairs are never listed: each
bucket names the families that its candidates connect, and a family's full sets meet in blocks, each block pair in one
task that counts all intersections at once and returns only links that join components. Members of a family's largest
component meet the others only. So a group of n copies costs n confirmations, and what is left over n rows a block.
Texts with equal sets are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_names, small_batches, stored

KEYED, MORE = 40, 152  # symbols (16 bits) for the keys, further symbols (8 bits) for the cut on distance
SENT_ROWS = 500_000  # rows of two numbers that may be broadcast: 16 MB; more are joined by shuffles
BLOCK = 2048  # members of a bucket or family that meet in one block
BLOCK_SHINGLES = 2_000_000  # shingles of a family's block: 16 MB
WORDS_KEPT = 100_000  # word hashes that a Python worker keeps: 20 MB
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_g = np.random.default_rng(20)
_MULTIPLIERS = _g.integers(1, 2**63, KEYED + MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL = _g.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Layout:
    """Chunks, their length in symbols, and the cut on differing symbols for a similarity of ``percent`` (50 to 100)."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must lie between 50 and 100")
        j, self.percent = percent / 100, percent
        for self.length in (5, 4, 3, 2):
            self.chunks = KEYED // self.length
            shares = j**self.length + self.length * j ** (self.length - 1) * (1 - j)
            if (1 - shares) ** self.chunks <= 5e-5:
                break
        self.cut = math.ceil((KEYED + MORE) * (1 - j) + 5 * math.sqrt((KEYED + MORE) * j * (1 - j)))

    def chunked(self, symbols: np.ndarray) -> np.ndarray:
        return symbols[:, : self.chunks * self.length].reshape(len(symbols), self.chunks, self.length)

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """chunks x length keys a row: key (c, j) leaves symbol j of chunk c out."""
        each = _mix(self.chunked(keyed(sig)).astype(np.uint64) * _ROLL[: self.length] + _ROLL[self.length : 2 * self.length])
        rest = each.sum(2, keepdims=True) - each
        tag = np.arange(self.chunks * self.length, dtype=np.uint64).reshape(1, self.chunks, self.length)
        return (_mix(rest ^ (tag * _ROLL[40])) & np.uint64(0xFFFFFFFFFFFFFFC0) | tag).reshape(len(sig), -1).view(np.int64)

    def sizes(self, a, b):
        """Whether sets of such sizes can reach the similarity; for columns."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of 64-bit shingle hashes of texts; word hashes are kept up to a bound."""

    def __init__(self, words: int = 4):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; a text with fewer words is one shingle as a whole, one without words has none."""
        ws = (text or "").encode().translate(_LOWER).split()
        if not ws:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > WORDS_KEPT:
            memo.clear()
        h = []
        for w in ws:
            v = memo.get(w)
            if v is None:
                v = memo[w] = xxhash.xxh3_64_intdigest(w)
            h.append(v)
        h = np.array(h, np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        s = np.full(n, np.uint64(k))
        for j in range(k):
            s += _mix(h[j : j + n] + np.uint64(j + 1)) * _ROLL[j % 64]
        return np.unique(_mix(s))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bytes a (non-empty) set: KEYED 16-bit symbols, then MORE 8-bit ones."""
    flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((len(sets), KEYED + MORE), np.uint64)
    for j, m in enumerate(_MULTIPLIERS):
        low[:, j] = np.minimum.reduceat(flat * m, first)
    low = _mix(low * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([low[:, :KEYED].astype("<u2").view(np.uint8).reshape(len(sets), -1), low[:, KEYED:].astype(np.uint8)], 1)


def keyed(sig: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sig[:, : 2 * KEYED]).view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of signatures, row by row."""
    return (keyed(a) != keyed(b)).sum(1) + (a[:, 2 * KEYED :] != b[:, 2 * KEYED :]).sum(1)


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * KEYED + MORE)


def _sets(docs: DataFrame, text_col: str, words: int, names: tuple[str, str]) -> DataFrame:
    """``docs`` with two more columns, called ``names``: a row's number, and its set's size, digest and signature.

    Only the text goes to Python; the other columns stay in the JVM.
    """

    @F.arrow_udf("struct<n:long,digest:binary,sig:binary>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingles = Shingler(words)
        for texts in batches:
            n, digest, sig = [], [], []
            for s in range(0, len(texts), 256):
                sets = [shingles(t) for t in texts.slice(s, 256).to_pylist()]
                full = [x for x in sets if len(x)]
                got = iter(signatures(full)) if full else iter(())
                n += map(len, sets)
                digest += [xxhash.xxh3_128_digest(x) if len(x) else b"" for x in sets]
                sig += [next(got).tobytes() if len(x) else b"" for x in sets]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["n", "digest", "sig"])

    uid, of = names
    return docs.withColumn(of, described(F.col(f"`{text_col}`"))).withColumn(uid, F.monotonically_increasing_id())


def _keyed_nodes(nodes: DataFrame, lay: Layout) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                k = lay.keys(_sig(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(np.asarray(b.column(0)), k.shape[1]))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, nodes: DataFrame, lay: Layout) -> DataFrame:
    """(a, b, far) of the pairs whose sizes and signatures allow the similarity."""
    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                far = distances(_sig(b.column(2)), _sig(b.column(3)))
                ok = far <= lay.cut
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[ok]), pa.array(np.asarray(b.column(1))[ok]), pa.array(far[ok].astype(np.int32))], names=["a", "b", "far"])

    sized = pairs.join(x, "a").join(y, "b").where(lay.sizes("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, far int")


def _sent(rows: DataFrame) -> DataFrame:
    """So few stored rows of two numbers go to every task; more of them are joined by shuffles."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """What the pairs (a, b) whose sets, made from the texts again, reach ``percent`` connect, folded.

    Both sides are dealt over a grid of cells by hash, so a node's text goes to few cells and a node with many partners
    is spread over a row of them.
    """
    pairs = stored(pairs, "neardup-pairs")
    side = math.ceil(math.sqrt(pairs.count() / 400)) or 1
    cell = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(side)), F.lit(side)).cast("int")
    dealt = pairs.select((cell("a") * side + cell("b")).alias("cell"), "a", "b")
    ends = stored(dealt.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct(), "neardup-ends")
    text = F.lit(None).cast("string").alias("text")
    zero = [F.lit(0).alias("i"), F.lit(0).alias("j")]
    rows = dealt.select("cell", *zero, "a", "b", text).union(_sent(ends).join(texts, "node").select("cell", *zero, F.col("node").alias("a"), F.lit(-1).cast("long").alias("b"), "text"))

    def of_cell(_, a, b, texts):
        shingles, node = Shingler(words), b < 0
        sets = {i: shingles(t) for i, t in zip(a[node].tolist(), texts[node], strict=True)}
        a, b = a[~node], b[~node]
        ok = []
        for x, y in ((sets[p], sets[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        return (a[ok], b[ok]) if any(ok) else None

    return _by_cell(rows, ["cell"], {"a": np.asarray, "b": np.asarray, "text": _texts}, of_cell)


def _texts(column: pa.Array) -> np.ndarray:
    return np.array([*column.to_pylist(), None], object)[:-1]


def folds(batches: Iterator[pa.RecordBatch], roots: bool = False) -> Iterator[pa.RecordBatch]:
    """(a, b): what the edges of these batches connect, as stars; up to SENT_ROWS edges are held at once.

    roots: whether stars hold their smallest member too, as a row (b, b).
    """
    held, n = [], 0

    def out():
        member, root = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held[:] = [(member, root)]
        return len(member)

    def batch():
        member, root = held.pop()
        own = np.unique(root) if roots else root[:0]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([member, own]), pa.int64()), pa.array(np.concatenate([root, own]), pa.int64())], names=["a", "b"])

    for x in batches:
        if x.num_rows:
            held.append(tuple(np.asarray(x.column(c), np.int64) for c in ("a", "b")))
            n += x.num_rows
        if n > SENT_ROWS:
            n = out()
            if n > SENT_ROWS // 2:
                yield batch()
                n = 0
    if held:
        out()
        yield batch()


def _folded(edges: DataFrame, roots: bool = False) -> DataFrame:
    return edges.select("a", "b").mapInArrow(lambda batches: folds(batches, roots), "a long, b long")


def components(edges: DataFrame, folded: bool = False) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b); by large and small stars.

    Edges are folded where they lie first, unless they come ``folded``. What is left is counted: up to SENT_ROWS rows are one partition, whose stars
    are the components; more of them go through rounds of joins.
    """
    edges = stored(edges if folded else _folded(edges.where("a <> b")), "neardup-folded")
    if edges.count() <= SENT_ROWS:
        return _folded(edges.coalesce(1), roots=True).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return _by_rounds(edges)


def _by_rounds(edges: DataFrame) -> DataFrame:
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        e = stored(j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).distinct(), "neardup-stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _dealt(rows: DataFrame, keys: list[str], is_big: Column, big_blocks: Column, other_blocks: Column) -> DataFrame:
    """``rows`` once for each cell (i, j) of blocks that a row's block meets, with its own block as ``mine``.

    The largest component's members fill the first blocks and meet the others' blocks only; those meet all blocks.
    """
    mine = F.when(is_big, F.pmod(F.xxhash64("node"), big_blocks)).otherwise(big_blocks + F.pmod(F.xxhash64("node"), other_blocks)).cast("int")
    met = F.sequence(F.when(is_big, big_blocks).otherwise(F.lit(0)), big_blocks + other_blocks - 1)
    cells = F.transform(met, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    rest = [c for c in rows.columns if c not in keys]
    return rows.withColumn("mine", mine).select(*keys, "mine", *rest, F.explode(cells).alias("cell")).select(*keys, "cell.i", "cell.j", "mine", *rest)


def _by_cell(rows: DataFrame, keys: list[str], columns: dict[str, Callable], of_cell: Callable) -> DataFrame:
    """Links (a, b) that ``of_cell`` finds in the rows of each cell, folded; cells are dealt by hash and sorted, so they follow each other.

    columns: how each column that ``of_cell`` takes becomes an array. Links are folded in the function that finds them: a
    second one would take a second Python worker for each task, and idle workers keep their memory.
    """
    at = [*keys, "i", "j"]

    def run(batches):
        held, last, found = [], None, []

        def close():
            whole = held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(whole[0]) > 1 and (links := of_cell(last, *whole)) is not None:
                found.append(links)

        def out():
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([np.asarray(batch.column(c), np.int64) for c in at], 1)
            arrays = [f(batch.column(c)) for c, f in columns.items()]
            bounds = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            names = list(map(tuple, ids[bounds[:-1]].tolist()))
            for now, s, e in zip(names, bounds[:-1], bounds[1:], strict=True):
                if held and now != last:
                    close()
                    held = []
                held.append([x[s:e] for x in arrays])
                last = now
            if found:
                yield out()
        if held:
            close()
        if found:
            yield out()

    return rows.repartition(*at).sortWithinPartitions(*at).mapInArrow(lambda batches: folds(run(batches)), "a long, b long")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the pairs connect, as (member, smallest member) rows without the smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low, before = np.arange(len(nodes)), None
    while before is None or (low != before).any():
        before = low.copy()
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        low = low[low]
    own = low != np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def _family_links(members: DataFrame, lay: Layout) -> DataFrame:
    """(a, b) rows that connect the candidates of different components; candidates of a bucket as stars, never as pairs.

    members: key, node, root, n, sig, big (the bucket's largest component), n_big, n_other. A pair is a candidate in the
    first key that it shares, if sizes and distance allow the similarity.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = _dealt(members.select("key", "node", "root", "n", "sig", "big", "n_big", "n_other"), ["key"], F.col("root") == F.col("big"), blocks("n_big"), blocks("n_other")).drop("big", "n_big", "n_other")

    def candidates(cell, mine, node, root, n, sig):
        key, i, j = cell
        a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        c, d = divmod(key & 63, lay.length)
        s = keyed(sig)
        found = []
        for at in range(0, len(a), 64):
            x = a[at : at + 64]
            ok = (root[x][:, None] != root[b]) & (np.minimum(n[x][:, None], n[b]) * 100 >= np.maximum(n[x][:, None], n[b]) * lay.percent)
            if i == j:
                ok &= node[x][:, None] < node[b]
            p, q = np.nonzero(ok)
            if not len(p):
                continue
            p, q = x[p], b[q]
            differ = s[p] != s[q]
            parts = lay.chunked(differ)
            wrong = parts.sum(2)
            first, each = (wrong <= 1).argmax(1), np.arange(len(p))
            left_out = np.where(wrong[each, first] == 0, 0, parts[each, first].argmax(1))
            keep = np.flatnonzero((first == c) & (left_out == d))
            far = differ[keep].sum(1) + (sig[p[keep], 2 * KEYED :] != sig[q[keep], 2 * KEYED :]).sum(1)
            keep = keep[far <= lay.cut]
            if len(keep):
                found.append(stars(node[p[keep]], node[q[keep]]))
        return stars(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else None

    return _by_cell(rows, ["key"], dict.fromkeys(("mine", "node", "root", "n"), np.asarray) | {"sig": _sig}, candidates)


def joining(sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of pairs of the two sides (of all pairs where they are one) that reach ``percent`` and join components.

    All intersections are counted at once: the shingles that several sets hold are the columns of 0/1 matrices, taken
    in parts, whose products are summed.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, whose = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    number, whose = number[shared], whose[shared]
    order = np.argsort(number, kind="stable")
    number, whose = number[order], whose[order]
    column = np.cumsum(np.append(0, number[1:] != number[:-1])) if len(number) else number
    left, right = (np.flatnonzero(side == k) for k in (side.min(), side.max()))
    both = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[whose[s:e], column[s:e] - at] = 1
        both += m[left] @ m[right].T
    ok = 100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)
    ok &= root[left][:, None] != root[right]
    top, links = {int(r): int(r) for r in np.unique(root)}, []

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for p, q in zip(*np.nonzero(ok), strict=True):
        a, b = left[p], right[q]
        x, y = find(int(root[a])), find(int(root[b]))
        if x != y:
            top[max(x, y)] = min(x, y)
            links.append((int(a), int(b)))
    return links


def _joined(families: DataFrame, rooted: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links of the same family, as the roots (a, b) that they connect; families: node, root (the family's name)."""
    members = stored(families.select("node", F.col("root").alias("family")).join(rooted.select("node", "root", "n"), "node"), "neardup-members")
    by_root = members.groupBy("family", "root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    whole = by_root.groupBy("family").agg(F.max(F.struct("size", "root", "shingles")).alias("top"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))
    blocks = lambda size, shingles: F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    whole = whole.select("family", F.col("top.root").alias("big"), blocks(F.col("top.size"), F.col("top.shingles")).alias("big_blocks"), blocks(F.col("size") - F.col("top.size"), F.col("shingles") - F.col("top.shingles")).alias("other_blocks"))
    placed = members.join(whole, "family").where("other_blocks > 0")
    cells = stored(_dealt(placed, ["family"], F.col("root") == F.col("big"), F.col("big_blocks"), F.col("other_blocks")).select("family", "i", "j", "mine", "node", "root"), "neardup-cells")
    rows = _sent(cells).join(texts, "node").select("family", "i", "j", "mine", "node", "root", "text")

    def of_cell(_, mine, root, texts):
        shingles = Shingler(words)
        links = joining([shingles(t) for t in texts], mine, root, percent)
        return tuple(root[np.array(x)] for x in zip(*links, strict=True)) if links else None

    held = dict.fromkeys(("mine", "root"), np.asarray) | {"text": _texts}
    return _by_cell(rows, ["family"], held, of_cell)


def _mixed_members(nodes: DataFrame, rooted: DataFrame, lay: Layout) -> DataFrame:
    """Members of the buckets that hold more than one component, with the bucket's largest one."""
    keys = _keyed_nodes(nodes, lay).join(rooted.select("node", "root"), "node")
    by_root = keys.groupBy("key", "root").agg(F.count("*").alias("size"))
    mixed = by_root.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("size")).where("size > top.size")
    mixed = mixed.select("key", F.col("top.root").alias("big"), F.col("top.size").alias("n_big"), (F.col("size") - F.col("top.size")).alias("n_other"))
    hit = keys.join(mixed, "key")
    return stored(hit.join(nodes, "node"), "neardup-mixed")


@small_batches
def _groups(docs: DataFrame, words: int, percent: int, text_col: str) -> tuple[DataFrame, DataFrame, str, str]:
    """(rows as ``_sets`` stores them, the root of each row's group by ``uid``, the names of the two columns in rows)."""
    lay = Layout(percent)
    uid, of = free_names(docs.columns, "uid", "set")
    rows = stored(_sets(docs, text_col, words, (uid, of)), "neardup-sets")
    small = rows.select(F.col(uid).alias("uid"), F.col(f"{of}.n").alias("n"), F.col(f"{of}.digest").alias("digest"))
    full = rows.where(F.col(f"{of}.n") > 0).select(F.col(uid).alias("uid"), f"{of}.*")
    nodes = stored(full.groupBy("digest", "n").agg(F.min("uid").alias("node"), F.min("sig").alias("sig")), "neardup-nodes")
    texts = rows.select(F.col(uid).alias("node"), F.col(f"`{text_col}`").alias("text"))
    plain = nodes.select("node", "n", "sig")
    # One partner a node: of the smallest members of its buckets, the nearest.
    keys = _keyed_nodes(plain, lay)
    hubs = keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("size")).where("size > 1").select("key", "b")
    pairs = keys.join(hubs, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    one = _near(pairs, plain, lay).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    links = _confirmed(one, texts, words, percent)
    # What is left between components, family by family.
    rooted = stored(_rooted(nodes.select("node", "n", "digest"), components(links, folded=True)), "neardup-rooted")
    families = components(_family_links(_mixed_members(plain, rooted, lay), lay), folded=True)
    above = components(_joined(families, rooted, texts, words, percent), folded=True).select(F.col("node").alias("root"), F.col("root").alias("top"))
    by_set = rooted.join(above, "root", "left").select("digest", "n", F.coalesce("top", "root").alias("root"))
    return rows, small.join(by_set, ["digest", "n"], "left").select("uid", F.coalesce("root", "uid").alias("root")), uid, of


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: set size, smallest id of its group, and whether it is the one kept.

    Links are pairs of texts whose shingle sets (``words`` words, letters A-Z lower-cased) reach ``percent`` (50 to 100)
    of Jaccard similarity, confirmed on the full sets; groups are what links connect. Texts without words (null, blank)
    link with nothing. Rows that repeat an id stay rows of their own; a row with a null id is kept and, alone in its
    group, has no group id. Ties: the smallest id. An empty table gives no rows; other columns are left out.
    """
    rows, roots, uid, of = _groups(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words, percent, "text")
    placed = stored(rows.select(F.col(uid).alias("uid"), "doc_id", F.col(f"{of}.n").alias("n_shingles")).join(roots, "uid"), "neardup-placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    r = placed.join(least, "root")
    return r.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with its columns: the one with the smallest id, of rows that repeat it the first stored."""
    rows, roots, uid, _ = _groups(docs, words, percent, text_col)
    ids = rows.select(F.col(uid).alias("uid"), F.col(f"`{id_col}`").alias("id")).join(roots, "uid")
    best = ids.groupBy("root").agg(F.min_by("uid", F.struct(F.col("id").isNull(), "id", "uid")).alias("uid"))
    gone = stored(ids.select("uid").join(best.select("uid"), "uid", "left_anti").select(F.col("uid").alias(uid)), "neardup-gone")
    return rows.join(_sent(gone), uid, "left_anti").select(*(f"`{c}`" for c in docs.columns))
