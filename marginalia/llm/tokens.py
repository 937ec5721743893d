"""Token counts by prefix dynamic programming: the exact count of every prefix of every text.

A sequence of BPE tokens is the encoding of its text exactly where each two neighbours, encoded together, stay as they
are. So the encoding of a prefix is that of a shorter prefix and one more token that goes with the last one there, and
its count is one more: one pass over a word gives the counts of all its prefixes, as beginnings of a longer word and as
words of their own (whose last token carries the word-end mark). The tokenizer's pre-tokenisation cuts a text into words
that BPE never crosses, from left to right and without looking ahead, so the counts of a text's prefixes are sums over
its words. The table of a text holds the change of the count with each character; it answers how many tokens a prefix
has, where a budget cuts, and how many the whole text has, without encoding anything again.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long, prefix_table binary"
_CACHE_WORDS = 400_000
_CACHE_PAIRS = 1_000_000


@cache
def _seconds() -> frozenset[str]:
    """Characters of combining class 0 that may compose with the one before."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    found = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"}
    jamo = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(c for c in found | jamo if not unicodedata.combining(c))


#: Characters with the Unicode property White_Space; Python's own white space holds four more.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, numbers and white space among ASCII, Latin and their lower case (some lie beyond); all other characters there are neither.
_END = 0x2AF
_LATIN = tuple("".join(re.escape(chr(c)) for c in [*range(_END + 1), 0x2C65, 0x2C66] if test(chr(c))) for test in (lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c)[0] == "N", lambda c: c in _SPACE))
_PLAIN = re.compile(f"[\0-{chr(_END)}\u2c65\u2c66]*")
_BREAK = regex.compile(f"[{_SPACE}]")


class Memo(dict):
    """Answers by key, made where one is missing; emptied between texts where it has grown too large."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def of(self, keys: list) -> list:
        if len(self) > _CACHE_WORDS:
            self.clear()
        return list(map(self.__getitem__, keys))


class PrefixCounter:
    """Exact prefix token counts of one tokenizer file: ``tokenizers`` JSON with NFC, lower case, split words and byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core only
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]
        if kinds != (["NFC", "Replace", "Lowercase"], "Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError(f"{path}: another normalisation or pre-tokenisation than this counter follows")
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = model["vocab"]
        #: Words in full, and beginnings of words, whose last symbol has no mark.
        self.whole = BPE(self.vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else BPE(self.vocab, merges)
        self.inner = BPE(self.vocab, merges)
        #: Ends of all tokens: 1 where one is whole without the word-end mark, 2 where with it (both where there is no mark).
        self.tails: dict[str, int] = {}
        self.states: dict[str, tuple[str, int, int]] = {}
        for token in self.vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            for k in range(1, len(body)):
                self.tails.setdefault(body[k:], 0)
            self.tails[body] = self.tails.get(body, 0) | (2 if ends else 1 if self.suffix else 3)
        whole = split["pattern"]["Regex"]
        #: The same pattern for Python's faster engine, over ASCII and over lower-case Latin texts.
        self.fast = [re.compile("(" + whole.replace(r"\p{L}", a).replace(r"\p{N}", b).replace(r"\s", c) + ")") for a, b, c in (("a-z", "0-9", r"\t\n\v\f\r "), _LATIN)]
        self.word = regex.compile(f"({whole})".replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.totals = Memo(self._changes), Memo(self._total)
        self.pairs: dict[tuple[str, str], bool] = {}
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: Byte-level BPE writes a byte as one character: printable Latin-1 as itself, the others from U+0100 on.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _lower(self, text: str) -> str:
        """Lower case character by character: Python alone treats a word's last sigma on its own; letters that it does not know yet are the library's."""
        if text.isascii():
            return text.lower()
        low = text.replace("Σ", "σ").lower()
        if new := [c for c in set(text) if unicodedata.category(c) == "Cn"]:
            low = low.translate({ord(c): self.tokenizer.normalizer.normalize_str(c) for c in new})
        return low

    def _stand_in(self, c: str) -> str:
        """A known character of the class that the library gives one without a category here."""
        parts = lambda t: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(t))
        return "a" if parts(f"a{c}a") == 1 else "!" if parts(f"!{c}!") == 1 else "1"

    def _go_together(self, a: str, b: str) -> bool:
        """Whether two tokens (or b alone, where a is empty) stay as they are when encoded together; b may carry the word-end mark."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _CACHE_PAIRS:
                self.pairs.clear()
            ends = self.suffix and b.endswith(self.suffix)
            got = (self.whole if ends else self.inner).tokenize(a + (b[: -len(self.suffix)] if ends else b))
            known = self.pairs[a, b] = [t.value for t in got] == ([a, b] if a else [b])
        return known

    def word_counts(self, word: str) -> list[int]:
        """Tokens of ``word[:1]``, ``word[:2]`` and so on, each as a word of its own.

        A beginning's state is its last token and count without the word-end mark, and its count as a whole word. Words
        share their beginnings, so states are kept. A new state tries the tokens that end there, shortest first, as far
        as the vocabulary has longer ones.
        """
        if word.isascii() and word.isprintable():
            piece, ends = word, None
        else:
            parts = ["".join([self.alphabet[b] for b in c.encode()]) for c in word]
            piece, ends = "".join(parts), list(accumulate(map(len, parts)))
        suffix, tails, states, known, check = self.suffix, self.tails, self.states, self.pairs.get, self._go_together
        if len(states) > _CACHE_WORDS:
            states.clear()
        before, whole = [("", 0, 0)], []
        for e in range(1, len(piece) + 1):
            state = states.get(piece[:e])
            if state is None:
                last, n, full = "", 0, 0
                for s in range(e - 1, -1, -1):
                    t = piece[s:e]
                    kind = tails.get(t)
                    if kind is None:
                        break
                    if kind:
                        a, k, _ = before[s]
                        if kind & 1 and not last and ((ok := known((a, t))) or ok is None and check(a, t)):
                            last, n = t, k + 1
                        if kind & 2 and not full and ((ok := known((a, t + suffix))) or ok is None and check(a, t + suffix)):
                            full = k + 1
                        if last and full:
                            break
                state = states[piece[:e]] = (last, n, full)
            before.append(state)
            whole.append(state[2])
        return whole if ends is None else [whole[e - 1] for e in ends]

    def _changes(self, word: str) -> bytes:
        """Change of the count with each character of a word or of white space, as signed bytes."""
        if not word.strip(_SPACE):
            return bytes(len(word))
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction that is cut short falls into two words
            counts = [sum(self.word_counts(t)[-1] for t in self.word.findall(word[: k + 1])) for k in range(len(word))]
        else:
            counts = self.word_counts(word)
        steps = list(map(sub, counts, [0, *counts]))
        if max(steps) > 127 or min(steps) < -127:
            raise ValueError("a character changes the count by more than 127 tokens")
        return bytes([x & 255 for x in steps])

    def _fast(self, low: str) -> re.Pattern | None:
        return self.fast[0] if low.isascii() else self.fast[1] if _PLAIN.fullmatch(low) else None

    def _parts(self, low: str) -> list[str]:
        """A normalised text's white space and words in turn."""
        if (fast := self._fast(low)) is not None:
            return fast.split(low)
        if new := [c for c in set(low) if unicodedata.category(c) == "Cn"]:
            like = low.translate({ord(c): self._stand_in(c) for c in new})
            at = list(accumulate(map(len, self.word.split(like)), initial=0))
            return [low[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        return self.word.split(low)

    def _parted(self, low: str) -> tuple[list[str], list[bytes]]:
        """A normalised text's white space and words in turn, and their changes."""
        parts = self._parts(low)
        return parts, self.words.of(parts)

    def _plain(self, text: str) -> np.ndarray:
        """Changes for a text without special strings."""
        low = self._lower(text)
        if len(low) == len(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return np.frombuffer(b"".join(self._parted(low)[1]), np.int8)
        # Pieces that normalise on their own: a character and what may compose with it.
        seconds = _seconds()
        starts = [i for i, c in enumerate(text) if not i or not unicodedata.combining(c) and c not in seconds]
        pieces = [text[s:e] for s, e in zip(starts, [*starts[1:], len(text)], strict=True)]
        lows = [self._lower(unicodedata.normalize("NFC", p)) for p in pieces]
        low = "".join(lows)
        parts, changes = self._parted(low)
        counts = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(changes), np.int8), dtype=np.int64)])
        word_starts = np.array([0, *list(accumulate(map(len, parts)))[:-1:2]], np.int64)
        out, q = [], 0
        for piece, own in zip(pieces, lows, strict=True):
            if len(piece) > 1:  # a cut inside the piece changes the last words only
                t0 = int(word_starts[max(0, np.searchsorted(word_starts, q - 3, "right") - 1)])  # contractions look two characters ahead
                for k in range(1, len(piece)):
                    part = low[t0:q] + self._lower(unicodedata.normalize("NFC", piece[:k]))
                    out.append(counts[t0] + sum(np.frombuffer(c, np.int8).sum() for c in self._parted(part)[1]))
            q += len(own)
            out.append(counts[q])
        return np.diff(np.array(out, np.int64), prepend=0)

    def table(self, text: str) -> np.ndarray:
        """The change of the token count with each character: their sum up to ``i`` is the count of ``text[:i]``.

        The tokenizer's special strings are one token each, as the library reads them; cut short, they are plain text.
        """
        if (m := self.special.search(text)) is None:
            return self._plain(text)
        before = self._plain(text[: m.end() - 1])
        whole = int(self._plain(text[: m.start()]).sum()) + 1
        return np.concatenate([before, [whole - int(before.sum())], self.table(text[m.end() :])])

    def _total(self, word: str) -> int:
        """Tokens of one whole word, from the BPE model alone."""
        return len(self.whole.tokenize(word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()])))

    def segments(self, text: str, longest: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of consecutive parts of a text, each of at most ``longest`` tokens by itself.

        Parts end where words end. A word that is longer is cut inside by its prefix table, and what is left of it is
        counted anew. A blank text is one part.
        """
        low = self._lower(text)
        if len(low) != len(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)) or self.special.search(text):
            return self._table_segments(text, longest)
        parts = self._parts(low)
        totals = self.totals.of(parts[1::2])
        if (n := sum(totals)) <= longest:
            return [(0, len(text), n)]
        counts = list(accumulate(totals, initial=0))
        ends = list(accumulate(map(len, parts)))[1::2]
        out, word, start = [], 0, 0
        while word < len(ends):
            last = bisect_right(counts, counts[word] + longest) - 1  # words that fit, counted from the first
            if last > word:
                out.append((start, ends[last - 1], counts[last] - counts[word]))
            else:
                last = word + 1
                out += [(start + s, start + e, n) for s, e, n in self._table_segments(text[start : ends[word]], longest)]
            word, start = last, ends[last - 1]
        if start < len(text):  # white space at the end
            out[-1] = (out[-1][0], len(text), out[-1][2])
        return out

    def _table_segments(self, text: str, longest: int) -> list[tuple[int, int, int]]:
        """The same from the prefix table of any text; parts end before white space where they can."""
        table = self.table(text)
        counts = np.cumsum(table, dtype=np.int64)
        out, start, base = [], 0, 0
        while True:
            if not len(counts) or counts[-1] - base <= longest:
                out.append((start, len(text), int(counts[-1]) - base if len(counts) else 0))
                return out
            end = start + int(np.flatnonzero(counts[start:] - base > longest)[0])  # the first prefix beyond the limit ends after it
            breaks = [m.start() for m in _BREAK.finditer(text, start + 1, end + 1)]
            solid = not breaks or not text[start : breaks[-1]].strip(_SPACE)
            end = max(end, start + 1) if solid else breaks[-1]
            out.append((start, end, int(counts[end - 1]) - base))
            if solid and not _BREAK.match(text, end):
                after = m.start() if (m := _BREAK.search(text, end)) else len(text)
                table = np.concatenate([table[:end], self.table(text[end:after]), table[after:]])
                counts = np.cumsum(table, dtype=np.int64)
            start, base = end, int(counts[end - 1])

    def encode_counts(self, texts: list[str]) -> list[int]:
        """The library's own counts; only tests need them."""
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def count_prefix(table: np.ndarray, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(table[:chars].sum(dtype=np.int64))


def cut(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    within = np.flatnonzero(np.cumsum(table, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


_counters: dict[str, PrefixCounter] = {}  # one counter a worker process, so that its memo serves all tasks there


def counter_of(path: str) -> PrefixCounter:
    return _counters.get(path) or _counters.setdefault(path, PrefixCounter(path))


def pack_table(table: np.ndarray) -> bytes:
    """A marking byte, then a byte for each change, or four where one doesn't fit."""
    small = not len(table) or np.abs(table).max() < 128
    return bytes([1 if small else 4]) + table.astype(np.int8 if small else "<i4").tobytes()


def unpack_table(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int8 if data[0] == 1 else np.dtype("<i4"), offset=1).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Prefix token counts of every whole text; a narrow operation of one row a document.

    ``cut_chars`` is the length of the longest prefix within ``limit`` tokens, ``prefix_table`` the change of the count
    with each character (``unpack_table``). A null text counts as an empty one (no bytes, no tokens); null ids and
    repeated rows pass through; other columns are left out.
    """

    def run(batches):
        counter = counter_of(tokenizer_path)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "over_limit", "cut_chars", "prefix_table")}
                for text in b.column(1).slice(s, 500).to_pylist():
                    text = text or ""
                    t = counter.table(text)
                    n = int(t.sum(dtype=np.int64))
                    out["n_bytes"].append(len(text.encode()))
                    out["n_tokens"].append(n)
                    out["over_limit"].append(n > limit)
                    out["cut_chars"].append(cut(t, limit) if n > limit else len(text))
                    out["prefix_table"].append(pack_table(t))
                cols = [b.column(0).slice(s, 500), *(pa.array(out[k], kind) for k, kind in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *out])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
