"""Encoding of a corpus with a public byte-level BPE tokenizer.

The merges of a pre-token run on a segment tree over the ranks of adjacent pairs: the root holds
the lowest rank, a descent that prefers the left child finds its leftmost place, and a merge
changes three leaves and their ancestors.  It ends when no pair at the root can be merged.
Pre-tokens of common length run through one tree array per length class, all words of a batch at
once; longer ones have a tree each.  Every distinct pre-token of a task is encoded once while the
task remembers it.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..scratch import spread

DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"
#: The tokenizer's own split pattern (fixed value), and the same for texts that are all ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ANY = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: White space and line ends of the pattern's character classes (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BREAKS = frozenset("\n\x0b\x0c\r\x85\u2028\u2029")
#: What ends a sentence before white space, what ends one by itself, and what may close a quotation behind it (fixed values).
STOPS, WIDE_STOPS, CLOSERS = frozenset(".!?…‽؟।"), frozenset("。！？｡"), "\"'”’»)]}」』）】"
NONE = np.int32(2**30)
LONGEST = 64  # pre-tokens of more bytes have a tree of their own
REMEMBER = 600_000


def _compiled(letters: str, digits: str, spaces: str) -> re.Pattern:
    """The pattern for the standard library's engine, which is faster where classes are plain ranges."""
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


_ASCII = _compiled("A-Za-z", "0-9", r"\t-\r ")


@lru_cache(maxsize=1)
def _bmp() -> re.Pattern:
    """The same for texts without characters beyond the basic plane."""

    def ranges(kind: str) -> str:
        plane = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))
        return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(rf"\p{{{kind}}}+", plane))

    return _compiled(ranges("L"), ranges("N"), ranges("White_Space"))


def pretokens(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text)
    return (_bmp() if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else _ANY).findall(text)


class ByteBPE:
    """Merge table of a byte-level BPE tokenizer file (``tokenizers`` JSON)."""

    def __init__(self, path: str = DEFAULT):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # byte-level vocabularies write each byte as a printable character: printable Latin-1 as itself, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.byte_id = np.array([vocab[char[b]] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys, rank = (left << 32) | right, np.arange(len(pairs), dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        self.pair = dict(zip(keys.tolist(), rank.tolist()))
        b = self.byte_id.astype(np.int64)
        self.first = self._rank(np.repeat(b, 256), np.tile(b, 256)).reshape(256, 256)
        self.known: dict[str, tuple[int, ...]] = {}
        self.shape: dict[str, int] | None = None  # filled where a caller wants it
        self.sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of each token
        for w, i in vocab.items():
            self.sizes[i] = len(w)
        byte = {c: b for b, c in char.items()}
        self.spelt = {i: bytes(byte[c] for c in w) for w, i in vocab.items() if all(c in byte for c in w)}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _trees(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Encode words of 2 to leaves + 1 bytes, all at once."""
        n, wide = len(words), leaves + 1
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), dtype=np.uint8).reshape(n, wide)
        ids = np.zeros((n, wide + 1), dtype=np.int32)
        ids[:, :wide] = self.byte_id[raw]
        after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int32)
        tree[:, leaves:] = np.where(np.arange(1, wide) < size[:, None], self.first[raw[:, :-1], raw[:, 1:]], NONE)
        k = leaves
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        live = np.arange(wide) < size[:, None]

        def update(rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + leaves
            tree[rows, node] = rank
            node = node >> 1
            while node[0] >= 1:  # all nodes of a call are on one level
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while rows.size:
            low = tree[rows, 1]
            node = np.ones(rows.size, dtype=np.int64)
            while node[0] < leaves:
                node = 2 * node
                node += tree[rows, node] != low
            at = node - leaves
            gone = after[rows, at]
            beyond = after[rows, gone]
            new = self.made[low]
            ids[rows, at] = new
            live[rows, gone] = False
            after[rows, at] = beyond
            inside = beyond < size[rows]
            before[rows[inside], beyond[inside]] = at[inside]
            # the pair that began at the place that is gone; the one of the new symbol; the one before it
            still = gone < leaves
            if still.any():
                update(rows[still], gone[still].astype(np.int64), np.full(int(still.sum()), NONE))
            right = np.where(inside, self._rank(new, ids[rows, np.minimum(beyond, wide)]), NONE)
            update(rows, at, right)
            prev = before[rows, at]
            has = prev >= 0
            if has.any():
                r, p = rows[has], prev[has].astype(np.int64)
                update(r, p, self._rank(ids[r, p], new[has]))
            rows = rows[tree[rows, 1] < NONE]
        counts = live.sum(axis=1)
        flat = ids[:, :wide][live].tolist()
        out, k = [], 0
        for c in counts.tolist():
            out.append(tuple(flat[k : k + c]))
            k += c
        return out

    def _tree(self, word: bytes) -> tuple[int, ...]:
        """Encode one long word with a tree of its own."""
        n = len(word)
        leaves = 1 << (n - 2).bit_length()
        none, pair, made = int(NONE), self.pair, self.made.tolist()
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = pair.get((ids[i] << 32) | ids[i + 1], none)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(leaf: int, rank: int) -> None:
            k = leaf + leaves
            tree[k] = rank
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < none:
            low, k = tree[1], 1
            while k < leaves:
                k = 2 * k if tree[2 * k] == low else 2 * k + 1
            at = k - leaves
            gone = after[at]
            beyond = after[gone]
            ids[at] = made[low]
            ids[gone] = -1
            after[at] = beyond
            if gone < leaves:
                update(gone, none)
            if beyond < n:
                before[beyond] = at
                update(at, pair.get((ids[at] << 32) | ids[beyond], none))
            else:
                update(at, none)
            if (p := before[at]) >= 0:
                update(p, pair.get((ids[p] << 32) | ids[at], none))
        return tuple(x for x in ids if x >= 0)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that aren't known yet."""
        todo = [w for w in words if w not in self.known]
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in todo:
            raw = w.encode("utf-8", "replace")
            if len(raw) == 1:
                self.known[w] = (int(self.byte_id[raw[0]]),)
            elif len(raw) > LONGEST + 1:
                self.known[w] = self._tree(raw)
            else:
                by.setdefault(1 << max(0, (len(raw) - 2).bit_length()), []).append((w, raw))
        for leaves, group in by.items():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                for (w, _), ids in zip(part, self._trees([r for _, r in part], leaves)):
                    self.known[w] = ids
        if self.shape is not None:
            for w in todo:
                flags = 0
                if w[0] in WHITE:
                    flags = 8 if w.strip(WHITE) else 12 if BREAKS.isdisjoint(w) else 28
                if not w[-1].isalnum():
                    last = w.rstrip(CLOSERS)[-1:]
                    flags |= (last in STOPS) << 1 | (last in WIDE_STOPS)
                self.shape[w] = len(w) | len(self.known[w]) << 30 | flags << 58

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text, all of them known afterwards."""
        if len(self.known) > REMEMBER:
            self.known.clear()
            if self.shape is not None:
                self.shape.clear()
        split = [pretokens(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return split

    def count(self, text: str) -> int:
        """Tokens of one text; forgets nothing that is known."""
        words = pretokens(text)
        self.learn(set(words))
        return sum(len(self.known[w]) for w in words)

    def text(self, ids: Iterable[int]) -> str:
        """The text that some ids spell; bytes that are no characters are replaced."""
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")

    def ids(self, texts: list[str]) -> list[list[int]]:
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, p))) for p in self.encode(texts)]


@contextmanager
def no_collection() -> Iterator[None]:
    """Without the cycle collector: millions of short-lived tuples and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@lru_cache(maxsize=4)
def load(path: str = DEFAULT) -> ByteBPE:
    return ByteBPE(path)


def portions(texts: list, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` characters (at least one row)."""
    start = n = 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield start, k + 1
            start, n = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = DEFAULT) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>, no special tokens) of every row; [] for an empty and for a null text.

    Rows stay rows: repeated texts and null ids are encoded like others, an empty table gives none.
    Strings of special tokens in a text are ordinary text.
    """
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts, 4_000_000):
                with no_collection():
                    found = bpe.ids([t or "" for t in texts[a:b]])
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [id_col, "ids"])

    return spread(rows, id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", tokenizer_path: str = DEFAULT) -> DataFrame:
    """``id_col`` and text of every row of ``encoded`` (``id_col``, ids), the way back of :func:`encode_corpus`; '' for null and empty lists."""
    rows = encoded.select(encoded[id_col].alias(id_col), encoded["ids"].alias("ids"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.text(x or ()) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")
