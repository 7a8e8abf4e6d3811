"""Evaluation texts leaking into training text, by latent semantic retrieval.

Passages are windows over all words of a document, unknown ones included, that start every ``STRIDE``
words and are so much longer than an item's window that a stretch of 1.25 times its length lies whole
within one.  A passage with fewer words of the items than any hit needs can't hold one and is left out.
A distributed randomised SVD of the TF-IDF passages (the items' windows among them) gives a latent
space; pairs of a passage and an item's window of at least some cosine in it are the candidates, and
the only ones.  The longest common subsequence of every candidate pair decides what is looked at
further: as many words of the item in one run are a verbatim leak; a subsequence of most of the window,
with the item's own last words behind it, is a paraphrase.

The corpus is read once for all items whose vocabulary fits ``VOCABULARY`` words.  The items are then
taken in blocks of bounded size, so that what is sent to the executors and to the driver (vocabulary,
item windows, a vocabulary-by-rank matrix) never grows with the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, spread

_WORD = re.compile(r"[^\W_]+")
BLOCK_WORDS = 100_000
VOCABULARY = 500_000
#: Words between the starts of passages; words of an item that are its answer, and of these as many must be there.
STRIDE = 8
ANSWER, TOLD = 3, 2
#: Passages are bit sets of one machine word.
WIDEST = 64
#: Passages that are compared at once, and cells of their word tables.
TOGETHER, CELLS, PAIRS = 1_024, 8_000_000, 1 << 14


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    found = _WORD.findall(text or "")
    return " ".join(found).lower().split(" ") if found else []


def _windows(n: int, need: int) -> Iterator[tuple[int, int]]:
    """Windows of 2 * need words, one starting every ``need``: each run of ``need`` words lies within one."""
    for a in range(0, max(1, n - need), need):
        yield a, min(n, a + 2 * need)


def _longest_run(a: list[int], b: list[int]) -> int:
    best = 0
    where: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    prev: dict[int, int] = {}
    for x in a:
        if (places := where.get(x)) is None:
            prev = {}
            continue
        prev = {j: prev.get(j - 1, 0) + 1 for j in places}
        if (run := max(prev.values())) > best:
            best = run
    return best


def _in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = max(row[j], row[j + 1], last + 1) if x == y else max(row[j], row[j + 1]), row[j + 1]
    return row[-1]


def _subsequences(masks: list[np.ndarray], width: int) -> np.ndarray:
    """Longest common subsequences of pairs: for each word of the windows, its places in the passages as bits (of each pair)."""
    row = np.full(len(masks[0]), np.uint64(2**64 - 1))
    u = np.empty_like(row)
    for m in masks:
        np.bitwise_and(row, m, out=u)
        row ^= u  # without the places that are met
        np.add(u, u, out=m)
        m += row
        np.bitwise_or(row, m, out=row)
    full = np.uint64((1 << width) - 1 if width < 64 else 2**64 - 1)
    return width - np.bitwise_count(row & full).astype(np.int64)


def _has_run(masks: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` words in a row are common, by doubling the length that the bits stand for."""

    def behind(x: np.ndarray, k: int) -> np.ndarray:
        y = np.zeros_like(x)
        y[:, k:] = x[:, :-k] << np.uint64(k)
        return y

    held, have = masks, 1
    while 2 * have <= n:
        held, have = held & behind(held, have), 2 * have
    if n > have:
        held = held & behind(held, n - have)
    return (held != 0).any(axis=1)


class _Terms:
    """The distinct terms of some passages (a matrix of word numbers, -1 where none) with their unit-length TF-IDF weights."""

    def __init__(self, passages: np.ndarray, idf: np.ndarray):
        rows, cols = np.nonzero(passages >= 0)
        keys, tf = np.unique(rows.astype(np.int64) * len(idf) + passages[rows, cols], return_counts=True)
        self.n, self.row, self.term = len(passages), keys // len(idf), keys % len(idf)
        w = tf * idf[self.term]
        norm = np.sqrt(np.bincount(self.row, w * w, minlength=self.n))
        self.weight = (w / norm[self.row]).astype(np.float32)

    def times(self, basis: np.ndarray) -> np.ndarray:
        """A B for the rows A of these passages."""
        out = np.zeros((self.n, basis.shape[1]), dtype=np.float32)
        if len(self.row):
            first = np.nonzero(np.diff(self.row, prepend=-1))[0]
            out[self.row[first]] = np.add.reduceat(self.weight[:, None] * basis[self.term], first, axis=0)
        return out

    def back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Add A' y to ``total``."""
        if len(self.row):
            order = np.argsort(self.term, kind="stable")
            term = self.term[order]
            first = np.nonzero(np.diff(term, prepend=-1))[0]
            total[term[first]] += np.add.reduceat(self.weight[order, None] * y[self.row[order]], first, axis=0)


class _Shape:
    """What passages look like: words needed in a row, their width, and how far behind them an item may go on."""

    def __init__(self, need: int, short: int, similar: float, longest: int):
        self.need, self.short, self.similar = need, short, similar
        self.width = math.floor(2 * need / similar) + STRIDE
        self.reach = math.ceil(max(0, longest - need) / similar) + ANSWER
        if not (1 <= short <= need and 0 < similar <= 1) or self.width > WIDEST:
            raise ValueError(f"passages of {self.width} words; {WIDEST} are the most (min_words / similar is at most {(WIDEST - STRIDE) // 2})")

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Where passages start that hold enough known words for a long item, or enough in a row for a short one."""
        n = len(ids)
        at = np.arange(0, max(1, n - self.width + STRIDE), STRIDE)
        end = np.minimum(at + self.width, n)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        ok = known[end] - known[at] >= self.need
        if self.short < self.need and n >= self.short:
            row = np.concatenate([[0], np.cumsum(known[self.short :] - known[: -self.short] == self.short)])  # rows of known words that start up to a place
            last = np.minimum(end - self.short + 1, len(row) - 1)
            ok |= row[np.maximum(last, at.clip(max=len(row) - 1))] > row[at.clip(max=len(row) - 1)]
        return at[ok]

    def cut(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The passages that start at some places, as a matrix."""
        padded = np.concatenate([ids, np.full(self.width, -1, dtype=ids.dtype)])
        return padded[at[:, None] + np.arange(self.width)]


class _Items:
    """A block of items: vocabulary and windows as word numbers, and what a hit on each window needs."""

    def __init__(self, items: list[tuple[object, list[str]]], vocab: dict[str, int], shape: _Shape):
        self.names = [key for key, _ in items]
        own: dict[int, int] = {}
        self.words = [[own.setdefault(vocab[w], len(own)) for w in ws] for _, ws in items]
        self.n_terms = len(own)
        self.local = np.full(len(vocab) + 1, -1, dtype=np.int32)  # the last place is that of unknown words, -1
        self.local[list(own)] = list(own.values())
        self.of, self.rest, windows = [], [], []
        for k, ids in enumerate(self.words):
            for a, b in _windows(len(ids), shape.need):
                self.of.append(k)
                windows.append(ids[a:b])
                self.rest.append(len(ids) - b)
        sizes = np.array([len(w) for w in windows])
        self.windows = np.full((len(windows), int(sizes.max())), -1, dtype=np.int32)
        for j, w in enumerate(windows):
            self.windows[j, : len(w)] = w
        self.run = np.minimum(shape.need, sizes)  # a short item must stand there whole
        self.least = np.where(sizes < shape.need, WIDEST + 1, np.maximum(shape.need, np.ceil(shape.similar * sizes))).astype(np.int64)
        self.share = np.sqrt(sizes / (2 * shape.need))

    def padded(self) -> np.ndarray:
        return np.where(self.windows < 0, self.n_terms, self.windows)


def _regions(docs: DataFrame, vocab: dict[str, int], shape: _Shape, id_type: str) -> DataFrame:
    """doc, region: stretches of word numbers (-1: unknown) made of passages that may hold a hit, with what follows them."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, shape = sent.value
        known, far = vocab.get, shape.width + shape.reach
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ws = words(text)
                if len(ws) < shape.short:
                    continue
                ids = np.fromiter((known(w, -1) for w in ws), dtype=np.int32, count=len(ws))
                at = shape.starts(ids)
                for part in np.split(at, np.nonzero(np.diff(at) > far)[0] + 1):
                    if part.size:
                        rows.append(k)
                        found.append(ids[part[0] : part[-1] + far])
            sizes = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=sizes[1:])
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32()))], ["doc", "region"])

    return spread(docs, "doc", "text").mapInArrow(run, f"doc {id_type}, region array<int>")


def _passages(column: pa.Array, items: _Items, shape: _Shape) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Regions in the block's word numbers, and their passages (with region and start), some thousand at a time."""
    offsets = column.offsets.to_numpy()
    flat = items.local[column.flatten().to_numpy(zero_copy_only=False)]
    base = offsets[0]
    regions, rows, at, cut, n = [], [], [], [], 0
    for i in range(len(column)):
        ids = flat[offsets[i] - base : offsets[i + 1] - base]
        starts = shape.starts(ids)
        if starts.size:
            rows.append(np.full(len(starts), i))
            at.append(starts)
            cut.append(shape.cut(ids, starts))
            n += len(starts)
        regions.append(ids)
        if n >= TOGETHER or n and i == len(column) - 1:
            yield regions, np.concatenate(rows), np.concatenate(at), np.concatenate(cut)
            rows, at, cut, n = [], [], [], 0


def _summed(regions: DataFrame, sent, shape: _Shape, what, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-term sums over all passages: each task adds up its own, then terms are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, *more = sent.value
        total, n = np.zeros((items.n_terms, width)), 0
        for batch in batches:
            if batch.num_rows:
                for _, _, _, passages in _passages(batch.column(0), items, shape):
                    what(passages, total, *more)
                    n += len(passages)
        term = np.nonzero(np.abs(total).sum(axis=1))[0]
        ids = np.concatenate([np.repeat(term, width), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.tile(np.arange(width), len(term)), [0]])), pa.array(np.concatenate([total[term].ravel(), [float(n)]]))], ["term", "j", "v"])

    t = regions.select("region").mapInArrow(run, "term bigint, j bigint, v double").groupBy("term", "j").agg(F.sum("v").alias("v")).toArrow()
    return t["term"].to_numpy(), np.stack([t["j"].to_numpy(), t["v"].to_numpy()]) if t.num_rows else np.zeros((2, 0))


def _table(found: tuple[np.ndarray, np.ndarray], n_terms: int, width: int) -> tuple[np.ndarray, float]:
    term, (j, v) = found
    out = np.zeros((n_terms, width))
    real = term >= 0
    out[term[real], j[real].astype(np.int64)] = v[real]
    return out, float(v[~real].sum())


def _count(passages: np.ndarray, total: np.ndarray) -> None:
    rows, cols = np.nonzero(passages >= 0)
    seen = np.unique(rows.astype(np.int64) * len(total) + passages[rows, cols]) % len(total)
    total[:, 0] += np.bincount(seen, minlength=len(total))


def _gram(passages: np.ndarray, total: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> None:
    """Add A' A B of these passages' rows A."""
    terms = _Terms(passages, idf)
    terms.back(terms.times(basis), total)


def _latent(regions: DataFrame, items: _Items, shape: _Shape, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """idf, and the leading right singular vectors of the TF-IDF passages (terms x rank)."""
    context = regions.sparkSession.sparkContext
    n = items.n_terms
    df, total = _table(_summed(regions, context.broadcast((items,)), shape, _count, 1), n, 1)
    _count(items.windows, df)
    total += len(items.windows)
    idf = np.log((1 + total) / (1 + df[:, 0])) + 1
    width = min(n, rank + 8)
    basis = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)

    def multiplied(basis: np.ndarray) -> np.ndarray:
        out, _ = _table(_summed(regions, context.broadcast((items, idf, basis)), shape, _gram, width), n, width)
        _gram(items.windows, out, idf, basis)
        return out

    basis = np.linalg.qr(multiplied(basis))[0]
    again = multiplied(basis.astype(np.float32))
    values, vectors = np.linalg.eigh((basis.T @ again + again.T @ basis) / 2)
    return idf, (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = 13,
    rank: int = 128,
    min_cosine: float = 0.3,
    similar: float = 0.8,
    seed: int = 7,
    short_words: int = 5,
) -> DataFrame:
    """``doc_id``, ``item_id``, run_words, shared_words: the documents that hold passages of items.

    run_words is the longest run of words that document and item have in common.  A pair is listed if that
    is at least ``min_words``, or all words of an item of ``short_words`` to ``min_words`` - 1 words, or if a
    stretch of the document and a window of the item have a longest common subsequence of at least
    ``similar`` of the window (and ``min_words``), and ``TOLD`` of the item's ``ANSWER`` last words stand in
    order in the stretch or as far behind it as the item goes on; shared_words is that length, 0 where the
    run decides.  Pairs whose latent cosine is below ``min_cosine`` (for shorter windows, times the root of
    their share of a full one) are no candidates and would be lost.  Null and empty texts, and items of
    fewer than ``short_words`` words, hold nothing; repeated documents come out each by its id; empty tables
    give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    docs = docs.select(docs[doc_id].alias("doc"), docs[text].alias("text")).where("text is not null")
    kinds = docs.schema["doc"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    items = items.select(items[item_id].alias("item"), items[text].alias("text")).where(F.octet_length("text") >= 2 * short_words - 1)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / (6 * BLOCK_WORDS)))
    only: list = []

    def held(block: int) -> list[tuple[object, list[str]]]:
        if not only:
            part = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
            told = [(r[0], ws) for r in part.distinct().toLocalIterator() if len(ws := words(r[1])) >= short_words]
            if n_blocks > 1:
                return told
            only.append(told)
        return only[0]

    groups: list[list] = []  # vocabulary, blocks, fewest and most words of an item
    for block in range(n_blocks):
        for _, ws in held(block):
            if not groups or block not in groups[-1][1] and len(groups[-1][0]) + len(ws) > VOCABULARY:
                groups.append([{}, [], len(ws), 0])
            vocab, blocks, fewest, most = groups[-1]
            for w in ws:
                vocab.setdefault(w, len(vocab))
            if block not in blocks:
                blocks.append(block)
            groups[-1][2:] = min(fewest, len(ws)), max(most, len(ws))
    out = None
    for vocab, blocks, fewest, most in groups:
        shape = _Shape(min_words, min(fewest, min_words), similar, most)
        regions = scratch.save(_regions(docs, vocab, shape, kinds[0]))
        for block in blocks:
            found = _block(regions, _Items(held(block), vocab, shape), shape, kinds, rank, min_cosine, seed)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"doc {kinds[0]}, item {kinds[1]}, run_words int, shared_words int")
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "run_words", "shared_words")


def _block(regions: DataFrame, items: _Items, shape: _Shape, kinds: tuple[str, str], rank: int, low: float, seed: int) -> DataFrame:
    idf, basis = _latent(regions, items, shape, rank, seed)
    latent = _unit(_Terms(items.windows, idf).times(basis))
    sent = regions.sparkSession.sparkContext.broadcast((items, idf, basis, latent))
    item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, basis, latent = sent.value
        padded, need, bars, v = np.ascontiguousarray(items.padded().T.astype(np.int64)), items.run, (low * items.share).astype(np.float32), items.n_terms
        runs = np.unique(items.run).tolist()
        step = max(16, min(TOGETHER, CELLS // (v + 1)))

        def told(ids: np.ndarray, start: int, j: int) -> bool:
            """Whether the item's own last words stand in a passage or as far behind it as the item goes on."""
            last = items.words[items.of[j]][-ANSWER:]
            far = ids[start : start + shape.width + math.ceil(items.rest[j] / shape.similar) + ANSWER].tolist()
            return any(_in_order(far[x : x + 2 * ANSWER], last) >= min(TOLD, len(last)) for x in range(len(far)))

        def checked(rows: np.ndarray, at: np.ndarray, passages: np.ndarray, regions: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
            """Region, item and common words (0: a run decides) of the hits among some passages."""
            cosine = _unit(_Terms(passages, idf).times(basis)) @ latent.T
            of, js = np.nonzero(cosine >= bars)  # the candidates
            places = np.zeros((len(passages), v + 1), dtype=np.uint64)
            every, known = np.arange(len(passages)), np.where(passages < 0, v, passages)
            for t in range(shape.width):
                places[every, known[:, t]] |= np.uint64(1 << t)
            places[:, v] = 0
            flat = places.ravel()
            for a in range(0, len(of), PAIRS):
                p, j = of[a : a + PAIRS], js[a : a + PAIRS]
                base = p * (v + 1)
                shared = _subsequences([flat.take(word.take(j, mode="clip") + base, mode="clip") for word in padded], shape.width)
                ok = shared >= need.take(j)
                p, j, shared = p[ok], j[ok], shared[ok]
                masks = places[p[:, None], padded[:, j].T]
                verbatim = np.zeros(len(p), dtype=bool)
                for n in runs:
                    mine = items.run[j] == n
                    verbatim[mine] = _has_run(masks[mine], n)
                for i in np.nonzero(verbatim)[0].tolist():
                    yield int(rows[p[i]]), items.of[j[i]], 0
                for i in np.nonzero(~verbatim & (shared >= items.least[j]))[0].tolist():
                    if told(regions[rows[p[i]]], int(at[p[i]]), int(j[i])):
                        yield int(rows[p[i]]), items.of[j[i]], int(shared[i])

        for batch in batches:
            if not batch.num_rows:
                continue
            best: dict[tuple[int, int], int] = {}
            regions: list[np.ndarray] = []
            for regions, rows, at, passages in _passages(batch.column(1), items, shape):
                for a in range(0, len(rows), step):
                    for i, k, shared in checked(rows[a : a + step], at[a : a + step], passages[a : a + step], regions):
                        old = best.get((i, k), -1)
                        best[i, k] = 0 if not shared or old == 0 else max(old, shared)
            found = [(i, items.names[k], _longest_run(regions[i].tolist(), items.words[k]), shared) for (i, k), shared in best.items()]
            cols = list(zip(*found)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], type=pa.int64())), pa.array(cols[1], type=item_type), pa.array(cols[2], type=pa.int32()), pa.array(cols[3], type=pa.int32())],
                ["doc", "item", "run_words", "shared_words"],
            )

    pairs = regions.mapInArrow(run, f"doc {kinds[0]}, item {kinds[1]}, run_words int, shared_words int")
    return pairs.groupBy("doc", "item").agg(F.max("run_words").alias("run_words"), F.when(F.min("shared_words") > 0, F.max("shared_words")).otherwise(0).alias("shared_words"))
