"""Splitting oversized documents at natural boundaries, by dynamic programming.

Cut positions are all ends of cells, paragraphs, lines, sentences and words, and, only in stretches
without any of these, all places between pre-tokens and between the tokens of very long ones.  Over the cuts of a document, in order, the cost
of a split is the sum of its cut penalties and of the squared deviations of the piece sizes from an
even size; the cheapest split with every piece within the limit is taken.  A piece starts at the
earliest natural end at which it shares at most the wanted overlap with the piece before; after a
cut at no natural end, at the earliest such place.

Sizes are exact: they count the tokens that a piece has when it is encoded by itself, which at a cut
within white space differs from its share of the tokens of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import spread
from .tokenizer import DEFAULT, WHITE, ByteBPE, load, no_collection, portions

CELL, PARAGRAPH, LINE, SENTENCE, WORD, OTHER = range(6)
KINDS = ("cell", "paragraph", "line", "sentence", "word", "other")
PENALTY = np.array([0.0, 0.1, 0.25, 0.5, 1.0, 6.0])
IMBALANCE = 2.0
TOKENS = 0xFFFFFFF
#: Tokens that a piece may have more by itself where it starts or ends within a word; tokens up to which a pre-token is never cut.
EDGE, WHOLE = 2, 16
PIECE = 0.5
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


class _Runs(dict):
    """Of a run of white space with line ends: its last line end, the kind, and the tokens of the parts before it and after it (without the last character)."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.sizes = bpe, {"": 0}

    def size(self, text: str) -> int:
        """Tokens of a text; those of short ones, which come again and again, are remembered."""
        if (n := self.sizes.get(text)) is None:
            n = self.bpe.count(text)
            if len(text) < 64 and len(self.sizes) < 200_000:
                self.sizes[text] = n
        return n

    def __missing__(self, run: str) -> tuple[int, int, int, int]:
        ends = [m.end() for m in _BREAK.finditer(run)]
        p = ends[-1]
        self[run] = out = (p, PARAGRAPH if len(ends) > 1 else LINE, self.size(run[:p]), self.size(run[p:-1]) if len(run) - p > 1 else 0)
        return out


class _Doc:
    """One document: its natural ends, and the token counts of pieces that start or end there."""

    def __init__(self, text: str, words: list[str], bpe: ByteBPE, info: np.ndarray, cells: list[int], runs: _Runs):
        self.text, self.bpe, self.words, self.memo = text, bpe, words, runs
        self.pos = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(info & 0x3FFFFFFF, out=self.pos[1:])
        self.sums = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum((info >> 30) & TOKENS, out=self.sums[1:])
        self._ends(info, cells, runs)

    def _ends(self, info: np.ndarray, cells: list[int], memo: _Runs) -> None:
        """pos_, kind, e (tokens of a piece ending there, counted from the start), s (tokens before a piece starting there)."""
        text, n = self.text, len(self.text)
        white, starts, breaks = (info >> 60) & 1 == 1, (info >> 61) & 1 == 1, (info >> 62) & 1 == 1
        opens = starts.copy()
        opens[1:] &= ~white[:-1]
        first = np.nonzero(opens)[0]  # pre-tokens at which runs of white space start
        # the run ends before the first later pre-token that isn't all white, or after that one's leading blank
        solid = np.nonzero(~white)[0]
        after = np.searchsorted(solid, first)
        last = np.where(after < len(solid), solid[np.minimum(after, len(solid) - 1)], len(info)) if len(solid) else np.full(len(first), len(info))
        lead = np.zeros(len(info) + 1, dtype=np.int64)
        lead[:-1] = starts & ~white
        ends = self.pos[last] + lead[last]
        broken = np.concatenate([[0], np.cumsum(breaks)])
        has = broken[last] > broken[first]
        begin = self.pos[first]
        self.run_starts = begin
        wide = (info >> 58) & 1 == 1
        stop = wide | ((info >> 59) & 1 == 1)
        alone = np.nonzero(wide[:-1] & ~starts[1:])[0] + 1  # a sentence may end without white space behind it
        place = np.concatenate([first[~has], alone])
        word, word_tokens = self.pos[place], self.sums[place]
        word_kind = np.where(stop[place - 1], SENTENCE, WORD)
        ok = (word > 0) & (word < n)
        word, word_tokens, word_kind = word[ok], word_tokens[ok], word_kind[ok]
        ends_in_text = set(c for c in cells if 0 < c < n)
        sums, place = self.sums, self.pos
        begin, b, i = begin[has], ends[has], first[has]
        told = map(memo.__getitem__, [text[x:y] for x, y in zip(begin.tolist(), b.tolist())])
        told = np.fromiter(chain.from_iterable(told), dtype=np.int64, count=4 * len(i)).reshape(-1, 4)
        at = begin + told[:, 0]
        if len(at) and at[-1] >= n:  # the last run may end the text
            at, b, i, told = at[:-1], b[:-1], i[:-1], told[:-1]
        kind, e, rest = told[:, 1].copy(), sums[i] + told[:, 2], told[:, 3]
        if ends_in_text and len(at):
            met = np.isin(at, list(ends_in_text))
            kind[met] = CELL
            ends_in_text.difference_update(at[met].tolist())
        inner = (b - at > 1) & (b < n)
        edge = np.where(b - at > 0, b - 1, b)
        k = np.searchsorted(place, edge)
        exact = place[np.minimum(k, len(place) - 1)] == edge
        s = np.where(inner, sums[k] - rest, sums[k])
        for q in np.nonzero(~exact | ((b == n) & (b > at)))[0].tolist():
            s[q] = self._before(int(at[q]))
        pos, kind, e = at.tolist(), kind.tolist(), e.tolist()
        lone = sorted(ends_in_text)  # only these can fall on the end of a word
        for p in lone:
            pos.append(p)
            kind.append(CELL)
            e.append(self._upto(p, memo))
            s = np.append(s, self._before(p))
        pos, kind, e = np.array(pos, dtype=np.int64), np.array(kind, dtype=np.int64), np.array(e, dtype=np.int64)
        if lone:
            free = ~np.isin(word, lone)
            word, word_tokens, word_kind = word[free], word_tokens[free], word_kind[free]
        pos = np.concatenate([pos, word])
        order = np.argsort(pos, kind="stable")
        self.natural = (
            pos[order],
            np.concatenate([kind, word_kind])[order],
            np.concatenate([e, word_tokens])[order],
            np.concatenate([s, word_tokens])[order],
        )

    def _before(self, p: int) -> int:
        """Tokens before a piece that starts at ``p``."""
        k = int(np.searchsorted(self.pos, p))
        end = int(self.pos[k])
        return int(self.sums[k]) - self.memo.size(self.text[p:end])

    def _upto(self, p: int, memo: _Runs) -> int:
        """Tokens from the start of the text to a piece's end at ``p``."""
        k = int(np.searchsorted(self.pos, p))
        begin = p if int(self.pos[k]) == p else int(self.pos[k - 1])
        if self.text[p - 1] in WHITE:
            begin = int(self.run_starts[np.searchsorted(self.run_starts, p - 1, side="right") - 1])
        k = int(np.searchsorted(self.pos, begin))
        return int(self.sums[k]) + memo.size(self.text[begin:p])

    def _hard(self, low: int, high: int) -> list[tuple[int, int]]:
        """(position, tokens before) between two token counts, where nothing natural stands."""
        i, j = np.searchsorted(self.sums, low, side="right"), np.searchsorted(self.sums, high, side="left")
        i, j = max(1, i) - 1, min(len(self.words), j)
        each = list(map(self.bpe.known.__getitem__, self.words[i:j]))
        ids = np.fromiter(chain.from_iterable(each), dtype=np.int64)
        if not len(ids):
            return []
        n = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        fit = np.repeat(n > WHOLE, n)  # shorter pre-tokens stay whole
        fit[np.cumsum(n) - n] = True
        start, stretch = int(self.pos[i]), self.text[int(self.pos[i]) : int(self.pos[j])]
        upto = np.concatenate([[0], np.cumsum(self.bpe.sizes[ids])[:-1]])  # bytes and tokens before each token
        at = int(self.sums[i]) + np.arange(len(ids))
        if not stretch.isascii():  # only where the tokens so far are whole characters
            opens = np.frombuffer(stretch.encode("utf-8", "replace"), dtype=np.uint8) & 0xC0 != 0x80
            whole = opens[upto]
            upto, at, fit = np.cumsum(opens)[upto[whole]] - 1, at[whole], fit[whole]
        ok = (at > low) & (at < high) & fit
        return list(zip((start + upto[ok]).tolist(), at[ok].tolist()))

    def split(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """(start, end, tokens, tokens shared with the piece before, kind of the cut at the end)."""
        total = int(self.sums[-1])
        pos, kind, e, s = self.natural
        cp, ck, ce, cs = pos, kind, e, s
        room = max(8, limit - overlap - 16)
        edges = np.concatenate([[0], ce, [total]])
        hard: list[tuple[int, int]] = []
        for k in np.nonzero(np.diff(edges) > room // 2)[0]:
            hard += self._hard(int(edges[k]), int(edges[k + 1]))
        if hard:
            hp, ht = np.array([p for p, _ in hard]), np.array([t for _, t in hard])
            cp, ck, ce, cs = np.concatenate([cp, hp]), np.concatenate([ck, np.full(len(hp), OTHER)]), np.concatenate([ce, ht]), np.concatenate([cs, ht])
            order = np.argsort(cp, kind="stable")
            cp, ck, ce, cs = cp[order], ck[order], ce[order], cs[order]
        # where the next piece starts: the earliest natural end that shares at most the overlap, or place if the cut is no natural end
        np_, ns = cp.copy(), cs.copy()
        for mine, p, t, share in ((ck != OTHER, pos, s, overlap), (ck == OTHER, cp, cs, max(0, overlap - EDGE))):
            if len(p) and mine.any():
                at = np.minimum(np.searchsorted(t, ce[mine] - share, side="left"), len(t) - 1)
                ok = p[at] < cp[mine]
                np_[mine], ns[mine] = np.where(ok, p[at], cp[mine]), np.where(ok, t[at], cs[mine])
        if hard:
            np_, ns = np.maximum.accumulate(np_), np.maximum.accumulate(ns)
        # candidates are numbered from 1; 0 is the start of the text and the last one its end
        n = len(cp)
        begin = np.concatenate([[0], ns]).astype(np.int64)
        ends = np.concatenate([[0], ce, [total]]).astype(np.int64)
        if hard:  # pieces that start or end between the tokens of a word may have a few more by themselves
            ends[1:-1] += EDGE * (ck == OTHER)
            begin[1:] -= EDGE * (ck == OTHER)
            begin = np.maximum.accumulate(begin)
        fine = np.concatenate([[0.0], PENALTY[ck], [0.0]]) + PIECE
        parts = max(1, -(-(total - overlap) // (limit - overlap)))
        even = (total + overlap * (parts - 1)) / parts
        scale = IMBALANCE / limit**2 * 4
        cuts: list[int] = []
        for least in (min(limit // 2, int(0.75 * even)), 3 * overlap // 2, 1)[bool(hard) :]:  # small pieces are better than none, and than a cut within a word
            best, back = self._cheapest(begin, ends, fine, even, limit, scale, least)
            if not np.isfinite(best[-1]):
                continue
            cuts, j = [], n + 1
            while j:
                cuts.append(j)
                j = int(back[j])
            break
        if not cuts:
            return []
        out, i = [], 0
        for j in reversed(cuts):
            start = 0 if i == 0 else int(np_[i - 1])
            shared = 0 if i == 0 else int(ends[i] - begin[i])
            end = len(self.text) if j == n + 1 else int(cp[j - 1])
            out.append((start, end, int(ends[j] - begin[i]), shared if start < (int(cp[i - 1]) if i else 0) else 0, int(ck[j - 1]) if j <= n else CELL))
            i = j
        return out

    @staticmethod
    def _cheapest(begin: np.ndarray, ends: np.ndarray, fine: np.ndarray, even: float, limit: int, scale: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Cost of the cheapest split up to each cut and the cut before it; all pieces but the last have ``least`` tokens or more."""
        n = len(ends)
        at = np.arange(n)
        low = np.searchsorted(begin, ends - limit, side="left")
        high = np.minimum(np.searchsorted(begin, ends - least, side="right"), at)
        high[-1] = n - 1
        upto = np.searchsorted(high, at, side="right").tolist()  # cuts whose predecessors all lie before this one
        lows, highs, j = low.tolist(), high.tolist(), 1
        # (end - even - begin) squared is taken apart: what depends on the predecessor alone is added to its cost
        end, from_ = ends - even, np.append(begin, 0).astype(np.float64)
        own, square, slope = scale * end * end + fine, scale * from_ * from_, (-2 * scale) * from_
        best, back = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        best[0] = 0.0
        ahead = best + square
        low, high = low[:, None], high[:, None]
        while j < n:
            m = max(j + 1, min(upto[j], n))
            a, b = lows[j], highs[m - 1]
            if m == n and highs[-1] > j:
                m = max(j + 1, n - 1)
                b = highs[m - 1]
            if b > a:
                cost = np.multiply.outer(end[j:m], slope[a:b])
                cost += ahead[a:b]
                if lows[m - 1] > a:  # only the corners of the band need to be cut off
                    np.copyto(cost[:, : lows[m - 1] - a], np.inf, where=at[a : lows[m - 1]] < low[j:m])
                if highs[j] < b:
                    np.copyto(cost[:, max(0, highs[j] - a) :], np.inf, where=at[max(a, highs[j]) : b] >= high[j:m])
                k = cost.argmin(axis=1)
                found = cost[at[: m - j], k]
                found += own[j:m]
                best[j:m] = found
                found += square[j:m]
                ahead[j:m] = found
                k += a
                back[j:m] = k
            j = m
        return best, back

    def _forced(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """Where no places between tokens will do: as many characters at a time as fit."""
        count, out, start, n, shared = self.bpe.count, [], 0, len(self.text), 0
        while True:
            step = limit
            while start + step < n and count(self.text[start : start + step]) <= limit:
                step *= 2
            low, high = 1, min(n - start, step)
            while low < high:  # the most characters within the limit
                middle = (low + high + 1) // 2
                low, high = (middle, high) if count(self.text[start : start + middle]) <= limit else (low, middle - 1)
            end = start + low
            out.append((start, end, count(self.text[start:end]), shared, OTHER))
            if end == n:
                return out
            start = self._within(start + 1, end, overlap)
            shared = count(self.text[start:end]) if start < end else 0

    def _within(self, start: int, end: int, overlap: int) -> int:
        """The first place from ``start`` on from which at most ``overlap`` tokens lead to ``end`` (by halving, then step by step)."""
        low, high = start, end
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.bpe.count(self.text[middle:end]) <= overlap else (middle + 1, high)
        while low < end and self.bpe.count(self.text[low:end]) > overlap:
            low += 1
        return low

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """As :meth:`split`; where cuts fall between the tokens of a word, sizes are counted again and the limit lowered until they hold."""
        tight, count = limit, self.bpe.count
        while True:
            found = self.split(tight, overlap)
            if found and not any(x[4] == OTHER for x in found):
                return found
            exact: list[tuple[int, int, int, int, int]] = []
            for piece in found:
                start, end, _, _, kind = piece
                after = exact[-1][4] if exact else CELL
                if OTHER in (after, kind):  # between natural ends the sizes are exact
                    before = exact[-1][1] if exact else start
                    shared = count(self.text[start:before]) if start < before else 0
                    if shared > overlap and after == OTHER:
                        start = self._within(start, before, overlap)
                        shared = count(self.text[start:before]) if start < before else 0
                    piece = start, end, count(self.text[start:end]), shared, kind
                exact.append(piece)
            if exact and all(x[2] <= limit and x[3] <= overlap for x in exact):
                return exact
            tight -= max(8, limit // 32)
            if tight <= max(overlap + overlap // 2, limit // 2):
                return self._forced(limit, overlap)


def split_documents(
    docs: DataFrame, max_tokens: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text", cells_col: str | None = "cells", tokenizer_path: str = DEFAULT
) -> DataFrame:
    """Pieces of every text of more than ``max_tokens`` tokens.

    Columns: ``id_col``, piece_no (from 1), start_pos, end_pos (characters from 0, end excluded), n_tokens,
    overlap_tokens (shared with the piece before), cut (what ends there: cell, paragraph, line, sentence, word,
    other; 'end' for the last piece) and text.  ``overlap`` must be less than ``max_tokens``.  Null, empty and short texts give no rows, null ``cells`` no
    cell ends, cell ends outside of the text don't count; repeated rows are split like others.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError(f"an overlap of {overlap} of {max_tokens} tokens")
    ends = F.transform(docs[cells_col], lambda c: c["end_pos"]) if cells_col else F.lit(None).cast("array<int>")
    # a text has at most as many tokens as bytes, so short ones can't be oversized
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"), ends.alias("ends")).where(F.octet_length("text") > max_tokens)
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, "piece_no", "start_pos", "end_pos", "n_tokens", "overlap_tokens", "cut", "text"]

    def cut(bpe: ByteBPE, memo: _Runs, texts: list[str], cells: list[list[int]]) -> tuple[list[int], list[list]]:
        row, cols = [], [[] for _ in names[1:]]
        for k, (text, words) in enumerate(zip(texts, bpe.encode(texts))):
            info = np.fromiter(map(bpe.shape.__getitem__, words), dtype=np.int64, count=len(words))
            if int(((info >> 30) & TOKENS).sum()) <= max_tokens:
                continue
            d = _Doc(text, words, bpe, info, [x for x in cells[k] or [] if x is not None], memo)
            for i, (start, end, n, shared, kind) in enumerate(d.pieces(max_tokens, overlap)):
                row.append(k)
                for c, v in zip(cols, (i + 1, start, end, n, shared, KINDS[kind] if end < len(text) else "end", text[start:end])):
                    c.append(v)
        return row, cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        if bpe.shape is None:
            bpe.known.clear()
            bpe.shape = {}
        memo = _Runs(bpe)
        for batch in batches:
            texts, cells = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in portions(texts, 2_000_000):
                with no_collection():
                    row, cols = cut(bpe, memo, texts[a:b], cells[a:b])
                ids = batch.column(0).take(pa.array([a + k for k in row], type=pa.int64()))
                arrays = [pa.array(c, type=pa.int32()) for c in cols[:5]] + [pa.array(c, type=pa.string()) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    return spread(rows, id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, piece_no int, start_pos int, end_pos int, n_tokens int, overlap_tokens int, cut string, text string")


def joined(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, text, most_tokens, most_shared: the texts that pieces were cut from, overlaps left out, with the largest size and overlap.

    Pieces of one text meet in one task, which holds no more than that text.  An empty table gives no rows.
    """
    before = F.lag("end_pos", 1, 0).over(Window.partitionBy(id_col).orderBy("piece_no"))
    own = pieces.withColumn("skip", before - F.col("start_pos")).withColumn("own", F.substring(F.col("text"), F.col("skip") + 1, F.length("text")))
    out = own.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("p"), F.max("n_tokens").alias("most_tokens"), F.max("overlap_tokens").alias("most_shared"))
    return out.select(id_col, F.array_join(F.transform("p", lambda x: x["own"]), "").alias("text"), "most_tokens", "most_shared")
