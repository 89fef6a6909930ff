"""Substring dedup with a compressed FM-index per shard.

Removes each word covered by a window of ``WIDTH`` words whose word sequence also starts earlier (in
a document of smaller id, or earlier in the same one).

The texts of a shard are contexts of anchors (``repeated``): each distinct one once, with its number and first
occurrence. They are put one after another, each closed by a separator, and the Burrows-Wheeler
transform of the whole is kept as a wavelet matrix: one bit vector for each bit of the word numbers,
packed, with running counts. Backward search extends a match to the left word by word; the number
of words matched while the suffix range holds two occurrences is the matching statistic of a position. Windows of
length WIDTH that are matched whole are repeated; the least first occurrence among the range's
suffixes, by a sparse table of minima, is the window's first occurrence, which stays. Nothing else decides.

Documents stream in blocks through the searches of their shard; all positions of a block step together.

Defined cases: null texts have no words; texts under WIDTH words are kept whole. Repeated rows are
documents of their own, in the order of (doc_id, text hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeslab.llm import blocks as B
from treeslab.llm import repeated as R
from treeslab.llm.shared import keyed

WIDTH = 20
#: Windows that are searched together.
STEP = 1 << 16


class Wavelet:
    """A sequence of numbers below 2 ** bits as a wavelet matrix; rank(c, i) counts c in the first i."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.packed, self.counts, self.zeros = [], [], []
        for k in range(bits - 1, -1, -1):
            bit = ((values >> k) & 1).astype(np.uint8)
            words = np.frombuffer(np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, dtype=np.uint8)], bitorder="little").tobytes(), dtype="<u8")
            self.packed.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.r_[values[bit == 0], values[bit == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each symbol among the first ``at`` entries (one row for each end of a range)."""
        lo = np.zeros(len(symbol), dtype=np.int64)
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> k) & 1).astype(bool)
            stacked = np.concatenate((lo[None], at)) if at.ndim == 2 else np.stack((lo, at))
            word = stacked >> 6
            part = self.packed[level][word] & ((np.uint64(1) << (stacked & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][word] + np.bitwise_count(part)
            moved = np.where(one, ones + self.zeros[level], stacked - ones)
            lo, at = moved[0], moved[1:] if at.ndim == 2 else moved[1]
        return at - lo


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of numbers, sorted on ``depth`` symbols at least, by doubling; ties by place."""
    n = len(text)
    rank = text.astype(np.int64)
    have = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[1:] = np.cumsum(np.diff(key[order]) != 0)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        have *= 2
        if new[-1] == n - 1 or have >= depth:
            return order


class FmIndex:
    """An index of texts of word numbers (from 1 on), with the rank of each text's first occurrence and how often it occurs."""

    def __init__(self, texts: np.ndarray, base: np.ndarray, first: np.ndarray, alphabet: int, weight: np.ndarray | None = None):
        n_texts = len(base) - 1
        lengths = np.diff(base)
        end = base[1:] + np.arange(n_texts)
        whole = np.zeros(len(texts) + n_texts, dtype=np.int64)
        inside = np.ones(len(whole), dtype=bool)
        inside[end] = False
        whole[inside] = texts
        order = suffix_order(whole, int(lengths.max()) + 1)
        self.wavelet = Wavelet(whole[order - 1], max(1, int(alphabet).bit_length()))
        self.less = np.r_[0, np.cumsum(np.bincount(whole, minlength=alphabet + 1))]
        text_of = np.repeat(np.arange(n_texts), lengths + 1)
        self.weights = np.r_[0, np.cumsum(np.ones(len(order), dtype=np.int64) if weight is None else weight[text_of[order]])]
        self.minima = [first[text_of[order]].astype(np.int32)]
        while (1 << len(self.minima)) <= len(order):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))
        self.n = len(order)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the matches with one more word on the left."""
        rank = self.wavelet.rank(symbol, np.stack((lo, hi)))
        return self.less[symbol] + rank[0], self.less[symbol] + rank[1]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least first occurrence in ranges that aren't empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][lo[at]], self.minima[k][hi[at] - (1 << int(k))])
        return out

    def statistics(self, query: np.ndarray, stop: np.ndarray, longest: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each stop: words matched backwards from it while the match occurs twice (``longest`` at most), and the range at the end."""
        lo, hi = np.zeros(len(stop), dtype=np.int64), np.full(len(stop), self.n, dtype=np.int64)
        matched = np.zeros(len(stop), dtype=np.int64)
        longest = np.broadcast_to(longest, len(stop))
        alive = np.arange(len(stop))
        k = 0
        while len(alive):
            k += 1
            alive = alive[longest[alive] >= k]
            a, b = self.extend(query[stop[alive] - k], lo[alive], hi[alive])
            more = self.weights[b] - self.weights[a] > 1  # a window's own suffix is in the index, so one occurrence is none
            alive = alive[more]
            lo[alive], hi[alive] = a[more], b[more]
            matched[alive] = k
        return matched, lo, hi


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a shard's texts against its index: the windows that occur twice, and where they do first."""
    np.seterr(over="ignore")
    tables = list(R.arriving(batches, 1 << 15))
    if tables:
        yield _shard(pa.concat_tables(tables))


def _shard(table: pa.Table) -> pa.RecordBatch:
    """The answers of a shard's texts, one row for each.

    A text is matched from its end as a whole first: where all of it occurs twice, as in copies, so do all of its windows. But the first occurrence
    of a window may be in another text, so where others share the key, and where the whole fails, each window is searched.
    """
    table = table.combine_chunks()
    key, digest, rid, n = (table.column(x).to_numpy() for x in ("key", "digest", "rid", "n"))
    start, count, anchor = (table.column(x).to_numpy().astype(np.int64) for x in ("start", "count", "anchor"))
    symbols = np.frombuffer(b"".join(table.column("content").to_pylist()), dtype=np.uint64)
    length = count - 1 + WIDTH
    base = np.r_[0, np.cumsum(length)]
    known, found = np.unique(symbols, return_inverse=True)
    found = found.astype(np.int64) + 1
    # texts by the occurrence of their anchor: equal windows start equally far before their anchors
    order = np.lexsort((start + anchor, rid))
    first = np.empty(len(rid), dtype=np.int64)
    first[order] = np.arange(len(rid))
    index = FmIndex(found, base, first, len(known), n)
    windows = np.r_[0, np.cumsum(count)]
    source = np.repeat(np.arange(len(rid)), count)  # the text in which a window occurs first
    hit = np.zeros(windows[-1], dtype=bool)
    matched, _, _ = index.statistics(found, base[1:], length)
    _, of, kinds = np.unique(key, return_inverse=True, return_counts=True)
    whole = (matched == length) & (kinds[of] == 1)
    hit[np.repeat(whole, count)] = True
    text = np.flatnonzero(~whole)
    rest = np.repeat(text, count[text])
    place = np.arange(len(rest)) - np.repeat(np.cumsum(count[text]) - count[text], count[text])
    for lo in range(0, len(rest), STEP):
        t, w = rest[lo : lo + STEP], place[lo : lo + STEP]
        matched, a, b = index.statistics(found, base[t] + w + WIDTH, WIDTH)
        full = np.flatnonzero(matched == WIDTH)
        at = windows[t[full]] + w[full]
        hit[at] = True
        source[at] = order[index.least(a[full], b[full])]
    text = np.repeat(np.arange(len(rid)), count)
    before = anchor[text] - (np.arange(windows[-1]) - windows[text])
    return R.answer(key, digest, windows, hit, rid[source], (start + anchor)[source] - before)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in B.blocks(B.binary(batch.column(1))):
            starts, stops, of = B.words(data, offsets)
            gone = R.run_flags(batch.column(2)[first:last], WIDTH, of)
            raw = data.tobytes()
            kept = []
            for k in range(last - first):
                stay = np.flatnonzero(~gone[of[k] : of[k + 1]]) + of[k]
                kept.append(b" ".join([raw[a:b] for a, b in zip(starts[stay].tolist(), stops[stay].tolist())]))
            sums = np.r_[0, np.cumsum(gone)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(np.diff(of)), pa.array(np.diff(sums[of])), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by spaces (UTF-8), of each row of docs."""
    rows, _ = keyed(docs)
    runs = R.repeated(rows, R.Words(WIDTH), _decide, keep_first=True)
    return R.covered(rows, runs, _finish, "doc_id long, n_words long, n_removed long, kept binary")
