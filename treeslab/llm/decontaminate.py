"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

Each item gives its windows (``width`` consecutive words, or all of them where it has fewer). A window
is a set of positioned shingles of up to three words. Shingles are ordered by how often they occur
in the corpus; a document that holds a window must hold the window's whole prefix, which for
exact containment is its rarest shingle alone. So only places with a prefix shingle are looked at:
the window's offset from the shingle must leave room for the whole window (positional and
length bounds). Shingles and words are looked up by hash; what is found is then confirmed
on the words' bytes.

Benchmark items go to the workers in blocks of at most ``block_windows`` windows, each a broadcast of
bounded size. One scan of the documents counts the shingles of all blocks; one scan for each block matches.

Defined cases: null or empty texts have no words. Items without words or with a null id are
ignored; repeated items are one. Rows are judged each for itself, repeated ones alike. Very long texts are matched
whole. An empty table gives no rows, an empty benchmark no hits. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.llm import blocks as B
from treeslab.llm.shared import bloom, every_column, free_name, keyed, numbered, over_rows, ship, spool

WIDTH = 10
SHINGLE = 3
#: Windows of one broadcast (each takes about 150 bytes).
BLOCK_WINDOWS = 200_000


class Index:
    """The windows of a block of items, by their words' hashes."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = WIDTH):
        spans: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            data = np.frombuffer(B.LOWER[np.frombuffer(text + b" ", dtype=np.uint8)].tobytes(), dtype=np.uint8)
            starts, stops, _ = B.words(data, np.array([0, len(data)]), B.NOT_ALNUM)
            words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
            for k in range(max(1, len(words) - width + 1) if words else 0):
                spans.setdefault(tuple(words[k : k + width]), set()).add(item)
        self.lengths = np.array([len(x) for x in spans], dtype=np.int64)
        self.words = np.zeros((len(spans), width), dtype=np.uint64)
        self.texts = [b" ".join(x) for x in spans]
        data = np.frombuffer(b" ".join(self.texts) + b" ", dtype=np.uint8)
        starts, stops, _ = B.words(data, np.array([0, len(data)]))
        self.words[np.arange(width) < self.lengths[:, None]] = B.word_hashes(data, starts, stops)
        self.items = [np.array(sorted(x)) for x in spans.values()]
        self.vocabulary = np.unique(self.words[self.words != 0])
        # all shingles of all windows: (window, offset, hash); a window of fewer words is one shingle
        window, offset, value = [], [], []
        for n in np.unique(self.lengths):
            k = np.flatnonzero(self.lengths == n)
            size = min(SHINGLE, int(n))
            for o in range(int(n) - size + 1):
                window.append(k)
                offset.append(np.full(len(k), o))
                value.append(joined(self.words[k, o : o + size]))
        self.window, self.offset, self.value = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (window, offset, value))
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.lengths})
        self.shingles = np.unique(self.value)

    def rank(self, counts: dict[int, int]) -> None:
        """Keep each window's prefix: its rarest shingle (ties by hash, then offset)."""
        often = np.array([counts.get(int(v), 0) for v in self.shingles.astype(np.uint64).view(np.int64)], dtype=np.int64)
        n = often[np.searchsorted(self.shingles, self.value)]
        order = np.lexsort((self.offset, self.value, n, self.window))
        order = order[np.r_[True, np.diff(self.window[order]) != 0]] if len(order) else order
        order = order[np.argsort(self.value[order], kind="stable")]
        self.prefix_value, self.prefix_window, self.prefix_offset = self.value[order], self.window[order], self.offset[order]


def joined(words: np.ndarray) -> np.ndarray:
    """One hash for each row of words."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(words.shape[1]):
        out = B.mix(out + words[:, k] + np.uint64(k + 1))
    return out


def doc_shingles(index: Index, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size: where the block's shingles of benchmark words start, and their hashes."""
    known = np.zeros(len(hashes), dtype=bool)
    if len(index.vocabulary) and len(hashes):
        at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
        known = index.vocabulary[at] == hashes
    for size in index.sizes:
        n = len(hashes) - size + 1
        if n <= 0:
            continue
        ok = known[:n].copy()
        for k in range(1, size):
            ok &= known[k : n + k]
        ok &= doc[:n] == doc[size - 1 :]
        at = np.flatnonzero(ok)
        value = joined(np.stack([hashes[at + k] for k in range(size)], axis=1)) if len(at) else np.zeros(0, dtype=np.uint64)
        yield size, at, value


def find(index: Index, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows in the documents of a block: the first word's place, and the window."""
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    end = np.repeat(of[1:], np.diff(of))
    begin = np.repeat(of[:-1], np.diff(of))
    places, windows = [], []
    for _, at, value in doc_shingles(index, hashes, doc):
        lo, hi = np.searchsorted(index.prefix_value, value, "left"), np.searchsorted(index.prefix_value, value, "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = index.prefix_window[entry]
        seen = np.repeat(at, n)
        first = seen - index.prefix_offset[entry]
        fits = (first >= begin[seen]) & (first + index.lengths[window] <= end[seen])
        first, window = first[fits], window[fits]
        for k in range(index.words.shape[1]):
            same = (index.lengths[window] <= k) | (index.words[window, k] == hashes[np.minimum(first + k, len(hashes) - 1)])
            first, window = first[same], window[same]
        places.append(first)
        windows.append(window)
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(windows)


@dataclass
class Block:
    """The words of rows first .. last - 1 of a batch: row first + k has the words of[k] .. of[k + 1] - 1."""

    first: int
    last: int
    low: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    of: np.ndarray
    hashes: np.ndarray

    def found(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """find, confirmed on the words' bytes."""
        place, window = find(index, self.hashes, self.of)
        same = np.zeros(len(place), dtype=bool)
        for k, (p, w) in enumerate(zip(place.tolist(), window.tolist())):
            span = slice(p, p + int(index.lengths[w]))
            same[k] = index.texts[w] == b" ".join([self.low[a:b].tobytes() for a, b in zip(self.starts[span].tolist(), self.stops[span].tolist())])
        return place[same], window[same]


def _block(batch: pa.RecordBatch, column: int) -> Iterator[Block]:
    for first, last, data, offsets in B.blocks(B.binary(batch.column(column))):
        low = B.LOWER[data]
        starts, stops, of = B.words(low, offsets, B.NOT_ALNUM)
        yield Block(first, last, low, starts, stops, of, B.word_hashes(low, starts, stops))


def _indexes(docs: DataFrame, benchmark: DataFrame, width: int, block_windows: int) -> Iterator[Index]:
    """Ranked indexes of the benchmark's blocks. Items are read one by one, so the driver holds one block."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    held: list[tuple[int, bytes]] = []
    counts = None
    size = 0
    for row in rows.toLocalIterator():
        held.append((row[0], row[1].encode()))
        size += len(row[1]) // 3 + 1
        if size >= block_windows:
            counts = spool(_counts(docs, _shingles(rows, width))) if counts is None else counts
            yield _ranked(counts, Index(held, width))
            held, size = [], 0
    if counts is None:
        counts = _counts(docs, _shingles(rows, width))
    yield _ranked(counts, Index(held, width))


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """The distinct shingle hashes (value) of all items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            index = Index([(0, x.encode()) for x in batch.column(1).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([pa.array(index.shingles.astype(np.uint64).view(np.int64))], names=["value"])

    return rows.mapInArrow(run, "value long").distinct()


def _counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """value, n: how often the shingles (value) occur in all documents, and a few others that the filter lets through."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(shingles, "value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for block in _block(batch, 0):
                doc = np.repeat(np.arange(len(block.of) - 1), np.diff(block.of))
                for size in range(1, SHINGLE + 1):
                    n = len(block.hashes) - size + 1
                    if n > 0:
                        value = joined(np.stack([block.hashes[k : n + k] for k in range(size)], axis=1))[doc[:n] == doc[size - 1 :]]
                        value, times = np.unique(value[held.value.holds(value)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["value", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, index: Index) -> Index:
    """Order the index's shingles by their counts over all documents."""
    shingles = np.sort(index.shingles.astype(np.uint64).view(np.int64))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column(0).to_numpy(zero_copy_only=False), shingles)))

    index.rank({row.value: row.n for row in counts.mapInArrow(mine, counts.schema).toLocalIterator()})  # one row for each shingle of the block at most
    return index


def _report(ids: pa.Array, n_words: np.ndarray, which: np.ndarray, start: np.ndarray, length: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    """One row for each document from its occurrences: document, first word within it, words."""
    base = np.r_[0, np.cumsum(n_words)]
    cover = np.zeros(base[-1] + 1, dtype=np.int64)
    np.add.at(cover, base[which] + start, 1)
    np.add.at(cover, base[which] + start + length, -1)
    n_hit = np.diff(np.r_[0, np.cumsum(np.cumsum(cover)[:-1] > 0)][base])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(n_hit > 0)],
        names=["doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated"],
    )


REPORT = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, contaminated boolean"
PART = "rid long, doc_id long, n_words long, start array<long>, length array<long>, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated for each document.

    With one block of items nothing is shuffled. With more, each block's occurrences are written to
    the shared folder and a document's parts are put together by its key.
    """
    ship(docs.sparkSession)
    indexes = _indexes(docs, benchmark, width, block_windows)
    index, later = next(indexes), next(indexes, None)

    def occurrences(index: Index, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        place, window = block.found(index)
        which = np.searchsorted(block.of, place, side="right") - 1
        items: list[set[str]] = [set() for _ in block.of[1:]]
        for d, w in set(zip(which.tolist(), window.tolist())):
            items[d].update(map(str, index.items[w].tolist()))
        return which, place - block.of[which], index.lengths[window], items

    if later is None:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for batch in batches:
                for block in _block(batch, 1):
                    yield _report(batch.column(0)[block.first : block.last], np.diff(block.of), *occurrences(held.value, block))

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, REPORT)

    rows, _ = keyed(docs)
    parts = None
    while index is not None:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def part(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for batch in batches:
                for block in _block(batch, 2):
                    which, start, length, items = occurrences(held.value, block)
                    first, last = block.first, block.last
                    at = [which == k for k in range(last - first)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[first:last], batch.column(1)[first:last], pa.array(np.diff(block.of)), pa.array([start[x] for x in at], pa.list_(pa.int64())), pa.array([length[x] for x in at], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                        names=["rid", "doc_id", "n_words", "start", "length", "items"],
                    )

        found = spool(rows.select("rid", "doc_id", "text").mapInArrow(part, PART))
        parts = found if parts is None else parts.unionByName(found)
        held.unpersist()
        index, later = later, next(indexes, None)
    whole = parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(x)).alias(x) for x in ("start", "length", "items")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, items = (batch.column(k).to_pylist() for k in (3, 4, 5))
            which = np.repeat(np.arange(batch.num_rows), [len(x) for x in start])
            flat = lambda x: np.array([v for y in x for v in y], dtype=np.int64)
            yield _report(batch.column(1), batch.column(2).to_numpy(), which, flat(start), flat(length), [set(x) for x in items])

    return whole.mapInArrow(finish, REPORT)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, all columns as they are.

    With one block of items there is no shuffle. With more, the keys of rows that go are gathered block by block, and taken off by one join.
    """
    ship(docs.sparkSession)
    indexes = _indexes(docs, benchmark, width, block_windows)
    index, later = next(indexes), next(indexes, None)

    def judged(frame: DataFrame, index: Index, dirty: bool) -> DataFrame:
        """The rows of a frame with a text that hold a window, or don't."""
        held = frame.sparkSession.sparkContext.broadcast(index)
        place_of = frame.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore")
            for batch in batches:
                for block in _block(batch, place_of):
                    hit = np.zeros(block.last - block.first, dtype=bool)
                    hit[np.searchsorted(block.of, block.found(held.value)[0], side="right") - 1] = True
                    yield batch.slice(block.first, block.last - block.first).filter(pa.array(hit == dirty))

        return over_rows(frame, run)

    if later is None:
        return judged(docs, index, False)
    name = free_name(docs, "rid")
    rows, _ = numbered(docs, name)
    gone = None
    while index is not None:
        found = spool(judged(rows.select(name, "text"), index, True).select(name))
        gone = found if gone is None else gone.unionByName(found)
        index, later = later, next(indexes, None)
    return rows.join(gone.distinct(), name, "left_anti").select([c for _, c in every_column(docs)])
