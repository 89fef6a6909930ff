"""LM scoring by subword lattice likelihood.

Pieces come from an existing vocabulary file of byte strings with ranks; they are never trained.
Their unigram probabilities are: they start from the ranks (1 / (rank + 1)) and take ``ROUNDS`` rounds of
expectation-maximisation over the distinct words of the training documents. A word, with a space
before it, may be cut into pieces in many ways; each way weighs the product of its pieces'
probabilities, and the forward recursion in log space adds up all of them. A word that training has seen
has one more way through its lattice, an arc over the whole word: it weighs (c - D) / N, and the
pieces share what the discounts D leave over. With the end of a text, (number of texts) / N,
this is a proper distribution over texts of lower-cased words.

``score`` is the log10 probability of this model; ``lattice_score`` is that of the pieces alone: every word's marginal times the share of
words among tokens.

Words are counted over the whole corpus and told apart by 64-bit hashes. A word's lattice is run once, in the table of words, not once for each use.
The words that are used most (``FREQUENT`` at most) are broadcast with their scores; for all other words
each document's uses are joined with the table by the word's hash.

Defined cases: a null text is empty and has only the end; a null doc_id counts as an empty id, in training. Repeated
rows count repeatedly. Without training documents every count is 0. A text without spaces is one word: its lattice takes a few seconds
and about 100 MB for each megabyte. Extra columns are left alone.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.llm import blocks as B
from treeslab.llm.shared import numbered, ship, spool

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROUNDS = 2
#: Taken from the count of each word that training has seen, and given to the pieces.
DISCOUNT = 0.75
#: Added to each piece's expected count.
PRIOR = 0.1
#: Words whose counts and scores are broadcast: 24 bytes each.
FREQUENT = 1 << 18
#: Bytes of words that step together, and the longest that do; edges of a longer word are made for so many bytes at a time.
STEP_BYTES, LONG, CHUNK = 1 << 17, 256, 1 << 15


class Trie:
    """Byte strings by their prefixes: key node * 256 + byte leads to a child; piece[node] is the string that ends there, or -1."""

    def __init__(self, strings: list[bytes]):
        children: dict[int, int] = {}
        piece = [-1]
        for k, text in enumerate(strings):
            node = 0
            for c in text:
                at = node * 256 + c
                node = children.get(at, 0)
                if not node:
                    node = children[at] = len(piece)
                    piece.append(-1)
            piece[node] = k
        keys = np.array([*children, 1 << 62], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array([*children.values(), 0], dtype=np.int64)[order]
        self.piece = np.array(piece, dtype=np.int64)

    def edges(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of all pieces in the data; one that starts at i ends at end[i] at most. Bytes are compared, not hashes."""
        at, node = np.arange(len(end)), np.zeros(len(end), dtype=np.int64)
        starts, sizes, pieces = [at[:0]], [at[:0]], [at[:0]]
        size = 0
        while len(at):
            key = node * 256 + data[at + size]
            found = np.searchsorted(self.keys, key)
            ok = self.keys[found] == key
            at, node = at[ok], self.child[found[ok]]
            size += 1
            whole = self.piece[node] >= 0
            starts.append(at[whole])
            sizes.append(np.full(len(starts[-1]), size))
            pieces.append(self.piece[node[whole]])
            more = at + size < end[at]
            at, node = at[more], node[more]
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)


def _steps(order_by: np.ndarray, into: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges step by step: (edges, where each target's edges begin among them, targets). A step's targets rest on earlier steps only."""
    order = np.lexsort((into, order_by))
    step, target = order_by[order], into[order]
    new = np.flatnonzero(np.r_[True, np.diff(target) != 0]) if len(order) else order
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(step[new]) != 0]), len(new)] if len(new) else np.zeros(1, dtype=np.int64)
    bounds = np.r_[new, len(order)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        first = int(bounds[lo])
        yield order[first : int(bounds[hi])], new[lo:hi] - first, target[new[lo:hi]]


class Pieces:
    """Byte strings with log probabilities (natural).

    Words follow each other, and pieces that start with a space start a word. So a word's way stands for its first
    piece given that a word starts, and for the start of the next: these two factors cancel.

    Words of all lengths up to LONG bytes step together, place by place; a longer one goes alone, byte by byte, with CHUNK bytes' edges at a time.
    """

    def __init__(self, strings: list[bytes], logs: np.ndarray, trie: Trie | None = None):
        self.strings, self.logs, self.trie = strings, logs, trie or Trie(strings)
        self.longest = max(map(len, strings), default=0)

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Pieces:
        """The pieces of a file of base64 strings and ranks that lower-cased words with a space before them may hold."""
        rank = {}
        with open(path, "rb") as lines:
            for line in lines:
                text, number = line.split()
                piece = base64.b64decode(text)
                bare = piece[1:] if piece[:1] == b" " else piece
                if piece and not any(0x41 <= c <= 0x5A or c == 0x20 or 0x09 <= c <= 0x0D for c in bare):
                    rank[piece] = int(number)
        strings = sorted(rank, key=rank.get)
        weight = 1.0 / (np.array([rank[x] for x in strings]) + 1.0)
        return cls(strings, np.log(weight / weight.sum()))

    def _together(self, words: list[bytes], counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The log probabilities of short words, and with counts the expected uses of the pieces."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.array([len(x) for x in words], dtype=np.int64)
        stop = np.cumsum(length)
        word = np.repeat(np.arange(len(words)), length)
        start, size, piece = self.trie.edges(data, stop[word])
        log, word_of = self.logs[piece], word[start]
        # a word of n bytes has n + 1 places: before each byte and at the end
        left, right = start + word_of, start + size + word_of
        begin = (stop - length + np.arange(len(words)))[word_of]
        first, last = stop - length + np.arange(len(words)), stop + np.arange(len(words))
        forward = np.full(len(data) + len(words), -np.inf)
        forward[first] = 0.0
        for some, cuts, into in _steps(right - begin, right):
            forward[into] = np.logaddexp.reduceat(forward[left[some]] + log[some], cuts)
        if counts is None:
            return forward[last], np.zeros(0)
        backward = np.full(len(forward), -np.inf)
        backward[last] = 0.0
        for some, cuts, into in _steps(begin - left, left):
            backward[into] = np.logaddexp.reduceat(backward[right[some]] + log[some], cuts)
        share = np.exp(forward[left] + log + backward[right] - forward[last][word_of]) * counts[word_of]
        return forward[last], np.bincount(piece, weights=share, minlength=len(self.strings))

    def _alone(self, word: bytes, count: float | None) -> tuple[float, np.ndarray]:
        """The same for one long word."""
        n = len(word)
        data = np.frombuffer(word, dtype=np.uint8)

        def chunks(backwards: bool) -> Iterator[tuple[np.ndarray, ...]]:
            for at in sorted(range(0, n, CHUNK), reverse=backwards):
                size = min(CHUNK, n - at)
                start, length, piece = self.trie.edges(data[at : at + size + self.longest], np.full(size, min(n - at, size + self.longest)))
                order = np.argsort(start, kind="stable")[:: -1 if backwards else 1]
                yield start[order] + at, (start + length)[order] + at, piece[order]

        def run(sums: np.ndarray, backwards: bool) -> None:
            sums = memoryview(sums)
            for left, right, piece in chunks(backwards):
                a, b = (right, left) if backwards else (left, right)
                for i, j, log in zip(a.tolist(), b.tolist(), self.logs[piece].tolist()):
                    x, y = sums[i] + log, sums[j]
                    if x < y:
                        x, y = y, x
                    sums[j] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x

        forward = np.full(n + 1, -np.inf)
        forward[0] = 0.0
        run(forward, False)
        total = np.zeros(len(self.strings))
        if count is not None:
            backward = np.full(n + 1, -np.inf)
            backward[n] = 0.0
            run(backward, True)
            for left, right, piece in chunks(False):
                total += np.bincount(piece, weights=np.exp(forward[left] + self.logs[piece] + backward[right] - forward[n]) * count, minlength=len(total))
        return float(forward[n]), total

    def marginal(self, words: Sequence[bytes]) -> np.ndarray:
        """The log probability of each word, over all ways to cut it."""
        out = np.zeros(len(words))
        for rows, group in _grouped(words):
            out[rows] = self._together(group, None)[0] if len(group[0]) <= LONG else self._alone(group[0], None)[0]
        return out

    def expected(self, words: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur so often."""
        total = np.zeros(len(self.strings))
        for rows, group in _grouped(words):
            total += self._together(group, counts[rows])[1] if len(group[0]) <= LONG else self._alone(group[0], float(counts[rows[0]]))[1]
        return total

    def with_counts(self, counts: np.ndarray) -> Pieces:
        counts = counts + PRIOR
        return Pieces(self.strings, np.log(counts / counts.sum()), self.trie)


def _grouped(words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rows, words) in groups of about STEP_BYTES and of like lengths; words over LONG bytes are groups of their own."""
    words = [bytes(x) for x in words]
    length = np.array([len(x) for x in words], dtype=np.int64)
    order = np.argsort(length, kind="stable")
    short = int(np.searchsorted(length[order], LONG, side="right"))
    sums = np.cumsum(length[order[:short]])
    lo = 0
    while lo < short:
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + STEP_BYTES, side="right")))
        yield order[lo:hi], [words[k] for k in order[lo:hi].tolist()]
        lo = hi
    for k in order[short:].tolist():
        yield np.array([k]), [words[k]]


@dataclass(frozen=True)
class Model:
    """The pieces and the totals of training: tokens, distinct words and texts."""

    pieces: Pieces
    tokens: int
    words: int
    texts: int

    def log10(self, words: Sequence[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of words (with a space before them) that training has seen so often: by the model, and by pieces alone."""
        by_pieces = self.pieces.marginal(words)
        if not self.words:
            alone = (by_pieces + np.log(0.5 if not self.tokens else 0.5 / self.tokens)) / np.log(10)
            return alone, alone
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - DISCOUNT, 0) / self.tokens)
        alone = by_pieces + np.log(1 - self.texts / self.tokens)
        return np.logaddexp(whole, by_pieces + np.log(DISCOUNT * self.words / self.tokens)) / np.log(10), alone / np.log(10)

    def end(self) -> float:
        return float(np.log10(self.texts / self.tokens)) if self.texts else float(np.log10(0.5))


def spaced(words: pa.Array) -> list[bytes]:
    """Words with a space before each."""
    return [b" " + x for x in words.to_pylist()]


def _distinct(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, one place of each, and their counts."""
    order = np.argsort(hashes, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0]) if len(order) else order
    return hashes[order[new]], order[new], np.diff(np.r_[new, len(order)])


def _low_words(column: pa.Array, limit: int = B.BLOCK_BYTES) -> Iterator[tuple]:
    for first, last, data, offsets in B.blocks(B.binary(column), limit):
        low = B.LOWER[data]
        starts, stops, of = B.words(low, offsets)
        yield first, last, low, starts, stops, of, B.word_hashes(low, starts, stops)


def word_table(rows: DataFrame) -> DataFrame:
    """h, word, c (uses in training), n (all uses) for rows (held_out, text): one row for each distinct word of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, low, starts, stops, of, hashes in _low_words(batch.column(1), 8 << 20):
                h, place, n = _distinct(low, starts, stops, hashes)
                train = np.repeat(~held[first:last].astype(bool), np.diff(of))
                known = np.bincount(np.searchsorted(h, hashes), weights=train, minlength=len(h)).astype(np.int64) if len(h) else n
                raw = low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array([raw[a:b] for a, b in zip(starts[place].tolist(), stops[place].tolist())], pa.binary()), pa.array(known), pa.array(n)], names=["h", "word", "c", "n"]
                )

    parts = rows.select("held_out", "text").mapInArrow(count, "h long, word binary, c long, n long")
    return parts.groupBy("h").agg(F.first("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n"))


def train(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Rounds of expectation-maximisation over all distinct training words; a round brings one row for each piece to the driver."""
    for _ in range(rounds):
        held = words.sparkSession.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore", invalid="ignore")
            total = np.zeros(len(held.value.strings))
            for batch in B.gathered(batches):
                total += held.value.expected(spaced(batch.column(0)), np.ones(batch.num_rows))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

        summed = words.where("c > 0").select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(pieces.strings))
        for row in summed.collect():  # as many as there are pieces, at most
            counts[row.piece] = row.n
        pieces = pieces.with_counts(counts)
        held.unpersist()
    return pieces


def _often(judged: DataFrame) -> int:
    """The least number of uses of words that are broadcast: the least power of 2 ** (1 / 8) that at most FREQUENT words reach."""
    step = F.floor(F.log2("n") * 8)
    sizes = judged.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect()  # a few hundred rows
    least, total = 1 << 62, 0
    for row in sorted(sizes, key=lambda r: -r.step):
        total += row.words
        if total > FREQUENT:
            break
        least = row.n
    return least


def score(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score (by pieces alone) for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, _ = numbered(rows, "rid")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = rows.select("rid", "doc_id", held_out.alias("held_out"), "text")
    words = spool(word_table(rows))
    ends = rows.where("not held_out").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train, distinct = total.n + ends, total.v + (ends > 0)
    model = Model(train(words, Pieces.read(path)), n_train, total.v, ends)
    end = model.end()
    model = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in B.gathered(batches):
            logs, alone = model.value.log10(spaced(batch.column(1)), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(logs), pa.array(alone)], names=["h", "c", "n", "log", "alone"])

    judged = spool(words.select("h", "word", "c", "n").mapInArrow(judge, "h long, c long, n long, log double, alone double"))
    common = judged.where(F.col("n") >= _often(judged)).select("h", "c", "log", "alone").toPandas()
    common = common.iloc[np.argsort(common.h.to_numpy().view(np.uint64))]
    spread = n_train + 0.5 * (distinct + 1)
    base = lambda c: np.log10((c + 0.5) / spread)
    often = spark.sparkContext.broadcast((common.h.to_numpy().view(np.uint64), common.c.to_numpy(), common.log.to_numpy(), common.alone.to_numpy()))
    last = (ends, float(base(ends)), end)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known, count, log, alone = often.value
        for batch in batches:
            for first, lastrow, low, starts, stops, of, hashes in _low_words(batch.column(3)):
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                found = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                pick = lambda x: np.diff(np.r_[0, np.cumsum(np.where(found, x[at], 0))][of]) if len(known) else np.zeros(lastrow - first)  # noqa: B023, E731
                doc = np.repeat(np.arange(lastrow - first), np.diff(of))
                rare_doc, rare = doc[~found], hashes[~found]
                order = np.lexsort((rare, rare_doc))
                rare_doc, rare = rare_doc[order], rare[order]
                new = np.flatnonzero(np.r_[True, (np.diff(rare_doc) != 0) | (np.diff(rare) != 0)]) if len(rare) else order
                cuts = np.searchsorted(rare_doc[new], np.arange(lastrow - first + 1)).astype(np.int32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k)[first:lastrow] for k in range(3)),
                        pa.array(np.diff(of) + 1),
                        pa.array((pick((count > 0).astype(np.int64)) + (last[0] > 0)).astype(np.int64)),
                        pa.array(pick(base(count)) + last[1]),
                        pa.array(pick(log) + last[2]),
                        pa.array(pick(alone) + last[2]),
                        listed(rare[new].view(np.int64)),
                        listed(np.diff(np.r_[new, len(rare)]).astype(np.int32)),
                    ],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "lattice_score", "rare", "uses"],
                )

    found = spool(rows.mapInArrow(use, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double, rare array<long>, uses array<int>"))
    each = found.select("rid", F.explode(F.arrays_zip("rare", "uses")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.uses").alias("m"))
    joined = each.join(judged.select("h", "c", "log", "alone"), "h")
    more = joined.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"), F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / F.lit(float(spread)))).alias("b"), F.sum(F.col("m") * F.col("log")).alias("s"), F.sum(F.col("m") * F.col("alone")).alias("a")
    )
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return found.drop("rare", "uses").join(more, "rid", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(n_train).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "s"), plus("lattice_score", "a"))
