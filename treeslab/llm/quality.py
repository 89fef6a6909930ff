"""Quality rules: a linear-chain CRF labels the lines of a document as content or boilerplate.

``features`` describes each line by a few numbers, ``train`` fits transition and line weights
by gradient ascent on the conditional likelihood (forward-backward), and ``judge`` decodes every
document with Viterbi; the share of words in content lines decides whether it is kept.

Training lines come from a bounded sample of labelled documents (``SAMPLE_DOCS``). Labels are for documents; those of
lines come from evidence inside and across documents: the lines of a document of quality 0 are boilerplate, and so is a line
of one of quality 1 that also stands in several other documents which aren't copies of each other (``MANY``), counted
over the whole corpus: license lines, headers, menus. All others are content, so that labels change within documents. Documents that the base
rules drop anyway don't take part. The sample takes the documents with the least hashes of
their ids, so it is the same whatever the partitions are.

Defined cases: a null or empty text has no words, fails the base rules and is dropped. Repeated
rows are judged each for itself. Documents without labels only miss the training. Without any
label of either kind, the model calls every line content. Very long texts are judged whole. Extra columns are left alone. Lines, words
and windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.llm import blocks as B
from treeslab.llm.shared import over_rows, ship

#: Most labelled documents of each quality that the CRF is fitted on; all their lines take part.
SAMPLE_DOCS = 300
#: Most lines of training documents that are padded to one length together, unless one document has more.
PADDED_LINES = 1 << 19
#: Least share of a document's words that lie in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
N_FEATURES = 18
#: A line is boilerplate if it stands in so many different documents, by their least shingles, and these are half of all it stands in.
MANY = 3
#: Words of notices and menus. (Fixed values.)
NOTICES = [b"license", b"licensed", b"copyright", b"rights", b"reserved", b"released", b"terms", b"privacy", b"policy", b"cookie", b"cookies", b"subscribe", b"newsletter", b"login", b"menu", b"home", b"share", b"advertisement"]
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags over [at[k], at[k + 1])."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


def _notices() -> np.ndarray:
    data = np.frombuffer(b" ".join(NOTICES) + b" ", dtype=np.uint8)
    starts, stops, _ = B.words(data, np.array([0, len(data)]))
    return B.word_hashes(data, starts, stops)


def features(data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of numbers for each line data[at[k]:at[k + 1]], all in [0, 1]; text k has counts[k] lines."""
    chars = np.maximum(1, _counts((data & 0xC0) != 0x80, at)).astype(float)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = ~B.SPACES[data]
    starts = (np.diff(inside) == 1).astype(np.int64)
    starts[at[:-1][at[:-1] < len(data)]] |= inside[1:][at[:-1][at[:-1] < len(data)]] == 1
    n = np.maximum(1, _counts(starts, at)).astype(float)
    upper = (data >= 0x41) & (data <= 0x5A)
    digit = (data >= 0x30) & (data <= 0x39)
    x = np.ones((len(at) - 1, N_FEATURES))
    x[:, 1] = _counts(SYMBOLS[data], at) / chars
    x[:, 2] = np.minimum(1, _counts(SYMBOLS[data], at) / n)
    x[:, 3] = _counts(upper, at) / chars
    x[:, 4] = np.minimum(1, _counts(data == 0x21, at) / n)
    x[:, 5] = np.minimum(1, _counts(data == 0x7C, at) / n)
    x[:, 6] = _counts(digit, at) / chars
    x[:, 7] = np.minimum(1, np.log1p(n) / 6)
    x[:, 8] = np.minimum(1, chars / n / 20)
    x[:, 9] = _counts(data >= 0x80, at) / np.maximum(1, np.diff(at))
    x[:, 10] = np.minimum(1, _counts(np.isin(data, (0x2C, 0x2E)), at) / n)
    x[:, 11] = n <= 3
    low = B.LOWER[data]
    begin, stop, of = B.words(low, at, B.NOT_ALNUM)
    hashes = B.word_hashes(low, begin, stop)
    x[:, 12] = np.minimum(1, 3 * _counts(np.isin(hashes, _notices()), of) / np.maximum(1, np.diff(of)))
    x[:, 17] = _counts(np.r_[False, hashes[1:] == hashes[:-1]][: len(hashes)], of) / np.maximum(1, np.diff(of))  # words like the one before them
    ends = np.cumsum(counts)[counts > 0]
    x[:, 13:15] = 0
    text = np.repeat(np.arange(len(counts)), counts)
    x[:, 15] = n / np.bincount(text, weights=n, minlength=len(counts))[text]  # a line's share of its text's words
    x[:, 16] = 1 / counts[text]
    x[(ends - counts[counts > 0]), 13] = 1
    x[ends - 1, 14] = 1
    return x


class Crf:
    """weights: labels x features; moves: label before x label; first: label of the first line. Label 1 is content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first

    @classmethod
    def blank(cls) -> Crf:
        weights = np.zeros((2, N_FEATURES))
        weights[1, 0] = 1.0
        return cls(weights, np.zeros((2, 2)), np.zeros(2))

    def viterbi(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of many sequences that lie one after another, all decoded step by step together."""
        emit = x @ self.weights.T
        offsets = np.r_[0, np.cumsum(lengths)]
        labels = np.zeros(len(x), dtype=np.int8)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return labels
        back = np.zeros((len(x), 2), dtype=np.int8)
        score = emit[offsets[order]] + self.first
        longest = int(lengths[order[0]])
        alive = [np.searchsorted(-lengths[order], -t, side="left") for t in range(1, longest)]
        final = np.zeros(len(order), dtype=np.int8)
        for t in range(1, longest + 1):
            n = alive[t - 1] if t < longest else 0  # the sequences with more than t lines come first
            final[n : len(score)] = score[n:].argmax(axis=1)
            score = score[:n]
            if n:
                at = offsets[order[:n]] + t
                step = score[:, :, None] + self.moves
                back[at] = step.argmax(axis=1)
                score = step.max(axis=1) + emit[at]
        for t in range(longest - 1, -1, -1):
            n = len(order) if t == 0 else alive[t - 1]
            at = offsets[order[:n]] + t
            labels[at] = final[:n]
            final[:n] = np.take_along_axis(back[at], final[:n, None].astype(np.int64), axis=1)[:, 0]
        return labels


def _groups(sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """All sequences in groups of at most PADDED_LINES after padding, or of one sequence."""
    if len(sequences) * max(len(y) for _, y in sequences) <= PADDED_LINES:
        return [sequences]
    out: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for one in sorted(sequences, key=lambda s: -len(s[1])):
        if out and (len(out[-1]) + 1) * len(out[-1][0][1]) <= PADDED_LINES:
            out[-1].append(one)
        else:
            out.append([one])
    return out


def _padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Features, places with a line, labels as indicators, places with a line before them, and the moves that are seen."""
    longest = max(len(y) for _, y in sequences)
    n = len(sequences)
    x = np.zeros((n, longest, N_FEATURES))
    y = np.zeros((n, longest), dtype=np.int64)
    on = np.zeros((n, longest), dtype=bool)
    for k, (a, b) in enumerate(sequences):
        x[k, : len(b)], y[k, : len(b)], on[k, : len(b)] = a, b, True
    hot = np.eye(2)[y] * on[:, :, None]
    pair = on[:, 1:]
    return x, on, hot, pair, np.einsum("ktI,ktJ->IJ", hot[:, :-1] * pair[:, :, None], hot[:, 1:])


def _gradient(group: tuple[np.ndarray, ...], weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The gradient of the log-likelihood of a group's label sequences."""
    x, on, hot, pair, seen_moves = group
    n, longest = on.shape
    emit = x @ weights.T
    alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    alpha[:, 0] = emit[:, 0] + first
    for t in range(1, longest):
        new = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + emit[:, t]
        alpha[:, t] = np.where(on[:, t, None], new, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        ahead = beta[:, t + 1] + emit[:, t + 1]
        new = np.logaddexp(ahead[:, 0, None] + moves[:, 0], ahead[:, 1, None] + moves[:, 1])
        beta[:, t] = np.where(on[:, t + 1, None], new, 0.0)
    norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    one = np.exp(alpha + beta - norm[:, None, None]) * on[:, :, None]
    two = np.exp(alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - norm[:, None, None, None]) * pair[:, :, None, None]
    return np.r_[np.einsum("ktI,ktf->If", hot - one, x).ravel(), (seen_moves - two.sum(axis=(0, 1))).ravel(), (hot[:, 0] - one[:, 0]).sum(axis=0)]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.1, shrink: float = 1e-4) -> Crf:
    """Fit by gradient ascent (Adam) on the mean log-likelihood of the label sequences; deterministic."""
    if len({int(v) for _, y in sequences for v in y}) < 2:
        return Crf.blank()
    groups = [_padded(some) for some in _groups(sequences)]
    total = sum(on.sum() for _, on, *_ in groups)
    size = 2 * N_FEATURES + 6
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)

    def parts(t):
        return t[: 2 * N_FEATURES].reshape(2, N_FEATURES), t[2 * N_FEATURES : 2 * N_FEATURES + 4].reshape(2, 2), t[-2:]

    for step in range(1, rounds + 1):
        grad = sum(_gradient(group, *parts(theta)) for group in groups) / total - shrink * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(*parts(theta))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of the \\n-split lines of all texts of a block, and the number of lines of each text."""
    edge = data == 0x0A
    edge[offsets[1:] - 1] = True
    at = np.r_[0, np.flatnonzero(edge) + 1]
    return at, np.diff(np.searchsorted(at, offsets))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Crf:
    """Fit the CRF on the sample: at most ``sample`` documents of each quality reach the driver, whole."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(17))
    picked = None
    for quality in (0, 1):
        some = marked.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    ids = {row.doc_id: row.quality for row in picked.collect()}
    if not ids:
        return Crf.blank()
    rows = docs.where(F.col("doc_id").isin(list(ids))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    taken = []
    with np.errstate(over="ignore"):
        for row in sorted(rows, key=lambda r: r.doc_id):
            raw = np.frombuffer(((row.text or "") + " ").encode(), dtype=np.uint8)
            ends = np.array([0, len(raw)])
            if not judge_block(raw, ends, Crf.blank(), 0.0)["base_failed"][0]:
                at, counts = lines_of(raw, ends)
                taken.append((features(raw, at, counts), line_hashes(raw, at), ids[row.doc_id]))
    good = [lines for _, lines, quality in taken if quality]
    known = common_lines(docs, np.unique(np.concatenate(good))) if good else np.zeros(0, dtype=np.uint64)
    sequences = [(x, np.where(np.isin(lines, known), 0, quality)) for x, lines, quality in taken]
    return train(sequences) if sequences else Crf.blank()


def line_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each line, without its end."""
    return B.RangeHash(data, 2, B.BYTE_VALUE).of(at[:-1], at[1:] - 1)


def common_lines(docs: DataFrame, lines: np.ndarray) -> np.ndarray:
    """Those of the sample's line hashes that stand in MANY documents which aren't copies of each other, over all of docs.

    A document is told by the least hash of its five-word shingles, which most copies share.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lines)  # as many as the sample has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for _, _, data, offsets in B.blocks(B.binary(batch.column(0))):
                at, counts = lines_of(data, offsets)
                starts, stops, of = B.words(data, offsets)
                filled = _counts(~B.SPACES[data], at) > 0
                found = line_hashes(data, at)
                doc = np.repeat(np.arange(len(counts)), counts)
                use = filled & np.isin(found, held.value)
                doc, found = doc[use], found[use]
                hashes = B.word_hashes(data, starts, stops)
                n = max(0, len(hashes) - 4)
                shingle = B.RangeHash(hashes, 1).of(np.arange(n), np.arange(n) + 5)
                least = np.array([shingle[of[d] : max(of[d], of[d + 1] - 4)].min(initial=np.uint64(0xFFFFFFFFFFFFFFFF)) for d in np.unique(doc)], dtype=np.uint64)
                pair = np.unique(np.stack((found, doc.astype(np.uint64)), axis=1), axis=0)  # once a document
                sign = least[np.searchsorted(np.unique(doc), pair[:, 1].astype(np.int64))] if len(pair) else least
                pair, times = np.unique(np.stack((pair[:, 0], sign), axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(pair[:, 1].copy().view(np.int64)), pa.array(times)], names=["line", "doc", "n"])

    each = docs.select(F.col("text").cast("string")).mapInArrow(run, "line long, doc long, n long").groupBy("line", "doc").agg(F.sum("n").alias("n"))
    sums = each.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).where((F.col("docs") >= MANY) & (2 * F.col("docs") >= F.col("n")))
    return np.array([row.line for row in sums.select("line").collect()], dtype=np.int64).view(np.uint64)


def repeats(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int = 5) -> np.ndarray:
    """The number of words in windows that occur twice or more in their own text."""
    n = len(h)
    out = np.zeros(len(lo), dtype=np.int64)
    if n < width:
        return out
    roll = B.RangeHash(h, 1)
    a = np.arange(n - width + 1)
    doc = np.repeat(np.arange(len(lo)), hi - lo)
    ok = doc[a] == doc[a + width - 1]
    a = a[ok]
    value = B.mix(roll.of(a, a + width) + doc[a].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value, kind="stable")
    same = np.diff(value[order]) == 0
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(n + 1, dtype=np.int64)
    hit = a[order[twice]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return np.add.reduceat(np.r_[np.cumsum(cover)[:n] > 0, False].astype(np.int64), np.minimum(lo, n)) * (hi > lo)


def _line_copies(data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line of the text."""
    hashes = line_hashes(data, at)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = ~B.SPACES[data]
    has = _counts(inside, at) > 0
    value = B.mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[has]
    order = np.argsort(value, kind="stable")
    again = np.zeros(len(order), dtype=bool)
    again[1:] = np.diff(value[order]) == 0
    return np.bincount(doc[has][order[again]], minlength=len(counts))


def judge_block(data: np.ndarray, offsets: np.ndarray, crf: Crf, share: float) -> dict[str, np.ndarray]:
    starts, stops, of = B.words(data, offsets)
    lo, hi = of[:-1], of[1:]
    n_words = hi - lo
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~B.SPACES[data], out=chars[1:])
    word_chars = np.diff(chars[offsets])
    n_symbols = _counts(SYMBOLS[data], offsets)
    n_repeat = repeats(B.word_hashes(data, starts, stops), lo, hi)
    at, counts = lines_of(data, offsets)
    n_dup = _line_copies(data, at, counts)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    labels = crf.viterbi(features(data, at, counts), counts)
    in_line = np.diff(np.searchsorted(starts, at))
    first = np.r_[0, np.cumsum(counts)]
    content = np.diff(np.r_[0, np.cumsum(in_line * labels)][first])
    portion = content / np.maximum(1, n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "content_share": portion, "kept": ~failed & (portion >= share)}


def judge(docs: DataFrame, crf: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """A verdict on each row of docs (doc_id, text): counts of the base rules, content share, kept. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for first, last, data, offsets in B.blocks(B.binary(batch.column(1))):
                found = judge_block(data, offsets, crf, share)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *(pa.array(x) for x in found.values())], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, JUDGED)


def keep(docs: DataFrame, crf: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs whose text is kept, all columns as they are. No shuffle."""
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for first, last, data, offsets in B.blocks(B.binary(batch.column(place))):
                yield batch.slice(first, last - first).filter(pa.array(judge_block(data, offsets, crf, share)["kept"]))

    return over_rows(docs, run)
