"""Anchors: positions in sequences that equal windows choose alike.

Each window of ``width`` symbols takes as its anchor the leftmost least hash among its
``gram``-symbol grams. The choice depends on the window's content alone, so two equal
windows have anchors at the same offset. The windows that share one anchor start at
consecutive positions; together they are a *context* of the anchor. All equalities
between windows are equalities between contexts of anchors, and there is about one
anchor in (width - gram) / 2 symbols.

A context is cut in cells by how many symbols its windows have before the anchor: r from ``lo`` to
``hi``. All windows of a cell contain the symbols from ``lo`` before the anchor to ``width - hi`` after it.
The hash of that common part is the cell's key, so equal windows always meet under one key.
There are two cells at first (at most half of the width, or more); a cell whose key
holds too many different contexts is cut in halves, down to single windows (``halves``), where
the key is the whole window and only one context is left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from treeslab.llm.blocks import U64, RangeHash, mix


@dataclass
class Contexts:
    """Arrays with one entry for each role of each anchor.

    The windows start at ``start`` .. ``start + count - 1`` of the sequence; the content is
    the symbols of [start, start + count - 1 + width).
    """

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    digest: np.ndarray


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive entries."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def cells(width: int, gram: int) -> list[tuple[int, int]]:
    """(lo, hi) of the two first cells."""
    return [(0, width // 2), (width // 2 + 1, width - gram)]


def contexts(values: RangeHash, again: RangeHash | None, grams: np.ndarray, gram: int, offsets: np.ndarray, width: int) -> Contexts:
    """The contexts of sequences that lie one after another; sequence k is [offsets[k], offsets[k + 1]).

    values and again are two hashes of the symbols (without again, digests are 0); grams[i] is a hash of the ``gram`` symbols from i on.
    """
    n = int(offsets[-1])
    empty = np.zeros(0, dtype=np.int64)
    if n < width:
        return Contexts(empty, empty, empty, empty.astype(U64), empty.astype(U64))
    bits = U64(max(1, int(n).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(packed, width - gram + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    begin = np.arange(len(anchor))
    # a run of windows with one anchor and in one cell; windows that cross the end of a sequence don't exist
    side = anchor - begin > width // 2
    edge = np.zeros(len(anchor), dtype=bool)
    edge[0] = True
    edge[1:] = (anchor[1:] != anchor[:-1]) | (side[1:] != side[:-1])
    last = offsets[1:-1]
    ends, heads = last - width + 1, last
    edge[ends[(ends > 0) & (ends < len(anchor))]] = True
    edge[heads[heads < len(anchor)]] = True
    start = np.flatnonzero(edge)
    count = np.diff(np.r_[start, len(anchor)])
    whole = start + width <= offsets[np.minimum(np.searchsorted(offsets, start, side="right"), len(offsets) - 1)]
    start, count = start[whole], count[whole]
    point, cell = anchor[start], side[start].astype(np.int64)
    lo, hi = (np.array(x)[cell] for x in zip(*cells(width, gram)))
    return Contexts(start, count, point, key_of(values, point, lo, hi, width), digest_of(again, start, count, point, width) if again else np.zeros(len(start), dtype=np.uint64))


def key_of(values: RangeHash, point: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """The hash of what all windows of a cell of the anchor at point contain."""
    return mix(values.of(point - lo, point - hi + width) + lo.astype(U64) * U64(0x9E3779B97F4A7C15) + hi.astype(U64))


def digest_of(again: RangeHash, start: np.ndarray, count: np.ndarray, point: np.ndarray, width: int) -> np.ndarray:
    return mix(again.of(start, start + count - 1 + width) + (point - start).astype(U64))


def halves(start: np.ndarray, count: np.ndarray, point: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parts of contexts in the halves of their cells: which context, start, count, lo, hi."""
    middle = (lo + hi) // 2
    out = []
    for a, b in ((lo, middle), (middle + 1, hi)):
        first, last = np.maximum(start, point - b), np.minimum(start + count - 1, point - a)
        use = np.flatnonzero((a <= b) & (first <= last))
        out.append((use, first[use], (last - first + 1)[use], a[use], b[use]))
    return tuple(np.concatenate(x) for x in zip(*out))
