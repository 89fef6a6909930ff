"""Arrow batches as blocks of bytes, and vectorised words and rolling hashes over them.

A block is a run of consecutive rows whose texts lie in one byte array, with one
space after each text. Blocks stay near ``BLOCK_BYTES`` (a single longer text makes
its own block), so a worker's memory does not depend on the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
#: Bytes whose prefix sums are held at a time.
HASHED_BYTES = 1 << 20
#: Values that are summed together.
STEP = 1 << 13
U64 = np.uint64


#: The greatest two primes below 2 ** 32, as what they lack of it. Products of residues fit in 64 bits.
SHORT = (U64(5), U64(17))
PRIMES = tuple(U64((1 << 32) - int(c)) for c in SHORT)
LOW32 = U64(0xFFFFFFFF)


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


#: One random odd number for each byte value, odd factors, and the bases of the rolling hashes, one for each prime.
BYTE_VALUE = _random_words(1, 256)
BASES = _random_words(2, 4)
ROOTS = np.stack([_random_words(3 + k, 4) % (PRIMES[k] - U64(2)) + U64(2) for k in range(2)])
_POWERS: dict[tuple[int, int], np.ndarray] = {}
#: Gives freed memory back to the system, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _folded(x: np.ndarray, k: int) -> np.ndarray:
    """x modulo PRIMES[k], by 2 ** 32 = SHORT[k]."""
    x = (x >> U64(32)) * SHORT[k] + (x & LOW32)
    x = (x >> U64(32)) * SHORT[k] + (x & LOW32)
    return np.minimum(x, x - PRIMES[k])  # the difference wraps around where x is the less


def powers(base: int, k: int, n: int) -> np.ndarray:
    """ROOTS[k, base] ** 0 .. ** (n - 1) modulo PRIMES[k]; for base below 0 those of the inverse of ROOTS[k, -base - 1]."""
    have = _POWERS.get((base, k))
    if have is None or len(have) < n:
        prime = int(PRIMES[k])
        root = int(ROOTS[k, base]) if base >= 0 else pow(int(ROOTS[k, -base - 1]), -1, prime)
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, 1 << 12):
            have = np.r_[have, _folded(have * U64(pow(root, len(have), prime)), k)]
        if len(have) <= 1 << 21:
            _POWERS[base, k] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit values, by prefix sums.

    The hash of [a, b) is the sum of value[i] * root ** (i - a) modulo two primes, mixed with the length: it
    depends on the values and their number alone, not on where the range starts. (Sums modulo 2 ** 64 would
    not do: there long sequences over two values are equal whatever the root is.)
    """

    def __init__(self, values: np.ndarray, base: int = 0, table: np.ndarray | None = None):
        """table: numbers that stand for the values 0, 1, ..; for bytes."""
        n = len(values)
        self.sums, self.back = [], []
        high = np.empty(STEP, dtype=np.uint64)
        for k in range(2):
            sums = np.zeros(n + 1, dtype=np.uint64)
            power = powers(base, k, n)
            rests = None if table is None else _folded(table, k)
            for lo in range(0, n, STEP):  # small steps stay in the cache
                part, up = sums[lo + 1 : min(n, lo + STEP) + 1], high[: min(n - lo, STEP)]
                if rests is None:
                    part[:] = _folded(values[lo : lo + STEP], k)
                else:
                    np.take(rests, values[lo : lo + STEP], out=part, mode="clip")
                part *= power[lo : lo + STEP]
                np.right_shift(part, U64(32), out=up)
                up *= SHORT[k]
                part &= LOW32
                part += up  # below 2 ** 37, so 2 ** 27 of them can be summed
                np.cumsum(part, out=part)
                part += sums[lo]
            self.sums.append(sums)
            self.back.append(powers(-base - 1, k, n + 1))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = np.asarray(stop - start).astype(np.uint64)
        one, two = (_folded(_folded(self.sums[k][stop] - self.sums[k][start], k) * self.back[k][start], k) for k in range(2))
        return mix((one << U64(32) | two) + length * U64(0x9E3779B97F4A7C15))


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets); row k's text is bytes[offsets[k]:offsets[k + 1] - 1].

    A null counts as an empty text.
    """
    pieces: list[bytes] = []
    first = size = 0
    n = len(texts)
    for k in range(n):
        value = texts[k].as_buffer()
        pieces.append(b"" if value is None else value.to_pybytes())
        size += len(pieces[-1]) + 1
        if size >= limit or k == n - 1:
            pieces.append(b"")
            data = np.frombuffer(b" ".join(pieces), dtype=np.uint8)
            offsets = np.zeros(len(pieces), dtype=np.int64)
            np.cumsum([len(x) + 1 for x in pieces[:-1]], out=offsets[1:])
            yield first, k + 1, data, offsets
            pieces, first, size = [], k + 1, 0
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def binary(column: pa.Array) -> pa.Array:
    """A string column as binary, without copying."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


#: Bytes that end a word: white space of ASCII, or everything but digits, letters and non-ASCII bytes.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all words, and the number of words before each text (one more than texts)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~ends[data]
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = 0) -> np.ndarray:
    """A hash of each word; long texts are hashed a part at a time, so the sums stay near HASHED_BYTES (or one word)."""
    if len(data) <= 2 * HASHED_BYTES:
        return RangeHash(data, base, BYTE_VALUE).of(starts, stops)
    out, first = np.empty(len(starts), dtype=np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + HASHED_BYTES, side="right")))
        at = int(starts[first])
        out[first:last] = RangeHash(data[at : int(stops[last - 1])], base, BYTE_VALUE).of(starts[first:last] - at, stops[first:last] - at)
        first = last
    return out


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The runs of equal values of an integer column in sorted batches, whole even where they span batches."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(np.diff(values)) + 1, len(values)]
        if waiting and waiting[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = batch.slice(lo, hi - lo)
            if hi < len(values):
                yield pa.Table.from_batches([*waiting, part])
                waiting = []
            else:
                waiting.append(part)
    if waiting:
        yield pa.Table.from_batches(waiting)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of small rows put together to at least so many rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
