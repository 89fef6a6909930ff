"""Where texts repeat: the passes that substring operators share.

Scans of the documents exchange only hashes, Bloom filters of bounded size, and the texts around
a few anchors:

1. Count the keys of all contexts (see ``anchors``); a context whose key occurs once cannot repeat.
2. List the occurrences of contexts whose key occurs twice. Equal contexts meet under one
   128-bit fingerprint (key, digest), with their number and first occurrence.
3. One copy of each context that occurs twice, or whose key other contexts share, is sent to the shard
   of its key, weighed by its number. The operator's index decides which of its windows occur more than once,
   and where first: nothing is removed that the index hasn't found.
4. Each occurrence takes its context's answer, as runs of window starts.

A context that stands in a third of all documents is one text with a weight here; its occurrences take a
broadcast answer (``HOT`` such contexts at most). A key that more than ``HEAVY`` different contexts share is cut into finer ones
until none is, so no key's texts outgrow a task. Every equality of windows is found, since equal windows have equal keys.

Up to ``KEYS_MAX`` keys that occur twice are told by a broadcast Bloom filter; more are joined by
shuffle, with about three quarters of the texts' bytes in hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.llm import blocks as B
from treeslab.llm.anchors import Contexts, cells, contexts, digest_of, halves, key_of
from treeslab.llm.shared import BLOOM_BITS_MAX, Bloom, bloom, ship, spool

#: Bytes of context texts in one shard's task, about.
SHARD_BYTES = 8 << 20
BLOCK = 1 << 18
#: Symbols of a long text whose contexts are made together.
SEGMENT = 1 << 18
#: Keys of a broadcast filter: 16 bits each.
KEYS_MAX = BLOOM_BITS_MAX // 16
#: Different contexts of one key that one task takes; a key with more is cut.
HEAVY = 4096
#: A context with more than this share of all occurrences has its answer broadcast, so there are as many at most.
HOT = 10_000

Decide = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
RUN = "start: int, n: int, frid: long, fstart: int"
ANSWER = f"key long, digest long, runs array<struct<{RUN}>>"
#: A context in two rows: one has its number n and first occurrence (rid, start), the other its content. lo, hi: its cell; anchor: the anchor's place in the content.
TEXT = "key long, digest long, rid long, start int, count int, anchor int, lo int, hi int, n long, content binary"
TYPES = dict(x.split() for x in TEXT.split(", "))
NAMES = list(TYPES)


@dataclass(frozen=True)
class Words:
    """Sequences of words: each symbol is a word's hash."""

    width: int
    gram: int = 4
    size: int = 8

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, stops, of = B.words(data, offsets)
        return B.word_hashes(data, starts, stops), of

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        n = max(0, len(symbols) - self.gram + 1)
        grams = symbols[:n].copy()
        for k in range(1, self.gram):
            grams = grams * B.BASES[2] + symbols[k : k + n]
        return B.mix(grams)

    def hashed(self, symbols: np.ndarray, base: int) -> B.RangeHash:
        return B.RangeHash(symbols, base)

    def symbols(self, content: bytes) -> np.ndarray:
        return np.frombuffer(content, dtype=np.uint64)


@dataclass(frozen=True)
class Bytes:
    """Sequences of bytes."""

    width: int
    gram: int = 8
    size: int = 1

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.ones(len(data), dtype=bool)
        inside[offsets[1:] - 1] = False
        return np.ascontiguousarray(data[inside]), offsets - np.arange(len(offsets))

    def grams(self, symbols: np.ndarray) -> np.ndarray:
        n = max(0, len(symbols) - 7)
        grams = np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(symbols), strides=(1,)) if n else np.zeros(0, dtype=np.uint64)
        grams = grams * np.uint64(0x9E3779B97F4A7C15)
        return (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def hashed(self, symbols: np.ndarray, base: int) -> B.RangeHash:
        return B.RangeHash(symbols, base, B.BYTE_VALUE)

    def symbols(self, content: bytes) -> np.ndarray:
        return np.frombuffer(content, dtype=np.uint8)


def _scan(batches: Iterator[pa.RecordBatch], kind: Words | Bytes, digests: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Contexts]]:
    """For each block, or segment of a long text: its rids, its symbols, their offsets by row, and the contexts."""
    np.seterr(over="ignore")
    for batch in batches:
        rid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, data, offsets in B.blocks(B.binary(batch.column(1)), BLOCK):
            symbols, of = kind.read(data, offsets)
            for at in range(0, max(1, int(of[-1])), SEGMENT):
                part = symbols[at : at + SEGMENT + kind.width - 1]
                ends = np.unique(np.clip(of - at, 0, len(part)))
                found = contexts(kind.hashed(part, 0), kind.hashed(part, 1) if digests else None, kind.grams(part), kind.gram, ends if len(ends) > 1 else np.array([0, len(part)]), kind.width)
                found.start += at
                found.anchor += at
                yield rid[first:last], symbols, of, found


def _place(rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return B.mix(B.mix(rid.view(np.uint64)) + start.astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(kind: Words | Bytes) -> Decide:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(value), pa.array(n > 1)], names=["key", "twice"])

        for _, _, _, found in _scan(batches, kind, digests=False):
            held.append(found.key)
            size += len(found.key)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def occurrences(rows: DataFrame, kind: Words | Bytes, keys: DataFrame | None) -> DataFrame:
    """key, digest, rid, start, count of all contexts of rows (rid, text); with keys, of those that have one of them (and maybe a few others)."""
    few = keys is not None and keys.count() <= KEYS_MAX
    held = rows.sparkSession.sparkContext.broadcast(bloom(keys, "key")) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, _, of, found in _scan(batches, kind):
            use = np.flatnonzero(held.value.holds(found.key)) if held else np.arange(len(found.key))
            start = found.start[use]
            row = np.searchsorted(of, start, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [_signed(found.key[use]), _signed(found.digest[use]), pa.array(rid[row]), pa.array((start - of[row]).astype(np.int32)), pa.array(found.count[use].astype(np.int32))], names=["key", "digest", "rid", "start", "count"]
            )

    out = rows.select("rid", "text").mapInArrow(run, "key long, digest long, rid long, start int, count int")
    return out if keys is None or few else out.join(keys, "key", "left_semi")


def texts_at(rows: DataFrame, kind: Words | Bytes, places: DataFrame) -> DataFrame:
    """The texts (TEXT, without n) of the contexts of rows (rid, text) that start at places (rid, start)."""
    few = places.count() <= KEYS_MAX
    rows = rows.select("rid", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            rid, start = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([_signed(_place(rid, start))], names=["place"])

    held = rows.sparkSession.sparkContext.broadcast(bloom(places.select("rid", "start").mapInArrow(hashed, "place long"), "place")) if few else None
    bounds = np.array(cells(kind.width, kind.gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, symbols, of, found in _scan(batches, kind):
            row = np.searchsorted(of, found.start, side="right") - 1
            use = np.arange(len(row)) if held is None else np.flatnonzero(held.value.holds(_place(rid[row], found.start - of[row])))
            row, start, count = row[use], found.start[use], found.count[use]
            before = found.anchor[use] - start
            lo, hi = bounds[(before > kind.width // 2).astype(np.int64)].T
            content = [symbols[a:b].tobytes() for a, b in zip(start.tolist(), (start + count - 1 + kind.width).tolist())]
            small = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [_signed(found.key[use]), _signed(found.digest[use]), pa.array(rid[row]), small(start - of[row]), small(count), small(before), small(lo), small(hi), pa.nulls(len(use), pa.int64()), pa.array(content, pa.binary())], names=NAMES
            )

    if few:
        return part_of(rows.mapInArrow(run, TEXT), CONTENT)
    wanted = rows.join(places.select("rid").distinct(), "rid", "left_semi")
    return part_of(wanted.mapInArrow(run, TEXT).join(places.select("rid", "start").distinct(), ["rid", "start"], "left_semi"), CONTENT)


NUMBER, CONTENT = ("key", "digest", "rid", "start", "n"), ("key", "digest", "count", "anchor", "lo", "hi", "content")


def part_of(frame: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows of TEXT with the columns named; the others are null."""
    return frame.select([F.col(x) if x in names else F.lit(None).cast(t).alias(x) for x, t in TYPES.items()])


def single(table: pa.Table) -> pa.Table:
    """One row for each text of rows of TEXT in which a text's rows are neighbours. Contexts without one of their rows have gone."""
    table = table.combine_chunks()
    key, digest = table.column("key").to_numpy(), table.column("digest").to_numpy()
    group = np.cumsum(np.r_[True, (np.diff(key) != 0) | (np.diff(digest) != 0)]) - 1
    rows = []
    for name in ("content", "n"):  # the first row of each text that has it
        at = np.flatnonzero(table.column(name).is_valid().to_numpy())
        row = np.full(group[-1] + 1, -1)
        row[group[at[::-1]]] = at[::-1]
        rows.append(row)
    whole = (rows[0] >= 0) & (rows[1] >= 0)
    content, number = (pa.array(x[whole]) for x in rows)
    return pa.table({x: table.column(x).take(number if x in NUMBER else content) for x in NAMES})


def arriving(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The texts of a shard in tables of about so many, one row for each text."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            room = rows - size
            if batch.num_rows <= room:
                waiting.append(batch)
                size += batch.num_rows
                break
            # up to the end of a text's rows
            key, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = max(1, room)
            while cut < batch.num_rows and key[cut] == key[cut - 1] and digest[cut] == digest[cut - 1]:
                cut += 1
            if cut == batch.num_rows:
                waiting.append(batch)
                size += cut
                break
            waiting.append(batch.slice(0, cut))
            yield single(pa.Table.from_batches(waiting))
            batch, waiting, size = batch.slice(cut), [], 0
    if waiting:
        yield single(pa.Table.from_batches(waiting))


def _halved(kind: Words | Bytes) -> Decide:
    """Texts cut at the middle of their cells, with the text they come from and how far in they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            if not batch.num_rows:
                continue
            contents = batch.column(NAMES.index("content")).to_pylist()
            symbols = kind.symbols(b"".join(contents))
            base = np.r_[0, np.cumsum([len(x) // kind.size for x in contents])][:-1]
            start, count, anchor, lo, hi = (batch.column(NAMES.index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "count", "anchor", "lo", "hi"))
            which, first, count, lo, hi = halves(base, count, base + anchor, lo, hi)
            values, again = kind.hashed(symbols, 0), kind.hashed(symbols, 1)
            point = (base + anchor)[which]
            key, digest = key_of(values, point, lo, hi, kind.width), digest_of(again, first, count, point, kind.width)
            content = [symbols[a:b].tobytes() for a, b in zip(first.tolist(), (first + count - 1 + kind.width).tolist())]
            small = lambda x: pa.array(x.astype(np.int32))
            off = first - base[which]
            take = lambda name: batch.column(NAMES.index(name)).take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [_signed(key), _signed(digest), take("rid"), small(start[which] + off), small(count), small(point - first), small(lo), small(hi), take("n"), pa.array(content, pa.binary()), take("key"), take("digest"), small(off)],
                names=[*NAMES, "pkey", "pdigest", "off"],
            )

    return run


def decided(each: DataFrame, texts: DataFrame, kind: Words | Bytes, decide: Decide) -> DataFrame:
    """ANSWER for the contexts (key, digest, n, rid, start) with their texts (TEXT, one row or more for each), by the index.

    decide gets the rows of a shard, sorted by digest and key. Keys of more than HEAVY texts are cut in halves first.
    """
    spark = each.sparkSession
    heavy = spool(each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > HEAVY).select("key"))
    some = not heavy.isEmpty()
    rows = part_of(each, NUMBER).unionByName(texts)
    light = rows.join(heavy, "key", "left_anti").select(NAMES) if some else rows
    size = each.count() * 3 * kind.width // 2 * kind.size
    shards = max(1, int(size // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = light.repartition(shards, "key").sortWithinPartitions("digest", "key").mapInArrow(decide, ANSWER)
    if not some:
        return answers
    whole = rows.join(heavy, "key", "left_semi").groupBy("key", "digest").agg(*(F.max(x).alias(x) for x in NAMES[2:])).where("content is not null and n is not null").select(NAMES)
    parts = spool(whole.mapInArrow(_halved(kind), f"{TEXT}, pkey long, pdigest long, off int"))
    fewer = spool(parts.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "start")).alias("own"), *(F.first(x).alias(x) for x in CONTENT[2:])))
    inner = decided(fewer.select("key", "digest", "n", "own.*"), part_of(fewer, CONTENT), kind, decide)
    moved = F.transform("runs", lambda r: F.struct((r["start"] + F.col("off")).alias("start"), r["n"].alias("n"), r["frid"].alias("frid"), r["fstart"].alias("fstart")))
    back = parts.select("key", "digest", "pkey", "pdigest", "off").join(inner, ["key", "digest"]).groupBy(F.col("pkey").alias("key"), F.col("pdigest").alias("digest")).agg(F.flatten(F.collect_list(moved)).alias("runs"))
    return answers.unionByName(back)


def applied(met: DataFrame, each: DataFrame, answers: DataFrame, keep_first: bool) -> DataFrame:
    """rid, runs array<struct<start, n>> of window starts to remove, for the occurrences met (key, digest, rid, start).

    keep_first: where a window occurs first, it stays.
    """
    hot = spool(each.where(F.col("n") > F.lit(max(1000, met.count() // HOT))).select("key", "digest"))
    found = met.select("key", "digest", "rid", "start")
    if hot.isEmpty():
        joined = found.join(answers, ["key", "digest"])
    else:
        bound = F.broadcast(hot)  # HOT rows at most, and their answers
        cold = found.join(bound, ["key", "digest"], "left_anti").join(answers, ["key", "digest"])
        joined = found.join(F.broadcast(spool(answers.join(bound, ["key", "digest"], "left_semi"))), ["key", "digest"]).unionByName(cold)
    runs = joined.select("rid", "start", F.explode("runs").alias("run")).select("rid", (F.col("start") + F.col("run.start")).alias("start"), "run.n", "run.frid", "run.fstart")
    if keep_first:
        runs = runs.where(~((F.col("frid") == F.col("rid")) & (F.col("fstart") == F.col("start"))))
    return runs.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def listed(met: DataFrame) -> DataFrame:
    """key, digest, n, and the first occurrence (rid, start) of each context of the occurrences."""
    return met.groupBy("key", "digest").agg(F.min(F.struct("rid", "start")).alias("own"), F.count(F.lit(1)).alias("n")).select("key", "digest", "n", "own.rid", "own.start")


def repeated(rows: DataFrame, kind: Words | Bytes, decide: Decide, keep_first: bool) -> DataFrame:
    """rid, runs of window starts to remove, for the rows (rid, text) that have any."""
    ship(rows.sparkSession)
    counted = rows.select("rid", "text").mapInArrow(_keys(kind), "key long, twice boolean")
    counted = spool(counted.groupBy("key").agg((F.max("twice") | (F.count(F.lit(1)) > 1)).alias("twice")).where("twice").select("key"))
    met = spool(occurrences(rows, kind, counted))
    each = spool(listed(met))
    answers = spool(decided(each, texts_at(rows, kind, each), kind, decide))
    return applied(met, each, answers, keep_first)


def answer(key: np.ndarray, digest: np.ndarray, base: np.ndarray, hit: np.ndarray, frid: np.ndarray | None = None, fstart: np.ndarray | None = None) -> pa.RecordBatch:
    """ANSWER from flags; text k's windows are [base[k], base[k + 1]). frid, fstart: where each window occurs first."""
    at = np.flatnonzero(hit)
    frid, fstart = (np.zeros(len(at), dtype=np.int64), at) if frid is None else (frid[at], fstart[at])
    text = np.searchsorted(base, at, side="right") - 1
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(text) != 0) | (np.diff(frid) != 0) | (np.diff(fstart) != 1)] if len(at) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(at)])
    small = lambda x: pa.array(x.astype(np.int32))
    runs = pa.StructArray.from_arrays([small(at[first] - base[text[first]]), small(n), pa.array(frid[first]), small(fstart[first])], names=["start", "n", "frid", "fstart"])
    used, begin = np.unique(text[first], return_index=True)
    lists = pa.ListArray.from_arrays(small(np.r_[begin, len(first)]), runs)
    return pa.RecordBatch.from_arrays([pa.array(key[used]), pa.array(digest[used]), lists], names=["key", "digest", "runs"])


def covered(rows: DataFrame, runs: DataFrame, finish: Decide, schema: str) -> DataFrame:
    """finish over (doc_id, text, runs) of all rows (rid, doc_id, text). Only texts that have runs are shuffled."""
    runs = spool(runs)
    hashed = F.xxhash64("rid", F.lit(3))
    some: Bloom = bloom(runs.select(hashed.alias("k")), "k")
    held = rows.sparkSession.sparkContext.broadcast(some)

    def part(inside: bool) -> Decide:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(held.value.holds(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)) == inside))

        return run

    marked = rows.select("rid", "doc_id", "text", hashed.alias("k"))
    rest = marked.mapInArrow(part(False), marked.schema).select("doc_id", "text", F.lit(None).cast("array<struct<start: int, n: int>>").alias("runs"))
    hit = marked.mapInArrow(part(True), marked.schema).join(runs, "rid", "left").select("doc_id", "text", "runs")
    return rest.unionByName(hit).mapInArrow(finish, schema)


def run_flags(column: pa.Array, width: int, of: np.ndarray) -> np.ndarray:
    """A flag for each symbol of a block: whether a window of the runs of its row covers it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flags = np.zeros(of[-1] + 1, dtype=np.int64)
    values = column.flatten()
    lengths = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    start, n = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    np.add.at(flags, of[row] + start, 1)
    np.add.at(flags, of[row] + start + n - 1 + width, -1)
    return np.cumsum(flags)[:-1] > 0
