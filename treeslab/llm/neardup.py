"""MinHash near-dedup by HyperMinHash registers.

A document's set is its distinct 5-word shingles (A-Z lowered; the whole sequence where it has
fewer words). One hash of each shingle picks one of 128 buckets; the bucket's register keeps the
leading zeros and ten mantissa bits of the bucket's least hash, in 16 bits. A band is four
registers, compared as they are stored; documents that agree in a band that isn't empty
are candidates. The share of agreeing registers, less the agreement expected by chance, is
the Jaccard estimate; candidates within reach of the threshold are verified on their full sets.

1. Documents with equal sets form a class; only its least document goes on.
2. Each candidate is verified against one hub: the member of its bands' groups that
   it shares most bands with among the groups' least members.
3. Links give components. Groups that still hold several components are taken again: every pair
   across components is estimated, in blocks of bounded size, and verified if it may reach the
   threshold. So all candidates are decided, but pairs that are connected already are
   never listed.

Nothing grows on the driver, and the only broadcasts are Bloom filters of bounded size.

Chance of missing a pair at a threshold of 0.8: (1 - 0.8 ** 4) ** 32 < 1e-7 for the bands, at 0.85 < 1e-10;
the estimate's margin is five standard errors.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with
nothing. Repeated rows are equal sets. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.llm import blocks as B
from treeslab.llm.components import components
from treeslab.llm.shared import Bloom, bloom, every_column, free_name, keyed, numbered, shared_dir, ship, spool

WORDS = 5
#: Least similarity of a link, in hundredths.
PERCENT = 80
BUCKETS, ROWS = 128, 4
BANDS = BUCKETS // ROWS
MANTISSA = 10
#: Members of a group that one task compares with as many others.
BLOCK = 1024
#: Chance that registers of different least hashes agree: the sum over leading zeros of the squared chances, times 2 ** -MANTISSA.
COLLISION = 2.0**-MANTISSA / 3


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    low = B.LOWER[data]
    starts, stops, of = B.words(low, offsets)
    hashes = B.word_hashes(low, starts, stops)
    roll = B.RangeHash(hashes, 1)
    n = len(hashes)
    at = np.arange(max(0, n - words + 1))
    shingles = roll.of(at, at + words)
    for lo, hi in zip(of[:-1], of[1:]):
        if hi - lo >= words:
            yield np.unique(shingles[lo : hi - words + 1])
        elif hi > lo:
            yield roll.of(np.array([lo]), np.array([hi]))
        else:
            yield np.zeros(0, dtype=np.uint64)


def registers(values: np.ndarray) -> np.ndarray:
    """128 registers of sorted distinct hashes: 0 if no hash fell in the bucket, else 1 + (zeros << 10 | mantissa) of its least hash."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    bucket = (values >> np.uint64(57)).astype(np.int64)
    used, first = np.unique(bucket, return_index=True)
    rest = ((values[first] << np.uint64(7)) >> np.uint64(11)) | np.uint64(1)  # 53 bits: a double holds them as they are
    bits = rest.astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + 52) - (bits >> np.uint64(52))
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[used] = (np.uint64(1) + (zeros << np.uint64(MANTISSA) | mantissa)).astype(np.uint16)
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of each row of registers in a with the one in b, corrected for chance agreement, and the registers they rest on."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(1, used)
    return np.clip((same - COLLISION) / (1 - COLLISION), 0, 1), used


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    found, used = estimates(a, b)
    return found >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(1, used)) - 0.01


def sketch(rows: DataFrame) -> DataFrame:
    """rid, n_shingles, a 128-bit digest of the set (d1, d2) and the registers, for rows (rid, text)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for first, last, data, offsets in B.blocks(B.binary(batch.column(1))):
                sizes, digests, regs = [], [], []
                for values in shingle_sets(data, offsets):
                    sizes.append(len(values))
                    digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    regs.append(registers(values).tobytes())
                two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(sizes, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(regs, pa.binary())], names=["rid", "n_shingles", "d1", "d2", "regs"]
                )

    return rows.select("rid", "text").mapInArrow(run, "rid long, n_shingles long, d1 long, d2 long, regs binary")


def _sets(rows: DataFrame, wanted: Bloom) -> DataFrame:
    """(rid, hashes) of the rows whose rid is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted.holds(B.mix(rid.astype(np.int64).view(np.uint64)))))
            for first, last, data, offsets in B.blocks(B.binary(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array([x.tobytes() for x in shingle_sets(data, offsets)], pa.binary())], names=["rid", "hashes"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, hashes binary")


def _mixed(column: str):
    """B.mix of a long column, with Spark's functions would overflow under ANSI rules; so by Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(B.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))], names=[column])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, hashes) of the rows with one of the ids, and of a few others that the Bloom filter lets through."""
    return _sets(rows, bloom(ids.select("rid").distinct().mapInArrow(_mixed("k"), "k long"), "k"))


def verify(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. The sets of both sides are joined to the pairs by shuffle; Spark splits a skewed b."""
    sets = spool(sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("rid"))))
    left = sets.select(F.col("rid").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda x: np.frombuffer(x.as_buffer(), dtype=np.uint64)
            keep = [linked(read(x), read(y), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _members(sketches: DataFrame) -> DataFrame:
    """(band, value, rid) of every class representative, in bands that aren't empty."""
    band = lambda i: F.struct(i.alias("band"), F.substring("regs", i * 2 * ROWS + 1, F.lit(2 * ROWS)).alias("value"))
    return sketches.select("rid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("x")).select("x.band", "x.value", "rid").where(F.col("value") != F.lit(bytes(2 * ROWS)))


def _pairs(table: pa.Table, regs: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block pair and the rows they may be linked with: other components, and no larger group that holds both."""
    own, rid, component = (table.column(x).to_numpy() for x in ("own", "rid", "component"))
    i, j, g = (table.column(x)[0].as_py() for x in ("i", "j", "g"))
    larger = [np.asarray([y for y in x if y > g], dtype=np.int64) for x in table.column("groups").to_pylist()]
    seen = np.unique(np.concatenate(larger)) if larger else np.zeros(0, dtype=np.int64)
    holds = np.zeros((len(rid), len(seen)), dtype=bool)
    for k, x in enumerate(larger):
        holds[k, np.searchsorted(seen, x)] = True
    cols = np.flatnonzero(own == j)
    for k in np.flatnonzero(own == i):
        others = cols[(component[cols] != component[k]) & ((rid[cols] > rid[k]) if i == j else True)]
        if len(others):
            others = others[may_reach(regs[others], regs[k], threshold)]
        if len(others) and len(seen):
            others = others[~(holds[others][:, holds[k]]).any(axis=1)]
        if len(others):
            yield k, others


def _regs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def _needed(groups: DataFrame, threshold: float) -> DataFrame:
    """Members of block pairs of the groups that have a pair to verify there.

    A group of more than BLOCK members is dealt to pairs of blocks; each pair of members is looked
    at in the largest of the groups that hold both.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = groups.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).withColumn("at", F.explode(meets))
    dealt = dealt.select(F.xxhash64("g", "at.i", "at.j").alias("task"), "g", "at.i", "at.j", "own", "rid", "component", "groups", "regs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches):
            use = np.zeros(table.num_rows, dtype=bool)
            for k, others in _pairs(table, _regs(table), threshold):
                use[k] = True
                use[others] = True
            if use.any():
                yield from table.filter(pa.array(use)).combine_chunks().to_batches()

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, dealt.schema)


def _decide(needed: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links (a, b) that join different components, found by comparing full sets within each block pair."""
    both = needed.join(sets, "rid").select("task", "g", "i", "j", "own", "rid", "component", "groups", "regs", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.runs(batches):
            rid, component = table.column("rid").to_numpy(), table.column("component").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
            root = {c: c for c in component.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            a, b = [], []
            for k, others in _pairs(table, _regs(table), threshold):
                for o in others.tolist():
                    p, q = top(int(component[k])), top(int(component[o]))
                    if p != q and linked(sets[k], sets[o], percent):
                        root[max(p, q)] = min(p, q)
                        a.append(int(rid[k]))
                        b.append(int(rid[o]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def cluster(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rid, n_shingles, component (the least rid reachable) for rows (rid, text) with unique rids."""
    shared_dir(rows.sparkSession)
    threshold = percent / 100
    sketches = spool(sketch(rows))
    classes = sketches.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("rid").alias("rid"), F.first("regs").alias("regs"))
    members = _members(classes)
    shared = members.groupBy("band", "value").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = spool(members.join(shared, ["band", "value"]).select("band", "value", "rid", "hub", "size"))
    hubs = met.where("rid != hub").groupBy("rid", "hub").agg(F.count(F.lit(1)).alias("n"))
    pairs = hubs.groupBy("rid").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("b")).select(F.col("rid").alias("a"), "b")
    links = verify(rows, pairs.checkpoint(), percent).checkpoint()
    label = components(links)

    named = met.join(label, met.rid == label.v, "left").select("band", "value", "rid", "size", F.coalesce("component", "rid").alias("component"))
    mixed = (
        named.groupBy("band", "value")
        .agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rid")).alias("s1"), F.bit_xor(F.xxhash64("rid", F.lit(7))).alias("s2"))
        .where("c1 != c2")
    )
    # groups of the same members are one group; larger groups have larger numbers
    number = F.shiftleft(F.least("size", F.lit(1 << 20)), 42).bitwiseOR(F.xxhash64("band", "value").bitwiseAND(F.lit((1 << 42) - 1)))
    open_groups = mixed.withColumn("g", number).groupBy("size", "s1", "s2").agg(F.min_by(F.struct("band", "value", "g"), "g").alias("x")).select("x.*")
    inside = named.join(open_groups, ["band", "value"]).select("g", "size", "rid", "component")
    lists = inside.groupBy("rid").agg(F.collect_list("g").alias("groups"))  # one for each band at most
    inside = inside.join(lists, "rid").join(classes.select("rid", "regs"), "rid")
    needed = spool(_needed(inside, threshold))
    more = _decide(needed, sets_of(rows, needed), threshold, percent)
    of = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(side + "id"))
    lifted = (
        more.select(F.col("a").alias("xid"), F.col("b").alias("yid"))
        .join(label.alias("x"), F.col("xid") == F.col("x.v"), "left")
        .join(label.alias("y"), F.col("yid") == F.col("y.v"), "left")
        .select(of("x").alias("a"), of("y").alias("b"))
    )
    joined = components(lifted)
    final = label.join(joined.select(F.col("v").alias("component"), F.col("component").alias("top")), "component", "left").select("v", F.coalesce("top", "component").alias("component"))
    final = final.unionByName(joined.join(label, "v", "left_anti"))
    reps = classes.select("d1", "d2", "rid").join(final, F.col("rid") == F.col("v"), "left").select("d1", "d2", F.coalesce("component", "rid").alias("component"))
    out = sketches.select("rid", "n_shingles", "d1", "d2").join(reps, ["d1", "d2"], "left")
    out = out.select("rid", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("rid")).alias("component"))
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept, for each row of docs."""
    rows, plain = keyed(docs)
    found = cluster(rows, percent)
    if plain:
        return found.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("rid") == F.col("component")).alias("kept"))
    names = rows.select("rid", "doc_id")
    top = names.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id"))
    named = names.join(found, "rid").join(top, "component")
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are the least of their component, one row for each, all columns as they are."""
    name = free_name(docs, "rid")
    rows, _ = numbered(docs, name)
    found = cluster(rows.select(F.col(name).alias("rid"), F.col("text").cast("string").alias("text")), percent)
    gone = found.where("rid != component").select(F.col("rid").alias(name))
    return rows.join(gone, name, "left_anti").select([c for _, c in every_column(docs)])
