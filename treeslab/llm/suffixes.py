"""Suffix-array dedup with a logarithmic index family.

Removes each byte that is covered by a ``WIDTH``-byte string which starts anywhere else too.

Texts enter a shard's index as contexts of anchors (``repeated``, ``anchors``): the suffix from
the anchor on, and the prefix before it, read backwards. An index level holds a suffix array of
each, sorted by bytes, so texts that share k bytes on a side are neighbours whose least common
prefix between them is k or more. New texts of a shard come in batches. A batch gets its suffix arrays; they
are merge-scanned against those of each existing level: in the merged order, the classes of
suffixes with at least WIDTH - r bytes in common and those of backward prefixes with at least
r in common, taken together, are the equal windows that start r bytes before the anchor. A class whose texts
occur twice in all is repeated; nothing else decides. Then the
batch joins the family as a level, and levels of equal size merge, so a shard of n texts has at most
log2(n) levels and each text is merged log2(n) times.

``dedup`` judges one table. ``Index`` keeps a family in a folder and takes batches of documents as they come: a batch's contexts are
scanned against the levels' contexts of the same keys, and levels of equal size merge.

The suffixes at anchors are enough: every window has one, and equal windows have it at the same place.
Suffixes are compared by bytes; hashes of 64 bits bring candidates together, and texts of one 128-bit fingerprint
(key, digest) are taken as equal, so that a passage of many copies enters the index once, with its number.

Defined cases: a null text is empty; texts under WIDTH bytes are kept whole. Repeated rows
are documents of their own, so their windows go. Ties don't matter: an equal
string anywhere removes both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeslab.llm import blocks as B
from treeslab.llm import repeated as R
from treeslab.llm.shared import keyed, ship, spool

WIDTH = 200
#: Texts of one batch.
BATCH = 8192


class Level:
    """Texts in a suffix array: sorted by the bytes from the anchor on (ahead), and by those before it, backwards (behind).

    valid: for each text the least and the greatest r of its windows, r bytes before the anchor. weight: how often it occurs.
    """

    def __init__(self, ahead: np.ndarray, behind: np.ndarray, valid: np.ndarray, ids: np.ndarray, weight: np.ndarray):
        self.ahead, self.behind, self.valid, self.ids, self.weight = ahead, behind, valid, ids, weight
        self.by_ahead, self.by_behind = np.argsort(ahead, kind="stable"), np.argsort(behind, kind="stable")

    def __len__(self) -> int:
        return len(self.ids)

    @classmethod
    def of(cls, contents: list[bytes], anchors: np.ndarray, counts: np.ndarray, ids: np.ndarray, width: int, weight: np.ndarray | None = None) -> Level:
        ahead = np.array([x[a:].ljust(width, b"\0")[:width] for x, a in zip(contents, anchors.tolist())], dtype=f"S{width}")
        behind = np.array([x[:a][::-1].ljust(width, b"\0") for x, a in zip(contents, anchors.tolist())], dtype=f"S{width}")
        return cls(ahead, behind, np.stack([anchors - counts + 1, anchors], axis=1), ids, np.ones(len(ids), dtype=np.int64) if weight is None else weight)

    def merged(self, other: Level) -> Level:
        """One level of both: the sorted arrays are merged, not sorted anew."""
        out = object.__new__(Level)
        out.ahead, out.behind = np.r_[self.ahead, other.ahead], np.r_[self.behind, other.behind]
        out.valid, out.ids, out.weight = np.r_[self.valid, other.valid], np.r_[self.ids, other.ids], np.r_[self.weight, other.weight]
        out.by_ahead = _merge(self.ahead, self.by_ahead, other.ahead, other.by_ahead)
        out.by_behind = _merge(self.behind, self.by_behind, other.behind, other.by_behind)
        return out


def _merge(x: np.ndarray, x_order: np.ndarray, y: np.ndarray, y_order: np.ndarray) -> np.ndarray:
    """The order of the entries of x, then y, from the orders of both."""
    at = np.searchsorted(x[x_order], y[y_order], side="right") + np.arange(len(y))
    out = np.empty(len(x) + len(y), dtype=np.int64)
    taken = np.zeros(len(out), dtype=bool)
    taken[at] = True
    out[at] = y_order + len(x)
    out[~taken] = x_order
    return out


def _common(strings: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Bytes that each string shares with the one before it in the order."""
    out = np.zeros(len(order), dtype=np.int64)
    for lo in range(1, len(order), 1 << 14):
        hi = min(len(order), lo + (1 << 14))
        rows = np.frombuffer(strings[order[lo - 1 : hi]].tobytes(), dtype=np.uint8).reshape(-1, width)
        differ = rows[1:] != rows[:-1]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


def matches(level: Level, width: int, ours: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, r) of the windows that occur twice in the level, by the texts' weights; with ours, those in one of ours and one that isn't."""
    n = len(level)
    ahead, behind = _common(level.ahead, level.by_ahead, width), _common(level.behind, level.by_behind, width)
    texts, offsets = [], []
    for r in range(int(level.valid[:, 0].min()), int(level.valid[:, 1].max()) + 1):
        fits = np.flatnonzero((level.valid[:, 0] <= r) & (r <= level.valid[:, 1]))
        if not len(fits):
            continue
        a, b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        a[level.by_ahead] = np.cumsum(ahead < width - r)
        b[level.by_behind] = np.cumsum(behind < r)
        both = a[fits] * (n + 1) + b[fits]
        order = np.argsort(both, kind="stable")
        group = np.cumsum(np.r_[True, np.diff(both[order]) != 0]) - 1
        if ours is not None:
            size, mine = np.bincount(group), np.bincount(group, weights=ours[fits][order])
            hit = ((mine > 0) & (mine < size))[group]
        else:
            hit = (np.bincount(group, weights=level.weight[fits][order]) > 1)[group]
        texts.append(fits[order[hit]])
        offsets.append(np.full(len(texts[-1]), r))
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(texts), np.concatenate(offsets)


class Family:
    """A logarithmic family of levels; add() reports the matches of new texts with all texts so far."""

    def __init__(self, width: int = WIDTH):
        self.width, self.levels = width, []

    def add(self, batch: Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, r) of windows that occur twice: within the batch, or in a level and the batch."""
        found, r = matches(batch, self.width)
        yield batch.ids[found], r
        for level in self.levels:
            both = level.merged(batch)
            found, r = matches(both, self.width, np.arange(len(both)) >= len(level))
            yield both.ids[found], r
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1]) >= len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text of a shard that occur twice. Texts come in batches in the order of their digests, so those of a key are dealt over all levels."""
    np.seterr(over="ignore")
    family = Family()
    tables: list[pa.Table] = []
    base: list[np.ndarray] = []
    place: list[np.ndarray] = []  # a text's first window, less what its first window has before the anchor
    texts = total = 0
    hit = np.zeros(0, dtype=bool)
    for table in R.arriving(batches, BATCH):
        count, anchor, n = (table.column(x).to_numpy().astype(np.int64) for x in ("count", "anchor", "n"))
        begin = total + np.r_[0, np.cumsum(count)]
        ids = texts + np.arange(len(count))
        place.append(begin[:-1] + anchor)
        where = np.concatenate(place)
        hit = np.r_[hit, np.zeros(begin[-1] - total, dtype=bool)]
        for text, r in family.add(Level.of(table.column("content").to_pylist(), anchor, count, ids, WIDTH, n)):
            hit[where[text] - r] = True
        tables.append(table.select(["key", "digest"]))
        base.append(begin[:-1])
        texts, total = texts + len(count), int(begin[-1])
    if texts:
        every = pa.concat_tables(tables)
        yield R.answer(every.column(0).to_numpy(), every.column(1).to_numpy(), np.r_[np.concatenate(base), total], hit)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in B.blocks(B.binary(batch.column(1))):
            of = offsets - np.arange(len(offsets))
            runs = batch.column(2)[first:last]
            gone = R.run_flags(runs, WIDTH, of)
            rows = []
            for k in range(last - first):
                text, flags = data[offsets[k] : offsets[k + 1] - 1], gone[of[k] : of[k + 1]]
                spans = int(np.count_nonzero(np.diff(np.r_[0, flags.astype(np.int8)]) == 1))
                rows.append((len(text), int(flags.sum()), spans, text[~flags].tobytes()))
            n, removed, spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row of docs."""
    rows, _ = keyed(docs)
    runs = R.repeated(rows, R.Bytes(WIDTH), _decide, keep_first=False)
    return R.covered(rows, runs, _finish, SCHEMA)


class Index:
    """A logarithmic family of levels in a folder, each a table of contexts (repeated.TEXT) by key.

    It grows by batches of documents whose doc_id is unique over all batches and never null. ``size`` counts contexts.
    An interrupted add leaves files that no manifest names; the index stays as it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.kind = spark, folder, R.Bytes(WIDTH)
        self.version, self.levels, self.batches = 0, [], []  # (folder, size) of each level; a name for each batch
        manifest = self._path("manifest")
        if self._exists(manifest):
            last = spark.read.parquet(manifest).orderBy(F.desc("version")).first()
            self.version, self.levels, self.batches = last.version, [(x.name, x.size) for x in last.levels], list(last.batches)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _kept(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").option("compression", "zstd").parquet(self._path(name))
        return self.spark.read.schema(frame.schema).parquet(self._path(name))

    def _each(self, level: DataFrame) -> DataFrame:
        numbers = level.where("n is not null").groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "start")).alias("own"))
        return numbers.select("key", "digest", "n", "own.*")

    def _level(self, name: str) -> DataFrame:
        return self.spark.read.schema(R.TEXT).parquet(self._path(name))

    def add(self, docs: DataFrame) -> None:
        """Scan a batch against itself and all levels; note the repeated windows of both sides; add it as a level."""
        ship(self.spark)
        rows, plain = keyed(docs)
        if not plain:
            raise ValueError("the documents of a batch have unique ids")
        version = self.version + 1
        met = self._kept(R.occurrences(rows, self.kind, None), f"met-{version}")
        each = R.listed(met)
        batch = self._kept(R.part_of(each, R.NUMBER).unionByName(R.texts_at(rows, self.kind, each)).repartition("key"), f"level-{version}")
        keys = batch.select("key").distinct()
        scanned = batch
        for name, _ in self.levels:
            scanned = scanned.unionByName(self._level(name).join(keys, "key", "left_semi").select(R.NAMES))
        scanned = spool(scanned)
        self._kept(R.decided(self._each(scanned), R.part_of(scanned.where("content is not null"), R.CONTENT), self.kind, _decide), f"found-{version}")
        levels = [*self.levels, (f"level-{version}", batch.where("n is not null").count())]
        while len(levels) > 1 and levels[-1][1] >= levels[-2][1]:
            (one, _), (two, _) = levels.pop(), levels.pop()
            both = self._level(one).unionByName(self._level(two))
            content = both.where("content is not null").dropDuplicates(["key", "digest"])
            merged = self._kept(R.part_of(self._each(both), R.NUMBER).unionByName(content).repartition("key"), f"level-{version}-{len(levels)}")
            levels.append((f"level-{version}-{len(levels)}", merged.where("n is not null").count()))
        self.version, self.levels, self.batches = version, levels, [*self.batches, str(version)]
        state = self.spark.createDataFrame([(version, levels, self.batches)], "version int, levels array<struct<name: string, size: long>>, batches array<string>")
        state.write.mode("append").parquet(self._path("manifest"))

    def removed(self, docs: DataFrame) -> DataFrame:
        """What dedup gives for docs, all of which were added, judged on everything that was added so far."""
        rows, _ = keyed(docs)
        met = self.spark.read.parquet(*(self._path(f"met-{x}") for x in self.batches))
        found = self.spark.read.parquet(*(self._path(f"found-{x}") for x in self.batches))
        each = self._each(self._level(self.levels[0][0]))
        for name, _ in self.levels[1:]:
            each = each.unionByName(self._each(self._level(name)))
        each = each.groupBy("key", "digest").agg(F.sum("n").alias("n"))
        return R.covered(rows, R.applied(met, each, found, keep_first=False).join(rows.select("rid"), "rid", "left_semi"), _finish, SCHEMA)
