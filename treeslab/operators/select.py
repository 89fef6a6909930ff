"""Selections of n-dimensional arrays: hyperslabs, points and regions; reads, writes, fill and resize.

Arrays come in two forms. Nested lists in one row are cut with ``slice`` and ``filter`` before anything is
exploded. The long form has one element a row (coordinates ``i0, i1, ..`` and ``value``), for arrays of any size:
selections are filters that reach the scan, writes are joins on the coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeslab.functions import codec

NONE, ALL, POINTS, HYPERSLABS = "H5S_SEL_NONE", "H5S_SEL_ALL", "H5S_SEL_POINTS", "H5S_SEL_HYPERSLABS"
Slab = tuple[int, int, int]


def slab(text: str | slice | int | Slab | None, extent: int) -> Slab:
    """(start, stop, step) of one axis; None is the whole axis, a number one place. Out of bounds fails."""
    if text is None:
        return 0, extent, 1
    if isinstance(text, int):
        text = slice(text, text + 1)
    if isinstance(text, str):
        parts = [int(x) if x else None for x in text.split(":")]
        text = slice(*parts) if len(parts) > 1 else slice(parts[0], parts[0] + 1)
    if isinstance(text, slice):
        text = (0 if text.start is None else text.start, extent if text.stop is None else text.stop, text.step or 1)
    start, stop, step = text
    if start < 0 or stop > extent or start > stop or step < 1:
        raise ValueError(f"selection {start}:{stop}:{step} of an extent of {extent}")
    return start, stop, step


def slabs(selection: Sequence | None, dims: Sequence[int]) -> list[Slab]:
    """One slab an axis; a selection of another rank fails."""
    if selection is None:
        return [slab(None, d) for d in dims]
    if len(selection) != len(dims):
        raise ValueError(f"a selection of rank {len(selection)} of an array of rank {len(dims)}")
    return [slab(x, d) for x, d in zip(selection, dims)]


def count(s: Slab) -> int:
    """Places that a slab takes."""
    return max(0, -(-(s[1] - s[0]) // s[2]))


def shape_of(selection: Sequence[Slab]) -> list[int]:
    return [count(x) for x in selection]


def cut(values: Column, selection: Sequence[Slab]) -> Column:
    """A hyperslab of nested lists, as nested lists."""
    if not selection:
        return values
    (start, stop, step), rest = selection[0], selection[1:]
    part = F.slice(values, F.lit(start + 1), F.lit(max(0, stop - start)))
    if step > 1:
        part = F.filter(part, lambda _, k: k % step == 0)
    return F.transform(part, lambda x: cut(x, rest)) if rest else part


def places(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def to_long(rows: DataFrame, values: str, rank: int) -> DataFrame:
    """Nested lists as the long form: the other columns, i0 .. and value. A scalar has no coordinates."""
    keep = [x for x in rows.columns if x != values]
    out = rows.withColumnRenamed(values, "value")
    for k in range(rank):
        out = out.select(*keep, *places(k), F.posexplode("value").alias(f"i{k}", "value_")).withColumnRenamed("value_", "value")
    return out


def to_nested(rows: DataFrame, rank: int, keys: Sequence[str] = ()) -> DataFrame:
    """The long form as nested lists, one row for each value of the keys, in the order of the coordinates."""
    out = rows
    for k in range(rank - 1, -1, -1):
        outer = [*keys, *places(k)]
        grouped = out.groupBy(*outer) if outer else out.groupBy()
        out = grouped.agg(F.transform(F.sort_array(F.collect_list(F.struct(f"i{k}", "value"))), lambda x: x["value"]).alias("value"))
    return out


def hyperslab(rows: DataFrame, selection: Sequence[Slab], names: Sequence[str] | None = None) -> DataFrame:
    """The elements of a hyperslab of the long form. Only filters: they are pushed to the scan."""
    for name, (start, stop, step) in zip(names or places(len(selection)), selection):
        at = F.col(name)
        rows = rows.where((at >= start) & (at < stop))
        if step > 1:
            rows = rows.where((at - start) % step == 0)
    return rows


def points(rows: DataFrame, wanted: DataFrame, names: Sequence[str], dims: Sequence[int] | None = None) -> DataFrame:
    """Elements at points (pos, and a column for each name), in the order of pos, repeated where points are.

    A point outside of dims fails. Points are the smaller side; whether they are broadcast is left to their size.
    """
    if dims is not None:
        inside = F.lit(True)
        for name, d in zip(names, dims):
            inside = inside & (F.col(name) >= 0) & (F.col(name) < d)
        wanted = wanted.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("a point is out of bounds")).cast("boolean")))
    return wanted.join(rows, list(names), "left").orderBy("pos")


def points_nested(rows: DataFrame, wanted: DataFrame, key: str, values: str, rank: int) -> DataFrame:
    """pos, i0 .. and value at points (pos, i0 ..) of arrays that are nested lists, a row for each i0 (column key).

    Rows meet points by i0 alone, and a point takes its element from the list: nothing is exploded.
    """
    joined = wanted.join(rows.select(F.col(key).alias("i0"), F.col(values).alias("list_")), "i0", "left")
    value = F.col("list_")
    for k in range(1, rank):
        value = F.get(value, F.col(f"i{k}"))
    return joined.select("pos", *places(rank), value.alias("value")).orderBy("pos")


def write_slab(rows: DataFrame, new: DataFrame, names: Sequence[str]) -> DataFrame:
    """The long form after a write: new elements (names, value) win over old ones."""
    fresh = new.select(*names, F.col("value").alias("new_"), F.lit(True).alias("hit_"))
    joined = rows.join(fresh, list(names), "full_outer")
    return joined.select(*names, F.when(F.col("hit_"), F.col("new_")).otherwise(F.col("value")).alias("value"))


def from_block(values: Sequence, selection: Sequence[Slab]) -> list[tuple]:
    """(coordinates .., value) of a block of nested lists that is written to a hyperslab; a block of another shape fails."""

    def visit(block: object, axes: Sequence[Slab], at: tuple) -> list[tuple]:
        if not axes:
            return [(*at, block)]
        if not isinstance(block, (list, tuple)) or len(block) != count(axes[0]):
            raise ValueError(f"the selection takes {shape_of(selection)}")
        return [x for k, part in enumerate(block) for x in visit(part, axes[1:], (*at, axes[0][0] + k * axes[0][2]))]

    return visit(values, selection, ())


def from_raw(rows: DataFrame, raw: str, item: Any, selection: Sequence[Slab]) -> DataFrame:
    """The other columns of rows, coordinates and value of the elements of a block that is written as raw bytes to a hyperslab; other lengths fail."""
    shape = shape_of(selection)
    every = rows.select(*(x for x in rows.columns if x != raw), F.posexplode(codec.read_raw(F.col(raw), item, math.prod(shape))).alias("at_", "value"))
    size, columns = math.prod(shape), []
    for k, (n, (start, _, step)) in enumerate(zip(shape, selection)):
        size //= n or 1
        columns.append((F.pmod(F.floor(F.col("at_") / max(1, size)), F.lit(max(1, n))) * step + start).cast("long").alias(f"i{k}"))
    return every.select(*(x for x in rows.columns if x != raw), *columns, "value")


def write_points(rows: DataFrame, new: DataFrame, names: Sequence[str]) -> DataFrame:
    """The long form after writes (pos, names, value) one after another: the last at a place wins. One aggregate, no sort."""
    last = new.groupBy(*names).agg(F.max_by("value", "pos").alias("value"))
    return write_slab(rows, last, names)


def region_blocks(selection: Sequence, rank: int) -> list[list[tuple[int, int]]]:
    """Checked blocks [(start, stop) an axis] of a hyperslab region; stop is exclusive."""
    out = []
    for first, last in selection:
        if len(first) != rank or len(last) != rank:
            raise ValueError("a block of another rank")
        if any(a < 0 or b <= a for a, b in zip(first, last)):
            raise ValueError("a block starts at 0 or more and ends after its start")
        out.append(list(zip(first, last)))
    return out


def inclusive_blocks(blocks: Sequence[Sequence[Sequence[int]]]) -> list[list[list[int]]]:
    """Blocks [first, last] with both ends inside, as [start, stop) with the stop outside."""
    return [[list(first), [x + 1 for x in last]] for first, last in blocks]


def region(rows: DataFrame, kind: str, selection: Sequence, names: Sequence[str]) -> DataFrame:
    """Elements of a region reference: nothing, everything, points, or the union of blocks, each element once."""
    if kind == NONE:
        return rows.limit(0)
    if kind == ALL:
        return rows
    inside = F.lit(False)
    if kind == POINTS:
        if any(len(p) != len(names) or min(p) < 0 for p in selection):
            raise ValueError("a point of another rank, or below 0")
        spark = rows.sparkSession
        wanted = spark.createDataFrame([tuple(p) for p in selection], ", ".join(f"`{x}` bigint" for x in names)).distinct()
        return rows.join(wanted, list(names), "left_semi")
    if kind != HYPERSLABS:
        raise ValueError(f"no such selection: {kind}")
    for block in region_blocks(selection, len(names)):
        one = F.lit(True)
        for name, (start, stop) in zip(names, block):
            one = one & (F.col(name) >= start) & (F.col(name) < stop)
        inside = inside | one
    return rows.where(inside)


def grid(spark, dims: Sequence[int], start: Sequence[int] | None = None) -> DataFrame:  # noqa: ANN001
    """All coordinates of an array, or of a block of it that begins at start, made in parallel."""
    out = spark.range(math.prod(dims))
    size = math.prod(dims)
    columns = []
    for k, d in enumerate(dims):
        size //= d or 1
        columns.append(F.expr(f"(id div {max(1, size)}) % {max(1, d)} + {start[k] if start else 0}L").alias(f"i{k}"))
    return out.select(*columns)


def resize(rows: DataFrame, old: Sequence[int], new: Sequence[int], limits: Sequence[int | None], fill: object) -> DataFrame:
    """The long form after growing: new places hold the fill value. Only growth, up to the greatest extents (None: unlimited)."""
    if len(new) != len(old):
        raise ValueError("the rank stays")
    for a, b, m in zip(old, new, limits):
        if b < a:
            raise ValueError("an extent only grows")
        if m not in (None, 0) and b > m:
            raise ValueError("an extent is over its greatest")
    names = places(len(old))
    out = rows.select(*names, "value")
    for k, (a, b) in enumerate(zip(old, new)):  # the slab that axis k adds: old extents on the axes before, new ones after
        added = grid(rows.sparkSession, [*old[:k], b - a, *new[k + 1 :]], [*[0] * k, a, *[0] * (len(new) - k - 1)])
        out = out.unionByName(added.withColumn("value", F.lit(fill).cast(rows.schema["value"].dataType)))
    return out


def filled(rows: DataFrame, dims: Sequence[int], fill: object) -> DataFrame:
    """The long form with every place of the array: missing ones hold the fill value."""
    names = places(len(dims))
    marked = rows.select(*names, "value", F.lit(True).alias("hit_"))
    joined = grid(rows.sparkSession, dims).join(marked, names, "left")
    return joined.select(*names, F.when(F.col("hit_"), F.col("value")).otherwise(F.lit(fill).cast(rows.schema["value"].dataType)).alias("value"))
