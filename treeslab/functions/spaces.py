"""Dataspaces: NULL, SCALAR, or SIMPLE with extents and greatest extents."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

UNLIMITED = "H5S_UNLIMITED"
SHAPE = "struct<class: string, dims: array<bigint>, maxdims: array<string>>"


def space(dims: list[int] | int | None, maxdims: list[Any] | None = None) -> dict:
    """The descriptor of an array of these extents; None: no elements, []: one. 0 or None in maxdims: unlimited.

    maxdims is told only where an extent is unlimited or greater than now.
    """
    if dims is None:
        return {"class": "H5S_NULL"}
    dims = [dims] if isinstance(dims, int) else list(dims)
    if not dims:
        return {"class": "H5S_SCALAR"}
    out: dict[str, Any] = {"class": "H5S_SIMPLE", "dims": dims}
    if maxdims is not None:
        limits = [UNLIMITED if x in (0, None, UNLIMITED) else int(x) for x in maxdims]
        if len(limits) != len(dims) or any(x != UNLIMITED and x < d for x, d in zip(limits, dims)):
            raise ValueError("greatest extents are at least the extents")
        if limits != dims:
            out["maxdims"] = limits
    return out


def dims_of(shape: dict | None) -> list[int] | None:
    """Extents: None of the NULL space, [] of a scalar."""
    if shape is None or shape["class"] == "H5S_NULL":
        return None
    if shape["class"] == "H5S_SCALAR":
        return []
    dims = shape["dims"]
    return [dims] if isinstance(dims, int) else list(dims)


def elements(shape: dict | None) -> int:
    dims = dims_of(shape)
    return 0 if dims is None else math.prod(dims)


def element_count(shape: Column) -> Column:
    """The number of elements of a shape column."""
    product = F.aggregate(shape["dims"], F.lit(1).cast("long"), lambda a, x: a * x)
    return F.when(shape["class"] == "H5S_SIMPLE", product).when(shape["class"] == "H5S_SCALAR", 1).otherwise(0).cast("long")


def shape_column(dims: Column, maxdims: Column | None = None) -> Column:
    """A shape column from extents: null, empty or not."""
    name = F.when(dims.isNull(), "H5S_NULL").when(F.size(dims) == 0, "H5S_SCALAR").otherwise("H5S_SIMPLE")
    limits = F.lit(None).cast("array<string>") if maxdims is None else F.transform(maxdims, lambda x: F.when(x.isNull() | (x == 0), UNLIMITED).otherwise(x.cast("string")))
    simple = F.when(name == "H5S_SIMPLE", dims)
    told = F.when(F.exists(F.arrays_zip(simple.alias("d"), limits.alias("m")), lambda z: z["d"].cast("string") != z["m"]), limits)
    return F.struct(name.alias("class"), simple.alias("dims"), told.alias("maxdims"))
