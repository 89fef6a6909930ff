"""The row query: records of a one-dimensional array, by predicate, range, step and limit."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.plans.predicate import compile_query

#: Rows that one block of a scan aims at, a whole number of chunks. (Fixed value.)
BLOCK_ROWS = 256_000


def block_rows(chunk: int | None = None, target: int = BLOCK_ROWS) -> int:
    """Rows of a block: the most chunks that fit in the target, or the target."""
    return target if not chunk or chunk >= target else target // chunk * chunk


def row_query(rows: DataFrame, index: str, query: str, fields: dict[str, str] | None = None, start: int = 0, stop: int = -1, step: int = 1, limit: int | None = None, shape: dict[str, Any] | None = None) -> DataFrame | None:
    """Records whose predicate holds, with their index, in its order.

    rows has one record a row and its place in ``index``. fields names the record's fields by column
    (default: all other columns). The range and the predicate reach the scan as filters; a limit is a top-k, not a full sort.
    """
    if shape is not None:
        if shape["class"] == "H5S_NULL":
            return None
        if shape["class"] != "H5S_SIMPLE" or len(shape["dims"]) != 1:
            raise ValueError("only one-dimensional arrays can be queried")
    if step < 1:
        raise ValueError("a step is 1 at least")
    fields = fields or {x: x for x in rows.columns if x != index}
    wanted = compile_query(query, {name: F.col(column) for name, column in fields.items()})
    at = F.col(index)
    kept = rows.where(at >= start)
    if stop >= 0:
        kept = kept.where(at < stop)
    if step > 1:
        kept = kept.where((at - start) % step == 0)
    kept = kept.where(wanted).orderBy(index)
    return kept.limit(limit) if limit else kept
