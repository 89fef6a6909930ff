"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is uniform over 60 bits. For each source the words of its documents are
summed by hash bucket; running sums find the bucket in which the source's budget ends; only that bucket
is cut finer, until it holds a single hash. Documents below the threshold are taken, by a
filter: nothing is sorted by hash, and a source that holds a third of all rows is summed before it is shuffled.

Budgets: sources in code point order (null last) weigh 5, 2, 1 in turn and share all words.
A target stops at three times its source's words; the excess goes to the others by weight. A target of t
whole repeats and a rest takes every document t times and those below the threshold once more.

Defined cases: a null text has no words, a null source is a source of its own, repeated rows share a
hash and are taken alike, and with an empty table there is nothing to mix. So do all rows with a null id: a source of them alone is taken
as a whole, or not, and comes as near to its target as that allows. A document longer than what is left of a budget is taken if
that comes nearer. Extra columns stay; where one has the name of a column that is added, the added one gets underscores.
One row for each source is put in order in one task: 20,000 sources take a few megabytes there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeslab.llm.shared import BROADCAST_ROWS, every_column, free_name, spool

WEIGHTS = (5, 2, 1)
CAP = 3
#: Bits of the hash, and bits by which a bucket is cut at each level.
BITS, STEP = 60, 10
SALTS = 64


def words(text: Column) -> Column:
    """Words of a text: places where a word starts, counted without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def position(*columns: Column) -> Column:
    """A uniform hash of 60 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *columns)), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target for sizes (source, source_size), one row a source.

    The level at which target / weight settles is found from running sums in the order in which sources reach their cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    at = sizes.withColumn("weight", weight)
    reach = F.col("source_size") * cap / F.col("weight")
    before = Window.orderBy(reach, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total, weights_sum = F.sum("source_size").over(every), F.sum("weight").over(every)
    capped, used = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = at.withColumn("level", (total - capped) / (weights_sum - used))
    top = level.withColumn("top", F.max("level").over(every))
    target = F.when(reach <= F.col("top"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("top") * F.col("weight"))
    return top.select("source", "source_size", target.alias("target"))


def _by_source(rows: DataFrame, small: DataFrame, n_sources: int) -> DataFrame:
    """rows joined with a frame of one row a source: broadcast if the sources are few, else by salted shuffle."""
    small = small.withColumnRenamed("source", "source_")
    same = F.col("source").eqNullSafe(F.col("source_"))
    if n_sources <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), same).drop("source_")
    salted = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("salt_"))).drop("source_", "salt", "salt_")


def thresholds(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """source, threshold: rows (source, size, h) with h < threshold have sizes that come nearest to budget, for budgets (source, budget).

    state: the bucket [lo, lo + 2 ** left) that the budget ends in, and the words below it.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("done"))
    left = BITS
    while left > 0:
        step = min(STEP, left)
        inner = left - step
        inside = _by_source(rows, state.where("not done").select("source", "lo"), n_sources).where((F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < F.lit(1 << left)))
        cells = inside.groupBy("source", F.shiftright(F.col("h") - F.col("lo"), inner).alias("cell")).agg(F.sum("size").alias("size"), F.min("h").alias("h1"), F.max("h").alias("h2"))
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        named = cells.select(F.col("source").alias("source_"), "cell", "size", "h1", "h2", "before")
        joined = state.join(named, F.col("source").eqNullSafe(F.col("source_")) & (F.col("below") + F.col("before") <= F.col("budget")) & (F.col("below") + F.col("before") + F.col("size") > F.col("budget")), "left")
        single = F.col("h1") == F.col("h2")
        under, over = F.col("budget") - F.col("below") - F.col("before"), F.col("below") + F.col("before") + F.col("size") - F.col("budget")
        lo = F.when(F.col("cell").isNull(), F.col("lo")).when(single, F.col("h1") + F.when(over < under, 1).otherwise(0)).otherwise(F.col("lo") + F.col("cell") * F.lit(1 << inner))
        # no bucket ends the budget: it covers all that is left (only in the first round, or of a done source)
        state = spool(
            joined.select(
                "source",
                "budget",
                F.when(F.col("cell").isNull() & ~F.col("done"), F.lit(1 << BITS)).otherwise(lo).alias("lo"),
                (F.col("below") + F.coalesce("before", F.lit(0))).alias("below"),
                (F.col("done") | F.col("cell").isNull() | single).alias("done"),
            )
        )
        left = inner
        if state.where("not done").isEmpty():
            break
    return state.select("source", F.col("lo").alias("threshold"))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": words(F.col("text").cast("string")), "h": position(F.col("doc_id").cast("string"))})


def _plan(rows: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, int]:
    """source, source_size, target, whole, threshold for rows (source, size, h), and the number of sources."""
    rows = spool(rows)
    goals = spool(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    n_sources = goals.count()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12).cast("long")
    budgets = goals.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget")).where("budget >= 0.5")
    limits = thresholds(rows, budgets, n_sources).withColumnRenamed("source", "s_")
    plan = goals.join(limits, F.col("source").eqNullSafe(F.col("s_")), "left")
    return plan.select("source", "source_size", "target", whole.alias("whole"), F.coalesce("threshold", F.lit(0)).alias("threshold")), n_sources


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs."""
    rows = spool(_measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")).drop("text"))
    plan, n_sources = _plan(rows.drop("doc_id"), weights, cap)
    return _applied(rows, plan, n_sources).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _applied(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    copies = F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return _by_source(rows, plan, n_sources).withColumn("copies", copies)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs that the mix takes, with the number of times it takes them (mix_copies) and their words (mix_words).

    A column of docs that has one of these names stays; the added one gets underscores after its name (shared.free_name).
    """
    rows = _measured(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")).drop("text", "doc_id")
    plan, n_sources = _plan(rows, weights, cap)
    every = every_column(docs)
    whole = docs.select(F.struct(*(c.alias(f"c{k}") for k, (_, c) in enumerate(every))).alias("row"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), position(F.col("doc_id").cast("string")).alias("h"))
    kept = [F.col(f"row.c{k}").alias(name) for k, (name, _) in enumerate(every)]
    return _applied(whole, plan, n_sources).where("copies > 0").select(*kept, F.col("copies").alias(free_name(docs, "mix_copies")), F.col("size").alias(free_name(docs, "mix_words")))
