"""Ordered prefix sums over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_blocks(df: DataFrame, key: str, rows_per_block: int = 100_000, max_blocks: int = 1024) -> tuple[DataFrame, int]:
    """Add ``block``: the rank of the key range that a row's ``key`` (a number) falls into.

    Ranges are cut at approximate quantiles, so blocks have about ``rows_per_block`` rows
    (more only if one key repeats, or beyond ``max_blocks`` of them). A row's block depends on its key alone, so
    recomputed tasks agree. Null keys are in block 0. Returns the frame and the rows' number."""
    n = df.count()
    blocks = min(max_blocks, max(1, -(-n // rows_per_block)))
    cuts: list[float] = []
    if blocks > 1:
        marks = [i / blocks for i in range(1, blocks)]
        cuts = sorted(set(df.select(F.percentile_approx(key, F.array(*map(F.lit, marks)), 10_000)).first()[0] or []))
    block: Column = F.lit(0)
    if cuts:
        block = F.coalesce(_bucket(F.col(key), cuts), F.lit(0))
    return df.withColumn("block", block), n


def _bucket(key: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below a key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNotNull(), tree(0, len(cuts)))


def prefix_sum(df: DataFrame, key: str, value: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before a row in ascending order of ``key``, then ``ties``.

    Each key range is summed by itself; the ranges' totals (one row each) give their
    offsets. ``df`` is read several times, so pass a table or a cheap plan. Keeps ``block``."""
    blocked, _ = with_blocks(df, key)
    order = [F.col(key).asc_nulls_first(), *map(F.col, ties or [])]
    inner = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("block").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    summed = blocked.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return summed.join(F.broadcast(offsets), "block").withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")
