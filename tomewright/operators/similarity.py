"""Pairs of alike texts by an equi-join on their rarest pairs of letters, instead of all pairs of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import udfs
from tomewright.session import materialize

#: Pairs of letters whose counts are known to the executors: the commonest. Others count as rare, in a fixed order.
COMMON = 20_000


def crowded(rows: DataFrame, on: list[str], text: str) -> DataFrame:
    """The rows that agree in ``on`` with a row of another ``text``. The ends of a block's texts are aggregated before the
    shuffle, so what no other text can meet is left out by one number a block."""
    several = rows.groupBy(*on).agg(F.min(text).alias("_first"), F.max(text).alias("_last")).where("_first < _last")
    return rows.join(several.select(*on), on, "left_semi")


def candidates(texts: DataFrame, on: list[str], text: str, threshold: float) -> DataFrame:
    """(on, text1, text2), text1 < text2: different texts that agree in ``on`` and may be alike (``names.similar``, or its like on
    unfolded letters) from ``threshold`` on. See ``udfs.rare_pairs`` for why none is missed. Each pair comes once."""
    one = materialize(crowded(texts.select(*on, F.col(text).alias("text")), on, "text").distinct(), "texts")
    grams = one.select(F.explode(udfs.letter_pairs("text")).alias("gram")).groupBy("gram").count()
    common = {r.gram: r["count"] for r in grams.orderBy(F.desc("count"), "gram").limit(COMMON).collect()}
    keyed = one.withColumn("gram", F.explode(udfs.rare_pairs(threshold, common)("text")))
    met = keyed.withColumnRenamed("text", "text1").join(keyed.withColumnRenamed("text", "text2"), [*on, "gram"]).where("text1 < text2")
    n1, n2 = F.length("text1"), F.length("text2")
    return met.where(F.least(n1, n2) * 2 >= (threshold - 1e-9) * (n1 + n2)).select(*on, "text1", "text2").distinct()
