"""Running sums over a whole order without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name in sums, the sum of that column over the rows before this one in the order.

    Rows are dealt into ranges of the order; each range is summed by itself, and the totals of the ranges, a row for
    each partition, are added as literals. Rows that are equal in the whole order should carry a tie-breaker in it.
    """
    names = list(sums)
    x = rows.select("*", *[sums[n].alias(n) for n in names])
    x = cut(x.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = {r["_part"]: r for r in x.groupBy("_part").agg(*[F.sum(n).alias(n) for n in names]).collect()}  # a row a partition
    offsets: dict[str, list] = {n: [] for n in names}
    for n in names:
        total = 0
        for p in sorted(totals):
            offsets[n] += [F.lit(p), F.lit(total)]
            total += totals[p][n] or 0
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not totals:
        return x.drop("_part")
    return x.select(*rows.columns,
        *[(F.coalesce(F.sum(n).over(w), F.lit(0)) + F.create_map(*offsets[n])[F.col("_part")]).alias(n) for n in names])


def text_batches(rows: DataFrame, text: str, order: list[str], size: int) -> DataFrame:
    """rows with batch: about `size` rows each, in order, and all rows of one text in one batch.

    A text counts from its first row in the order; a text of more than 2 x size rows is split, so that no batch outgrows that."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    place = F.struct(*order)
    texts = rows.groupBy(text).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first"))
    before = running_sums(texts, ["_first", text], {"_before": F.col("_n")}).select(text, "_n", "_before")
    within = Window.partitionBy(text).orderBy(*order)
    x = rows.join(before, text).withColumn("_i",
        F.when(F.col("_n") > 2 * size, F.floor((F.row_number().over(within) - 1) / (2 * size))).otherwise(0))
    return x.withColumn("batch", F.floor(F.col("_before") / size) + F.col("_i")).drop("_n", "_before", "_i")
