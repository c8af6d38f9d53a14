"""Running sums along an order, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], ahead: str | None = None) -> DataFrame:
    """`df` with the sum of each of `sums` over a group's rows up to and with this one, and `next` of the column `ahead`.

    Groups are the values of `keys`, rows are ordered by `order` (null first). Rows are range-partitioned by both, summed within each
    partition, and moved by what stands in earlier partitions: a group of any size is spread. One row per partition and group
    is all that is brought together. Rows that tie in `order` are summed in any order.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    for name, value in sums.items():
        placed = placed.withColumn(f"_{name}", value)
    placed = cut_lineage(placed.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    within = Window.partitionBy("_part", *keys).orderBy("_row")
    totals = [F.sum(f"_{name}").alias(f"_t_{name}") for name in sums]
    if ahead:
        totals.append(F.min_by(ahead, "_row").alias("_first"))
    parts = placed.groupBy("_part", *keys).agg(*totals) if totals else placed.select("_part", *keys).distinct()
    along = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    for name in sums:
        before = F.sum(f"_t_{name}").over(along.rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn(f"_t_{name}", F.coalesce(before, F.lit(0)))
    if ahead:
        parts = parts.withColumn("_first", F.lead("_first").over(along))
    out = placed
    for name in sums:
        out = out.withColumn(f"_{name}", F.sum(f"_{name}").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    if ahead:
        out = out.withColumn("next", F.lead(ahead).over(within))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}")) for k in ["_part", *keys]]
    joined = out.alias("o").join(parts.alias("p"), same)
    columns = [F.col(f"o.{c}") for c in df.columns]
    columns += [(F.col(f"o._{name}") + F.col(f"p._t_{name}")).alias(name) for name in sums]
    if ahead:
        columns.append(F.coalesce(F.col("o.next"), F.col("p._first")).alias("next"))
    return joined.select(*columns)
