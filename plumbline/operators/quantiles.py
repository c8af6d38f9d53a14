"""Exact weighted quantiles of many columns, without gathering a column in one task.

Input is values with their counts: `(cid, x, n)`; a value may come in several rows. Columns with few values use
Spark's own `percentile` with frequencies. Larger ones are range-sorted across the cluster: each partition sums its
counts, the sums become offsets, and only the partitions that hold a wanted rank are ranked inside. Where the range of a
column is known, bins of equal width take the place of the partitions and nothing is sorted, unless its values crowd into a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import collect_small

# Distinct values up to which one task may hold a column (about 100 bytes each).
SMALL_COLUMN = 1_000_000
# Bins of a larger column; one row of each is summed by a task.
BINS = 4096


def quantiles(
    values: DataFrame, probs: tuple[float, ...], large: list[int], held: list[DataFrame] | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """`(cid, q array<double>)` in the order of `probs`, interpolated linearly between neighbours.

    `large` names the columns whose distinct count is above `SMALL_COLUMN`. Sorted values
    are persisted; they are appended to `held` for the caller to release. `ranges`: `(cid, lo, hi)`, the smallest and
    largest value of each column, one row per column."""
    small_values = values.filter(~F.col("cid").isin(large)) if large else values
    small = small_values.groupBy("cid").agg(F.percentile("x", [float(p) for p in probs], F.col("n")).alias("q"))
    if not large:
        return small
    wide = values.filter(F.col("cid").isin(large) & F.col("x").isNotNull())
    if ranges is None:
        return small.unionByName(_sorted_quantiles(wide, probs, held))
    binned = _in_bins(wide, ranges)
    ends = _ends(binned, probs)
    crowded = sorted({r.cid for r in ends.collect() if r.held_rows > SMALL_COLUMN})
    if not crowded:
        return small.unionByName(_ranked(binned, ends))
    ranked = _ranked(binned.filter(~F.col("cid").isin(crowded)), ends.filter(~F.col("cid").isin(crowded)))
    return small.unionByName(ranked).unionByName(_sorted_quantiles(wide.filter(F.col("cid").isin(crowded)), probs, held))


def _in_bins(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values with the bin they fall in as `part`. Every step of the formula keeps the order of the values."""
    width = F.col("hi") - F.col("lo")
    share = F.when((width > 0) & (width < float("inf")), (F.col("x") - F.col("lo")) / width).otherwise(0.0)
    part = F.greatest(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    return values.join(F.broadcast(ranges.select("cid", "lo", "hi")), "cid", "left").select("cid", "x", "n", part.alias("part"))


def _sorted_quantiles(values: DataFrame, probs: tuple[float, ...], held: list[DataFrame] | None) -> DataFrame:
    tagged = _in_partitions(values, held)
    return _ranked(tagged, _ends(tagged, probs))


def _in_partitions(values: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    """Values range-sorted over the cluster, with their partition as `part`."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Persisted so that both uses see one and the same range partitioning; blocks lost with an
    # executor are rebuilt from that same shuffle.
    tagged = values.repartitionByRange(parts, "cid", "x").withColumn("part", F.spark_partition_id()).persist()
    if held is not None:
        held.append(tagged)
    return tagged


def _ends(tagged: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """The zero-based ranks of the neighbours of each quantile, with the part that holds them, its offset and its rows."""
    # One row per part and column: bounded by the number of bins or shuffle partitions.
    sums = tagged.groupBy("cid", "part").agg(F.sum("n").alias("in_part"), F.count(F.lit(1)).alias("held_rows"))
    before = Window.partitionBy("cid").orderBy("part")
    spans = sums.select(
        "cid",
        "part",
        "held_rows",
        (F.sum("in_part").over(before) - F.col("in_part")).alias("start"),
        F.sum("in_part").over(before).alias("stop"),
        F.sum("in_part").over(Window.partitionBy("cid")).alias("total"),
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    )
    ranks = spans.select("*", wanted.alias("w")).select(
        "cid", "part", "held_rows", "start", "stop", "w.slot", ((F.col("total") - 1) * F.col("w.p")).alias("h")
    )
    ends = ranks.select(
        "cid", "part", "held_rows", "start", "stop", "slot", "h",
        F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))).alias("r"),
    ).filter((F.col("r") >= F.col("start")) & (F.col("r") < F.col("stop")))
    # Two rows per quantile. Local ones keep the joins of `_ranked` from being self-joins, on whose second side Spark may not find
    # held values again and would sort them anew, perhaps with other bounds.
    return collect_small(ends)


def _ranked(tagged: DataFrame, ends: DataFrame) -> DataFrame:
    """`(cid, q)` from the values of the parts that hold a wanted rank."""
    # Rows, not range: equal values in several rows each take their own ranks.
    running = Window.partitionBy("cid", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = ends.select("cid", "part", "start").distinct()
    counted = (
        tagged.join(F.broadcast(needed), ["cid", "part"])
        .withColumn("hi", F.col("start") + F.sum("n").over(running))
        .withColumn("lo", F.col("hi") - F.col("n"))
        .select("cid", "part", "x", "lo", "hi")
    )
    wanted = F.broadcast(ends.drop("start", "held_rows"))
    hits = counted.join(wanted, ["cid", "part"]).filter((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    per_quantile = hits.groupBy("cid", "slot").agg(
        F.min("x").alias("a"), F.max("x").alias("b"), F.max(F.col("h") - F.floor("h")).alias("frac")
    )
    return per_quantile.groupBy("cid").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slot", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("v")))),
            lambda e: e["v"],
        ).alias("q")
    )
