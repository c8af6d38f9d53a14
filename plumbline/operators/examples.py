"""Evidence: up to five failing values per check, and the findings they belong to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..model import CheckSpec
from ..session import local_frame
from .checks import check_types
from .evaluate import (
    Store, _fails, _value_rows, casing_variants, is_finding, newest_values, order_violations, orphans, severity_rank,
    union_all, value_params,
)
from .histogram import histogram_value, of_columns, top_k

EXAMPLES = 5


def choose_checks(results: DataFrame, per_asset: int | None = None) -> DataFrame:
    """The failing checks that get examples: all, or `per_asset` per table, scoring ones first, then by severity.

    Format and spelling checks and facts of the table do not count. One row per check goes in."""
    if per_asset is None:
        return results.filter("failed > 0")
    ranked = [t.name for t in check_types().values() if not t.from_values and t.how != "table"]
    plain = F.col("type").isin(*ranked)
    order = Window.partitionBy("asset", plain).orderBy(
        F.desc("scores"), severity_rank(F.col("severity")), "type_order", "check_id"
    )
    return (
        results.filter("failed > 0")
        .withColumn("_r", F.row_number().over(order))
        .filter(~plain | (F.col("_r") <= per_asset))
        .drop("_r")
    )


def failing_values(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """`(check_id, value, n)`: the distinct failing values of the given checks."""
    types = check_types()
    how = lambda *kinds: [s for s in specs if types[s.type].how in kinds]
    frames = []
    single = [s for s in how("value") if s.column]
    if single:
        params, used, cids = value_params(store, single)
        v = histogram_value()
        failing = [
            F.when(_fails(t, v) & (F.col("n") > 1) if t.repeats else _fails(t, v), F.lit(t.name)) for t in used
        ]
        # Only values that fail some check are turned into text.
        some = reduce(lambda a, b: a | b, [F.coalesce(_fails(t, v), F.lit(False)) & ((F.col("n") > 1) if t.repeats else F.lit(True)) for t in used])
        frames.append(
            _value_rows(store, params, of_columns(store.hist, cids)).filter(some)
            .select("asset", "column", v.text.alias("value"), "n", F.explode(F.array_compact(F.array(*failing))).alias("type"))
            .select(F.concat_ws(":", "type", "asset", "column").alias("check_id"), "value", "n")
        )
    if how("casing"):
        frames.append(casing_variants(store, how("casing")))
    if how("parent"):
        frames.append(orphans(store, how("parent")))
    if how("order"):
        frames.append(order_violations(store, how("order")))
    aged = [s for s in how("table") if s.type == "freshness"]
    if aged:
        newest = newest_values(store, aged).filter(F.col("newest").isNotNull())
        frames.append(
            newest.select(
                "check_id", F.timestamp_micros("newest").cast("string").alias("value"), F.lit(1).cast("bigint").alias("n")
            )
        )
    if not frames:
        return local_frame(store.spark, [], "check_id string, value string, n bigint")
    return union_all(frames)


def examples(store: Store, specs: list[CheckSpec], personal: set[tuple[str, str]]) -> DataFrame:
    """`(check_id, examples array<struct<value, n, masked>>)`: most frequent first, ties by text."""
    masked = local_frame(
        store.spark, [(s.id, (s.asset, s.column) in personal) for s in specs], "check_id string, masked boolean"
    )
    top = top_k(
        failing_values(store, specs), ["check_id"], [F.desc("n"), F.asc("value")], EXAMPLES, F.col("value")
    )
    shown = top.join(F.broadcast(masked), "check_id").withColumn("value", shown_value(F.col("value"), F.col("masked")))
    return shown.groupBy("check_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n", "masked"))),
            lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"), e["masked"].alias("masked")),
        ).alias("examples")
    )


def shown_value(value: Column, masked: Column, characters: int | None = None) -> Column:
    """The value, masked if personal; with `characters`, a longer one is cut and ends in an ellipsis."""
    plain = value if characters is None else F.when(F.char_length(value) > characters, F.concat(F.substring(value, 1, characters), F.lit("…"))).otherwise(value)
    return F.when(masked, X.mask(value)).otherwise(plain)


def findings(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Failing checks that score, with their evidence, the most severe and worst first."""
    return (
        results.filter(is_finding())
        .join(evidence, "check_id", "left")
        .select(
            "check_id", "type", "title", "asset",
            F.coalesce(F.col("column"), F.when(F.size("columns") > 0, F.array_join("columns", ", "))).alias("column"),
            "dimension", "severity", "evaluated", "failed", "population", "ratio", "low", "high", "summary", "next_step",
            F.coalesce("examples", F.array().cast("array<struct<value:string,n:bigint,masked:boolean>>")).alias("examples"),
            severity_rank(F.col("severity")).alias("severity_rank"),
        )
        .orderBy("severity_rank", "ratio", "check_id")
    )
