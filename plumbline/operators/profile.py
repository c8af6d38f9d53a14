"""Column profiles.

Counts, ranges, lengths and text classes are one aggregate per column over cells, combined where the table is read.
Distinct counts come from value hashes; quantiles, types and shapes from the value histogram.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..model import NOT_SCALAR, NUMERIC, TEMPORAL
from .histogram import TOP_OTHER, TOP_TEXT, cids_where, histogram_value, of_columns, top_k
from .quantiles import SMALL_COLUMN, quantiles

QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
QUANTILE_NAMES = ("p01", "p25", "p50", "p75", "p99")
SHOWN_TOP = 20
SHOWN_PATTERNS = 10
EPOCH = datetime(1970, 1, 1)


def to_micros(t: datetime) -> int:
    return round((t.replace(tzinfo=None) - EPOCH) / timedelta(microseconds=1))


YEAR_1900 = to_micros(datetime(1900, 1, 1))
YEAR_2200 = to_micros(datetime(2200, 1, 1))


def counted(pred: Column) -> Column:
    """Rows for which `pred` holds; a null predicate does not count."""
    return F.coalesce(F.sum(F.when(pred, F.col("n"))), F.lit(0)).cast("bigint")


def basic_measures(cells: DataFrame, distinct: DataFrame | None, meta: DataFrame, scan_time: datetime) -> DataFrame:
    """One row per column: counts, ranges, lengths, text classes and date plausibility.

    `cells` may be cells or a histogram; `distinct` has a row `(cid, distinct)` for each column with
    values. Without it `cells` is a histogram, of which each row is one value."""
    v = histogram_value()
    kind = F.col("logical_type")
    is_num, is_text, is_time = kind.isin(*NUMERIC), kind == "text", kind.isin(*TEMPORAL)
    scalar = ~F.col("logical_type").isin(*NOT_SCALAR)
    x, t, us, n = F.col("_x"), F.col("_t"), F.col("_us"), F.col("n")
    length = F.char_length(t)
    tomorrow = to_micros(scan_time + timedelta(days=1))
    rows = cells.join(F.broadcast(meta.select("cid", "slot", "logical_type")), "cid").select(
        "cid", "logical_type", "n", v.number.alias("_x"), v.string.alias("_t"), v.micros.alias("_us"),
        v.present.alias("_p"),
    )
    only = lambda cond, c: F.when(F.first(cond), c)
    measured = rows.groupBy("cid").agg(
        F.first(scalar).alias("_scalar"),
        F.sum("n").alias("rows"),
        counted(~F.col("_p")).alias("nulls"),
        F.min("_x").alias("min_number"),
        F.max("_x").alias("max_number"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        only(is_num, counted(x == 0)).alias("zeros"),
        only(is_num, counted(x < 0)).alias("negatives"),
        only(is_num, counted(F.col("_p") & x.isNull())).alias("non_finite"),
        F.min(length).cast("bigint").alias("min_length"),
        F.max(length).cast("bigint").alias("max_length"),
        (F.sum(length * n) / F.sum(F.when(t.isNotNull(), n))).alias("mean_length"),
        only(is_text, counted(X.has_outer_spaces(t))).alias("whitespace"),
        only(is_text, counted(X.has_non_printing(t))).alias("non_printing"),
        only(is_text, counted(X.is_blank(t))).alias("blanks"),
        only(is_text, counted(X.is_numeric_like(t))).alias("numeric_like"),
        only(is_text, counted(X.is_date_like(t))).alias("date_like"),
        only(is_text, counted(X.is_leading_zero_number(t))).alias("leading_zero_numbers"),
        F.min("_us").alias("min_us"),
        F.max("_us").alias("max_us"),
        only(is_time, counted(us > tomorrow)).alias("future"),
        only(is_time, counted(us < YEAR_1900)).alias("before_1900"),
        only(is_time, counted(us > YEAR_2200)).alias("after_2200"),
        *([F.count_if("_p").alias("distinct")] if distinct is None else []),
    )
    if distinct is not None:  # one row per column on both sides
        measured = measured.join(F.broadcast(distinct), "cid", "left")
    return measured.withColumn(
        "distinct", F.when(F.col("_scalar"), F.coalesce("distinct", F.lit(0)))
    ).drop("_scalar")


def number_values(hist: DataFrame, meta: DataFrame) -> DataFrame:
    """`(cid, x, n)` of the numeric columns."""
    numeric = cids_where(meta, F.col("logical_type").isin(*NUMERIC))
    # Of a number exactly one slot is filled; NaN is larger than infinity.
    x = F.coalesce(F.col("i").cast("double"), F.col("d"), F.col("s").cast("double"))
    return of_columns(hist, numeric).select("cid", x.alias("x"), "n").filter(F.abs("x") < float("inf"))


def number_ranges(basic: DataFrame) -> DataFrame:
    """`(cid, lo, hi)`: the smallest and largest number of each column."""
    return basic.select("cid", F.col("min_number").alias("lo"), F.col("max_number").alias("hi"))


def large_columns(basic_rows: list[Any]) -> list[int]:
    """Columns with too many distinct values for one task to hold."""
    return [r.cid for r in basic_rows if (r["distinct"] or 0) > SMALL_COLUMN]


def spread_measures(
    hist: DataFrame, meta: DataFrame, centres: DataFrame, large: list[int], held: list[DataFrame] | None = None
) -> DataFrame:
    """Standard deviation and MAD: a second pass with each column's mean and median joined in.

    `centres`: `(cid, mean, p50, min_number, max_number)`."""
    values = number_values(hist, meta).join(F.broadcast(centres.select("cid", "mean", "p50")), "cid")
    moments = values.groupBy("cid").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("_m2")
    )
    farthest = F.greatest(F.col("p50") - F.col("min_number"), F.col("max_number") - F.col("p50"))
    ranges = centres.select("cid", F.lit(0.0).alias("lo"), farthest.alias("hi"))
    mad = quantiles(values.select("cid", F.abs(F.col("x") - F.col("p50")).alias("x"), "n"), (0.5,), large, held, ranges)
    return moments.join(mad, "cid", "left").select(
        "cid",
        F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1))).alias("stddev"),
        F.col("q")[0].alias("mad"),
    )


def semantic_measures(values: DataFrame, meta: DataFrame) -> DataFrame:
    """The semantic type of each text column and its share, over all `text_values`."""
    text = meta.filter("logical_type = 'text'").select("cid", "allowed_types")
    rows = values.join(F.broadcast(text), "cid").withColumn("_v", X.strip(F.col("value")))
    # Only fixed-width sums, so that the aggregate stays a hash aggregate and no text is sorted; allowed types join after it.
    per = rows.groupBy("cid").agg(
        F.sum("n").alias("total"),
        *[
            counted(F.array_contains("allowed_types", name) & test(F.col("_v"))).alias(f"ok_{name}")
            for name, test in S.TESTS.items()
        ],
    )
    per = per.join(F.broadcast(text), "cid")
    best = S.best_type(F.col("total"), {name: F.col(f"ok_{name}") for name in S.TESTS}, F.col("allowed_types"))
    return per.withColumn("_b", best).select(
        "cid", F.col("_b.name").alias("semantic_type"), F.col("_b.share").alias("semantic_share")
    )


def patterns(values: DataFrame, limit: int = SHOWN_PATTERNS) -> DataFrame:
    """`(cid, pattern, n, rank)`: the most frequent shapes of each text column, over all `text_values`."""
    shapes = (
        values.groupBy("cid", X.pattern_class(F.col("value")).alias("pattern"))
        .agg(F.sum("n").alias("n"))
    )
    return top_k(shapes, ["cid"], [F.desc("n"), F.asc("pattern")], limit, F.col("pattern"))


def role_expr() -> Column:
    """The role of a column, from its declaration, type, name and distinct share."""
    name = F.lower("column")
    nearly_unique = (F.col("rows") > F.col("nulls")) & (
        F.col("distinct") >= 0.99 * (F.col("rows") - F.col("nulls"))
    )
    return (
        F.when(F.col("declared_key"), "key")
        .when(F.col("declared_reference"), "foreign_key")
        .when(F.col("logical_type").isin(*TEMPORAL), "timestamp")
        .when((name == "id") & F.coalesce(nearly_unique, F.lit(False)), "key")
        .when(name.endswith("_id") & F.array_contains("key_names", name) & F.coalesce(nearly_unique, F.lit(False)), "key")
        .when(name.endswith("_id"), "foreign_key")
        .when(F.col("logical_type").isin(*NUMERIC), "measure")
        .when((F.col("logical_type") == "text") & (F.coalesce(F.col("mean_length"), F.lit(0.0)) > 50), "description")
        .otherwise("attribute")
    )


def iso_instant(us: Column, logical: Column) -> Column:
    """An instant as ISO text; dates without a time."""
    ts = F.timestamp_micros(us)
    fraction = us % 1_000_000 != 0
    return (
        F.when(logical == "date", F.date_format(ts, "yyyy-MM-dd"))
        .when(fraction, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    )


def profile_frame(meta: DataFrame, basic: DataFrame, quants: DataFrame, spread: DataFrame, semantic: DataFrame) -> DataFrame:
    """The profile table: one row per column. Its inputs have one row per column as well."""
    q = quants.select("cid", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)])
    joined = (
        meta.join(basic, "cid", "left").join(q, "cid", "left").join(spread, "cid", "left").join(semantic, "cid", "left")
    )
    # A column of an empty table has no histogram rows: its counts are zero, its values absent.
    kind = F.col("logical_type")
    zero_where = [
        (~kind.isin(*NOT_SCALAR), ("distinct",)),
        (kind == "text", ("blanks", "whitespace", "non_printing", "numeric_like", "date_like", "leading_zero_numbers")),
        (kind.isin(*NUMERIC), ("zeros", "negatives", "non_finite")),
        (kind.isin(*TEMPORAL), ("future", "before_1900", "after_2200")),
        (F.lit(True), ("rows", "nulls")),
    ]
    joined = joined.withColumns(
        {c: F.when(cond, F.coalesce(F.col(c), F.lit(0))) for cond, names in zero_where for c in names}
    )
    non_null = F.col("rows") - F.col("nulls")
    limit = F.when(F.col("logical_type") == "text", TOP_TEXT).otherwise(TOP_OTHER)
    return joined.select(
        "cid", "asset", "column", "position", "physical_type", "logical_type", "declared_not_null",
        "semantic_type", "semantic_share",
        "rows", "nulls", non_null.alias("non_null"),
        "distinct", "blanks", "min_number", "max_number", "mean", "stddev", *QUANTILE_NAMES, "mad", "zeros",
        "negatives", "non_finite", "min_length", "max_length", "mean_length", "whitespace", "non_printing",
        "numeric_like", "date_like", "leading_zero_numbers", "min_us", "max_us",
        iso_instant(F.col("min_us"), F.col("logical_type")).alias("oldest"),
        iso_instant(F.col("max_us"), F.col("logical_type")).alias("newest"),
        "future", "before_1900", "after_2200",
        (F.col("distinct") > limit).alias("top_truncated"),
        F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).alias("null_ratio"),
        F.when(non_null > 0, F.col("distinct") / non_null).alias("distinct_ratio"),
        role_expr().alias("role"),
    )


@dataclass(frozen=True)
class ColumnProfile:
    """A row of the profile table on the driver, for generating checks."""

    row: Any
    top: tuple[tuple[str, int], ...] = ()  # only for columns with at most 20 distinct values
    patterns: tuple[tuple[str, int], ...] = ()  # the three most frequent shapes

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name == "row":
            raise AttributeError(name)
        return self.row[name]

    @property
    def personal(self) -> bool:
        return self.row.semantic_type in S.personal_types()


@dataclass
class AssetProfile:
    """What is known of a table after profiling."""

    asset: Any
    population: int = 0
    sample_rows: int = 0
    sampled: bool = False
    columns: list[ColumnProfile] = field(default_factory=list)
    error: str | None = None

    @property
    def label(self) -> str:
        return self.asset.label

    def column(self, name: str | None) -> ColumnProfile | None:
        return next((c for c in self.columns if c.column == name), None)

    @property
    def time_series_candidate(self) -> bool:
        roles = {c.role for c in self.columns}
        return "timestamp" in roles and "measure" in roles and self.sample_rows >= 100
