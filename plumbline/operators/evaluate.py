"""Counting evaluated and failing rows per check: `(check_id, n, k)` for any number of tables.

Checks on values run over cells (or the histogram, where a scan holds it), with their parameters joined in as one small
row per column, and are combined where they are read. Repeated keys are counted by value hashes. References are joined between distinct values, so a
hot key is one row on either side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property, partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import intervals as I
from ..functions import text as X
from ..model import SEVERITIES, Asset, CheckSpec
from ..session import collect_small, local_frame, run_together
from .checks import CheckType, age_hours, check_types, spec_id
from .histogram import ColumnMeta, Value, encode, histogram_value, of_columns, quote, row_value, slot_letter, value_cells, value_hashes

COUNTS_SCHEMA = "check_id string, n bigint, k bigint"


@dataclass(frozen=True)
class Store:
    """The profiled tables a set of checks is evaluated against."""

    spark: SparkSession
    assets: dict[str, Asset]  # full tables
    read: dict[str, DataFrame]  # what was read of each: the table itself or its sample
    sampled: dict[str, bool]
    hist: DataFrame
    meta: DataFrame
    metas: list[ColumnMeta]
    now: datetime
    counted: bool = False  # the histogram is held already, as in a scan that needs it for values and references

    def column(self, asset: str, column: str | None) -> ColumnMeta | None:
        return self._by_name.get((asset, column))

    @cached_property
    def _by_name(self) -> dict[tuple[str, str], ColumnMeta]:
        return {(m.asset, m.column): m for m in reversed(self.metas)}

    def cells(self, cids: set[int]) -> DataFrame:
        """The cells of some columns, the others not being read; the rows of the histogram if it is held."""
        if self.counted:
            return of_columns(self.hist, cids)
        wanted: dict[str, list[ColumnMeta]] = {}
        for m in self.metas:
            if m.cid in cids:
                wanted.setdefault(m.asset, []).append(m)
        return value_cells([(self.read[label], metas) for label, metas in wanted.items()])

    def full(self, label: str) -> DataFrame:
        return self.assets[label].df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- checks on values -------------------------------------------------------------------------------


def value_params(store: Store, specs: list[CheckSpec]) -> tuple[DataFrame, list[CheckType], set[int]]:
    """One row per column with a struct of parameters per check type, null where the check is absent; the types and columns.

    The row count is the number of checked columns, so the frame is always broadcast."""
    types = check_types()
    used = [t for t in types.values() if t.how in ("value", "nulls") and any(s.type == t.name and s.column for s in specs)]
    by_column: dict[int, dict[str, tuple[Any, ...]]] = {}
    for s in specs:
        t = types[s.type]
        if t in used and s.column:
            m = store.column(s.asset, s.column)
            by_column.setdefault(m.cid, {})[t.name] = t.typed(s.params, store.now)
    schema = "cid int, asset string, column string" + "".join(f", p_{t.name} struct<{_ddl(t.fields)}>" for t in used)
    where = {m.cid: m for m in store.metas}
    rows = [
        (cid, where[cid].asset, where[cid].column, *[p.get(t.name) for t in used]) for cid, p in by_column.items()
    ]
    return local_frame(store.spark, rows, schema), used, set(by_column)


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))


def _struct_fields(t: CheckType) -> list[str]:
    return T._parse_datatype_string(t.fields).names


def _value_rows(store: Store, params: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells or histogram rows of the checked columns with their parameters."""
    slots = store.meta.select("cid", "slot")
    return cells.join(F.broadcast(params.join(slots, "cid")), "cid")


def _fails(t: CheckType, v: Value) -> Column:
    """Whether a cell fails a value check that is set for its column."""
    p = F.col(f"p_{t.name}")
    if t.how == "nulls":
        return p.isNotNull() & ~v.present
    return p.isNotNull() & v.present & t.fail(v, lambda f: p[f])


def value_counts(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """All value checks of all columns: one aggregate over cells, combined before anything is shuffled."""
    params, used, cids = value_params(store, specs)
    n, v = F.col("n"), histogram_value()
    cells = store.cells(cids)
    once, again = [t for t in used if not t.repeats], [t for t in used if t.repeats]
    # Only fixed-width sums are kept per column, so that the aggregate stays a hash aggregate; names and settings join after it.
    grouped = _value_rows(store, params, cells).groupBy("cid").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(v.present, n)).alias("present"),
        *[F.sum(F.when(_fails(t, v), n)).alias(f"k_{t.name}") for t in once],
    )
    for t in again:
        grouped = grouped.join(F.broadcast(_repeats(store, t, [s for s in specs if s.type == t.name])), "cid", "left")
    settings = params.select("cid", "asset", "column", *[F.col(f"p_{t.name}").isNotNull().alias(f"on_{t.name}") for t in used])
    grouped = grouped.join(F.broadcast(settings), "cid")
    per_check = F.array(
        *[
            F.struct(
                F.lit(t.name).alias("type"),
                F.col(f"on_{t.name}").alias("on"),
                F.coalesce(F.col("rows" if t.how == "nulls" else "present"), F.lit(0)).alias("n"),
                F.coalesce(F.col(f"k_{t.name}"), F.lit(0)).alias("k"),
            )
            for t in used
        ]
    )
    # An empty table has no histogram rows; its checks are filled with zeros by `count_checks`.
    return grouped.select("asset", "column", F.inline(per_check)).filter("on").select(
        F.concat_ws(":", "type", "asset", "column").alias("check_id"), "n", "k"
    )


def _repeats(store: Store, t: CheckType, specs: list[CheckSpec]) -> DataFrame:
    """`(cid, k_<type>)`: rows of failing values after the first of each value; values not yet counted are by their hashes."""
    params, _, cids = value_params(store, specs)
    failing = _value_rows(store, params, store.cells(cids)).filter(_fails(t, histogram_value()))
    return (failing if store.counted else value_hashes(failing)).groupBy("cid").agg(F.sum(F.col("n") - 1).alias(f"k_{t.name}"))


# --- spelling variants ------------------------------------------------------------------------------


def _casing_rows(store: Store, specs: list[CheckSpec]) -> DataFrame:
    columns = [(store.column(s.asset, s.column).cid, s.id) for s in specs]
    targets = local_frame(store.spark, columns, "cid int, check_id string")
    return (
        of_columns(store.hist, {cid for cid, _ in columns}).join(F.broadcast(targets), "cid")
        .filter(F.col("s").isNotNull())
        .select("check_id", F.col("s").alias("value"), X.folded(F.col("s")).alias("folded"), "n")
    )


def casing_counts(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """Rows whose value has a more frequent spelling: each form's total less its largest member."""
    forms = _casing_rows(store, specs).groupBy("check_id", "folded").agg(
        F.sum("n").alias("total"), F.max("n").alias("largest")
    )
    return forms.groupBy("check_id").agg(
        F.sum("total").alias("n"), F.sum(F.col("total") - F.col("largest")).alias("k")
    )


def casing_variants(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """`(check_id, value, n)` of every spelling but the most frequent one (ties by text)."""
    rows = _casing_rows(store, specs)
    first = rows.groupBy("check_id", "folded").agg(
        F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("best"), F.count(F.lit(1)).alias("forms")
    )
    return (
        rows.join(first.filter("forms > 1"), ["check_id", "folded"])
        .filter(F.col("value") != F.col("best.value"))
        .select("check_id", "value", "n")
    )


# --- references -------------------------------------------------------------------------------------


def _keys(fk: Column, s: Column, i: Column, d: Column) -> list[Column]:
    """A key in its slot; the slots not in use are constant, so plain equality compares the one in use."""
    return [
        fk.alias("fk"),
        F.coalesce(s, F.lit("")).alias("ks"),
        F.coalesce(i, F.lit(0)).alias("ki"),
        F.coalesce(d, F.lit(0.0)).alias("kd"),
    ]


KEY = ["fk", "ks", "ki", "kd"]


def _references(store: Store, specs: list[CheckSpec]) -> tuple[DataFrame, DataFrame]:
    """Distinct child keys with their counts, and distinct parent keys, over all references at once."""
    nothing = F.lit(None)
    child_rows, inner_rows, parents = [], [], []
    for fk, s in enumerate(specs):
        child = store.column(s.asset, s.column)
        parent = store.column(s.params["parent"], s.params["parent_column"])
        # Keys compare in their own type when both sides have it, else as text.
        as_text = child.logical != parent.logical or slot_letter(child.slot) != slot_letter(parent.slot)
        child_rows.append((child.cid, fk, s.id, as_text))
        if not store.sampled[parent.asset]:
            inner_rows.append((parent.cid, fk, as_text))
            continue
        c = F.col(quote(parent.column))
        e = c.cast("string") if as_text else encode(c, parent.slot)
        letter = "s" if as_text else slot_letter(parent.slot)
        slots = [e if letter == x else nothing.cast(t) for x, t in (("s", "string"), ("i", "bigint"), ("d", "double"))]
        parents.append(store.full(parent.asset).filter(c.isNotNull()).select(*_keys(F.lit(fk), *slots)))

    v = histogram_value()
    s_, i_, d_ = (
        F.when(F.col("as_text"), v.text).otherwise(F.col("s")),
        F.when(~F.col("as_text"), F.col("i")),
        F.when(~F.col("as_text"), F.col("d")),
    )
    slots = store.meta.select("cid", "slot")
    targets = local_frame(store.spark, child_rows, "cid int, fk int, check_id string, as_text boolean").join(slots, "cid")
    children = (
        of_columns(store.hist, {r[0] for r in child_rows}).join(F.broadcast(targets), "cid")
        .filter(v.present)
        .select("check_id", v.text.alias("value"), "n", *_keys(F.col("fk"), s_, i_, d_))
    )
    # Keys read from a table are made distinct first, so that a repeated one is one row in the join.
    parents = [union_all(parents).distinct()] if parents else []
    if inner_rows:
        # A parent read in full is in the histogram already, as its distinct values.
        inner = local_frame(store.spark, inner_rows, "cid int, fk int, as_text boolean").join(slots, "cid")
        parents.append(
            of_columns(store.hist, {r[0] for r in inner_rows}).join(F.broadcast(inner), "cid").filter(v.present)
            .select(*_keys(F.col("fk"), s_, i_, d_))
        )
    return children, union_all(parents)


def reference_counts(store: Store, specs: list[CheckSpec]) -> DataFrame:
    children, parents = _references(store, specs)
    # Both sides in one grouping, which has nothing to sort, and no name of a check beside each key.
    sides = children.select(*KEY, "n", F.lit(False).alias("found")).unionByName(
        parents.select(*KEY, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("found"))
    )
    keys = sides.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("found").alias("found"))
    counts = keys.groupBy("fk").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("found"), 0).otherwise(F.col("n"))).alias("k"))
    names = local_frame(store.spark, [(fk, s.id) for fk, s in enumerate(specs)], "fk int, check_id string")
    return counts.join(F.broadcast(names), "fk").select("check_id", "n", "k")


def orphans(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """`(check_id, value, n)` of the keys without a parent."""
    children, parents = _references(store, specs)
    return children.join(parents, KEY, "left_anti").select("check_id", "value", "n")


# --- comparisons within a row -----------------------------------------------------------------------


def order_counts(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """All column pairs of a table in one aggregate."""
    frames = []
    for label in dict.fromkeys(s.asset for s in specs):
        mine = [s for s in specs if s.asset == label]
        cols = [tuple(F.col(quote(c)) for c in s.columns) for s in mine]
        out = store.read[label].agg(
            *[F.count_if(a.isNotNull() & b.isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(cols)],
            *[F.count_if(a > b).alias(f"k{i}") for i, (a, b) in enumerate(cols)],
        )
        structs = [
            F.struct(F.lit(s.id).alias("check_id"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k"))
            for i, s in enumerate(mine)
        ]
        frames.append(out.select(F.inline(F.array(*structs))))
    return union_all(frames)


def order_violations(store: Store, specs: list[CheckSpec]) -> DataFrame:
    frames = []
    for s in specs:
        a, b = (F.col(quote(c)) for c in s.columns)
        text = F.concat(a.cast("string"), F.lit(" > "), b.cast("string"))
        frames.append(
            store.read[s.asset].filter(a > b).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(s.id).alias("check_id"), "value", "n")
        )
    return union_all(frames)


# --- copies of rows and key tuples ------------------------------------------------------------------


def _with_keys(df: DataFrame, spec: CheckSpec) -> DataFrame:
    """Rows a copy check applies to: all of them, or those with every part of the key."""
    if spec.type != "unique":
        return df
    return df.filter(reduce(lambda x, y: x & y, [F.col(quote(c)).isNotNull() for c in spec.columns]))


def _row_hash(spec: CheckSpec) -> Column:
    return F.xxhash64(*[F.col(quote(c)) for c in spec.columns])


# Values of fixed width that a row of a hash count is not much narrower than.
NARROW = 3


def _is_narrow(df: DataFrame, spec: CheckSpec) -> bool:
    """Whether the values themselves may stand where their hash would."""
    fixed = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return len(spec.columns) <= NARROW and all(isinstance(df.schema[c].dataType, fixed) for c in spec.columns)


def copy_counts(store: Store, specs: list[CheckSpec], held: list[DataFrame] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows, exactly.

    A few numbers or dates are grouped as they are. Of wider rows, equal ones have equal hashes, so 8 bytes per row are
    shuffled first and whole rows only where a hash repeats; those are then grouped by their actual values, which removes
    hash collisions."""
    narrow = [s for s in specs if _is_narrow(store.read[s.asset], s)]
    wide = [s for s in specs if s not in narrow]
    frames = [_narrow_copies(store.read[s.asset], s) for s in narrow]
    return union_all(frames + ([_wide_copies(store, wide, held)] if wide else []))


def _narrow_copies(df: DataFrame, spec: CheckSpec) -> DataFrame:
    groups = _with_keys(df, spec).groupBy(*[F.col(quote(c)) for c in spec.columns]).agg(F.count(F.lit(1)).alias("m"))
    n, k = (F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("m"), F.col("m") - 1))
    return groups.agg(n.alias("n"), k.alias("k")).select(F.lit(spec.id).alias("check_id"), "n", "k")


def _wide_copies(store: Store, specs: list[CheckSpec], held: list[DataFrame] | None) -> DataFrame:
    hashes = union_all(
        [_with_keys(store.read[s.asset], s).select(F.lit(i).alias("c"), _row_hash(s).alias("h")) for i, s in enumerate(specs)]
    )
    repeated = hashes.groupBy("c", "h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    if held is not None:  # the caller releases it
        held.append(repeated.persist())
    suspects = {r.c for r in repeated.select("c").distinct().collect()}
    frames = []
    for i, s in enumerate(specs):
        rows = _with_keys(store.read[s.asset], s)
        total = rows.agg(F.count(F.lit(1)).alias("n"))
        if i not in suspects:
            frames.append(total.select(F.lit(s.id).alias("check_id"), "n", F.lit(0).cast("bigint").alias("k")))
            continue
        # (1, -) rows carry the evaluated count, (-, k) rows the failing count of each group.
        groups = _suspect_groups(rows, s, repeated.filter(F.col("c") == i).select("h"))
        extra = groups.agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("k"))
        both = total.select("n", F.lit(0).cast("bigint").alias("k")).unionByName(
            extra.select(F.lit(0).cast("bigint").alias("n"), "k")
        )
        frames.append(both.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.lit(s.id).alias("check_id"), "n", "k"))
    return union_all(frames)


def _suspect_groups(rows: DataFrame, spec: CheckSpec, hashes: DataFrame) -> DataFrame:
    rows = rows.withColumn("_h", _row_hash(spec)).join(hashes.withColumnRenamed("h", "_h"), "_h", "left_semi")
    return rows.groupBy(*[F.col(quote(c)) for c in spec.columns]).agg(F.count(F.lit(1)).alias("m"))


# --- facts of the table -----------------------------------------------------------------------------


def table_counts(store: Store, specs: list[CheckSpec], populations: dict[str, int]) -> DataFrame:
    """Empty tables (from their row counts) and the age of the newest value of the full table."""
    empty = [(s.id, 1, int(populations[s.asset] == 0)) for s in specs if s.type == "row_count"]
    frames = [local_frame(store.spark, empty, COUNTS_SCHEMA)] if empty else []
    aged = [s for s in specs if s.type == "freshness"]
    if aged:
        limit = F.col("max_age_hours") < (F.lit(age_hours(0, store.now)) - F.col("newest") / 3_600_000_000)
        frames.append(
            newest_values(store, aged).select(
                "check_id",
                F.lit(1).cast("bigint").alias("n"),
                F.coalesce(limit, F.lit(True)).cast("bigint").alias("k"),
            )
        )
    return union_all(frames)


def newest_values(store: Store, specs: list[CheckSpec]) -> DataFrame:
    """`(check_id, newest, max_age_hours)`: the newest instant of the full table, in microseconds."""
    frames = []
    for s in specs:
        age = F.lit(float(s.params["max_age_hours"])).alias("max_age_hours")
        m = store.column(s.asset, s.column)
        newest = store.full(s.asset).agg(F.max(encode(F.col(quote(s.column)), m.slot)).alias("newest"))
        frames.append(newest.select(F.lit(s.id).alias("check_id"), "newest", age))
    return union_all(frames)


# --- all of them ------------------------------------------------------------------------------------


def count_checks(
    store: Store, specs: list[CheckSpec], populations: dict[str, int], held: list[DataFrame] | None = None
) -> DataFrame:
    """`(check_id, n, k)` for every spec; zeros where a table has no rows."""
    parts = [run() for run in count_parts(store, specs, populations, held)]
    return _with_zeros(store, specs, union_all(parts))


def count_checks_now(
    store: Store, specs: list[CheckSpec], populations: dict[str, int], held: list[DataFrame] | None = None,
    known: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """The same, counted: each kind of check is a job of its own, and they run side by side; `known` checks are not counted again.

    One row per check comes back and becomes a local frame, so nothing built on it counts again."""
    def job(run: Callable[[], DataFrame]) -> Callable[[], list[Any]]:
        return lambda: run().collect()

    known = known or {}
    parts = run_together([job(run) for run in count_parts(store, [s for s in specs if s.id not in known], populations, held)])
    rows = [(check_id, *nk) for check_id, nk in known.items()] + [r for part in parts for r in part]
    return collect_small(_with_zeros(store, specs, local_frame(store.spark, rows, COUNTS_SCHEMA)))


def _with_zeros(store: Store, specs: list[CheckSpec], counted: DataFrame) -> DataFrame:
    ids = local_frame(store.spark, [(s.id,) for s in specs], "check_id string")
    return ids.join(counted, "check_id", "left").select(
        "check_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("k", F.lit(0)).cast("bigint").alias("k")
    )


def count_parts(
    store: Store, specs: list[CheckSpec], populations: dict[str, int], held: list[DataFrame] | None
) -> list[Callable[[], DataFrame]]:
    """One counting step per way of evaluation that the specs need."""
    types = check_types()
    how = lambda *kinds: [s for s in specs if types[s.type].how in kinds]
    single = [s for s in how("value", "nulls") if s.column]
    tuples = [s for s in how("value", "copies") if s.columns]
    parts = [
        (single, lambda x: value_counts(store, x)),
        (how("casing"), lambda x: casing_counts(store, x)),
        (how("parent"), lambda x: reference_counts(store, x)),
        (how("order"), lambda x: order_counts(store, x)),
        (tuples, lambda x: copy_counts(store, x, held)),
        (how("table"), lambda x: table_counts(store, x, populations)),
    ]
    return [partial(run, part) for part, run in parts if part]


def type_frame(spark: SparkSession) -> DataFrame:
    """The registry as a small table."""
    rows = [(t.name, t.title, t.level, t.how, t.phrase, t.next_step, i) for i, t in enumerate(check_types().values())]
    return local_frame(
        spark, rows, "type string, title string, level string, how string, phrase string, next_step string, type_order int"
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def check_results(counts: DataFrame, specs: DataFrame, asset_info: DataFrame, types: DataFrame) -> DataFrame:
    """Counts with population, share, interval, verdict and a sentence. One row per check.

    `asset_info`: `(asset, population, sample_rows, sampled)`."""
    rows = (
        specs.join(counts, "check_id")
        .join(F.broadcast(types), "type")
        .join(asset_info.select("asset", F.col("population").alias("table_rows"), "sample_rows", "sampled"), "asset")
        .withColumnRenamed("n", "evaluated")
        .withColumnRenamed("k", "failed")
    )
    n, k = F.col("evaluated"), F.col("failed")
    row_level = (F.col("level") == "column") | (F.size("columns") > 0)
    scaled = F.bround(n * F.col("table_rows") / F.greatest(F.col("sample_rows"), F.lit(1))).cast("bigint")
    rows = rows.withColumn(
        "population", F.when(row_level & F.col("sampled"), F.greatest(n, scaled)).otherwise(n)
    )
    p, low, high = I.check_interval(n, k, F.col("population"))
    place = F.concat_ws(".", "asset", F.coalesce(F.col("column"), F.when(F.size("columns") > 0, F.array_join("columns", ", "))))
    sentence = F.concat(
        F.format_number(k, 0), F.lit(" of "), F.format_number(n, 0), F.lit(" rows "), F.col("phrase"), F.lit(" "), place,
        F.lit(" ("), X.percentage(k, n), F.lit(")."),
    )
    return rows.select(
        "check_id", "type", "asset", "column", "columns", "params", "dimension", "severity", "kind", "status",
        "origin", "max_fail_ratio", "title", "level", "type_order", "evaluated", "failed",
        "population", p.alias("ratio"), low.alias("low"), high.alias("high"),
        ((k == 0) | (p >= 1 - F.col("max_fail_ratio") - 1e-12)).alias("passed"),
        F.col("status").isin("active", "locked").alias("scores"),
        sentence.alias("summary"), "next_step",
    )


def drop_weak_candidates(results: DataFrame) -> DataFrame:
    """Without the inferred references that fewer than 90 % of the rows follow, unless a person kept them."""
    inferred = (F.col("type") == "foreign_key") & (F.get_json_object("params", "$.inferred") == "true")
    kept = (F.col("status") == "locked") | (F.col("origin") == "manual")
    strong = (F.col("evaluated") > 0) & (F.col("ratio") >= 0.9)
    return results.filter(kept | strong | ~inferred)


def is_finding() -> Column:
    return F.col("scores") & (F.col("failed") > 0) & ~F.col("passed")


# --- failing rows -----------------------------------------------------------------------------------


def failing_rows(store: Store, spec: CheckSpec) -> DataFrame:
    """The rows of the table that fail a check, lazily; the groups that repeat for copy checks."""
    t, df = check_types()[spec.type], store.full(spec.asset)
    if t.how == "nulls":
        return df.filter(F.col(quote(spec.column)).isNull())
    if t.how == "value" and spec.column and not t.repeats:
        names = _struct_fields(t)
        given = dict(zip(names, t.typed(spec.params, store.now), strict=True))
        v = row_value(spec.column, df.schema[spec.column].dataType)
        return df.filter(v.present & t.fail(v, lambda f: _literal(given[f])))
    if t.how == "order":
        a, b = (F.col(quote(c)) for c in spec.columns)
        return df.filter(a > b)
    if t.how == "parent":
        child, parent = store.column(spec.asset, spec.column), store.column(spec.params["parent"], spec.params["parent_column"])
        as_text = child.logical != parent.logical or slot_letter(child.slot) != slot_letter(parent.slot)
        theirs = store.full(parent.asset).select(_key_of(parent, as_text).alias("_k")).filter("_k IS NOT NULL").distinct()
        rows = df.filter(F.col(quote(spec.column)).isNotNull()).withColumn("_k", _key_of(child, as_text))
        return rows.join(theirs, "_k", "left_anti").drop("_k")
    if t.how == "casing":
        # Spellings are those of the rows that are returned, which a sample need not have.
        forms = df.select(F.col(quote(spec.column)).cast("string").alias("_v")).filter("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
        forms = forms.withColumn("folded", X.folded(F.col("_v")))
        best = forms.groupBy("folded").agg(F.min(F.struct((-F.col("n")).alias("o"), "_v")).alias("best"))
        bad = forms.join(best, "folded").filter("_v <> best._v").select("_v")
        return df.join(bad, F.col(quote(spec.column)) == F.col("_v"), "left_semi")
    if t.how in ("copies", "value"):
        cols = spec.columns or (spec.column,)
        rows = _with_keys(df, spec) if spec.columns else df.filter(F.col(quote(spec.column)).isNotNull())
        return rows.groupBy(*[F.col(quote(c)) for c in cols]).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    raise ValueError(f"{spec.type} has no failing rows")


def _key_of(meta: ColumnMeta, as_text: bool) -> Column:
    """A key of a raw row as the histogram has it: in its slot, or as the text of that."""
    c = F.col(quote(meta.column))
    if not as_text:
        return encode(c, meta.slot)
    return (c.cast("double") if meta.slot == "dbl" else c).cast("string")


def _literal(value: Any) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(x) for x in value])
    return F.lit(value)


__all__ = ["Store", "check_results", "count_checks", "drop_weak_candidates", "failing_rows", "is_finding", "spec_id"]
