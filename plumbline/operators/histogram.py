"""Cells and the value histogram: the values of each column, for many tables at once.

One pass over a table turns its rows into `(column, value)` cells. What is a sum, a count or an extreme (measures,
value checks) is aggregated from cells per column where the table is read, and nothing but one row per task and column is
shuffled. What depends on how often a value occurs is counted by value with map-side combination, so a value holding a
third of all rows is one row per task before the shuffle and one row after it: by a hash of the value where only the
counts matter, by the value itself where values are shown, inferred from or joined.

A value is kept in one of three typed slots, so nothing is turned into text to be grouped:

    s  text, and decimals (their text is exact)
    i  integers, booleans (0/1), dates and timestamps (microseconds), 1 for values never compared
    d  floating point numbers

All three null means the column is null. `cid` numbers the columns of one scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.semantics import candidates_for
from ..model import NOT_SCALAR, NUMERIC, TEMPORAL, Asset, logical_type
from ..session import deal, local_frame

# Columns unpivoted in one pass; beyond this a table is read once per group of columns, so that the
# row stays narrow enough for generated code.
COLUMNS_PER_PASS = 80
TOP_TEXT = 1000  # most frequent text values kept as a result
TOP_OTHER = 25


@dataclass(frozen=True)
class ColumnMeta:
    """One column of the scan: its number, where it is, and how its values are stored."""

    cid: int
    asset: str
    column: str
    position: int
    data_type: T.DataType
    logical: str
    slot: str  # int | bool | dbl | dec | text | date | ts | opaque
    declared_not_null: bool

    @property
    def physical(self) -> str:
        return self.data_type.simpleString()


def slot_of(dt: T.DataType) -> str:
    kind = logical_type(dt)
    if kind in NOT_SCALAR:
        return "opaque"
    if isinstance(dt, T.DecimalType):
        return "int" if dt.scale == 0 and dt.precision <= 18 else "dec"
    return {"integer": "int", "decimal": "dbl", "boolean": "bool", "text": "text", "date": "date",
            "timestamp": "ts"}[kind]


def column_meta(assets: list[Asset], first_cid: int = 0) -> list[ColumnMeta]:
    """Number the columns of all tables and map their types."""
    out: list[ColumnMeta] = []
    for a in assets:
        for pos, f in enumerate(a.df.schema.fields, start=1):
            out.append(
                ColumnMeta(
                    first_cid + len(out), a.label, f.name, pos, f.dataType, logical_type(f.dataType), slot_of(f.dataType),
                    f.name in a.not_null or f.name in a.primary_key,
                )
            )
    return out


def singular_forms(name: str) -> set[str]:
    """The singulars an English plural may stand for, the name itself included."""
    n = name.lower()
    forms = {n}
    for plural, singular in (("ies", "y"), ("ses", "s"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("s", "")):
        if n.endswith(plural):
            forms.add(n[: -len(plural)] + singular)
    return forms


META_SCHEMA = (
    "cid int, asset string, column string, position int, physical_type string, logical_type string, "
    "slot string, declared_not_null boolean, declared_key boolean, declared_reference boolean, "
    "key_names array<string>, allowed_types array<string>"
)


def meta_frame(spark: SparkSession, assets: list[Asset], metas: list[ColumnMeta]) -> DataFrame:
    """Column metadata as a DataFrame; one row per column, so it is always small enough to broadcast."""
    by_label = {a.label: a for a in assets}
    rows = []
    for m in metas:
        a = by_label[m.asset]
        key = m.column in a.primary_key or (m.column,) in a.unique
        rows.append(
            (m.cid, m.asset, m.column, m.position, m.physical, m.logical, m.slot, m.declared_not_null, key,
             any(fk.column == m.column for fk in a.foreign_keys),
             sorted(f"{s}_id" for s in singular_forms(a.name)), candidates_for(m.column))
        )
    return local_frame(spark, rows, META_SCHEMA)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def encode(c: Column, slot: str) -> Column:
    """The stored form of a value: text for s, bigint for i, double for d."""
    if slot in ("int", "bool"):
        return c.cast("bigint") if slot == "int" else c.cast("int").cast("bigint")
    if slot in ("date", "ts"):
        return micros(c)
    if slot == "dbl":
        return c.cast("double")
    if slot == "opaque":
        return F.when(c.isNotNull(), F.lit(1).cast("bigint"))
    return c.cast("string")


def slot_letter(slot: str) -> str:
    return {"dbl": "d", "dec": "s", "text": "s"}.get(slot, "i")


def unpivot_columns(df: DataFrame, metas: list[ColumnMeta]) -> DataFrame:
    """Rows of `df` as `(cid, s, i, d)`, one per column; a single Expand above a single scan."""
    spark = df.sparkSession
    parts = []
    for start in range(0, len(metas), COLUMNS_PER_PASS):
        group = metas[start : start + COLUMNS_PER_PASS]
        columns = [encode(F.col(quote(m.column)), m.slot).alias(f"c{m.cid}") for m in group]
        # Only the empty slots that are used: a column left out of the UNPIVOT is handed through, and with it Spark does not
        # recognise the plan of a held histogram again on the second side of a join.
        letters = {slot_letter(m.slot) for m in group}
        kinds = (("s", "string"), ("i", "bigint"), ("d", "double"))
        empty = [F.lit(None).cast(t).alias(f"n_{x}") for x, t in kinds if letters - {x}]
        tuples = []
        for m in group:
            slots = {"s": "n_s", "i": "n_i", "d": "n_d"} | {slot_letter(m.slot): f"c{m.cid}"}
            tuples.append(f"({slots['s']}, {slots['i']}, {slots['d']}) AS `{m.cid}`")
        parts.append(
            spark.sql(
                "SELECT CAST(cid AS INT) AS cid, s, i, d FROM {src} UNPIVOT INCLUDE NULLS "
                f"((s, i, d) FOR cid IN ({', '.join(tuples)}))",
                src=df.select(*columns, *empty),
            )
        )
    return reduce(DataFrame.union, parts)


def value_cells(frames: list[tuple[DataFrame, list[ColumnMeta]]]) -> DataFrame:
    """`(cid, s, i, d, n)` with one row per cell of all given tables, `n` being 1: no shuffle."""
    rows = reduce(DataFrame.union, [unpivot_columns(df, metas) for df, metas in frames if metas])
    return rows.withColumn("n", F.lit(1).cast("bigint"))


def value_hashes(cells: DataFrame, keys: tuple[str, ...] = ("cid",)) -> DataFrame:
    """`(keys, h, g, n)`: how often each value occurs, the values being two independent 64-bit hashes.

    16 bytes a value are shuffled, however long it is. Two of a million million different values agree in both hashes
    with a probability below 1e-14."""
    present = cells.filter(histogram_value().present)
    slots = [F.col(c) for c in ("s", "i", "d")]
    return present.groupBy(*keys, F.xxhash64(*slots).alias("h"), F.xxhash64(F.lit("g"), *slots).alias("g")).agg(F.sum("n").alias("n"))


def distinct_counts(hashes: DataFrame) -> DataFrame:
    """`(cid, distinct)` from rows that each stand for one value of a column."""
    return hashes.groupBy("cid").agg(F.count(F.lit(1)).alias("distinct"))


def deal_texts(frames: list[tuple[DataFrame, list[ColumnMeta]]]) -> list[tuple[DataFrame, list[ColumnMeta]]]:
    """The same tables, those that are mostly text with their rows dealt over tasks of bounded size.

    A small piece of a file may hold or make millions of different texts, which a task would all combine in memory. Numbers
    are hardly larger in memory than in a file, and their tables stay as they are read."""
    texts = [i for i, (_, metas) in enumerate(frames) if metas and 2 * sum(m.slot == "text" for m in metas) >= len(metas)]
    if not texts:
        return frames
    counts = [frames[i][0].agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i in texts]
    rows = {r.i: r.n for r in reduce(DataFrame.union, counts).collect()}
    return [(deal(df, rows.get(i, 0) * len(metas)), metas) for i, (df, metas) in enumerate(frames)]


def build_histogram(frames: list[tuple[DataFrame, list[ColumnMeta]]]) -> DataFrame:
    """`(cid, s, i, d, n)` over all given tables: one shuffle for the whole batch."""
    rows = reduce(DataFrame.union, [unpivot_columns(df, metas) for df, metas in deal_texts(frames) if metas])
    return rows.groupBy("cid", "s", "i", "d").agg(F.count(F.lit(1)).alias("n"))


def held_histogram(hist: DataFrame) -> DataFrame:
    """The histogram persisted with the rows of a column side by side, so that a pass over some columns (`of_columns`) skips the
    batches of the others instead of unpacking every value."""
    return hist.sortWithinPartitions("cid").persist()


def of_columns(hist: DataFrame, cids: Iterable[int]) -> DataFrame:
    """The rows of some columns, by constants, which Spark compares with the bounds of held batches before it reads them."""
    return hist.filter(F.col("cid").isin(sorted(cids)))


def cids_where(meta: DataFrame, condition: Column) -> list[int]:
    """The numbers of the columns that a condition on their metadata holds for."""
    return [r.cid for r in meta.filter(condition).select("cid").collect()]


@dataclass(frozen=True)
class Value:
    """A value as the checks see it: the same predicates run on the histogram and on raw rows."""

    text: Column  # any scalar as text
    string: Column  # text columns only, else null
    number: Column  # finite numbers only, else null
    micros: Column  # dates and timestamps only, else null
    present: Column  # not null


_NUMBER = "CASE slot WHEN 'int' THEN CAST(i AS DOUBLE) WHEN 'dbl' THEN d WHEN 'dec' THEN CAST(s AS DOUBLE) END"
_TEXT = (
    "CASE slot WHEN 'text' THEN s WHEN 'dec' THEN s WHEN 'int' THEN CAST(i AS STRING) "
    "WHEN 'dbl' THEN CAST(d AS STRING) WHEN 'bool' THEN CAST(i = 1 AS STRING) "
    "WHEN 'date' THEN CAST(CAST(timestamp_micros(i) AS DATE) AS STRING) "
    "WHEN 'ts' THEN CAST(timestamp_micros(i) AS STRING) END"
)


def histogram_value() -> Value:
    """The value of a histogram row that carries `slot` (after joining the column metadata)."""
    return Value(
        text=F.expr(_TEXT),
        string=F.expr("CASE WHEN slot = 'text' THEN s END"),
        number=F.expr(f"CASE WHEN abs({_NUMBER}) < CAST('Infinity' AS DOUBLE) THEN {_NUMBER} END"),
        micros=F.expr("CASE WHEN slot IN ('date', 'ts') THEN i END"),
        present=F.expr("s IS NOT NULL OR i IS NOT NULL OR d IS NOT NULL"),
    )


def row_value(name: str, dt: T.DataType) -> Value:
    """The value of a column of a raw DataFrame."""
    c, kind = F.col(quote(name)), logical_type(dt)
    nothing = F.lit(None)
    return Value(
        text=c.cast("string") if kind not in NOT_SCALAR else nothing.cast("string"),
        string=c.cast("string") if kind == "text" else nothing.cast("string"),
        number=_finite(c.cast("double")) if kind in NUMERIC else nothing.cast("double"),
        micros=micros(c) if kind in TEMPORAL else nothing.cast("bigint"),
        present=c.isNotNull(),
    )


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)  # NaN counts as larger than infinity


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column) -> DataFrame:
    """The first `k` rows of each group in `order`, with their `rank`; never one task per group.

    Two ranked passes: groups are split by a hash of `spread` first, each part is cut to `k`, and
    only the survivors meet. A constant limit lets Spark prune before each shuffle as well."""
    parts = 32
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .drop("_r", "_part")
    )
    return cut.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def text_values(hist: DataFrame, meta: DataFrame) -> DataFrame:
    """`(cid, value, n)`: every distinct value of the text columns, from which types and shapes are inferred."""
    text = cids_where(meta, F.col("logical_type") == "text")
    return of_columns(hist, text).filter(F.col("s").isNotNull()).select("cid", F.col("s").alias("value"), "n")


def top_values(hist: DataFrame, meta: DataFrame) -> DataFrame:
    """`(cid, value, n, rank)`: the most frequent values of each scalar column, ties by text."""
    v = histogram_value()
    rows = (
        hist.join(F.broadcast(meta.select("cid", "slot")), "cid")
        .filter(v.present & (F.col("slot") != "opaque"))
        .select("cid", (F.col("slot") == "text").alias("is_text"), v.text.alias("value"), "n")
    )
    ranked = top_k(rows, ["cid"], [F.desc("n"), F.asc("value")], TOP_TEXT, F.col("value"))
    return ranked.filter(F.col("is_text") | (F.col("rank") <= TOP_OTHER)).drop("is_text")
