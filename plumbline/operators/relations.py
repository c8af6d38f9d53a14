"""Rules between columns and tables: balances, functional dependencies, overlapping columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, deal


def aggregate_balance(child: DataFrame, foreign_key: str, amount: str, parent: DataFrame, key: str, total: str, tolerance: str = "0.01", scale: int = 4) -> DataFrame:
    """key, child_total, parent_total, difference, state: every key of either side, the child's sum against the parent's total.

    State: `balanced` (the difference is at most `tolerance`), `differs`, `no_parent` (child rows without a parent) or `no_child` (a
    parent without child rows, whose sum is 0; balanced if its total is within the tolerance of 0). Amounts are rounded to
    `scale` decimals and summed as decimals, so the order of addition changes nothing. Null amounts add nothing, a null total is
    0, child rows with a null key are left out; a parent key that stands twice is summed.

    Children are summed before the join, so it moves one row per key, whatever the number of children.
    """
    kind = f"decimal(30,{scale})"
    sums = child.where(F.col(foreign_key).isNotNull()).groupBy(F.col(foreign_key).alias("key")).agg(F.sum(F.round(amount, scale).cast(kind)).alias("child_sum"))
    totals = parent.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.coalesce(F.sum(F.round(total, scale).cast(kind)), F.lit(0)).cast(kind).alias("parent_sum"), F.lit(True).alias("there"))
    both = sums.withColumn("has_child", F.lit(True)).join(totals, "key", "full_outer")
    as_is = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(f"decimal(34,{scale})")
    difference = as_is("child_sum") - as_is("parent_sum")
    near = F.abs(difference) <= F.lit(tolerance).cast(f"decimal(34,{scale})")
    state = F.when(F.col("there").isNull(), "no_parent").when(near, "balanced").when(F.col("has_child").isNull(), "no_child").otherwise("differs")
    return both.select("key", F.col("child_sum").cast("double").alias("child_total"), F.col("parent_sum").cast("double").alias("parent_total"), difference.cast("double").alias("difference"), state.alias("state"))


def functional_dependencies(df: DataFrame, columns: list[str], error: float = 0.05, width: int = 2, distinct_ratio: float = 0.9) -> DataFrame:
    """determinant, dependent, rows, error, gain: the dependencies that hold but for a share `error` of the rows, always proposals.

    The g3 error of X -> Y is the smallest share of rows to be left out for X to decide Y. `gain` is how much of the error of the
    best constant guess of Y it removes, the rank of a proposal: a dependency on a column that hardly varies is worth nothing and is
    not returned. Determinants have at most `width` columns, joined by `, ` in the order of `columns`. Only minimal ones are
    returned, and none whose distinct values are more than `distinct_ratio` of the rows: a key decides everything. Nulls are a value.

    The lattice of determinants is gone through level by level. A determinant that decides Y, is a key, or contains one that does,
    is not counted again, so a level holds what is left. Each level is one job: rows are counted by (determinant, dependent)
    values with map-side combination, then the most frequent dependent of each determinant value is kept. Values are two independent
    64-bit hashes, 16 bytes however long they are, and rows are dealt so that no task counts more than `CELLS_PER_TASK` of them.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    values = df.select(*[h.alias(f"{name}{i}") for i, t in enumerate(texts) for name, h in (("h", F.xxhash64(t)), ("g", F.xxhash64(F.lit("g"), t)))])
    n = df.count()
    schema = "determinant string, dependent string, rows long, error double, gain double"
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)
    # The empty determinant: what a constant guess gets wrong.
    guess = {c: 1 - top / n for c, (top, _) in _tops(values, n, [((), y) for y in range(len(columns))]).items()}
    constant = {y: guess[((), y)] for y in range(len(columns))}
    decided: dict[int, list[frozenset]] = {y: [] for y in constant}
    keys: list[frozenset] = []
    found = []
    for size in range(1, width + 1):
        level = [
            (x, y) for x in combinations(range(len(columns)), size) for y in constant
            if y not in x and constant[y] > 0 and not any(k <= set(x) for k in keys) and not any(d <= set(x) for d in decided[y])
        ]
        for (x, y), (top, distinct) in _tops(values, n, level).items():
            if distinct > distinct_ratio * n:
                keys.append(frozenset(x))
            elif 1 - top / n <= error:
                decided[y].append(frozenset(x))
                found.append((", ".join(columns[i] for i in x), columns[y], n, 1 - top / n, 1 - (1 - top / n) / constant[y]))
    found = [f for f in found if f[4] > 0]
    return df.sparkSession.createDataFrame(sorted(found, key=lambda f: (-f[4], f[0], f[1])), schema)


def _tops(values: DataFrame, n: int, candidates: list[tuple[tuple[int, ...], int]]) -> dict[tuple[tuple[int, ...], int], tuple[int, int]]:
    """For each (determinant, dependent): rows that agree with the most frequent dependent of their determinant value, and the
    number of determinant values."""
    if not candidates:
        return {}
    used = {j for x, y in candidates for j in (*x, y)}
    rows = deal(values.select(*[f"{name}{j}" for j in sorted(used) for name in "hg"]), n * len(candidates))
    both = lambda *js: [F.xxhash64(F.lit(len(js)), *[F.col(f"{name}{j}") for j in js]) for name in "hg"]
    entries = []
    for i, (x, y) in enumerate(candidates):
        h, g = both(*x)
        entries.append(F.struct(F.lit(i).alias("c"), h.alias("h"), g.alias("g"), F.col(f"h{y}").alias("yh"), F.col(f"g{y}").alias("yg")))
    counted = rows.select(F.inline(F.array(*entries))).groupBy("c", "h", "g", "yh", "yg").agg(F.count("*").alias("n"))
    best = counted.groupBy("c", "h", "g").agg(F.max("n").alias("n")).groupBy("c").agg(F.sum("n").alias("top"), F.count("*").alias("distinct"))
    return {candidates[r.c]: (r.top, r["distinct"]) for r in best.collect()}


def overlapping_columns(tables: dict[str, DataFrame], columns: dict[str, list[str]], containment: float = 0.9, sketch: int = 1024, slack: float = 0.3) -> DataFrame:
    """left_table, left_column, right_table, right_column, left_values, right_values, shared, containment, jaccard.

    Pairs of columns of different tables of which the left one's distinct values lie to at least `containment` in the right one, all exact
    counts. Values are compared as text, nulls left out; a column without values is in no pair.

    Every column's distinct values are hashed and the `sketch` smallest hashes kept; sketches merge by keeping the smallest again,
    and are all that columns are compared by at first. Below the larger of the two sketches' greatest hashes the smaller column
    is known whole or by a sample of its smallest hashes, whose share in the other is the estimate. Pairs whose estimate is
    `slack` below `containment` or better are counted exactly by one join of the values of the columns that are left.
    """
    spark = next(iter(tables.values())).sparkSession
    names = [(t, c) for t, cs in columns.items() for c in cs]
    number = {name: i for i, name in enumerate(names)}
    values = None
    for t, cs in columns.items():
        part = tables[t].select(F.explode(F.array(*[F.struct(F.lit(number[t, c]).alias("col"), F.col(c).cast("string").alias("value")) for c in cs])).alias("e")).select("e.col", "e.value")
        values = part if values is None else values.unionByName(part)
    values = cut_lineage(values.where("value is not null").distinct().withColumn("h", F.xxhash64("value")))
    sizes = {r.col: r.n for r in values.groupBy("col").agg(F.count("*").alias("n")).collect()}
    small = values.withColumn("r", F.row_number().over(Window.partitionBy("col", F.pmod("h", F.lit(64))).orderBy("h"))).where(F.col("r") <= sketch)
    small = small.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy("h"))).where(F.col("r") <= sketch)
    sketches: dict[int, set[int]] = {}
    for r in small.select("col", "h").collect():
        sketches.setdefault(r.col, set()).add(r.h)
    likely = []
    for a in sketches:
        for b in sketches:
            if names[a][0] == names[b][0]:
                continue
            # Up to `top` all hashes of b are known; what a has there is a sample of its values by hash.
            top = max(sketches[b]) if sizes[b] > sketch else max(sketches[a])
            known = [h for h in sketches[a] if h <= top]
            # A sample too small to judge by is left to the exact count.
            if len(known) < 32 or len(sketches[b].intersection(known)) / len(known) >= containment - slack:
                likely.append((a, b))
    schema = "left_table string, left_column string, right_table string, right_column string, left_values long, right_values long, shared long, containment double, jaccard double"
    if not likely:
        return spark.createDataFrame([], schema)
    left = values.select("col", "value").where(F.col("col").isin([a for a, _ in likely]))
    right = values.select(F.col("col").alias("other"), "value").where(F.col("other").isin([b for _, b in likely]))
    wanted = spark.createDataFrame(likely, "col int, other int")
    shared = left.join(right, "value").join(F.broadcast(wanted), ["col", "other"]).groupBy("col", "other").agg(F.count("*").alias("shared"))
    out = []
    for r in shared.collect():
        a, b = sizes[r.col], sizes[r.other]
        if r.shared >= containment * a:
            out.append((*names[r.col], *names[r.other], a, b, r.shared, r.shared / a, r.shared / (a + b - r.shared)))
    return spark.createDataFrame(sorted(out), schema)
