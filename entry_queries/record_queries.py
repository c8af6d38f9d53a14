"""Score records, alarms of locked baselines, inferred references with their evidence, populations of sampled checks; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import Asset, CheckSpec, specs_frame
from plumbline.operators import accuracy, history
from plumbline.operators.checks import new_spec
from plumbline.operators.evaluate import check_results, drop_weak_candidates, type_frame
from plumbline.plans import scan as plan
from plumbline.session import tune
from plumbline.sources.sampling import row_counts

from .oracle import INFERRED_ROLES, count_if, dimensions_sql, scan_sql, shape, sql_with
from .queries import counts_of, faulty_scan, finished, narrowed
from .views import NOW, table


def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a scan's scores: the store and each table, one row per dimension."""
    rows = history.score_records(faulty_scan(spark, sf_dir).scores, "first", NOW)
    return rows.select("scan_id", "asset", "overall", "low", "high", "checks", F.explode("dimensions").alias("dimension", "d")).select(
        "scan_id", "asset", "overall", "low", "high", "checks", "dimension", F.col("d.value").alias("dimension_value"), F.col("d.checks").alias("dimension_checks")
    )


def baseline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every baseline of the clean twins, locked, on the faulty tables: scoring checks and findings per type."""
    options = plan.ScanOptions(sample_rows=0, now=NOW, examples=False)
    named = lambda kind: [Asset(n, table(spark, sf_dir, f"{kind}_{n}"), primary_key=("id",)) for n in ("customers", "orders")]
    first = plan.profile_assets(tune(spark), named("clean"), options)
    _, specs, _ = plan.plan_checks(first)
    first.release()
    results = finished(plan.run_scan(spark, named("dirty"), options, saved=accuracy.locked_baselines(specs))).results
    return accuracy.baseline_alarms(results).filter("baseline_checks > 0")


# Candidate references: child, column, parent, key, status, origin. The last two are kept without evidence.
CANDIDATES = (
    ("dirty_orders", "customer_id", "dirty_customers", "id", "active", "generated"),
    ("lineitem", "l_partkey", "part", "p_partkey", "active", "generated"),
    ("lineitem", "l_orderkey", "supplier", "s_suppkey", "active", "generated"),
    ("orders", "o_custkey", "part", "p_partkey", "active", "generated"),
    ("events", "user_id", "supplier", "s_suppkey", "locked", "generated"),
    ("labels", "doc_id", "customer", "c_custkey", "active", "manual"),
)


def inferred_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that at least 90 % of the rows follow, and those a person locked or wrote."""
    columns: dict[str, tuple[str, ...]] = {}
    for child, c, parent, p, _, _ in CANDIDATES:
        for t, name in ((child, c), (parent, p)):
            columns[t] = tuple(dict.fromkeys((*columns.get(t, ()), name)))
    st = narrowed(spark, sf_dir, columns)
    specs = [
        new_spec("foreign_key", child, c, params={"parent": parent, "parent_column": p, "inferred": True}, status=status, origin=origin)
        for child, c, parent, p, status, origin in CANDIDATES
    ]
    counts = counts_of(st, specs)
    info = asset_info(spark, row_counts([st.assets[t] for t in dict.fromkeys(s.asset for s in specs)]))
    kept = drop_weak_candidates(check_results(counts, specs_frame(spark, specs), info, type_frame(spark)))
    return kept.select("check_id", "evaluated", "failed", F.round("ratio", 9).alias("ratio"))


def asset_info(spark: SparkSession, rows: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(t, n, n, False) for t, n in rows.items()], "asset string, population bigint, sample_rows bigint, sampled boolean")


LATE = 1000


def sample_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check per order status, as if the orders of a status were the sample read of all orders."""
    df = table(spark, sf_dir, "dirty_orders")
    groups = df.groupBy(F.coalesce("status", F.lit("")).alias("asset")).agg(
        F.count(F.lit(1)).alias("sample_rows"), F.count("customer_id").alias("n"), F.count_if(F.col("customer_id") > LATE).alias("k"))
    rows = groups.collect()  # one per status
    specs: list[CheckSpec] = [new_spec("range", r.asset, "customer_id", params={"min": 0.0, "max": float(LATE)}) for r in rows]
    total = sum(r.sample_rows for r in rows)
    counts = spark.createDataFrame([(s.id, r.n, r.k) for s, r in zip(specs, rows)], "check_id string, n bigint, k bigint")
    info = spark.createDataFrame([(r.asset, total, r.sample_rows, True) for r in rows], "asset string, population bigint, sample_rows bigint, sampled boolean")
    out = check_results(counts, specs_frame(spark, specs), info, type_frame(spark))
    return out.select("check_id", "evaluated", "failed", "population", *[F.round(c, 9).alias(c) for c in ("ratio", "low", "high")])


RECORD_QUERIES = {
    "score_records": score_records, "baseline_findings": baseline_findings, "inferred_references": inferred_references,
    "sample_populations": sample_populations,
}


def _records_sql() -> str:
    body = """SELECT 'first' AS scan_id, s.asset, round(100 * o.v, 1) AS overall, round(100 * o.v, 1) AS low, round(100 * o.v, 1) AS high, o.checks,
 s.dimension, round(100 * s.v, 1) AS dimension_value, CAST(s.checks AS BIGINT) AS dimension_checks FROM scored s
 JOIN (SELECT asset, avg(v) AS v, CAST(sum(checks) AS BIGINT) AS checks FROM scored GROUP BY asset) o ON s.asset IS NOT DISTINCT FROM o.asset"""
    scored = ", scored AS (SELECT asset, dimension, v, checks FROM tabs UNION ALL SELECT CAST(NULL AS VARCHAR), dimension, v, checks FROM stor) "
    sql = scan_sql(body, roles=INFERRED_ROLES)
    i = sql.rindex(body)
    return sql[:i].rstrip() + dimensions_sql(INFERRED_ROLES) + scored + body


def _baselines_sql() -> str:
    c, o = ("clean_customers", "dirty_customers"), ("clean_orders", "dirty_orders")
    def outside(x: str, clean: str) -> str:
        return f"{x} < (SELECT min({x}) FROM {clean}) OR {x} > (SELECT max({x}) FROM {clean})"

    rows = [("length", c, outside(f"length({x})", c[0])) for x in ("name", "email", "iban", "city", "country", "vat_id", "total")]
    rows += [("length", o, outside("length(status)", o[0]))]
    # Shapes are the three most frequent ones of the clean column.
    usual = lambda x, clean: f"(SELECT s FROM (SELECT {shape(x)} AS s, count(*) AS m FROM {clean} WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY m DESC, s LIMIT 3))"
    rows += [("pattern", t, f"{shape(x)} NOT IN {usual(x, t[0])}") for t, x in ((c, "name"), (c, "city"), (c, "total"), (o, "status"))]
    rows += [("accepted_values", t, f"{x} NOT IN (SELECT {x} FROM {t[0]} WHERE {x} IS NOT NULL)") for t, x in ((c, "city"), (c, "country"), (o, "status"))]
    rows += [("range", o, outside(x, o[0])) for x in ("amount", "ordered_at", "shipped_at")]
    parts = [f"SELECT '{kind}' AS type, {count_if(p)} AS k FROM {t[1]}" for kind, t, p in rows]
    body = f"SELECT type, count(*) AS baseline_checks, {count_if('k > 0')} AS baseline_findings FROM ({' UNION ALL '.join(parts)}) GROUP BY type"
    return sql_with((*c, *o), body)


def _candidates_sql() -> str:
    parts = [
        f"SELECT 'foreign_key:{child}:{c}' AS check_id, {str(status == 'locked' or origin == 'manual').lower()} AS always, count(*) AS evaluated, "
        f"{count_if('q.k IS NULL')} AS failed FROM {child} x LEFT JOIN (SELECT DISTINCT {p} AS k FROM {parent}) q ON x.{c} = q.k WHERE x.{c} IS NOT NULL"
        for child, c, parent, p, status, origin in CANDIDATES
    ]
    return sql_with(("dirty_orders", "dirty_customers"), f"""SELECT check_id, evaluated, failed, round(CAST(evaluated - failed AS DOUBLE) / evaluated, 9) AS ratio
 FROM ({' UNION ALL '.join(parts)}) WHERE always OR CAST(evaluated - failed AS DOUBLE) / evaluated >= 0.9""")


def _populations_sql() -> str:
    return sql_with(("dirty_orders",), f"""SELECT 'range:' || s || ':customer_id' AS check_id, n AS evaluated, k AS failed, pop AS population, round(p, 9) AS ratio,
 round(CASE WHEN n <= 1 OR pop <= n THEN p ELSE greatest(0.0, centre - half) END, 9) AS low, round(CASE WHEN n <= 1 OR pop <= n THEN p ELSE least(1.0, centre + half) END, 9) AS high FROM (
  SELECT *, (p + z * z / (2 * e)) / (1 + z * z / e) AS centre, z * sqrt(p * (1 - p) / e + z * z / (4 * e * e)) / (1 + z * z / e) AS half FROM (
   SELECT *, CAST(n AS DOUBLE) * (pop - 1) / nullif(pop - n, 0) AS e, CAST(n - k AS DOUBLE) / n AS p, 1.959964 AS z FROM (
    SELECT s, n, k, greatest(n, CAST(round_even(n * total / rows, 0) AS BIGINT)) AS pop FROM (
     SELECT coalesce(status, '') AS s, count(*) AS rows, count(customer_id) AS n, {count_if(f'customer_id > {LATE}')} AS k, any_value(t.total) AS total
     FROM dirty_orders, (SELECT count(*) AS total FROM dirty_orders) t GROUP BY 1))))""")


RECORD_ORACLE = {
    "score_records": _records_sql(), "baseline_findings": _baselines_sql(), "inferred_references": _candidates_sql(), "sample_populations": _populations_sql(),
}
