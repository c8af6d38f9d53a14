"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import semantics as S
from plumbline.functions import text as X
from plumbline.model import Asset, CheckSpec, specs_frame
from plumbline.operators import accuracy, examples, findings, history, lifecycle, profile, score
from plumbline.operators.checks import new_spec
from plumbline.operators.evaluate import Store, check_results, count_checks, failing_rows, orphans, type_frame
from plumbline.operators.health import health_items
from plumbline.operators.histogram import distinct_counts, text_values, top_values, value_hashes
from plumbline.operators.quantiles import quantiles
from plumbline.plans import scan as plan
from plumbline.session import collect_small, local_frame, tune
from plumbline.sources.sampling import row_counts

from .views import NOW, TABLES, all_assets, asset, table

Query = Callable[[SparkSession, str], DataFrame]
FULL = plan.ScanOptions(sample_rows=0, now=NOW)

# The columns the profile queries read.
NUMERIC = {
    "lineitem": ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"),
    "orders": ("o_custkey", "o_totalprice"), "customer": ("c_acctbal",), "part": ("p_size", "p_retailprice"),
    "events": ("user_id", "value"), "documents": ("n_chars",), "dirty_orders": ("customer_id", "amount"),
}
TEXT = {
    "dirty_customers": ("name", "email", "iban", "city", "country", "vat_id", "total"), "dirty_orders": ("status",),
    "documents": ("text", "lang", "source"), "pages": ("url", "html"), "conversations": ("role", "text"),
    "events": ("event_type", "props"),
}
TIME = {"orders": ("o_orderdate",), "lineitem": ("l_shipdate",), "events": ("ts",), "dirty_orders": ("ordered_at", "shipped_at")}
MAD = {"lineitem": ("l_quantity", "l_extendedprice"), "events": ("value",), "documents": ("n_chars",), "dirty_orders": ("amount",)}
TOP = {"customer": ("c_mktsegment",), "part": ("p_brand", "p_name", "p_size"), "events": ("event_type", "user_id"), "dirty_customers": ("city", "email")}
PATTERN = {"customer": ("c_name",), "part": ("p_brand", "p_name"), "dirty_customers": ("email", "city", "vat_id", "total"), "pages": ("url",)}


def make_store(assets: list[Asset]) -> Store:
    """Tables ready for evaluation, read in full, without profiling them first."""
    spark = tune(assets[0].df.sparkSession)
    read = {a.label: a.df for a in assets}
    hist, meta, metas = plan.histogram_of(spark, assets, read)
    return Store(spark, {a.label: a for a in assets}, read, dict.fromkeys(read, False), hist, meta, metas, NOW)


def basic_of(st: Store) -> DataFrame:
    """The measures of every column: from cells, distinct values by their hashes."""
    cells = st.cells({m.cid for m in st.metas})
    return profile.basic_measures(cells, distinct_counts(value_hashes(cells)), st.meta, NOW)


def narrowed(spark: SparkSession, sf_dir: str, columns: dict[str, tuple[str, ...]]) -> Store:
    return make_store([asset(spark, sf_dir, t, c, declared=False) for t, c in columns.items()])


def with_names(df: DataFrame, meta: DataFrame, *columns: str) -> DataFrame:
    return df.join(F.broadcast(meta.select("cid", "asset", "column")), "cid").select("asset", "column", *columns)


# --- profiles ---------------------------------------------------------------------------------------


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, NUMERIC)
    basic, q, spread = number_measures(st)
    rows = basic.join(q, "cid").join(spread, "cid")
    r = lambda c, d=6: F.round(c, d)
    return with_names(
        rows.select(
            "cid", "rows", "nulls", "distinct", F.col("min_number").alias("min"), F.col("max_number").alias("max"),
            r(F.col("mean"), 4).alias("mean"), r(F.col("stddev"), 4).alias("stddev"),
            *[r(F.col("q")[i], 4).alias(n) for i, n in enumerate(profile.QUANTILE_NAMES)], "zeros", "negatives",
        ),
        st.meta, "rows", "nulls", "distinct", "min", "max", "mean", "stddev", *profile.QUANTILE_NAMES, "zeros", "negatives",
    )


def number_measures(st: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Basic measures, quantiles and spread of every column, as local frames of one row per column.

    Values are counted once and held while the three passes over them run; each pass needs results of the one before."""
    held = [st.hist.persist()]
    try:
        basic = collect_small(profile.basic_measures(st.hist, None, st.meta, NOW))
        large = profile.large_columns(basic.collect())
        q = collect_small(quantiles(profile.number_values(st.hist, st.meta), profile.QUANTILES, large, held, profile.number_ranges(basic)))
        centres = basic.select("cid", "mean", "min_number", "max_number").join(q.select("cid", F.col("q")[2].alias("p50")), "cid")
        return basic, q, collect_small(profile.spread_measures(st.hist, st.meta, centres, large, held))
    finally:
        for df in held:
            df.unpersist()


def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, TEXT)
    rows = basic_of(st).withColumn("mean_length", F.round("mean_length", 4))
    return with_names(rows, st.meta, "rows", "nulls", "distinct", "min_length", "max_length", "mean_length", "whitespace",
                      "non_printing", "blanks", "numeric_like", "date_like", "leading_zero_numbers")


def profile_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, TIME)
    return with_names(basic_of(st), st.meta, "rows", "nulls", "distinct", "min_us", "max_us",
                      "future", "before_1900", "after_2200")


def profile_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, MAD)
    return with_names(mad_of(st).withColumn("mad", F.round("mad", 4)).withColumn("median", F.round("median", 4)), st.meta, "median", "mad")


def mad_of(st: Store) -> DataFrame:
    """`(cid, median, mad)`; columns too large for one task take the range-sorted way. Values are counted once and held meanwhile."""
    held = [st.hist.persist()]
    try:
        values = profile.number_values(st.hist, st.meta)
        large = profile.large_columns(values.groupBy("cid").agg(F.count(F.lit(1)).alias("distinct")).collect())
        centre = collect_small(quantiles(values, (0.5,), large, held).select("cid", F.col("q")[0].alias("median")))
        dev = values.join(F.broadcast(centre), "cid").select("cid", F.abs(F.col("x") - F.col("median")).alias("x"), "n")
        return collect_small(centre.join(quantiles(dev, (0.5,), large, held).select("cid", F.col("q")[0].alias("mad")), "cid"))
    finally:
        for df in held:
            df.unpersist()


def sorted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range-sorted way for every column, whatever its size."""
    st = narrowed(spark, sf_dir, NUMERIC)
    q = quantiles(profile.number_values(st.hist, st.meta), profile.QUANTILES, [m.cid for m in st.metas])
    rows = q.select("cid", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(profile.QUANTILE_NAMES)])
    return with_names(rows, st.meta, *profile.QUANTILE_NAMES)


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, {k: TEXT[k] for k in ("dirty_customers", "dirty_orders", "documents", "events")})
    rows = st.hist.filter(F.col("s").isNotNull()).select("cid", F.col("s").alias("value"), "n")
    return with_names(rows, st.meta, "value", "n")


def top_values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, TOP)
    rows = top_values(st.hist, st.meta).filter(F.col("rank") <= profile.SHOWN_TOP)
    return with_names(rows.withColumn("rank", F.col("rank").cast("bigint")), st.meta, "value", "n", "rank")


def pattern_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, PATTERN)
    rows = profile.patterns(text_values(st.hist, st.meta))
    return with_names(rows.withColumn("rank", F.col("rank").cast("bigint")), st.meta, "pattern", "n", "rank")


def infer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all tables with their declarations, and of the undeclared ones once more by name alone."""
    named = [asset(spark, sf_dir, t) for t in (*TABLES, "dirty_customers", "dirty_orders")]
    plain = [Asset(t, table(spark, sf_dir, t), namespace="plain") for t in ("events", "pages", "documents", "conversations")]
    st = make_store(named + plain)
    basic = basic_of(st)
    return st.meta.join(basic, "cid").select("asset", "column", profile.role_expr().alias("role"))


def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, {"dirty_customers": TEXT["dirty_customers"], "pages": ("url",), "part": ("p_brand",),
                                  "contacts": ("phone", "currency", "postcode", "country", "token")})
    rows = profile.semantic_measures(text_values(st.hist, st.meta), st.meta).filter("semantic_type IS NOT NULL")
    return with_names(rows.withColumn("semantic_share", F.round("semantic_share", 6)), st.meta, "semantic_type", "semantic_share")


VALIDATED = (
    ("email", "dirty_customers", "email"), ("iban", "dirty_customers", "iban"), ("eu_vat", "dirty_customers", "vat_id"),
    ("iso_country", "dirty_customers", "country"), ("iso_country", "contacts", "country"), ("url", "pages", "url"),
    ("phone_e164", "contacts", "phone"), ("iso_currency", "contacts", "currency"), ("postcode_de", "contacts", "postcode"),
    ("uuid", "contacts", "token"),
)


def semantic_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid rows per validator, counted over distinct values."""
    columns: dict[str, tuple[str, ...]] = {}
    for _, t, c in VALIDATED:
        columns[t] = (*columns.get(t, ()), c)
    st = narrowed(spark, sf_dir, columns)
    kinds = local_frame(spark, [(st.column(t, c).cid, kind) for kind, t, c in VALIDATED], "cid int, validator string")
    rows = st.hist.filter(F.col("s").isNotNull()).join(F.broadcast(kinds), "cid")
    valid = S.valid_as(F.col("s"), F.col("validator"))
    counts = rows.groupBy("cid", "validator").agg(profile.counted(valid).alias("valid"), profile.counted(~valid).alias("invalid"))
    return with_names(counts, st.meta, "validator", "valid", "invalid")


def mask_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "dirty_customers")
    return df.select("id", X.mask(F.col("email")).alias("email"), X.mask(F.col("iban")).alias("iban"), X.mask(F.col("vat_id")).alias("vat_id"),
                     X.mask(F.col("city")).alias("city"))


def time_series_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = plan.profile_assets(tune(spark), [asset(spark, sf_dir, t) for t in ("orders", "lineitem", "events", "customer", "part")], FULL)
    profiled.release()
    return plan.asset_frame(profiled, FULL).select("asset", "population", "columns", "time_series_candidate")


# --- checks -----------------------------------------------------------------------------------------


def specs_for(check: str, columns: dict[str, tuple[str, ...]], **kw: object) -> list[CheckSpec]:
    return [new_spec(check, t, c, **kw) for t, cols in columns.items() for c in cols]


def counts_of(st: Store, specs: list[CheckSpec]) -> DataFrame:
    populations = row_counts([st.assets[t] for t in {s.asset for s in specs if s.type == "row_count"}]) if any(
        s.type == "row_count" for s in specs) else {}
    return count_checks(st, specs, populations)


def value_check(check: str, columns: dict[str, tuple[str, ...]], params: dict[tuple[str, str], dict] | None = None) -> Query:
    """A check on the values of some columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        st = narrowed(spark, sf_dir, columns)
        specs = [new_spec(check, t, c, params=(params or {}).get((t, c), {})) for t, cols in columns.items() for c in cols]
        return counts_of(st, specs)

    return run


NULLS = {"dirty_customers": ("id", "name", "email", "city"), "dirty_orders": ("id", "customer_id", "amount", "ordered_at"),
         "lineitem": ("l_orderkey", "l_shipdate"), "embeddings": ("embedding",), "documents": ("text",)}
CONFORM = {("dirty_customers", "total"): {"expected": "number", "majority": 0.99}, ("contacts", "postcode"): {"expected": "number", "majority": 1.0},
           ("order_notes", "customer_id"): {"expected": "date", "majority": 0.0}}
SEMANTIC = {("dirty_customers", "email"): {"semantic_type": "email"}, ("dirty_customers", "iban"): {"semantic_type": "iban"},
            ("dirty_customers", "vat_id"): {"semantic_type": "eu_vat"}, ("dirty_customers", "country"): {"semantic_type": "iso_country"},
            ("pages", "url"): {"semantic_type": "url"}}
SHAPES = {("dirty_customers", "total"): {"patterns": ["9", "99", "999"]}, ("dirty_customers", "vat_id"): {"patterns": ["AA9{5+}"]},
          ("part", "p_brand"): {"patterns": ["A{5+}#9"]}, ("customer", "c_name"): {"patterns": ["A{5+}#9{5+}"]}}
ACCEPTED = {("dirty_customers", "city"): {"values": ["Berlin", "Hamburg", "Wien"]}, ("dirty_orders", "status"): {"values": ["F", "O"]},
            ("part", "p_size"): {"values": [str(i) for i in range(1, 21)]}, ("events", "event_type"): {"values": ["click", "view"]}}
LENGTHS = {("dirty_customers", "email"): {"min": 5, "max": 20}, ("dirty_customers", "city"): {"min": 4, "max": 7},
           ("documents", "text"): {"min": 10, "max": 20000}, ("conversations", "text"): {"min": 1, "max": 200}}
RANGES = {("dirty_orders", "amount"): {"min": 1000.0, "max": 400000.0},
          ("dirty_orders", "ordered_at"): {"min": "1995-01-01T00:00:00", "max": "2001-12-31T12:00:00"},
          ("lineitem", "l_quantity"): {"min": 2.0, "max": 49.0}, ("part", "p_size"): {"min": 5.0, "max": 45.0}}


def _columns(keys: dict[tuple[str, str], dict]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for t, c in keys:
        out[t] = (*out.get(t, ()), c)
    return out


def check_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = [asset(spark, sf_dir, t) for t in (*TABLES, "no_returns")]
    return counts_of(make_store(assets), [new_spec("row_count", a.label) for a in assets])


def check_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the data itself: one row per column comes back from the first pass."""
    st = narrowed(spark, sf_dir, MAD)
    name = {m.cid: m for m in st.metas}
    rows = [r for r in mad_of(st).collect() if r.mad]
    return counts_of(
        st, [new_spec("outliers", name[r.cid].asset, name[r.cid].column, params={"median": r.median, "mad": r.mad, "z": 6.0}) for r in rows]
    )


FK = (("dirty_orders", "customer_id", "dirty_customers", "id"), ("order_notes", "customer_id", "dirty_customers", "id"),
      ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
      ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"))


def fk_store(spark: SparkSession, sf_dir: str, links: tuple[tuple[str, str, str, str], ...] = FK) -> tuple[Store, list[CheckSpec]]:
    columns: dict[str, tuple[str, ...]] = {}
    for child, c, parent, p in links:
        columns[child] = tuple(dict.fromkeys((*columns.get(child, ()), c)))
        columns[parent] = tuple(dict.fromkeys((*columns.get(parent, ()), p)))
    specs = [new_spec("foreign_key", child, c, params={"parent": parent, "parent_column": p}) for child, c, parent, p in links]
    return narrowed(spark, sf_dir, columns), specs


def check_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_of(*fk_store(spark, sf_dir))


def orphan_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent orphan values of each reference."""
    st, specs = fk_store(spark, sf_dir, FK[:2])
    from plumbline.operators.histogram import top_k

    rows = top_k(orphans(st, specs), ["check_id"], [F.desc("n"), F.asc("value")], 5, F.col("value"))
    return rows.select("check_id", "value", "n", F.col("rank").cast("bigint").alias("rank"))


def check_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, {"dirty_orders": ("ordered_at", "shipped_at")})
    return counts_of(st, [new_spec("column_order", "dirty_orders", columns=("ordered_at", "shipped_at"))])


def check_casing_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"dirty_customers": ("city", "name"), "contacts": ("currency",), "documents": ("lang", "source")}
    return counts_of(narrowed(spark, sf_dir, cols), specs_for("casing_variants", cols))


def check_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"dirty_orders": ("id", "customer_id", "amount", "status", "ordered_at", "shipped_at"), "dirty_customers": ("city", "country"),
            "documents": ("text", "lang"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")}
    st = narrowed(spark, sf_dir, cols)
    return counts_of(st, [new_spec("duplicate_rows", t, columns=c) for t, c in cols.items()])


COMPOSITE = {"lineitem": ("l_orderkey", "l_linenumber"), "conversations": ("conv_id", "turn"), "dirty_orders": ("customer_id", "ordered_at")}


def check_composite_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, COMPOSITE)
    return counts_of(st, [new_spec("unique", t, columns=c) for t, c in COMPOSITE.items()])


FRESH = {("dirty_orders", "ordered_at"): 24, ("events", "ts"): 24 * 365, ("orders", "o_orderdate"): 24 * 365 * 30}


def check_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = narrowed(spark, sf_dir, _columns(dict.fromkeys(FRESH, {})))
    return counts_of(st, [new_spec("freshness", t, c, params={"max_age_hours": h}) for (t, c), h in FRESH.items()])


# --- one scan of the faulty tables ------------------------------------------------------------------


def faulty_scan(spark: SparkSession, sf_dir: str, evidence: bool = False) -> plan.Scan:
    """Everything generated from the profiles of the two faulty tables."""
    assets = [asset(spark, sf_dir, t) for t in ("dirty_customers", "dirty_orders")]
    options = plan.ScanOptions(sample_rows=0, now=NOW, examples=evidence)
    return finished(plan.run_scan(tune(spark), assets, options))


def finished(scan: plan.Scan) -> plan.Scan:
    """The result frames are local by now; what the scan cached can go."""
    scan.release()
    return scan


def check_results_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = faulty_scan(spark, sf_dir).results.filter("scores")
    return r.select("check_id", "evaluated", "failed", "population", F.round("ratio", 9).alias("ratio"), F.round("low", 9).alias("low"),
                    F.round("high", 9).alias("high"), "passed", X.percentage(F.col("failed"), F.col("evaluated")).alias("failed_share"))


def generated_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check generated for all given tables, as specs."""
    profiled = plan.profile_assets(tune(spark), all_assets(spark, sf_dir), FULL)
    _, runnable, _ = plan.plan_checks(profiled)
    profiled.release()
    return specs_frame(spark, runnable)


def findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_scan(spark, sf_dir).findings.select(
        "check_id", "dimension", "severity", "evaluated", "failed", F.round("ratio", 9).alias("ratio"), F.col("severity_rank").cast("bigint").alias("severity_rank")
    )


def findings_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of findings on text columns, one row per example; personal values masked."""
    f = faulty_scan(spark, sf_dir, evidence=True).findings.filter("asset = 'dirty_customers' AND type NOT IN ('not_null', 'duplicate_rows')")
    return f.select("check_id", F.posexplode("examples").alias("position", "e")).select(
        "check_id", (F.col("position") + 1).cast("bigint").alias("rank"), F.col("e.value").alias("value"), F.col("e.n").alias("n"), F.col("e.masked").alias("masked")
    )


def failing_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the rows behind several checks, one row per check and row."""
    st = make_store([asset(spark, sf_dir, "dirty_customers"), asset(spark, sf_dir, "dirty_orders")])
    specs = [
        new_spec("not_null", "dirty_customers", "email"), new_spec("whitespace", "dirty_customers", "city"),
        new_spec("non_printing", "dirty_customers", "name"), new_spec("casing_variants", "dirty_customers", "city"),
        new_spec("semantic_format", "dirty_customers", "iban", params={"semantic_type": "iban"}),
        new_spec("type_conformance", "dirty_customers", "total", params={"expected": "number", "majority": 0.9}),
        new_spec("range", "dirty_orders", "amount", params={"min": 0.0, "max": 1_000_000.0}),
        new_spec("column_order", "dirty_orders", columns=("ordered_at", "shipped_at")),
        new_spec("foreign_key", "dirty_orders", "customer_id", params={"parent": "dirty_customers", "parent_column": "id"}),
        new_spec("unique", "dirty_orders", "id"),
    ]
    rows = [failing_rows(st, s).select(F.lit(s.id).alias("check_id"), F.col("id").cast("bigint").alias("id")) for s in specs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def health_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = [asset(spark, sf_dir, t) for t in ("clean_customers", "dirty_customers", "no_returns", "contacts")]
    options = plan.ScanOptions(sample_rows=0, now=NOW, declares_keys=True)
    p = plan.profile_assets(tune(spark), assets, options)
    p.release()
    return health_items(p.profile, plan.asset_frame(p, options)).select("type", "asset", "column")


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = faulty_scan(spark, sf_dir).findings
    by_severity = findings.counts_by_severity(f).select(F.lit("severity").alias("by"), F.col("severity").alias("name"), "findings")
    return by_severity.unionByName(findings.counts_by_table(f).select(F.lit("table").alias("by"), F.col("asset").alias("name"), "findings"))


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = plan.scan_statistics(faulty_scan(spark, sf_dir))
    return st.select("assets", "assets_failed", "columns", "checks_active")


def check_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of one check per part size and order status, as if its rows were a sample of all."""
    from plumbline.functions.intervals import check_interval as interval
    from plumbline.functions.intervals import variance_of

    df = table(spark, sf_dir, "orders")
    groups = df.groupBy(F.col("o_custkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 400000).alias("k"))
    population = row_counts([Asset("orders", df)])["orders"]
    rows = groups.withColumn("population", F.lit(population))
    p, low, high = interval(F.col("n"), F.col("k"), F.col("population"))
    return rows.select("grp", "n", "k", F.round(p, 9).alias("ratio"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"),
                       F.round(variance_of(low, high), 9).alias("variance"))


def scores_at(level: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = faulty_scan(spark, sf_dir).scores.filter(F.col("level") == level)
        keys = {"column": ["asset", "column"], "table": ["asset"], "store": []}[level]
        return s.select(*keys, "dimension", "value", "low", "high", "checks")

    return run


def sampled_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a sample of lineitem drawn by key hash: shares with their intervals."""
    options = plan.ScanOptions(sample_rows=max(1, row_counts([asset(spark, sf_dir, "lineitem")])["lineitem"] // 10), by_key=True, now=NOW, examples=False)
    s = finished(plan.run_scan(tune(spark), [asset(spark, sf_dir, t) for t in ("lineitem", "orders")], options))
    return s.results.select("check_id", "evaluated", "failed", "population", "ratio", "low", "high", "passed")


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given tables, read in full: scores of the store and of every table."""
    s = finished(plan.run_scan(tune(spark), all_assets(spark, sf_dir), plan.ScanOptions(sample_rows=0, now=NOW, examples=False)))
    return s.scores.filter("level <> 'column'").select("level", "asset", "dimension", "value", "low", "high", "checks")


# --- accuracy ---------------------------------------------------------------------------------------


def fault_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of the two views, recounted from the key arithmetic."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders_twice").select(F.col("o_orderkey").alias("k"))
    m = lambda d: F.col("k") % d == 0
    customers = c.agg(
        F.count_if(m(50)).alias("not_null/email"), F.count_if(m(59)).alias("non_printing/name"), F.count_if(m(61)).alias("whitespace/city"),
        F.count_if(m(101)).alias("type_conformance/total"), F.count_if(m(79)).alias("semantic_format/vat_id"), F.count_if(m(83)).alias("semantic_format/iban"),
        F.count_if(~m(50) & (m(211) | m(97))).alias("semantic_format/email"), F.count_if(m(211) & ~m(50)).alias("not_blank/email"),
        F.count_if(F.col("k") % 250 == 249).alias("unique/id"), F.count_if(m(61) | m(67)).alias("casing_variants/city"),
    )
    orders = o.agg(
        F.count_if(m(1009) & ~m(997)).alias("not_null/customer_id"), F.count_if(F.col("k") == 11).alias("future_dates/ordered_at"),
        F.count_if(F.col("k") == 7).alias("implausible_dates/ordered_at"), F.count_if(m(400)).alias("outliers/amount"),
        F.count_if(F.col("k").between(20, 29)).cast("bigint").alias("dup"),
    ).withColumn("duplicate_rows/", F.expr("dup div 2")).drop("dup")

    def long(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(c.split("/")[0]).alias("type"), F.lit(c.split("/")[1] or None).cast("string").alias("column"), F.col(f"`{c}`").alias("rows")) for c in df.columns])
        return df.select(F.inline(entries)).withColumn("asset", F.lit(name))

    return long(customers, "dirty_customers").unionByName(long(orders, "dirty_orders"))


def accuracy_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection on the faulty tables, per check type."""
    rules = faulty_scan(spark, sf_dir).results.filter("kind = 'rule'")
    return accuracy.detection(fault_list(spark, sf_dir), rules)


def clean_scan_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the clean twins: nothing may fail."""
    assets = [asset(spark, sf_dir, t) for t in ("clean_customers", "clean_orders")]
    s = finished(plan.run_scan(tune(spark), assets, plan.ScanOptions(sample_rows=0, now=NOW, examples=False)))
    return accuracy.clean_alarms(s.results)


def locked_baseline_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the clean twins, locked, on the faulty tables under the same names."""
    options = plan.ScanOptions(sample_rows=0, now=NOW, examples=False)

    def named(view: str, name: str) -> Asset:
        return Asset(name, table(spark, sf_dir, view), primary_key=("id",))

    first = plan.profile_assets(tune(spark), [named("clean_customers", "customers"), named("clean_orders", "orders")], options)
    _, specs, _ = plan.plan_checks(first)
    first.release()
    locked = accuracy.locked_baselines(specs)
    second = finished(plan.run_scan(spark, [named("dirty_customers", "customers"), named("dirty_orders", "orders")], options, saved=locked))
    return second.results.filter("kind = 'baseline' AND status = 'locked' AND column IN ('city', 'amount', 'ordered_at', 'status')").select(
        "check_id", "evaluated", "failed", "passed")


QUERIES: dict[str, Query] = {
    "profile_numeric": profile_numeric, "profile_text": profile_text, "profile_temporal": profile_temporal, "profile_mad": profile_mad,
    "sorted_quantiles": sorted_quantiles, "value_histogram": value_histogram, "top_values": top_values_query, "pattern_classes": pattern_classes,
    "infer_roles": infer_roles, "semantic_types": semantic_types, "semantic_validators": semantic_validators, "mask_personal": mask_personal,
    "time_series_candidates": time_series_candidates,
    "check_not_null": value_check("not_null", NULLS),
    "check_not_blank": value_check("not_blank", TEXT),
    "check_row_count": check_row_count,
    "check_type_conformance": value_check("type_conformance", _columns(CONFORM), CONFORM),
    "check_semantic_format": value_check("semantic_format", _columns(SEMANTIC), SEMANTIC),
    "check_pattern": value_check("pattern", _columns(SHAPES), SHAPES),
    "check_accepted_values": value_check("accepted_values", _columns(ACCEPTED), ACCEPTED),
    "check_length": value_check("length", _columns(LENGTHS), LENGTHS),
    "check_whitespace": value_check("whitespace", TEXT),
    "check_non_printing": value_check("non_printing", TEXT),
    "check_range": value_check("range", _columns(RANGES), RANGES),
    "check_outliers": check_outliers,
    "check_future_dates": value_check("future_dates", TIME),
    "check_implausible_dates": value_check("implausible_dates", TIME),
    "check_foreign_key": check_foreign_key, "orphan_examples": orphan_examples, "check_column_order": check_column_order,
    "check_casing_variants": check_casing_variants,
    "check_unique": value_check("unique", {"dirty_customers": ("id",), "dirty_orders": ("id",), "documents": ("doc_id", "text"), "lineitem": ("l_orderkey",)}),
    "check_composite_unique": check_composite_unique, "check_duplicate_rows": check_duplicate_rows, "check_freshness": check_freshness,
    "check_results_batch": check_results_batch, "generated_checks": generated_checks, "findings": findings_query,
    "findings_examples": findings_examples, "failing_rows": failing_rows_query, "health": health_query, "finding_counts": finding_counts,
    "scan_stats": scan_stats, "check_interval": check_interval, "score_columns": scores_at("column"), "score_tables": scores_at("table"),
    "score_store": scores_at("store"), "sampled_profile": sampled_profile, "store_scan": store_scan,
    "accuracy_measures": accuracy_measures, "clean_scan_alarms": clean_scan_alarms, "locked_baseline_alarms": locked_baseline_alarms,
}
