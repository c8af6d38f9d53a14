"""Registered queries on what is kept between scans: checks, findings, scores, measures and the change log.

Three ten-day slices of the events stand for three scans. Each checks, per event type and user group, that
at most 13 % of the values exceed 100.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.intervals import check_interval
from plumbline.model import Asset
from plumbline.operators import examples, history, lifecycle
from plumbline.operators import findings as fd
from plumbline.plans import scan as plan
from plumbline.session import cut_lineage, instant, local_frame, tune

from .views import NOW, table

START = datetime(2024, 1, 1)
SCANS = ("scan0", "scan1", "scan2")
SEVERITY = "CASE g WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'low' END"
LIMIT = 0.13


def seen_at(p: int) -> datetime:
    return START + timedelta(days=10 * (p + 1))


def slice_of(spark: SparkSession, sf_dir: str, p: int) -> DataFrame:
    ts = F.col("ts")
    lo, hi = (instant(START + timedelta(days=10 * x)) for x in (p, p + 1))
    return table(spark, sf_dir, "events").filter((ts >= lo) & (ts < hi))


def slice_results(spark: SparkSession, sf_dir: str, p: int) -> DataFrame:
    counts = slice_of(spark, sf_dir, p).groupBy("event_type", (F.col("user_id") % 7).alias("g")).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("value") > 100).alias("failed")
    )
    n, k = F.col("evaluated"), F.col("failed")
    ratio, low, high = check_interval(n, k, n * 2)
    s = lambda text: F.lit(text)
    return counts.select(
        F.concat(F.lit("share:"), "event_type", F.lit(":"), F.col("g").cast("string")).alias("check_id"),
        s("share").alias("type"), s("High values").alias("title"), F.col("event_type").alias("asset"), s("value").alias("column"),
        F.array().cast("array<string>").alias("columns"), s("accuracy").alias("dimension"), F.expr(SEVERITY).alias("severity"),
        "evaluated", "failed", (n * 2).alias("population"), ratio.alias("ratio"), low.alias("low"), high.alias("high"),
        s("high values").alias("summary"), s("look").alias("next_step"), F.lit(True).alias("scores"),
        (ratio >= 1 - LIMIT).alias("passed"), s("column").alias("level"), s("rule").alias("kind"),
    )


def no_evidence(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], "check_id string, examples array<struct<value:string,n:bigint,masked:boolean>>")


def stored_checks(results: DataFrame) -> DataFrame:
    """All checks active, except that group 6 was retired meanwhile."""
    status = F.when(F.col("check_id").endswith(":6"), "retired").otherwise("active")
    return results.select("check_id", "type", "column", "dimension", status.alias("status"))


def folded(spark: SparkSession, sf_dir: str, scans: int = 3, actions_after_first: bool = False) -> list[fd.FindingFold]:
    """The folds of the first scans, each on the state the one before left."""
    tune(spark)
    state = fd.empty_state(spark)
    out = []
    for p in range(scans):
        # Each fold starts from written results and a written state, as it does between real scans.
        r = cut_lineage(slice_results(spark, sf_dir, p))
        fold = fd.fold_findings(state, stored_checks(r), r, examples.findings(r, no_evidence(spark)), SCANS[p], seen_at(p))
        state = cut_lineage(fold.state)
        out.append(replace(fold, state=state))
        if p == 0 and actions_after_first:
            state = fd.apply_finding_actions(state, people(state)).state
    return out


def people(state: DataFrame) -> DataFrame:
    """One action per finding, chosen by its group: some allowed, some stale, some out of turn."""
    g = F.substring("check_id", -1, 1).cast("int")
    action = F.expr("CASE g WHEN 0 THEN 'acknowledge' WHEN 1 THEN 'mute' WHEN 2 THEN 'resolve' WHEN 3 THEN 'reopen' WHEN 4 THEN 'mute' ELSE 'acknowledge' END")
    until = F.expr("CASE g WHEN 1 THEN TIMESTAMP_NTZ '2024-01-15 00:00:00' END")
    version = F.when(F.col("g") == 5, F.col("version") + 1).otherwise(F.col("version"))
    return state.withColumn("g", g).select(
        "finding_id", action.alias("action"), version.alias("version"), F.lit("ana").alias("actor"),
        instant(datetime(2024, 1, 12)).alias("at"), until.alias("until"), F.lit("  ").alias("note"),
    )


def link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir)[-1].state.select("check_id", "status", "severity", "occurrences", "first_scan_id", "last_scan_id", "resolved_scan_id", "version")


def mute_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People act after the first scan; a mute that ran out opens again when the finding recurs."""
    return folded(spark, sf_dir, 2, actions_after_first=True)[-1].state.select("check_id", "status", "occurrences", "version", F.col("muted_until").isNotNull().alias("has_until"))


def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.summary.withColumn("scan_id", F.lit(SCANS[p])) for p, f in enumerate(folded(spark, sf_dir))])


def auto_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reduce(DataFrame.unionByName, [f.events.withColumn("scan_id", F.lit(SCANS[p])) for p, f in enumerate(folded(spark, sf_dir))])
    return events.filter("action = 'auto_resolved'").select(
        F.element_at(F.split("finding_id", "/"), 2).alias("check_id"), "scan_id", "from_status", "to_status")


def finding_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = folded(spark, sf_dir, 1)[-1].state
    fold = fd.apply_finding_actions(state, people(state))
    changed = fold.state.select("finding_id", "check_id", "status", "version")
    refused = fold.refused.select("finding_id", "refusal")
    return changed.join(refused, "finding_id", "left").drop("finding_id")


def latest_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.latest_occurrences(all_occurrences(spark, sf_dir)).select("check_id", "scan_id", "evaluated", "failed")


def all_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.occurrences for f in folded(spark, sf_dir)])


def findings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five findings after the first high one, most severe first."""
    folds = folded(spark, sf_dir)
    occurrences = reduce(DataFrame.unionByName, [f.occurrences for f in folds])
    checks = stored_checks(slice_results(spark, sf_dir, 2))
    page = fd.list_findings(folds[-1].state, checks, occurrences, after=(2, seen_at(2), "scan0/share:click:1"), limit=5)
    return page.select("check_id", "severity", "last_seen_at", "evaluated", "failed")


def finding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two occurrences and all events of one finding."""
    folds = folded(spark, sf_dir)
    events = reduce(DataFrame.unionByName, [f.events for f in folds])
    occ = reduce(DataFrame.unionByName, [f.occurrences for f in folds])
    wanted = folds[-1].state.filter("first_scan_id = 'scan0' AND occurrences > 1").agg(F.min("finding_id")).first()[0]
    o, e = fd.finding_detail(wanted, occ, events, shown=2)
    return o.select(F.lit("occurrence").alias("what"), "seen_at", F.col("failed").cast("string").alias("detail")).unionByName(
        e.select(F.lit("event").alias("what"), F.col("at").alias("seen_at"), F.col("action").alias("detail")))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low findings of the last scan with the status of the finding each belongs to."""
    r = slice_results(spark, sf_dir, 2)
    found = examples.findings(r, no_evidence(spark))
    return fd.scan_findings(found, folded(spark, sf_dir)[-1].state, severity="low").select("check_id", "failed", "finding_status")


# --- history ----------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per slice and event type, and for all of them, from the share of high values."""
    parts = []
    for p in range(3):
        df = slice_of(spark, sf_dir, p)
        per = df.groupBy(F.col("event_type").alias("asset")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("k"))
        whole = df.agg(F.lit(None).cast("string").alias("asset"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("k"))
        both = per.unionByName(whole)
        v, low, high = check_interval(F.col("n"), F.col("k"), F.col("n") * 2)
        parts.append(both.select(
            F.lit(SCANS[p]).alias("scan_id"), instant(seen_at(p)).alias("measured_at"), "asset",
            *[F.round(100 * x, 1).alias(name) for name, x in (("overall", v), ("low", low), ("high", high))], F.lit(1).cast("bigint").alias("checks"),
        ))
    return reduce(DataFrame.unionByName, parts)


def scans_frame(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [(s, "schedule" if i else "manual") for i, s in enumerate(SCANS)], "scan_id string, trigger string")


def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's last two scores up to the second scan, and those of one event type."""
    r, s = records(spark, sf_dir), scans_frame(spark)
    store = history.score_history(r, s, limit=2, until_scan="scan1")
    one = history.score_history(r, s, asset="click", limit=2)
    return store.unionByName(one).select("asset", "scan_id", "overall", "low", "high", "checks", "trigger")


def score_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.score_changes(records(spark, sf_dir))


def measure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    options = plan.ScanOptions(sample_rows=0, now=NOW)
    for p in range(3):
        a = Asset("events", slice_of(spark, sf_dir, p).select("value", "event_type", "ts"))
        profiled = plan.profile_assets(tune(spark), [a], options)
        profiled.release()  # the profile is local by now
        parts.append(history.measures(profiled.profile, plan.asset_frame(profiled, options), SCANS[p], seen_at(p)))
    return reduce(DataFrame.unionByName, parts)


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure_tables(spark, sf_dir)
    return m.select("scan_id", "asset", "column", F.explode("measures").alias("measure", "value")).withColumn("value", F.round("value", 6))


def measure_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = history.measure_series(measure_tables(spark, sf_dir))
    return s.select("asset", "column", "measure", "points", *[F.round(c, 6).alias(c) for c in ("first", "newest", "lowest", "highest")])


def measure_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = history.measure_history(measure_tables(spark, sf_dir), scans_frame(spark), "events", "value", limit=2)
    return m.select("scan_id", "trigger", "rows", F.round(F.col("measures")["mean"], 6).alias("mean"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change log: people of the user group act on findings and checks."""
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.col("ts").alias("at"),
        F.concat(F.when(F.col("user_id") % 2 == 0, "check.").otherwise("finding."), "event_type").alias("action"),
        F.concat(F.lit("User_"), F.col("user_id").cast("string"), F.lit("%")).alias("actor"),
        F.when(F.col("user_id") % 2 == 0, "check").otherwise("finding").alias("object_type"), F.col("user_id").cast("string").alias("object_id"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty entries of a prefix, a part of a name with wildcard characters, a time range, and a page mark."""
    rows = history.change_log(
        log_events(spark, sf_dir), action="check.", actor="uSER_1", object_type="check", since=datetime(2024, 1, 5), until=datetime(2024, 1, 29),
        after=(datetime(2024, 1, 28), "000000000000"), limit=40)
    return rows.select("event_id", "at", "action", "actor")


def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts before and after a relabelling that touches the type of every third and the brand of every fifth."""
    df = table(spark, sf_dir, "part")
    before = F.when(F.col("p_partkey") % 11 != 0, F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type"))
    brand = F.when(F.col("p_partkey") % 5 == 0, F.lit("Brand#99")).otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_partkey") % 3 == 0, F.lit("OTHER")).otherwise(F.col("p_type"))
    was, now = history.changed_fields(F.col("before"), F.col("after"))
    rows = df.select("p_partkey", before.alias("before"), F.create_map(F.lit("brand"), brand, F.lit("type"), kind).alias("after"))
    out = rows.select("p_partkey", was.alias("was"), now.alias("now"))
    return out.select("p_partkey", F.size("now").cast("bigint").alias("fields"), *[F.col(m)[f].alias(f"{m}_{f}") for m in ("was", "now") for f in ("brand", "type")])


# --- checks kept between scans ----------------------------------------------------------------------


def spec_rows(df: DataFrame) -> DataFrame:
    """Specs of a range check per part brand."""
    g = df.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    b = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    return g.select(
        F.concat(F.lit("range:part:"), "p_brand").alias("check_id"), F.lit("range").alias("type"), F.lit("part").alias("asset"),
        F.col("p_brand").alias("column"), F.array().cast("array<string>").alias("columns"),
        F.format_string('{"max": %d, "min": %d}', "hi", "lo").alias("params"), F.lit("accuracy").alias("dimension"), F.lit("high").alias("severity"),
        F.lit("baseline").alias("kind"), F.lit("proposed").alias("status"), F.lit(0.0).alias("max_fail_ratio"), F.lit("generated").alias("origin"),
        F.lit(1).cast("bigint").alias("version"), b.alias("b"),
    )


def generated_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spec_rows(table(spark, sf_dir, "part").filter("p_size % 25 <> 0"))
    return rows.filter("b % 7 <> 0").drop("b")


def saved_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spec_rows(table(spark, sf_dir, "part")).filter("b % 5 <> 0")
    status = F.expr("CASE b % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'active' WHEN 2 THEN 'locked' ELSE 'retired' END")
    return rows.withColumn("status", status).withColumn("origin", F.when(F.col("b") % 6 == 0, "manual").otherwise("generated")).withColumn(
        "version", (F.col("b") % 3 + 1).cast("bigint")).drop("b")


def reconcile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lifecycle.reconcile_frames(generated_specs(spark, sf_dir), saved_specs(spark, sf_dir))
    return r.select("check_id", "outcome", "status", "params", "origin", "version")


def check_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(None).cast("timestamp_ntz")
    return saved_specs(spark, sf_dir).withColumn("last_scan_id", F.lit("scan0")).withColumn("updated_at", at)


def persisted(spark: SparkSession, sf_dir: str) -> lifecycle.CheckFold:
    """A scan that loaded the saved versions, except that brands 1, 11 and 21 changed meanwhile."""
    state = check_state(spark, sf_dir)
    loaded = state.select("check_id", F.when(F.col("check_id").endswith("1"), F.col("version") + 9).otherwise(F.col("version")).alias("v"))
    specs = generated_specs(spark, sf_dir).join(loaded, "check_id", "left").withColumn("version", F.coalesce("v", "version")).drop("v")
    return lifecycle.persist_checks(state, specs, "scan1", datetime(2024, 1, 20))


def persist_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted(spark, sf_dir).state.select("check_id", "status", "params", "version", "last_scan_id", "updated_at")


def check_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted(spark, sf_dir).events.select("check_id", "action", "from_status", "to_status", "params_before", "params_after")


def check_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action per check, by brand: some stale, some out of turn."""
    state = check_state(spark, sf_dir)
    b = F.regexp_replace("column", "Brand#", "").cast("int")
    action = F.expr("CASE b % 6 WHEN 0 THEN 'approve' WHEN 1 THEN 'lock' WHEN 2 THEN 'unlock' WHEN 3 THEN 'restore' WHEN 4 THEN 'reject' ELSE 'retire' END")
    actions = state.withColumn("b", b).select(
        "check_id", action.alias("action"), F.when(F.col("b") % 10 == 3, 99).otherwise(F.col("version")).cast("bigint").alias("version"),
        F.lit("ana").alias("actor"), instant(datetime(2024, 1, 21)).alias("at"))
    fold = lifecycle.apply_check_actions(state, actions)
    return fold.state.select("check_id", "status", "version").join(fold.refused.select("check_id", "refusal"), "check_id", "left")


def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = check_state(spark, sf_dir)
    return lifecycle.check_counts(state.unionByName(state.withColumn("asset", F.col("column"))))


def check_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.list_checks(check_state(spark, sf_dir), "part", ["active", "locked"]).select("check_id", "column", "status")


STATE_QUERIES = {
    "link_findings": link_findings, "mute_expiry": mute_expiry, "fold_summary": fold_summary, "auto_resolve": auto_resolve,
    "finding_transitions": finding_transitions, "latest_occurrence": latest_occurrence, "findings_page": findings_page,
    "finding_history": finding_history, "scan_findings": scan_findings, "score_history": score_history, "score_change": score_change,
    "measures": measures, "measure_series": measure_series, "measure_points": measure_points, "change_log": change_log,
    "changed_fields": changed_fields, "reconcile_checks": reconcile_checks, "persist_checks": persist_checks, "check_events": check_events,
    "check_transitions": check_transitions, "check_counts": check_counts, "check_list": check_list,
}
