"""Findings across scans: a fold of one scan into the stored findings, people's actions, and reading them.

A finding follows one check. Every function reads the previous snapshot and returns the next one; nothing
is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import SCORING_STATUSES
from ..session import instant, local_frame
from .evaluate import severity_rank
from .lifecycle import SCANNER, ActionFold, judge_actions

STATE_SCHEMA = (
    "finding_id string, check_id string, asset string, status string, severity string, occurrences bigint, "
    "first_scan_id string, last_scan_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
    "muted_until timestamp_ntz, resolved_at timestamp_ntz, resolved_scan_id string, version bigint, updated_at timestamp_ntz"
)
STATE = [f.strip().split(" ")[0] for f in STATE_SCHEMA.split(",")]
DEFAULT_STATUSES = ("open", "acknowledged")
FOLD_ACTIONS = ("opened", "recurred", "reopened", "unmuted", "auto_resolved", "unlinked")

# A person's actions on a finding, the statuses they start from and the one they lead to.
FINDING_TRANSITIONS = {
    "acknowledge": (("open",), "acknowledged"),
    "resolve": (("open", "acknowledged", "muted"), "resolved"),
    "mute": (("open", "acknowledged"), "muted"),
    "unmute": (("muted",), "open"),
    "reopen": (("resolved",), "open"),
}


@dataclass(frozen=True)
class FindingFold:
    state: DataFrame
    occurrences: DataFrame
    events: DataFrame
    summary: DataFrame


def empty_state(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], STATE_SCHEMA)


def candidates(state: DataFrame) -> DataFrame:
    """The finding a failing check would continue: the unresolved one, else the one resolved last."""
    order = Window.partitionBy("check_id").orderBy(
        (F.col("status") == "resolved").asc(), F.desc_nulls_last("resolved_at"), F.desc("first_seen_at"), "finding_id"
    )
    return state.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def fold_findings(
    state: DataFrame, checks: DataFrame, results: DataFrame, findings: DataFrame, scan_id: str, seen_at: datetime
) -> FindingFold:
    """Link failing checks to findings, resolve those whose check passed, and record occurrences.

    `checks`: the stored checks after this scan, `(check_id, status)`. A check that no longer scores keeps
    its finding and gets an unlinked occurrence. A check without a result changes nothing."""
    at = instant(seen_at)
    scoring = checks.filter(F.col("status").isin(*SCORING_STATUSES)).select("check_id", F.lit(True).alias("linked"))
    failing = findings.join(scoring, "check_id", "left")
    passing = (
        results.filter("scores AND NOT (failed > 0 AND NOT passed)").select("check_id").join(scoring, "check_id", "left_semi")
    )
    expired = (F.col("status") == "muted") & (F.col("muted_until") <= at)
    failed = (
        failing.filter("linked").select("check_id", "asset", F.col("severity").alias("new_severity"))
        .join(candidates(state).drop("asset"), "check_id", "left")
        .withColumn(
            "action",
            F.when(F.col("finding_id").isNull(), "opened")
            .when(F.col("status") == "resolved", "reopened")
            .when(F.coalesce(expired, F.lit(False)), "unmuted")
            .otherwise("recurred"),
        )
        .withColumn("finding_id", F.coalesce("finding_id", F.concat_ws("/", F.lit(scan_id), "check_id")))
    )
    a = F.col("action")
    back_open = a.isin("opened", "reopened", "unmuted")
    clear = lambda c: F.when(~back_open, F.col(c)).alias(c)
    touched = failed.select(
        "finding_id", "check_id", "asset",
        F.when(back_open, "open").otherwise(F.col("status")).alias("status"),
        F.col("new_severity").alias("severity"),
        (F.coalesce("occurrences", F.lit(0)) + 1).cast("bigint").alias("occurrences"),
        F.coalesce("first_scan_id", F.lit(scan_id)).alias("first_scan_id"), F.lit(scan_id).alias("last_scan_id"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"), at.alias("last_seen_at"),
        clear("muted_until"), clear("resolved_at"), clear("resolved_scan_id"),
        (F.coalesce("version", F.lit(0)) + 1).cast("bigint").alias("version"), at.alias("updated_at"),
        a, F.col("status").alias("from_status"),
    )
    healed = (
        state.filter("status <> 'resolved'").join(passing, "check_id", "left_semi")
        .withColumn("from_status", F.col("status"))
        .withColumns({
            "status": F.lit("resolved"), "resolved_at": at, "resolved_scan_id": F.lit(scan_id),
            "muted_until": F.lit(None).cast("timestamp_ntz"), "version": F.col("version") + 1, "updated_at": at,
            "action": F.lit("auto_resolved"),
        })
    )
    changed = touched.unionByName(healed.select(*touched.columns))
    unchanged = state.join(changed.select("finding_id"), "finding_id", "left_anti")
    occurrences = failing.join(touched.select("check_id", "finding_id"), "check_id", "left").select(
        F.concat_ws("/", F.lit(scan_id), "check_id").alias("occurrence_id"), F.lit(scan_id).alias("scan_id"),
        at.alias("seen_at"), "finding_id",
        *[c for c in findings.columns if c not in ("severity_rank", "finding_id")],
    )
    events = changed.select(
        "finding_id", F.lit(SCANNER).alias("actor"), "action", "from_status", F.col("status").alias("to_status"),
        F.lit(None).cast("string").alias("note"), at.alias("at"),
    )
    actions = changed.select("action").unionByName(failing.filter("linked IS NULL").select(F.lit("unlinked").alias("action")))
    names = local_frame(state.sparkSession, [(x,) for x in FOLD_ACTIONS], "action string")
    summary = names.join(actions.groupBy("action").agg(F.count(F.lit(1)).alias("findings")), "action", "left").select(
        "action", F.coalesce("findings", F.lit(0)).alias("findings")
    )
    return FindingFold(unchanged.select(*STATE).unionByName(changed.select(*STATE)), occurrences, events, summary)


def broken_invariants(state: DataFrame) -> DataFrame:
    """Checks with more than one unresolved finding; empty for a sound state."""
    return state.filter("status <> 'resolved'").groupBy("check_id").agg(F.count(F.lit(1)).alias("unresolved")).filter("unresolved > 1")


def apply_finding_actions(state: DataFrame, actions: DataFrame) -> ActionFold:
    """Acknowledge, resolve, mute, unmute and reopen. `actions` also carries `until` and `note`."""
    judged = judge_actions(state, actions, "finding_id", FINDING_TRANSITIONS).withColumn(
        "refusal",
        F.coalesce(
            F.when(F.col("until").isNotNull() & (F.col("action") != "mute"), "until_without_mute")
            .when(F.col("until") <= F.col("at"), "until_in_the_past"),
            F.col("refusal"),
        ),
    )
    accepted = judged.filter("refusal IS NULL")
    rows = state.join(
        accepted.select("finding_id", "action", "target", F.col("at").alias("_at"), F.col("until").alias("_until")), "finding_id", "left"
    )
    acted, act = F.col("target").isNotNull(), F.col("action")
    replaced: dict[str, Column] = {
        "status": F.coalesce("target", "status"),
        "muted_until": F.when(~acted, F.col("muted_until")).when(act == "mute", F.col("_until")),
        "resolved_at": F.when(act == "resolve", F.col("_at")).when(~acted | (act != "reopen"), F.col("resolved_at")),
        "resolved_scan_id": F.when(~acted | ~act.isin("resolve", "reopen"), F.col("resolved_scan_id")),
        "version": F.when(acted, F.col("version") + 1).otherwise(F.col("version")),
        "updated_at": F.coalesce("_at", "updated_at"),
    }
    next_state = rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in STATE])
    note = F.when(F.trim("note") != "", F.col("note")).alias("note")
    events = accepted.select("finding_id", "actor", "action", "from_status", F.col("target").alias("to_status"), note, "at")
    return ActionFold(next_state, events, judged.filter("refusal IS NOT NULL").select("finding_id", "action", "actor", "refusal"))


# --- reading ----------------------------------------------------------------------------------------


def latest_occurrences(occurrences: DataFrame) -> DataFrame:
    """The newest occurrence of each finding: one grouped aggregate, not a sort per finding."""
    fields = [c for c in occurrences.columns if c != "finding_id"]
    # Latest scan first, then the smallest occurrence id.
    latest = occurrences.filter("finding_id IS NOT NULL").groupBy("finding_id").agg(F.max("seen_at").alias("seen_at"))
    at_latest = occurrences.join(latest, ["finding_id", "seen_at"])
    return at_latest.groupBy("finding_id").agg(F.min_by(F.struct(*fields), "occurrence_id").alias("o")).select("finding_id", "o.*")


def list_findings(
    state: DataFrame, checks: DataFrame, occurrences: DataFrame, statuses: tuple[str, ...] = DEFAULT_STATUSES,
    severities: tuple[str, ...] | None = None, asset: str | None = None,
    after: tuple[int, datetime, str] | None = None, limit: int = 50,
) -> DataFrame:
    """A page of findings with their check and newest occurrence: severity, last seen, id.

    `after` is the `(severity_rank, last_seen_at, finding_id)` of the last row of the page before."""
    rows = state.filter(F.col("status").isin(*statuses)).withColumn("severity_rank", severity_rank(F.col("severity")))
    if severities:
        rows = rows.filter(F.col("severity").isin(*severities))
    if asset is not None:
        rows = rows.filter(F.col("asset") == asset)
    if after:
        rank, seen, last = after
        r, s, i = F.col("severity_rank"), F.col("last_seen_at"), F.col("finding_id")
        seen_at = instant(seen)
        rows = rows.filter((r > rank) | ((r == rank) & ((s < seen_at) | ((s == seen_at) & (i > last)))))
    order = [F.col("severity_rank"), F.desc("last_seen_at"), F.col("finding_id")]
    page = rows.orderBy(*order).limit(limit)
    facts = checks.select("check_id", F.col("type").alias("check_type"), "column", "dimension")
    newest = latest_occurrences(occurrences).select("finding_id", "evaluated", "failed", "ratio", "low", "high", "summary", "examples")
    return page.join(facts, "check_id").join(newest, "finding_id", "left").orderBy(*order)


def finding_detail(finding_id: str, occurrences: DataFrame, events: DataFrame, shown: int = 20) -> tuple[DataFrame, DataFrame]:
    """The newest occurrences of a finding and all its events, newest first."""
    mine = occurrences.filter(F.col("finding_id") == finding_id).orderBy(F.desc("seen_at"), "occurrence_id").limit(shown)
    return mine, events.filter(F.col("finding_id") == finding_id).orderBy(F.desc("at"), "action")


def scan_findings(
    findings: DataFrame, state: DataFrame, severity: str | None = None, dimension: str | None = None, asset: str | None = None
) -> DataFrame:
    """A scan's findings with the status of the stored finding each one belongs to."""
    rows = findings
    for name, wanted in (("severity", severity), ("dimension", dimension), ("asset", asset)):
        if wanted is not None:
            rows = rows.filter(F.col(name) == wanted)
    stored = candidates(state).select("check_id", "finding_id", F.col("status").alias("finding_status"))
    return rows.join(stored, "check_id", "left")


def counts_by_severity(findings: DataFrame) -> DataFrame:
    """Findings per severity, zeros included."""
    from ..model import SEVERITIES

    names = local_frame(findings.sparkSession, [(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    return names.join(counts, "severity", "left").select("severity", F.coalesce("findings", F.lit(0)).alias("findings"))


def counts_by_table(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings per table, most first."""
    rows = findings.groupBy("asset").agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "asset")
    return rows.limit(limit) if limit else rows
