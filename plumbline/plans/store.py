"""Keeping scans: write the result tables and fold them into the state of checks, findings and history."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Asset, CheckSpec, specs_from_rows
from ..operators import findings as fd
from ..operators import history, lifecycle
from ..sources import sinks
from .scan import Scan, ScanOptions, run_scan


@dataclass(frozen=True)
class Recorded:
    """What folding a scan changed: findings per action and checks per action."""

    findings: dict[str, int]
    checks: dict[str, int]


def saved_checks(spark: SparkSession, root: str) -> list[CheckSpec]:
    """The stored checks, as a scan starts from them: one row per check."""
    state = sinks.read_snapshot(spark, root, "checks")
    return specs_from_rows(state.collect()) if state is not None else []


def record_scan(scan: Scan, root: str, trigger: str = "manual") -> Recorded:
    """Write a scan's tables and the next state. The previous snapshots stay as they are.

    A scan that is recorded already changes nothing: its fold starts from the snapshot it started from before, so a call that
    was cut short can be repeated. The list of scans is written last."""
    spark = scan.profiled.store.spark
    at = scan.started_at
    name = f"{at:%Y%m%dT%H%M%S}-{scan.scan_id}"
    specs = scan.check_specs
    base, done = sinks.base_of(spark, root, "checks", name)
    old_checks = sinks.read_snapshot(spark, root, "checks", base) if base else None
    checks = lifecycle.persist_checks(old_checks if old_checks is not None else lifecycle.empty_check_state(specs), specs, scan.scan_id, at)
    done = done or sinks.write_snapshot(checks.state, root, "checks", name, base)
    stored = sinks.read_snapshot(spark, root, "checks", done)

    base, done = sinks.base_of(spark, root, "findings", name)
    old = sinks.read_snapshot(spark, root, "findings", base) if base else None
    fold = fd.fold_findings(old if old is not None else fd.empty_state(spark), stored, scan.results, scan.findings, scan.scan_id, at)
    done = done or sinks.write_snapshot(fold.state, root, "findings", name, base)
    broken = fd.broken_invariants(sinks.read_snapshot(spark, root, "findings", done)).count()
    if broken:
        raise ValueError(f"{broken} checks have more than one unresolved finding")

    with_scan = lambda df: df.withColumn("scan_id", F.lit(scan.scan_id))
    sinks.write_tables(
        scan.tables()
        | {
            "occurrences": fold.occurrences,
            "finding_events": with_scan(fold.events),
            "check_events": with_scan(checks.events),
            "score_records": history.score_records(scan.scores, scan.scan_id, at),
            "measures": history.measures(scan.profile, scan.assets, scan.scan_id, at),
            "scans": with_scan(scan.assets.agg(F.count(F.lit(1)).alias("assets")).withColumn("trigger", F.lit(trigger))),
        },
        root,
    )
    return Recorded(
        {r.action: r.findings for r in fold.summary.collect()}, {r.action: r.checks for r in checks.summary.collect()}
    )


def scan_and_record(
    spark: SparkSession, assets: list[Asset], root: str, scan_id: str, options: ScanOptions | None = None, trigger: str = "manual"
) -> tuple[Scan, Recorded]:
    """A scan that starts from the stored checks and ends in the stored state."""
    scan = run_scan(spark, assets, options, saved=saved_checks(spark, root), scan_id=scan_id)
    return scan, record_scan(scan, root, trigger)


def change_checks(spark: SparkSession, root: str, actions: DataFrame, at: datetime) -> DataFrame:
    """Apply people's actions to the stored checks; returns the refused ones."""
    return _change(spark, root, "checks", actions, at, lifecycle.apply_check_actions)


def change_findings(spark: SparkSession, root: str, actions: DataFrame, at: datetime) -> DataFrame:
    return _change(spark, root, "findings", actions, at, fd.apply_finding_actions)


def _change(spark: SparkSession, root: str, name: str, actions: DataFrame, at: datetime, apply) -> DataFrame:
    names = sinks.snapshots(spark, root, name)
    if not names:
        raise ValueError(f"no {name} are stored yet")
    fold = apply(sinks.read_snapshot(spark, root, name, names[-1]), actions)
    mark = f"{at:%Y%m%dT%H%M%S}-people-{uuid.uuid4().hex[:12]}"
    sinks.write_snapshot(fold.state, root, name, mark, names[-1])
    events = fold.events.withColumn("scan_id", F.lit(mark))
    sinks.write_tables({f"{'check' if name == 'checks' else 'finding'}_events": events}, root)
    return fold.refused
