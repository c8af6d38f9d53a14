import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from shop import NOW

from plumbline import Asset, ScanOptions, change_checks, change_findings, scan_and_record
from plumbline.operators import history
from plumbline.plans.store import record_scan
from plumbline.operators.findings import list_findings
from plumbline.sources import sinks
from plumbline.sources.files import expand_paths, file_assets, guess_delimiter
from plumbline.sources.tables import catalog_assets, declared_assets


def invoices(spark, broken):
    return [Asset("invoices", spark.range(300).selectExpr(
        "id", f"CASE WHEN id % 50 = 3 AND {str(broken).lower()} THEN 'DE12345' ELSE concat('DE', lpad(cast(id AS STRING), 9, '1')) END AS vat_id"))]


CHECK = "semantic_format:invoices:vat_id"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Five scans: broken, broken, fixed, broken again, and once more after an expired mute."""
    root = str(tmp_path_factory.mktemp("store"))
    out = {"root": root, "recorded": [], "states": []}

    def scan(i, broken):
        s, rec = scan_and_record(spark, invoices(spark, broken), root, f"s{i}", ScanOptions(sample_rows=0, now=NOW + timedelta(days=i)))
        s.release()
        out["recorded"].append(rec)
        out["states"].append(sinks.read_snapshot(spark, root, "findings").filter(F.col("check_id") == CHECK).first())

    for i, broken in enumerate((True, True, False, True)):
        scan(i, broken)
    f = out["states"][-1]
    at = NOW + timedelta(days=3, hours=1)
    actions = spark.createDataFrame(
        [(f.finding_id, "mute", f.version, "ana", at, NOW + timedelta(days=4), "wait"), (f.finding_id, "resolve", f.version, "bob", at + timedelta(minutes=1), None, None)],
        "finding_id string, action string, version bigint, actor string, at timestamp_ntz, until timestamp_ntz, note string")
    out["refused"] = change_findings(spark, root, actions, at).collect()
    out["muted"] = sinks.read_snapshot(spark, root, "findings").filter(F.col("check_id") == CHECK).first()
    scan(5, True)
    return out


def test_a_finding_opens_recurs_resolves_reopens(kept):
    assert [(s.status, s.occurrences) for s in kept["states"]] == [("open", 1), ("open", 2), ("resolved", 2), ("open", 3), ("open", 4)]
    assert kept["states"][2].resolved_scan_id == "s2" and kept["states"][3].resolved_at is None and kept["states"][3].first_scan_id == "s0"
    acts = [{k: v for k, v in r.findings.items() if v} for r in kept["recorded"]]
    assert acts == [{"opened": 1}, {"recurred": 1}, {"auto_resolved": 1}, {"reopened": 1}, {"unmuted": 1}]


def test_people_mute_and_stale_actions_are_refused(kept):
    assert kept["muted"].status == "muted" and kept["muted"].muted_until == NOW + timedelta(days=4)
    assert [(r.action, r.refusal) for r in kept["refused"]] == [("resolve", "stale_version")]


def test_checks_are_created_once_and_regenerated_on_change(spark, kept):
    checks = [r.checks for r in kept["recorded"]]
    assert checks[0]["created"] > 5 and "created" not in checks[1] and checks[1] == {}
    events = sinks.read_table(spark, kept["root"], "check_events")
    assert events.filter("action = 'created'").count() == checks[0]["created"]


def test_history_and_measures(spark, kept):
    root = kept["root"]
    records, scans = sinks.read_table(spark, root, "score_records"), sinks.read_table(spark, root, "scans")
    h = history.score_history(records, scans, limit=3).collect()
    assert [r.scan_id for r in h] == ["s2", "s3", "s5"] and h[0].overall == 100.0 and h[1].overall < 100.0
    assert [r.scan_id for r in history.score_history(records, scans, limit=2, until_scan="s2").collect()] == ["s1", "s2"]
    change = {r.scan_id: r for r in history.score_changes(records.filter("asset IS NULL")).collect()}
    assert change["s0"].since is None and change["s2"].delta > 0 and change["s2"].within is False
    m = history.measure_history(sinks.read_table(spark, root, "measures"), scans, "invoices", "vat_id", limit=1).first().measures
    assert set(m) == {"null_share", "distinct_share", "blank_share", "mean_length"} and m["null_share"] == 0.0


def test_pages_of_findings(spark, kept):
    root = kept["root"]
    page = list_findings(sinks.read_snapshot(spark, root, "findings"), sinks.read_snapshot(spark, root, "checks"), sinks.read_table(spark, root, "occurrences")).collect()
    assert [(r.check_id, r.failed) for r in page] == [(CHECK, 6)]


def test_actions_on_checks(spark, kept):
    root = kept["root"]
    state = {r.check_id: r for r in sinks.read_snapshot(spark, root, "checks").collect()}
    at = datetime(2026, 11, 1)
    length = "length:invoices:vat_id"
    rows = [(length, "approve", state[length].version, "ana", at), (CHECK, "approve", state[CHECK].version, "ana", at), ("none", "lock", 1, "ana", at)]
    refused = change_checks(spark, root, spark.createDataFrame(rows, "check_id string, action string, version bigint, actor string, at timestamp_ntz"), at)
    assert {(r.check_id, r.refusal) for r in refused.collect()} == {(CHECK, "invalid_transition"), ("none", "not_found")}
    after = {r.check_id: r for r in sinks.read_snapshot(spark, root, "checks").collect()}
    assert after[length].status == "active" and after[length].version == state[length].version + 1


def test_files_become_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name;when\n1;"x;y";2024-01-01\n2;N/A;2024-01-02\n')
    (tmp_path / "b.tsv").write_text("id\tn\n1\t2.5\n2\tN/A\n")
    (tmp_path / "c.json").write_text('[{"id": 1, "t": {"k": 1}}, {"id": 2}]')
    (tmp_path / "a.jsonl").write_text('{"id": 7}\n{"id": 8}\n')
    (tmp_path / "skip.md").write_text("x")
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    got = {a.name: a.df for a in file_assets(spark, [str(tmp_path)])}
    assert set(got) == {"a", "a_jsonl", "b", "c", "p"} or set(got) == {"a", "a_csv", "b", "c", "p"}
    rows = sorted(df.count() for df in got.values())
    assert rows == [2, 2, 2, 2, 3]
    assert got["b"].dtypes == [("id", "int"), ("n", "string")]
    assert len(expand_paths(spark, [str(tmp_path / "*.csv")])) == 1
    with pytest.raises(ValueError):
        expand_paths(spark, [str(tmp_path / "skip.md")])
    with pytest.raises(ValueError):
        expand_paths(spark, [str(tmp_path / "none.csv")])
    assert guess_delimiter('a,"b;c;d",e') == ","


def test_declared_constraints_from_catalogue_rows(spark):
    t = lambda n, k="BASE TABLE": {"table_schema": "main", "table_name": n, "table_type": k}
    c = lambda n, name, kind, col, pos=1, parent=(None, None, None): {
        "table_schema": "main", "table_name": n, "constraint_name": name, "constraint_type": kind, "column_name": col, "ordinal_position": pos,
        "parent_schema": parent[0], "parent_name": parent[1], "parent_column": parent[2]}
    rows = [c("o", "pk", "PRIMARY KEY", "b", 2), c("o", "pk", "PRIMARY KEY", "a"), c("o", "u", "UNIQUE", "x"), c("o", "f", "FOREIGN KEY", "a", 1, ("main", "p", "id")),
            c("o", "f2", "FOREIGN KEY", "a", 1, ("main", "q", "i")), c("o", "f2", "FOREIGN KEY", "b", 2, ("main", "q", "j"))]
    out = declared_assets([t("p", "VIEW"), t("o")], rows, [{"table_schema": "main", "table_name": "o", "column_name": "x"}], lambda s, n, k: spark.range(1))
    o, p = out
    assert (o.label, o.primary_key, o.unique, o.not_null, p.kind) == ("o", ("a", "b"), (("x",),), ("x",), "view")
    assert [(f.column, f.parent, f.parent_column) for f in o.foreign_keys] == [("a", "p", "id")]


def test_catalogue_tables(spark):
    spark.range(4).createOrReplaceTempView("numbers_here")
    assert "numbers_here" in {a.name for a in catalog_assets(spark)}


def test_report_as_json_lines(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report({"a": spark.range(2), "b": spark.sql("SELECT 'x' AS y")}, path)
    rows = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted((r["table"], str(r["row"])) for r in rows) == [("a", "{'id': 0}"), ("a", "{'id': 1}"), ("b", "{'y': 'x'}")]


def test_a_scan_recorded_twice_and_two_batches_in_one_second_keep_every_row(spark, tmp_path):
    root = str(tmp_path / "twice")
    scan, first = scan_and_record(spark, invoices(spark, True), root, "s0", ScanOptions(sample_rows=0, now=NOW))
    again = record_scan(scan, root)
    scan.release()
    assert again == first and len(sinks.snapshots(spark, root, "findings")) == 1
    state = sinks.read_snapshot(spark, root, "findings").filter(F.col("check_id") == CHECK).first()
    assert (state.status, state.occurrences) == ("open", 1)
    assert sinks.read_table(spark, root, "finding_events").count() == 1
    checks = sinks.read_snapshot(spark, root, "checks").collect()
    at = datetime(2026, 11, 1)
    schema = "check_id string, action string, version bigint, actor string, at timestamp_ntz"
    c = next(c for c in checks if c.status == "proposed")
    for stale in (0, 1):  # the second batch comes too late, but is a snapshot of its own
        assert change_checks(spark, root, spark.createDataFrame([(c.check_id, "approve", c.version, "ana", at)], schema), at).count() == stale
    after = sinks.read_snapshot(spark, root, "checks").collect()
    assert len(after) == len(checks) and len(sinks.snapshots(spark, root, "checks")) == 3


def test_a_writer_whose_base_has_moved_on_is_refused(spark, tmp_path):
    root = str(tmp_path / "race")
    one = sinks.write_snapshot(spark.range(2), root, "findings", "a", None)
    sinks.write_snapshot(spark.range(3), root, "findings", "b", one)
    with pytest.raises(RuntimeError):
        sinks.write_snapshot(spark.range(9), root, "findings", "c", one)
    assert sinks.read_snapshot(spark, root, "findings").count() == 3 and len(sinks.snapshots(spark, root, "findings")) == 2


def test_more_points_than_are_served_are_refused(spark):
    with pytest.raises(ValueError):
        history.score_history(spark.range(0).selectExpr("'a' AS asset", "'s' AS scan_id"), spark.range(0), limit=101)
