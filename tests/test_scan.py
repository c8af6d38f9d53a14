from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from shop import NOW, assets, frames

from plumbline import Asset, CheckType, failing_rows, new_spec, register_check, register_semantic_type
from plumbline.functions import semantics
from plumbline.model import CheckSpec
from plumbline.operators import checks, evaluate
from plumbline.operators.accuracy import locked_baselines
from plumbline.plans.scan import ScanOptions, run_scan, scan_statistics

FULL = ScanOptions(sample_rows=0, now=NOW)


@pytest.fixture(scope="module")
def faulty(spark):
    return run_scan(spark, assets(spark, faulty=True), FULL)


@pytest.fixture(scope="module")
def clean(spark):
    return run_scan(spark, assets(spark), FULL)


def failed(scan):
    return {r.check_id: r.failed for r in scan.results.filter("failed > 0").collect()}


def test_every_rule_finds_its_fault_and_counts_it_exactly(spark, faulty):
    rows = {n: df.collect() for n, df in frames(spark, faulty=True).items()}
    c, o, i = rows["customers"], rows["orders"], rows["invoices"]
    ids = {r.id for r in c}
    want = {
        "not_null:customers:email": sum(r.email is None for r in c),
        "not_null:orders:customer_id": sum(r.customer_id is None for r in o),
        "not_blank:customers:email": sum(r.email == "N/A" for r in c),
        "semantic_format:customers:email": sum(r.email == "N/A" for r in c),
        "semantic_format:customers:iban": sum(r.id % 60 == 31 for r in c),
        "semantic_format:invoices:vat_id": sum(r.vat_id == "DE12345" for r in i),
        "whitespace:customers:city": sum(r.city != r.city.strip(" ") for r in c),
        "non_printing:customers:name": sum("​" in r.name for r in c),
        "casing_variants:customers:city": sum(r.city in (" Berlin", "berlin") for r in c),
        "future_dates:customers:created_at": 1,
        "implausible_dates:customers:created_at": 1,
        "foreign_key:orders:customer_id": sum(r.customer_id is not None and r.customer_id not in ids for r in o),
        "foreign_key:invoices:order_id": sum(r.order_id not in {x.id for x in o} for r in i),
        "unique:orders:id": len(o) - len({r.id for r in o}),
        "duplicate_rows:orders": len(o) - len(set(o)),
        "outliers:orders:amount": sum(r.amount >= 20000 for r in o),
        "column_order:orders:ordered_at,shipped_at": sum(r.ordered_at > r.shipped_at for r in o),
        "type_conformance:invoices:total": sum(r.total == "twelve" for r in i),
        "row_count:returns:": 1,
    }
    got = {k if not k.startswith("duplicate_rows") else k.rsplit(":", 1)[0]: v for k, v in failed(faulty).items()}
    assert got == {k: v for k, v in want.items() if v}
    assert all(want.values())


def test_findings_carry_evidence(faulty):
    f = {r.check_id: r for r in faulty.findings.collect()}
    iban = f["semantic_format:customers:iban"]
    assert len(iban.examples) == 5 and all(e.masked and "•" in e.value for e in iban.examples) and iban.summary and iban.next_step
    spelled = f["casing_variants:customers:city"].examples
    assert {e.value for e in spelled} == {" Berlin", "berlin"} and not spelled[0].masked
    assert f["unique:orders:id"].examples[0].value == "99" and f["unique:orders:id"].examples[0].n == 3
    ranks = [r.severity_rank for r in faulty.findings.collect()]
    assert ranks == sorted(ranks)


def test_baselines_only_propose_at_first(faulty):
    kinds = {(r.kind, r.status) for r in faulty.results.collect()}
    assert kinds == {("rule", "active"), ("baseline", "proposed")}


def test_clean_twin_is_silent_and_scores_100(clean):
    assert failed(clean) == {} and clean.findings.count() == 0
    overall = clean.scores.filter("level = 'store' AND dimension = 'overall'").first()
    assert (overall.value, overall.low, overall.high) == (100.0, 100.0, 100.0)


def test_scores_are_bounded_and_cover_the_store(faulty):
    rows = faulty.scores.collect()
    assert all(0 <= r.low <= r.value <= r.high <= 100 for r in rows)
    assert {r.asset for r in rows if r.level == "table"} == set(faulty.profiled.assets)


def test_drift_breaks_locked_baselines(spark, clean):
    saved = locked_baselines(clean.specs)
    drift = run_scan(spark, assets(spark, drift=True), ScanOptions(sample_rows=0, now=NOW + timedelta(days=1)), saved=saved)
    got = failed(drift)
    assert got["accepted_values:orders:status"] == 20 and got["pattern:products:sku"] == 5 and got["length:customers:name"] == 5
    assert got["range:orders:amount"] == 10 and got["freshness:events:occurred_at"] == 1 and got["range:events:occurred_at"] > 0


@pytest.mark.parametrize("form", ["faulty", "drift"])
def test_a_scan_counts_only_what_its_profile_does_not_tell(spark, clean, monkeypatch, form):
    seen, real = [], evaluate.value_counts
    monkeypatch.setattr(evaluate, "value_counts", lambda store, specs: seen.extend(specs) or real(store, specs))
    saved = locked_baselines(clean.specs) if form == "drift" else None
    scan = run_scan(spark, assets(spark, **{form: True}), ScanOptions(sample_rows=0, now=NOW, examples=False), saved=saved)
    again = [s.type for s in seen]
    assert set(again) <= {"outliers"} | ({"length", "pattern", "accepted_values", "range"} if saved else set())
    want = {r.check_id: (r.n, r.k) for r in evaluate.count_checks(scan.profiled.store, scan.specs, scan.profiled.populations).collect()}
    got = {r.check_id: (r.evaluated, r.failed) for r in scan.results.collect()}
    assert got == {check: want[check] for check in got} and len(again) < len(got) / 4


def test_sampled_scan_has_intervals_that_hold_the_truth(spark, faulty):
    s = run_scan(spark, assets(spark, faulty=True), ScanOptions(sample_rows=400, seed=3, now=NOW, examples=False))
    orders = s.assets.filter("asset = 'orders'").first()
    assert orders.sampled and 300 < orders.sample_rows < 500 and orders.population == 1205
    rows = s.results.filter("asset = 'orders' AND type = 'not_null' AND column = 'customer_id'").first()
    truth = faulty.results.filter(F.col("check_id") == rows.check_id).first()
    assert rows.low < rows.high and rows.population == 1205 and rows.low <= truth.ratio <= rows.high


def test_samples_by_key_do_not_depend_on_the_layout(spark):
    a = [x for x in assets(spark, declared=True) if x.name == "orders"][0]
    options = ScanOptions(sample_rows=300, by_key=True, now=NOW, examples=False)
    many = Asset("orders", a.df.repartition(7), primary_key=("id",))
    first, second = (run_scan(spark, [x], options).assets.first().sample_rows for x in (a, many))
    assert first == second


def test_saved_checks_through_a_scan(spark):
    mine = [a for a in assets(spark) if a.name in ("orders", "customers")]
    locked = new_spec("range", "orders", "amount", params={"min": 30.0, "max": 90.0}, origin="generated", status="locked")
    gone = new_spec("range", "orders", "discount", params={"min": 0.0, "max": 9.0}, status="locked")
    orphan = new_spec("foreign_key", "orders", "product_id", params={"parent": "products", "parent_column": "id"}, status="locked")
    strange = CheckSpec("odd:orders:x", "odd", "orders", "validity", "low", "manual", "active", origin="manual")
    retired = new_spec("accepted_values", "orders", "status", params={"values": ["paid"]}, status="retired")
    s = run_scan(spark, mine, FULL, saved=[locked, gone, orphan, strange, retired])
    ids = {r.check_id: r for r in s.results.collect()}
    assert ids[locked.id].failed == sum(not 30 <= 20 + i % 91 <= 90 for i in range(1200)) and not ids[locked.id].passed
    assert {(x.id, why) for x, why in s.unevaluated} == {(gone.id, "column_missing"), (orphan.id, "parent_missing"), (strange.id, "unknown_type")}
    assert retired.id not in ids and gone.id in {r.check_id for r in s.check_specs.collect()}


def test_weak_inferred_references_are_dropped_unless_kept(spark):
    parents = Asset("customers", spark.range(50).toDF("id"))
    children = Asset("visits", spark.range(200).selectExpr("id", "id * 2 AS customer_id"))
    assert not [r for r in run_scan(spark, [parents, children], FULL).results.collect() if r.type == "foreign_key"]
    kept = new_spec("foreign_key", "visits", "customer_id", params={"parent": "customers", "parent_column": "id", "inferred": True})
    r = run_scan(spark, [parents, children], FULL, saved=[kept]).results.filter("type = 'foreign_key'").first()
    assert (r.evaluated, r.failed) == (200, 175)


def test_references_of_different_types_compare_as_text(spark):
    parents = Asset("customers", spark.range(100).toDF("id"))
    children = Asset("invoices", spark.range(200).selectExpr("id", "cast(CASE WHEN id % 20 = 0 THEN id + 1000 ELSE id % 100 END AS STRING) AS customer_id"))
    for rows in (0, 120):
        s = run_scan(spark, [parents, children], ScanOptions(sample_rows=rows, now=NOW))
        r = s.results.filter("type = 'foreign_key'").first()
        assert r.failed / r.evaluated == pytest.approx(0.05, abs=0.05) and (rows or (r.evaluated, r.failed) == (200, 10))


def test_a_table_that_cannot_be_read_is_recorded_and_the_scan_goes_on(spark):
    bad = Asset("broken", spark.range(5).select(F.assert_true(F.col("id") < 2).alias("x"), "id"))
    s = run_scan(spark, [bad, Asset("good", spark.range(3).toDF("id"))], FULL)
    rows = {r.asset: r for r in s.assets.collect()}
    assert rows["broken"].error and rows["good"].error is None and rows["good"].population == 3
    assert scan_statistics(s).first().assets_failed == 1


def test_hostile_names_and_values(spark):
    name = 'a`b"c\'d.e'
    df = spark.createDataFrame([("x'; DROP TABLE t; --",), ("`",), (None,)], f"`{name.replace('`', '``')}` string")
    s = run_scan(spark, [Asset('we.ird "t"', df)], FULL)
    r = s.results.filter("type = 'not_null'").first()
    assert (r.column, r.evaluated, r.failed) == (name, 3, 1) and r.asset == '"we.ird ""t"""'


def test_failing_rows_match_the_counts(spark, faulty):
    st = faulty.profiled.store
    counts = failed(faulty)
    for s in faulty.specs:
        if counts.get(s.id) and s.type not in ("row_count", "unique", "duplicate_rows", "freshness"):
            assert failing_rows(st, s).count() == counts[s.id], s.id
    unique = next(s for s in faulty.specs if s.id == "unique:orders:id")
    assert failing_rows(st, unique).selectExpr("sum(copies - 1) AS k").first().k == counts[unique.id]


def test_registries_accept_new_types(spark):
    register_semantic_type("sku", lambda v: v.rlike("^SKU-[0-9]{5}$"), label="SKU")
    register_check(CheckType("even", "Odd numbers", "validity", "value", "are odd in", "Look.", applies=lambda c: c.column == "code",
                             fail=lambda v, p: v.number % 2 != 0))
    try:
        df = spark.range(60).selectExpr("id AS code", "concat('SKU-', lpad(cast(id AS STRING), 5, '0')) AS item")
        s = run_scan(spark, [Asset("t", df)], FULL)
        assert s.results.filter("type = 'even'").first().failed == 30
        assert s.profiled.assets["t"].column("item").semantic_type == "sku"
    finally:
        checks._REGISTRY.pop("even")
        semantics.FACTS.pop("sku")
        semantics.TESTS.pop("sku")


def test_masked_values_do_not_leak(faulty):
    shown = faulty.top.filter("asset = 'customers' AND column IN ('iban', 'email')").collect()
    assert shown and all(r.masked and "•" in r.value for r in shown)


def test_asset_filter(spark):
    s = run_scan(spark, assets(spark), ScanOptions(sample_rows=0, now=NOW, assets=("events",)))
    assert [r.asset for r in s.assets.collect()] == ["events"]
