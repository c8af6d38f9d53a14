"""Checks across scans, columns and tables: planted cases, edges and refusals."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.custom import CustomCheck, RefusedCheck, custom_checks, custom_failing_rows, refused
from plumbline.operators.drift import categorical_shift, numeric_shift
from plumbline.operators.duplicates import Field, normalised_duplicates, record_links
from plumbline.operators.explain import explain_failures
from plumbline.operators.relations import aggregate_balance, functional_dependencies, overlapping_columns
from plumbline.operators.running import running
from plumbline.operators.trends import metric_anomaly, time_series, volume_trend
from plumbline.sources.sinks import read_snapshot, snapshots, write_snapshot


def test_running_sums_cross_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id")).alias("x"), F.lit(2).alias("w")).repartition(7)
    got = running(rows.where("x is not null"), ["g"], ["x"], {"upto": F.col("w")}, ahead="x").orderBy("g", "x").collect()
    for g in range(3):
        xs = [i for i in range(5000) if i % 3 == g and i % 50]
        mine = [r for r in got if r.g == g]
        assert [r.upto for r in mine] == [2 * (i + 1) for i in range(len(xs))] and [r.next for r in mine] == [*xs[1:], None]


def test_numeric_shift(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    b = spark.range(500).select((F.col("id") % 100 + 50).cast("double").alias("x"), F.lit(3.0).alias("same"), F.lit(1.0).alias("none"))
    got = {r["column"]: r for r in numeric_shift(a.unionByName(spark.range(1).select(F.lit(float("nan")).alias("x"), F.lit(float("inf")).alias("same"), F.lit(None).cast("double").alias("none"))), b, ["x", "same", "none"]).collect()}
    assert set(got) == {"x", "same"}
    assert got["x"].wasserstein == pytest.approx(50) and got["x"].ks == pytest.approx(0.5) and got["x"].shifted and (got["x"].n_before, got["x"].n_after) == (1000, 500)
    assert (got["same"].wasserstein, got["same"].ks, got["same"].shifted) == (0, 0, False)
    assert numeric_shift(a.limit(0), b, ["x"]).collect() == []


def test_categorical_shift(spark):
    rng = random.Random(4)
    frame = lambda w, n: spark.createDataFrame([(rng.choices("abcd", w)[0], "z") for _ in range(n)], "c string, k string")
    base, same, moved = frame([4, 3, 2, 1], 4000), frame([4, 3, 2, 1], 4000), frame([1, 3, 2, 4], 4000)
    assert [r.shifted for r in categorical_shift(base, same, ["c", "k"]).orderBy("column").collect()] == [False, False]
    r = categorical_shift(base, moved, ["c"]).first()
    assert r.shifted and 0 < r.js < 1 and r.psi > r.psi_critical
    # The 99 % point of chi-square with 3 degrees is 11.345.
    assert r.psi_critical == pytest.approx(11.345 * 2 / 4000, rel=5e-3)
    apart = categorical_shift(base.where("c = 'a'"), base.where("c = 'b'"), ["c"]).first()
    assert apart.js == pytest.approx(1.0)


def test_metric_anomaly_keeps_its_rate_and_finds_a_break(spark):
    rng = random.Random(9)
    rows = [(f"s{s}", date(2024, 1, 1) + timedelta(days=d), 100 + 10 * (d % 7) + rng.gauss(0, 2)) for s in range(20) for d in range(120)]
    clean = metric_anomaly(spark.createDataFrame(rows, "series string, at date, value double"), alpha=0.05).collect()
    judged = [r for r in clean if r.p_value is not None]
    assert len(judged) > 1500 and sum(r.anomaly for r in judged) / len(judged) < 0.07
    broken = [(s, at, v + (60 if at == date(2024, 4, 20) else 0)) for s, at, v in rows] + [("s0", date(2024, 9, 1), None), ("short", date(2024, 1, 1), 1.0)]
    found = {(r.series, r.at) for r in metric_anomaly(spark.createDataFrame(broken, "series string, at date, value double"), alpha=0.05).where("anomaly").collect()}
    assert {(f"s{s}", date(2024, 4, 20)) for s in range(20)} <= found and not any(s == "short" for s, _ in found)


def test_volume_trend_names_missing_low_and_late_days(spark):
    days = [datetime(2024, 1, 1) + timedelta(days=d) for d in range(28)]
    rows = [(t,) for t in days for _ in range(2 if t.day == 24 else 10) if t.day != 20] + [(None,)]
    got = {r.day.day: r for r in volume_trend(spark.createDataFrame(rows, "t timestamp_ntz"), "t", until=date(2024, 1, 30)).collect()}
    assert {d: r.state for d, r in got.items() if r.state not in ("ok", "new")} == {20: "missing", 24: "low", 29: "missing", 30: "missing"}
    assert got[20].n == 0 and got[20].expected == 10 and sorted(d for d, r in got.items() if r.state == "new") == list(range(1, 8))


def test_time_series_is_ordered_within_and_across_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b", None]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(500)), float(rng.randrange(9))) for _ in range(4000)] + [("b", None, 1.0)]
    got = time_series(spark.createDataFrame(rows, "k string, t timestamp_ntz, v double").repartition(5), "k", "t", "v")
    seen = [(r.series, r.at, r.value) for r in got.toLocalIterator()]
    assert seen == sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    places = defaultdict(list)
    for r in got.toLocalIterator():
        places[r.series].append(r.place)
    assert all(p == list(range(1, len(p) + 1)) for p in places.values())


def test_explanation_names_the_planted_segment(spark):
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        country, channel, flag = rng.choice(["FR", "DE", "AT", None]), rng.choice(["web", "shop"]), rng.choice("xy")
        bad = rng.random() < (0.8 if (country, channel) == ("FR", "web") else 0.01)
        rows.append((country, channel, flag, None if bad and i % 2 else bad))
    df = spark.createDataFrame(rows, "country string, channel string, flag string, bad boolean")
    got = explain_failures(df, F.col("bad"), ["country", "channel", "flag"], support=0.3, lift=1.5, width=3).collect()
    assert got[0].segment == "country=FR & channel=web" and got[0].lift > 5 and not any("flag" in r.segment for r in got)
    fr = [r for r in rows if r[:2] == ("FR", "web")]
    assert (got[0].failing, got[0].rows) == (sum(r[3] is True for r in fr), len(fr))
    assert explain_failures(df, F.lit(False), ["country"]).collect() == [] and explain_failures(df.limit(0), F.col("bad"), ["country"]).collect() == []


def test_dependencies_against_plain_counts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        city = rng.choice(["Berlin", "Hamburg", "Wien", "Graz", None])
        land = {"Berlin": "DE", "Hamburg": "DE", None: None}.get(city, "AT")
        rows.append((i, city, land if rng.random() > 0.02 else "FR", rng.choice("abc"), "const"))
    df = spark.createDataFrame(rows, "id long, city string, land string, other string, fix string")
    got = {(r.determinant, r.dependent): r for r in functional_dependencies(df, df.columns, error=0.05).collect()}
    assert set(got) == {("city", "land")}
    groups = defaultdict(Counter)
    for r in rows:
        groups[r[1]][r[2]] += 1
    assert got["city", "land"].error == pytest.approx(1 - sum(max(c.values()) for c in groups.values()) / 1500)
    assert functional_dependencies(df.limit(0), df.columns).collect() == []


def test_overlaps(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("none"))
    b = spark.range(1000, 3000).select(F.col("id").cast("string").alias("ref"), (F.col("id") + 4500).alias("half"))
    got = {(r.left_column, r.right_column): r for r in overlapping_columns({"a": a, "b": b}, {"a": ["k", "none"], "b": ["ref", "half"]}, sketch=256).collect()}
    assert set(got) == {("ref", "k")} and (got["ref", "k"].shared, got["ref", "k"].containment, got["ref", "k"].jaccard) == (2000, 1.0, 0.4)


def test_balance_of_both_sides(spark):
    child = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 5.0), (3, 1.0), (3, None), (None, 9.0), (9, 4.0)], "fk long, amount double")
    parent = spark.createDataFrame([(1, 0.3), (2, 6.0), (3, 1.005), (4, 2.0), (5, 0.0), (6, None), (None, 1.0)], "id long, total double")
    got = {r.key: (r.state, r.difference) for r in aggregate_balance(child, "fk", "amount", parent, "id", "total").collect()}
    assert {k: s for k, (s, _) in got.items()} == {1: "balanced", 2: "differs", 3: "balanced", 4: "no_child", 5: "balanced", 6: "balanced", 9: "no_parent"}
    assert got[1][1] == 0.0 and got[2][1] == -1.0


def test_custom_checks_and_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "x long, s string")
    got = {r.check_id: r for r in custom_checks(df, [CustomCheck("big", "x > 2", 0.5), CustomCheck("null_is_no_failure", "s > 'b'"), CustomCheck("never", "x < 0")]).collect()}
    assert {k: (r.evaluated, r.failed, r.ratio, r.passed) for k, r in got.items()} == {"big": (4, 2, 0.5, True), "null_is_no_failure": (4, 2, 0.5, False), "never": (4, 0, 1.0, True)}
    assert [r.x for r in custom_failing_rows(df, CustomCheck("big", "x > 2")).collect()] == [3, 4]
    df.createOrReplaceTempView("some_rows")
    for bad in ("y > 1", "x +", "x + 1", "rand() > 0.5", "x > (SELECT max(x) FROM some_rows)", "count(*) > 1", "now() > '2020-01-01'", "explode(array(true))"):
        assert refused(df, CustomCheck("bad", bad)), bad
    with pytest.raises(RefusedCheck, match="bad"):
        custom_checks(df, [CustomCheck("bad", "y > 1")])
    assert custom_checks(df.limit(0), [CustomCheck("big", "x > 2")]).first().ratio == 1.0


def test_normalised_duplicates(spark):
    df = spark.createDataFrame([("Berlin",), ("Berlin",), ("BERLIN ",), ("ber-lin",), ("Wien",), (None,), ("--",)], "city string")
    r = normalised_duplicates(df, ["city"]).collect()
    assert [tuple(x) for x in r] == [("city", "berlin", 3, 4, 2)]


def test_record_links_find_planted_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, planted = [], set()
    for i in range(600):
        rows.append((i, f"{word(6)} {word(8)}", rng.choice(["Berlin", "Wien", "Graz"]), f"{rng.randrange(10**8):08d}", word(5)))
    for i in range(120):
        k, name, city, phone, mail = rows[i]
        wrong = rng.randrange(3)
        rows.append((1000 + i, (name[:-1] + "#" if wrong == 0 else name).upper(), city if wrong != 1 else "Linz", phone if wrong != 2 else None, mail))
        planted.add((i, 1000 + i))
    rows += [(5000, *rows[3][1:]), (None, "x", "y", "z", "w")]
    df = spark.createDataFrame(rows, "id long, name string, city string, phone string, mail string")
    fields = [Field("name", edits=2), Field("city"), Field("phone"), Field("mail")]
    got = record_links(df, "id", fields, [["phone"], ["mail"], ["city"]], block_size=60).collect()
    found = {(r.left, r.right) for r in got}
    assert len(planted & found) >= 0.95 * 120 and len(found - planted - {(3, 5000), (1003, 5000)}) <= 3
    assert [r for r in got if r.pattern == "="] == [r for r in got if (r.left, r.right) == (3, 5000)]
    assert record_links(df.limit(0), "id", fields, [["phone"]]).collect() == []


def test_a_dead_writers_claim_does_not_lock_the_state(spark, tmp_path):
    root, df = str(tmp_path), spark.range(3)
    base = write_snapshot(df, root, "checks", "a", None)
    folder = tmp_path / "state" / "checks"
    # It claimed the next number and had written all, but was never moved: it is finished, and this writer must read again.
    df.write.parquet(str(folder / "pending-dead"))
    (folder / "claims" / "000000000002").write_text("pending-dead 000000000002-b")
    with pytest.raises(RuntimeError, match="have changed"):
        write_snapshot(spark.range(9), root, "checks", "c", base)
    assert snapshots(spark, root, "checks") == [base, "000000000002-b"] and read_snapshot(spark, root, "checks").count() == 3
    # A claim of nothing is taken over.
    (folder / "claims" / "000000000003").write_text("pending-gone 000000000003-c")
    assert write_snapshot(spark.range(9), root, "checks", "c", "000000000002-b") == "000000000003-c" and read_snapshot(spark, root, "checks").count() == 9
    with pytest.raises(RuntimeError, match="have changed"):
        write_snapshot(df, root, "checks", "d", "000000000002-b")


def test_dependencies_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    from plumbline import session

    df = spark.range(3000).selectExpr("id", "id % 40 AS city", "(id % 40) % 7 AS state", "IF(id % 3 = 0, NULL, 'x') AS note").repartition(1)
    want = functional_dependencies(df, df.columns, error=0.05).collect()
    assert [(r.determinant, r.dependent, r.error) for r in want] == [("city", "state", 0.0)]
    monkeypatch.setattr(session, "CELLS_PER_TASK", 500)
    assert functional_dependencies(df, df.columns, error=0.05).collect() == want
    dealt = session.deal(df, 3000 * 4)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 24 and max(sizes) < 250 and sum(sizes) == 3000
    assert sorted(dealt.collect()) == sorted(df.collect()) and session.deal(df, 500) is df
