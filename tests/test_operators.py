import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.model import Asset
from plumbline.operators import profile as P
from plumbline.operators import quantiles as Q
from plumbline.operators.checks import new_spec
from plumbline.operators.evaluate import Store, copy_counts, count_checks, failing_rows, value_counts
from plumbline.operators.histogram import distinct_counts, held_histogram, text_values, top_k, value_hashes
from plumbline.plans.scan import histogram_of, profile_assets, ScanOptions
from shop import NOW


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows hold one value; the rest are spread widely."""
    rng = random.Random(3)
    return [7.0] * 700 + [rng.lognormvariate(0, 4) for _ in range(1400)] + [-3.0] * 5


def test_sorted_quantiles_equal_brute_force(spark, skewed):
    rows = [(c, float(x), n) for c, xs in ((0, skewed), (1, [5.0]), (2, [1.0, 2.0])) for x, n in Counter(xs).items()]
    rows += [(3, float(x), n) for x, n in ((1, 2), (1, 3), (1, 1), (2, 4), (2, 1))]  # values in several rows
    df = spark.createDataFrame(rows, "cid int, x double, n bigint").repartition(5)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    held = []
    got = {r.cid: r.q for r in Q.quantiles(df, probs, [0, 1, 2, 3], held).collect()}
    small = {r.cid: r.q for r in Q.quantiles(df, probs, []).collect()}
    for cid, xs in ((0, skewed), (1, [5.0]), (2, [1.0, 2.0]), (3, [1.0] * 6 + [2.0] * 5)):
        want = np.quantile(np.array(xs), probs)
        assert np.allclose(got[cid], want) and np.allclose(small[cid], want)
    assert held


def test_quantiles_of_known_ranges_sort_only_crowded_columns(spark, skewed, monkeypatch):
    """Bins hold few values, or all but one of them, or their width is no number: the same quantiles, the latter sorted."""
    far, wide = [*skewed, 1e30], [-1.7e308, *skewed, 1.7e308]
    columns = dict(enumerate((list(range(3000)), [float(x) / 7 for x in range(-900, 900)], far, wide, [5.0])))
    rows = [(c, float(x), n) for c, xs in columns.items() for x, n in Counter(xs).items()]
    df = spark.createDataFrame(rows, "cid int, x double, n bigint").repartition(5)
    ranges = spark.createDataFrame([(c, float(min(xs)), float(max(xs))) for c, xs in columns.items() if c != 1], "cid int, lo double, hi double")
    monkeypatch.setattr(Q, "SMALL_COLUMN", 200)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    for cids, is_sorted in (([0, 4], False), ([0, 1, 2, 3, 4], True)):
        held = []
        some = df.filter(F.col("cid").isin(cids))
        got = {r.cid: r.q for r in Q.quantiles(some, probs, cids, held, ranges).collect()}
        assert set(got) == set(cids) and bool(held) == is_sorted
        for c in cids:
            assert np.allclose(got[c], np.quantile(np.array(columns[c], dtype=float), probs)), c


def test_top_k_equals_brute_force_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(9)}", f"v{i:04d}", rng.randrange(6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v string, n bigint").repartition(6)
    got = top_k(df, ["g"], [F.desc("n"), F.asc("v")], 7, F.col("v")).collect()
    for g in {r[0] for r in rows}:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:7]
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [(r.v, r["rank"]) for r in mine] == [(w[1], i + 1) for i, w in enumerate(want)]


def test_copies_survive_hash_collisions(spark, monkeypatch):
    """With every row in one of three hash groups, counts stay exact."""
    import plumbline.operators.evaluate as E

    rows = [(i % 40, f"t{i % 30}", None if i % 11 == 0 else i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    a = Asset("t", df)
    hist, meta, metas = histogram_of(spark, [a], {"t": df})
    st = Store(spark, {"t": a}, {"t": df}, {"t": False}, hist, meta, metas, NOW)
    specs = [new_spec("duplicate_rows", "t", columns=("a", "b", "c")), new_spec("unique", "t", columns=("a", "c"))]
    keyed = [(r[0], r[2]) for r in rows if r[2] is not None]
    want = {specs[0].id: (1000, 1000 - len(set(rows))), specs[1].id: (len(keyed), len(keyed) - len(set(keyed)))}
    for hashing in (E._row_hash, lambda s: F.pmod(F.xxhash64(*s.columns), F.lit(3))):
        monkeypatch.setattr(E, "_row_hash", hashing)
        assert {r.check_id: (r.n, r.k) for r in copy_counts(st, specs).collect()} == want


def test_non_finite_numbers_are_set_apart(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (3.0,), (None,)], "x double")
    p = profile_assets(spark, [Asset("t", df)], ScanOptions(sample_rows=0, now=NOW)).assets["t"].column("x")
    assert (p.rows, p.nulls, p.non_finite, p.min_number, p.max_number, p.mean) == (5, 1, 2, 1.0, 3.0, 2.0)


def test_every_type_is_profiled(spark):
    df = spark.sql("SELECT 1Y a, 1.50BD b, true d, 'x' e, DATE '2024-01-01' f, TIMESTAMP '2024-01-01 00:00:00' g, array(1) h, X'00' i, "
                   "CAST(NULL AS STRING) n, CAST(12345678901234567890 AS DECIMAL(20,0)) o FROM range(3)")
    out = profile_assets(spark, [Asset("t", df)], ScanOptions(sample_rows=0, now=NOW))
    cols = {c.column: c for c in out.assets["t"].columns}
    assert cols["h"].distinct is None and cols["h"].nulls == 0 and cols["n"].nulls == 3
    assert cols["b"].mean == 1.5 and cols["o"].logical_type == "integer" and cols["f"].newest == "2024-01-01"
    assert cols["g"].newest == "2024-01-01T00:00:00"
    top = {(r.cid, r.value): r.n for r in out.top.collect()}
    assert top[(cols["d"].cid, "true")] == 3 and top[(cols["f"].cid, "2024-01-01")] == 3 and top[(cols["b"].cid, "1.50")] == 3


def test_plans_stay_free_of_python_and_cross_joins(spark):
    df = spark.range(100).selectExpr("id", "cast(id AS STRING) AS s", "id / 3.0D AS x")
    st = stored_as(spark, {"t": df})
    cells = st.cells({m.cid for m in st.metas})
    plan = P.basic_measures(cells, distinct_counts(value_hashes(cells)), st.meta, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # Columns, value hashes and their counts: nothing is shuffled by value, and every aggregate is a hash aggregate.
    assert plan.count("Exchange hashpartitioning") == 3 and "SortAggregate" not in plan
    assert not re.search(r"hashpartitioning\([^)]*\b[sid]#", plan)


def test_value_checks_shuffle_one_row_per_column(spark):
    df = spark.range(100).selectExpr("id", "concat('v', id % 7) AS s", "id / 3.0D AS x")
    st = stored_as(spark, {"t": df})
    specs = [new_spec("not_null", "t", "s"), new_spec("whitespace", "t", "s"), new_spec("range", "t", "x", params={"min": 1.0, "max": 9.0})]
    counts = value_counts(st, specs)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan and "hashpartitioning(cid" in plan
    assert {r.check_id.split(":")[0]: (r.n, r.k) for r in counts.collect()} == {"not_null": (100, 0), "whitespace": (100, 0), "range": (100, 75)}


def test_repeats_are_counted_by_value_hashes(spark):
    df = spark.createDataFrame([(None, 0.0), ("a", -0.0), ("a", float("nan")), ("b", float("nan")), ("a", 1.0)], "s string, x double")
    st = stored_as(spark, {"t": df, "none": df.limit(0)})
    specs = [new_spec("unique", t, c) for t in ("t", "none") for c in ("s", "x")]
    got = {(r.check_id): (r.n, r.k) for r in count_checks(st, specs, {}).collect()}
    assert got == {"unique:t:s": (4, 2), "unique:t:x": (5, 2), "unique:none:s": (0, 0), "unique:none:x": (0, 0)}


def stored_as(spark, tables, sampled=()):
    """A store whose sampled tables were read in half."""
    assets = [Asset(n, df) for n, df in tables.items()]
    read = {n: df.limit(df.count() // 2) if n in sampled else df for n, df in tables.items()}
    hist, meta, metas = histogram_of(spark, assets, read)
    return Store(spark, {a.label: a for a in assets}, read, {n: n in sampled for n in tables}, hist, meta, metas, NOW)


def test_failing_rows_of_float_keys_and_samples_are_those_of_the_full_table(spark):
    child = spark.range(200).selectExpr("id", "CAST(id AS FLOAT) / 10 AS k", "CASE WHEN id % 40 = 39 THEN 'berlin' ELSE 'Berlin' END AS city")
    parent = spark.range(110).selectExpr("CAST(id AS FLOAT) / 10 AS k")
    whole = stored_as(spark, {"c": child, "p": parent})
    reference = new_spec("foreign_key", "c", "k", params={"parent": "p", "parent_column": "k"})
    assert failing_rows(whole, reference).count() == 90
    half = stored_as(spark, {"c": child, "p": parent}, sampled=("c",))
    assert failing_rows(half, reference).count() == 90
    assert failing_rows(half, new_spec("casing_variants", "c", "city")).count() == 5


def test_column_numbers_never_meet(spark):
    """A very wide table beside one that cannot be read: every table keeps its own counts."""
    wide = spark.range(24).select("id", *[F.lit(1).alias(f"c{i}") for i in range(1002)])
    small = spark.range(7).selectExpr("id AS only_id", "'x' AS t")
    broken = spark.range(3).selectExpr("IF(id >= 0, raise_error('no'), 1) AS bad")
    p = profile_assets(spark, [Asset("wide", wide), Asset("broken", broken), Asset("small", small)], ScanOptions(sample_rows=0, now=NOW))
    assert p.assets["broken"].error and p.assets["small"].column("t").rows == 7 and p.assets["wide"].column("c1001").rows == 24


def test_types_do_not_depend_on_the_number_of_values(spark):
    """Most values are addresses, but the first by text are not."""
    mails = spark.range(20_000).selectExpr("IF(id < 1100, concat('#', lpad(id, 6, '0')), concat('user', id, '@example.org')) AS mail")
    p = profile_assets(spark, [Asset("t", mails)], ScanOptions(sample_rows=0, now=NOW)).assets["t"].column("mail")
    assert p.semantic_type == "email" and p.personal


def test_a_held_histogram_is_read_on_both_sides_of_a_join(spark, tmp_path):
    from entry_queries.views import table

    at = F.lit("2020-01-01").cast("timestamp_ntz").alias("o_orderdate")
    orders = spark.range(100).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), (F.col("id") * 0.5).alias("o_totalprice"), F.lit("O").alias("o_orderstatus"), at)
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    a = Asset("dirty_orders", table(spark, str(tmp_path), "dirty_orders").select("amount"))
    assert a.df.count() == 110
    hist, meta, _ = histogram_of(spark, [a], {"dirty_orders": a.df})
    hist = hist.persist()
    both = hist.join(hist.groupBy("cid").agg(F.count(F.lit(1)).alias("m")), "cid")
    shown = both._jdf.queryExecution().optimizedPlan().toString()
    by_rows = P.basic_measures(hist, None, meta, NOW).collect()
    by_hash = P.basic_measures(hist, distinct_counts(value_hashes(hist)), meta, NOW).select(by_rows[0].__fields__).collect()
    hist.unpersist()
    assert re.search(r"(?<!InMemory)Relation \[", shown) is None
    assert by_rows == by_hash and by_rows[0]["distinct"] == 100


def test_a_pass_over_some_columns_skips_held_batches_of_the_others(spark):
    df = spark.range(40_000).selectExpr("id", "id * 0.5 AS amount", "concat('t', id % 7) AS kind").repartition(1)
    hist, meta, _ = histogram_of(spark, [Asset("t", df)], {"t": df})
    hist = held_histogram(hist.coalesce(1))
    try:
        assert hist.count() == 80_007
        values = text_values(hist, meta)
        assert sorted((r.value, r.n) for r in values.collect()) == [(f"t{k}", len(range(k, 40_000, 7))) for k in range(7)]
        plan = values._jdf.queryExecution().executedPlan()
        shown = plan.toString()
        assert re.search(r"InMemoryTableScan \[[^]]*\], \[[^]]*cid#\d+ = 2", shown), shown
        x = {r.cid: r.n for r in P.number_values(hist, meta).groupBy("cid").agg(F.sum("n").alias("n")).collect()}
        assert x == {0: 40_000, 1: 40_000}
    finally:
        hist.unpersist()


def test_tables_of_texts_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    from plumbline import session
    from plumbline.operators.histogram import deal_texts

    texts = spark.range(2000).selectExpr("concat('a', id) AS a", "concat('b', id % 5) AS b").repartition(1)
    numbers = spark.range(2000).selectExpr("id", "id % 3 AS k", "concat('c', id % 2) AS c").repartition(1)
    assets = [Asset("texts", texts), Asset("numbers", numbers)]
    read = {a.label: a.df for a in assets}
    hist, meta, metas = histogram_of(spark, assets, read)
    want = sorted(hist.collect(), key=repr)
    assert len(want) == 2000 + 5 + 2000 + 3 + 2
    monkeypatch.setattr(session, "CELLS_PER_TASK", 400)
    (t, _), (n, _) = deal_texts([(read[a.label], [m for m in metas if m.asset == a.label]) for a in assets])
    assert n is numbers and t.rdd.getNumPartitions() == 10
    assert max(r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect()) < 400
    hist, _, _ = histogram_of(spark, assets, read)
    assert sorted(hist.collect(), key=repr) == want
    hist = held_histogram(hist)  # dealt rows are found again on the second side of a join
    shown = hist.join(hist.groupBy("cid").agg(F.count(F.lit(1)).alias("m")), "cid")._jdf.queryExecution().optimizedPlan().toString()
    hist.unpersist()
    assert shown.count("InMemoryRelation") == 2


def test_narrow_keys_are_counted_without_a_pass_over_their_hashes(spark, monkeypatch):
    """A key of a few numbers is grouped once, by its values; parts that are null are left out of a key, and equal in a row."""
    import plumbline.operators.evaluate as E

    rows = [(i % 40, None if i % 11 == 0 else i % 4, f"t{i % 30}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, c int, b string")
    a = Asset("t", df)
    hist, meta, metas = histogram_of(spark, [a], {"t": df})
    st = Store(spark, {"t": a}, {"t": df}, {"t": False}, hist, meta, metas, NOW)
    specs = [new_spec("unique", "t", columns=("a", "c")), new_spec("duplicate_rows", "t", columns=("a", "c"))]
    monkeypatch.setattr(E, "_row_hash", None)
    got = {r.check_id: (r.n, r.k) for r in copy_counts(st, specs).collect()}
    keys, full = [x[:2] for x in rows if x[1] is not None], [x[:2] for x in rows]
    assert got == {s.id: (len(xs), len(xs) - len(set(xs))) for s, xs in zip(specs, (keys, full))}
