"""Rules with fixed meaning: planted cases, nulls, blanks and empty tables."""

import pytest

from plumbline.operators.rules import client_crossings, code_list, erp_rules, filled, mixed_types, schema_drift


def test_code_list(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("A",), ("",)], "v string")
    codes = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    assert sorted(tuple(r) for r in code_list(df, "v", codes, "c").collect()) == [("", 1), ("A", 1), ("b", 2)]
    assert code_list(df.limit(0), "v", codes, "c").collect() == []
    assert code_list(df, "v", codes.limit(0), "c").count() == 4
    numbers = spark.createDataFrame([(1,), (7,)], "v int")
    assert [tuple(r) for r in code_list(numbers, "v", spark.createDataFrame([(1,)], "c long"), "c").collect()] == [("7", 1)]


def test_mixed_types(spark):
    rows = [("1", "x", None, str(i)) for i in range(3)] + [("-2,5", "3", " ", "1.000.000"), ("word", "y", "", "9"), ("1a", None, None, "-1")]
    df = spark.createDataFrame(rows, "half string, `few.er` string, none string, all string").selectExpr("*", "1 AS number")
    got = {r["column"]: (r.evaluated, r.numbers, r.mixed) for r in mixed_types(df).collect()}
    assert got == {"half": (6, 4, True), "few.er": (5, 1, False), "none": (0, 0, False), "all": (6, 6, False)}
    assert mixed_types(df.select("number")).collect() == []
    assert [(r.share, r.mixed) for r in mixed_types(df.limit(0), ["half"]).collect()] == [(None, False)]


def test_schema_drift(spark):
    before = spark.sql("SELECT 1 AS kept, 1 AS gone, 1 AS retyped, 1 AS emptied, CAST(NULL AS INT) AS filled")
    after = spark.sql("SELECT 2 AS kept, 'x' AS retyped, CAST(NULL AS INT) AS emptied, 5 AS filled, true AS `new.one`")
    got = {r["column"]: (r.change, r.type_before, r.type_after) for r in schema_drift(filled(before), filled(after)).collect()}
    assert got == {"gone": ("removed", "int", None), "retyped": ("retyped", "int", "string"), "emptied": ("emptied", "int", "int"), "filled": ("filled", "int", "int"), "new.one": ("added", None, "boolean")}
    assert schema_drift(filled(before), filled(before)).collect() == []
    assert {r.filled for r in filled(before.limit(0)).collect()} == {0}


def test_erp_rules(spark):
    rows = [
        ("20240229", "007", 5.0, "EUR", 1, None, "X"), ("20230229", "7", 5.0, " ", 0, None, " "), ("00000000", "42", 0.0, None, None, "KG", None), (None, "A1", None, None, 3, "", ""),
        ("2024-1-1", "0", -1.0, None, 2, "PC", "X"), (" ", None, 1.0, "USD", 2, "PC", "x"),
    ]
    df = spark.createDataFrame(rows, "day string, key string, amount double, curr string, many int, unit string, gone string")
    arguments = (["day"], ["key"], {"amount": "curr"}, {"many": "unit"}, ["gone"])
    got = {r.rule: (r["column"], r.evaluated, r.failed) for r in erp_rules(df, *arguments).collect()}
    assert got == {
        "dates_valid": ("day", 3, 2), "zero_padding": ("key", 4, 2), "currency_missing": ("amount", 4, 2), "unit_missing": ("many", 4, 2), "deletion_share": ("gone", 6, 3),
    }
    assert {(r.evaluated, r.failed) for r in erp_rules(df.limit(0), *arguments).collect()} == {(0, 0)}
    assert erp_rules(df).collect() == []


def test_client_crossings(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "lost"), (2, None), (None, "a"), (3, "both"), (4, "both")], "client int, ref string")
    parent = spark.createDataFrame([("a", 1), ("a", 1), ("both", 3), ("both", 4), (None, 2)], "id string, owner int")
    got = {r.client: (r.evaluated, r.failed) for r in client_crossings(child, "ref", "client", parent, "id", "owner").collect()}
    assert got == {1: (2, 0), 2: (2, 1), None: (1, 1), 3: (1, 0), 4: (1, 0)}
    assert client_crossings(child.limit(0), "ref", "client", parent, "id", "owner").collect() == []


@pytest.mark.parametrize("text, day", [("20240101", True), ("20241301", False), ("2024011", False), ("+2024010", False)])
def test_text_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "d string")
    assert [(r.evaluated, r.failed) for r in erp_rules(df, ["d"]).collect()] == [(1, 0 if day else 1)]
