import math

import pytest
from pyspark.sql import functions as F
from results import one

from plumbline.functions import intervals as I
from plumbline.functions import semantics as S
from plumbline.functions import text as X
from plumbline.model import canonical_json, label_of, logical_type


def value_of(spark, c):
    return one(spark.range(1).select(c.alias("v")))[0]


@pytest.mark.parametrize("value,pattern", [
    ("SKU-00012", "AAA-9{5+}"), ("München 1", "A{5+} 9"), ("a1b2", "A9A9"), ("", ""), ("12345678", "9{5+}"), ("Ünï", "AAA"), ("АБВГД", "A{5+}"), ("A9", "A9"),
])
def test_pattern_class(spark, value, pattern):
    assert value_of(spark, X.pattern_class(F.lit(value))) == pattern


@pytest.mark.parametrize("value,masked", [("DE89370400440532013000", "DE" + "•" * 18 + "00"), ("abc", "•••"), ("abcd", "••••"), ("abcde", "ab•de"), ("", "")])
def test_mask(spark, value, masked):
    assert value_of(spark, X.mask(F.lit(value))) == masked


@pytest.mark.parametrize("value,blank", [("", True), ("  \t", True), (" N/A ", True), ("NULL", True), ("--", True), ("?", True), ("nap", False), ("0", False)])
def test_blank(spark, value, blank):
    assert value_of(spark, X.is_blank(F.lit(value))) is blank


@pytest.mark.parametrize("value,number,date", [
    ("12", True, False), ("-1,5", True, False), (" +.5e-3 ", True, False), ("1.2.3", False, False), ("twelve", False, False),
    ("2024-01-31", False, True), ("2024-01-31T10:00:00.5Z", False, True), ("31.1.24", False, True), ("1/2/2024", False, True), ("12\nx", False, False), ("12x\n", False, False),
])
def test_number_and_date_like(spark, value, number, date):
    assert value_of(spark, X.is_numeric_like(F.lit(value))) is number
    assert value_of(spark, X.is_date_like(F.lit(value))) is date


def test_strip_takes_all_white_space_and_trim_only_spaces(spark):
    assert value_of(spark, X.strip(F.lit("　\t a b  \n"))) == "a b"
    assert value_of(spark, X.has_outer_spaces(F.lit("\ta"))) is False
    assert value_of(spark, X.has_outer_spaces(F.lit(" a"))) is True


@pytest.mark.parametrize("kind,value,ok", [
    ("iban", "DE89370400440532013000", True), ("iban", "DE89 3704 0044 0532 0130 00", True), ("iban", "DE89370400440532013001", False), ("iban", "XX00", False),
    ("iban", "GB82WEST12345698765432", True), ("iban", "GB82WEST1234569876543", False),
    ("eu_vat", "DE123456789", True), ("eu_vat", "ATU12345678", True), ("eu_vat", "NL123456789B01", True), ("eu_vat", "DE12345", False), ("eu_vat", "US123456789", False),
    ("eu_vat", "de 123.456-789", True), ("email", "anna@example.org", True), ("email", "anna@", False), ("email", "a@b", False),
    ("phone_e164", "+49 30 1234567", True), ("phone_e164", "030 1234567", False), ("iso_country", "DE", True), ("iso_country", "deu", True), ("iso_country", "XX", False),
    ("iso_currency", "EUR", True), ("iso_currency", "EURO", False), ("postcode_de", "10115", True), ("postcode_de", "00999", False), ("postcode_de", "x", False),
    ("uuid", "123e4567-e89b-12d3-a456-426614174000", True), ("uuid", "123e4567", False), ("url", "https://example.org/a?b", True), ("url", "ftp://example.org", False),
    ("url", "http://nodots", False),
])
def test_semantic_types(spark, kind, value, ok):
    assert value_of(spark, S.valid_as(F.lit(value), F.lit(kind))) is ok


def interval(spark, n, k, population):
    return one(spark.range(1).select(*[c.alias(x) for c, x in zip(I.check_interval(F.lit(n), F.lit(k), F.lit(population)), "plh")]))


def test_intervals(spark):
    assert interval(spark, 1000, 10, 1000) == (0.99, 0.99, 0.99)
    assert interval(spark, 0, 0, 0) == (1.0, 1.0, 1.0)
    assert interval(spark, 1, 1, 50) == (0.0, 0.0, 0.0)
    p, low, high = interval(spark, 1000, 10, 100_000)
    assert low < p < high
    _, low2, high2 = interval(spark, 10_000, 100, 100_000)
    assert high2 - low2 < high - low
    _, a, b = interval(spark, 1000, 10, 10**9)
    _, c, d = interval(spark, 1000, 10, 2000)
    assert d - c < b - a
    z, n_eff = I.Z, 1000 * 99_999 / 99_000
    half = z * math.sqrt(0.99 * 0.01 / n_eff + z * z / (4 * n_eff**2)) / (1 + z * z / n_eff)
    assert math.isclose(high - low, 2 * half, rel_tol=1e-9)


def test_labels_are_lossless():
    assert label_of("a.b", "c") == '"a.b".c' and label_of("a", "b.c") == 'a."b.c"'
    assert label_of("", "orders") == "orders" and label_of("public", "orders") == "public.orders"
    assert label_of("", 'say "hi"') == '"say ""hi"""'


def test_logical_types(spark):
    df = spark.sql("SELECT 1Y a, 1.5BD b, CAST(1 AS DECIMAL(20,0)) c, true d, 'x' e, DATE '2024-01-01' f, TIMESTAMP_NTZ '2024-01-01 00:00:00' g, "
                   "array(1) h, X'00' i, INTERVAL '1' DAY j, parse_json('{}') k, CAST(1 AS FLOAT) l")
    assert [logical_type(f.dataType) for f in df.schema] == [
        "integer", "decimal", "integer", "boolean", "text", "date", "timestamp", "other", "binary", "other", "json", "decimal"]


def test_percentages(spark):
    pct = lambda k, n: value_of(spark, X.percentage(F.lit(k), F.lit(n)))
    assert (pct(0, 0), pct(1, 1000), pct(236, 1000), pct(1, 1)) == ("0 %", "0.10 %", "23.6 %", "100.0 %")
    assert canonical_json({"b": 1, "a": [2]}) == '{"a": [2], "b": 1}'


def test_numbers_with_any_white_space_are_valid(spark):
    from plumbline.functions import semantics as S

    df = spark.createDataFrame([("DE 123 456 789", "+49 30 123456")], "vat string, phone string")
    assert tuple(df.select(S.is_eu_vat(F.col("vat")), S.is_phone_e164(F.col("phone"))).first()) == (True, True)
