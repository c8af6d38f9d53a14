"""A small web shop: a faulty form, its clean twin, and a drifted form. Faults are put in by row number."""

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.model import Asset, ForeignKey

NOW = datetime(2026, 10, 2, 6)
N = 1200  # orders

_IBAN = (
    "concat('DE', lpad(cast(98 - cast(cast(concat(lpad(cast({k} AS STRING), 18, '1'), '131400') AS DECIMAL(38,0)) % 97 AS INT) AS STRING), 2, '0'), "
    "lpad(cast(id AS STRING), 18, '1'))"
)


def frames(spark, faulty=False, drift=False):
    f = lambda cond, then, other: f"CASE WHEN {cond} THEN {then} ELSE {other} END" if faulty else other
    d = lambda cond, then, other: f"CASE WHEN {cond} THEN {then} ELSE {other} END" if drift else other
    iban = f("id % 60 = 31", _IBAN.format(k="id + 1"), _IBAN.format(k="id"))
    name = d("id < 5", "concat(repeat('x', 40), id)", "concat('Customer ', lpad(cast(id AS STRING), 4, '0'))")
    city = "CASE WHEN id % 3 = 0 THEN 'Berlin' WHEN id % 3 = 1 THEN 'Hamburg' ELSE 'Wien' END"
    customers = spark.range(N // 4).selectExpr(
        "id",
        f("id % 100 = 7", f"concat({name}, '​')", name) + " AS name",
        f("id % 50 = 3", "NULL", f("id % 70 = 11", "'N/A'", "concat('user', id, '@example.org')")) + " AS email",
        iban + " AS iban",
        f("id % 40 = 5", "concat(' ', 'Berlin')", f("id % 40 = 9", "'berlin'", city)) + " AS city",
        "CASE WHEN id % 2 = 0 THEN 'DE' ELSE 'AT' END AS country",
        f("id = 17", "TIMESTAMP_NTZ '2031-01-01 00:00:00'", f("id = 18", "TIMESTAMP_NTZ '1890-01-01 00:00:00'",
          "TIMESTAMP_NTZ '2025-01-01 00:00:00' + make_dt_interval(cast(id AS INT))")) + " AS created_at",
    )
    sku = d("id < 5", "concat('#', id)", "concat('SKU-', lpad(cast(id AS STRING), 5, '0'))")
    products = spark.range(N // 20).selectExpr("id", sku + " AS sku", "concat('Thing ', id) AS title", "cast(5 + id % 37 AS DOUBLE) AS price", "'EUR' AS currency")
    amount = d("id < 10", "-1.0 * (20 + id % 91)", "cast(20 + id % 91 AS DOUBLE)")
    ordered = "TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(cast(id % 270 AS INT), 3)"
    orders = spark.range(N).selectExpr(
        f("id IN (100, 101)", "cast(99 AS BIGINT)", "id") + " AS id",
        f("id % 300 = 13", "NULL", f("id % 100 = 21", f"{N} + id", f"id % {N // 4}")) + " AS customer_id",
        f"id % {N // 20} AS product_id",
        "cast(1 + id % 5 AS INT) AS quantity",
        f("id % 150 = 44", "1000.0 * (20 + id % 91)", amount) + " AS amount",
        d("id < 20", "'lost'", "CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 4 = 1 THEN 'paid' ELSE 'shipped' END") + " AS status",
        f"{ordered} AS ordered_at",
        f("id % 120 = 2", f"{ordered} - INTERVAL '2' DAY", f"{ordered} + INTERVAL '1' DAY") + " AS shipped_at",
    )
    if faulty:
        orders = orders.union(orders.filter("id BETWEEN 200 AND 204"))
    total = f("id % 250 = 8", "'twelve'", "cast(10 + id % 50 AS STRING)") if faulty else "cast(10 + id % 50 AS DOUBLE)"
    invoices = spark.range(N * 4 // 5).selectExpr(
        "id", "id AS order_id", f("id % 200 = 3", "'DE12345'", "concat('DE', lpad(cast(id AS STRING), 9, '1'))") + " AS vat_id", f"{total} AS total",
        "TIMESTAMP_NTZ '2026-02-01 00:00:00' + make_dt_interval(cast(id % 200 AS INT)) AS issued_at")
    shift = "- INTERVAL '30' DAY" if drift else ""
    events = spark.range(N // 2).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN 'click' ELSE 'view' END AS kind",
        f"TIMESTAMP_NTZ '2026-09-30 00:00:00' + make_dt_interval(0, cast(id % 48 AS INT)) {shift} AS occurred_at", "cast(100 + id % 900 AS INT) AS payload_size")
    out = {"customers": customers, "products": products, "orders": orders, "invoices": invoices, "events": events}
    if faulty:
        out["returns"] = spark.range(0).select("id", F.col("id").alias("order_id"), F.lit("x").alias("reason"))
    return out


def assets(spark, declared=False, **form):
    keys = {"orders": (ForeignKey("customer_id", "customers", "id"), ForeignKey("product_id", "products", "id"))}
    return [
        Asset(n, df, primary_key=("id",) if declared else (), foreign_keys=keys.get(n, ()) if declared else ())
        for n, df in frames(spark, **form).items()
    ]
