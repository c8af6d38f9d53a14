"""The tables the registered queries run on: the given ones, and views with faults put in by key arithmetic.

The view text runs unchanged in Spark and DuckDB, apart from the name of the zone-less timestamp type.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from plumbline.model import Asset, ForeignKey

NOW = datetime(2026, 1, 1)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")

_IBAN = """concat('DE', lpad(CAST(98 - CAST(CAST(concat(lpad(CAST({k} AS STRING), 18, '1'), '131400')
    AS DECIMAL(38,0)) % 97 AS INT) AS STRING), 2, '0'), lpad(CAST(c_custkey AS STRING), 18, '1'))"""

VIEWS = {
    "dirty_customers": f"""SELECT
  CASE WHEN c_custkey % 250 = 249 THEN c_custkey - 1 ELSE c_custkey END AS id,
  CASE WHEN c_custkey % 59 = 0 THEN concat(c_name, '\u200b') ELSE c_name END AS name,
  CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 211 = 0 THEN 'N/A'
       WHEN c_custkey % 97 = 0 THEN concat('user', CAST(c_custkey AS STRING), '@')
       ELSE concat('user', CAST(c_custkey AS STRING), '@example.org') END AS email,
  {_IBAN.format(k="CASE WHEN c_custkey % 83 = 0 THEN c_custkey + 1 ELSE c_custkey END")} AS iban,
  CASE WHEN c_custkey % 61 = 0 THEN ' Berlin ' WHEN c_custkey % 67 = 0 THEN 'berlin'
       WHEN c_custkey % 3 = 0 THEN 'Berlin' WHEN c_custkey % 3 = 1 THEN 'Hamburg' ELSE 'Wien' END AS city,
  CASE WHEN c_custkey % 2 = 0 THEN 'DE' ELSE 'AT' END AS country,
  CASE WHEN c_custkey % 79 = 0 THEN 'DE12345' ELSE concat('DE', lpad(CAST(c_custkey AS STRING), 9, '1')) END AS vat_id,
  CASE WHEN c_custkey % 101 = 0 THEN 'twelve' ELSE CAST(c_custkey * 3 + 1 AS STRING) END AS total
FROM customer""",
    "clean_customers": f"""SELECT c_custkey AS id, c_name AS name, concat('user', CAST(c_custkey AS STRING), '@example.org') AS email,
  {_IBAN.format(k="c_custkey")} AS iban,
  CASE WHEN c_custkey % 3 = 0 THEN 'Berlin' WHEN c_custkey % 3 = 1 THEN 'Hamburg' ELSE 'Wien' END AS city,
  CASE WHEN c_custkey % 2 = 0 THEN 'DE' ELSE 'AT' END AS country,
  concat('DE', lpad(CAST(c_custkey AS STRING), 9, '1')) AS vat_id, CAST(c_custkey * 3 + 1 AS STRING) AS total
FROM customer""",
    "dirty_orders": """SELECT
  CASE WHEN o_orderkey % 500 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS id,
  CASE WHEN o_orderkey % 997 = 0 THEN 1000000 + o_orderkey WHEN o_orderkey % 1009 = 0 THEN NULL ELSE o_custkey END AS customer_id,
  CASE WHEN o_orderkey % 400 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS amount,
  o_orderstatus AS status,
  CASE WHEN o_orderkey = 7 THEN CAST('1899-12-31 00:00:00' AS {TS})
       WHEN o_orderkey = 11 THEN CAST('2031-01-01 00:00:00' AS {TS}) ELSE o_orderdate END AS ordered_at,
  CASE WHEN o_orderkey % 300 = 0 THEN o_orderdate - INTERVAL 2 DAY ELSE o_orderdate + INTERVAL 2 DAY END AS shipped_at
FROM orders_twice""",
    "clean_orders": """SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS amount, o_orderstatus AS status,
  o_orderdate AS ordered_at, o_orderdate + INTERVAL 2 DAY AS shipped_at FROM orders""",
    # Ten rows appear twice.
    "orders_twice": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey BETWEEN 20 AND 29",
    # References kept as text, against a numeric key.
    "order_notes": """SELECT o_orderkey AS note_no, CASE WHEN o_orderkey % 997 = 0 THEN CAST(1000000 + o_orderkey AS STRING)
  ELSE CAST(o_custkey AS STRING) END AS customer_id FROM orders""",
    # Numbers a phone list, a currency list, a postcode list and an id list would hold, with faults.
    "contacts": """SELECT c_custkey AS contact_no,
  CASE WHEN c_custkey % 7 = 0 THEN concat('030 ', CAST(c_custkey AS STRING)) ELSE concat('+49 (30) ', CAST(1000000 + c_custkey AS STRING)) END AS phone,
  CASE WHEN c_custkey % 11 = 0 THEN 'EURO' WHEN c_custkey % 2 = 0 THEN 'EUR' ELSE ' usd ' END AS currency,
  CASE WHEN c_custkey % 13 = 0 THEN '00999' ELSE lpad(CAST(10000 + c_custkey % 89999 AS STRING), 5, '0') END AS postcode,
  CASE WHEN c_custkey % 17 = 0 THEN 'XX' WHEN c_custkey % 3 = 0 THEN 'deu' ELSE 'FR' END AS country,
  CASE WHEN c_custkey % 19 = 0 THEN 'not-a-uuid' ELSE concat('123e4567-e89b-12d3-a456-', lpad(CAST(c_custkey AS STRING), 12, '0')) END AS token
FROM customer""",
    "no_returns": "SELECT o_orderkey AS return_no, o_orderstatus AS reason FROM orders WHERE o_orderkey < 0",
}
_NEEDS = {"dirty_orders": ("orders_twice",)}


def sql_with(views: tuple[str, ...], body: str) -> str:
    """`body` for DuckDB with the views it uses in front."""
    needed: list[str] = []
    for v in views:
        needed += [x for x in (*_NEEDS.get(v, ()), v) if x not in needed]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].replace('{TS}', 'TIMESTAMP')})" for v in needed)
    return f"WITH {ctes} {body}" if needed else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Spark keeps the old column ids inside a BETWEEN when it renews a plan, and would not find held rows again by it.
    text = VIEWS[name].replace("{TS}", "TIMESTAMP_NTZ").replace("o_orderkey BETWEEN 20 AND 29", "o_orderkey >= 20 AND o_orderkey <= 29")
    source = {"dirty_orders": "orders_twice", "dirty_customers": "customer", "clean_customers": "customer", "contacts": "customer"}.get(name, "orders")
    return spark.sql(text.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf_dir, source))


KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
    "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"),
    "benchmark": ("item_id",), "embeddings": ("vec_id",),
}
REFERENCES: dict[str, tuple[ForeignKey, ...]] = {
    "nation": (ForeignKey("n_regionkey", "region", "r_regionkey"),),
    "customer": (ForeignKey("c_nationkey", "nation", "n_nationkey"),),
    "supplier": (ForeignKey("s_nationkey", "nation", "n_nationkey"),),
    "orders": (ForeignKey("o_custkey", "customer", "c_custkey"),),
    "lineitem": (ForeignKey("l_orderkey", "orders", "o_orderkey"), ForeignKey("l_partkey", "part", "p_partkey"),
                 ForeignKey("l_suppkey", "supplier", "s_suppkey")),
    "labels": (ForeignKey("doc_id", "documents", "doc_id"),),
    "dirty_orders": (ForeignKey("customer_id", "dirty_customers", "id"),),
    "clean_orders": (ForeignKey("customer_id", "clean_customers", "id"),),
}


def asset(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] | None = None, declared: bool = True) -> Asset:
    """A table with its declarations, narrowed to the columns a query uses."""
    df = table(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    if not declared:
        return Asset(name, df)
    return Asset(name, df, primary_key=KEYS.get(name, ("id",) if "id" in df.columns else ()), foreign_keys=REFERENCES.get(name, ()))


def all_assets(spark: SparkSession, sf_dir: str) -> list[Asset]:
    return [asset(spark, sf_dir, t) for t in TABLES]
