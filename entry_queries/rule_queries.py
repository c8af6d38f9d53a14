"""Queries of the rules with fixed meaning, over the given tables and what Spark derives from them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import client_crossings, code_list, erp_rules, filled, mixed_types, schema_drift
from plumbline.session import tune

from .views import table

# Line items as an ERP system keeps them: text dates, padded keys, units apart, a deletion flag.
ERP = """SELECT
  CASE WHEN l_orderkey % 11 = 0 THEN '00000000' WHEN l_orderkey % 13 = 0 THEN '20230230' WHEN l_orderkey % 17 = 0 THEN NULL ELSE replace(CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)), '-', '') END AS posted,
  CASE WHEN l_partkey % 7 = 0 THEN CAST(l_partkey AS VARCHAR(20)) WHEN l_partkey % 31 = 0 THEN 'X' ELSE lpad(CAST(l_partkey AS VARCHAR(20)), 10, '0') END AS material,
  l_extendedprice AS amount, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'EUR' END AS currency,
  l_quantity AS quantity, CASE WHEN l_linenumber = 6 THEN NULL ELSE 'PC' END AS unit,
  CASE WHEN l_returnflag = 'R' THEN 'X' ELSE '' END AS deleted
FROM lineitem"""


def code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states against those of the large finished orders; nations of customers against those of three regions."""
    orders, customer = table(tune(spark), sf_dir, "orders"), table(spark, sf_dir, "customer")
    states = code_list(orders, "o_orderstatus", orders.where("o_totalprice > 400000").select(F.lower("o_orderstatus").alias("c")).union(orders.where("o_orderstatus = 'F'").select("o_orderstatus")), "c")
    nations = code_list(customer, "c_nationkey", table(spark, sf_dir, "nation").where("n_regionkey < 3"), "n_nationkey")
    return states.select(F.lit("o_orderstatus").alias("column"), "value", "n").unionByName(nations.select(F.lit("c_nationkey").alias("column"), "value", "n"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of orders, one of them with a number in every second row."""
    orders = table(tune(spark), sf_dir, "orders")
    return mixed_types(orders.select("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderstatus")).alias("note")))


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a later form of them: a column gone, one new, one as text, one emptied."""
    orders = table(tune(spark), sf_dir, "orders")
    later = orders.drop("o_orderpriority").withColumns({"o_channel": F.col("o_orderstatus"), "o_custkey": F.col("o_custkey").cast("string"), "o_totalprice": F.when(F.col("o_totalprice") < 0, F.col("o_totalprice"))})
    return schema_drift(filled(orders), filled(later)).select("column", "change", "filled_before", "filled_after")


def erp(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(tune(spark), sf_dir, "lineitem").createOrReplaceTempView("erp_lineitem")
    df = spark.sql(ERP.replace("FROM lineitem", "FROM erp_lineitem"))
    return erp_rules(df, ["posted"], ["material"], {"amount": "currency"}, {"quantity": "unit"}, ["deleted"])


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers of ten clients, by their keys: nine of ten references cross."""
    orders = table(tune(spark), sf_dir, "orders").withColumn("client", F.col("o_orderkey") % 10)
    return client_crossings(orders, "o_custkey", "client", table(spark, sf_dir, "customer").withColumn("owner", F.col("c_custkey") % 10), "c_custkey", "owner")


RULE_QUERIES = {"code_list": code_lists, "mixed_types": mixed, "schema_drift": drifted, "erp_rules": erp, "client_crossings": crossings}

NUMBER = "'^[+-]?[0-9]+([.,][0-9]+)*$'"
RULE_ORACLE = {
    "code_list": """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN (SELECT lower(o_orderstatus) FROM orders WHERE o_totalprice > 400000) AND o_orderstatus <> 'F' GROUP BY ALL
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY ALL""",
    "mixed_types": f"""
WITH cells AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 'note', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END FROM orders),
counted AS (SELECT "column", count(*) AS evaluated, count(*) FILTER (regexp_matches(trim(v), {NUMBER})) AS numbers FROM cells WHERE trim(v) <> '' GROUP BY ALL)
SELECT *, numbers / evaluated AS share, numbers / evaluated BETWEEN 0.3 AND 0.9 AS mixed FROM counted""",
    "schema_drift": """
SELECT 'o_orderpriority' AS "column", 'removed' AS change, count(o_orderpriority) AS filled_before, NULL AS filled_after FROM orders
UNION ALL SELECT 'o_channel', 'added', NULL, count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_custkey', 'retyped', count(o_custkey), count(o_custkey) FROM orders
UNION ALL SELECT 'o_totalprice', 'emptied', count(o_totalprice), 0 FROM orders""",
    "erp_rules": f"""
WITH erp AS ({ERP}), d AS (SELECT posted FROM erp WHERE posted <> '00000000'), k AS (SELECT material FROM erp WHERE regexp_matches(material, '^[0-9]+$'))
SELECT 'dates_valid' AS rule, 'posted' AS "column", count(*) AS evaluated, count(*) FILTER (try_strptime(posted, '%Y%m%d') IS NULL) AS failed FROM d
UNION ALL SELECT 'zero_padding', 'material', count(*), least(count(*) FILTER (material LIKE '0%'), count(*) FILTER (material NOT LIKE '0%')) FROM k
UNION ALL SELECT 'currency_missing', 'amount', count(*), count(*) FILTER (trim(currency) = '') FROM erp WHERE amount <> 0
UNION ALL SELECT 'unit_missing', 'quantity', count(*), count(*) FILTER (unit IS NULL) FROM erp WHERE quantity <> 0
UNION ALL SELECT 'deletion_share', 'deleted', count(*), count(*) FILTER (deleted <> '') FROM erp""",
    "client_crossings": """
SELECT o_orderkey % 10 AS client, count(*) AS evaluated, count(*) FILTER (c_custkey IS NOT NULL AND c_custkey % 10 <> o_orderkey % 10) AS failed
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL GROUP BY ALL""",
}
