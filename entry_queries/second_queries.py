"""Queries of the checks across scans, columns and tables that need more than one column's counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.custom import CustomCheck, custom_checks
from plumbline.operators.drift import categorical_shift, numeric_shift
from plumbline.operators.duplicates import Field, normalised_duplicates, record_links
from plumbline.operators.explain import explain_failures
from plumbline.operators.relations import aggregate_balance, functional_dependencies, overlapping_columns
from plumbline.operators.trends import metric_anomaly, time_series, volume_trend
from plumbline.session import tune

from .views import table

CUSTOM = (
    CustomCheck("late_big_orders", "o_totalprice > 400000 AND o_orderpriority = '5-LOW'", 0.05),
    CustomCheck("odd_status", "o_orderstatus NOT IN ('F', 'O')"),
    CustomCheck("negative", "o_totalprice < 0"),
)
OVERLAP = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"],
    "part": ["p_partkey", "p_size"], "supplier": ["s_suppkey", "s_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "events": ["user_id", "event_type"],
    "documents": ["doc_id", "lang"], "labels": ["doc_id"],
}
DEPENDENT = {"part": ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "dirty_customers": ["city", "country", "email", "total"], "orders": ["o_orderstatus", "o_orderpriority", "o_custkey"]}
MIDDLE = {"orders": "o_orderdate >= '1998-07-01'", "events": "ts >= '2024-01-16'"}


def slices(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """A table's rows before and after the middle of its time: two scans."""
    df = table(tune(spark), sf_dir, name)
    return df.where(~F.expr(MIDDLE[name])), df.where(F.expr(MIDDLE[name]))


def named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("asset"), *df.columns)


def distribution_shift_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and events, first half against second."""
    orders = numeric_shift(*slices(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey", "o_orderkey"])
    return named(orders, "orders").unionByName(named(numeric_shift(*slices(spark, sf_dir, "events"), ["value", "user_id", "event_id"]), "events"))


def distribution_shift_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of orders and events, first half against second; days as classes have all moved."""
    orders = categorical_shift(*slices(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    before, after = (df.withColumn("day", F.to_date("ts")) for df in slices(spark, sf_dir, "events"))
    return named(orders, "orders").unionByName(named(categorical_shift(before, after, ["event_type", "user_id", "day"]), "events"))


def daily_measures(events: DataFrame) -> DataFrame:
    """series, at, value: rows and mean value per day of each event type."""
    days = events.groupBy("event_type", F.to_date("ts").alias("at")).agg(F.count("*").cast("double").alias("rows"), F.avg("value").alias("mean"))
    return days.unpivot(["event_type", "at"], ["rows", "mean"], "measure", "value").select(F.concat_ws(".", "event_type", "measure").alias("series"), "at", "value")


def metric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_anomaly(daily_measures(table(tune(spark), sf_dir, "events")), period=7, alpha=0.1)


def volume_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per day and user, up to two days after the last: some days have none."""
    return volume_trend(table(tune(spark), sf_dir, "events"), "ts", "user_id", weeks=3, until=date(2024, 2, 1))


def series_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's series: size, ends, and a checksum that only this order gives."""
    placed = time_series(table(tune(spark), sf_dir, "events"), "event_type", "ts", "value")
    mark = F.pmod(F.col("place") * F.round(F.col("value") * 100).cast("long"), F.lit(1_000_003))
    return placed.groupBy("series").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("place").alias("last_place"), F.sum(mark).alias("order_mark"))


def failure_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where customers without an e-mail address come from: all of one country."""
    df = table(tune(spark), sf_dir, "dirty_customers").withColumn("prefix", F.substring("total", 1, 1))
    return explain_failures(df, F.col("email").isNull(), ["country", "city", "prefix"], support=0.1, lift=1.1, width=2)


def functional_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, columns in DEPENDENT.items():
        part = named(functional_dependencies(table(tune(spark), sf_dir, name), columns, error=0.4, width=2), name)
        out = part if out is None else out.unionByName(part)
    return out


def aggregate_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against their orders, keys of either side."""
    return aggregate_balance(table(tune(spark), sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", tolerance="1000", scale=2)


def overlapping_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping_columns({t: table(tune(spark), sf_dir, t) for t in OVERLAP}, OVERLAP)


def custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom_checks(table(tune(spark), sf_dir, "orders"), list(CUSTOM))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written in several ways, of customers and of URLs."""
    customers = named(normalised_duplicates(table(tune(spark), sf_dir, "dirty_customers"), ["city", "name", "email", "vat_id"]), "dirty_customers")
    return customers.unionByName(named(normalised_duplicates(table(spark, sf_dir, "conversations"), ["role", "text"]), "conversations"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a record of a person; every twentieth once more under another key, with a typing error."""
    customer = table(tune(spark), sf_dir, "customer")
    name, phone = F.substring(F.md5("c_name"), 1, 12), F.lpad((F.col("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0")
    one = customer.select(F.col("c_custkey").alias("id"), name.alias("name"), F.col("c_nationkey").cast("string").alias("city"), phone.alias("phone"), F.col("c_mktsegment").alias("segment"))
    again = one.where("id % 20 = 0").withColumn("name", F.concat(F.upper(F.substring("name", 1, 11)), F.lit("-z"))).withColumn("id", F.col("id") + 1_000_000_000)
    return one.unionByName(again)


def record_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of records that are the same person."""
    fields = [Field("name", edits=2), Field("city"), Field("phone"), Field("segment")]
    return record_links(people(spark, sf_dir), "id", fields, [["phone"], ["name"], ["city"]]).select("left", "right")


SECOND_QUERIES = {
    "near_duplicates": near_duplicates, "record_linkage": record_linkage,
    "distribution_shift_numeric": distribution_shift_numeric, "distribution_shift_categorical": distribution_shift_categorical, "metric_anomalies": metric_anomalies,
    "failure_explanation": failure_explanation, "functional_dependency": functional_dependency, "volume_trend": volume_trends, "overlapping_tables": overlapping_tables,
    "time_series_extraction": series_extraction, "aggregate_balance": aggregate_balances, "custom_sql": custom_sql,
}
