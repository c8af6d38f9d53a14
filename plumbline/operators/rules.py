"""Rules with fixed meaning: values of a reference list, numbers among words, columns that came or went, and rules of ERP tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import full_match
from plumbline.model import logical_type

MIXED = (0.3, 0.9)
NUMBER = r"[+-]?[0-9]+([.,][0-9]+)*"
UNSET_DATE = "00000000"


def code_list(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """value, n of every value of `column` that is not in `codes`. Values are compared as text, null is not evaluated.

    Rows are counted by value before they meet the list, and the list may be of any size: which way they are joined is left to Spark."""
    counted = df.select(F.col(column).cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    known = codes.select(F.col(code).cast("string").alias("value")).where("value is not null").distinct()
    return counted.join(known, "value", "left_anti")


def mixed_types(df: DataFrame, columns: list[str] | None = None, low: float = MIXED[0], high: float = MIXED[1]) -> DataFrame:
    """column, evaluated, numbers, share, mixed of the text columns: from `low` to `high` of a mixed column's values are numbers.

    Null and blank values are not evaluated; a column without others has no share and is not mixed. One aggregation, no value is shuffled."""
    texts = [c for c in columns or df.columns if logical_type(df.schema[c].dataType) == "text"]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, evaluated long, numbers long, share double, mixed boolean")
    stripped = {c: F.trim(F.col(f"`{c}`")) for c in texts}
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(v != "").alias("evaluated"), F.count_if(full_match(v, NUMBER)).alias("numbers")) for c, v in stripped.items()]
    out = df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    share = F.when(F.col("evaluated") > 0, F.col("numbers") / F.col("evaluated"))
    return out.select("column", "evaluated", "numbers", share.alias("share"), F.coalesce(share.between(low, high), F.lit(False)).alias("mixed"))


def filled(df: DataFrame) -> DataFrame:
    """column, type, filled (values that are not null), one row per column."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, type string, filled long")
    counts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.col(f"`{f.name}`")).alias("filled")) for f in df.schema]
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, change, type_before, type_after, filled_before, filled_after of the columns that two scans of a table do not share.

    Change is `added`, `removed`, `retyped`, `emptied` (had values, has none) or `filled` (had none, has some). Names are compared as
    they are written. Both sides take what `filled` gives, so a kept list of an earlier scan does as well as its rows."""
    a, b = (s.select("column", F.col("type").alias(f"type_{w}"), F.col("filled").alias(f"filled_{w}")) for s, w in ((before, "before"), (after, "after")))
    both = a.join(b, "column", "full")
    change = (
        F.when(F.col("type_before").isNull(), "added").when(F.col("type_after").isNull(), "removed").when(F.col("type_before") != F.col("type_after"), "retyped")
        .when((F.col("filled_before") > 0) & (F.col("filled_after") == 0), "emptied").when((F.col("filled_before") == 0) & (F.col("filled_after") > 0), "filled")
    )
    return both.select("column", change.alias("change"), "type_before", "type_after", "filled_before", "filled_after").where("change is not null")


def is_text_date(v: Column) -> Column:
    """A day that exists, written in eight digits."""
    return full_match(v, "[0-9]{8}") & F.try_to_date(v, "yyyyMMdd").isNotNull()


def erp_rules(
    df: DataFrame, dates: list[str] | None = None, keys: list[str] | None = None, amounts: dict[str, str] | None = None,
    quantities: dict[str, str] | None = None, deleted: list[str] | None = None,
) -> DataFrame:
    """rule, column, evaluated, failed of a table in the manner of ERP systems: all rules in one aggregation.

    `dates_valid`: text dates that are no day; null, blank and all zeros are missing, not evaluated. `zero_padding`: of the keys made of
    digits, the fewer of those with and those without leading zeros; keys of letters are not evaluated. `currency_missing` and `unit_missing`:
    amounts and quantities (each with the column of its unit) that are neither null nor 0 and have a null or blank unit. `deletion_share`:
    rows with a flag that is not blank, of all."""

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""

    rules: list[tuple[str, str, Column, Column]] = []
    for c in dates or []:
        asked = ~blank(c) & (F.trim(c) != UNSET_DATE)
        rules.append(("dates_valid", c, F.count_if(asked), F.count_if(asked & ~F.coalesce(is_text_date(F.trim(c)), F.lit(False)))))
    for c in keys or []:
        asked = full_match(F.trim(c), "[0-9]+")
        padded = F.count_if(asked & F.trim(c).startswith("0"))
        rules.append(("zero_padding", c, F.count_if(asked), F.least(padded, F.count_if(asked) - padded)))
    for rule, pairs in (("currency_missing", amounts), ("unit_missing", quantities)):
        for c, unit in (pairs or {}).items():
            asked = F.coalesce(F.col(c) != 0, F.lit(False))
            rules.append((rule, c, F.count_if(asked), F.count_if(asked & blank(unit))))
    for c in deleted or []:
        rules.append(("deletion_share", c, F.count("*"), F.count_if(~blank(c))))
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, column string, evaluated long, failed long")
    counts = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), n.cast("long").alias("evaluated"), k.cast("long").alias("failed")) for r, c, n, k in rules]
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def client_crossings(child: DataFrame, child_key: str, child_client: str, parent: DataFrame, parent_key: str, parent_client: str) -> DataFrame:
    """client, evaluated, failed: references whose key exists under other clients only. Null keys are not evaluated, missing ones do not fail.

    References are counted by client and key before they meet the parents, so a key that many rows hold is one row."""
    links = child.select(F.col(child_client).alias("client"), F.col(child_key).alias("key")).where("key is not null").groupBy("client", "key").agg(F.count("*").alias("n"))
    owners = parent.select(F.col(parent_client).alias("owner"), F.col(parent_key).alias("key")).where("key is not null").distinct()
    here = owners.select(F.col("owner").alias("client"), "key", F.lit(True).alias("here"))
    known = owners.select("key").distinct().withColumn("known", F.lit(True))
    met = links.join(known, "key", "left").join(here, ["client", "key"], "left")
    crossed = F.col("known").isNotNull() & F.col("here").isNull()
    return met.groupBy("client").agg(F.sum("n").alias("evaluated"), F.sum(F.when(crossed, F.col("n")).otherwise(0)).alias("failed"))
