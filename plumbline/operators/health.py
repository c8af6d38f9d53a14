"""Health items: reported, not scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health_items(profile: DataFrame, asset_info: DataFrame) -> DataFrame:
    """`(type, asset, column, summary)`: empty tables, tables without a key, numbers stored as text.

    `asset_info` also carries `kind`, `has_primary_key` and `declares_keys`: a missing key is only
    reported where the source could declare one."""
    nothing = F.lit(None).cast("string").alias("column")
    empty = asset_info.filter("population = 0").select(
        F.lit("empty_table").alias("type"), "asset", nothing, F.concat("asset", F.lit(" has no rows.")).alias("summary")
    )
    keyless = asset_info.filter("declares_keys AND kind = 'table' AND NOT has_primary_key").select(
        F.lit("no_primary_key").alias("type"), "asset", nothing,
        F.concat("asset", F.lit(" declares no primary key.")).alias("summary"),
    )
    numbers = profile.filter(
        "logical_type = 'text' AND non_null > 0 AND numeric_like = non_null AND leading_zero_numbers = 0 "
        "AND role NOT IN ('key', 'foreign_key')"
    ).select(
        F.lit("numbers_as_text").alias("type"), "asset", "column",
        F.concat_ws("", "asset", F.lit("."), "column", F.lit(" stores numbers as text.")).alias("summary"),
    )
    return empty.unionByName(keyless).unionByName(numbers)
