"""Row counts and seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Asset
from ..operators.histogram import quote

HASH_RANGE = 1 << 30


def row_counts(assets: list[Asset]) -> dict[str, int]:
    """Exact row counts in one job; Parquet answers from its footers, without reading a column."""
    frames = [a.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(a.label).alias("asset"), "n") for a in assets]
    return {r.asset: int(r.n) for r in reduce(DataFrame.union, frames).collect()}


def keep_by_key(keys: list[Column], fraction: float, seed: int) -> Column:
    """Keep a row by the hash of its key: the same rows for any file layout or partitioning."""
    h = F.xxhash64(F.lit(seed).cast("bigint"), *keys)
    return F.pmod(h, F.lit(HASH_RANGE)) < F.lit(int(fraction * HASH_RANGE))


def sample(asset: Asset, rows: int, seed: int, population: int, by_key: bool = False) -> tuple[DataFrame, bool]:
    """About `rows` rows of the table and whether that is a sample; all of it when `rows` is 0 or covers it.

    Rows are drawn independently, so identical rows are not in or out together. `by_key` draws by the
    primary key's hash instead, which does not depend on how files are split."""
    if rows <= 0 or population <= rows:
        return asset.df, False
    fraction = rows / population
    if by_key and asset.primary_key:
        return asset.df.filter(keep_by_key([F.col(quote(c)) for c in asset.primary_key], fraction, seed)), True
    return asset.df.sample(withReplacement=False, fraction=fraction, seed=seed), True
