"""Where failures cluster: attribute combinations over-represented among failing rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explain_failures(df: DataFrame, failing: Column, attributes: list[str], support: float = 0.2, lift: float = 1.2, width: int = 2, gain: float = 1.2) -> DataFrame:
    """segment, size, failing, rows, support, rate, lift of the combinations of `attributes` that failures come from.

    A segment is `name=value` or several of them joined by ` & ` in the order of `attributes`. `failing` counts its failing rows,
    `rows` all its rows; support is its share of all failing rows, lift its failure rate over that of the table. Segments of at
    least `support` and `lift` and at most `width` attributes are returned; one with more attributes only if its rate is
    `gain` times that of every part of it. A null value is the value `null`, a null of the condition does not fail; without failing rows there are none.

    A value below the support is in no segment above it, so each level counts only what the level before let through. Every
    attribute has at most 1/support such values, so the lists that levels hand on stay small however large the table is; each level
    is one aggregation with map-side combination.
    """
    fails = F.coalesce(failing, F.lit(False))
    rows = df.select(fails.alias("fails"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(f"a{i}") for i, c in enumerate(attributes)])
    total = rows.agg(F.count("*").alias("rows"), F.count_if("fails").alias("failing")).first()
    schema = "segment string, size int, failing long, rows long, support double, rate double, lift double"
    if not total["failing"]:
        return df.sparkSession.createDataFrame([], schema)
    overall = total["failing"] / total["rows"]
    kept: dict[tuple, tuple[int, int]] = {}
    level = [(i,) for i in range(len(attributes))]
    for _ in range(min(width, len(attributes))):
        if not level:
            break
        # Of a combination only the rows whose every part passed are counted.
        allowed = {i: [v for (key,) in [k for k in kept if len(k) == 1] for j, v in [key] if j == i] for i in range(len(attributes))}
        entries = []
        for combo in level:
            entry = F.struct(F.lit(",".join(map(str, combo))).alias("combo"), F.array(*[F.col(f"a{i}") for i in combo]).alias("values"))
            ok = F.lit(True)
            for i in combo if len(combo) > 1 else ():
                ok = ok & F.col(f"a{i}").isin(allowed[i])
            entries.append(F.when(ok, entry))
        counted = rows.select("fails", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
        counted = counted.groupBy("e.combo", "e.values").agg(F.count_if("fails").alias("failing"), F.count("*").alias("rows"))
        for r in counted.where(F.col("failing") >= support * total["failing"]).collect():
            kept[tuple(zip(map(int, r.combo.split(",")), r["values"], strict=True))] = (r.failing, r.rows)
        last = {tuple(i for i, _ in k) for k in kept if len(k) == len(level[0])}
        names = sorted({i for combo in last for i in combo})
        level = [c for c in combinations(names, len(level[0]) + 1) if all(part in last for part in combinations(c, len(level[0])))]
    rate = {k: f / n for k, (f, n) in kept.items()}
    out = []
    for key, (f, n) in kept.items():
        parts = [p for size in range(1, len(key)) for p in combinations(key, size)]
        if rate[key] / overall >= lift and all(rate[key] >= gain * rate[p] for p in parts):
            out.append((" & ".join(f"{attributes[i]}={v}" for i, v in key), len(key), f, n, f / total["failing"], rate[key], rate[key] / overall))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: (-r[6], -r[4], r[0])), schema)
