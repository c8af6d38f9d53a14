"""Records that mean the same thing: equal after normalising, or likely the same by the agreement of their fields."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

from .running import running


def normalised(c: Column) -> Column:
    """Lower case, without spaces and punctuation; null where nothing is left."""
    text = F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(text) > 0, text)


def normalised_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, form, variants, n, failing: the values of each column that are written in several ways.

    `form` is the normalised value, `variants` how many spellings it has, `n` its rows, `failing` the rows beyond those of its most
    frequent spelling. Values are counted before they are normalised, so a frequent one moves as one row."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(entries).alias("e")).where("e.value is not null").groupBy("e.column", "e.value").agg(F.count("*").alias("n"))
    forms = values.withColumn("form", normalised(F.col("value"))).where("form is not null")
    forms = forms.groupBy("column", "form").agg(F.count("*").alias("variants"), F.sum("n").alias("n"), F.max("n").alias("most"))
    return forms.where("variants > 1").select("column", "form", "variants", "n", (F.col("n") - F.col("most")).alias("failing"))


@dataclass(frozen=True)
class Field:
    """A field to compare. Two values agree if their normalised forms are equal, or are at most `edits` edits apart."""

    name: str
    edits: int = 0


def record_links(df: DataFrame, key: str, fields: list[Field], blocks: list[list[str]], probability: float = 0.9, block_size: int = 100, rounds: int = 50) -> DataFrame:
    """left, right, pattern, weight, probability: pairs of records that are likely the same, by Fellegi and Sunter's model.

    Candidate pairs share the normalised values of the columns of one of `blocks`. Their agreement pattern, one digit a field (1
    agree, 0 differ, - one is null), is all the model reads: the chances of agreement among matches and among others, and the share of
    matches, are learned by expectation maximisation over the counts of the patterns (at most 3 to the number of fields, so the
    learning is one small sum each round). `weight` is the sum of log2 likelihood ratios.

    Records equal in all fields and block columns are one record: the least key stands for them, and every other one is linked to it
    with probability 1. A block of more than `block_size` such records is not compared as a whole: its records are ordered by their
    fields, and cut into runs of `block_size` that overlap by half. A record is thus compared with those beside it, work is
    bounded by the number of records times `block_size`, and the other blocks find what lies farther apart. Records without a
    value in a block's columns are in no block of that kind. Null keys are left out; keys are taken as unique.
    """
    names = sorted({f.name for f in fields} | {c for b in blocks for c in b})
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[normalised(F.col(c)).alias(f"f_{c}") for c in names])
    forms = [f"f_{c}" for c in names]
    # One text for all fields, a null apart from every value: equal records meet by it, however many they are.
    whole = F.concat_ws("\1", *[F.coalesce(F.concat(F.lit("="), f), F.lit("-")) for f in forms])
    rows = rows.withColumn("whole", whole)
    firsts = rows.groupBy("whole").agg(F.min("k").alias("first"))
    rows = cut_lineage(rows.join(firsts, "whole").drop("whole"))
    same = rows.where("k <> first").select(F.col("first").alias("left"), F.col("k").alias("right"), F.lit("=").alias("pattern"), F.lit(None).cast("double").alias("weight"), F.lit(1.0).alias("probability"))
    one = rows.where("k = first").drop("first")
    runs = None
    half = max(1, block_size // 2)
    for number, columns in enumerate(blocks):
        in_block = one.where(" and ".join(f"f_{c} is not null" for c in columns)).withColumn("block", F.concat_ws("\1", F.lit(number), *[F.col(f"f_{c}") for c in columns]))
        size = in_block.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > block_size)
        placed = in_block.join(size, "block", "left")
        # Only records of large blocks are ordered, over range partitions.
        head = F.concat_ws("\1", *[F.coalesce(F.col(f), F.lit("")) for f in forms])
        large = placed.where("size is not null").withColumn("head", head)
        large = running(large, ["block"], ["head", "k"], {"place": F.lit(1)}).withColumn("run", F.floor((F.col("place") - 1) / half))
        large = large.withColumn("run", F.explode(F.array(F.col("run"), F.col("run") + 1)))
        part = placed.where("size is null").select("k", *forms, "block", F.lit(0).cast("long").alias("run")).unionByName(large.select("k", *forms, "block", "run"))
        runs = part if runs is None else runs.unionByName(part)
    a, b = (runs.select(F.col("k").alias(f"{s}_k"), *[F.col(f).alias(f"{s}_{f}") for f in forms], "block", "run") for s in ("a", "b"))
    pairs = a.join(b, ["block", "run"]).where("a_k < b_k")

    def agreement(f: Field) -> Column:
        x, y = F.col(f"a_f_{f.name}"), F.col(f"b_f_{f.name}")
        close = x == y if f.edits == 0 else (F.levenshtein(x, y, f.edits) >= 0)
        return F.when(x.isNull() | y.isNull(), "-").when(close, "1").otherwise("0")

    pairs = pairs.select(F.col("a_k").alias("left"), F.col("b_k").alias("right"), F.concat(*[agreement(f) for f in fields]).alias("pattern"))
    pairs = cut_lineage(pairs.dropDuplicates(["left", "right"]))
    counts = {r.pattern: r.n for r in pairs.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return same
    weights = _learned(counts, len(fields), rounds)
    model = df.sparkSession.createDataFrame([(p, float(w), float(q)) for p, (w, q) in weights.items()], "pattern string, weight double, probability double")
    linked = pairs.join(F.broadcast(model), "pattern").where(F.col("probability") >= probability)
    return same.unionByName(linked.select("left", "right", "pattern", "weight", "probability"))


def _learned(counts: dict[str, int], fields: int, rounds: int) -> dict[str, tuple[float, float]]:
    """Weight and match probability of every agreement pattern."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    agree = np.array([[c == "1" for c in p] for p in patterns], dtype=float)
    known = np.array([[c != "-" for c in p] for p in patterns], dtype=float)
    m, u, share = np.full(fields, 0.9), np.clip((n @ agree) / np.maximum(n @ known, 1), 0.01, 0.5), 0.1
    for _ in range(rounds):
        g = _posterior(agree, known, m, u, share)
        seen, unseen = (n * g) @ known, (n * (1 - g)) @ known
        m = np.clip((n * g) @ agree / np.maximum(seen, 1e-9), 1e-4, 1 - 1e-4)
        u = np.clip((n * (1 - g)) @ agree / np.maximum(unseen, 1e-9), 1e-4, 1 - 1e-4)
        share = float(np.clip((n @ g) / n.sum(), 1e-6, 1 - 1e-6))
    ratio = _ratio(agree, known, m, u)
    return {p: (w, q) for p, w, q in zip(patterns, ratio / np.log(2), _posterior(agree, known, m, u, share), strict=True)}


def _ratio(agree: np.ndarray, known: np.ndarray, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    return agree @ np.log(m / u) + (known - agree) @ np.log((1 - m) / (1 - u))


def _posterior(agree: np.ndarray, known: np.ndarray, m: np.ndarray, u: np.ndarray, share: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_ratio(agree, known, m, u) + np.log(share / (1 - share)), -700, 700)))
