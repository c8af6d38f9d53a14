"""Mixing sources to target weights by a budget over a tree of domains, languages and sources.

Everything is DataFrame expressions. The budget flows down the tree: at each node, children get parts by weight, but no child
more than its leaves can give in all epochs; what a child cannot take goes to its siblings by weight, and only what all of
them cannot take is left to the parent's siblings. A leaf's rows are in seeded order, another one in each epoch, and the leaf
gives the longest prefix of its epochs within its budget. A prefix is found by token sums of 4,096 hash ranges per leaf and
epoch, so no task sorts a leaf, and only the range where the prefix ends is summed by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import join_small, stored

SEED = "mix"
FRACTION = 0.8
EPOCHS = 2
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}
UNKNOWN = "unknown"
LEVELS = ("domain", "language", "origin")


def domain_of(source: Column) -> Column:
    """Two domains by a hash of the source's name, as the tables have no domain of their own."""
    return F.when(F.substring(F.md5(F.coalesce(source, F.lit(UNKNOWN)).cast("binary")), 1, 1) < "8", "d0").otherwise("d1")


def mix_sources(
    df: DataFrame, domain: Callable[[Column], Column] = domain_of, lang: str = "lang", source: str = "source", doc_id: str = "doc_id", text: str = "text",
    weights: Mapping[str, Mapping[str, float]] | None = None, fraction: float = FRACTION, epochs: int = EPOCHS, seed: str = SEED, into: str | None = "mix",
) -> DataFrame:
    """The rows of `df` that the mix takes, with epoch, n_tokens, domain, language and origin as fields of the column `into`, which
    takes the place of one of that name; with None, the table's own columns alone.

    `weights` has a mapping for any of domain, language and origin (the source); what it does not name weighs 1. The budget is
    `fraction` of all tokens (words between blanks). A row is given once in each epoch that reaches it; rows with equal ids
    share a place in the order and are taken together or not at all. Null texts have no token, and null or unnamed languages
    and sources are leaves called `unknown`. An empty table gives an empty mix.
    """
    weights = weights if weights is not None else {"language": LANGUAGE_WEIGHTS}
    # Numbered names keep the table's own columns apart from those made here.
    names = df.columns
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    lang, source, doc_id, text = (f"c{names.index(c)}" for c in (lang, source, doc_id, text))
    leaf = F.struct(
        domain(F.col(source)).alias("domain"),
        F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("language"), F.coalesce(F.col(source), F.lit(UNKNOWN)).alias("origin"),
    )
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))

    narrow = stored(df.select(F.col(doc_id), leaf.alias("leaf"), tokens.alias("n_tokens")).select("*", "leaf.*").drop("leaf"))
    narrow = narrow.withColumn("epoch", F.explode(F.expr(f"sequence(0, {epochs - 1})"))).withColumn("place", place)
    ends = _ends(narrow, weights, fraction, epochs)
    n_ends = ends.count()
    rows = df.select(df["*"], leaf.alias("mix_leaf"), tokens.alias("mix_tokens"), F.explode(F.expr(f"sequence(0, {epochs - 1})")).alias("mix_epoch"))
    rows = rows.withColumn("mix", F.struct(F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), "mix_leaf.domain", "mix_leaf.language", "mix_leaf.origin"))
    at = F.md5(F.concat_ws(":", F.lit(seed), F.col("mix_epoch"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("mix_place", at).withColumn("mix_key", F.concat_ws("\x01", "mix_leaf.domain", "mix_leaf.language", "mix_leaf.origin", F.col("mix_epoch").cast("string")))
    ends = ends.select(F.concat_ws("\x01", "domain", "language", "origin", F.col("epoch").cast("string")).alias("mix_key"), F.col("end").alias("mix_end"))
    chosen = join_small(rows, ends, ["mix_key"], "inner", n_ends).where("mix_place <= mix_end")
    added = [] if into is None else [F.col("mix").alias(into)]
    return chosen.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != into], *added)


def quotas(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], budget: float) -> DataFrame:
    """Budget of every leaf (domain, language, origin, cap): the tree's levels are filled from the top."""
    nodes = leaves.withColumn("quota", F.lit(budget))
    for depth, level in enumerate(LEVELS):
        parents, group = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        given = weights.get(level, {})
        weight = F.lit(1.0)
        for name, value in given.items():
            weight = F.when(F.col(level) == name, float(value)).otherwise(weight)
        caps = nodes.groupBy(*group).agg(F.sum("cap").cast("double").alias("room"), F.first("quota").alias("quota")).withColumn("weight", weight)
        ordered = Window.partitionBy(*parents).orderBy(F.col("room") / F.col("weight"), level)
        before = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
        caps = caps.withColumn("rate", (F.col("quota") - before) / left).withColumn("full", F.col("room") <= F.col("rate") * F.col("weight"))
        rate = F.max(F.when(~F.col("full"), F.col("rate"))).over(Window.partitionBy(*parents))
        filled = caps.withColumn("share", F.when(F.col("full"), F.col("room")).otherwise(rate * F.col("weight"))).select(*group, "share")
        nodes = nodes.join(filled, group).withColumn("quota", F.col("share")).drop("share")
    return nodes


def _ends(narrow: DataFrame, weights: Mapping[str, Mapping[str, float]], fraction: float, epochs: int) -> DataFrame:
    """Place of the last row that each leaf gives in each epoch; no row where an epoch gives none."""
    leaf = ["domain", "language", "origin"]
    sums = stored(narrow.groupBy(*leaf, "epoch", F.substring("place", 1, 3).alias("range")).agg(F.sum("n_tokens").alias("tokens")))
    leaves = sums.where("epoch = 0").groupBy(*leaf).agg(F.sum("tokens").alias("have"))
    total = leaves.agg(F.sum("have")).first()[0] or 0
    given = quotas(leaves.withColumn("cap", F.col("have") * epochs), weights, float(int(total * fraction)))
    # Whole tokens, and the part of them that falls to each epoch.
    given = given.select(*leaf, "have", F.floor(F.col("quota") + 1e-6).cast("long").alias("quota"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("have"), F.col("quota") - F.col("epoch") * F.col("have")))
    by_range = Window.partitionBy(*leaf, "epoch").orderBy("range")
    reach = sums.join(given, leaf).withColumn("part", part).withColumn("upto", F.sum("tokens").over(by_range))
    whole = reach.where("upto <= part and part > 0").groupBy(*leaf, "epoch").agg(F.max("range").alias("range"))
    cut = reach.where("upto > part and upto - tokens < part").select(*leaf, "epoch", "range", "part", (F.col("upto") - F.col("tokens")).alias("before"))
    cut = stored(cut)
    n_cut = cut.count()
    rows = join_small(narrow.withColumn("range", F.substring("place", 1, 3)), cut, [*leaf, "epoch", "range"], "inner", n_cut)
    sums_by_row = F.sum("n_tokens").over(Window.partitionBy(*leaf, "epoch").orderBy("place")) + F.col("before")
    last = rows.withColumn("upto", sums_by_row).where("upto <= part").groupBy(*leaf, "epoch").agg(F.max("place").alias("end"))
    # All places of a whole range come before the next range's first, "g" being after every hexadecimal digit.
    ends = whole.select(*leaf, "epoch", F.concat("range", F.lit("g")).alias("end")).unionByName(last)
    return stored(ends.groupBy(*leaf, "epoch").agg(F.max("end").alias("end")))
