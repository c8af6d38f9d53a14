"""One scan: sample, profile, generate, evaluate and score a set of tables.

Tables are handled in batches, and each step is one job for the whole batch. What comes back to the
driver is one row per table, column or check; everything else stays a DataFrame.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Asset, CheckSpec, specs_frame, specs_from_rows
from ..operators import profile as P
from ..operators.checks import check_types, generate, known_counts, parent_keys
from ..operators.evaluate import (
    Store, check_results, count_checks_now, drop_weak_candidates, type_frame, union_all,
)
from ..operators.examples import choose_checks, examples, failing_values, findings
from ..operators.health import health_items
from ..operators.histogram import (
    ColumnMeta, build_histogram, column_meta, held_histogram, meta_frame, of_columns, text_values, top_values,
)
from ..operators.lifecycle import not_runnable, reconcile_frames
from ..operators.quantiles import quantiles
from ..operators.score import scores
from ..session import collect_small, instant, local_frame, require_utc, run_together
from ..sources.sampling import row_counts, sample

log = logging.getLogger(__name__)

# Tables profiled together: enough to fill a cluster with small tables, few enough to plan quickly.
TABLES_PER_BATCH = 16


@dataclass(frozen=True)
class ScanOptions:
    sample_rows: int = 0  # 0 reads every table in full; more draws a sample of larger ones
    seed: int = 42
    by_key: bool = False  # draw samples by key hash, independent of the file layout
    assets: tuple[str, ...] | None = None  # labels or names; all when unset
    now: datetime | None = None  # the time dates are measured against
    examples: bool = True
    declares_keys: bool = False  # whether the source could declare primary keys


@dataclass
class Profiled:
    """The profile tables of a scan and the per-column facts on the driver."""

    store: Store
    assets: dict[str, P.AssetProfile]
    profile: DataFrame
    top: DataFrame
    patterns: DataFrame
    populations: dict[str, int]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


@dataclass
class Scan:
    """The result tables of a scan. `tables()` adds `scan_id` to each for storage."""

    scan_id: str
    started_at: datetime
    profiled: Profiled
    specs: list[CheckSpec]
    unevaluated: list[tuple[CheckSpec, str]]
    results: DataFrame
    evidence: DataFrame
    assets: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    @cached_property
    def findings(self) -> DataFrame:
        return findings(self.results, self.evidence)

    @cached_property
    def scores(self) -> DataFrame:
        return scores(self.results, self.profile.select("asset", "column", "role"), self.assets)

    @cached_property
    def health(self) -> DataFrame:
        return health_items(self.profile, self.assets)

    @property
    def profile(self) -> DataFrame:
        return self.profiled.profile

    @property
    def check_specs(self) -> DataFrame:
        """The reconciled specs; candidates dropped for weak evidence are not among them."""
        spark = self.profiled.store.spark
        specs = specs_frame(spark, self.specs)
        gone = local_frame(spark, [(s.id,) for s, _ in self.unevaluated], "check_id string")
        return specs.join(self.results.select("check_id").union(gone), "check_id", "left_semi")

    @property
    def top(self) -> DataFrame:
        """The values shown per column, masked where the column is personal."""
        return shown_top(self.profiled)

    def tables(self) -> dict[str, DataFrame]:
        spark = self.profiled.store.spark
        gone = local_frame(spark, [(s.id, s.asset, why) for s, why in self.unevaluated], "check_id string, asset string, reason string")
        out = {
            "assets": self.assets, "profile": self.profile.drop("cid"), "top_values": self.top.drop("cid"),
            "patterns": named(self.profiled, self.profiled.patterns), "check_specs": self.check_specs,
            "check_results": self.results, "unevaluated": gone, "findings": self.findings, "scores": self.scores,
            "health": self.health,
        }
        at = instant(self.started_at.replace(tzinfo=None))
        return {k: v.withColumn("scan_id", F.lit(self.scan_id)).withColumn("scanned_at", at) for k, v in out.items()}

    def release(self) -> None:
        """Free what the scan kept cached. Profile, results, findings, scores and health stay, as they are local."""
        for df in self.held:
            df.unpersist()
        self.profiled.release()


def utc(now: datetime | None) -> datetime:
    t = now or datetime.now(timezone.utc)
    if t.tzinfo is not None:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    return t.replace(microsecond=0)


def select_assets(assets: list[Asset], wanted: tuple[str, ...] | None) -> list[Asset]:
    return [a for a in assets if wanted is None or a.label in wanted or a.name in wanted]


# --- phase 1: profiles ------------------------------------------------------------------------------


def profile_assets(spark: SparkSession, assets: list[Asset], options: ScanOptions) -> Profiled:
    """Profile tables batch by batch. A table that cannot be read is recorded with its error."""
    require_utc(spark)
    now = utc(options.now)
    batches = [assets[i : i + TABLES_PER_BATCH] for i in range(0, len(assets), TABLES_PER_BATCH)]
    parts: list[Profiled] = []
    failed: dict[str, P.AssetProfile] = {}
    first = 0  # one running number for all columns of the scan, whichever tables fail
    for batch in batches:
        try:
            parts.append(_profile_batch(spark, batch, options, now, first))
        except PySparkException as e:  # find the table, keep the others
            if len(batch) == 1:
                failed[batch[0].label] = _failed(batch[0], e)
            else:
                at = first
                for a in batch:
                    try:
                        parts.append(_profile_batch(spark, [a], options, now, at))
                    except PySparkException as one:
                        failed[a.label] = _failed(a, one)
                    at += len(a.df.columns)
        first += sum(len(a.df.columns) for a in batch)
    if not parts:
        raise ValueError("no table could be read: " + "; ".join(f"{k}: {v.error}" for k, v in failed.items()))
    done = {label: p for part in parts for label, p in part.assets.items()} | failed
    store = Store(
        spark=spark,
        assets={a.label: a for a in assets},
        read={k: v for part in parts for k, v in part.store.read.items()},
        sampled={k: v for part in parts for k, v in part.store.sampled.items()},
        hist=union_all([part.store.hist for part in parts]),
        meta=union_all([part.store.meta for part in parts]),
        metas=[m for part in parts for m in part.store.metas],
        now=now,
        counted=True,
    )
    return Profiled(
        store=store,
        assets={a.label: done[a.label] for a in assets},
        profile=union_all([part.profile for part in parts]),
        top=union_all([part.top for part in parts]),
        patterns=union_all([part.patterns for part in parts]),
        populations={k: v for part in parts for k, v in part.populations.items()},
        held=[df for part in parts for df in part.held],
    )


def _failed(asset: Asset, e: Exception) -> P.AssetProfile:
    log.warning("cannot profile %s: %s", asset.label, e)
    return P.AssetProfile(asset, error=str(e).splitlines()[0][:500] if str(e) else type(e).__name__)


def histogram_of(spark: SparkSession, assets: list[Asset], read: dict[str, DataFrame], first: int = 0) -> tuple[DataFrame, DataFrame, list[ColumnMeta]]:
    """The lazy histogram and column metadata of tables as read."""
    metas = column_meta(assets, first)
    frames = [(read[a.label], [m for m in metas if m.asset == a.label]) for a in assets]
    return build_histogram(frames), meta_frame(spark, assets, metas), metas


def _profile_batch(spark: SparkSession, assets: list[Asset], options: ScanOptions, now: datetime, first: int) -> Profiled:
    held: list[DataFrame] = []
    try:
        return _profile_tables(spark, assets, options, now, first, held)
    except Exception:
        for df in held:
            df.unpersist()
        raise


def _profile_tables(
    spark: SparkSession, assets: list[Asset], options: ScanOptions, now: datetime, first: int, held: list[DataFrame]
) -> Profiled:
    full_read = options.sample_rows <= 0
    counts = {} if full_read else row_counts(assets)
    read, sampled = {}, {}
    for a in assets:
        df, is_sample = sample(a, options.sample_rows, options.seed, counts.get(a.label, 0), options.by_key)
        if is_sample:
            df = df.persist()
            held.append(df)
        read[a.label], sampled[a.label] = df, is_sample
    hist, meta, metas = histogram_of(spark, assets, read, first)
    hist = held_histogram(hist)
    held.append(hist)

    basic_lazy = P.basic_measures(hist, None, meta, now)
    basic_rows = basic_lazy.collect()  # one row per column; fills the histogram's cache
    basic = local_frame(spark, basic_rows, basic_lazy.schema)
    large = P.large_columns(basic_rows)
    top = top_values(hist, meta).persist()
    held.append(top)

    def numbers() -> tuple[DataFrame, DataFrame]:
        quants = collect_small(quantiles(P.number_values(hist, meta), P.QUANTILES, large, held, P.number_ranges(basic)))
        centres = quants.select("cid", F.col("q")[2].alias("p50")).join(basic.select("cid", "mean", "min_number", "max_number"), "cid")
        return quants, collect_small(P.spread_measures(hist, meta, centres, large, held))

    def kinds() -> DataFrame:
        return collect_small(P.semantic_measures(text_values(hist, meta), meta))

    # The second pass over the numbers and the inference of types do not need each other.
    (quants, spread), semantic = run_together([numbers, kinds])  # type: ignore[misc]
    profile_lazy = P.profile_frame(meta, basic, quants, spread, semantic)
    rows = profile_lazy.collect()
    profile = local_frame(spark, rows, profile_lazy.schema)
    patterns = P.patterns(text_values(hist, meta))
    values, shapes = run_together([lambda: _few_values(hist, meta, rows), lambda: _main_shapes(patterns, profile, rows)])

    out: dict[str, P.AssetProfile] = {}
    for a in assets:
        cols = [
            P.ColumnProfile(r, tuple(values.get(r.cid, ())), tuple(shapes.get(r.cid, ())))
            for r in sorted(rows, key=lambda r: r.position) if r.asset == a.label
        ]
        seen = max((int(c.rows) for c in cols), default=0)
        population = counts[a.label] if sampled[a.label] else seen
        out[a.label] = P.AssetProfile(a, population, seen, sampled[a.label], cols)
    store = Store(spark, {a.label: a for a in assets}, read, sampled, hist, meta, metas, now, counted=True)
    return Profiled(store, out, profile, top, patterns, {k: p.population for k, p in out.items()}, held)


def _few_values(hist: DataFrame, meta: DataFrame, rows: list[Row]) -> dict[int, list[tuple[str, int]]]:
    """The values of columns with at most twenty of them. Those of the other columns are ranked only when they are asked for."""
    few = [r.cid for r in rows if r.logical_type in ("text", "integer") and (r["distinct"] or 0) <= 20]
    out: dict[int, list[tuple[str, int]]] = {}
    for r in top_values(of_columns(hist, few), meta).orderBy("cid", "rank").collect() if few else []:
        out.setdefault(r.cid, []).append((r.value, r.n))
    return out


def _main_shapes(patterns: DataFrame, profile: DataFrame, rows: list[Row]) -> dict[int, list[tuple[str, int]]]:
    """Three shapes per column, for the columns they cover; others are not collected."""
    untyped = [r.cid for r in rows if r.logical_type == "text" and r.non_null >= 50 and not r.semantic_type]
    if not untyped:
        return {}
    first = patterns.filter((F.col("rank") <= 3) & F.col("cid").isin(untyped))
    covered = F.sum("n").over(Window.partitionBy("cid"))  # three rows per column
    kept = first.withColumn("covered", covered).join(F.broadcast(profile.select("cid", "non_null")), "cid")
    out: dict[int, list[tuple[str, int]]] = {}
    for r in kept.filter("covered >= 0.99 * non_null").orderBy("cid", "rank").collect():
        out.setdefault(r.cid, []).append((r.pattern, r.n))
    return out


def named(profiled: Profiled, df: DataFrame) -> DataFrame:
    """A `cid`-keyed frame with table and column names."""
    return df.join(F.broadcast(profiled.profile.select("cid", "asset", "column")), "cid").drop("cid")


def shown_top(profiled: Profiled, shown: int = P.SHOWN_TOP) -> DataFrame:
    from ..functions.semantics import personal_types
    from ..functions.text import mask

    facts = profiled.profile.select(
        "cid", "asset", "column", F.coalesce(F.col("semantic_type").isin(*personal_types()), F.lit(False)).alias("masked")
    )
    rows = profiled.top.filter(F.col("rank") <= shown).join(F.broadcast(facts), "cid")
    return rows.select(
        "cid", "asset", "column", F.when(F.col("masked"), mask(F.col("value"))).otherwise(F.col("value")).alias("value"),
        "n", "rank", "masked",
    )


# --- phase 2: checks --------------------------------------------------------------------------------


def asset_frame(profiled: Profiled, options: ScanOptions) -> DataFrame:
    """One row per table."""
    rows = [
        (label, p.asset.kind, p.population, p.sample_rows, p.sampled, len(p.columns), p.time_series_candidate,
         bool(p.asset.primary_key), options.declares_keys, p.error)
        for label, p in profiled.assets.items()
    ]
    return local_frame(
        profiled.store.spark, rows,
        "asset string, kind string, population bigint, sample_rows bigint, sampled boolean, columns bigint, "
        "time_series_candidate boolean, has_primary_key boolean, declares_keys boolean, error string",
    )


def plan_checks(
    profiled: Profiled, saved: list[CheckSpec] | None = None
) -> tuple[list[CheckSpec], list[CheckSpec], list[tuple[CheckSpec, str]]]:
    """Generate checks, reconcile them with saved ones: all, the ones to evaluate, the ones that cannot be."""
    spark = profiled.store.spark
    readable = {label: p for label, p in profiled.assets.items() if not p.error}
    parents = parent_keys(list(readable.values()))
    fresh = {s.id: s for p in readable.values() for s in generate(p, profiled.assets, parents, profiled.store.now)}
    kept = [s for s in saved or [] if s.asset in readable]
    if not kept and len(readable) == len(profiled.assets):
        return list(fresh.values()), list(fresh.values()), []
    specs = reconcile_frames(specs_frame(spark, list(fresh.values())), specs_frame(spark, kept)).filter("outcome NOT IN ('retired', 'dropped')").persist()
    columns = local_frame(spark, [(label, c.column) for label, p in readable.items() for c in p.columns], "asset string, column string")
    reasons = {r.check_id: r.reason for r in not_runnable(specs, columns, list(check_types())).collect()}
    place = {check_id: n for n, check_id in enumerate([*fresh, *(s.id for s in kept)])}
    everything = sorted(specs_from_rows(specs.collect()), key=lambda s: place[s.id])
    specs.unpersist()
    return everything, [s for s in everything if s.id not in reasons], [(s, reasons[s.id]) for s in everything if s.id in reasons]


def evaluate(profiled: Profiled, specs: list[CheckSpec], options: ScanOptions) -> tuple[DataFrame, list[DataFrame]]:
    """Results of the given checks, persisted: one row per check."""
    held: list[DataFrame] = []
    spark = profiled.store.spark
    known = known_counts(profiled.assets, specs, profiled.store.now)
    counts = count_checks_now(profiled.store, specs, profiled.populations, held, known)
    results = check_results(counts, specs_frame(spark, specs), asset_frame(profiled, options), type_frame(spark))
    return drop_weak_candidates(results), held


def run_scan(
    spark: SparkSession,
    assets: list[Asset],
    options: ScanOptions | None = None,
    saved: list[CheckSpec] | None = None,
    scan_id: str = "scan",
) -> Scan:
    """Assess every table. `saved` are the stored checks of earlier scans."""
    options = options or ScanOptions()
    profiled = profile_assets(spark, select_assets(assets, options.assets), options)
    everything, runnable, unable = plan_checks(profiled, saved)
    results, held = evaluate(profiled, runnable, options)
    results = collect_small(results)
    evidence = evidence_for(profiled, runnable, results) if options.examples else None
    if evidence is None:
        evidence = local_frame(spark, [], "check_id string, examples array<struct<value:string,n:bigint,masked:boolean>>")
    else:
        evidence = collect_small(evidence)
    return Scan(
        scan_id=scan_id,
        started_at=profiled.store.now,
        profiled=profiled,
        specs=everything,
        unevaluated=unable,
        results=results,
        evidence=evidence,
        assets=asset_frame(profiled, options),
        held=held,
    )


def evidence_for(profiled: Profiled, specs: list[CheckSpec], results: DataFrame) -> DataFrame:
    """Examples of the failing checks that get some."""
    chosen = {r.check_id for r in choose_checks(results).select("check_id").collect()}
    personal = {(label, c.column) for label, p in profiled.assets.items() for c in p.columns if c.personal}
    return examples(profiled.store, [s for s in specs if s.id in chosen], personal)


def evidence_rows(profiled: Profiled, specs: list[CheckSpec]) -> DataFrame:
    """All failing values of the given checks with their counts."""
    return failing_values(profiled.store, specs)


def scan_statistics(scan: Scan) -> DataFrame:
    """One row: tables, failed tables, columns, scoring and proposed checks, findings."""
    a = scan.assets.agg(
        F.count(F.lit(1)).alias("assets"), F.count("error").alias("assets_failed"), F.sum("columns").alias("columns")
    )
    r = scan.results.agg(
        F.count_if("scores").alias("checks_active"), F.count_if(~F.col("scores")).alias("checks_proposed")
    )
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(r.select("*", one), "_one").drop("_one")
