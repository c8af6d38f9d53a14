"""The check types: when one is generated from a profile, and which values fail it.

A value check is a predicate on one value. It is evaluated over the value histogram, where its
parameters arrive as columns, and over raw rows for the failing rows themselves, where they are
literals. `register_check` adds another one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..model import NOT_SCALAR, NUMERIC, TEMPORAL, CheckSpec
from .histogram import Value
from .profile import YEAR_1900, YEAR_2200, AssetProfile, ColumnProfile, to_micros

KEYISH = ("key", "foreign_key")
Params = Callable[[str], Column]

# Names of date columns that may lie ahead, and of columns that show a feed's age.
AHEAD_HINTS = ("due", "expir", "valid_to", "valid_until", "end", "until", "planned", "scheduled", "deadline", "forecast")
FEED_SUFFIXES = ("_at", "_time", "_date", "_ts", "timestamp", "loaded", "updated", "created")
FEED_NAMES = ("ts", "time", "date")
# Column names that form a start and an end.
AFFIX_PAIRS = (
    ("_start", "_end"),
    ("start_", "end_"),
    ("_from", "_to"),
    ("min_", "max_"),
)
NAMED_PAIRS = (
    ("valid_from", "valid_to"),
    ("created_at", "updated_at"),
    ("start_date", "end_date"),
    ("ordered_at", "shipped_at"),
    ("order_date", "ship_date"),
)
PAIR_SUFFIXES = tuple(p for p in AFFIX_PAIRS if p[0].startswith("_"))
PAIR_PREFIXES = tuple(p for p in AFFIX_PAIRS if p[0].endswith("_"))


@dataclass(frozen=True)
class CheckType:
    """One check type. `how` says what evaluates it:

    value    a predicate on the histogram (`fail`), counting rows or, with `repeats`, rows after the first
    nulls    null rows of a column
    casing   spelling variants over the histogram
    parent   anti join with the parent's keys
    order    a comparison of two columns of a row
    copies   identical rows or key tuples
    table    known from the table's profile
    """

    name: str
    title: str
    dimension: str
    how: str
    phrase: str
    next_step: str
    severity: str = "medium"
    kind: str = "rule"
    level: str = "column"
    applies: Callable[[ColumnProfile], bool] | None = None
    params: Callable[[ColumnProfile], dict[str, Any]] = lambda c: {}
    tolerance: Callable[[ColumnProfile], float] = lambda c: 0.0
    severity_for: Callable[[ColumnProfile], str] | None = None
    fields: str = "on boolean"
    typed: Callable[[dict[str, Any], datetime], tuple[Any, ...]] = lambda p, now: (True,)
    fail: Callable[[Value, Params], Column] | None = None
    repeats: bool = False
    # Failing rows where the column's profile already tells them exactly, else None.
    known: Callable[[ColumnProfile, dict[str, Any], datetime], int | None] = lambda c, p, now: None

    @property
    def from_values(self) -> bool:
        """Examples come with the evaluation, whatever the number of failing checks."""
        return self.name in ("semantic_format", "casing_variants")


_REGISTRY: dict[str, CheckType] = {}


def register_check(c: CheckType) -> CheckType:
    """Add (or replace) a check type."""
    _REGISTRY[c.name] = c
    return c


def check_types() -> dict[str, CheckType]:
    return dict(_REGISTRY)


def spec_id(check: str, asset: str, target: str) -> str:
    return f"{check}:{asset}:{target}"


def make_spec(
    c: CheckType, asset: str, column: str | None = None, columns: tuple[str, ...] = (),
    params: dict[str, Any] | None = None, severity: str | None = None, tolerance: float = 0.0,
    origin: str = "generated", status: str | None = None,
) -> CheckSpec:
    return CheckSpec(
        id=spec_id(c.name, asset, column or ",".join(columns)), type=c.name, asset=asset, column=column,
        columns=columns, params=params or {}, dimension=c.dimension, severity=severity or c.severity, kind=c.kind,
        status=status or ("active" if c.kind == "rule" else "proposed"), max_fail_ratio=tolerance, origin=origin,
    )


def new_spec(check: str, asset: str, column: str | None = None, **kw: Any) -> CheckSpec:
    """A spec written by hand; a manual check is kept as it is whatever the profile says."""
    return make_spec(_REGISTRY[check], asset, column, **({"origin": "manual"} | kw))


# --- the value checks -------------------------------------------------------------------------------


def _text_with_values(c: ColumnProfile) -> bool:
    return c.logical_type == "text" and c.non_null > 0


def _many(c: ColumnProfile) -> bool:
    return c.non_null >= 50


def _conformance_applies(c: ColumnProfile) -> bool:
    if c.logical_type != "text" or c.non_null < 10 or c.semantic_type:
        return False
    numbers, dates = c.numeric_like / c.non_null, c.date_like / c.non_null
    return dates >= 0.9 or (numbers >= 0.9 and c.leading_zero_numbers == 0)


def _conformance_params(c: ColumnProfile) -> dict[str, Any]:
    expected = "number" if c.numeric_like >= c.date_like else "date"
    return {"expected": expected, "majority": round(max(c.numeric_like, c.date_like) / c.non_null, 4)}


def _pattern_applies(c: ColumnProfile) -> bool:
    if c.logical_type != "text" or not _many(c) or c.semantic_type or not c.patterns:
        return False
    return sum(n for _, n in c.patterns[:3]) >= 0.99 * c.non_null


def _accepted_applies(c: ColumnProfile) -> bool:
    return (
        c.logical_type in ("text", "integer")
        and c.role not in KEYISH
        and 2 <= c.distinct <= 20
        and _many(c)
        and c.distinct_ratio <= 0.2
        and not c.personal
    )


def _range_params(c: ColumnProfile) -> dict[str, Any]:
    if c.logical_type in NUMERIC:
        return {"min": c.min_number, "max": c.max_number}
    return {"min": c.oldest, "max": c.newest}


def _range_typed(p: dict[str, Any], now: datetime) -> tuple[Any, ...]:
    if isinstance(p["min"], str):
        return (None, None, to_micros(datetime.fromisoformat(p["min"])), to_micros(datetime.fromisoformat(p["max"])))
    return (float(p["min"]), float(p["max"]), None, None)


def _null_severity(c: ColumnProfile) -> str:
    return "critical" if c.role in KEYISH else "high" if c.role == "timestamp" else "low"


def _null_tolerance(c: ColumnProfile) -> float:
    return 0.0 if c.role in (*KEYISH, "timestamp") or c.declared_not_null else 1.0


def _known_misfits(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    like = c.numeric_like if p["expected"] == "number" else c.date_like
    return None if like is None else c.non_null - like


def _known_malformed(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    # A test someone registered may answer null, which neither passes nor fails.
    if c.semantic_type is None or p["semantic_type"] != c.semantic_type or S.TESTS[c.semantic_type] not in S.OWN_TESTS:
        return None
    return c.non_null - round(c.semantic_share * c.non_null)


def _known_shapes(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    found, usual = dict(c.patterns), set(p["patterns"])
    return c.non_null - sum(found[x] for x in usual) if usual and usual <= set(found) else None


def _known_unlisted(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    if not c.top or len(c.top) != c.distinct or None in p["values"]:
        return None
    return sum(n for value, n in c.top if value not in set(p["values"]))


def _inside(low: Any, high: Any, least: Any, most: Any) -> int | None:
    """No row fails where the bounds hold the least and the largest value."""
    return 0 if None not in (low, high, least, most) and low <= least and most <= high else None


def _known_out_of_range(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    low, high, low_us, high_us = _range_typed(p, now)
    if c.logical_type in NUMERIC:
        return _inside(low, high, c.min_number, c.max_number)
    return _inside(low_us, high_us, c.min_us, c.max_us) if c.logical_type in TEMPORAL else None


def _known_outliers(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    if c.min_number is None:
        return None
    width = float(p["z"]) * 1.4826 * float(p["mad"])
    return 0 if all(abs(x - float(p["median"])) <= width for x in (c.min_number, c.max_number)) else None


def _known_implausible(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    return None if c.before_1900 is None else c.before_1900 + c.after_2200


def _known_repeats(c: ColumnProfile, p: dict[str, Any], now: datetime) -> int | None:
    return None if c.distinct is None else c.non_null - c.distinct


def _may_lie_ahead(name: str) -> bool:
    return any(h in name.lower() for h in AHEAD_HINTS)


register_check(CheckType(
    "not_null", "Missing values", "completeness", "nulls", "have no value in",
    "Trace the load that leaves this column empty; retire the check if a value is optional.",
    applies=lambda c: True, severity_for=_null_severity, tolerance=_null_tolerance,
    known=lambda c, p, now: c.nulls,
))
register_check(CheckType(
    "not_blank", "Blank and placeholder values", "completeness", "value", "are blank or a placeholder in",
    "Load placeholders as null, then decide whether a value is required.",
    applies=_text_with_values, fail=lambda v, p: X.is_blank(v.string),
    known=lambda c, p, now: c.blanks,
))
register_check(CheckType(
    "row_count", "Empty table", "completeness", "table", "expected in", "Look at the last load of this table.",
    severity="critical", level="asset",
))
register_check(CheckType(
    "type_conformance", "Values of the wrong type", "validity", "value", "do not have the majority's type in",
    "Cast the column while loading and set aside the rows that do not cast.",
    applies=_conformance_applies, params=_conformance_params,
    fields="expected string", typed=lambda p, now: (p["expected"],),
    fail=lambda v, p: F.when(p("expected") == "number", ~X.is_numeric_like(v.string)).otherwise(~X.is_date_like(v.string)),
    known=_known_misfits,
))
register_check(CheckType(
    "semantic_format", "Invalid format", "validity", "value", "are not valid for the type of",
    "Validate where the value is entered; for bank and tax numbers look at the source's input mask.",
    severity="high", applies=lambda c: c.logical_type == "text" and c.semantic_type is not None,
    params=lambda c: {"semantic_type": c.semantic_type},
    fields="semantic_type string", typed=lambda p, now: (p["semantic_type"],),
    fail=lambda v, p: ~S.valid_as(v.string, p("semantic_type")),
    known=_known_malformed,
))
register_check(CheckType(
    "pattern", "Unusual value shape", "validity", "value", "do not have the usual shape in",
    "Approve the new shapes if they are meant; otherwise trace where they come from.",
    kind="baseline", applies=_pattern_applies,
    params=lambda c: {"patterns": [p for p, _ in c.patterns[:3] if p]},
    fields="patterns array<string>", typed=lambda p, now: (list(p["patterns"]),),
    fail=lambda v, p: ~F.array_contains(p("patterns"), X.pattern_class(v.string)),
    known=_known_shapes,
))
register_check(CheckType(
    "accepted_values", "Unexpected category", "validity", "value", "have a value outside the observed set in",
    "Approve the new categories if they are meant; otherwise trace where they come from.",
    severity="high", kind="baseline", applies=_accepted_applies,
    params=lambda c: {"values": sorted(t for t, _ in c.top)},
    fields="accepted array<string>", typed=lambda p, now: (list(p["values"]),),
    fail=lambda v, p: ~F.array_contains(p("accepted"), v.text),
    known=_known_unlisted,
))
register_check(CheckType(
    "length", "Text too short or too long", "validity", "value", "have an unusual length in",
    "Approve the new lengths if they are meant; otherwise trace where they come from.",
    severity="low", kind="baseline",
    applies=lambda c: c.logical_type == "text" and _many(c) and c.min_length is not None,
    params=lambda c: {"min": c.min_length, "max": c.max_length},
    fields="lo bigint, hi bigint", typed=lambda p, now: (int(p["min"]), int(p["max"])),
    fail=lambda v, p: ~F.char_length(v.string).between(p("lo"), p("hi")),
    known=lambda c, p, now: _inside(int(p["min"]), int(p["max"]), c.min_length, c.max_length),
))
register_check(CheckType(
    "whitespace", "Leading or trailing spaces", "validity", "value", "have outer spaces in",
    "Trim while loading, and look at the export's settings.",
    severity="low", applies=_text_with_values, fail=lambda v, p: X.has_outer_spaces(v.string),
    known=lambda c, p, now: c.whitespace,
))
register_check(CheckType(
    "non_printing", "Control and invisible characters", "validity", "value", "hold invisible characters in",
    "Clean while loading, and look at the export's encoding.",
    applies=_text_with_values, fail=lambda v, p: X.has_non_printing(v.string),
    known=lambda c, p, now: c.non_printing,
))
register_check(CheckType(
    "range", "Outside the observed range", "accuracy", "value", "are outside the observed range of",
    "Approve the new range if it is meant; otherwise trace where the values come from.",
    severity="high", kind="baseline",
    applies=lambda c: c.logical_type in (*NUMERIC, *TEMPORAL) and _many(c) and c.role not in KEYISH
    and (c.min_number is not None or c.min_us is not None),
    params=_range_params, fields="lo double, hi double, lo_us bigint, hi_us bigint", typed=_range_typed,
    fail=lambda v, p: F.coalesce(~v.number.between(p("lo"), p("hi")), ~v.micros.between(p("lo_us"), p("hi_us"))),
    known=_known_out_of_range,
))
register_check(CheckType(
    "outliers", "Extreme values", "accuracy", "value", "are far from the median of",
    "Look at the examples; a factor of 100 or 1,000 points to a unit or decimal separator.",
    severity="low", applies=lambda c: c.role == "measure" and c.logical_type in NUMERIC and c.non_null >= 30
    and c.p50 is not None and bool(c.mad),
    params=lambda c: {"median": c.p50, "mad": c.mad, "z": 6.0}, tolerance=lambda c: 0.01,
    fields="median double, width double",
    typed=lambda p, now: (float(p["median"]), float(p["z"]) * 1.4826 * float(p["mad"])),
    fail=lambda v, p: F.abs(v.number - p("median")) > p("width"),
    known=_known_outliers,
))
register_check(CheckType(
    "future_dates", "Dates in the future", "accuracy", "value", "lie more than a day ahead in",
    "Look at time zones and default dates in the source.",
    severity="high", applies=lambda c: c.logical_type in TEMPORAL and not _may_lie_ahead(c.column),
    fields="after_us bigint", typed=lambda p, now: (to_micros(now + timedelta(days=1)),),
    fail=lambda v, p: v.micros > p("after_us"),
    known=lambda c, p, now: c.future,
))
register_check(CheckType(
    "implausible_dates", "Dates before 1900 or after 2200", "accuracy", "value", "are before 1900 or after 2200 in",
    "Look at default dates in the source.", applies=lambda c: c.logical_type in TEMPORAL,
    fail=lambda v, p: (v.micros < YEAR_1900) | (v.micros > YEAR_2200),
    known=_known_implausible,
))
register_check(CheckType(
    "foreign_key", "Orphan references", "consistency", "parent", "refer to missing parents in",
    "Load parents before children, or find where the parents were removed.", severity="critical",
))
register_check(CheckType(
    "column_order", "Start after end", "consistency", "order", "start after they end in",
    "See whether the load swaps the two columns.", severity="high", level="asset",
))
register_check(CheckType(
    "casing_variants", "Same value, different spelling", "consistency", "casing", "are spelling variants in",
    "Normalise the spelling while loading, or map the variants to one code.", severity="low",
    applies=lambda c: c.logical_type == "text" and c.distinct >= 2 and c.role not in KEYISH and not c.personal,
))
register_check(CheckType(
    "unique", "Duplicate keys", "uniqueness", "value", "repeat an earlier key in",
    "Find the double load; declare the key where the store can enforce it.", severity="critical",
    applies=lambda c: c.role == "key" and c.logical_type not in NOT_SCALAR,
    fail=lambda v, p: F.lit(True), repeats=True,
    known=_known_repeats,
))
register_check(CheckType(
    "duplicate_rows", "Identical rows", "uniqueness", "copies", "copy another row in",
    "Find the double load; declare a key where the store can enforce it.", severity="high", level="asset",
))
register_check(CheckType(
    "freshness", "Data not updated", "currentness", "table", "newest value is too old in",
    "Look at the schedule of the load that writes this table.", severity="high", kind="baseline", level="asset",
))


# --- what the profile tells ---------------------------------------------------------------------------


def known_counts(assets: dict[str, AssetProfile], specs: list[CheckSpec], now: datetime) -> dict[str, tuple[int, int]]:
    """`(n, k)` of the checks whose evaluated and failing rows follow from the profile of the same rows, by check."""
    columns = {(label, c.column): c for label, a in assets.items() for c in a.columns}
    out: dict[str, tuple[int, int]] = {}
    for s in specs:
        t = _REGISTRY[s.type]
        if t.how in ("value", "nulls") and s.column:
            c = columns[s.asset, s.column]
            k = t.known(c, s.params, now)
            if k is not None:
                out[s.id] = (c.rows if t.how == "nulls" else c.non_null, k)
        elif t.how == "copies" or (t.how == "value" and s.columns):
            parts = [columns[s.asset, c] for c in s.columns]
            # A column that repeats no value keeps all rows apart. Rows without a part of a key are not evaluated.
            if any(c.nulls == 0 and c.distinct == c.rows for c in parts) and (t.how == "copies" or all(c.nulls == 0 for c in parts)):
                out[s.id] = (assets[s.asset].sample_rows, 0)
    return out


# --- generation -------------------------------------------------------------------------------------


def generate(asset: AssetProfile, assets: dict[str, AssetProfile], parents: dict[str, list[tuple[str, str]]], now: datetime) -> list[CheckSpec]:
    """All checks a table's profile calls for, in registry order. `parents` are the `parent_keys` of all tables."""
    special = {
        "row_count": lambda c: [make_spec(c, asset.label)],
        "foreign_key": lambda c: _references(c, asset, assets, parents),
        "column_order": lambda c: _ordered_pairs(c, asset),
        "duplicate_rows": lambda c: _row_identity(c, asset),
        "freshness": lambda c: _feeds(c, asset, now),
    }
    out: list[CheckSpec] = []
    for c in _REGISTRY.values():
        if c.name in special:
            out += special[c.name](c)
            continue
        for col in asset.columns:
            if c.applies is None or not c.applies(col):
                continue
            if c.name == "unique" and _part_of_tuple(asset, col.column):
                continue
            out.append(
                make_spec(c, asset.label, col.column, params=c.params(col), tolerance=c.tolerance(col),
                          severity=c.severity_for(col) if c.severity_for else None)
            )
        if c.name == "unique":
            tuples = [t for t in (asset.asset.primary_key, *asset.asset.unique) if len(t) > 1]
            out += [make_spec(c, asset.label, columns=tuple(t)) for t in dict.fromkeys(tuples)]
    return out


def _part_of_tuple(asset: AssetProfile, column: str) -> bool:
    pk = asset.asset.primary_key
    return len(pk) > 1 and column in pk and (column,) not in asset.asset.unique


def parent_keys(assets: list[AssetProfile]) -> dict[str, list[tuple[str, str]]]:
    """Key columns of all tables by the name a reference to them has: `orders.id` and `orders.order_id` under `order_id`.

    Built once for a scan, so that a reference finds its parent without going through the tables."""
    found: dict[str, list[tuple[str, str]]] = {}
    for parent in assets:
        name = parent.asset.name.lower()
        plurals = (("", ""), ("s", ""), ("es", ""), ("ies", "y"))
        for stem in dict.fromkeys(name[: len(name) - len(end)] + one for end, one in plurals if name.endswith(end)):
            for key in (f"{stem}_id", "id"):
                for col in parent.columns:
                    if col.role == "key" and col.column.lower() == key:
                        found.setdefault(f"{stem}_id", []).append((parent.asset.label, col.column))
    return found


def _references(c: CheckType, asset: AssetProfile, assets: dict[str, AssetProfile], parents: dict[str, list[tuple[str, str]]]) -> list[CheckSpec]:
    """Declared references of filled columns, else the first table that a foreign key's name stands for."""
    rows: dict[str, tuple[str, str, bool]] = {}
    for col in asset.columns:
        if col.role == "foreign_key":
            others = [p for p in parents.get(col.column.lower(), ()) if p[0] != asset.asset.label]
            rows |= {col.column: (*p, True) for p in others[:1]}
    rows |= {fk.column: (fk.parent, fk.parent_column, False) for fk in asset.asset.foreign_keys if fk.parent in assets}
    return [
        make_spec(
            c, asset.label, col.column, params=dict(zip(("parent", "parent_column", "inferred"), rows[col.column], strict=True)),
            **({} if rows[col.column][2] else {"origin": "declared"}),
        )
        for col in asset.columns
        if col.non_null and col.column in rows
    ]


def _ordered_pairs(c: CheckType, asset: AssetProfile) -> list[CheckSpec]:
    """Columns of one kind whose names stand for the start and the end of the same thing.

    Every name has a place for each rule it fits, as (kind, rule, what is left of the name); a start and an end meet there."""
    starts: dict[tuple, str] = {}
    ends: dict[tuple, str] = {}
    for col in asset.columns:
        name, kind = col.column.lower(), col.logical_type
        if kind not in (*NUMERIC, *TEMPORAL):
            continue
        for side, held in ((0, starts), (1, ends)):
            held |= {(kind, rule): col.column for rule in NAMED_PAIRS if rule[side] == name}
            held |= {(kind, rule, name.removesuffix(rule[side])): col.column for rule in PAIR_SUFFIXES if name.endswith(rule[side])}
            held |= {(kind, rule, name.removeprefix(rule[side])): col.column for rule in PAIR_PREFIXES if name.startswith(rule[side])}
    rank = {rule: n for n, rule in enumerate((*NAMED_PAIRS, *PAIR_SUFFIXES, *PAIR_PREFIXES))}
    met = sorted((place for place in starts if place in ends), key=lambda place: rank[place[1]])
    return [make_spec(c, asset.label, columns=pair) for pair in dict.fromkeys((starts[place], ends[place]) for place in met)]


def _row_identity(c: CheckType, asset: AssetProfile) -> list[CheckSpec]:
    scalar = tuple(p.column for p in asset.columns if p.logical_type not in NOT_SCALAR)
    return [make_spec(c, asset.label, columns=scalar)] if len(scalar) > 1 else []


def age_hours(newest_us: int, now: datetime) -> float:
    return (to_micros(now) - newest_us) / 3_600_000_000


def _feeds(c: CheckType, asset: AssetProfile, now: datetime) -> list[CheckSpec]:
    """Freshness of the newest feed column: twice its present age, a day at least. A year-old table is no feed."""
    ages = {
        p.column: age_hours(p.max_us, now)
        for p in asset.columns
        if p.role == "timestamp" and p.max_us is not None and (p.column.lower() in FEED_NAMES or p.column.lower().endswith(FEED_SUFFIXES))
    }
    youngest = min(ages, key=ages.get, default=None)
    if youngest is None or ages[youngest] > 24 * 365:
        return []
    return [make_spec(c, asset.label, youngest, params={"max_age_hours": max(24, math.ceil(2 * ages[youngest]))})]
