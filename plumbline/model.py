"""Metadata objects: what a table declares, what a check is, and the weights used in scoring.

These live on the driver, one object per table, column or check. Row data never does.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .session import local_frame

# Role and severity weights, dimension order and mapping.
ROLE_WEIGHT = {
    "key": 3.0,
    "foreign_key": 2.5,
    "timestamp": 2.0,
    "measure": 1.5,
    "attribute": 1.0,
    "description": 0.5,
}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.6, "medium": 0.3, "low": 0.1}
SEVERITIES = tuple(SEVERITY_WEIGHT)
DIMENSIONS = ("completeness", "validity", "accuracy", "consistency", "uniqueness", "currentness")
ISO_25012 = {
    "completeness": "completeness",
    "validity": "accuracy (syntactic), compliance",
    "accuracy": "accuracy (semantic)",
    "consistency": "consistency",
    "uniqueness": "consistency (no duplicate records)",
    "currentness": "currentness",
}
CHECK_STATUSES = ("proposed", "active", "locked", "retired")
SCORING_STATUSES = ("active", "locked")
FINDING_STATUSES = ("open", "acknowledged", "muted", "resolved")

NUMERIC = ("integer", "decimal")
TEMPORAL = ("date", "timestamp")
NOT_SCALAR = ("json", "binary", "other")


def logical_type(dt: T.DataType) -> str:
    """The logical type a check reasons about, from a Spark type."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, T.DecimalType):
        return "integer" if dt.scale == 0 else "decimal"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "decimal"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.BinaryType):
        return "binary"
    if isinstance(dt, T.VariantType):
        return "json"
    return "other"


def label_of(namespace: str, name: str) -> str:
    """A table's label. Parts holding a dot or a quote are quoted, so no two tables share one."""

    def part(p: str) -> str:
        return '"' + p.replace('"', '""') + '"' if ("." in p or '"' in p) else p

    return ".".join(part(p) for p in (namespace, name) if p)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str  # label of the parent table
    parent_column: str


@dataclass(frozen=True)
class Asset:
    """One table, view or file: a lazy DataFrame and what is declared about it."""

    name: str
    df: DataFrame
    namespace: str = ""
    kind: str = "table"
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return label_of(self.namespace, self.name)


@dataclass(frozen=True)
class CheckSpec:
    """A generated or saved check. `params` holds JSON-compatible values."""

    id: str
    type: str
    asset: str
    dimension: str
    severity: str
    kind: str
    status: str
    column: str | None = None
    columns: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    max_fail_ratio: float = 0.0
    origin: str = "generated"
    version: int = 1

    @property
    def scores(self) -> bool:
        return self.status in SCORING_STATUSES

    def with_status(self, status: str) -> CheckSpec:
        return replace(self, status=status)


SPEC_SCHEMA = (
    "check_id string, type string, asset string, column string, columns array<string>, params string, "
    "dimension string, severity string, kind string, status string, max_fail_ratio double, "
    "origin string, version bigint"
)


def canonical_json(params: dict[str, Any]) -> str:
    """Parameters as text with sorted keys, so equal parameters are equal strings."""
    return json.dumps(params, sort_keys=True, ensure_ascii=False)


def specs_frame(spark: SparkSession, specs: list[CheckSpec]) -> DataFrame:
    """Specs as a DataFrame: one row per check, which the schema of the scanned tables bounds."""
    rows = [
        (s.id, s.type, s.asset, s.column, list(s.columns), canonical_json(s.params), s.dimension, s.severity,
         s.kind, s.status, float(s.max_fail_ratio), s.origin, int(s.version))
        for s in specs
    ]
    return local_frame(spark, rows, SPEC_SCHEMA)


def specs_from_rows(rows: list[Any]) -> list[CheckSpec]:
    """The inverse of `specs_frame`, for saved checks read back from a table."""
    return [
        CheckSpec(
            id=r.check_id, type=r.type, asset=r.asset, column=r.column, columns=tuple(r.columns or ()),
            params=json.loads(r.params or "{}"), dimension=r.dimension, severity=r.severity, kind=r.kind,
            status=r.status, max_fail_ratio=r.max_fail_ratio, origin=r.origin, version=int(r.version),
        )
        for r in rows
    ]
