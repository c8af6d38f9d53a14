"""Tables of the session catalogue and of databases, with the constraints they declare."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Asset, ForeignKey, label_of


def catalog_assets(spark: SparkSession, database: str | None = None) -> list[Asset]:
    """The tables and views Spark's catalogue lists."""
    out = []
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        namespace = "" if t.isTemporary or not t.namespace or t.namespace == ["default"] else ".".join(t.namespace)
        full = t.name if not namespace else f"{namespace}.{t.name}"
        out.append(Asset(t.name, spark.table(full), namespace=namespace, kind="view" if t.tableType in ("VIEW", "TEMPORARY") else "table"))
    return out


# Standard catalogue views, the same in any database that has an information schema.
TABLES_QUERY = (
    "SELECT table_schema, table_name, table_type FROM information_schema.tables "
    "WHERE table_schema NOT IN ('information_schema', 'pg_catalog')"
)
CONSTRAINTS_QUERY = (
    "SELECT c.table_schema, c.table_name, c.constraint_name, c.constraint_type, k.column_name, k.ordinal_position, "
    "u.table_schema AS parent_schema, u.table_name AS parent_name, u.column_name AS parent_column "
    "FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
    "ON k.constraint_schema = c.constraint_schema AND k.constraint_name = c.constraint_name AND k.table_name = c.table_name "
    "LEFT JOIN information_schema.referential_constraints r "
    "ON r.constraint_schema = c.constraint_schema AND r.constraint_name = c.constraint_name "
    "LEFT JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema "
    "AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.position_in_unique_constraint "
    "WHERE c.constraint_type IN ('PRIMARY KEY', 'UNIQUE', 'FOREIGN KEY')"
)
NOT_NULL_QUERY = "SELECT table_schema, table_name, column_name FROM information_schema.columns WHERE is_nullable = 'NO'"


def declared_assets(
    tables: list[Any], constraints: list[Any], not_null: list[Any], load: Callable[[str, str, tuple[str, ...]], DataFrame],
    default_schema: str = "main", schemas: tuple[str, ...] | None = None,
) -> list[Asset]:
    """Tables with their declared keys, from catalogue rows. `load` reads one, given its schema, name and key."""
    space = lambda s: "" if s == default_schema else s
    groups: dict[tuple[str, str], dict[str, list[Any]]] = defaultdict(lambda: defaultdict(list))
    for r in constraints:
        groups[(r["table_schema"], r["table_name"])][r["constraint_name"]].append(r)
    required: dict[tuple[str, str], list[str]] = defaultdict(list)
    for r in not_null:
        required[(r["table_schema"], r["table_name"])].append(r["column_name"])
    out = []
    for t in sorted(tables, key=lambda r: (r["table_schema"], r["table_name"])):
        where = (t["table_schema"], t["table_name"])
        if schemas and where[0] not in schemas:
            continue
        primary: tuple[str, ...] = ()
        unique: list[tuple[str, ...]] = []
        links: list[ForeignKey] = []
        for rows in groups[where].values():
            rows = sorted(rows, key=lambda r: r["ordinal_position"])
            columns = tuple(r["column_name"] for r in rows)
            kind = rows[0]["constraint_type"]
            if kind == "PRIMARY KEY":
                primary = columns
            elif kind == "UNIQUE":
                unique.append(columns)
            elif len(columns) == 1 and rows[0]["parent_name"]:
                parent = label_of(space(rows[0]["parent_schema"]), rows[0]["parent_name"])
                links.append(ForeignKey(columns[0], parent, rows[0]["parent_column"]))
        out.append(
            Asset(where[1], load(*where, primary), namespace=space(where[0]), kind="view" if "VIEW" in t["table_type"] else "table",
                  primary_key=primary, unique=tuple(unique), foreign_keys=tuple(links), not_null=tuple(required[where]))
        )
    return out


def jdbc_assets(
    spark: SparkSession, url: str, properties: dict[str, str], schemas: tuple[str, ...] | None = None,
    partitions: int = 16, default_schema: str = "main", quote: str = '"',
) -> list[Asset]:
    """Every table of a database. A table with a single whole-number key is read in `partitions` ranges of it."""

    def ask(sql: str) -> DataFrame:
        return spark.read.jdbc(url, f"({sql}) q", properties=properties)

    def load(schema: str, name: str, key: tuple[str, ...]) -> DataFrame:
        table = f"{quote}{schema}{quote}.{quote}{name}{quote}"
        plain = spark.read.jdbc(url, table, properties=properties)
        if len(key) != 1 or plain.schema[key[0]].dataType.typeName() not in ("integer", "long", "short"):
            return plain
        low, high = ask(f"SELECT min({quote}{key[0]}{quote}) AS lo, max({quote}{key[0]}{quote}) AS hi FROM {table}").first()
        if low is None:
            return plain
        return spark.read.jdbc(url, table, column=key[0], lowerBound=low, upperBound=high + 1, numPartitions=partitions, properties=properties)

    lower = lambda df: df.select(*[F.col(c).alias(c.lower()) for c in df.columns]).collect()
    return declared_assets(lower(ask(TABLES_QUERY)), lower(ask(CONSTRAINTS_QUERY)), lower(ask(NOT_NULL_QUERY)), load, default_schema, schemas)
