"""Files as tables: CSV, TSV, text, Parquet and JSON, named directly, by folder or by pattern."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Asset

# The file types that become tables.
DELIMITED = {"csv": None, "tsv": "\t", "txt": None}
JSON = ("json", "jsonl", "ndjson")
SUPPORTED = (*DELIMITED, "parquet", *JSON)
DELIMITERS = (",", ";", "\t", "|")


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def expand_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files named directly, the supported files of a folder, or the matches of a pattern, sorted.

    Works on any file system Hadoop knows. A folder whose own name has a supported ending, such as a
    Parquet table written by Spark, is one table."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for raw in paths:
        p = jvm.org.apache.hadoop.fs.Path(raw)
        fs = p.getFileSystem(conf)
        matches = fs.globStatus(p)
        if not matches:
            raise ValueError(f"no such file or folder: {raw}")
        pattern = any(c in raw for c in "*?[{")
        for m in matches:
            text = m.getPath().toString()
            if m.isFile() or suffix(text) in SUPPORTED:
                if suffix(text) in SUPPORTED:
                    found.append(text)
                elif not pattern:
                    raise ValueError(f"unsupported file type: {raw}")
            elif not pattern:
                inside = [s.getPath().toString() for s in fs.listStatus(m.getPath())]
                found += sorted(x for x in inside if suffix(x) in SUPPORTED)
    if not found:
        raise ValueError("no CSV, Parquet or JSON files found")
    return list(dict.fromkeys(found))


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).select(F.substring("value", 1, 65_536).alias("value")).first()
    return row.value if row else ""


def guess_delimiter(header: str) -> str:
    """The candidate that occurs most often outside quotes in the header line."""
    counts: Counter[str] = Counter()
    quoted = False
    for ch in header:
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in DELIMITERS:
            counts[ch] += 1
    return max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))


def read_file(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False
) -> DataFrame:
    """One file (or folder of one type) as a DataFrame.

    Without a schema, delimited types are inferred from every row, so that a late `N/A` makes a column
    text; give a schema for large data, which saves that pass. `multiline` allows line breaks inside
    quotes, at the price of reading each file in one task."""
    kind = suffix(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in DELIMITED:
        sep = DELIMITED[kind] or guess_delimiter(_first_line(spark, path))
        reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multiline)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", 1.0)).csv(path)
    if kind in JSON:
        array = kind == "json" and _first_line(spark, path).lstrip().startswith("[")
        reader = spark.read.option("multiLine", array or multiline)
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"unsupported file type: {path}")


def file_assets(
    spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, schemas: dict[str, T.StructType | str] | None = None
) -> list[Asset]:
    """One table per file, named by its stem; `_ending` is added when two files share one."""
    used: set[str] = set()
    out = []
    for path in expand_paths(spark, paths):
        name = (names or {}).get(path, stem(path))
        if name in used:
            name = f"{name}_{suffix(path)}"
        used.add(name)
        out.append(Asset(name, read_file(spark, path, (schemas or {}).get(name)), kind="file"))
    return out
