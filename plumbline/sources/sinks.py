"""Result tables on disk: one folder per table, partitioned by scan; state as complete snapshots."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A claim is written at once; one that is still empty after this time was left behind.
CLAIM_SECONDS = 600

# Result tables are one row per table, column or check; one file per scan is enough.


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table under `root`, replacing only this scan's partition, so that a repeated write is harmless."""
    for name, df in tables.items():
        writer = df.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("scan_id").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{name}")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """All result tables of a scan as JSON lines, one `{table, row}` object per row."""
    rows = [df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    text = F.concat(F.lit('{"table":"'), "table", F.lit('","row":'), "row", F.lit("}"))
    out.select(text.alias("value")).repartition(1).write.mode("overwrite").text(path)


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(conf)


def snapshots(spark: SparkSession, root: str, name: str) -> list[str]:
    """Complete snapshots of a state table, oldest first: a number and a label each. Unfinished writes are not among them."""
    marks, fs = _file_system(spark, f"{root}/state/{name}/*-*/_SUCCESS")
    found = sorted(m.getPath().getParent().getName() for m in fs.globStatus(marks) or [])
    return [n for n in found if not n.startswith("pending")]


def base_of(spark: SparkSession, root: str, name: str, label: str) -> tuple[str | None, str | None]:
    """The snapshot to fold `label` into, and the one that has it folded in already, if any."""
    names = snapshots(spark, root, name)
    for at, known in enumerate(names):
        if known.split("-", 1)[1] == label:
            return (names[at - 1] if at else None), known
    return (names[-1] if names else None), None


def write_snapshot(df: DataFrame, root: str, name: str, label: str, base: str | None) -> str:
    """A new snapshot after `base`, never in place of another; returns its name.

    It is written aside, its number is claimed with the name of what was written, and then it is moved to that number. A number
    can be claimed once: if another writer has moved on from the same base, this fails and the state stays as it is. A writer that
    died after its claim has written everything, so the next one moves its snapshot into place first (and then fails as above,
    since the state has changed); a claim that names nothing that is still there is taken over."""
    spark = df.sparkSession
    number = int(base.split("-", 1)[0]) + 1 if base else 1
    folder = f"{root}/state/{name}"
    pending = f"pending-{uuid.uuid4().hex}"
    aside, fs = _file_system(spark, f"{folder}/{pending}")
    df.write.parquet(aside.toString())
    final = f"{number:012d}-{label}"
    if not _claimed(spark, folder, number, f"{pending} {final}") and (_finish_claim(spark, folder, number) or not _claimed(spark, folder, number, f"{pending} {final}")):
        fs.delete(aside, True)
        raise RuntimeError(f"the {name} have changed since snapshot {base}; read them again")
    _moved(spark, folder, pending, final)
    return final


def _claimed(spark: SparkSession, folder: str, number: int, content: str) -> bool:
    """Claim `number` with `content`; False if it is claimed."""
    claim, fs = _file_system(spark, f"{folder}/claims/{number:012d}")
    fs.mkdirs(claim.getParent())
    try:
        out = fs.create(claim, False)
    except Py4JJavaError:
        if fs.exists(claim):
            return False
        raise
    out.writeBytes(content)
    out.close()
    return True


def _finish_claim(spark: SparkSession, folder: str, number: int) -> bool:
    """Whether the claim of `number` stands for a snapshot, moved into place if its writer did not. A claim of nothing is removed,
    an empty one once it is too old to be still in writing."""
    claim, fs = _file_system(spark, f"{folder}/claims/{number:012d}")
    stream = fs.open(claim)
    content = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split(" ", 1)
    stream.close()
    if fs.globStatus(_file_system(spark, f"{folder}/{number:012d}-*/_SUCCESS")[0]):
        return True
    if len(content) == 2 and fs.exists(_file_system(spark, f"{folder}/{content[0]}/_SUCCESS")[0]):
        _moved(spark, folder, *content)
        return True
    age = time.time() - fs.getFileStatus(claim).getModificationTime() / 1000
    if len(content) < 2 and age < CLAIM_SECONDS:
        return True
    fs.delete(claim, False)
    return False


def _moved(spark: SparkSession, folder: str, pending: str, final: str) -> None:
    """Move a written snapshot into place; another writer may have done so already."""
    (source, fs), (target, _) = _file_system(spark, f"{folder}/{pending}"), _file_system(spark, f"{folder}/{final}")
    if fs.exists(target) or fs.rename(source, target) or fs.exists(target):
        return
    raise RuntimeError(f"cannot move {pending} to {final} in {folder}")


def read_snapshot(spark: SparkSession, root: str, name: str, snapshot: str | None = None) -> DataFrame | None:
    """A snapshot of a state table, the latest by default; None before the first."""
    if snapshot is None:
        names = snapshots(spark, root, name)
        if not names:
            return None
        snapshot = names[-1]
    return spark.read.parquet(f"{root}/state/{name}/{snapshot}")
