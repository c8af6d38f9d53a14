"""Sharding on a consistent-hash ring whose shards take bounded loads: what a full shard cannot take goes on clockwise."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SHARDS = 24
NODES = 256
SLACK = 0.0


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Place (a signed 64-bit number) and shard of every virtual node, in ring order. A shard's nodes do not depend on the others."""
    digest = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "little", signed=True)
    return sorted((digest(s, v), s) for s in range(shards) for v in range(nodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """How many rows each shard may take: with no slack the shares of an equal division, else that much above the mean."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-rows * (1 + slack) // shards)] * shards


def placed(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """Runs of rows in ring order as (number of the first row, shard, slot of the first row).

    `counts` rows lie in the arc that ends at each node. Round by round every arc offers the rows it still has to the next node
    clockwise; nodes are asked in ring order and take the arc's first rows up to what their shard has room for. A row thus lies
    on the first shard clockwise that was not full."""
    size, nodes = list(capacity), len(owners)
    start = np.concatenate([[0], np.cumsum(counts)])[:-1].tolist()
    left, used, runs = list(counts), [0] * len(capacity), []
    waiting = [a for a in range(nodes) if left[a]]
    for step in range(nodes):
        if not waiting:
            break
        for a in waiting:
            shard = owners[(a + step) % nodes]
            take = min(left[a], size[shard] - used[shard])
            if take > 0:
                runs.append((start[a], shard, used[shard]))
                start[a] += take
                left[a] -= take
                used[shard] += take
        waiting = [a for a in waiting if left[a]]
    if waiting:
        raise ValueError("the shards together have room for fewer rows than there are")
    return sorted(runs)


def shard_rows(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK,
) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law, shard, slot and grown_shard of every row.

    A row's key on the ring is its text, so equal texts lie together and share a shard unless a full one parts them; rows of one
    key are in the order of their id. With no `slack` row counts of shards differ by one at most; with some, no shard holds more than
    (1 + slack) times the mean and fewer rows move when a shard is added. Slots count from 0 in each shard without a gap. The law
    is `rows`: every shard's load counts, so a row's shard is not decided by its id alone, and grown_shard is null.

    A null text is an empty key of size 8 and crc32 0; a null id comes first among its equals; repeated rows take a slot each.
    Texts of any length are read once and not shuffled; a table without rows gives none. Other columns are not read.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), (F.length(content) + F.lit(8)).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("point"))
    # A key of very many rows is split by the hash of their ids, equal ids further by a number of the row; equal rows may change places.
    rows = rows.withColumn("spread", F.xxhash64("doc_id")).withColumn("copy", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)))
    order = ["point", "spread", "doc_id", "copy"]
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    parts = sorted(rows.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("rows"), F.min("m").alias("least")).collect())
    before = np.concatenate([[0], np.cumsum([p.rows for p in parts])]).astype(np.int64)
    number, shift = np.array([p.part for p in parts], dtype=np.int64), before[:-1] - np.array([p.least for p in parts], dtype=np.int64)
    total = int(before[-1])

    places = ring(shards, nodes)
    edges = np.array([p for p, _ in places], dtype=np.int64)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(edges), dtype=np.int64)
        for batch in batches:
            # A key on a node belongs to it; keys after the last node belong to the first, and come last in ring order.
            count += np.bincount(np.searchsorted(edges, batch.column("point").to_numpy()) % len(edges) if len(batch) else [], minlength=len(edges)).astype(np.int64)
        held = np.flatnonzero(count)
        yield pa.record_batch([pa.array(held), pa.array(count[held])], names=["arc", "rows"])

    counts = [0] * len(edges)
    for r in rows.select("point").mapInArrow(arcs, "arc long, rows long").groupBy("arc").agg(F.sum("rows").alias("rows")).collect():
        counts[r.arc] = r.rows
    # The first node's arc crosses the end of the number range: its rows are the ring's last and its first ones. Rows are counted
    # from the first node on, so that an arc is one run of numbers.
    wrapped = rows.where(F.col("point") <= int(edges[0])).count()
    counts = counts[1:] + counts[:1]
    owners = [s for _, s in places[1:] + places[:1]]
    runs = placed(counts, owners, capacities(total, shards, slack)) if total else []
    first = np.array([r[0] for r in runs], dtype=np.int64)
    shard_of, slot_of = np.array([r[1] for r in runs], dtype=np.int32), np.array([r[2] for r in runs], dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m = batch.column("m").to_numpy()
                place = (m + shift[np.searchsorted(number, m >> 33)] - wrapped) % total
                run = np.searchsorted(first, place, "right") - 1
                law = pa.array(np.full(len(batch), "rows", dtype=object), pa.string())
                none = pa.nulls(len(batch), pa.int32())
                columns = [batch.column(c) for c in ("doc_id", "size", "text_crc32")]
                yield pa.record_batch([*columns, law, pa.array(shard_of[run]), pa.array(slot_of[run] + place - first[run]), none], names=SCHEMA_NAMES)

    return rows.select("doc_id", "size", "text_crc32", "m").mapInArrow(assign, SCHEMA)


SCHEMA_NAMES = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
