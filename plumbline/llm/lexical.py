"""Ranked lexical search: every document streams once through an automaton of the items' terms, which counts them from the text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stored
from plumbline.llm.words import list_array

TOP = 10
TERMS = 100_000
ITEMS = 2_000
CELLS = 1 << 22
# A-Z become a-z; every other character of ASCII that is in no term becomes the guard.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
COUNTED = "row long, doc_id long, n long, terms array<int>, counts array<long>"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def lexical_search(
    df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, terms: int = TERMS, items_at_once: int = ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `top` highest-scoring documents with a score above 0.

    A term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that hold a term, L
    terms in all, n of a document, df documents and tf occurrences of a term: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 +
    (90 n N) div L, and a score sums w ((10^9 tf) div (1000 tf + 8 m)) over an item's distinct terms. Equal scores rank by doc_id,
    null ids last, then repeated rows in any order.

    At most `terms` terms are sent out in one automaton and `items_at_once` items in one table: more are taken in blocks, each
    block by a pass of its own. Null and empty texts have no terms: such documents are never found and such items find nothing.
    Items of equal id are one item of all their terms; a null item id finds nothing. Texts of any length are counted whole.
    Without documents or items there are no rows; other columns are not read.
    """
    spark = df.sparkSession
    wanted = items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(terms_of(F.col(item_text)))).alias("term")).where(F.col("item_id").isNotNull()).distinct()
    # Terms and items are numbered within blocks of bounded size.
    words = stored(_numbered(wanted.select("term").distinct(), "term", "number"))
    wanted = wanted.join(words, "term").select("item_id", "number")
    named = stored(_numbered(wanted.select("item_id").distinct(), "item_id", "place"))
    wanted = stored(wanted.join(named, "item_id").select("place", "number"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = None
    for start in range(0, words.count(), terms):
        block = words.where(F.col("number").between(start, start + terms - 1)).collect()
        part = rows.mapInArrow(_counter(block), COUNTED)
        counted = part if counted is None else counted.unionByName(part)
    empty = spark.createDataFrame([], named.select("item_id").schema.add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType()))
    if counted is None:
        return empty
    counted = stored(counted.where("n > 0"))
    # Every block of terms counts a document's n again.
    blocks = -(-words.count() // terms)
    docs, length = counted.agg(F.count("*"), F.sum("n")).first()
    if not docs:
        return empty
    docs, length = docs // blocks, length // blocks
    seen = stored(counted.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df")))
    found = None
    for start in range(0, named.count(), items_at_once):
        held = wanted.where(F.col("place").between(start, start + items_at_once - 1))
        weight = [(r.place - start, r.number, math.floor(1000 * math.log((2 * docs + 2) / (2 * r.df + 1)))) for r in held.join(seen, "number").collect()]
        part = _scores(counted, blocks, weight, docs, length, top).withColumn("place", F.col("place") + start)
        found = part if found is None else found.unionByName(part)
    return _best(found, top).join(named, "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """`values` with numbers from 0 without gaps, in order."""
    ordered = stored(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    starts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("m").alias("first")).collect()
    ahead, shifts = 0, []
    for r in sorted(starts):
        shifts.append((r.part, ahead - r["first"]))
        ahead += r["rows"]
    shift = ordered.sparkSession.createDataFrame(shifts, "part long, shift long")
    return ordered.withColumn("part", part).join(F.broadcast(shift), "part").select(column, (F.col("m") + F.col("shift")).alias(name))


def _counter(block: list):
    """Documents to n and the counts of the block's terms. Terms are looked for between guards, so none is found inside another."""
    terms = [(r.term, r.number) for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term, number in terms:
            automaton.add_word(f" {term} ", number)
        automaton.make_automaton()
        for batch in batches:
            sizes, numbers, counts = np.zeros(len(batch), dtype=np.int64), [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                folded = b" " + (text.as_py() or b"").translate(FOLD) + b" "
                guard = np.frombuffer(folded, dtype=np.uint8) == 32
                sizes[i] = np.count_nonzero(guard[:-1] & ~guard[1:])
                tf = Counter(number for _, number in automaton.iter(folded.decode())) if sizes[i] else {}
                numbers.append(np.fromiter(tf.keys(), np.int32, len(tf)))
                counts.append(np.fromiter(tf.values(), np.int64, len(tf)))
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes), list_array(numbers, pa.int32()), list_array(counts, pa.int64())],
                names=["row", "doc_id", "n", "terms", "counts"],
            )

    return run


def _scores(counted: DataFrame, blocks: int, weight: list[tuple[int, int, int]], docs: int, length: int, top: int) -> DataFrame:
    """place, doc_id, score, row: the `top` of each item in each task's documents."""
    weight = sorted(weight, key=lambda t: t[1])
    places = np.array([t[0] for t in weight], dtype=np.int64)
    numbers, first = np.unique(np.array([t[1] for t in weight], dtype=np.int64), return_index=True)
    first = np.append(first, len(weight))
    w = np.array([t[2] for t in weight], dtype=np.int64)
    width = int(places.max(initial=-1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(width, top)
        for batch in batches if width else ():
            entries = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(batch)), entries)
            number, tf = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
            used = numbers[at] == number
            doc, at, tf = doc[used], at[used], tf[used]
            m = 10 + (90 * batch.column("n").to_numpy() * docs) // length
            ids, row = batch.column("doc_id"), batch.column("row").to_numpy()
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            # A term's value goes to every item that has it; so many documents at once as make CELLS such sums.
            reach = np.diff(first)[at]
            held = np.cumsum(np.bincount(doc, weights=reach, minlength=len(batch)) + width)
            start = 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + CELLS, "right")))
                a, b = np.searchsorted(doc, [start, end])
                x, times = at[a:b], reach[a:b]
                where = np.repeat(first[x] - np.cumsum(times) + times, times) + np.arange(times.sum())
                value = w[where] * np.repeat((1_000_000_000 * tf[a:b]) // (1000 * tf[a:b] + 8 * m[doc[a:b]]), times)
                cell = np.repeat(doc[a:b] - start, times) * width + places[where]
                # Sums of doubles are exact below 2^53, so the halves of a value are summed apart.
                high, low = (np.bincount(cell, weights=v, minlength=(end - start) * width).astype(np.int64) for v in (value >> 24, value & 0xFFFFFF))
                best.add(((high << 24) + low).reshape(end - start, width), ids[start:end], null[start:end], row[start:end])
                start = end
        place, score, null, ids, row = best.rows
        yield pa.record_batch([pa.array(place), pa.array(ids, mask=null), pa.array(score), pa.array(row)], names=["place", "doc_id", "score", "row"])

    if blocks > 1:  # a document's terms come from several passes
        counted = counted.groupBy("row", "doc_id", "n").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("counts")).alias("counts"))
    return counted.select("row", "doc_id", "n", "terms", "counts").mapInArrow(run, "place long, doc_id long, score long, row long")


class Best:
    """The `top` rows of each item seen so far: place, score, null id, id, row."""

    def __init__(self, width: int, top: int) -> None:
        self.top, self.least = top, np.ones(width, dtype=np.int64)
        self.rows = [np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, bool, np.int64, np.int64)]

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        if len(scores) > self.top:
            self.least = np.maximum(self.least, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        doc, place = np.nonzero(scores >= self.least)
        found = (place, scores[doc, place], null[doc], ids[doc], row[doc])
        found = [np.concatenate(pair) for pair in zip(self.rows, found, strict=True)]
        order = np.lexsort((found[4], found[3], found[2], -found[1], found[0]))
        place = found[0][order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        self.rows = [f[order[rank < self.top]] for f in found]
        place, last = self.rows[0], self.top - 1
        full = np.flatnonzero(np.bincount(place, minlength=len(self.least)) == self.top)
        self.least[full] = np.maximum(self.least[full], self.rows[1][np.searchsorted(place, full) + last])


def _best(found: DataFrame, top: int) -> DataFrame:
    """Ranks within an item; what the tasks found is cut by parts of an item first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    some = F.row_number().over(Window.partitionBy("place", F.pmod(F.xxhash64("row"), F.lit(64))).orderBy(*order))
    found = found.withColumn("rank", some).where(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= top)
