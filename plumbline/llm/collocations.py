"""Phrases whose words keep together: n-grams counted with one FM-index per shard of text, summed over the shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, stored
from plumbline.llm.fmindex import FmIndex
from plumbline.llm.words import MULTIPLIER, mix

LEAST = 100
LONGEST = 5
PER_LANG = 2_000
SHARD_BYTES = 6 << 20
RANKED_ROWS = 100_000
FAN = 256
PIECE_BREAK, WORD_BREAK = 10, 32
SHARDS = "shard long, lang string, n long, seq binary, words array<string>, counts array<int>"
# A-Z become a-z, every piece break a line feed, every word break a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else PIECE_BREAK if chr(c) in ".,;:!?\n\v\f\r" else WORD_BREAK if c == 9 else c for c in range(256))


def collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, per_lang: int | None = PER_LANG,
    shard_bytes: int = SHARD_BYTES, fan: int = FAN, sent: int = BROADCAST_ROWS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to `longest` words that occur `least` times or more.

    A-Z are lower-cased, texts are cut into pieces at `[.,;:!?]` and line breaks, pieces into words at blanks. A phrase of
    count a, cut after its first words, of counts l and r, scores floor(1000 a n / (l r)) with the language's n words; the
    lowest cut counts, the shortest first part among equals. Phrases inside a longer one (up to `longest` words) that occurs as
    often are dropped. Ranks are by score, then a, both descending, then phrase; `per_lang` None returns them all.

    Counts are summed in a tree: `fan` shards' packed counts meet by `fan` ranges of the phrases' hash, their sums meet by `fan`
    times as many ranges, until one node is left. Up to `sent` frequent words and pairs are sent to all shards, more are
    joined with each shard's own.

    A null language is `und`, a null or empty text has no words, repeated rows count each time, a text of any length is cut into
    shards between pieces, an empty table has no phrases. Other columns of `df` are not read.
    """
    shards = stored(
        df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(_sharder(shard_bytes), SHARDS)
    )
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    entries = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry"))
    entries = entries.select("shard", "lang", (F.col("place") + 1).alias("place"), F.col("entry.words").alias("word"), F.col("entry.counts").alias("count"))
    words = entries.groupBy("lang", "word").agg(F.sum("count").alias("a")).where(F.col("a") >= least)
    words = stored(words.withColumn("id", F.monotonically_increasing_id() + 1))
    told = Told(shards, entries.join(words, ["lang", "word"]).select("shard", F.lit(False).alias("pair"), F.col("place").cast("long").alias("x"), F.col("id").alias("y")))
    if words.count() <= sent:
        told.words = words.select("lang", "word", "id").toArrow()
    number = shards.count()
    counted = [stored(_sums(told.run(_packed_pairs(_nodes(number, fan), fan), PACKED), number, fan, least))]
    if longest > 2:
        frequent = counted[0].select(F.col("ids")[0].alias("x"), F.col("ids")[1].alias("y"))
        if frequent.count() <= sent:
            told.pairs = frequent.toArrow()
        else:
            own = told.run(_own_pairs, "shard long, pair boolean, x long, y long").join(frequent, ["x", "y"])
            told = Told(shards, told.known.unionByName(own))
        counted.append(stored(_sums(told.run(_longer(longest, _nodes(number, fan), fan), PACKED), number, fan, least)))
    phrases = counted[0].unionByName(counted[1]) if longest > 2 else counted[0]
    return _ranked(_scored(phrases, words, totals), per_lang)


def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one stands for."""
    inside = phrases.where(F.size("ids") > 2).select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), F.col("a").alias("longer"))
    kept = phrases.join(inside.groupBy("ids").agg(F.max("longer").alias("longer")), "ids", "left").where("longer is null or longer < a").select("ids", "a")
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    spelt = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda e: e["word"]), " ").alias("phrase"))
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    scored = cuts.join(spelt, "ids").join(totals, "lang").withColumn("score", score)
    return scored.groupBy("lang", "ids", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _ranked(scored: DataFrame, per_lang: int | None) -> DataFrame:
    """Ranks within a language. A part of a language is cut to `per_lang` before the language is ranked in one place; all ranks
    at once come from exact counts of what stands before each part of the order."""
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if per_lang is None:
        scored = stored(scored.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order).withColumn("m", F.monotonically_increasing_id()))
        part = F.shiftright("m", 33)
        first = scored.groupBy("lang", part.alias("part")).agg(F.count("*").alias("rows"), F.min("m").alias("start"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = first.select("lang", "part", (before + 1 - F.col("start")).alias("shift"))
        return scored.withColumn("part", part).join(F.broadcast(first), ["lang", "part"]).withColumn("rank", F.col("m") + F.col("shift")).select(columns)
    scored = stored(scored)
    salts = max(1, scored.count() // RANKED_ROWS)
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= per_lang)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= per_lang).select(columns)


def _sharder(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                for part in _parts(text.as_py() or b"", shard_bytes):
                    held.setdefault(name, []).append(part)
                    size[name] = size.get(name, 0) + len(part) + 1
                    if size[name] > shard_bytes or sum(size.values()) > 2 * shard_bytes:
                        name = max(size, key=size.get)
                        yield _shard(number, name, held.pop(name))
                        number += 1
                        del size[name]
        for name, parts in held.items():
            yield _shard(number, name, parts)
            number += 1

    return run


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text's folded bytes, a very long one in parts that end between pieces."""
    text = text.translate(FOLD)
    start = 0
    while len(text) - start > 2 * limit and (end := text.find(PIECE_BREAK, start + limit)) >= 0:
        yield text[start:end]
        start = end + 1
    if start < len(text):
        yield text[start:]


def _shard(number: int, lang: str, parts: list[bytes]) -> pa.RecordBatch:
    """One row: the words in order as numbers from 1 (0 between pieces), the words themselves and their counts."""
    data = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    cut = data == PIECE_BREAK
    letter = ~(cut | (data == WORD_BREAK))
    edges = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[letter].tobytes())).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int32)
    piece = np.cumsum(cut)[starts]
    seq = np.insert(codes + 1, np.flatnonzero(np.diff(piece)) + 1, 0).astype(np.int32)
    counts = np.bincount(codes, minlength=len(words.dictionary)).astype(np.int32)
    return pa.RecordBatch.from_pydict(
        {"shard": [number], "lang": [lang], "n": [len(starts)], "seq": [pack(seq)], "words": [words.dictionary.cast(pa.string()).to_pylist()], "counts": [counts]},
        schema=pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("seq", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]),
    )


def pack(seq: np.ndarray) -> bytes:
    return len(seq).to_bytes(8, "little") + pa.compress(seq.astype(np.int32).tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], 4 * size, "zstd", asbytes=True), dtype=np.int32).astype(np.int64)


class Told:
    """The shards and what they are told: their frequent words and, later, pairs. `words` and `pairs` are sent to all; where one
    of them is too large for that, `known` has rows for each shard, of its place and id of a word or of two ids of a pair."""

    def __init__(self, shards: DataFrame, known: DataFrame) -> None:
        self.shards, self.known = shards, known
        self.words: pa.Table | None = None
        self.pairs: pa.Table | None = None

    def run(self, job, schema: str) -> DataFrame:
        """`job` of each shard: its number, the sequence of its frequent words numbered from 1, their ids by that number, pairs."""
        words, pairs = self.words, self.pairs
        if words is None:
            def cogrouped(shard: pa.Table, known: pa.Table) -> pa.Table:
                pair = known.column("pair")
                mine = known.filter(pair) if pairs is None else pairs
                known = known.filter(pc.invert(pair))
                seq = unpack(shard.column("seq")[0].as_py()) if len(shard) else np.zeros(0, dtype=np.int64)
                return job(shard.column("home")[0].as_py() if len(shard) else 0, *_frequent(seq, known.column("x").to_numpy(), known.column("y").to_numpy()), mine)

            seqs = self.shards.select(F.col("shard").alias("home"), "seq")
            return seqs.groupBy("home").cogroup(self.known.groupBy("shard")).applyInArrow(cogrouped, schema)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_lang = {name: words.filter(pc.equal(words.column("lang"), name)) for name in pc.unique(words.column("lang")).to_pylist()}
            for batch in batches:
                for i in range(len(batch)):
                    shard = {c: batch.column(c)[i] for c in batch.schema.names}
                    mine = of_lang.get(shard["lang"].as_py())
                    if mine is not None:
                        at = pc.index_in(shard["words"].values, value_set=mine.column("word").combine_chunks())
                        place = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                        ids = mine.column("id").take(at.drop_null()).to_numpy()
                        yield from job(shard["shard"].as_py(), *_frequent(unpack(shard["seq"].as_py()), place + 1, ids), pairs).to_batches()

        return self.shards.select("shard", "lang", "seq", "words").mapInArrow(mapped, schema)


def _frequent(seq: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's sequence of frequent words only, numbered from 1 in the order of their ids; the ids by that number."""
    code = np.zeros(int(max(seq.max(initial=0), place.max(initial=0))) + 1, dtype=np.int64)
    code[place] = np.searchsorted(np.sort(ids), ids) + 1
    return _squeezed(code[seq]), np.concatenate([[0], np.sort(ids)])


def _squeezed(seq: np.ndarray) -> np.ndarray:
    """Without zeros after zeros."""
    return seq[(seq > 0) | (np.roll(seq, 1) > 0)]


def _sums(packed: DataFrame, shards: int, fan: int, least: int) -> DataFrame:
    """ids, a of the phrases that occur `least` times or more in all shards together, from each shard's packed counts."""
    nodes, depth = _nodes(shards, fan), 1
    while nodes > 1:
        nodes = -(-nodes // fan)
        packed = packed.groupBy("node", "part").applyInArrow(_merged(fan, depth), PACKED)
        depth += 1
    return packed.groupBy("part").applyInArrow(_summed(least), "ids array<long>, a long")


def _nodes(shards: int, fan: int) -> int:
    return max(1, -(-shards // fan))


PACKED = "node long, part long, counts binary"
PACKED_KIND = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])


def _shard_pairs(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a shard's pairs of frequent words, and their counts."""
    *_, (words, count) = FmIndex(seq, 2).ngrams(2)
    return ids[words], count


def _own_pairs(number: int, seq: np.ndarray, ids: np.ndarray, pairs: pa.Table | None) -> pa.Table:
    words, _ = _shard_pairs(seq, ids)
    return pa.table({"shard": np.full(len(words), number), "pair": np.ones(len(words), dtype=bool), "x": words[:, 0], "y": words[:, 1]})


def _dealt(node: int, words: np.ndarray, count: np.ndarray, fan: int, depth: int) -> pa.Table:
    """One row for each of the fan^depth ranges of the phrases' hash: its phrases in order, packed."""
    part = np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        part = part * np.uint64(MULTIPLIER) + column.astype(np.uint64)
    part = mix(part) % np.uint64(fan**depth)
    order = np.lexsort((*words.T[::-1], part))
    part, words, count = part[order], words[order], count[order]
    edges = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
    ends = np.append(edges[1:], len(part))
    blobs = [_squeeze(words[a:b], count[a:b]) for a, b in zip(edges, ends, strict=True)] if len(part) else []
    return pa.table([pa.array(np.full(len(blobs), node), pa.int64()), pa.array(part[edges].astype(np.int64) if len(part) else [], pa.int64()), pa.array(blobs, pa.binary())], schema=PACKED_KIND)


def _squeeze(words: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted phrases as compressed bytes: steps of the first word, the other words (0 where there is none), counts, bytes of
    equal weight together."""
    table = np.stack([np.diff(words[:, 0], prepend=0), *words.T[1:], count]).astype("<i8")
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(table), -1, 8).transpose(0, 2, 1))
    return len(words).to_bytes(8, "little") + len(table).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _loosen(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over packed counts of sorted phrases."""
    tables = []
    for blob in blobs.to_pylist():
        n, k = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
        raw = np.frombuffer(pa.decompress(blob[16:], 8 * k * n, "zstd", asbytes=True), dtype=np.uint8)
        table = np.ascontiguousarray(raw.reshape(k, 8, n).transpose(0, 2, 1)).view("<i8").reshape(k, n)
        tables.append(np.vstack([np.cumsum(table[0]), table[1:]]))
    table = np.concatenate(tables, axis=1)
    table = table[:, np.lexsort(table[-2::-1])]
    first = np.flatnonzero((np.diff(table[:-1], axis=1, prepend=-1) != 0).any(axis=0))
    return table[:-1, first].T, np.add.reduceat(table[-1], first)


def _node(number: int, nodes: int) -> int:
    return int(mix(np.array([number], dtype=np.uint64))[0] % np.uint64(nodes))


def _packed_pairs(nodes: int, fan: int):
    def job(number: int, seq: np.ndarray, ids: np.ndarray, pairs: pa.Table | None) -> pa.Table:
        return _dealt(_node(number, nodes), *_shard_pairs(seq, ids), fan, 1)

    return job


def _merged(fan: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        return _dealt(table.column("node")[0].as_py() // fan, *_loosen(table.column("counts")), fan, depth + 1)

    return run


def _summed(least: int):
    def run(table: pa.Table) -> pa.Table:
        words, a = _loosen(table.column("counts"))
        words, a = words[a >= least], a[a >= least]
        size = np.count_nonzero(words, axis=1)
        offsets = np.concatenate([[0], np.cumsum(size)])
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words[words > 0], pa.int64())), "a": pa.array(a, pa.int64())})

    return run


def _longer(longest: int, nodes: int, fan: int):
    """Packed n-grams of three words and more, all of whose pairs are frequent."""

    def job(number: int, seq: np.ndarray, ids: np.ndarray, pairs: pa.Table) -> pa.Table:
        if len(seq) == 0 or len(pairs) == 0:
            return PACKED_KIND.empty_table()
        # Between two words that are no frequent pair no longer phrase passes.
        x, y = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("x", "y"))
        here = (ids[np.minimum(x, len(ids) - 1)] == pairs.column("x").to_numpy()) & (ids[np.minimum(y, len(ids) - 1)] == pairs.column("y").to_numpy())
        pair = np.sort(x[here] * len(ids) + y[here])
        if len(pair) == 0:
            return PACKED_KIND.empty_table()
        found = seq[:-1] * len(ids) + seq[1:]
        at = np.minimum(np.searchsorted(pair, found), len(pair) - 1)
        cut = (pair[at] != found) & (seq[:-1] > 0) & (seq[1:] > 0)
        seq = np.insert(seq, np.flatnonzero(cut) + 1, 0)
        # Words with a gap on either side are in no pair.
        around = np.concatenate([[0], seq, [0]])
        seq = _squeezed(np.where((around[:-2] > 0) | (around[2:] > 0), seq, 0))
        longer = [(words, count) for words, count in FmIndex(seq, longest).ngrams(longest) if words.shape[1] > 2]
        words = np.vstack([np.pad(ids[words], ((0, 0), (0, longest - words.shape[1]))) for words, _ in longer])
        return _dealt(_node(number, nodes), words, np.concatenate([count for _, count in longer]), fan, 1)

    return job
