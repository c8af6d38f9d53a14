"""Exact Jaccard join of documents on word shingles, in a metric space.

Jaccard distance obeys the triangle inequality, so pivots can cut a set of documents into Voronoi regions. It cannot cut
documents that are all at distance 1 from each other and from every pivot, as unrelated texts are: their windows would hold
everybody. So the regions at the root come from shared shingles, which is exact: two sets within the threshold share one of the
first shingles of both in any common order. Inside a root region texts are alike, distances vary, and pivots do cut.

1. Shingle sets; equal sets are one node. The order puts the corpus' most frequent shingles last, by count, the rest by hash.
   Shingles go to other tasks as gaps of sorted hashes, packed by hash range, so a count costs a byte and a half a shingle.
2. Each set's prefix meets others by shingle: pairs with a count of shared shingles, where a bound on that count drops most
   pairs without reading their sets. A shingle with more than BUCKET sets gives a star to its least set instead of pairs.
3. Connected components of what is left are the root regions; each set is sent to its own region once.
4. A region of more than LEAF sets is cut by pivots. A set's home is its nearest pivot; sets within the threshold of a pivot
   link to it, which connects most of a home. Pairs are left only where two sets are not connected that way (open). A set is
   replicated to another pivot's region if it is at most twice the threshold farther from it than from its own and within
   the threshold of the ring of the region's open sets (a window); regions without an open set are done. Sets farther than
   BALL from every pivot stay in one region, with a window of those in reach of them. Large regions are cut again while a cut
   leaves half of the pairs at most; else, where few sets are open, and after LEVELS cuts, open sets meet the rest block by block.
5. Leaves compare all their sets by a matrix product over shingles; links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_small, row_key, stored
from plumbline.llm.components import components
from plumbline.llm.words import Words, list_array, mix, shingles, slices, text_bytes
from plumbline.session import cut_lineage

SIZE = 5
PERCENT = 75
FREQUENT = 1 << 20
# Ranges of hashes that are counted and met at once, and how many hashes a task packs at once.
RANGES = 1 << 10
PACKED = 1 << 22
# Bits of a shingle's hash by which prefixes meet, and of the map of shingles that are frequent beyond FREQUENT.
MEET = 40
MARKS = 28
BUCKET = 24
LEAF = 1024
PIVOTS = 32
BALL = 0.5
LEVELS = 8
# A region is cut where that leaves this share of its pairs at most.
LEFT = 0.5


def jaccard_join(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
    bucket: int = BUCKET, leaf: int = LEAF, pivots: int = PIVOTS, levels: int = LEVELS,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two rows link when 100 * |A and B| >= percent * |A or B| for their sets of distinct shingles of `size` words (ASCII
    lower case). component_id is the least doc_id that links reach. Null and empty texts have no shingle, link with nothing
    and are their own component; a row with a null id has the least id of its component, or null. Repeated rows stay.
    Sets are of 64-bit hashes. `bucket`, `leaf`, `pivots` and `levels` steer cost, never the result.
    """
    named = _named(df, doc_id, text, size, percent, bucket, leaf, pivots, levels)
    least = named.groupBy("top").agg(F.min("id").alias("component_id"))
    out = named.join(least.where("top is not null"), "top", "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """`df` with one row of each component of the join: the one with the least id, a null id last, then the least text hash.

    Texts without a word are linked with nothing and stay, all of them. All columns stay as they are."""
    named = stored(_named(df, doc_id, text, size, percent, BUCKET, LEAF, PIVOTS, LEVELS).where("n > 0").select("row", "top", F.col("id").isNull().alias("unnamed"), "id"))
    first = named.groupBy("top").agg(F.min(F.struct("unnamed", "id", "row")).alias("first"))
    rows = named.join(first, "top").groupBy("row").agg(F.max(F.col("row") != F.col("first.row")).alias("gone"), F.count("*").alias("c"))
    marks = stored(rows.where("gone or c > 1"))
    n = marks.count()
    names = df.columns
    keyed = df.toDF(*[f"c{i}" for i in range(len(names))])
    keyed = keyed.withColumn("near_row", row_key(*(f"c{names.index(c)}" for c in (doc_id, text))))
    kept = join_small(keyed, marks.select(F.col("row").alias("near_row")), ["near_row"], "left_anti", n)
    # Of rows that repeat as they are, one stays.
    repeated = join_small(keyed, marks.where("not gone").select(F.col("row").alias("near_row")), ["near_row"], "left_semi", n).dropDuplicates(["near_row"])
    return kept.unionByName(repeated).drop("near_row").toDF(*names)


def _named(df: DataFrame, doc_id: str, text: str, size: int, percent: int, bucket: int, leaf: int, pivots: int, levels: int) -> DataFrame:
    """Row key, id and set size of every row, and `top`, the same for the rows of a component; null without a word."""
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    docs = docs.select(row_key("id", "text").alias("row"), "id", "text")
    counted = _counted(docs, size, bucket)
    rows = counted.where("c is null").select("row", "id", "n", "node")
    frequent = _frequent(counted.where("c is not null").select("s", "c"))

    candidates = cut_lineage(_candidates(docs, frequent, size, bucket, percent))
    regions = components(candidates)
    # One row stands for all of an equal set.
    regions = rows.join(regions, "node").groupBy("node", "root").agg(F.min("row").alias("row"))
    members = components(_regions_joined(docs, rows, regions, size, percent, leaf, pivots, levels))
    return rows.join(members, "node", "left").select("row", "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("top"))


def _set_of(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingles(words, size))


def _node(own: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(mix(np.array([np.sum(mix(own)) + np.uint64(len(own))], dtype=np.uint64)).view(np.int64)[0]) if len(own) else 0


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, each compressed by itself: high bytes that are much the same take little."""
    codec, planes = pa.Codec("zstd", 1), []
    for column in columns:
        data = column.astype("<u8").view(np.uint8).reshape(-1, 8)
        width = max(1, -(-int(column.max()).bit_length() // 8)) if len(column) else 0
        planes += [codec.compress(np.ascontiguousarray(data[:, i]).data, asbytes=True) if i < width else b"" for i in range(8)]
    return np.array([len(x) for x in planes], dtype=np.uint32).tobytes() + b"".join(planes)


def unpack(packed: bytes, n: int, columns: int) -> list[np.ndarray]:
    codec, at, found = pa.Codec("zstd"), 32 * columns, []
    sizes = np.frombuffer(packed, dtype=np.uint32, count=8 * columns).tolist()
    for k in range(columns):
        data = np.zeros((n, 8), dtype=np.uint8)
        for i, held in enumerate(sizes[8 * k : 8 * k + 8]):
            if held:
                data[:, i] = np.frombuffer(codec.decompress(packed[at : at + held], n), dtype=np.uint8)
            at += held
        found.append(data.view("<u8").ravel())
    return found


def _by_range(values: np.ndarray, bits: int, *others: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Range, count and packed gaps of numbers of `bits` bits, with what belongs to each, for every range that has some."""
    order = np.argsort(values, kind="stable") if others else None
    values = np.sort(values) if order is None else values[order]
    shift = bits - RANGES.bit_length() + 1
    bounds = np.searchsorted(values, np.arange(RANGES, dtype=np.uint64) << np.uint64(shift)).tolist() + [len(values)]
    gaps = np.diff(values, prepend=values[:1])
    ranges = [r for r in range(RANGES) if bounds[r] < bounds[r + 1]]
    packed = []
    for r in ranges:
        a, b = bounds[r], bounds[r + 1]
        gaps[a] = values[a] - (np.uint64(r) << np.uint64(shift))
        packed.append(pack(gaps[a:b], *(x[order[a:b]] for x in others)))
    return ranges, [bounds[r + 1] - bounds[r] for r in ranges], packed


def _of_range(r: int, bits: int, packed: list[tuple[int, bytes]], columns: int) -> list[np.ndarray]:
    """What _by_range packed of one range, in the order of its parts; the last column numbers these."""
    found = [unpack(data, n, columns) for n, data in packed]
    start = np.uint64(r) << np.uint64(bits - RANGES.bit_length() + 1)
    parts = [np.concatenate([np.cumsum(x[0]) + start for x in found])] + [np.concatenate([x[k] for x in found]) for k in range(1, columns)]
    return [*parts, np.repeat(np.arange(len(packed)), [n for n, _ in packed])]


def _ranges(batches: Iterator[pa.RecordBatch], aside: list[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The packed parts of each range, from rows in order of `r`; other rows are set aside."""
    last, held = None, []
    for batch in batches:
        other = batch.column("packed").is_null()
        aside.append(batch.filter(other))
        batch = batch.filter(pc.invert(other))
        for r, n, packed in zip(*(batch.column(c).to_pylist() for c in ("r", "m", "packed")), strict=True):
            if r != last and held:
                yield last, held
                held = []
            last = r
            held.append((n, packed))
    if held:
        yield last, held


def _counted(docs: DataFrame, size: int, bucket: int) -> DataFrame:
    """Key, id, set size and set hash of every row; and, in rows of their own, `s` and `c` for the low halves of the hashes of
    shingles that more than `bucket` texts hold. One pass over the texts, one shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, many = Words(lower=True), [], 0
        for batch in batches:
            sizes, nodes = [], []
            for data, offsets in _texts(batch.column("text")):
                _, _, hashes, firsts = split.split(data, offsets)
                for i, j in zip(firsts[:-1], firsts[1:], strict=True):
                    own = _set_of(hashes[i:j], size)
                    sizes.append(len(own))
                    nodes.append(_node(own))
                    held.append(own.astype(np.uint32))
                    many += len(own)
                    if many >= PACKED:
                        yield _filled(COUNTS, **_parts(*_by_range(np.concatenate(held).astype(np.uint64), 32)))
                        held, many = [], 0
            row = batch.column("row")
            yield _filled(COUNTS, r=pa.array(np.abs(row.to_numpy() % RANGES), pa.int32()), row=row, id=batch.column("id"), n=pa.array(sizes, pa.int64()), node=pa.array(nodes, pa.int64()))
        if many:
            yield _filled(COUNTS, **_parts(*_by_range(np.concatenate(held).astype(np.uint64), 32)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: list[pa.RecordBatch] = []

        def values() -> Iterator[pa.RecordBatch]:
            for r, packed in _ranges(batches, aside):
                s = np.sort(_of_range(r, 32, packed, 1)[0].astype(np.uint32)).view(np.int32)
                yield pa.record_batch([pa.array(s), pa.array(np.ones(len(s), np.int32))], names=["s", "c"])

        for found in _summed(bucket)(values()):
            while aside:
                rows = aside.pop()
                yield _filled(COUNTED, **{c: rows.column(c) for c in ("row", "id", "n", "node")})
            yield _filled(COUNTED, s=found.column("s"), c=found.column("c"))

    dealt = docs.mapInArrow(count, _ddl(COUNTS)).repartition("r").sortWithinPartitions("r")
    return stored(dealt.mapInArrow(summed, _ddl(COUNTED)))


ROWS = {"row": pa.int64(), "id": pa.int64(), "n": pa.int64(), "node": pa.int64()}
PARTS = {"r": pa.int32(), "m": pa.int32(), "packed": pa.binary()}
COUNTS = PARTS | ROWS
COUNTED = ROWS | {"s": pa.int32(), "c": pa.int64()}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} { {'int32': 'int', 'int64': 'long', 'binary': 'binary'}[str(kind)] }" for name, kind in kinds.items())


def _filled(kinds: dict[str, pa.DataType], **columns: pa.Array) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def _parts(ranges: list[int], counts: list[int], packed: list[bytes]) -> dict[str, pa.Array]:
    return {"r": pa.array(ranges, pa.int32()), "m": pa.array(counts, pa.int32()), "packed": pa.array(packed, pa.binary())}


Frequent = tuple[np.ndarray, np.ndarray, bytes | None]


def _frequent(counts: DataFrame) -> Frequent:
    """The FREQUENT most frequent of the counted shingles, sorted, and their counts. Where there are more, a compressed map of
    2^MARKS bits has all of them: else the rest would tie the texts that hold one into a single region.

    They only order shingles: any order gives the same result."""
    top = counts.orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()
    low, many = top.column("s").to_numpy().view(np.uint32), top.column("c").to_numpy()
    order = np.argsort(low)
    return low[order], many[order], _marks(counts) if len(low) == FREQUENT else None


def _marks(counts: DataFrame) -> bytes:
    """A bit for each value of the first MARKS bits of the counted halves, made range by range."""
    shift = 32 - RANGES.bit_length() + 1

    def mark(table: pa.Table) -> pa.Table:
        s = table.column("s").to_numpy().view(np.uint32)
        bits = np.zeros((1 << MARKS) // RANGES, dtype=bool)
        bits[(s & np.uint32((1 << shift) - 1)) >> np.uint32(32 - MARKS)] = True
        return pa.table({"r": pa.array([int(s[0]) >> shift], pa.int32()), "bits": pa.array([pa.compress(np.packbits(bits).data, "zstd", asbytes=True)], pa.binary())})

    each = (1 << MARKS) // RANGES // 8
    marks = np.zeros((RANGES, each), dtype=np.uint8)
    for r, bits in counts.groupBy(F.shiftrightunsigned("s", shift).alias("r")).applyInArrow(mark, "r int, bits binary").collect():
        marks[r] = np.frombuffer(pa.decompress(bytes(bits), each, "zstd"), dtype=np.uint8)
    return pa.compress(marks.ravel().data, "zstd", asbytes=True)


def _marked(half: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = half >> np.uint32(32 - MARKS)
    return (marks[place >> np.uint32(3)] >> (7 - (place & np.uint32(7))).astype(np.uint8)) & 1 == 1


def _summed(bucket: int):
    """Sums of `c` above `bucket` of each `s`, from rows in order of `s`; one batch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            s = np.concatenate([last, batch.column("s").to_numpy()])
            c = np.concatenate([total, batch.column("c").to_numpy()])
            if len(s) == 0:
                continue
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            values, sums = s[starts], np.add.reduceat(c, starts)
            last, total = values[-1:], sums[-1:]
            yield _above(values[:-1], sums[:-1], bucket)
        yield _above(last, total, bucket)

    return run


def _above(values: np.ndarray, sums: np.ndarray, bucket: int) -> pa.RecordBatch:
    keep = sums > bucket
    return pa.record_batch([pa.array(values[keep], pa.int32()), pa.array(sums[keep], pa.int64())], names=["s", "c"])


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in slices(column):
        yield text_bytes(column.slice(a, b - a))


def _counts(own: np.ndarray, low: np.ndarray, many: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
    """The count of each shingle that is among the most frequent, 1 for other frequent ones, 0 for the rest."""
    half = own.astype(np.uint32)
    found = _marked(half, marks).astype(np.int64) if marks is not None else np.zeros(len(own), dtype=np.int64)
    if len(low) == 0:
        return found
    place = np.minimum(np.searchsorted(low, half), len(low) - 1)
    return np.where(low[place] == half, many[place], found)


PREFIXES = PARTS | {"node": pa.int64(), "least": pa.int64(), "s": pa.int64()}
MET = {"a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "star": pa.bool_()}


def _prefixes(frequent: Frequent, size: int, percent: int):
    """The prefixes of all sets: shingles packed by range with set hash and set size.

    Sets with a frequent shingle in their prefixes are linked to the least of them here, and that one meets those of other
    tasks: however many sets hold a shingle, a task sends one row of it. Of equal sets that are packed together, the first
    alone has its prefix: an equal set adds no pair."""
    low, many, packed_marks = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(pa.decompress(packed_marks, (1 << MARKS) // 8, "zstd"), dtype=np.uint8) if packed_marks else None
        split, seen, rare, common, nodes, sizes, total = Words(lower=True), set(), [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            node = np.array(nodes, dtype=np.int64)
            lengths = [len(x) for x in rare]
            s = np.concatenate(rare) & np.uint64((1 << MEET) - 1)
            each = np.repeat(node.view(np.uint64), lengths), np.repeat(np.array(sizes, dtype=np.uint64), lengths)
            yield _filled(PREFIXES, **_parts(*_by_range(s, MEET, *each)))
            s = np.concatenate(common).view(np.int64)
            s, least, edges = _stars(s, np.repeat(node, [len(x) for x in common]))
            r = np.concatenate([s, edges[:, 0]]) % RANGES
            kinds = {"node": [least, edges[:, 0]], "least": [None, edges[:, 1]], "s": [s, None]}
            filled = {c: pa.concat_arrays([pa.array(x) if x is not None else pa.nulls(n, pa.int64()) for x, n in zip(given, (len(s), len(edges)), strict=True)]) for c, given in kinds.items()}
            yield _filled(PREFIXES, r=pa.array(r.astype(np.int32)), **filled)

        for batch in batches:
            for data, offsets in _texts(batch.column("text")):
                _, _, hashes, firsts = split.split(data, offsets)
                for i, j in zip(firsts[:-1], firsts[1:], strict=True):
                    own = _set_of(hashes[i:j], size)
                    n, node = len(own), _node(own)
                    if n == 0 or node in seen:
                        continue
                    seen.add(node)
                    length = n - (percent * n + 99) // 100 + 1
                    count = _counts(own, low, many, marks)
                    cold, hot = own[count == 0], own[count > 0]
                    hot = hot[np.lexsort((hot, count[count > 0]))]
                    rare.append(cold[:length])
                    common.append(hot[: max(0, length - len(cold))])
                    nodes.append(node)
                    sizes.append(n)
                    total += length
                    if total >= PACKED // 2:
                        yield from flush()
                        seen, rare, common, nodes, sizes, total = set(), [], [], [], [], 0
        if total:
            yield from flush()

    return run


def _stars(s: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value of s with the least of its nodes, and distinct edges from the other nodes to that."""
    order = np.lexsort((node, s))
    s, node = s[order], node[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    least = node[first]
    edges = np.stack([node, least[np.cumsum(first) - 1]], axis=1)
    return s[first], least, np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)


def _candidates(docs: DataFrame, frequent: Frequent, size: int, bucket: int, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that can link."""
    dealt = docs.select("text").mapInArrow(_prefixes(frequent, size, percent), _ddl(PREFIXES)).repartition("r").sortWithinPartitions("r")
    met = dealt.mapInArrow(_met(bucket, percent), "a long, b long, na long, nb long, star boolean")
    need = "ceil({p} * (na + nb) / {q}D - 1e-9) - greatest(ceil({p} * na / 100D - 1e-9), ceil({p} * nb / 100D - 1e-9)) + 1".format(p=percent, q=100 + percent)
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("star").alias("star"))
    # A pair with frequent shingles in both prefixes may share those: its count is no bound, and its star holds it.
    return pairs.withColumn("need", F.expr(need)).where("star or c >= need").select("a", "b")


def _met(bucket: int, percent: int):
    """Pairs of sets that share a shingle; stars where more than `bucket` sets do, or where the shingle is a frequent one.

    A range is held at a time. Shingles meet by MEET bits of their hashes, so a few pairs too many are found, never too few:
    all shingles that a set has of a value count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: list[pa.RecordBatch] = []
        common = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def others() -> Iterator[pa.RecordBatch]:
            while aside:
                rows = aside.pop()
                meets = rows.filter(rows.column("least").is_null())
                common.append((meets.column("s").to_numpy(), meets.column("node").to_numpy()))
                edges = rows.filter(rows.column("least").is_valid())
                yield _filled(MET, a=edges.column("node"), b=edges.column("least"), star=pa.array(np.full(len(edges), True)))

        for r, packed in _ranges(batches, aside):
            s, node, n, part = _of_range(r, MEET, packed, 3)
            yield from _pairs(s, node.view(np.int64), n.astype(np.int64), part, bucket, percent)
            yield from others()
        yield from others()
        edges = _stars(*(np.concatenate(x) for x in zip(*common, strict=True)))[2]
        yield _filled(MET, a=pa.array(edges[:, 0]), b=pa.array(edges[:, 1]), star=pa.array(np.full(len(edges), True)))

    return run


def _pairs(s: np.ndarray, node: np.ndarray, n: np.ndarray, part: np.ndarray, bucket: int, percent: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((part, node, s))
    node, n, s, part = node[order], n[order], s[order], part[order]
    # An equal set in another part has the same prefix; the first part stands for it.
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])])
    keep = part == part[np.flatnonzero(first)][np.cumsum(first) - 1]
    node, n, s = node[keep], n[keep], s[keep]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    counts = np.diff(np.append(starts, len(s)))
    place = np.arange(len(s)) - np.repeat(starts, counts)
    size = np.repeat(counts, counts)
    few = size <= bucket
    for step in range(1, bucket):
        i = np.flatnonzero(few & (place + step < size))
        if len(i) == 0:
            break
        small, large = np.minimum(n[i], n[i + step]), np.maximum(n[i], n[i + step])
        i = i[(100 * small >= percent * large) & (node[i] != node[i + step])]
        yield _edges(node[i], node[i + step], n[i], n[i + step], False)
    i = np.flatnonzero(~few & (place > 0))
    j = i - place[i]
    i, j = i[node[i] != node[j]], j[node[i] != node[j]]
    yield _edges(node[j], node[i], n[j], n[i], True)


def _edges(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, star: bool) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(na), pa.array(nb), pa.array(np.full(len(a), star))], names=["a", "b", "na", "nb", "star"])


def _regions_joined(docs: DataFrame, rows: DataFrame, regions: DataFrame, size: int, percent: int, leaf: int, pivots: int, levels: int) -> DataFrame:
    """Links (a, b) that connect what the exact links of every region connect."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words(lower=True)
        for batch in batches:
            done = 0
            for data, offsets in _texts(batch.column("text")):
                _, _, hashes, firsts = split.split(data, offsets)
                own = [_set_of(hashes[i:j], size) for i, j in zip(firsts[:-1], firsts[1:], strict=True)]
                part = batch.slice(done, len(own))
                done += len(own)
                yield pa.record_batch([part.column("root"), part.column("node"), list_array(own, pa.int64())], names=["region", "node", "own"])

    def sets(some: DataFrame, n: int) -> DataFrame:
        here = join_small(docs, some, ["row"], "inner", n).select("root", "node", "text")
        return here.mapInArrow(read, "region long, node long, own array<long>")

    regions = cut_lineage(regions)
    count = regions.count()
    # Regions of one leaf, nearly all, are read, compared and not written.
    here = join_small(rows.select("row"), regions, ["row"], "inner", count)
    sizes = cut_lineage(here.groupBy(F.col("root").alias("region")).agg(F.count("*").alias("m"), F.count("*").alias("o")).where(F.col("m") > leaf))
    n_large = sizes.count()
    roots = sizes.select(F.col("region").alias("root"))
    small = join_small(regions, roots, ["root"], "left_anti", n_large) if n_large else regions
    links = sets(small, count).groupBy("region").applyInArrow(_leaf(percent), "a long, b long")
    if n_large == 0:
        return links
    now = stored(sets(join_small(regions, roots, ["root"], "left_semi", n_large), count).withColumn("open", F.lit(True)))
    for level in range(levels + 1):
        if level:
            sizes = cut_lineage(now.groupBy("region").agg(F.count("*").alias("m"), F.count_if("open").alias("o")).where(F.col("m") > leaf))
            n_large = sizes.count()
            leaves = join_small(now, sizes, ["region"], "left_anti", n_large) if n_large else now
            links = links.unionByName(leaves.groupBy("region").applyInArrow(_leaf(percent), "a long, b long"))
            if n_large == 0:
                return links
        large = join_small(now, sizes, ["region"], "inner", n_large)
        if level == levels:
            return links.unionByName(_blocks(large, leaf, percent))
        links = links.unionByName(_blocks(large.where(F.col("o") <= leaf), leaf, percent))
        if sizes.where(F.col("o") > leaf).isEmpty():
            return links
        now, more = _cut(large.where(F.col("o") > leaf), percent, pivots, leaf, level)
        links = links.unionByName(more)
    return links


def _cut(rest: DataFrame, percent: int, pivots: int, leaf: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One level of Voronoi regions: the regions to go on with, and the links of sets to pivots and in regions that end here.

    Near copies of one text are as near to every pivot, and each would go to every region. So a region is cut where that
    leaves half of its pairs at most; else the sets that pivots have not tied together meet the others in blocks."""
    radius = 1 - percent / 100
    order = F.xxhash64("node", F.lit(level))
    # About `pivots` open sets a region by hash, never more, and always the one with the least hash.
    drawn = rest.where("open").where(F.pmod(order, F.col("o")) < pivots)
    least = rest.where("open").groupBy("region").agg(F.min_by("node", order).alias("node"))
    drawn = drawn.select("region", "node", "own").unionByName(rest.join(least, ["region", "node"], "left_semi").select("region", "node", "own"))
    chosen = drawn.dropDuplicates(["region", "node"]).groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct("node", "own"))), 1, pivots).alias("p"))
    # A region's pivots go once to each part of about `leaf` of its sets.
    parts = F.ceil(F.col("m") / leaf).cast("long")
    sizes = rest.select("region", "m").distinct()
    centres = chosen.join(sizes, "region").select("region", "p", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    centres = centres.select("region", "part", F.explode("p").alias("x")).select(F.col("region").alias("zone"), F.col("part").alias("slice"), "x.*")
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    schema = "region long, node long, own array<long>, d array<double>, mask long, near array<long>"
    split = stored(dealt.groupBy("region", "part").cogroup(centres.groupBy("zone", "slice")).applyInArrow(_distances(percent), schema))
    links = split.select(F.col("node").alias("a"), F.explode("near").alias("b")).where("a <> b")

    # Pivots that a set links to are connected; a set's label is the component of its pivots, -1 without a link.
    joined = split.groupBy("region", "mask").agg(F.count("*").alias("c")).groupBy("region").applyInArrow(_joined(pivots), "region long, labels array<int>")
    split = split.join(joined, "region").withColumn("home", F.array_min("d"))
    split = split.withColumn("label", F.expr("if(mask = 0, -1, element_at(labels, cast(bit_count((mask & -mask) - 1) as int) + 1))"))
    # Sets are left out until it is known which regions they go to: there is a row for every pivot.
    cells = split.select("region", "node", "home", "label", "labels", F.posexplode("d").alias("i", "far")).where(F.expr(f"far <= home + {2 * radius} + 1e-9"))
    cells = cells.withColumn("open", F.expr("label < 0 or label <> element_at(labels, i + 1)")).drop("label", "labels")
    reach = cells.where(f"far = home and home <= {BALL}").groupBy("region", "i").agg(F.max("home").alias("most"))
    cells = cells.join(reach, ["region", "i"]).where(F.expr(f"far <= most + {radius} + 1e-9"))
    rings = cells.where("open").groupBy("region", "i").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    held = cells.join(rings, ["region", "i"]).where(F.expr(f"far between low - {radius} - 1e-9 and high + {radius} + 1e-9"))
    held = held.select("region", "node", F.struct(F.xxhash64("region", "i").alias("region"), "open").alias("to"))
    # Sets beyond every ball stay together, with those that can be within the threshold of one.
    beyond = split.groupBy("region").agg(F.max("home").alias("farthest")).where(f"farthest > {BALL}").select("region")
    outside = split.join(beyond, "region").where(f"home > {BALL - radius} - 1e-9")
    outside = outside.select("region", "node", F.struct(F.xxhash64("region", F.lit("outside")).alias("region"), F.expr(f"home > {BALL}").alias("open")).alias("to"))
    both = cut_lineage(held.unionByName(outside).distinct())

    tied = split.groupBy("region", "label").agg(F.count("*").alias("c"), F.max(F.col("label") >= 0).alias("linked"))
    tied = tied.groupBy("region").agg(F.max_by("label", F.struct("linked", "c")).alias("main"), F.sum("c").alias("m"), F.max(F.expr("if(linked, c, 0)")).alias("most"))
    tied = tied.select("region", "main", "m", (F.col("m") - F.col("most")).alias("o"))
    pairs = both.groupBy("region", "to.region").agg(F.count("*").alias("m"), F.count_if("to.open").alias("o")).toDF("region", "cell", "m", "o")
    pairs = pairs.groupBy("region").agg(F.sum(F.col("m").cast("double") * F.col("o")).alias("pairs"))
    tied = cut_lineage(tied.join(pairs, "region", "left").withColumn("cut", F.expr(f"coalesce(pairs, 0) <= {LEFT}D * m * o")))

    ends = split.select("region", "node", "own", "label").join(tied.where("not cut"), "region").withColumn("open", F.expr("label < 0 or label <> main"))
    links = links.unionByName(_blocks(ends, leaf, percent))
    goes = both.join(tied.where("cut"), "region", "left_semi").groupBy("region", "node").agg(F.collect_list("to").alias("to"))
    sets = split.select("region", "node", "own").join(goes, ["region", "node"]).select("node", "own", F.explode("to").alias("to"))
    return stored(sets.select("to.region", "node", "own", "to.open")), links


def _distances(percent: int):
    """Distances of every set to the pivots of its region, and which pivots it links to: as bits and as nodes."""

    def run(sets: pa.Table, given: pa.Table) -> pa.Table:
        centres = sorted((node, own.values.to_numpy()) for node, own in zip(given.column("node").to_pylist(), given.column("own"), strict=True))
        far, masks, near = [], [], []
        for own in sets.column("own"):
            mine = own.values.to_numpy()
            d, mask, links = [], 0, []
            for bit, (pivot, other) in enumerate(centres):
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                union = len(mine) + len(other) - shared
                d.append(1 - shared / union)
                if 100 * shared >= percent * union:
                    mask |= 1 << bit
                    links.append(pivot)
            far.append(np.array(d))
            masks.append(mask)
            near.append(np.array(links, dtype=np.int64))
        more = {"d": list_array(far, pa.float64()), "mask": pa.array(masks, pa.int64()), "near": list_array(near, pa.int64())}
        return pa.table({**{c: sets.column(c) for c in ("region", "node", "own")}, **more})

    return run


def _joined(pivots: int):
    """The component of every pivot of a region, by the sets that link to several."""

    def run(table: pa.Table) -> pa.Table:
        parts = [1 << i for i in range(pivots)]
        for mask in table.column("mask").to_pylist():
            if mask & (mask - 1):
                met = [p for p in parts if p & mask]
                if len(met) > 1:
                    parts = [p for p in parts if not p & mask] + [sum(met)]
        labels = [next(k for k, p in enumerate(parts) if p >> i & 1) for i in range(pivots)]
        return pa.table({"region": table.column("region").slice(0, 1), "labels": pa.array([labels], pa.list_(pa.int32()))})

    return run


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of left x right link, by a matrix product over the shingles that both sides have."""
    values, counts = np.unique(np.concatenate(left + right), return_counts=True) if left and right else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    # What one set alone has is in no intersection; a side compared with itself has everything twice.
    shared = values[counts > (2 if left is right else 1)]
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        sides = []
        for side in (left, right):
            matrix = np.zeros((len(side), len(part)), dtype=np.float32)
            for row, own in enumerate(side):
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
                place = np.minimum(np.searchsorted(part, own), len(part) - 1)
                matrix[row, place[part[place] == own]] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    if left is right:
        np.fill_diagonal(total, [len(x) for x in left])
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * total >= percent * (sizes - total)


def _spanning(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Links from each node to the first of its component, for the links between the places a and b."""
    top = list(range(len(nodes)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        top[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    keep = roots != np.arange(len(nodes))
    return pa.table({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(nodes[roots[keep]], pa.int64())})


def _leaf(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        nodes, at = np.unique(nodes, return_index=True)
        own = table.column("own").combine_chunks()
        # Sets come sorted as unsigned numbers; here the order is that of signed ones.
        sets = [np.sort(own[int(i)].values.to_numpy()) for i in at]
        a, b = np.nonzero(np.triu(linked_pairs(sets, sets, percent), 1)) if len(nodes) > 1 else (nodes[:0], nodes[:0])
        return _spanning(nodes, a, b)

    return run


def _blocks(large: DataFrame, leaf: int, percent: int) -> DataFrame:
    """Exact comparison of the open sets of regions of `m` sets, `o` of them open, with all of them: each block of about `leaf` open
    sets with each block of about `leaf` sets is a task of its own."""
    ways = large.where("o > 0").withColumn("k", F.ceil(F.col("m") / leaf).cast("long")).withColumn("l", F.ceil(F.col("o") / leaf).cast("long"))
    meets = "transform(sequence(0L, l - 1), i -> struct(i, pmod(xxhash64(node), k) as j, 0 as side))"
    opens = "transform(sequence(0L, k - 1), j -> struct(pmod(xxhash64(node, 1), l) as i, j, 1 as side))"
    cells = ways.select("region", "node", "own", F.explode(F.expr(f"if(open, concat({opens}, {meets}), {meets})")).alias("at"))
    return cells.select("region", "node", "own", "at.*").groupBy("region", "i", "j").applyInArrow(_cell(percent), "a long, b long")


def _cell(percent: int):
    """Links between the sets of side 1 and those of side 0."""

    def run(table: pa.Table) -> pa.Table:
        node, side, own = table.column("node").to_numpy(), table.column("side").to_numpy(), table.column("own").combine_chunks()
        rows = [np.flatnonzero(side == 1), np.flatnonzero(side == 0)]
        if not len(rows[0]) or not len(rows[1]):
            return _spanning(node[:0], rows[0][:0], rows[0][:0])
        sets = [[np.sort(own[int(r)].values.to_numpy()) for r in part] for part in rows]
        x, y = np.nonzero(linked_pairs(*sets, percent))
        return _spanning(node, rows[0][x], rows[1][y])

    return run
