"""Byte-level BPE: every distinct pre-token of the corpus is encoded once, and texts are put together again by position.

One row per pre-token would send the corpus around several times over, so positions travel packed. Texts are taken in chunks of
about CHUNK pre-tokens. A chunk's distinct pre-tokens are dealt by hash to the tasks that encode them, each distinct one once
per task, whichever chunks have it; the ids go back to the chunks, where the sequence of pre-token numbers (the positions) meets
them. A frequent pre-token is one entry per chunk, so no task sees more of it than of another. The two sides of the last join
read the texts independently: a chunk whose other side is missing, or a pre-token in none, is encoded on the spot.
Decoding joins ids with the table of token bytes, which the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import row_key

CHUNK = 1_500_000
LONG_TEXT = 1 << 22
ROWS_PER_TASK = 4_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of lines with base64 bytes and a rank. It is read by the driver only."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def encode(df: DataFrame, ranks: list[bytes], pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids (array of int) of every row: the ranks of BPE merges within each match of `pattern`, without special tokens.

    Null and empty texts have no ids. Rows repeat and ids may be null: rows keep their own results."""
    rows = df.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tasks = max(8, df.count() // ROWS_PER_TASK)
    words = rows.mapInArrow(_words(pattern, chunk, tasks), "task int, chunk long, words binary")
    ids = words.groupBy("task").applyInArrow(_encoded(ranks), "chunk long, words binary, ids binary")
    texts = rows.mapInArrow(_sequences(pattern, chunk), "chunk long, doc_ids array<long>, sizes array<int>, words binary, places binary")
    return texts.groupBy("chunk").cogroup(ids.select(F.col("chunk").alias("of"), F.col("words").alias("known"), "ids").groupBy("of")).applyInArrow(_together(ranks), "doc_id long, ids array<int>")


def decode(ids: np.ndarray, offsets: np.ndarray, table: pa.Array) -> list[bytes]:
    """Bytes of each text from its ids, by the table of token bytes."""
    found = table.take(pa.array(ids))
    edge = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1]
    data = found.buffers()[2]
    return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(edge[offsets[:-1]].tolist(), edge[offsets[1:]].tolist(), strict=True)]


def digests(encoded: DataFrame, ranks: list[bytes]) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids, joined by commas, and of the decoded bytes, for rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(ranks, pa.large_binary())
        comma = pa.array([f"{i},".encode() for i in range(len(ranks))], pa.large_binary())
        for batch in batches:
            for part in _small(batch):
                column = part.column("ids")
                offsets = column.offsets.to_numpy().astype(np.int64)
                ids = column.values.to_numpy()[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                texts, joined = decode(ids, offsets, table), decode(ids, offsets, comma)
                shas = [[hashlib.sha256(x).hexdigest() for x in texts], [hashlib.sha256(x[:-1]).hexdigest() for x in joined]]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(shas[1], pa.string()), pa.array(shas[0], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _small(batch: pa.RecordBatch, ids: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // ids
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _chunks(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int) -> Iterator[tuple[int, list, list[int], dict[str, int], array]]:
    """Name, ids of the rows, pre-tokens of each, numbers of distinct pre-tokens and the sequence of numbers of every chunk."""
    split = regex.compile(pattern)
    name, doc_ids, sizes, numbers, places = None, [], [], {}, array("I")
    for batch in batches:
        for row, doc, value in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py() or ""
            found = split.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in split.finditer(text))
            before = len(places)
            number = numbers.setdefault
            places.extend([number(w, len(numbers)) for w in found] if isinstance(found, list) else (number(w, len(numbers)) for w in found))
            name = row if name is None else name
            doc_ids.append(doc)
            sizes.append(len(places) - before)
            if len(places) >= chunk:
                yield name, doc_ids, sizes, numbers, places
                name, doc_ids, sizes, numbers, places = None, [], [], {}, array("I")
    if name is not None:
        yield name, doc_ids, sizes, numbers, places


def pack(parts: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(parts), *map(len, parts)], dtype=np.uint32).tobytes() + b"".join(parts), 3)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    edge = 4 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)])
    edge = edge.tolist()
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _words(pattern: str, chunk: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, numbers, _ in _chunks(batches, pattern, chunk):
            dealt: list[list[bytes]] = [[] for _ in range(tasks)]
            for word in sorted(w.encode() for w in numbers):
                dealt[zlib.crc32(word) % tasks].append(word)
            full = [t for t, words in enumerate(dealt) if words]
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([name] * len(full), pa.int64()), pa.array([pack(dealt[t]) for t in full], pa.binary())], names=["task", "chunk", "words"])

    return run


def _encoder(ranks: list[bytes]) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks={token: i for i, token in enumerate(ranks) if token}, special_tokens={})


def _encoded(ranks: list[bytes]):
    held: list[tiktoken.Encoding] = []

    def run(table: pa.Table) -> pa.Table:
        if not held:
            held.append(_encoder(ranks))
        known: dict[bytes, bytes] = {}
        ids = []
        for blob in table.column("words").to_pylist():
            out = []
            for word in unpack(blob):
                code = known.get(word)
                if code is None:
                    code = known[word] = np.array(held[0]._encode_single_piece(word), dtype=np.int32).tobytes()
                out.append(code)
            ids.append(pack(out))
        return pa.table({"chunk": table.column("chunk"), "words": table.column("words"), "ids": pa.array(ids, pa.binary())})

    return run


def _sequences(pattern: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, doc_ids, sizes, numbers, places in _chunks(batches, pattern, chunk):
            numbers = np.frombuffer(places, dtype=np.uint32) if len(places) else np.zeros(0, np.uint32), numbers
            # Low and high halves apart: most high halves are zeros.
            halves = numbers[0].astype("<u4").view(np.uint8).reshape(-1, 4)
            flat = pack([np.ascontiguousarray(halves[:, k]).tobytes() for k in range(4)])
            yield pa.record_batch(
                [pa.array([name], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack([w.encode() for w in numbers[1]])], pa.binary()), pa.array([flat], pa.binary())],
                names=["chunk", "doc_ids", "sizes", "words", "places"],
            )

    return run


def _together(ranks: list[bytes]):
    held: list[tiktoken.Encoding] = []

    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        known: dict[bytes, bytes] = {}
        for words, ids in zip(given.column("known").to_pylist(), given.column("ids").to_pylist(), strict=True):
            known.update(zip(unpack(words), unpack(ids), strict=True))
        docs, sizes, values = [], [], []
        for doc_ids, counts, words, places in zip(*(texts.column(c).to_pylist() for c in ("doc_ids", "sizes", "words", "places")), strict=True):
            codes = []
            for word in unpack(words):
                code = known.get(word)
                if code is None:
                    if not held:
                        held.append(_encoder(ranks))
                    code = known[word] = np.array(held[0]._encode_single_piece(word), dtype=np.int32).tobytes()
                codes.append(code)
            size = np.array([len(c) // 4 for c in codes], dtype=np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            table = np.frombuffer(b"".join(codes), dtype=np.int32)
            number = np.stack([np.frombuffer(p, np.uint8) for p in unpack(places)], axis=1).copy().view("<u4").ravel().astype(np.int64)
            length = size[number]
            ends = np.concatenate([[0], np.cumsum(length)])
            at = np.repeat(first[number] - ends[:-1], length) + np.arange(ends[-1])
            values.append(table[at])
            docs += doc_ids
            edge = np.concatenate([[0], np.cumsum(counts)])
            sizes.append(np.diff(ends[edge]))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(values) if values else [], pa.int32()))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": ids})

    return run
