"""Quality scores from pairwise preferences (Bradley-Terry) over features of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bucket, row_key, stored
from plumbline.llm.repetition import duplicate_lines, per_text, repeated_word_count
from plumbline.llm.words import Words, slices, text_bytes
from plumbline.operators.quantiles import SMALL_COLUMN, quantiles

PAIRS_PER_ROW = 3  # of the more frequent label
GROUP = 64  # rows of the rarer label that are paired within one group
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "symbols", "exclamation", "bars", "upper", "digits", "other_ascii", "marked_words", "dup_lines",
    "repeat_words", "distinct_words", "short_lines", "non_ascii",
)
SCHEMA = "row long, doc_id long, features array<double>"


def features_of(split: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; zeros for a text without words."""
    starts, ends, hashes, firsts = split.split(data, offsets)
    n = np.diff(firsts)
    owner = np.repeat(np.arange(len(n)), n)

    def share(kind: np.ndarray, of: np.ndarray) -> np.ndarray:
        return per_text(kind[data], offsets) / np.maximum(of, 1)

    def of_bytes(wanted: bytes) -> np.ndarray:
        kind = np.zeros(256, dtype=bool)
        kind[list(wanted)] = True
        return kind

    size = per_text(~split.blank[data], offsets)
    letters = of_bytes(bytes(range(65, 91)) + bytes(range(97, 123)))
    digits = of_bytes(b"0123456789")
    other = ~(letters | digits | split.blank)
    other[128:] = False
    text_letters = per_text(letters[data], offsets)
    lines = per_text(data == 10, offsets) + 1
    last = data[ends - 1] if len(ends) else data[:0]
    marked = np.bincount(owner[of_bytes(b"#*$%&|<>!")[last]], minlength=len(n))
    keys = hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, at = np.unique(keys, return_index=True)
    distinct = np.bincount(owner[at], minlength=len(n))
    words = np.maximum(n, 1)
    columns = [
        np.log1p(n), size / words, share(of_bytes(b"#*$%&<>"), size), share(of_bytes(b"!"), size), share(of_bytes(b"|"), size),
        share(of_bytes(bytes(range(65, 91))), text_letters), share(digits, size), share(other, size), marked / words,
        duplicate_lines(split, data, offsets, starts) / lines, repeated_word_count(hashes, owner, firsts, 3) / words, distinct / words, lines / words,
        per_text(data >= 128, offsets) / np.maximum(size, 1),
    ]
    out = np.stack(columns, axis=1)
    out[n == 0] = 0
    return out


def drawn_pairs(y: np.ndarray, z: np.ndarray, seed: int) -> np.ndarray:
    """Differences between rows of label 1 and of label 0, each row in as many pairs as the others of its label (one more or less)."""
    draw = np.random.Generator(np.random.PCG64(seed))
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return z[:0]
    n = PAIRS_PER_ROW * max(len(better), len(worse))

    def dealt(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([draw.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]

    return z[dealt(better)] - z[dealt(worse)]


def fit_pairs(pairs: DataFrame, width: int, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights w that maximise the likelihood of better over worse, P = 1 / (1 + exp(-w (x - y))), by Newton steps.

    `pairs` holds the differences x - y. Each step is one job that sums gradient and curvature where the pairs are."""
    w = np.zeros(width)
    for _ in range(steps):
        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            n, gradient, curve = 0, np.zeros(width), np.zeros((width, width))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, width)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                n += len(x)
                gradient += x.T @ (1 - p)
                curve += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.record_batch([pa.array([[float(n), *gradient, *curve.ravel()]], pa.list_(pa.float64()))], names=["sums"])

        parts = sorted(r.sums for r in pairs.mapInArrow(sums, "sums array<double>").collect())  # one row per task
        total = np.sum(np.array(parts), axis=0)
        n = max(total[0], 1)
        gradient = total[1 : width + 1] / n - ridge * w
        curve = total[width + 1 :].reshape(width, width) / n + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def rank_quality(
    df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    folds: int = 4, fold: int = 2, threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    Preference pairs put a label-1 text before a label-0 one; only rows whose crc32(doc_id) mod `folds` is not `fold` are used, and
    all of them: rows are dealt by hash into groups in which each is paired, and the weights are fitted over the pairs of all
    groups where they lie. Means, spreads and the quantile are those of all learning rows. The score is a logistic curve of the learned Bradley-Terry score, placed so that
    `threshold` falls on the quantile of scores that equals the label-0 share of the learning rows. Null and empty texts have
    zero features and are scored alike. Without labels of both kinds every score is 0. A null id is not held out; null labels
    teach nothing; rows repeat as given.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column):
                x = features_of(split, *text_bytes(column.slice(a, b - a)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.record_batch([batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), values], names=["row", "doc_id", "features"])

    rows = df.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    measured = stored(rows.mapInArrow(measure, SCHEMA))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    learn = measured.where(bucket("doc_id", folds) != fold).join(known, "doc_id").select("row", "y", "features")
    learn = stored(learn)
    feature = [F.col("features")[i] for i in range(len(FEATURES))]
    facts = learn.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.array(*map(F.avg, feature)).alias("centre"), F.array(*map(F.stddev_pop, feature)).alias("spread")).first()
    held = (F.col("doc_id").isNotNull() & (bucket("doc_id", folds) == fold)).alias("held_out")
    if not facts.n0 or not facts.n1:
        return measured.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    centre, spread = np.array(facts.centre), np.array(facts.spread)
    spread = np.where(spread < 1e-9, 1, spread)

    def scaled(column: pa.Array) -> np.ndarray:
        return np.clip((column.flatten().to_numpy().reshape(-1, len(FEATURES)) - centre) / spread, -8, 8)

    def paired(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("row", "ascending"), ("y", "ascending")])
        x = drawn_pairs(group.column("y").to_numpy(), scaled(group.column("features").combine_chunks()), key[0].as_py())
        return pa.table({"difference": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))})

    groups = max(min(facts.n0, facts.n1) // GROUP, 1)
    dealt = learn.withColumn("g", F.pmod(F.xxhash64("row", F.lit("quality")), F.lit(groups)))
    w = fit_pairs(stored(dealt.groupBy("g").applyInArrow(paired, "difference array<double>")), len(FEATURES))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(scaled(batch.column(0)) @ w)], names=["x"])

    # The middle between the scores of two neighbours: those after as many rows as have label 0, and the one before.
    n = facts.n0 + facts.n1
    raw = learn.select("features").mapInArrow(learned, "x double").select(F.lit(0).alias("cid"), "x", F.lit(1).cast("bigint").alias("n"))
    sorted_: list[DataFrame] = []
    cut = quantiles(raw, ((facts.n0 - 0.5) / (n - 1),), [0] if n > SMALL_COLUMN else [], sorted_).first().q[0]
    for frame in sorted_:
        frame.unpersist()
    shift = np.log(threshold / (1 - threshold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip(scaled(batch.column("features")) @ w - cut + shift, -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = measured.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held, "score", "predicted")
