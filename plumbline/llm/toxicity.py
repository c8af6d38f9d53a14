"""Toxicity from bags of subwords: averaged embeddings under a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.llm.common import bucket, row_key, stored
from plumbline.llm.words import MULTIPLIER, Words, mix, slices, text_bytes

BUCKETS = 1 << 17
DIMENSIONS = 4
GRAMS = (3, 5, 6, 7, 8)
WINDOW = 4
PER_CLASS = 1_000
SAMPLE_CHARS = 12_000_000
EPOCHS = 25
RATE = 0.1
LEAST_PRIOR = 0.3
DECAY = 1e-6
ROUNDS = 2
SCHEMA = "doc_id long, score double, predicted int"


class Letters(Words):
    """Words as runs of letters: ASCII letters, lower-cased, and every other character beyond ASCII."""

    def __init__(self) -> None:
        super().__init__(lower=True)
        self.blank[:128] = True
        self.blank[65:91] = self.blank[97:123] = False


def subwords(split: Words, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of the given words, with marked word ends, and each word's first place among them.

    n-grams are over bytes; a whole word has a bucket of its own too."""
    length = ends - starts + 2
    first = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(length, out=first[1:])
    marked = np.full(int(first[-1]), 1, dtype=np.uint64)
    inner = np.arange(int(first[-1])) - np.repeat(first[:-1], length)
    keep = (inner > 0) & (inner < np.repeat(length, length) - 1)
    marked[keep] = split.values[data[(np.repeat(starts, length) + inner - 1)[keep]]]
    left = np.repeat(length, length) - inner
    word = np.repeat(np.arange(len(starts)), length)
    grams, owners = [], []
    for k in GRAMS:
        at = np.flatnonzero(left >= k)
        total = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            total = total * np.uint64(MULTIPLIER) + marked[at + j]
        grams.append(mix(total))
        owners.append(word[at])
    whole = split.hashed(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams.append(whole)
    owners.append(np.arange(len(starts)))
    gram, owner = (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return gram[order], np.searchsorted(owner[order], np.arange(len(starts)))


def distinct_words(split: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets and places of the distinct words, the distinct word of every word, and each text's first word."""
    starts, ends, hashes, firsts = split.split(data, offsets)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    grams, first = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    total = 0
    # In blocks of about a million letters; a single longer word is a block.
    sizes = np.cumsum(ends[at] - starts[at]) // (1 << 20)
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(sizes)) + 1) if len(at) else []:
        s, e = starts[at[part]], ends[at[part]]
        flat = np.concatenate([data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        edge = np.concatenate([[0], np.cumsum(e - s)])
        g, f = subwords(split, flat, edge[:-1], edge[1:])
        grams.append(g)
        first.append(f + total)
        total += len(g)
    return np.concatenate(grams), np.concatenate(first), which, firsts


def window_starts(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of WINDOW words, and the window count per text."""
    n = np.diff(firsts)
    count = (n + WINDOW - 1) // WINDOW
    ahead = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(firsts[:-1], count) + WINDOW * (np.arange(ahead[-1]) - np.repeat(ahead[:-1], count))
    return at, count


class Model:
    """score = sigmoid(scale * top + shift), top being the highest window logit of a text.

    A window's logit is linear in the average of its words' embeddings, each the average of its n-grams' embeddings, so at
    scoring time every n-gram needs one number only."""

    def __init__(self, weight: np.ndarray, bias: float, scale: float, shift: float) -> None:
        self.weight, self.bias, self.scale, self.shift = weight, bias, scale, shift

    def tops(self, grams: np.ndarray, first: np.ndarray, which: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        out = np.full(len(firsts) - 1, -np.inf)
        if len(which) == 0:
            return out
        word = np.add.reduceat(self.weight[grams], first) / np.diff(np.append(first, len(grams)))
        at, count = window_starts(firsts)
        size = np.diff(np.append(at, len(which)))
        logit = np.add.reduceat(word[which], at) / size + self.bias
        filled = np.flatnonzero(count)
        out[filled] = np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum(count[filled])[:-1]]))
        return out

    def scores(self, tops: np.ndarray) -> np.ndarray:
        """A text without a word has score 0."""
        with np.errstate(invalid="ignore"):
            return np.where(np.isinf(tops), 0.0, 1 / (1 + np.exp(-np.clip(self.scale * tops + self.shift, -30, 30))))


def train(texts: pa.Array, labels: np.ndarray, prior: float, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Embeddings and softmax by full-batch Adam over windows; then once more with, of a toxic text, its top window only.

    `prior` is the share of toxic rows among all learning rows; it places the final probabilities, taken as LEAST_PRIOR at
    least, since a missed toxic text costs more than a doubtful one."""
    split = Letters()
    grams, first, which, firsts = distinct_words(split, *text_bytes(texts))
    at, count = window_starts(firsts)
    owner = np.repeat(np.arange(len(count)), count)
    y = labels[owner].astype(np.float32)
    size = np.diff(np.append(at, len(which))).astype(np.float32)
    per_word = np.diff(np.append(first, len(grams))).astype(np.float32)
    window = np.repeat(np.arange(len(at)), size.astype(np.int64))
    draw = np.random.Generator(np.random.PCG64(seed))
    table, soft, bias = draw.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), draw.normal(0, 0.5, DIMENSIONS).astype(np.float32), 0.0
    use = np.ones(len(at))
    # Gradients of words and n-grams add up over sorted places.
    by_word, by_gram = np.argsort(which, kind="stable"), np.argsort(grams, kind="stable")
    word_edge = np.searchsorted(which[by_word], np.arange(len(first)))
    gram_ids, gram_edge = np.unique(grams[by_gram], return_index=True)
    gram_word = np.repeat(np.arange(len(first)), per_word.astype(np.int64))[by_gram]
    for _ in range(ROUNDS):
        share = use / max(use.sum(), 1)
        # Both classes weigh the same.
        share = np.where(y > 0, share / max(share[y > 0].sum(), 1e-12), share / max(share[y == 0].sum(), 1e-12)).astype(np.float32) / 2
        state = {k: [0.0, 0.0] for k in "tsb"}
        for step in range(1, epochs + 1):
            word = np.add.reduceat(table[grams], first, axis=0) / per_word[:, None]
            mean = np.add.reduceat(word[which], at, axis=0) / size[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ soft + bias, -30, 30)))
            error = (p - y) * share
            d_soft, d_bias = mean.T @ error, np.array([error.sum()])
            d_mean = error[:, None] * soft / size[:, None]
            d_word = np.add.reduceat(d_mean[window][by_word], word_edge, axis=0) / per_word[:, None]
            d_table = np.zeros_like(table)
            d_table[gram_ids] = np.add.reduceat(d_word[gram_word], gram_edge, axis=0)
            d_table[gram_ids] += DECAY * table[gram_ids]
            table -= adam(state["t"], d_table, step, RATE)
            soft -= adam(state["s"], d_soft, step, RATE)
            bias -= float(adam(state["b"], d_bias, step, RATE)[0])
        model = Model(table @ soft, bias, 1.0, 0.0)
        word = np.add.reduceat(model.weight[grams], first) / per_word
        logit = np.add.reduceat(word[which], at) / size
        best = np.full(len(count), -np.inf)
        np.maximum.at(best, owner, logit)
        use = np.where((y == 0) | (logit >= best[owner]), 1.0, 0.0)
    tops = model.tops(grams, first, which, firsts)
    seen = np.isfinite(tops)
    prior = max(prior, LEAST_PRIOR)
    weight = np.where(labels[seen] == 1, prior / max((labels[seen] == 1).mean(), 1e-9), (1 - prior) / max((labels[seen] == 0).mean(), 1e-9))
    model.scale, model.shift = curve(tops[seen], labels[seen].astype(np.float64), weight)
    return model


def adam(state: list, slope: np.ndarray, step: int, rate: float) -> np.ndarray:
    state[0] = 0.9 * state[0] + 0.1 * slope
    state[1] = 0.99 * state[1] + 0.01 * slope * slope
    return rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-12)


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton steps over standardised x."""
    centre, spread = x.mean(), max(x.std(), 1e-9)
    z = np.stack([(x - centre) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ ((y - p) * weight) / len(x) - ridge * np.array([1.0, 0.0]) * w
        bend = (z * (p * (1 - p) * weight)[:, None]).T @ z / len(x) + np.diag([ridge, 1e-9])
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def toxicity(
    df: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    folds: int = 5, fold: int = 0, per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row, from all its windows of WINDOW words.

    Labels are learned from whole texts of at most `per_class` rows of each class, by hash, of those whose crc32(doc_id) mod
    `folds` is not `fold`; fewer rows where their texts together exceed `chars` characters, none longer than that alone. A text without a letter (null, empty) has
    score 0, and so has every text when labels of both classes are missing. A null id is not held out; null labels teach
    nothing; repeated rows are scored alike.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = (F.col("doc_id").isNotNull() & (bucket("doc_id", folds) == fold)).alias("held_out")
    model = _fitted(rows, labels, label, folds, fold, per_class, chars)
    if model is None:
        return rows.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Letters()
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column, 1 << 23):
                s = model.scores(model.tops(*distinct_words(split, *text_bytes(column.slice(a, b - a)))))
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, SCHEMA).select("doc_id", held, "score", "predicted")


def drop_toxic(
    df: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    folds: int = 5, fold: int = 0, per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """The rows of `df`, all columns, whose score is below 0.5; every row where labels of both classes are missing."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = _fitted(rows, labels, label, folds, fold, per_class, chars)
    if model is None:
        return df
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Letters()
        for batch in batches:
            column = batch.column(at)
            for a, b in slices(column, 1 << 23):
                s = model.scores(model.tops(*distinct_words(split, *text_bytes(column.slice(a, b - a)))))
                yield batch.slice(a, b - a).filter(pa.array(s < 0.5))

    return df.mapInArrow(run, df.schema)


def _fitted(rows: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, chars: int) -> Model | None:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(bucket("doc_id", folds) != fold).withColumn("h", F.xxhash64("doc_id", F.lit("toxicity")))
    # Labels count where their documents are; texts stay behind until the rows of the sample are known.
    size = F.coalesce(F.length("text"), F.lit(0)).alias("size")
    here = stored(rows.select("doc_id", row_key("doc_id", "text").alias("key"), size).join(known, "doc_id"))
    counts = {r[0]: r[1] for r in here.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    narrow = here.where(F.col("size") <= chars).select("h", "key", "y", "size")
    drawn = [_within(narrow.where(F.col("y") == y).orderBy("h", "key").limit(per_class).collect(), chars) for y in (0, 1)]
    if not all(drawn):
        return None
    drawn = sorted(drawn[0] + drawn[1])
    keys = rows.sparkSession.createDataFrame(sorted({(key,) for _, key, _ in drawn}), "key long")
    texts = rows.withColumn("key", row_key("doc_id", "text")).join(F.broadcast(keys), "key", "left_semi").select("key", "text").dropDuplicates(["key"]).toArrow()
    place = {key: i for i, key in enumerate(texts.column("key").to_pylist())}
    chosen = texts.column("text").combine_chunks().take(pa.array([place[key] for _, key, _ in drawn]))
    return train(chosen, np.array([y for _, _, y in drawn]), counts[1] / (counts[0] + counts[1]))


def _within(found: list[Row], chars: int) -> list[tuple[int, int, int]]:
    """Hash, key and label of the first rows whose texts together have at most `chars` characters."""
    held = np.cumsum([r.size for r in found], dtype=np.int64)
    return [(r.h, r.key, r.y) for r, total in zip(found, held.tolist(), strict=True) if total <= chars]
