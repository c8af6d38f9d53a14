"""Language by cross-parsing: how many phrases of a language's known text does it take to spell a text?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bucket, stored
from plumbline.llm.words import slices

SLOTS = 48
SLOT_CHARS = 500
LEARNED_CHARS = 24_000
LANGUAGES = 200
BLOCK = 256
SCHEMA = "doc_id long, lang_pred string, score double"


class Automaton:
    """Suffix automaton of a text as a dense table: state and symbol to the next state, 0 where there is none.

    State 1 is the start. Symbol 0 stands for every character that no learned text has."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        follow: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in text.tolist():
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table = np.zeros((len(follow), symbols), dtype=np.int32)
        for state, edges in enumerate(follow):
            for c, to in edges.items():
                self.table[state, c] = to * symbols
        self.table = self.table.ravel()

    def phrases(self, grid: np.ndarray, symbols: int) -> np.ndarray:
        """Phrases that each column of symbols takes: each is the longest match with the learned text. -1 ends a column."""
        state = np.full(grid.shape[1], symbols, dtype=np.int32)
        count = np.zeros(grid.shape[1], dtype=np.int32)
        for row in grid:
            live = int(np.searchsorted(-row, 1)) if row[-1] < 0 else len(row)
            if live == 0:
                break
            now, c = state[:live], row[:live]
            to = self.table[now + c]
            miss = np.flatnonzero(to == 0)
            again = self.table[symbols + c[miss]]
            # The phrase before ends, if there is one; a character that the learned text does not have is a phrase of its own.
            count[miss] += (now[miss] != symbols).astype(np.int32) + (again == 0)
            to[miss] = np.where(again == 0, symbols, again)
            state[:live] = to
        return count


def detect_language(
    df: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", folds: int = 3, fold: int = 1,
    slots: int = SLOTS, slot_chars: int = SLOT_CHARS, learned_chars: int = LEARNED_CHARS, languages: int = LANGUAGES,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row.

    Per language a suffix automaton is built over at most `learned_chars` characters, from up to `slots` rows drawn by hash and
    `slot_chars` characters of each, from a place drawn by hash, of the rows with a language whose crc32(doc_id) mod `folds` is
    not `fold`. More than `languages` languages are refused. A whole text is cut into longest matches; each phrase weighs
    log2 of the language's learned length, and the language with the least sum wins, the first by name among equals. Blocks of
    BLOCK characters are parsed on their own, so a text of any length is many short columns. The score is one minus the
    winner's share of the runner-up's sum (1 with one language). Null texts and texts without a letter
    are `und` with score 0, and so is every text when nothing was learned. A null id is not held out; rows repeat as given.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    held = (F.col("doc_id").isNotNull() & (bucket("doc_id", folds) == fold)).alias("held_out")
    learn = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket("doc_id", folds) != fold))
    drawn = F.xxhash64("doc_id", "text", F.lit("language"))
    # A piece begins anywhere in its text, by hash.
    start = F.pmod(F.xxhash64("doc_id", "text", F.lit("piece")), F.greatest(F.length("text") - slot_chars + 1, F.lit(1))) + 1
    learn = learn.select("lang", F.substr("text", start.cast("int"), F.lit(slot_chars)).alias("text"), F.pmod(drawn, F.lit(slots)).alias("slot"), drawn.alias("h"))
    sample = stored(learn.groupBy("lang", "slot").agg(F.min(F.struct("h", "text")).alias("x")))
    if sample.select("lang").distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"the table has more than {languages} languages; raise `languages` where workers have the memory for their automata")
    sample = sample.orderBy("slot", "lang")
    known: dict[str, list[str]] = {}
    for r in sample.select("lang", "x.text", "slot").toArrow().to_pylist():
        known.setdefault(r["lang"], []).append(r["text"])
    names = sorted(known)
    texts = ["\n".join(known[n])[:learned_chars] for n in names]
    if not names:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    alphabet = np.unique(points(pa.array(texts))[0])
    symbols = len(alphabet) + 1
    code = np.zeros(0x110000, dtype=np.int32)
    code[alphabet] = np.arange(1, symbols)
    weight = np.log2([len(t) + 1 for t in texts])
    machines = [Automaton(code[points(pa.array([t]))[0]], symbols) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column, 1 << 22):
                part = column.slice(a, b - a)
                chars, offsets = points(part)
                grid, owner = columns(code[chars], offsets)
                counts = np.stack([np.bincount(owner, weights=m.phrases(grid, symbols), minlength=b - a) for m in machines])
                letters = pc.match_substring_regex(pc.fill_null(part, ""), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
                # A text's last phrase ends with the text, whichever language.
                counts += 1
                # A phrase points into the learned text: the longer that is, the more bits it takes.
                counts = counts * weight[:, None]
                best = counts.argmin(axis=0)
                ordered = np.sort(counts, axis=0)
                score = 1 - ordered[0] / ordered[1] if len(names) > 1 else np.ones(b - a)
                pred = [names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"]
                )

    return rows.select("doc_id", "text").mapInArrow(run, SCHEMA).select("doc_id", held, "lang_pred", "score")


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, and the offset of each text."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    text = "".join(column.to_pylist())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def columns(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of BLOCK symbols as columns, longest first, and the text of each."""
    size = np.diff(offsets)
    count = (size + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(size)), count)
    ahead = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(offsets[:-1], count) + BLOCK * (np.arange(ahead[-1]) - np.repeat(ahead[:-1], count))
    length = np.minimum(BLOCK, np.repeat(offsets[1:], count) - start)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    place = np.arange(BLOCK)[:, None] + start[None, :]
    grid = np.where(np.arange(BLOCK)[:, None] < length[None, :], codes[np.minimum(place, max(len(codes) - 1, 0))] if len(codes) else 0, -1)
    return grid.astype(np.int32), owner
