"""Personal data: fixed forms, and identifiers found by bootstrapping from the contexts of those.

The base finds emails, addresses, cards and phone numbers by form. Each of them, and every other token that looks like an
identifier, is an instance; the words around it are patterns. Spark counts which patterns hold which instances, over all texts,
and scores both in turn: a pattern by the share of its instances that are believed, an instance by the patterns that hold it.
Tokens in a pattern of high confidence are reported too, as `other`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "other")
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.8
PATTERNS = 10_000
CONTEXT = 40

# Fixed forms of the base. A number's first digit is not preceded by a digit: an earlier start would have matched as well.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s\"'<>|,;()\[\]{}]*[0-9][^\s\"'<>|,;()\[\]{}]*")
LEAST_TOKEN = 6
UNIT = re.compile(r"[^\W\d_]+|[^\w\s]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if place % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base forms, each kind leftmost and without overlaps, sorted."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), 0))
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def other_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of LEAST_TOKEN characters or more with a digit, without closing punctuation, that overlap no base span."""
    out = []
    if not DIGIT.search(text):
        return out
    taken, n = 0, len(spans)
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".:!?*#$%&=-":
            end -= 1
        while start < end and text[start] in ".:!?*#$%&=-":
            start += 1
        if end - start < LEAST_TOKEN:
            continue
        while taken < n and spans[taken][1] <= start:
            taken += 1
        if any(s < end and e > start for s, e, _ in spans[max(0, taken - 4) : taken + 8]):
            continue
        out.append((start, end))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the two words or marks before it, and the one before with the one after."""
    before = UNIT.findall(text[max(0, start - CONTEXT) : start].lower())[-2:]
    after = UNIT.findall(text[end : end + CONTEXT].lower())[:1]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern, instance and whether the base knows it; each pair of a batch once."""
    for batch in batches:
        seen: dict[tuple[str, int], bool] = {}
        for value in batch.column("text"):
            text = value.as_py()
            if not text:
                continue
            spans = base_spans(text)
            for start, end, known in [*((s, e, True) for s, e, _ in spans), *((s, e, False) for s, e in other_tokens(text, spans))]:
                name = int.from_bytes(hashlib.blake2b(text[start:end].lower().encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                for pattern in contexts(text, start, end):
                    seen[pattern, name] = seen.get((pattern, name), False) or known
            if len(seen) > 100_000:
                yield _as_edges(seen)
                seen = {}
        yield _as_edges(seen)


def _as_edges(seen: dict[tuple[str, int], bool]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([p for p, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.int64()), pa.array(list(seen.values()), pa.bool_())], names=["pattern", "instance", "seed"]
    )


def learned_patterns(rows: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """All patterns of high confidence, as rows. Patterns and instances are scored in turn, `rounds` times, over all texts."""
    edges = stored(rows.select("text").mapInArrow(_edges, "pattern string, instance long, seed boolean").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    belief = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    good = None
    for step in range(rounds):
        scored = edges.join(belief, "instance").groupBy("pattern").agg(F.sum("belief").alias("support"), F.avg("belief").alias("confidence"))
        good = stored(scored.where((F.col("support") >= support) & (F.col("confidence") >= confidence)))
        if step + 1 < rounds:
            by_pattern = edges.join(good, "pattern", "left")
            doubt = F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.99))))
            belief = by_pattern.groupBy("instance").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(doubt)).alias("belief"))
    return good.select("pattern")


def all_spans(text: str, patterns: frozenset[str], found: Iterable[Iterable[int]] = ()) -> list[tuple[int, int, int]]:
    """Base spans, and the candidate tokens that are in one of `patterns` or listed in `found`."""
    spans = base_spans(text)
    more = [(s, e, 4) for s, e in found]
    if patterns:
        more += [(s, e, 4) for s, e in other_tokens(text, spans) if any(p in patterns for p in contexts(text, s, e))]
    if more:
        spans = sorted([*spans, *more], key=lambda s: (s[0], s[2]))
    return spans


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of the text, pattern, start and end of every candidate token; those of equal texts of a batch once."""
    for batch in batches:
        seen: dict[tuple[int, str, int, int], None] = {}
        for key, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py()
            for start, end in other_tokens(text, base_spans(text)) if text else []:
                seen.update(((key, pattern, start, end), None) for pattern in contexts(text, start, end))
            if len(seen) > 100_000:
                yield _as_candidates(seen)
                seen = {}
        yield _as_candidates(seen)


def _as_candidates(seen: dict[tuple[int, str, int, int], None]) -> pa.RecordBatch:
    columns = list(zip(*seen, strict=True)) or [(), (), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["key", "pattern", "start", "end"])


def _searched(df: DataFrame, text: str, patterns: list[str] | None, sent: int) -> tuple[DataFrame, frozenset[str]]:
    """`df` with a last column of the tokens found by a join, and the patterns to look for in tasks: of more than `sent` none."""
    rows = df.select(F.col(text).alias("text"))
    last = "found" + "_" * max(map(len, df.columns))
    none = F.lit(None).cast("array<array<int>>").alias(last)
    if patterns is not None:
        return df.select("*", none), frozenset(patterns)
    good = learned_patterns(rows)
    if good.count() <= sent:
        return df.select("*", none), frozenset(r[0] for r in good.collect())
    key = F.xxhash64(F.col(text))
    tokens = rows.select(F.xxhash64("text").alias("key"), "text").mapInArrow(_candidates, "key long, pattern string, start int, end int")
    tokens = tokens.join(good, "pattern").select("key", "start", "end").distinct()
    found = tokens.groupBy(F.col("key").alias(f"{last}_key")).agg(F.collect_list(F.array("start", "end")).alias(last))
    return df.select("*", key.alias(f"{last}_key")).join(found, f"{last}_key", "left").drop(f"{last}_key"), frozenset()


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text", patterns: list[str] | None = None, sent: int = PATTERNS) -> DataFrame:
    """Counts and spans of personal data in every row: n_email, n_ip, n_card, n_phone (the base), n_other (by learned patterns),
    base_sha256 of the base spans and `spans`, all spans as kind:start:end in code points, by start, then kind.

    `patterns` are learned from these rows where none are given; up to `sent` of them go to every task, more are joined with the
    tokens. Only tokens of LEAST_TOKEN characters or more that hold a digit can be `other`. Null and empty texts have no span. Rows repeat and ids may be
    null: each row is searched alone.
    """
    rows, known = _searched(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", patterns, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, joined = [], []
            for value, found in zip(batch.column("text"), batch.column(2).to_pylist(), strict=True):
                spans = all_spans(value.as_py() or "", known, found or ())
                texts = [f"{KINDS[k]}:{s}:{e}" for s, e, k in spans]
                for kind, held in enumerate(counts):
                    held.append(sum(k == kind for _, _, k in spans))
                shas.append(hashlib.sha256(",".join(t for t, (_, _, k) in zip(texts, spans, strict=True) if k < 4).encode()).hexdigest())
                joined.append(",".join(texts))
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(joined, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_other long, base_sha256 string, spans string")


def redact_pii(df: DataFrame, text: str = "text", patterns: list[str] | None = None, sent: int = PATTERNS) -> DataFrame:
    """`df` with each span of personal data replaced by its kind, as in `<EMAIL>`; overlapping spans are one, of the first's kind.

    All other columns stay. Null texts stay null."""
    rows, known = _searched(df, text, patterns, sent)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                whole = value.as_py()
                parts, done, held = [], 0, 0
                for start, end, kind in all_spans(whole, known, found or ()) if whole else []:
                    if start >= held:
                        parts += [whole[done:start], f"<{KINDS[kind].upper()}>"]
                    done = held = max(held, end)
                out.append("".join([*parts, whole[done:]]) if parts else whole)
            columns = [*batch.columns[:at], pa.array(out, batch.schema.field(at).type), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.remove(batch.num_columns - 1))

    return rows.mapInArrow(run, df.schema)
