"""Phrases against a plain count of n-grams, with shards, trees and joins of every size; the FM-index against a plain count too."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import ordered

from plumbline.llm.collocations import collocations
from plumbline.llm.fmindex import FmIndex

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, per_lang):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for key, a in counts.items():
        lang, *words = key
        if len(words) < 2 or a < least:
            continue
        if any(counts[q] >= a for q in counts if len(q) == len(key) + 1 and q[0] == lang and tuple(words) in (q[1:-1], q[2:])):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, *words[:k]], counts[lang, *words[k:]], totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:per_lang]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine)]
    return ordered(ranked)


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Of", "the", "of", "é", "new", "york", "a", "b", "c", "d"])
    text = lambda n: "".join(word() + rng.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "de", None]), text(rng.choice([0, 1, 5, 80]))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, "new york new york"), ("fr", "x"), ("en", text(3000))] + [("de", "of the new york of the new york")] * 40
    return spark.createDataFrame(rows, "lang string, text string").repartition(3), rows


@pytest.mark.parametrize("settings", [{}, {"shard_bytes": 300, "fan": 3}, {"shard_bytes": 300, "fan": 2, "sent": 0}, {"sent": 30}, {"per_lang": 7}, {"longest": 2}])
def test_phrases_equal_brute_force(speech, settings):
    df, rows = speech
    got = collocations(df, least=6, **settings).collect()
    assert ordered(got) == brute(rows, 6, settings.get("longest", 5), settings.get("per_lang", 2000)) and got


def test_all_ranks(speech):
    df, rows = speech
    assert ordered(collocations(df, least=6, per_lang=None).collect()) == brute(rows, 6, 5, None)


def test_awkward_rows(awkward, nothing):
    got = {(r.lang, r.phrase): r.a for r in collocations(awkward).collect()}
    assert got[("en", "word word word word word")] == 296 and collocations(nothing).collect() == []
    rows = [(r.lang, r.text) for r in awkward.where(F.length("text") < 5000).select("lang", "text").collect()]
    assert ordered(collocations(awkward.where(F.length("text") < 5000), least=2).collect()) == brute(rows, 2, 5, 2000)


@pytest.mark.parametrize("n,symbols", [(0, 3), (1, 3), (40, 2), (3000, 5)])
def test_index_counts_every_ngram(n, symbols):
    seq = np.random.default_rng(3).integers(0, symbols, n)
    for k, (words, count) in enumerate(FmIndex(seq, 5).ngrams(5), 1):
        want = Counter(tuple(seq[i : i + k].tolist()) for i in range(n - k + 1) if all(seq[i : i + k]))
        assert {tuple(w): int(c) for w, c in zip(words.tolist(), count, strict=True)} == want
