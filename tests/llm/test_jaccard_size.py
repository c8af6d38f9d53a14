"""What the join writes and sends, and that its rarer paths give the same result."""

import random

import numpy as np
from rows import ordered
from test_jaccard import brute, clusters

from plumbline.llm import jaccard
from plumbline.llm.jaccard import jaccard_join


def near_copies(n):
    """Texts that are all near one text, most of them too far from each other to link, and some that link with none."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(150)] = word()
        out.append(" ".join(own))
    return list(enumerate(out))


def watched(monkeypatch):
    cut, seen = jaccard._cut, []

    def run(rest, *more):
        now, links = cut(rest, *more)
        seen.append((rest.count(), now.count()))
        return now, links

    monkeypatch.setattr(jaccard, "_cut", run)
    return seen


def test_near_copies_do_not_go_to_every_pivot(spark, monkeypatch):
    seen, rows = watched(monkeypatch), near_copies(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(jaccard_join(df, leaf=8, pivots=6).collect()) == brute(rows)
    assert seen and all(after <= 2 * before for before, after in seen)


def test_windows_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEFT", 1e6)
    seen, rows = watched(monkeypatch), clusters(7, 3, 15, 14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(jaccard_join(df, bucket=3, leaf=6, pivots=3, levels=2).collect()) == brute(rows)
    assert any(after for _, after in seen)


def test_more_frequent_shingles_than_are_listed(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    found, counts, regions, joined = [], jaccard._frequent, [], jaccard._regions_joined
    monkeypatch.setattr(jaccard, "_frequent", lambda *a: found.append(counts(*a)) or found[-1])
    monkeypatch.setattr(jaccard, "_regions_joined", lambda docs, rows, given, *a: regions.append(given.count()) or joined(docs, rows, given, *a))
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(25)]
    rows = list(enumerate(" ".join([word() for _ in range(60)] + passage) for _ in range(40)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(jaccard_join(df, bucket=3).collect()) == brute(rows)
    assert len(found[0][0]) == 4 and found[0][2] is not None
    # A passage that all hold ties no unrelated texts.
    assert regions == [0]


def test_hashes_are_packed_small():
    rng = np.random.Generator(np.random.PCG64(3))
    values = rng.integers(0, 1 << 32, 2_000_000, dtype=np.uint64)
    values[:3] = 0, (1 << 32) - 1, values[5]
    ranges, counts, packed = jaccard._by_range(values, 32)
    assert sum(map(len, packed)) < 1.9 * len(values)
    back = np.concatenate([jaccard._of_range(r, 32, [(n, data)], 1)[0] for r, n, data in zip(ranges, counts, packed, strict=True)])
    assert (back == np.sort(values)).all()
    own = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    small = rng.integers(0, 1 << 40, 1000, dtype=np.uint64)
    ranges, counts, packed = jaccard._by_range(small, 40, own)
    parts = [jaccard._of_range(r, 40, [(n, data)] * 2, 2) for r, n, data in zip(ranges, counts, packed, strict=True)]
    s, node, part = (np.concatenate(x) for x in zip(*parts, strict=True))
    assert sorted(zip(s.tolist(), node.tolist(), part.tolist(), strict=True)) == sorted((a, b, k) for a, b in zip(small.tolist(), own.tolist(), strict=True) for k in (0, 1))
