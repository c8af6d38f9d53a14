import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
from rows import ordered, pairs

from plumbline.llm.jaccard import _summed, drop_near_duplicates, jaccard_join


def sets_of(rows):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append(frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    return out


def brute(rows):
    sets = sets_of(rows)
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for h in holders.values() for p in combinations(h, 2))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return ordered(out)


def clusters(seed, bases, copies, edits):
    """Near copies of a few texts at all distances around the threshold, a passage that all share, and texts on their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(bases):
        base = [word() for _ in range(80)] + passage
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(80)] = word()
            texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)] + [" ".join(passage)] * 3
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    rows = clusters(1, 3, 40, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert ordered(jaccard_join(df).collect()) == want
    # Tiny limits send everything through pivots, windows, outside regions and, with one level, blocks.
    assert ordered(jaccard_join(df, bucket=3, leaf=6, pivots=4).collect()) == want
    assert ordered(jaccard_join(df, bucket=2, leaf=3, pivots=2, levels=1).collect()) == want


def test_awkward_rows(awkward, nothing):
    assert ordered(jaccard_join(awkward).collect()) == brute(pairs(awkward))
    assert jaccard_join(nothing).collect() == []


def test_one_of_each_group_stays(awkward, nothing):
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    left = pairs(kept)
    assert sorted(i for i, t in left if i is not None) == [1, 3, 4, 5, 6, 7, 8, 10, 11, 12] and len(left) == 12
    assert drop_near_duplicates(nothing).collect() == []


def test_counts_are_summed_over_batches():
    values = [1, 1, 1, 2, 2, 5, 5, 5, 5, 9]
    rows = [pa.record_batch([pa.array(values[i:j], pa.int32()), pa.array([2] * (j - i), pa.int32())], names=["s", "c"]) for i, j in ((0, 2), (2, 2), (2, 3), (3, 7), (7, 10))]
    found = [(r["s"], r["c"]) for b in _summed(3)(iter(rows)) for r in b.to_pylist()]
    assert found == [(1, 6), (2, 4), (5, 8)]
    assert [b.num_rows for b in _summed(3)(iter([]))] == [0]
