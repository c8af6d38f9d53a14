"""Lexical search against plain scores, and the ring's assignment against a plain walk."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from rows import ordered, pairs

from plumbline.llm.lexical import lexical_search
from plumbline.llm.sharding import capacities, ring, shard_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, top=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, tf, sum(tf.values())) for doc, tf in counts if tf]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, tf, _ in counts for t in tf)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item] |= set(terms(text))
    out = []
    for item, ts in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts if t in df}
        found = []
        for doc, tf, n in counts:
            m = 10 + (90 * n * n_docs) // length
            found.append((sum(x * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, x in w.items() if t in tf), doc))
        found = sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:top]
        out += [(item, i + 1, doc, score) for i, (score, doc) in enumerate(found)]
    return ordered(out)


@pytest.mark.parametrize("settings", [{}, {"terms": 7, "items_at_once": 2}, {"top": 2}])
def test_search_equals_brute_force(spark, awkward, settings):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ant", "ant", "ants", "bee", "b-e", "été", "12", "x_y", "中文"])
    docs = [(i if i % 9 else None, " ".join(word() for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(80)] + [(5, None), (7, "ant"), (7, "ant"), (8, "-- !")]
    docs += pairs(awkward)
    items = [(0, "ants bee"), (1, "Ant é ÉTÉ été"), (2, "nothing of it"), (3, None), (4, ""), (None, "ant"), (0, "12 ant"), (6, "one two word 中文 x y"), (7, "ant ant ant")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("row", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search(d, i, **settings).collect()
    assert ordered(got) == brute(docs, items, settings.get("top", 10)) and got


def test_search_of_or_for_nothing(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search(nothing, items).collect() == [] and lexical_search(awkward, items.limit(0)).collect() == []
    assert lexical_search(awkward, spark.createDataFrame([(1, "absent")], "item_id long, text string")).collect() == []


def walked(points, shards, nodes, slack):
    """Shard of each row by offering rows node by node: `points` are (place on the ring, row) in ring order."""
    places = ring(shards, nodes)
    edges = [p for p, _ in places]
    room = capacities(len(points), shards, slack)
    waiting = defaultdict(list)
    for point, row in points:
        waiting[bisect.bisect_left(edges, point) % len(edges)].append((point <= edges[0], point, row))
    arcs = [(a, sorted(waiting[a], key=lambda x: (x[0], x[1]))) for a in [*range(1, len(edges)), 0] if a in waiting]
    out = {}
    for step in range(len(edges)):
        for a, rows in arcs:
            shard = places[(a + step) % len(edges)][1]
            while rows and room[shard]:
                room[shard] -= 1
                out[rows.pop(0)[2]] = shard
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_ring_equals_a_plain_walk(spark, small, slack):
    points = sorted((r.p, r.doc_id) for r in small.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("p"), F.xxhash64("doc_id").alias("s")).orderBy("p", "s").collect())
    keys = {r.doc_id: (r.p, r.s) for r in small.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("p"), F.xxhash64("doc_id").alias("s")).collect()}
    points = [(p, d) for p, d in sorted(points, key=lambda x: keys[x[1]])]
    got = shard_rows(small, slack=slack, nodes=16).collect()
    assert {r.doc_id: r.shard for r in got} == walked(points, 24, 16, slack)
    slots, texts = defaultdict(list), dict(pairs(small))
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 if slack == 0 else max(counts) <= math.ceil(200 * (1 + slack) / 24)


def test_few_rows_move_to_one_more_shard(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    share = lambda slack: (
        shard_rows(rows, slack=slack).select("doc_id", F.col("shard").alias("a")).join(shard_rows(rows, shards=25, slack=slack).select("doc_id", "shard"), "doc_id").where("a != shard").count() / 20_000
    )
    assert share(0.25) < 0.07 and share(0.0) < 0.25


def test_ring_with_awkward_rows_and_one_hot_text(spark, awkward, nothing):
    got = shard_rows(awkward).collect()
    assert sorted(r.shard for r in got) == sorted(range(16)) and {r.slot for r in got} == {0} and shard_rows(nothing).collect() == []
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(8, 0)}
    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    counts = Counter(r.shard for r in shard_rows(hot).collect())
    assert set(counts.values()) == {125}
