"""Operators on single texts, against plain versions of their contracts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from rows import ordered, pairs

from plumbline.llm import langid, pii, repetition
from plumbline.llm.bpe import decode, digests, encode, read_ranks
from plumbline.llm.passages import _one_of_equal, drop_repeated_passages
from plumbline.llm.ranking import drawn_pairs, rank_quality
from plumbline.llm.toxicity import drop_toxic, toxicity, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# --- language ---------------------------------------------------------------------------------------


def test_phrases_equal_longest_matches():
    known = "the cat sat on the mat and the hat"
    alphabet = np.unique(langid.points(pa.array([known]))[0])
    code = np.zeros(0x110000, dtype=np.int16)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    machine = langid.Automaton(code[langid.points(pa.array([known]))[0]], len(alphabet) + 1)
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice("the catsonmdxé ") for _ in range(rng.randrange(600)))
        want = 0
        for at in range(0, len(text), langid.BLOCK):
            block, i = text[at : at + langid.BLOCK], 0
            while i < len(block):
                j = i
                while j < len(block) and block[i : j + 1] in known:
                    j += 1
                want += j == i or j < len(block)
                i = max(j, i + 1)
        chars, offsets = langid.points(pa.array([text]))
        grid, _ = langid.columns(code[chars], offsets)
        assert machine.phrases(grid, len(alphabet) + 1).sum() == want


def test_languages_of_held_out_texts(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.detect_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    odd = langid.detect_language(awkward).collect()
    assert len(odd) == 16 and all((r.lang_pred, r.score) == ("und", 0.0) for r in odd if r.doc_id in (3, 4, 5))
    assert langid.detect_language(nothing).collect() == []


# --- repeated passages ------------------------------------------------------------------------------


def without_repeats(rows, size=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return ordered(out)


def test_repeated_passages(spark, small, awkward, nothing):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("abcdefghij") for _ in range(n))
    passages = [words(60) for _ in range(5)]
    rows = [(i, words(rng.randrange(80)) + rng.choice(" \n") + rng.choice(passages)[: rng.randrange(40, 180)] + " " + words(rng.randrange(80))) for i in range(200)]
    rows += [(300, "a " * 200), (301, "b " * 34), (302, "c " * 36), (303, rows[0][1]), (303, rows[0][1]), (304, "a b " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = without_repeats(rows)
    assert ordered(drop_repeated_passages(df).collect()) == want
    assert ordered(drop_repeated_passages(df, dealt=4).collect()) == want  # anchors dealt over many parts
    assert ordered(drop_repeated_passages(small).collect()) == without_repeats(pairs(small))
    assert ordered(drop_repeated_passages(awkward).collect()) == without_repeats(pairs(awkward))
    assert drop_repeated_passages(nothing).collect() == []


def test_rows_that_repeat_are_read_once(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text)] * 40 + [(2, "start " + text + " end"), (3, "alone"), (3, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = df.select(F.xxhash64("doc_id", "text").alias("rid"), "text")
    assert sorted(r.text for r in _one_of_equal(keyed, keyed).collect()) == sorted({text for _, text in rows})
    assert ordered(drop_repeated_passages(df).collect()) == without_repeats(rows)


def test_repeats_of_unequal_extent_around_a_shared_line(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") + rng.choice("abcdefghij") for _ in range(n)]
    rows = []
    for line in [words(24) for _ in range(4)]:
        for _ in range(12):
            before, after = words(22), words(22)
            for wide in (22, 22, 15):  # the third shares only windows inside the run of the others
                rows.append((len(rows), " ".join([*words(20), *before[-wide:], *line, *after[:wide], *words(20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else few parts end up in one task
    try:
        assert ordered(drop_repeated_passages(df, dealt=1).collect()) == without_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- repetition rules -------------------------------------------------------------------------------


def covered(words, size):
    seen = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    hit = [False] * len(words)
    for i in range(len(words) - size + 1):
        if seen[tuple(words[i : i + size])] > 1:
            hit[i : i + size] = [True] * size
    return sum(hit)


def judged(doc, text):
    text = text or ""
    words = WORD.findall(text)
    n, lines, again = len(words), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    order = sorted(range(n), key=lambda i: words[i : i + 400])
    longest = 0
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < n and words[a + k] == words[b + k]:
            k += 1
        longest = max(longest, k)
    repeats, span = covered(words, 3), covered(words, repetition.SHORTEST)
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and 100 * span <= repetition.MAX_COVERED_PERCENT * n and longest <= repetition.MAX_LONGEST
    return doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, repeats, failed, kept, span, longest


def test_repetition_rules(spark, awkward, nothing):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\n\n"])) for i in range(60)]
    rows += [(i + 100, "\n".join(rng.choice(["a b", "", " ", "c # d", "é"]) for _ in range(12))) for i in range(40)]
    rows += [(200, " ".join(f"w{i}" for i in range(80))), (201, " ".join(f"w{i % 70}" for i in range(140)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(repetition.repetition_rules(df).collect()) == ordered(judged(*r) for r in rows)
    short = awkward.where("doc_id is null or doc_id <> 6")
    assert ordered(repetition.repetition_rules(short).collect()) == ordered(judged(*r) for r in pairs(short))
    assert repetition.repetition_rules(awkward.where("doc_id = 6")).first().n_words == 30_000
    assert repetition.repetition_rules(nothing).collect() == []


# --- personal data ----------------------------------------------------------------------------------

FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    good = (lambda m: True, lambda m: all(int(p) <= 255 for p in m.group().split(".")), lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15)
    return sorted(((m.start(), m.end(), k) for k, form in enumerate(FORMS) for m in form.finditer(text) if good[k](m)), key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_plain_patterns(small):
    rng = random.Random(5)
    for _ in range(5000):
        letters = rng.choice(["a@.-1 ", "0123.", "0 1-4", "+1 ().-", "a1@.+é-%_ ", "12.5 "])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == base(text)
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000 + "@") == []
    for _, text in pairs(small):
        assert pii.base_spans(text) == base(text)


def test_patterns_find_identifiers_of_another_form(spark, awkward, nothing):
    people = [(i, f"note {i} write to user{i}@mail.example soon") for i in range(20)] + [(100, "note write to agent-007/x soon"), (101, "we counted item-4711 there"), (102, None)]
    df = spark.createDataFrame(people, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert rows[100].spans == "other:14:25" and rows[100].n_other == 1 and rows[101].spans == "" and rows[102].spans == ""
    assert rows[0].n_email == 1 and rows[0].base_sha256 == sha("email:16:34") and rows[100].base_sha256 == sha("")
    assert {r.text for r in pii.redact_pii(df).where("doc_id in (0, 100)").collect()} == {"note 0 write to <EMAIL> soon", "note write to <OTHER> soon"}
    masked = pii.redact_pii(awkward)
    assert masked.columns == awkward.columns and masked.where("doc_id = 11").first().text == "<EMAIL> <PHONE>"
    assert pii.find_pii(nothing).collect() == [] and pii.redact_pii(nothing).collect() == []


def test_every_learned_pattern_counts(spark, awkward, small):
    people = [(10 * i + j, f"note{i} alpha write{'abc'[i]} user{i}{j}@mail.example soon") for i in range(3) for j in range(8)]
    people += [(100 + i, f"note{i} alpha write{'abc'[i]} agent-00{i}/x soon") for i in (0, 1, 2)] * 2 + [(None, None), (None, "")]
    df = spark.createDataFrame(people, "doc_id long, text string").repartition(3)
    assert pii.learned_patterns(df).count() > 1
    for sent in (1, 10_000):
        assert sum(r.n_other for r in pii.find_pii(df, sent=sent).collect()) == 6
        assert pii.redact_pii(df, sent=sent).where("text like '%<OTHER>%'").count() == 6
        assert pii.redact_pii(awkward, sent=sent).columns == awkward.columns
    assert ordered(pii.find_pii(small, sent=0).collect()) == ordered(pii.find_pii(small).collect())
    assert ordered(pii.redact_pii(small, sent=0).collect()) == ordered(pii.redact_pii(small).collect())


# --- classifiers ------------------------------------------------------------------------------------


def test_held_out_toxicity_and_quality(spark, awkward, nothing, labels):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for scored, label, folds, fold, least in ((toxicity(docs, labels), "toxic", 5, 0, 0.93), (rank_quality(docs, labels), "quality", 4, 2, 0.98)):
        rows = scored.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").collect()
        cut = 0.5 if label == "toxic" else 0.7
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.predicted == r.y for r in held) >= least * len(held)
    few = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (4, 0, 1), (8, 1, 0), (9, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, toxic int, quality int")
    for op in (toxicity, rank_quality):
        assert op(awkward, few).count() == 16 and op(nothing, few).collect() == []
        assert {r.score for r in op(awkward, few.limit(0)).collect()} == {0.0}
    assert all(r.score == 0.0 for r in toxicity(awkward, few).where("doc_id in (3, 4, 5)").collect())
    assert drop_toxic(awkward, few).columns == awkward.columns and drop_toxic(awkward, few.limit(0)).count() == 16


def test_quality_learns_from_all_labelled_rows(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(24_000):
        digits = rng.random()
        docs.append((i, " ".join(rng.choice("0123456789") if rng.random() < digits else rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(20, 60)))))
        labels.append((i, int(rng.random() > digits)))
    scored = rank_quality(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(labels, "doc_id long, quality int"), folds=50, fold=49)
    taught = scored.where(~F.col("held_out")).toPandas()
    wanted = sum(y for i, y in labels if zlib.crc32(str(i).encode()) % 50 != 49)
    # The threshold lies where the scores of all learning rows have as many rows above as have label 1.
    assert len(taught) > 20_000 and abs(int(taught.predicted.sum()) - wanted) <= 2


def test_every_row_is_in_pairs():
    y, z = np.array([1, 0, 0, 1, 0, 0, 0]), np.eye(7)
    pairs = drawn_pairs(y, z, 3)
    assert len(pairs) == 15 and (pairs.sum(axis=0)[y == 0] == -3).all() and set(pairs.sum(axis=0)[y == 1]) <= {7, 8}
    assert drawn_pairs(np.ones(3), z[:3], 3).shape == (0, 7)


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("abcdefgh") * 2 + rng.choice("abcdefgh") for _ in range(n))
    late = [words(3_500) + (" zorkly vexing" if i % 2 else "") for i in range(20)]
    docs = spark.createDataFrame([*enumerate(late), *enumerate(late[:4])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    taught = []
    monkeypatch.setattr("plumbline.llm.toxicity.train", lambda texts, y, prior: taught.append(list(zip(texts.to_pylist(), y.tolist(), strict=True))) or train(texts, y, prior))
    assert toxicity(docs, labels, folds=50, fold=49).count() == 24
    assert sorted(taught[0]) == sorted((t, i % 2) for rows in (late, late[:4]) for i, t in enumerate(rows))
    toxicity(docs, labels, folds=50, fold=49, chars=50_000)
    assert all(t in late for t, _ in taught[1]) and all(0 < sum(len(t) for t, y in taught[1] if y == k) <= 50_000 for k in (0, 1))


# --- tokens -----------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark, small, awkward, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = read_ranks(path)

    def want(rows):
        ids = [(doc, library.encode_ordinary(text or ""), text or "") for doc, text in rows]
        return ordered((doc, len(x), sha(",".join(map(str, x))), sha(text)) for doc, x, text in ids)

    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc' sS tdé\n\t\x1c\x85  ​12²中\U0001f600!.#'re\r\x00") for _ in range(rng.randrange(60)))) for i in range(800)]
    rows += [(901, "<|endoftext|>"), (902, " " * 500 + "x"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk in (1_000_000, 300):
        assert ordered(digests(encode(df, table, public_tokenizers.PATTERN, chunk=chunk), table).collect()) == want(rows)
    for other in (small, awkward):
        assert ordered(digests(encode(other, table, public_tokenizers.PATTERN), table).collect()) == want(pairs(other))
    assert encode(nothing, table, public_tokenizers.PATTERN).collect() == []
    assert decode(np.array([0, 1, 2]), np.array([0, 2, 2, 3]), pa.array(table, pa.large_binary())) == [table[0] + table[1], b"", table[2]]


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "calm water runs by the old mill every day").otherwise("you filthy rotten scum go away now please").alias("text"))
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = toxicity(docs, labels, per_class=30).collect()
    assert [r.doc_id for r in got if r.predicted != r.doc_id % 2] == []


def test_pieces_come_from_whole_texts_and_languages_are_never_dropped(spark):
    head = "0123456789 " * 200
    rows = [(i, head + ("der hund lief durch den wald und " if i % 2 else "the dog ran through a wood and ") * 300, "de" if i % 2 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tests = spark.createDataFrame([(1000, "und der hund lief", None), (1001, "and the dog ran", None)], docs.schema)
    got = {r.doc_id: r.lang_pred for r in langid.detect_language(docs.unionByName(tests)).collect()}
    assert (got[1000], got[1001]) == ("de", "en")
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.detect_language(docs, languages=1)
