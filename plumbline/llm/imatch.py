"""I-Match fingerprints: distinct terms of a middle band of document frequency, hashed per randomised part of the lexicon.

Everything is DataFrame expressions. Document frequencies are counted over all texts by term hash. The lexicon is the terms
that at least LEAST and at most MOST of the rows hold, so it cannot have more than (mean distinct terms per text) / LEAST
entries, however many rows there are; it is sent to every executor, terms meet it where their text is, and one row per text is
shuffled. A text's terms in a part of the lexicon are distinct, and their hashes are combined by exclusive or, which gives the
same value for a set in any order, as sorting it first would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import join_small, stored

PARTS = 64
LEAST = 0.002
MOST = 0.02
ROWS_PER_RANGE = 2_000


def fingerprints(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = PARTS, least: float = LEAST, most: float = MOST, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Fingerprint of every row's text and of its edited text, and how alike they are.

    The edited text is the row's text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next row's, in descending doc_id, then by text hash, null ids last; the first row follows the last, and a single row
    follows itself. A fingerprint is `parts` numbers of 8 hex digits, zeros where a text has no term of that part. Likeness is
    the share of parts with equal numbers among those where either text has a term, and 1 where neither has any. Null texts are
    empty; empty texts and texts without a term of the lexicon have zeros only. Equal texts have equal fingerprints.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)
    lexicon = _lexicon(rows, n, least, most, parts)
    edited = _with_next(rows, n, rows_per_range)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = edited.select(
        "uid", "next_uid", "doc_id", size.cast("long").alias("n_chars"), "text",
        F.concat(F.substr("text", F.lit(1), size - half), F.substr("next_text", F.lit(1), half)).alias("edited"),
    )
    both = edited.select(
        "uid", "next_uid", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), _terms("text").alias("terms")), F.struct(F.lit(1).alias("which"), _terms("edited").alias("terms")))).alias("x"),
    )
    terms = both.select("uid", "next_uid", "doc_id", "n_chars", "sha", "x.which", F.explode_outer("x.terms").alias("term")).withColumn("t", F.xxhash64("term"))
    known = terms.join(F.broadcast(lexicon), "t", "left")
    value = F.xxhash64("t", F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))
    print_ = [F.coalesce(F.bit_xor(F.when(F.col("part") == k, value)), F.lit(0)).alias(f"p{k}") for k in range(parts)]
    found = known.groupBy("uid", "which").agg(F.first("next_uid").alias("next_uid"), F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("sha").alias("sha"), *print_)
    found = stored(found.select("uid", "which", "next_uid", "doc_id", "n_chars", "sha", F.array(*[F.col(f"p{k}") for k in range(parts)]).alias("print")))
    own = found.where("which = 0").drop("which")
    other = found.where("which = 1").select("uid", F.col("print").alias("edited_print"))
    after = own.select(F.col("uid").alias("next_uid"), F.col("print").alias("next_print"))
    out = own.join(other, "uid").join(after, "next_uid")
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), _digits("print").alias("fingerprint"), _digits("edited_print").alias("edited_fingerprint"),
        _likeness("print", "edited_print").alias("near_edited"), _likeness("print", "next_print").alias("near_next"),
    )


def _terms(text: str) -> Column:
    return F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))


def _digits(name: str) -> Column:
    return F.array_join(F.transform(F.col(name), lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def _likeness(a: str, b: str) -> Column:
    pairs = F.zip_with(F.col(a), F.col(b), lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise(F.when(x == y, 1.0).otherwise(0.0)))
    used = F.filter(pairs, lambda v: v.isNotNull())
    total = F.aggregate(used, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(used) == 0, 1.0).otherwise(total / F.size(used))


def _lexicon(rows: DataFrame, n: int, least: float, most: float, parts: int) -> DataFrame:
    """(t, part) of the terms in the band: the hash of each and its part of the lexicon."""
    terms = rows.select(F.explode(_terms("text")).alias("term")).where("term <> ''").select(F.xxhash64("term").alias("t"))
    counts = terms.groupBy("t").agg(F.count("*").alias("df"))
    band = counts.where((F.col("df") >= max(2, int(least * n))) & (F.col("df") <= max(2, int(most * n))))
    return stored(band.select("t", F.pmod(F.xxhash64("t", F.lit(2)), F.lit(parts)).cast("int").alias("part")))


def _with_next(rows: DataFrame, n: int, rows_per_range: int) -> DataFrame:
    """Rows with uid, the next row's uid and its text. Ranges of ids are sorted apart, so no task sees all rows; the first row of
    each range goes along with the range before it."""
    ids = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    low, high = (ids[0], ids[1]) if ids[2] else (0, 0)
    ranges = max(1, -(-n // rows_per_range))
    key = F.xxhash64("text")
    by_id = F.least(F.floor((F.lit(high).cast("double") - F.col("doc_id")) / (float(high) - float(low) + 1) * ranges), F.lit(ranges - 1))
    by_key = ranges + F.least(F.floor((key.cast("double") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1))
    rows = rows.withColumn("key", key).withColumn("range", F.coalesce(by_id, by_key).cast("long")).withColumn("down", -F.col("doc_id"))
    heads = rows.groupBy("range").agg(F.min(F.struct(F.coalesce("down", F.lit(0)).alias("down"), "key")).alias("head"))
    # One row a range: the ranges that have rows, in order, each with the one before it, the first after the last.
    order = Window.orderBy("range")
    heads = heads.withColumn("before", F.lag("range").over(order)).withColumn("last", F.max("range").over(Window.partitionBy()))
    heads = stored(heads.select("range", "head.down", "head.key", F.coalesce("before", "last").alias("before")))
    guests = join_small(rows.withColumn("down", F.coalesce("down", F.lit(0))), heads, ["range", "down", "key"], "inner", 2 * ranges).dropDuplicates(["range"])
    guests = guests.select("doc_id", "text", "key", F.col("before").alias("range"), "down", (F.col("range") * F.lit(1 << 32) + 1).alias("given"))
    all_rows = rows.withColumn("given", F.lit(None).cast("long")).unionByName(guests)
    w = Window.partitionBy("range").orderBy(F.col("given").isNotNull(), "down", "key")
    own = F.col("range") * F.lit(1 << 32)
    placed = all_rows.select(
        "doc_id", "text", "given", (own + F.row_number().over(w)).alias("uid"), F.lead("text").over(w).alias("next_text"),
        F.coalesce(F.lead("given").over(w), own + F.row_number().over(w) + 1).alias("next_uid"),
    )
    return placed.where("given is null").drop("given")
