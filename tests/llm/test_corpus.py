"""Fingerprints, the mix, the pipeline, and that the folder can be removed."""

import hashlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from rows import ordered, pairs

import corpus_pipeline
from plumbline.llm.imatch import fingerprints
from plumbline.llm.mixing import mix_sources, quotas
from plumbline.llm.sql import ORACLE

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_edited_texts_and_fingerprints(small, awkward, nothing):
    rows = sorted(pairs(small), reverse=True)
    got = {r.doc_id: r for r in fingerprints(small, rows_per_range=30).collect()}
    by_text = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, got[doc].fingerprint) == got[doc].fingerprint
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())
    odd = fingerprints(awkward).collect()
    assert len(odd) == 16 and {r.n_chars for r in odd if r.doc_id in (3, 4)} == {0}
    assert fingerprints(nothing).collect() == []
    alone = fingerprints(small.limit(1)).first()
    assert alone.near_next == 1.0


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 30), ("b", "x", "4", 1000)], "domain string, language string, origin string, cap long")
    got = {r.origin: r.quota for r in quotas(leaves, {}, 240.0).collect()}
    # a and b get 120 each; x and y of a 60 each, y can give 30 only, so x gets 90, of which leaf 1 can give 10.
    assert got == pytest.approx({"1": 10, "2": 80, "3": 30, "4": 120})
    got = {r.origin: r.quota for r in quotas(leaves, {"domain": {"a": 3.0}}, 240.0).collect()}
    assert got == pytest.approx({"1": 10, "2": 100, "3": 30, "4": 100})


def test_mix_equals_sql(spark, small, awkward, nothing):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = mix_sources(small).select("doc_id", "mix.domain", "mix.language", "mix.origin", "mix.epoch", "mix.n_tokens")
    assert ordered(got.collect()) == ordered(duckdb.sql(ORACLE["op6_mix_sources"]).fetchall())
    odd = mix_sources(awkward, fraction=2.0)
    assert odd.columns == [*[c for c in awkward.columns if c != "mix"], "mix"] and odd.select("mix.origin").distinct().collect()[0][0] == "unknown"
    assert mix_sources(awkward, into=None).columns == awkward.columns and mix_sources(nothing).collect() == []


def test_pipeline_stages(spark, small, awkward, nothing):
    docs = small
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "byte_bpe":
            assert after.columns == small.columns
        if name in ("toxicity", "near_duplicates"):
            assert after.join(docs, small.columns, "left_anti").isEmpty() and after.count() < docs.count()
        docs = spark.createDataFrame(after.toArrow())
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.where(F.size("ids") != F.col("n_tokens")).isEmpty()
    assert ordered(corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens").collect()) == ordered(docs.select("doc_id", "n_tokens").collect())


def test_the_rest_imports_without_the_folder(tmp_path):
    for name in ("plumbline", "entry_queries", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
