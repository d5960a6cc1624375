"""The pipeline's stages on a small table, each held against brute force on its own input."""

import re

import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute as near_groups
from test_quality import rules
from test_secret_scan import base

import corpus_pipeline
from sensorflow.llm import mixing, quality, secret_scan
from sensorflow.llm.queries import trusted_ids
from sensorflow.llm.staging import source, stored, work_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Documents, then the result of each stage."""
    found, folder = [source(spark, sf_dir, "documents")], work_folder(spark, "steps")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found.append(stored(stage(spark, found[-1], sf_dir), f"{folder}/{number}"))
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "mixing", "packing"]
    assert all(df.columns == COLUMNS for df in steps[:-1])
    assert all(df.count() for df in steps)


def test_quality_stage(spark, sf_dir, steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert all(before[i] == r for i, r in after.items())
    weights = quality.fit(steps[0], trusted_ids(spark, sf_dir))
    llr = {r.doc_id: r for r in quality.judged(steps[0], weights).collect()}
    for i, r in before.items():
        words, _, _, _, repeated = rules(r.text)
        passed = llr[i].llr >= round(quality.THRESHOLD * quality.SCALE) * llr[i].n_grams
        assert (i in after) == (words >= 50 and 2 * repeated <= words and passed)


def test_near_duplicate_stage(steps):
    before, after = rows(steps[1]), rows(steps[2])
    groups = near_groups([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (_, group) in groups.items() if i == group}
    assert all(before[i] == r for i, r in after.items())


def test_secret_stage(steps):
    before, after = rows(steps[2]), rows(steps[3])
    assert set(before) == set(after)
    for i, r in after.items():
        assert base(r.text) == ""
        assert r.n_chars == len(r.text)
        if r.text != before[i].text:
            kept = [re.escape(part) for part in r.text.split(secret_scan.REPLACEMENT)]
            assert re.fullmatch("(?s).+".join(kept), before[i].text)


def test_mixing_stage(steps):
    planned = {r.doc_id: r.epochs for r in mixing.plan(steps[3]).collect()}
    copies = {r.doc_id: r.n for r in steps[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {i: n for i, n in planned.items() if n}
    before = rows(steps[3])
    assert all(before[r.doc_id] == r for r in steps[4].collect())


def test_packing_stage(steps):
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in steps[4].select("doc_id").collect()}
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_take_odd_rows(spark, sf_dir, odd, none):
    for docs in (odd, none):
        docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("kept"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
            stage(spark, docs, sf_dir).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
