import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorflow.llm import quality
from sensorflow.llm.queries import QUERIES, trusted_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rules(text):
    text = text or ""
    words, covered, places = WORD.findall(text), set(), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    for starts in places.values():
        if len(starts) > 1:
            covered.update(i + k for i in starts for k in range(3))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered))


def grams(text):
    tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")
    return [(t,) for t in tokens] + list(zip(tokens, tokens[1:] + ["\n"]))


def test_query_matches_brute_force(spark, sf_dir, given):
    """Rules, and the ratio from counts of grams whose buckets Spark's hash gives."""
    found = {r.doc_id: r for r in QUERIES["op4_quality_ratio"](spark, sf_dir).collect()}
    texts = dict(given("SELECT doc_id, text FROM documents"))
    trusted = {i for (i,) in given("SELECT doc_id FROM labels WHERE quality = 1")}
    own = {i: grams(text) for i, text in texts.items()}
    different = sorted({g for found in own.values() for g in found})
    singles = spark.createDataFrame([(g[0], g[-1] if len(g) > 1 else None) for g in different], "a string, b string")
    hashed = singles.select("a", "b", F.pmod(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(quality.BUCKETS)).alias("h"))
    bucket = {(r.a,) if r.b is None else (r.a, r.b): r.h for r in hashed.collect()}
    raw, target = np.zeros(quality.BUCKETS, int), np.zeros(quality.BUCKETS, int)
    for i, all_grams in own.items():
        for g in all_grams:
            raw[bucket[g]] += 1
            target[bucket[g]] += i in trusted
    base = math.log((raw.sum() + quality.BUCKETS) / (target.sum() + quality.BUCKETS))
    weights = [round(quality.SCALE * (math.log((t + 1) / (r + 1)) + base)) for t, r in zip(target, raw)]
    for i, text in texts.items():
        r, wanted = found[i], rules(text)
        assert tuple(r[name] for name in RULES) == wanted
        failed = wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0]
        llr = sum(weights[bucket[g]] for g in own[i])
        assert (r.n_grams, r.llr, r.base_failed) == (len(own[i]), llr, failed)
        assert r.kept == (not failed and llr >= round(quality.THRESHOLD * quality.SCALE) * len(own[i]))


def test_good_documents_stay_and_junk_goes(spark, sf_dir, given):
    kept = {r.doc_id for r in QUERIES["op4_quality_ratio"](spark, sf_dir).filter("kept").collect()}
    good = {i for (i,) in given("SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND len(regexp_split_to_array(trim(text), '\\s+')) >= 60")}
    bad = {i for (i,) in given("SELECT doc_id FROM labels WHERE quality = 0")}
    assert len(good & kept) >= 0.98 * len(good)
    assert len(bad & kept) <= 0.4 * len(bad)


def test_odd_rows(odd, clashing, none, spark):
    rows = [r.text for r in odd.collect()]
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    weights = quality.fit(clashing, ids, buckets=64)
    found = quality.judged(clashing, weights).collect()
    assert sorted(tuple(r[name] for name in RULES) for r in found) == sorted(map(rules, rows))
    assert {r.cluster for r in found} == {"own cluster"}
    assert all(not r.kept for r in found if not r.text)
    kept = quality.keep(clashing, ids)
    assert kept.columns == clashing.columns and {r.n_words for r in kept.collect()} <= {"own n_words"}
    assert quality.keep(none, ids).count() == 0
    assert quality.fit(odd, ids.limit(0), buckets=8) == [0] * 8


@pytest.mark.parametrize("text", ["a b a b a", "a b c x a b c", "a b c b c a b c", "a a a", "a a a a", "a b c d e f"])
def test_repeated_words_of_overlapping_windows(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(quality.repeated_words(quality.words(F.col("text")))).first()[0] == rules(text)[4]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op4_quality_ratio"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert trusted_ids(spark, sf_dir).columns == ["doc_id"]
