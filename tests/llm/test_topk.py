import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorflow.llm import topk


def brute(rows, k, is_query):
    usable = [(i, [max(-(2**63), min(topk.LONG, math.floor(64 * float(np.float32(x))))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(usable):
        if is_query(i):
            held = lambda s: max(-topk.LONG, min(topk.LONG, s))
            scored = sorted((-held(sum(a * b for a, b in zip(v, w))), j) for m, (j, w) in enumerate(usable) if m != n)
            out += [(i, rank, j, -s, abs(s) == topk.LONG) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k, is_query, schema="vec_id long, embedding array<float>, label int"):
    df = spark.createDataFrame([(*row, 1) for row in rows], schema).repartition(3)
    return sorted(map(tuple, topk.top_k(df, is_query, k).collect()))


@pytest.mark.parametrize("bins,block", [(4096, 8192), (7, 50)])
def test_blocks_and_refinement(spark, monkeypatch, bins, block):
    """Ties, a very common vector, and few bins and small blocks, so that several rounds and tasks are needed."""
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 8) / 64).tolist() if i % 3 else [0.125] * 8) for i in range(260)]
    assert run(spark, rows, 20, F.col("vec_id") % 10 == 0) == brute(rows, 20, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf")]), (5, []), (6, [1.0]), (7, [-0.01, 0.01, 9.0]), (None, [1.0, 1.0]), (8, [0.5, 0.25]), (8, [0.5, 0.25])]
    assert run(spark, rows, 3, F.col("vec_id") % 8 == 0) == brute(rows, 3, lambda i: i % 8 == 0)
    assert run(spark, rows, 50, F.col("vec_id") == 0) == brute(rows, 50, lambda i: i == 0)
    assert run(spark, [], 3, F.lit(True)) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**24 + i), float(2**23 - 3 * i)]) for i in range(8)]
    assert run(spark, rows, 4, F.col("vec_id") == 0) == brute(rows, 4, lambda i: i == 0)


@pytest.mark.parametrize("first", [2.0**24, 2.0**25, 2.0**25 * 1.4, 2.0**27, 1e30])
def test_scores_around_the_limits_of_a_long(spark, first):
    """Squared norms below and above 2^62 and beyond a long, scores of both signs."""
    rows = [(i, [first, (i - 4) * first / 32]) for i in range(8)] + [(i, [-first, (i - 4) * first / 16]) for i in range(8, 12)]
    assert run(spark, rows, 4, F.col("vec_id") % 3 == 0) == brute(rows, 4, lambda i: i % 3 == 0)
