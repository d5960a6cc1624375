import hashlib
import random

import numpy as np
import pytest

from sensorflow.llm import suffix_dedup
from sensorflow.llm.queries import QUERIES
from sensorflow.llm.suffix_sort import sort_suffixes


def brute(rows, length):
    """(id, bytes) rows: id, n_bytes, n_removed, n_spans, hash of what is left."""
    first, out = {}, []
    last = 1 << 70
    for i, text in rows:
        for p in range(len(text) - length + 1):
            first[text[p : p + length]] = min(first.get(text[p : p + length], last), last if i is None else i)
    for i, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(text)) if gone[p] and (not p or not gone[p - 1]))
        out.append((str(i), len(text), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone) if not g)).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_query_matches_brute_force(spark, sf_dir, given):
    rows = [(i, (text or "").encode()) for i, text in given("SELECT doc_id, text FROM documents")]
    assert found(QUERIES["op8_suffix_dedup"](spark, sf_dir)) == brute(rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages_over_many_chunks_and_groups(spark, monkeypatch, seed):
    for name, value in (("CHUNK_BYTES", 3_000), ("GROUP_BYTES", 2_000), ("BLOCK", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    rows = [(rng.randrange(60), "".join(rng.choice([*passages, "x" * rng.randrange(80), str(rng.random())]) for _ in range(rng.randrange(6)))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(suffix_dedup.remove_repeats(docs, length=40)) == brute([(i, t.encode()) for i, t in rows], 40)


def test_odd_rows(odd, clashing, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    out = suffix_dedup.remove_repeats(clashing, with_kept=True)
    assert found(out) == brute(rows, 50)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())
    assert suffix_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd, length=20)


def test_suffixes_are_sorted_and_equal_ones_grouped():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, length = int(rng.integers(60, 400)), int(rng.integers(1, 60))
        data = rng.integers(0, int(rng.integers(1, 4)), n).astype(np.uint8) + np.uint8(250 * (trial % 2))
        if trial % 3 == 0:
            data = np.tile(data[:37], 30)[:n]
        starts = rng.permutation(n - length + 1).astype(np.int64)
        order, group = sort_suffixes(np.concatenate([data, rng.integers(0, 255, 8).astype(np.uint8)]), starts, length)
        ordered = [data[i : i + length].tobytes() for i in starts[order]]
        assert ordered == sorted(ordered)
        assert group.tolist() == np.cumsum([0] + [a != b for a, b in zip(ordered, ordered[1:])]).tolist()
