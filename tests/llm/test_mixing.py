import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sensorflow.llm import mixing
from sensorflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Share by weight, stop at three times the size, share the excess anew, by plain repetition."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= full
    return out


def check(rows, wanted_sizes):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    sizes = {s: sum(r.size for r in found) for s, found in by_source.items()}
    wanted = targets(sizes)
    for s, found in by_source.items():
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(wanted[s], rel=1e-9, abs=1e-9) for r in found)
        assert all(0 <= r.taken <= 3 * r.size for r in found)
        assert abs(sum(r.taken for r in found) - wanted[s]) <= max([r.size for r in found]) / 2 + 1e-6
    assert sorted((str(r.doc_id), r.size) for r in rows) == wanted_sizes


def test_query_meets_targets(spark, sf_dir, given):
    sources = dict(given("SELECT doc_id, source FROM documents"))
    rows = spark.createDataFrame([(i, s) for i, s in sources.items()], "doc_id long, source string").join(QUERIES["op7_curriculum_mix"](spark, sf_dir), "doc_id").collect()
    check(rows, sorted((str(i), len(WORD.findall(t or ""))) for i, t in given("SELECT doc_id, text FROM documents")))


def test_many_buckets_small_and_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(900)] + [(1000, "a b", "tiny"), (1001, "a", None), (1002, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    first = mixing.plan(docs).collect()
    check(first, sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows))
    again = mixing.plan(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.taken) for r in first) == Counter((r.doc_id, r.taken) for r in again)


def test_positions_follow_the_schedule(spark):
    """Up to each time a source has given about the integral of its schedule."""
    rows = [(i, "w " * 5, f"s{i % 3}") for i in range(900)]
    placed = mixing.positions(mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    slope = {0: -0.8, 1: 0.0, 2: 0.8}
    for t in (0.1, 0.35, 0.5, 0.9):
        for rank, a in slope.items():
            mine = [r for r in placed if r["rank"] == rank]
            given = sum(r.size for r in mine if r.position <= t)
            assert given == pytest.approx(mine[0].target * (t + a * (t * t - t)), abs=10)


def test_odd_rows(odd, clashing, none):
    rows = mixing.plan(clashing).collect()
    check(rows, sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in odd.collect()))
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    wanted = Counter()
    for r in mixing.plan(odd.withColumn("n", F.length("text"))).collect():
        wanted[r.doc_id] += r.epochs
    assert Counter(r.doc_id for r in mixed.collect()) == +wanted
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def brute_positions(rows):
    """(id, text, source) rows: for each id the times of its copies, by bisection of its source's demand."""
    sizes, out = defaultdict(int), defaultdict(list)
    known = [(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    for _, _, n, s in known:
        sizes[s] += n
    wanted = targets(sizes)
    for rank, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        slope, target, at = (-0.8, 0.0, 0.8)[rank % 3], wanted[s], 0
        whole = int(target // sizes[s]) if sizes[s] else 0
        for _, i, n, _ in sorted(row for row in known if row[3] == s):
            for epoch in range(whole + (at + n / 2 < target - whole * sizes[s])):
                asked, low, high = min(1, (epoch * sizes[s] + at + n / 2) / target), 0.0, 1.0
                for _ in range(60):
                    t = (low + high) / 2
                    low, high = (t, high) if t + slope * (t * t - t) < asked else (low, t)
                out[i].append(low)
            at += n
    return out


def test_query_places_copies_in_training_order(spark, sf_dir, given):
    wanted = brute_positions(given("SELECT doc_id, text, source FROM documents"))
    order = sorted(t for times in wanted.values() for t in times)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, ("false", "5")):
            spark.conf.set(name, value)
        rows = QUERIES["op7_curriculum_mix"](spark, sf_dir).collect()
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert max(r.last_place for r in rows if r.taken) == len(order) - 1
    firsts = [r.first_place for r in rows if r.first_place is not None]
    assert len(set(firsts)) == len(firsts) == sum(map(bool, wanted.values()))
    for r in rows:
        times = wanted[r.doc_id]
        assert r.taken == len(times) * r.size
        assert (r.first_place is None) == (not times)
        if times:
            assert order[r.first_place] == pytest.approx(min(times), abs=1e-9)
            assert order[r.last_place] == pytest.approx(max(times), abs=1e-9)


def test_mixed_rows_differ_in_which_column_is_null(spark):
    rows = [(1, "a a", None), (1, None, "a a"), (2, "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.taken_in_order(docs).collect()
    assert Counter((r.size, r.source, r.taken) for r in planned) == Counter((r.size, r.source, r.taken) for r in mixing.plan(docs).collect())
