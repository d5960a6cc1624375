import random
import re

import numpy as np
import pytest

from sensorflow.llm import near_dedup
from sensorflow.llm.components import components
from sensorflow.llm.queries import QUERIES
from sensorflow.llm.shingles import Shingler

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """id: (size, component) by comparing all pairs."""
    sets = {i: shingle_set(text, width) for i, text in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if root(a) != root(b) and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(df, rows, width, percent):
    wanted, found = brute(rows, width, percent), df.collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*wanted[r.doc_id], r.doc_id == wanted[r.doc_id][1])


def test_query_matches_brute_force(spark, sf_dir, given):
    check(QUERIES["op3_minhash_near_dedup"](spark, sf_dir), given("SELECT doc_id, text FROM documents"), 3, 85)


def test_chained_near_copies_over_several_blocks(spark, monkeypatch):
    """One group of copies with few or many changes, cut into several blocks: many pairs are below the limit."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXT", 20_000)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(near_dedup.near_duplicates(docs), rows, 5, 80)


def test_odd_rows(odd, clashing, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check(near_dedup.near_duplicates(clashing), rows, 5, 80)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "9", "None", *(["11"] if brute(rows, 5, 80)[11][1] == 11 else [])])


def test_keep_one_compares_every_row(spark):
    """Equal and null ids: one row of each group stays, the smallest id if one is there; one id with two texts keeps both."""
    first, second, third = (" ".join(f"{name}{i}" for i in range(40)) for name in "abc")
    rows = [(1, first), (1, first), (None, first), (None, second), (None, second), (5, third), (5, first), (5, second), (None, None), (None, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = near_dedup.keep_one(docs).collect()
    wanted = [(1, first), (5, second), (5, third), (None, None), (None, None), (6, ""), (6, "")]
    assert sorted(map(str, [tuple(r) for r in kept])) == sorted(map(str, wanted))


@pytest.mark.parametrize("width", [1, 3])
def test_shingles_of_blocks_equal_those_of_single_texts(width, monkeypatch):
    rng = random.Random(width)
    texts = ["".join(rng.choice("aAbB \n\té") for _ in range(rng.randrange(60))).encode() for _ in range(400)]
    many = list(Shingler(width).sets(texts))
    known = {}
    for text, found in zip(texts, many, strict=True):
        assert (found == next(iter(Shingler(width).sets([text])))).all()
        wanted = shingle_set(text.decode(), width)
        assert len(wanted) == len(found)
        for hashed in [(frozenset(wanted), found.tobytes())]:
            assert known.setdefault(hashed[0], hashed[1]) == hashed[1]
    assert len(set(known.values())) == len(known)


def test_components_of_long_chains_and_stars(spark, tmp_path):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(5, 5), (None, 4), (7, None)]
    links += [tuple(map(int, rng.integers(1000, 1200, 2))) for _ in range(120)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), f"file://{tmp_path}/c").collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert found == {i: root(i) for i in parent}


def test_bands_meet_the_stated_miss():
    for percent in (80, 85, 95):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MISS
