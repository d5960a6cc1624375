import random
import re
from collections import Counter

import numpy as np
import pytest

from sensorflow.llm import phrases
from sensorflow.llm.hat_trie import Container, HatTrie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, percent=50, first=2000):
    counts, spoken = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            spoken[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        outer = [b for (other, longer), b in candidates.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * b >= percent * a for b in outer):
            continue
        cuts = [(10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, left, right, spoken[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1)
    }


def rows_of(df):
    found = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "a", "b", "x-y", "日本", " ", "of"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "", "a\tb\n"])) for _ in range(n)]


@pytest.mark.parametrize("entries, most_ids, per_part", [(1 << 21, None, 1 << 20), (40, None, 2000), (1 << 21, 12, 2000)])
def test_equals_counting_everything(spark, monkeypatch, entries, most_ids, per_part):
    """Also with tries that spill and vocabularies that are renewed in mid-text."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 64)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 100 if most_ids else 1 << 20)
    counted = phrases._counted
    monkeypatch.setattr(phrases, "_counted", lambda longest, parts, entries: counted(longest, parts, entries, 64 + 50 + 20 if most_ids else None))
    rows = random_rows(entries)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    wanted = brute(rows)
    assert len(wanted) > 50
    assert rows_of(phrases.collocations(docs, entries=entries, text_per_part=per_part)) == wanted


def test_heavy_and_light_parts_and_salted_ranks(spark, monkeypatch):
    rows = random_rows(3, 150)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "HEAVY_SHARE", 8)
    assert rows_of(phrases.collocations(docs, first=7)) == brute(rows, first=7)


def test_odd_rows(spark, odd, clashing, none):
    rows = [(r.text, r.source) for r in odd.collect()]
    wanted = brute(rows, least=2)
    assert rows_of(phrases.collocations(clashing.withColumn("phrase", clashing.text), least=2, lang="source")) == wanted
    assert phrases.collocations(none, lang="source").collect() == []
    hot = spark.createDataFrame([("one pair " * 5000 + "x" * 3_000_000, "en"), (None, None)], "text string, lang string")
    assert rows_of(phrases.collocations(hot)) == brute([(r.text, r.lang) for r in hot.collect()])


def test_trie_counts_like_a_counter_and_bursts():
    rng = np.random.default_rng(1)
    trie, wanted = HatTrie(3, burst=50), Counter()
    for _ in range(30):
        ids = rng.zipf(1.4, 400) % 300
        trie.add(np.append(ids, [0, 0]).astype(np.int64))
        padded = [*ids.tolist(), 0, 0]
        for i in range(400):
            for size in (1, 2, 3):
                if all(padded[i : i + size]):
                    wanted[tuple(padded[i : i + size] + [0] * (3 - size))] += 1
    assert len(trie.containers) > 20 and max(c.used for c in trie.containers) <= 50
    assert (np.diff(trie.lows) > 0).all()
    half = trie.spill(len(trie) // 2)
    rest = trie.spill(0)
    found = Counter()
    for keys, counts in (half, rest):
        assert len(np.unique(keys)) == len(keys)
        for key, n in zip(zip(*[c.tolist() for c in trie.columns(keys)]), counts.tolist()):
            found[key] += n
    assert found == wanted and len(trie) == 0


def test_container_grows():
    table = Container(4)
    keys = np.arange(1, 5000, dtype=np.int64) << 21
    for _ in range(3):
        table.add(keys, np.ones(len(keys), np.int64))
    found, counts = table.in_order()
    assert (found == keys).all() and (counts == 3).all()
