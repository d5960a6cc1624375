import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sensorflow.llm import prefix_trie as trie
from sensorflow.llm.queries import QUERIES
from sensorflow.llm.radix_tree import LAYOUTS, RadixTree


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def brute(conversations):
    """conversations: list of (conv_id, turns)."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in conversations:
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
        ends[tuple(turns)].append(conv)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, known in members.items():
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += not children[path]
            saved[path[:depth]] += (len(known) - 1) * len(path[-1][1].encode()) if path else 0
    digest = lambda path: hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
    return sorted(
        (min(known), len(path), min(members[path[:-1]]) if path else -1, len(known), children[path], leaves[path], saved[path], digest(path)) for path, known in members.items()
    )


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("seed, per_part", [(1, 200_000), (2, 10), (3, 30)])
def test_equals_grouping_all_prefixes(spark, monkeypatch, seed, per_part):
    """Few turns in many orders: long shared starts, conversations that begin others, many copies, over many tasks."""
    monkeypatch.setattr(trie, "IDS_PER_BLOCK", 7)
    rng = random.Random(seed)
    conversations = []
    for conv in range(150):
        turns = [(rng.choice(["user", ""]), rng.choice(["é", "bb", "", "cccc"])) for _ in range(rng.randrange(6))]
        conversations.append((conv * 3, turns if conv % 3 else conversations[0][1] if conversations else turns))
    rows = [(conv, i, role, text) for conv, turns in conversations for i, (role, text) in enumerate(turns)]
    known = {row[0] for row in rows}
    given = [(conv, turns) for conv, turns in conversations if conv in known]
    found = trie.prefix_trie(trie.turns_of(table(spark, rows)), turns_per_part=per_part)
    assert rows_of(found) == brute(given)
    found = trie.prefix_trie(trie.with_shared_starts(trie.turns_of(table(spark, rows))), turns_per_part=per_part)
    assert rows_of(found) == brute(list(rebuilt(rows).items()))


def test_one_conversation_in_very_many_copies_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_BLOCK", 50)
    turns = [("user", "hot"), ("assistant", "copy")]
    conversations = [(i, turns) for i in range(3000)] + [(3000, turns * 2), (3001, [("user", "hot")])] + [(4000 + i, [("u", str(j)) for j in range(400 - i)]) for i in range(3)]
    rows = [(conv, i, *turn) for conv, known in conversations for i, turn in enumerate(known)]
    found = trie.prefix_trie(trie.turns_of(table(spark, rows)), turns_per_part=100).cache()
    assert found.groupBy("depth").count().filter("depth > 400").count() == 0
    assert rows_of(found) == brute(conversations)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 1, "", "x"), (2, None, "", ""), (None, 1, "a", "b"), (5, 3, "r", "t" * 2_000_000), (7, 1, "same", "same"), (7, 1, "same", "same"), (6, 0, "a", "1:b"), (8, 0, "a1", ":b")]
    clashing = table(spark, rows).selectExpr("*", "1 AS h", "2 AS turns", "3 AS path", "'x' AS part", "5 AS depth")
    found = trie.prefix_trie(trie.with_shared_starts(trie.turns_of(clashing)))
    assert rows_of(found) == brute(list(rebuilt(rows).items()))
    none = table(spark, rows).filter("conv_id > 100")
    assert trie.prefix_trie(trie.turns_of(none)).collect() == []


def test_query_matches_brute_force(spark, sf_dir, given):
    rows = given("SELECT conv_id, turn, role, text FROM conversations")
    assert rows_of(QUERIES["op12_prefix_trie"](spark, sf_dir)) == brute(list(rebuilt(rows).items()))


def test_nodes_grow_through_all_layouts():
    rng, tree, wanted = random.Random(4), RadixTree(), defaultdict(list)
    keys = [bytes([b]) * 2 for b in range(256)] + [bytes(rng.choices(b"abc", k=rng.randrange(9))) for _ in range(500)] + [b"x" * 40, b"x" * 39, b"x" * 41 + b"y"]
    rng.shuffle(keys)
    layouts = set()
    for i, key in enumerate(keys):
        tree.add(key, i)
        wanted[key].append(i)
        layouts.add(tree.root.children.layout)
    found, path = {}, bytearray()
    order = []
    for node, above, leaving in tree.walk():
        if not leaving:
            path[above:] = node.path
            below = [i for key, values in wanted.items() if key.startswith(bytes(path)) for i in values]
            assert (node.n, node.least) == (len(below), min(below))
            if node.values:
                found[bytes(path)] = node.values
                order.append(bytes(path))
    assert found == wanted and order == sorted(order)
    assert layouts == set(LAYOUTS)
