"""Prefix trie of conversations: a node for each distinct beginning, from adaptive radix trees over fixed-width turn ids.

1. A turn's id is the first WIDTH bytes of a SHA-256 of role and text; a conversation's key is its turns' ids put together.
2. Conversations are range-partitioned and sorted by key and number, so a task has all of a subtree or a border of it. Each task puts its
   keys into a radix tree; only depths that are whole turns become nodes.
3. Nodes on the path of a task's first or last key may go on in other tasks. These few are summed up; what neighbours
   both counted of the path they share is taken off.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.llm.radix_tree import RadixTree
from sensorflow.llm.staging import stored, work_folder, worker_memo

WIDTH = 16
IDS_PER_BLOCK = 100_000
TURNS_PER_PART = 200_000
BATCH = 5_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
LOCAL = (
    "part int, path binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "bytes long, on_first boolean, on_last boolean, ends_sha256 string, block int, ids binary"
)


def turn_id(role: Column, text: Column) -> Column:
    """Hex id of a turn; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turns_of(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: array of (turn, id, bytes) in the order of turn, null first; equal numbers are in the order of ids.
    Rows without a conversation are left out. A conversation is one row of some 40 bytes a turn."""
    column = lambda name: F.col(f"`{name}`")
    rows = conversations.filter(column(key).isNotNull()).select(
        column(key).cast("long").alias("conv_id"),
        F.struct(column(turn).alias("turn"), turn_id(column(role), column(text)).alias("id"), F.octet_length(F.coalesce(column(text), F.lit(""))).alias("bytes")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_starts(turns: DataFrame, group: int = 5, longest: int = 8) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % ``group``, then the own ones after the first h; h = crc32(decimal c) % (``longest`` + 1)."""
    heads = turns.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, longest).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    joined = turns.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left")
    start = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(start, rest).alias("turns"))


def _chain(key: bytes) -> list[bytes]:
    """A name for each beginning of a key, from the empty one on."""
    names = [b"\0" * WIDTH]
    for first in range(0, len(key), WIDTH):
        names.append(_next(names[-1], key[first : first + WIDTH]))
    return names


def _next(above: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(above + turn, digest_size=WIDTH).digest()


def _nodes(tree: RadixTree, sizes: dict[bytes, int], first: bytes, last: bytes, part: int):
    """Rows of LOCAL for all whole-turn depths of a task's tree, children before parents; ids of conversations that end on a border path in blocks."""
    first_path, last_path = set(_chain(first)), set(_chain(last))
    borders = first_path | last_path
    key, names, leasts = bytearray(), [], []
    sums = []  # per open tree node: uppermost turn nodes, leaves and saved bytes below
    for node, above, leaving in tree.walk():
        if not leaving:
            key[above:] = node.path
            deepest = len(key) // WIDTH
            del names[above // WIDTH + 1 :], leasts[above // WIDTH + 1 :]
            if not names:
                names.append(b"\0" * WIDTH)
                leasts.append(node.least)
            for depth in range(len(names), deepest + 1):
                names.append(_next(names[-1], bytes(key[(depth - 1) * WIDTH : depth * WIDTH])))
                leasts.append(node.least)
            sums.append([0, 0, 0])
            continue
        del key[above + len(node.path) :], names[len(key) // WIDTH + 1 :], leasts[len(key) // WIDTH + 1 :]
        tops, leaves, saved = sums.pop()
        below = len(key)
        lowest = above // WIDTH + 1 if sums else 0
        for depth in range(below // WIDTH, lowest - 1, -1):
            size = sizes[bytes(key[(depth - 1) * WIDTH : depth * WIDTH])] if depth else 0
            saved += (node.n - 1) * size
            leaves = leaves if tops else 1
            name = names[depth]
            ends = node.values if depth * WIDTH == below else []
            border = name in borders
            for block in range(0, len(ends) if border else 0, IDS_PER_BLOCK):
                ids = ",".join(map(str, ends[block : block + IDS_PER_BLOCK])).encode()
                yield (part, name, *[None] * 12, block // IDS_PER_BLOCK, ids)
            digest = None if border else hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
            above_name = names[depth - 1] if depth else None
            parent = leasts[depth - 1] if depth and above_name not in borders else None
            yield (part, name, above_name, depth, node.least, parent, node.n, tops, leaves, saved, size, name in first_path, name in last_path, digest, None, None)
            tops = 1
        if sums:
            sums[-1] = [a + b for a, b in zip(sums[-1], (tops, leaves, saved))]


def _grown(batches):
    """Sorted rows (key, sizes, conv_id) of a partition become the nodes of its tree."""
    from pyspark import TaskContext

    worker_memo().clear()
    tree, sizes, first, last = RadixTree(), {}, None, None
    for batch in batches:
        for key, lengths, known in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            first, last = key if first is None else first, key
            tree.add(key, known)
            for i, n in enumerate(lengths):
                sizes[key[i * WIDTH : (i + 1) * WIDTH]] = n
    if first is None:
        return
    rows, names = [], [field.split()[0] for field in LOCAL.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[field.split()[1]] for field in LOCAL.split(", ")]

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names)

    for row in _nodes(tree, sizes, first, last, TaskContext.get().partitionId()):
        rows.append(row)
        if len(rows) >= BATCH:
            yield packed()
            rows = []
    if rows:
        yield packed()


def _digests(batches):
    """Rows (path, ids) in order become one digest for each path; blocks pass through one at a time."""
    path, digest = None, None

    def out():
        return pa.RecordBatch.from_pydict({"e_path": pa.array([path], pa.binary()), "e_sha256": pa.array([digest.hexdigest()], pa.string())})

    for batch in batches:
        for mine, ids in zip(batch.column(0), batch.column(1)):
            mine = mine.as_py()
            if mine != path:
                if path is not None:
                    yield out()
                path, digest = mine, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py())
    if path is not None:
        yield out()


def _border_nodes(border: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes on paths of first and last keys, each put together from all tasks that have it."""
    tasks = border.filter("depth = 0").select("part").distinct()
    following = tasks.select(F.col("part").alias("t"), F.lead("part").over(Window.orderBy("part")).alias("t_next"))
    left = border.filter("on_last").join(following, F.col("part") == F.col("t")).select("t", "t_next", "path", "depth", "bytes", "n_children")
    right = border.filter("on_first").select(F.col("part").alias("r_part"), F.col("path").alias("r_path"))
    shared = left.join(right, (F.col("t_next") == F.col("r_part")) & (F.col("path") == F.col("r_path")))
    both = Window.partitionBy("t")
    upwards = both.orderBy(F.desc("depth"))
    # Of a path that two neighbours share, saved bytes miss one, children and a leaf at its end were counted by both.
    none = F.lit(None).cast("long")
    twice = shared.select(
        "path",
        none.alias("conv_id"),
        F.lit(0).cast("long").alias("n_convs"),
        F.when(F.row_number().over(upwards) > 1, -1).otherwise(0).cast("long").alias("n_children"),
        (-F.max((F.col("n_children") == 0).cast("long")).over(both)).alias("n_leaves"),
        F.sum("bytes").over(upwards).alias("saved_tokens"),
        F.lit(None).cast("binary").alias("parent"),
        "depth",
    )
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    rows = border.select("path", "conv_id", *sums, "parent", "depth").unionByName(twice)
    whole = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), *[F.sum(name).alias(name) for name in sums])
    ordered = blocks.select("path", "part", "block", "ids").repartition("path").sortWithinPartitions("path", "part", "block")
    ends = ordered.select("path", "ids").mapInArrow(_digests, "e_path binary, e_sha256 string")
    ended = whole.join(ends, F.col("path") == F.col("e_path"), "left").withColumn("ends_sha256", F.coalesce("e_sha256", F.lit(NO_ENDS)))
    return ended.drop("e_path", "e_sha256")


def prefix_trie(turns: DataFrame, folder: str | None = None, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per node: a distinct sequence of the first ``depth`` turns of conversations, from the root with depth 0.

    ``turns`` has conv_id and turns: array of (id, bytes, ...), as from ``turns_of``. Members of a node are the conversations that start with it, all
    those without turns are only the root's. conv_id: smallest member; parent_conv_id: the parent's (root: null); n_convs: members; n_children; n_leaves: childless
    nodes in its subtree, itself included; saved_tokens: summed over its subtree, (n_convs - 1) times the bytes of the node's last text; ends_sha256: SHA-256 of
    the ascending decimal conv_ids of members without more turns, comma-joined.

    A table without conversations has no node. A number that occurs twice counts twice. Turns are told apart by 128 bits of SHA-256.
    Copies of one conversation are spread over tasks; the digest of their numbers is computed from blocks, in one pass over them.
    """
    spark, folder = turns.sparkSession, folder or work_folder(turns.sparkSession, "trie")
    keys = turns.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["bytes"].cast("long")).alias("sizes"), "conv_id")
    keys = stored(keys, f"{folder}/keys")
    total = keys.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // turns_per_part))
    ranged = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    local = stored(ranged.mapInArrow(_grown, LOCAL), f"{folder}/local")
    nodes = local.filter("block IS NULL")
    on_border = F.col("on_first") | F.col("on_last")
    border, inner = nodes.filter(on_border), nodes.filter(~on_border)
    whole = stored(_border_nodes(border, local.filter("block IS NOT NULL")), f"{folder}/border")
    parents = whole.select(F.col("path").alias("p_path"), F.col("conv_id").alias("p_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = whole.join(parents, F.col("parent") == F.col("p_path"), "left").withColumnRenamed("p_conv_id", "parent_conv_id")
    # Children of border nodes find their parent by their own task's copy of it, so no parent is the key of more rows than a task has.
    copies = border.select(F.col("part").alias("c_part"), F.col("path").alias("c_path")).join(parents, F.col("c_path") == F.col("p_path"))
    below = inner.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(copies, (F.col("part") == F.col("c_part")) & (F.col("parent") == F.col("c_path")))
    below = below.withColumnRenamed("p_conv_id", "parent_conv_id")
    out = inner.filter("parent_conv_id IS NOT NULL").select(*columns).unionByName(below.select(*columns)).unionByName(above.select(*columns))
    return out.withColumn("depth", F.col("depth").cast("long"))
