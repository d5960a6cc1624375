"""Near-duplicate groups by MinHash: banding, signature verification, confirmation on full sets, connected components.

1. Every text gets its set's hash and, from many universal hash minima, one key per band.
2. Texts with equal sets form a class; only its smallest id goes on.
3. Ids that share a band key are linked to the smallest of them: the components of these links are clusters
   of candidates, which hold every pair that shares a band.
4. A cluster is cut into blocks by hash of the id; each pair of blocks is one group of a task. Pairs not
   yet connected there are compared by signature, then by full sets; only links that connect something leave the task.
5. The components of those links, with all members of the classes, are the groups.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.components import components
from sensorflow.llm.shingles import Shingler
from sensorflow.llm.staging import stored, work_folder, worker_memo

ROWS = 5
MISS = 1e-6
BLOCK_TEXT = 2 << 20
SIGMAS = 5


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which a pair of just ``percent`` similarity shares no band with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class MinHash:
    """Minima of ``n`` universal hash functions (a x + b) mod 2^64, high half, with fixed odd a and fixed b."""

    def __init__(self, n: int):
        draws = np.random.default_rng(20_011).integers(0, 1 << 64, (2, n), dtype=np.uint64)
        self.a, self.b = draws[0] | np.uint64(1), draws[1]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        lowest = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for first in range(0, len(shingles), 256):
            block = self.a[:, None] * shingles[None, first : first + 256]
            block += self.b[:, None]
            np.minimum(lowest, block.min(axis=1), out=lowest)
        return (lowest >> np.uint64(32)).astype(np.uint32)


def _text_bytes(column) -> list[bytes]:
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


def _describe(width: int, bands: int, rows: int):
    def describe(batches):
        worker_memo().clear()
        shingler, minhash = Shingler(width), MinHash(bands * rows)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for shingles in shingler.sets(_text_bytes(batch.column(1))):
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                parts = minhash.signature(shingles).reshape(bands, rows)
                keys.append([int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8, salt=b"%d" % i).digest(), "little", signed=True) for i, part in enumerate(parts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "digest", "bands"],
            )

    return describe


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                return parent
            parent[:] = up


def linked_pairs(ids: np.ndarray, side: np.ndarray, texts: list[bytes], width: int, percent: int, minhash: MinHash, shingler: Shingler):
    """Links that connect the texts of one block (side all 0) or of two blocks (0 and 1): a spanning forest of all links of at
    least ``percent`` similarity within and between them."""
    sets = list(shingler.sets(texts))
    sizes = np.array([len(s) for s in sets])
    signatures = np.stack([minhash.signature(s) for s in sets])
    n = signatures.shape[1]
    share = percent / 100
    least = share - SIGMAS * math.sqrt(share * (1 - share) / n)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(len(vocabulary), bool)
    forest, links = Forest(len(ids)), []
    two = bool(side.any())
    for a in range(len(ids)):
        roots = forest.roots()
        others = (roots != roots[a]) & (np.arange(len(ids)) > a)
        if two:
            others &= side != side[a]
        others &= (100 * np.minimum(sizes, sizes[a])) >= percent * np.maximum(sizes, sizes[a])
        others = np.flatnonzero(others)
        if len(others):
            others = others[(signatures[others] == signatures[a]).mean(axis=1) >= least]
        if not len(others):
            continue
        mine = places[starts[a] : starts[a + 1]]
        marks[mine] = True
        for b in others.tolist():
            if forest.root(a) == forest.root(b):
                continue
            common = int(marks[places[starts[b] : starts[b + 1]]].sum())
            if 100 * common >= percent * (sizes[a] + sizes[b] - common):
                forest.parent[forest.root(b)] = forest.root(a)
                links.append((ids[a], ids[b]))
        marks[mine] = False
    return links


def _compare(width: int, percent: int, n_hashes: int):
    """Groups of rows (cluster, left, right, id, side, text) in order become links; rows of a group follow each other."""

    def compare(batches):
        worker_memo().clear()
        shingler, minhash, group, rows = Shingler(width), MinHash(n_hashes), None, []

        def finish():
            ids, side = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            return linked_pairs(ids, side, [r[2] for r in rows], width, percent, minhash, shingler)

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"])

        for batch in batches:
            links = []
            columns = [batch.column(i).to_pylist() for i in range(5)] + [_text_bytes(batch.column(5))]
            for cluster, left, right, known, side, text in zip(*columns):
                if (cluster, left, right) != group:
                    if rows:
                        links += finish()
                    group, rows = (cluster, left, right), []
                rows.append((known, side, text))
            yield out(links)
        if rows:
            yield out(finish())

    return compare


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", rows: int = ROWS, miss: float = MISS, folder: str | None = None) -> DataFrame:
    """Group texts whose sets of distinct shingles of ``width`` words have a Jaccard similarity of at least ``percent`` / 100.

    One row per input row: key, n_shingles, component_id (smallest key reachable over links, itself included), kept (key = component_id).
    A pair just at the limit is missed with a chance of at most ``miss`` by the bands, and of about 3e-7 by the signatures, unless
    others connect it. Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null key are linked with
    nothing: n_shingles is theirs, component_id null, kept false. Rows that repeat a key are one document for
    the links (they are expected to repeat the text, too) and all get its result.
    """
    spark, folder = docs.sparkSession, folder or work_folder(docs.sparkSession, "near")
    bands = bands_for(percent, rows, miss)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    described = stored(source.mapInArrow(_describe(width, bands, rows), "id long, n_shingles long, digest binary, bands array<long>"), f"{folder}/described")
    usable = described.filter("id IS NOT NULL AND digest IS NOT NULL")
    classes = stored(usable.groupBy("digest").agg(F.min("id").alias("rep")), f"{folder}/classes")
    reps = usable.select("id", "digest", "bands").join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep")))
    banded = reps.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    met = banded.join(shared, "band").filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    clusters = stored(components(met, f"{folder}/clusters").withColumnsRenamed({"node": "c_id", "component": "cluster"}), f"{folder}/members")

    # Candidates grow with the corpus; the hint keeps a small corpus on the plan of a large one.
    members = source.join(clusters.hint("merge"), F.col("id") == F.col("c_id")).select("cluster", "id", "text")
    members = stored(members.withColumn("bytes", F.octet_length("text").cast("long")).drop_duplicates(["id"]), f"{folder}/texts")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("bytes") / BLOCK_TEXT).cast("int").alias("blocks"))
    dealt = members.join(sizes.withColumnRenamed("cluster", "c"), F.col("cluster") == F.col("c"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # Block i meets every block j: as (i, j) or (j, i); with itself as (i, i).
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "id", (F.col("block") > F.col("other")).cast("int").alias("side"), "text"
    )
    grouped = met.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "id")
    links = stored(grouped.mapInArrow(_compare(width, percent, bands * rows), "u long, v long"), f"{folder}/links")
    joined = components(links, f"{folder}/groups").withColumnsRenamed({"node": "g_id"})
    known = classes.join(joined, F.col("rep") == F.col("g_id"), "left").select(F.col("digest").alias("k_digest"), F.coalesce("component", "rep").alias("group"))
    out = described.select("id", "n_shingles", "digest").join(known, (F.col("digest") == F.col("k_digest")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("group", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, **options) -> DataFrame:
    """One row of each group of near duplicates, with its own columns: the one with the smallest key, null keys last, of those the first of the stored input.

    Every row is compared, so of rows that repeat a key or have none only near copies go. Rows with null, empty and blank texts all stay.
    """
    folder = folder or work_folder(docs.sparkSession, "keep")
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), f"{folder}/rows")
    found = near_duplicates(rows, key="__row", text=text, folder=f"{folder}/near", **options).select("__row", "component_id")
    ordered = found.join(rows.select("__row", F.col(f"`{key}`").alias("__key")), "__row").withColumn("__place", F.struct(F.col("__key").isNull(), "__key", "__row"))
    first = ordered.groupBy("component_id").agg(F.min("__place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    grouped = ordered.join(first.select(F.col("component_id").alias("c"), F.col("first.__row").alias("__first")), F.col("component_id") == F.col("c"))
    gone = grouped.filter("__row <> __first").select(F.col("__row").alias("__gone"))
    return rows.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
