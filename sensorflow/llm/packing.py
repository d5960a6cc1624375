"""Best-fit packing of documents into sequences of bounded length, with certified repacking.

Documents longer than a sequence are cut into full pieces, of which only the first may be shorter. Full pieces are sequences of their own;
the others are dealt to partitions, each packed best-fit decreasing. Dual feasible functions bound each partition's bins
from below. Partitions above their bound give all their documents to a pool, certified ones those of their
emptiest bin; the pool is dealt anew to fewer partitions and packed again while that saves bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.staging import stored, work_folder
from sensorflow.llm.tokens import Encoder

CAPACITY = 1024
ITEMS_PER_PARTITION = 20_000
PIECE = "id long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, part long, bin long, offset long, released boolean, bins long, bound long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that dual feasible functions prove, for lengths from 1 to capacity.

    Used are the identity, f_k (longer than capacity - k counts as a whole bin, shorter than k as nothing) for every length
    k up to half a bin, and u_k (a length x with (k + 1) x a whole number of bins counts as x, others as floor((k + 1) x) / k) for k up to 20.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        mapped = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
        best = max(best, -(-int((counts * mapped).sum()) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        mapped = np.where(whole, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. A bit per free length tells which bins are open, so the tightest fit is one bit operation."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits, used = 0, 0
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = free_bits >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            chosen = open_bins[free].pop()
            if not open_bins[free]:
                free_bits ^= 1 << free
        else:
            free, chosen, used = capacity, used, used + 1
        bins[i], offsets[i] = chosen, capacity - free
        left = free - length
        if left:
            if not open_bins[left]:
                free_bits |= 1 << left
            open_bins[left].append(chosen)
    return bins, offsets


def _pack_partition(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    items = items.sort_values("id", ignore_index=True)
    lengths = items["length"].to_numpy(np.int64)
    bins, offsets = best_fit_decreasing(lengths, capacity)
    n_bins, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
    filled = np.bincount(bins, weights=lengths, minlength=n_bins)
    released = np.ones(len(items), bool) if n_bins > bound else bins == int(filled.argmin())
    return items.assign(bin=bins, offset=offsets, released=released, bins=n_bins, bound=bound)


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: key, piece, start, length and crc of its ids, and the ids if asked for."""

    def cut(batches):
        encoder = Encoder(tokenizer, "<u4")
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for known, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(whole.as_py()) + tail
                limits = list(range(len(ids), 0, -4 * capacity))[::-1]  # full pieces from the end on, so the first may be shorter
                for piece, (first, last) in enumerate(zip([0, *limits], limits)):
                    part = ids[first:last]
                    values = (known, piece, first // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for name, value in zip(out, values):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(out["doc_id"], pa.int64()), "piece": pa.array(out["piece"], pa.int32())}
                | {name: pa.array(out[name], pa.int64()) for name in ("start", "length", "ids_crc32")}
                | {"ids": pa.array(out["ids"], pa.binary())}
            )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def place(items: DataFrame, folder: str, capacity: int = CAPACITY, per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """Sequence and offset for every row of ``items`` (the columns of PIECE; lengths from 1 to capacity)."""
    full = items.filter(F.col("length") == capacity).select("*", (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    pool, placed, before, turn = items.filter(F.col("length") < capacity), [full], None, 0
    n_items = pool.count()
    while n_items:
        parts = -(-n_items // per_partition)
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInPandas(lambda group: _pack_partition(group, capacity), PLACED), f"{folder}/round-{turn}")
        named = packed.withColumn("sequence_id", F.lit(turn) * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin"))
        named = named.withColumn("certified", F.col("bins") == F.col("bound"))
        total = packed.select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        if before is not None and total >= before[1]:
            placed.append(before[0])
            break
        kept, loose = named.filter(~F.col("released")), named.filter("released")
        released = loose.agg(F.count("*").alias("items"), F.count_distinct("sequence_id").alias("bins")).first()
        if parts == 1:
            placed.append(named)
            break
        placed.append(kept)
        before, n_items, turn = (loose, released.bins), released.items, turn + 1
        pool = loose.select(*items.columns)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "id"]
    out = placed[0].select(*columns)
    for more in placed[1:]:
        out = out.unionByName(more.select(*columns))
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int | None = None, capacity: int = CAPACITY, with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """Pack all documents; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, and ids
    (little-endian unsigned 32-bit) if asked for. ``certified``: the bins of the piece's partition are as few as its lower bound.

    Null texts are empty. A document without ids (empty and no ``end``) has no piece. Repeated rows are separate documents, null keys stay
    null. An empty table gives an empty result.
    """
    folder = folder or work_folder(docs.sparkSession, "pack")
    found = pieces(docs, tokenizer, text, key, end, capacity, with_ids).withColumn("id", F.monotonically_increasing_id())
    cut = stored(found if with_ids else found.drop("ids"), f"{folder}/pieces")
    out = place(cut.select("id", "doc_id", "piece", "start", "length", "ids_crc32"), folder, capacity)
    if with_ids:
        out = out.join(cut.select("id", "ids"), "id")
    return out.drop("id")
