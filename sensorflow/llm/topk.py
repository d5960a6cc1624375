"""Exact top-k search by distributed histogram selection.

Queries and candidates meet in blocks, and every score is computed. Per query, histograms of
scores are added up over all blocks and refined until the k-th highest score is known; a last pass keeps what lies above it and the
ties with the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.llm.staging import stored, work_folder

QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 8_192
SLICE = 128
BINS = 4_096
LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    vectors = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), dtype=np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _scores(block: pa.Table, width: int, exact: bool):
    """Yields (query positions, scores, own rows masked) in slices of queries, and the candidates' table first."""
    is_query = np.asarray(block.column("is_query"))
    queries, candidates = block.filter(pa.array(is_query)), block.filter(pa.array(~is_query))
    kind = np.float64 if exact else object
    right = _matrix(candidates.column("vector"), width).astype(kind).T
    left = _matrix(queries.column("vector"), width).astype(kind)
    rows, own = np.asarray(candidates.column("row")), np.asarray(queries.column("row"))

    def slices():
        for first in range(0, len(own), SLICE):
            found = left[first : first + SLICE] @ right
            found = found.astype(np.int64) if exact else np.clip(found, -LONG, LONG).astype(np.int64)
            yield first, found, rows[None, :] != own[first : first + SLICE, None]

    return queries, candidates, slices


def _bins(scores: np.ndarray, low: np.int64, step: np.int64) -> np.ndarray:
    """Bins of scores from ``low`` on; their distance may pass a signed number, an unsigned one holds it."""
    return ((scores.view(np.uint64) - np.array(low).view(np.uint64)) // np.uint64(step)).astype(np.int64)


def _histogram(width: int, exact: bool):
    """Per query, counts of the bins from the block's highest down to where ``need`` scores are counted; lower bins cannot matter."""

    def count(block: pa.Table) -> pa.Table:
        queries, _, slices = _scores(block, width, exact)
        rows, low, high, step, need = (np.asarray(queries.column(c)) for c in ("row", "low", "high", "step", "need"))
        out = [np.zeros((3, 0), np.int64)]
        for first, scores, others in slices():
            for i in range(len(scores)):
                q = first + i
                mine = scores[i][others[i]]
                mine = mine[(mine >= low[q]) & (mine <= high[q])]
                if len(mine) > need[q]:
                    mine = mine[mine >= np.partition(mine, len(mine) - need[q])[len(mine) - need[q]]]
                found, counts = np.unique(_bins(mine, low[q], step[q]), return_counts=True)
                out.append(np.stack([np.full(len(found), rows[q]), found, counts]))
        row, bin_, n = np.concatenate(out, axis=1)
        return pa.table({"row": row, "bin": bin_, "n": n})

    return count


def _winners(width: int, exact: bool, k: int):
    """Per query, the block's scores above the k-th highest and the ties with the smallest ids, ``need`` at most."""

    def select(block: pa.Table) -> pa.Table:
        queries, candidates, slices = _scores(block, width, exact)
        rows, ids, low, need = (np.asarray(queries.column(c)) for c in ("row", "vec_id", "low", "need"))
        others_ids, others_rows = np.asarray(candidates.column("vec_id")), np.asarray(candidates.column("row"))
        out = [np.zeros((5, 0), np.int64)]
        for first, scores, others in slices():
            for i in range(len(scores)):
                q = first + i
                above = np.flatnonzero(others[i] & (scores[i] > low[q]))
                ties = np.flatnonzero(others[i] & (scores[i] == low[q]))
                if len(ties) > need[q]:
                    ties = ties[np.lexsort((others_rows[ties], others_ids[ties]))[: need[q]]]
                found = np.concatenate([above, ties])
                out.append(np.stack([np.full(len(found), rows[q]), np.full(len(found), ids[q]), others_rows[found], others_ids[found], scores[i][found]]))
        row, query_id, vec_row, vec_id, score = np.concatenate(out, axis=1)
        return pa.table({"row": row, "query_id": query_id, "vec_row": vec_row, "vec_id": vec_id, "score": score})

    return select


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, folder: str | None = None) -> DataFrame:
    """The k highest integer inner products of each query with every other row: query_id, rank (from 1), vec_id, score, held.

    Ties go to the smaller id. Rows whose id is null, and vectors that are null or hold null or non-finite components, take no part.
    Vectors of unequal length are compared over the shorter length, empty ones score 0. Repeated rows are separate
    rows: only the query's own row is left out. Components and scores beyond a long are held at its limits; such scores tie, and ``held`` marks them.
    """
    spark, folder = vectors.sparkSession, folder or work_folder(vectors.sparkSession, "topk")
    named = vectors.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"),
        quantised(F.col(f"`{vector}`"), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.monotonically_increasing_id().alias("row"),
    ).dropna(subset=["vec_id", "vector"])
    rows = stored(named, f"{folder}/rows")
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, n_queries, width, largest = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("vector")), F.max(norm)).first()
    result = "query_id long, rank int, vec_id long, score long, held boolean"
    if not n_queries:
        return spark.createDataFrame([], result)
    exact = largest < float(1 << 52)
    limit = min(LONG, int(largest) + 1)
    query_blocks, candidate_blocks = -(-n_queries // QUERY_BLOCK), -(-n // CANDIDATE_BLOCK)
    every_query_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb")
    every_candidate_block = F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("cb")
    block_of = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")

    def cells(state: DataFrame) -> DataFrame:
        ask = rows.filter("is_query").join(state, "row").select(
            "row", "vec_id", "vector", "low", "high", "step", "need", F.lit(True).alias("is_query"), block_of(query_blocks).alias("qb"), every_candidate_block
        )
        zero = [F.lit(0).cast("long").alias(c) for c in ("low", "high", "step", "need")]
        offer = rows.select("row", "vec_id", "vector", *zero, F.lit(False).alias("is_query"), every_query_block, block_of(candidate_blocks).alias("cb"))
        return ask.unionByName(offer).groupBy("qb", "cb")

    step = max(1, -(-(2 * limit + 1) // BINS))
    start = [F.lit(v).cast("long").alias(c) for c, v in (("low", -limit), ("high", limit), ("step", step), ("need", k))]
    state, turn = rows.filter("is_query").select("row", *start), 0
    while True:
        counts = cells(state).applyInArrow(_histogram(width, exact), "row long, bin long, n long")
        summed = counts.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        upper = Window.partitionBy("row").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = summed.withColumn("upto", F.sum("n").over(upper))
        old = state.select(F.col("row").alias("r"), "low", "high", "step", "need")
        at = reached.join(old, F.col("row") == F.col("r")).filter(F.col("upto") >= F.col("need"))
        hit = at.groupBy("row").agg(F.min(F.struct("upto", "bin", "n", "low", "high", "step", "need")).alias("h")).select("row", "h.*")
        wide = lambda name: F.col(name).cast("decimal(20, 0)")  # noqa: E731  sums and products that pass a long on the way
        low = wide("low") + wide("bin") * wide("step")
        finer = hit.select(
            "row",
            low.cast("long").alias("low"),
            F.least(wide("high"), low + wide("step") - 1).cast("long").alias("high"),
            F.greatest(F.lit(1), F.ceil(F.col("step") / BINS)).cast("long").alias("step"),
            (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"),
        )
        # Queries with fewer than k candidates take all of them.
        rest = state.join(hit.select("row"), "row", "left_anti").select("row", "low", "low", "step", "need").toDF("row", "low", "high", "step", "need")
        state = stored(finer.unionByName(rest), f"{folder}/state-{turn}")
        turn += 1
        if step == 1:
            break
        step = max(1, -(-step // BINS))
    best = cells(state).applyInArrow(_winners(width, exact, k), "row long, query_id long, vec_row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "vec_row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", (F.abs("score") == LONG).alias("held"))
