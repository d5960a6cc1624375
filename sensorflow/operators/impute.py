"""Bounded forward fill that also splits a very long series over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sensorflow.schema import FILL_ROWS, HEART_RATE, SUBJECT, TIME

ROWS_PER_TASK = 2_000_000
# Chunks of long series are smaller than ROWS_PER_TASK while there would be fewer than CHUNKS_PER_CORE for a core.
CHUNKS_PER_CORE = 4
LEAST_CHUNK = 200_000
MAX_CHUNKS = 10_000
SAMPLES_PER_CHUNK = 16
# Keeps microseconds when keys are passed as text.
EXACT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def forward_fill(
    df: DataFrame,
    column: str = HEART_RATE,
    by: Sequence[str] = (SUBJECT,),
    order_by: Sequence[str] = (TIME,),
    rows: int = FILL_ROWS,
    rows_per_task: int | None = ROWS_PER_TASK,
    max_chunks: int = MAX_CHUNKS,
) -> DataFrame:
    """Replace nulls by the last value among the ``rows`` preceding rows of the series.

    ``by`` names the series, ``order_by`` must order it totally: add a tie-break
    to the time. The frame counts rows, not time.

    Series up to ``rows_per_task`` rows are filled by one window per series. A
    count per series, run here, finds longer ones. These are cut along the order
    key into chunks of about that size, or smaller ones to give every core work, so no task ever holds a whole long
    series, and each chunk is told the value it inherits from the chunks before
    it. The result is the same. ``rows_per_task=None`` skips the count; use it
    only when series are known to be short.

    Cutting reads ``df`` again (series, order and value columns only), so feed
    it stored data: order columns must not change between two reads.
    """
    by, order_by = list(by), list(order_by)
    long_series, target = ([], 0) if rows_per_task is None else _long_series(df, by, rows_per_task, max_chunks)
    if not long_series:
        window = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(-rows, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(window))

    hot = _renamed(df.sparkSession.createDataFrame([row[:-1] for row in long_series], df.select(*by).schema), by)
    key = _unique(by + order_by)
    cuts, size = _cut_points(df, by, order_by, hot, target)
    chunked = _dealt(_with_chunk(df, key, cuts, size), by, size + 1)
    narrow = _in_series(df.select(*_unique(key + [column])), hot, by)
    inherited = _inherited_values(_with_chunk(narrow, key, cuts, size), column, by, order_by, rows)

    series = Window.partitionBy("_place", *by, "_chunk").orderBy(*order_by)
    filled = chunked.select(
        "*",
        F.last(column, ignorenulls=True).over(series.rowsBetween(-rows, 0)).alias("_filled"),
        F.row_number().over(series).alias("_position"),
    )
    # At most one small row per chunk, and at most 2 * max_chunks chunks.
    joined = filled.join(F.broadcast(inherited), _same(filled, inherited, by + ["_chunk"]), "left")
    carried = F.when(F.col("_position") <= F.col("_reach"), F.col("_inherited"))
    return joined.select(
        *[F.coalesce("_filled", carried).alias(column) if name == column else filled[name] for name in df.columns]
    )


def _long_series(df: DataFrame, by: list[str], rows_per_task: int, max_chunks: int) -> tuple[list[Row], int]:
    """Series with more than the target rows, and the target.

    The target grows when the chunks would exceed ``max_chunks``, which bounds
    everything that is collected or broadcast later. Longest first, so the
    series above a raised target come first.
    """
    found = (
        df.groupBy(*by)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .orderBy(F.desc("_rows"))
        .limit(max_chunks)
        .collect()
    )
    rows = sum(row["_rows"] for row in found)
    even = max(LEAST_CHUNK, -(-rows // (CHUNKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)))
    target = max(min(rows_per_task, even), -(-rows // max_chunks))
    return [row for row in found if row["_rows"] > target], target


def _dealt(df: DataFrame, by: list[str], chunks: int) -> DataFrame:
    """Chunks dealt to enough partitions that few share one, where the session has fewer.

    They are dealt by a hash: windows do not partition by a series column of one fixed value, so dealt by the columns the rows would be shuffled again.
    """
    df = df.withColumn("_place", F.xxhash64(*by, "_chunk"))
    spark = df.sparkSession
    wanted = min(2 * chunks, 2 * CHUNKS_PER_CORE * spark.sparkContext.defaultParallelism)
    if wanted <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(wanted, "_place")


def _cut_points(
    df: DataFrame, by: list[str], order_by: list[str], hot: DataFrame, target: int
) -> tuple[Column, int]:
    """Array literal of sorted keys (series, order) about ``target`` rows apart in long series, and its size.

    They are every n-th key of a random sample of about n keys per chunk. Any
    keys of long series give the same fill, they only decide how even the chunks
    are. They are fixed here once, because both reads of the data must use the same.
    """
    names = _unique(by + order_by)
    sample = _in_series(df.select(*names), hot, by).filter(F.rand() < min(1.0, SAMPLES_PER_CHUNK / target))
    ranked = sample.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)))
    points = ranked.filter(F.col("_n") % SAMPLES_PER_CHUNK == 0).agg(F.collect_list(_key(names)).alias("points"))
    text, size = points.select(F.to_json("points", EXACT_TIMES), F.size("points")).first()
    return F.sort_array(F.from_json(F.lit(text), points.schema["points"].dataType, EXACT_TIMES)), size


def _with_chunk(df: DataFrame, key: list[str], cuts: Column, size: int) -> DataFrame:
    """Add the number of cut points up to the row's key, found by halving steps.

    The optimizer folds the points to one literal that expressions hold by
    reference; joined to the rows, the array would be copied per row. One
    projection per step keeps the search in generated code.
    """
    found = df.withColumns({"_key": _key(key), "_chunk": F.lit(0)})
    for power in reversed(range(size.bit_length())):
        passed = F.get(cuts, F.col("_chunk") + (2**power - 1)) <= F.col("_key")
        found = found.withColumn("_chunk", F.col("_chunk") + F.when(passed, 2**power).otherwise(0))
    return found.drop("_key")


def _inherited_values(
    df: DataFrame, column: str, by: list[str], order_by: list[str], rows: int
) -> DataFrame:
    """Per chunk the value before it and how many of its first rows that value reaches.

    Only the last ``rows`` rows of a chunk can matter later, so a chunk counts
    for at most that many. The rank filter drops the others before the shuffle.
    """
    backwards = Window.partitionBy(*by, "_chunk").orderBy(*[F.desc(name) for name in order_by])
    tails = df.withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= rows)
    chunks = tails.groupBy(*by, "_chunk").agg(
        F.count("*").alias("_size"),
        F.min(F.when(F.col(column).isNotNull(), F.struct("_back", F.col(column).alias("_value")))).alias("_last"),
    )
    in_order = Window.partitionBy(*by).orderBy("_chunk")
    ended = chunks.withColumn("_end", F.sum("_size").over(in_order))
    known = F.when(
        F.col("_last").isNotNull(),
        F.struct((F.col("_end") - F.col("_last._back") + 1).alias("at"), F.col("_last._value").alias("value")),
    )
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    source = ended.withColumn("_source", F.last(known, ignorenulls=True).over(before))
    reach = F.col("_source.at") + rows - (F.col("_end") - F.col("_size"))
    return source.filter(reach >= 1).select(
        *[F.col(name).alias(f"_by_{name}") for name in [*by, "_chunk"]],
        F.col("_source.value").alias("_inherited"),
        reach.alias("_reach"),
    )


def _key(names: list[str]) -> Column:
    return F.struct(*[F.col(name).alias(f"k{i}") for i, name in enumerate(names)])


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*[F.col(name).alias(f"_by_{name}") for name in by])


def _in_series(df: DataFrame, hot: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the long series; there are at most ``max_chunks`` of those."""
    return df.join(F.broadcast(hot), _same(df, hot, by), "left_semi")


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    """Equality of the series columns; a null names a series like any other value."""
    return reduce(Column.__and__, (left[name].eqNullSafe(right[f"_by_{name}"]) for name in by))


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))
