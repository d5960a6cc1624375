"""Sharding by extendible hashing.

A row's place is a string of hash bits. All rows start in one bucket; a bucket
above the byte limit splits on its next bit until every bucket fits. The
directory says for each prefix of ``CELL_BITS`` more bits which bucket it leads to,
or that its bucket is still too large and the next level of the directory decides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.staging import stored, work_folder

CELL_BITS = 10
WORD_BITS = 60
WORDS = 3


def hash_bits(value: Column) -> Column:
    """The first 60 bits of a value's MD5, as a long; a null is hashed as an empty text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, WORD_BITS // 4), 16, 10).cast("long")


def bits(word: Column, first: int, count: int) -> Column:
    """``count`` bits of a 60-bit word after its first ``first`` bits."""
    return F.shiftright(word, WORD_BITS - first - count).bitwiseAND((1 << count) - 1)


def split_bucket(cells: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Split one bucket until each part fits or its bits in this level are used up.

    cells: one row per cell (prefix of CELL_BITS more bits) that has rows; at most 1,024.
    """
    out, todo = [], [(0, 0, cells)]
    while todo:
        depth, prefix, part = todo.pop()
        total, n = int(part["size"].sum()), int(part["n"].sum())
        if total <= limit or n == 1:
            out.append(part.assign(depth=depth, prefix=prefix, shard_bytes=total, shard_rows=n, open=False))
        elif depth == CELL_BITS:
            out.append(part.assign(depth=depth, prefix=prefix, shard_bytes=total, shard_rows=n, open=True))
        else:
            bit = (part["cell"].to_numpy() >> (CELL_BITS - depth - 1)) & 1
            for side in (0, 1):
                if (bit == side).any():
                    todo.append((depth + 1, prefix * 2 + side, part[bit == side]))
    return pd.concat(out)


def shard(rows: DataFrame, key: Column, size: Column, limit: int, folder: str | None = None, store: bool = True) -> DataFrame:
    """Give every row its shard.

    Adds ``shard_bytes``, ``shard_rows``, ``shard_depth`` (bits) and ``shard`` (``b`` and
    those bits). ``key`` decides the place; rows of one key stay together unless
    they exceed the limit: then bits of the whole row's hash follow, and for identical rows
    bits of the row's position in the stored input. A single row above the limit is a shard of its own.

    The rows are stored first, so that every pass sees the same positions; ``store=False`` saves this for rows read
    straight from files.

    Null keys count as an empty text, null or negative sizes as 0. Identical rows are separate rows.
    Input columns keep their names; names that this function adds replace input columns of that name.
    """
    spark, folder = rows.sparkSession, folder or work_folder(rows.sparkSession, "shard")
    kept = [c for c in rows.columns if c not in ("shard", "shard_bytes", "shard_rows", "shard_depth")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept])
    current = rows.select(
        whole.alias("__row"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("__size"),
        hash_bits(key).alias("__w0"),
        hash_bits(F.to_json(whole, {"ignoreNullFields": "false"})).alias("__w1"),
        hash_bits(F.monotonically_increasing_id()).alias("__w2"),
        F.lit("").alias("__path"),
    )
    if store:
        current = stored(current, f"{folder}/rows")

    done, level = [], 0
    levels = WORDS * WORD_BITS // CELL_BITS
    while True:
        word, first = divmod(level * CELL_BITS, WORD_BITS)
        current = current.withColumn("__cell", bits(F.col(f"__w{word}"), first, CELL_BITS))
        cells = current.groupBy("__path", "__cell").agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
        directory = stored(
            cells.withColumnRenamed("__cell", "cell")
            .groupBy("__path")
            .applyInPandas(
                lambda part: split_bucket(part, limit),
                "__path string, cell long, size long, n long, depth int, prefix long, shard_bytes long, shard_rows long, open boolean",
            )
            .withColumn("bits", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix"), 10, 2), F.col("depth"), F.lit("0"))))
            .select("__path", F.col("cell").alias("__cell"), "bits", "shard_bytes", "shard_rows", F.col("open").alias("__open")),
            f"{folder}/directory-{level}",
        )
        placed = current.join(directory, ["__path", "__cell"])
        last = level == levels - 1
        ended = placed if last else placed.filter(~F.col("__open"))
        done.append(
            ended.select(
                *[F.col("__row")[c].alias(c) for c in kept],
                F.concat(F.lit("b"), "__path", "bits").alias("shard"),
                "shard_bytes",
                "shard_rows",
                F.length(F.concat("__path", "bits")).alias("shard_depth"),
            )
        )
        if last or directory.filter("__open").isEmpty():
            break
        current = placed.filter("__open").withColumn("__path", F.concat("__path", "bits")).drop("bits", "shard_bytes", "shard_rows", "__open", "__cell")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(rows: DataFrame, path: str) -> None:
    """One directory per shard, from the output of ``shard``. A shard fits the limit, so one task writes it."""
    rows.repartition("shard").write.partitionBy("shard").parquet(path)


def read_shards(rows: DataFrame, path: str, size: Column) -> DataFrame:
    """What ``write_shards`` wrote of ``rows``: ``row_bytes`` (``size`` of the row read), and ``shard_bytes``, ``shard_rows`` and ``shard_depth`` counted anew."""
    files = rows.sparkSession.read.schema(rows.schema).parquet(path).drop("shard_bytes", "shard_rows", "shard_depth").withColumn("row_bytes", size.cast("long"))
    total = F.sum(F.greatest(F.coalesce("row_bytes", F.lit(0)), F.lit(0)))
    sizes = files.groupBy(F.col("shard").alias("__of")).agg(total.alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return files.join(sizes, F.col("shard") == F.col("__of")).drop("__of").withColumn("shard_depth", F.length("shard") - 1)
