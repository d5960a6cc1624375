"""Training / held-out split and folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.functions.values import row_hash
from sensorflow.schema import SEED

TRAIN_PERCENT = 80
SMALL = 100


def hash_split(df: DataFrame, key: Sequence[str], percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the row key: the same rows on every run and any partitioning."""
    trained = in_training(key, percent)
    return df.filter(trained), df.filter(~trained)


def in_training(key: Sequence[str], percent: int = TRAIN_PERCENT) -> Column:
    return row_hash(key) % 100 < percent


def random_split(df: DataFrame, percent: int = TRAIN_PERCENT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Seeded random split; the rows chosen change with the partitioning of ``df``."""
    train, test = df.randomSplit([percent / 100, 1 - percent / 100], seed)
    return train, test


def with_fold(df: DataFrame, key: Sequence[str], folds: int = 5, output: str = "fold") -> DataFrame:
    """Fold number from a hash of the key; a subject key keeps subjects together."""
    return df.withColumn(output, (row_hash(key) % folds).cast("int"))


def with_group_fold(df: DataFrame, group: Sequence[str], folds: int = 5, output: str = "fold") -> DataFrame:
    """Fold number by group, so that folds have about equally many rows and a group is in one fold.

    Groups are counted. Those with at least one in ``folds`` * SMALL rows, so at most that many, are dealt largest first, each to the
    fold with the fewest rows so far (equal sizes in the order of their hash). Smaller ones follow each other in the order of their hash and fill up
    the folds: running sums within range partitions, and one sum per partition, tell how many rows lie before a group.
    Null is a group like any other.
    """
    group = list(group)
    counts = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    large = counts.filter(F.col("_rows") * (folds * SMALL) >= total).orderBy(F.desc("_rows"), row_hash(group), *group).collect()
    loads, dealt = [0] * folds, []
    for row in large:
        fold = min(range(folds), key=loads.__getitem__)
        loads[fold] += row["_rows"]
        dealt.append((*row[:-1], fold))
    small = counts.filter(F.col("_rows") * (folds * SMALL) < total)
    keys = counts.select(*group).schema
    known = df.sparkSession.createDataFrame(dealt, T.StructType([*keys, T.StructField(output, T.IntegerType())]))
    named = [F.col(name).alias(f"_group_{name}") for name in group]
    chosen = F.broadcast(known.select(*named, output))
    same = reduce(Column.__and__, (df[name].eqNullSafe(chosen[f"_group_{name}"]) for name in group))
    first = df.join(chosen, same, "left").select(*[df[name] for name in df.columns], chosen[output])
    rest = _filled_up(small, group, loads, total, output).select(*named, output)
    other = first.filter(F.col(output).isNull()).drop(output)
    same = reduce(Column.__and__, (other[name].eqNullSafe(rest[f"_group_{name}"]) for name in group))
    return first.filter(F.col(output).isNotNull()).unionByName(other.join(rest, same).select(*[other[name] for name in df.columns], rest[output]))


def _filled_up(small: DataFrame, group: list[str], loads: list[int], total: int, output: str) -> DataFrame:
    """Small groups in the order of their hash, cut where the folds are as full as the others."""
    left, room = total - sum(loads), []
    level = _level(loads, left)
    for load in loads:
        room.append(max(0.0, level - load))
    limits = [sum(room[: i + 1]) for i in range(len(room) - 1)]
    ordered = small.withColumn("_hash", row_hash(group)).repartitionByRange("_hash", *group).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_part").orderBy("_hash", *group)
    running = ordered.withColumn("_before", F.sum("_rows").over(here) - F.col("_rows"))
    parts = running.groupBy("_part").agg(F.max(F.col("_before") + F.col("_rows")).alias("_sum"))
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = running.join(F.broadcast(offsets.drop("_sum")), "_part")  # one row per partition
    middle = F.col("_offset") + F.col("_before") + F.col("_rows") / 2
    fold = reduce(Column.__add__, ((middle >= limit).cast("int") for limit in limits), F.lit(0))
    return placed.select(*group, fold.alias(output))


def _level(loads: list[int], left: int) -> float:
    """How full folds get when ``left`` more rows fill up the emptiest ones evenly."""
    known = sorted(loads)
    for n in range(1, len(known) + 1):
        level = (sum(known[:n]) + left) / n
        if n == len(known) or level <= known[n]:
            return level
    return 0.0
