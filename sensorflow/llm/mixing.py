"""Mixing sources to target weights as a time-varying curriculum.

Every source has a target number of words and a schedule: its share of demand at
training time t in [0, 1] is ``1 + tilt * (2t - 1)`` times its average share. The
integral of that over [0, t] times the target is the demand up to t. A copy of a document whose middle
lies ``m`` words into its source's stream is trained on at the t where that demand is ``m``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.llm.staging import stored, work_folder

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 5_000
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.0, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target words of each source; one row per source: source, source_size.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words.
    No target exceeds ``max_repeats`` times its source's size; what is above is shared by weight among the
    others until none is above. Adds rank (from 0), weight and target. The table has a row per source, so
    its order is one small sort.

    If the first i sources by size over weight stop at their limit, the others get ``level`` times their weight;
    the first i for which the next source stays below its limit is the answer.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(w) for w in weights])
    limit = F.lit(max_repeats) * F.col("source_size")
    leveled = (
        sources.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumns(
            {
                "__words": F.sum("source_size").over(every) * F.lit(float(share)),
                "__weights": F.sum("weight").over(every),
                "__used": F.coalesce(F.sum(limit).over(before), F.lit(0)),
                "__gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            }
        )
        .withColumn("__level", (F.col("__words") - F.col("__used")) / (F.col("__weights") - F.col("__gone")))
        .withColumn("__free", F.col("__level") * F.col("weight") <= limit)
        .withColumn("__final", F.min(F.when(F.col("__free"), F.struct(F.col("__gone"), F.col("__level")))).over(every))
    )
    bounded = F.col("__final").isNull() | (F.col("__gone") < F.col("__final.__gone"))
    return leveled.withColumn("target", F.when(bounded, limit.cast("double")).otherwise(F.col("__final.__level") * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def tilt(rank: Column) -> Column:
    """Default schedules: sources in turn fade out, stay even, fade in."""
    return F.element_at(F.array(F.lit(-0.8), F.lit(0.0), F.lit(0.8)), (rank % 3 + 1).cast("int"))


def time_of(demand_share: Column, slope: Column) -> Column:
    """The t in [0, 1] at which ``t + slope * (t^2 - t)`` of a source's target has been asked for."""
    linear = 1 - slope
    root = F.sqrt(linear * linear + 4 * slope * demand_share)
    return F.when(F.abs(slope) < 1e-9, demand_share).otherwise(2 * demand_share / (linear + root))


def plan(docs: DataFrame, size: Column | None = None, text: str = "text", source: str = "source", key: str = "doc_id", folder: str | None = None, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """How often and when each document is trained on: one row per input row.

    Columns: key, source, size, source_size, rank, target, ``epochs`` (times taken), ``taken`` (words), ``__before``
    (words of its source that come earlier in an epoch) and ``__row``.

    Within a source documents follow the hash of their key. Every document is taken
    floor(target / source_size) times, and once more if its middle lies within the rest of the target, so a source
    misses its target by at most half of one document. Words before a document are sums over buckets of
    hash values of about ROWS_PER_BUCKET rows plus a running sum within the bucket, so a hot source is spread.
    Null texts and empty texts have size 0 and count as taken 0 words; null keys hash as an empty text; repeated rows
    are separate documents.
    """
    spark, folder = docs.sparkSession, folder or work_folder(docs.sparkSession, "mix")
    size = word_count(F.col(f"`{text}`")) if size is None else size
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    narrow = stored(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{source}`").cast("string").alias("source"),
            size.alias("size"),
            place.alias("__place"),
            F.monotonically_increasing_id().alias("__row"),
            *keep,
        ),
        f"{folder}/sizes",
    )
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    wanted = targets(totals.select("source", "source_size"), **options)
    buckets = totals.select(F.col("source").alias("__s"), F.ceil(F.col("__rows") / ROWS_PER_BUCKET).alias("__buckets"))
    sources = stored(wanted.join(buckets, wanted["source"].eqNullSafe(buckets["__s"])).drop("__s"), f"{folder}/sources")
    sources = sources.withColumnRenamed("source", "__source")
    known = narrow.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    known = known.withColumn("__bucket", F.floor(F.col("__place") / F.lit(float(1 << 60)) * F.col("__buckets")))
    sums = known.groupBy("rank", "__bucket").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("rank").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("rank").alias("__r"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy("rank", "__bucket").orderBy("__place", "key", "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, (F.col("rank") == F.col("__r")) & (F.col("__bucket") == F.col("__b"))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    return (
        placed.withColumn("__before", F.col("__offset") + F.col("__inside"))
        .withColumn("epochs", (whole + F.when(F.col("__before") + F.col("size") / 2 < rest, 1).otherwise(0)).cast("int"))
        .withColumn("taken", F.col("epochs") * F.col("size"))
        .select(F.col("key").alias(key), "source", "size", "source_size", "rank", "target", "epochs", "taken", "__before", "__row", *keep)
    )


def positions(planned: DataFrame) -> DataFrame:
    """One row per copy: the plan's columns, ``epoch`` (from 0) and ``position`` in [0, 1] of training."""
    copies = planned.filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    middle = F.col("epoch") * F.col("source_size") + F.col("__before") + F.col("size") / 2
    asked = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle / F.col("target"))).otherwise(F.lit(0.0))
    return copies.withColumn("position", time_of(asked, tilt(F.col("rank"))))


def ordered(docs: DataFrame, text: str, source: str, key: str, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """The stored plan, and the documents in training order with ``__row`` of the plan for each copy.

    The plan is joined to one row of each group of identical rows, which then repeats as often as the plan takes the group.
    """
    columns = [f"`{c}`" for c in docs.columns]
    marks = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in columns]
    marked = docs.withColumn("__content", F.md5(F.concat(*marks)))
    planned = stored(plan(marked, text=text, source=source, key=key, folder=folder, keep=("__content",), **options), f"{folder}/plan")
    copies = positions(planned).select(F.col("__content").alias("__same"), F.col("position").alias("__position"), "__row", F.col("epoch").alias("__epoch"))
    first = Window.partitionBy("__content").orderBy(F.lit(0))
    single = marked.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1")
    joined = single.join(copies, F.col("__content") == F.col("__same"))
    order = ["__position", "__row", "__epoch"]
    return planned, joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, "__row")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", folder: str | None = None, **options) -> DataFrame:
    """The documents in training order: each as often as the plan takes it, range-sorted by position.

    Keeps the columns of ``docs``. Documents without words are taken as their source's epochs say.
    """
    folder = folder or work_folder(docs.sparkSession, "mix")
    return ordered(docs, text, source, key, folder, **options)[1].select(*[f"`{c}`" for c in docs.columns])


def taken_in_order(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", folder: str | None = None, **options) -> DataFrame:
    """One row per input row: the plan's columns, with ``taken`` (words), first_place and last_place (from 0, null if never taken) of its copies
    counted in the mixed documents as they are written."""
    folder = folder or work_folder(docs.sparkSession, "mix")
    planned, rows = ordered(docs, text, source, key, folder, **options)
    numbers = {"__part": F.spark_partition_id(), "__nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    written = stored(rows.withColumns(numbers), f"{folder}/mixed", compression="zstd")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    sized = written.select("__row", "__part", "__nth", word_count(F.col(f"`{text}`")).alias("__words"))
    placed = sized.join(offsets, F.col("__part") == F.col("__p")).withColumn("__place", F.col("__offset") + F.col("__nth"))
    found = placed.groupBy(F.col("__row").alias("__r")).agg(
        F.sum("__words").alias("__taken"), F.min("__place").alias("first_place"), F.max("__place").alias("last_place")
    )
    return planned.join(found, F.col("__row") == F.col("__r"), "left").withColumn("taken", F.coalesce("__taken", F.lit(0))).drop("__r", "__taken", "__content")
