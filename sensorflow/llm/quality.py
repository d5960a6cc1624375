"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Trusted target and raw corpus are multinomials over hash buckets of one- and two-token grams. A document's score is the mean over its grams
of log p(bucket | target) - log p(bucket | raw), in fixed point so that sums do not depend on their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 8_192
SCALE = 1_000_000
THRESHOLD = -0.1
TRUSTED_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words(text: Column) -> Column:
    return F.array_remove(_parts(text), "")


def _parts(text: Column) -> Column:
    """What lies between white-space signs, empty parts included."""
    return F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", -1)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(found: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Every word is hashed once, a window is the hash of three of those. Only where windows repeat are they sorted by hash, with their
    places: equal ones are neighbours. Each start of a repeated window covers the words up to the next start, three at most.
    Two different windows of a text are taken for equal with a chance of 2^-64.
    """
    hashed = F.transform(found, lambda word: F.xxhash64(word))

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def beside(values):
        """Structs of fields 0, 1 and 2: value, next value, value before."""
        none = F.array(F.lit(None).cast("long"))
        return F.arrays_zip(F.concat(values), F.concat(F.slice(values, F.lit(2), F.size(values)), none), F.slice(F.concat(none, values), F.lit(1), F.size(values)))

    def starts(ordered):
        marked = F.arrays_zip(beside(ordered["0"]), ordered["1"])
        return F.sort_array(F.filter(marked, lambda w: F.coalesce(w["0"]["0"] == w["0"]["1"], F.lit(False)) | F.coalesce(w["0"]["0"] == w["0"]["2"], F.lit(False)))["1"])

    def covered(places):
        return F.aggregate(beside(places), F.lit(0).cast("long"), lambda n, i: n + F.least(F.lit(3).cast("long"), i["1"] - i["0"]))

    def counted(w):
        places = F.sequence(F.lit(0).cast("long"), F.size(w) - F.lit(1).cast("long"))
        ordered = F.sort_array(F.arrays_zip(F.concat(w), places))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_once(_once(ordered, starts), covered))

    return F.when(F.size(found) < 4, 0).otherwise(_once(_once(hashed, windows), counted)).cast("long")


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts have no words and fail. The columns replace input columns of these names.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    split = docs.withColumn("__split", _parts(whole)).withColumn("__lines", lines)
    counted = split.withColumn("__words", F.array_remove("__split", ""))
    counted = counted.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            # All characters but the signs between the split parts.
            "word_chars": (F.length(whole) - F.size("__split") + 1).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("__words", "__lines", "__split")


def grams(text: Column, buckets: int) -> Column:
    """Buckets of a text's tokens and of each token with its successor, the text's end counting as a token."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    bucket = lambda gram: F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")
    pairs = lambda tokens: F.arrays_zip(tokens, F.slice(F.concat(tokens, F.array(F.lit("\n"))), F.lit(2), F.size(tokens)))
    return _once(tokens, lambda found: F.concat(F.transform(found, bucket), F.transform(pairs(found), bucket)))


def _counts(texts: DataFrame, text: str, buckets: int) -> dict[int, int]:
    """Grams per bucket over all rows: one row per bucket reaches the driver, so at most ``buckets``."""
    exploded = texts.select(F.explode(grams(F.col(f"`{text}`"), buckets)).alias("bucket"))
    return {row.bucket: row.n for row in exploded.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[int]:
    """Weight of each bucket: round(SCALE * log(p_target / p_raw)), both with one gram added to each bucket.

    The raw corpus is all of ``docs``. The target is the documents whose key is among the ``trusted_rows`` ids of ``trusted_ids`` that come first by hash
    (a bound on labelled rows only; it also bounds what the join sends to executors). Without any trusted
    document all weights are 0, so that the ratio rejects nothing.
    """
    sample = trusted_ids.dropna().distinct().toDF("__id").orderBy(F.xxhash64("__id"), "__id").limit(trusted_rows)
    target = docs.join(F.broadcast(sample), docs[key] == F.col("__id"), "left_semi")
    trusted, raw = _counts(target, text, buckets), _counts(docs, text, buckets)
    n_trusted, n_raw = sum(trusted.values()), sum(raw.values())
    if not n_trusted:
        return [0] * buckets
    base = math.log((n_raw + buckets) / (n_trusted + buckets))
    return [round(SCALE * (math.log((trusted.get(b, 0) + 1) / (raw.get(b, 0) + 1)) + base)) for b in range(buckets)]


def judged(docs: DataFrame, weights: list[int], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the rules' columns, ``n_grams``, ``llr`` (sum of weights), ``score`` (per gram) and ``kept``.

    Kept: not base_failed and llr >= threshold * SCALE * n_grams, in whole numbers. A text without tokens has llr 0.
    """
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to one literal
    found = with_rules(docs, text).withColumn("__grams", grams(F.col(f"`{text}`"), len(weights)))
    scored = found.withColumns(
        {
            "n_grams": F.size("__grams").cast("long"),
            "llr": F.aggregate("__grams", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b)),
        }
    ).drop("__grams")
    # Always true; not deterministic, so a filter on the result stays above it and does not compute the words anew for each use.
    here = F.monotonically_increasing_id() >= 0
    passed = here & (F.col("llr") >= round(threshold * SCALE) * F.col("n_grams"))
    return scored.withColumn("score", F.when(F.col("n_grams") > 0, F.col("llr") / F.col("n_grams") / SCALE).otherwise(0.0)).withColumn(
        "kept", passed & ~F.col("base_failed")
    )


def keep(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents kept, with their own columns."""
    names = docs.columns
    marked = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("__row"), F.col(f"`{text}`").alias("text"))
    return judged(marked, fit(docs, trusted_ids, text, key), "text", **options).filter("kept").select("__row.*")
