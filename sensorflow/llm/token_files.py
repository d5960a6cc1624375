"""Token ids as flat binary files with 64-bit document offsets, read by memory mapping.

A folder holds, for each partition p of the documents in ascending key order,

    tokens-<p>.bin    the ids of its documents, little-endian unsigned integers
    offsets-<p>.bin   64-bit: n + 1 offsets of its n documents in tokens-<p>.bin, counted in ids from 0
    keys-<p>.bin      64-bit: the n document keys

and index.json, one line per partition: part, n_docs, n_nulls (null keys, which come first), n_tokens, base (ids in all earlier
partitions) and dtype. A document starts at base + offset.
"""

from __future__ import annotations

import os
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorflow.llm.staging import stored
from sensorflow.llm.tokens import Encoder

INDEX = "part int, n_docs long, n_nulls long, n_tokens long, dtype string"


def mounted(folder: str) -> str:
    """The path of a folder that is mounted on the driver and all executors; memory mapping needs one."""
    parsed = urlparse(folder)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"token files need a mounted shared folder, not {folder}")
    return unquote(parsed.path)


def _write_part(folder: str, tokenizer: str, dtype: str, end: int | None):
    def write(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        os.makedirs(folder, exist_ok=True)
        encoder = Encoder(tokenizer, dtype)
        tail = b"" if end is None else np.array([end], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        names = [f"{folder}/{kind}-{part}.bin" for kind in ("tokens", "offsets", "keys")]
        docs = nulls = total = 0
        files = [open(f"{name}.{attempt}", "wb") for name in names]
        files[1].write(np.array([0], "<i8").tobytes())
        for batch in batches:
            keys = batch.column(0)
            nulls += keys.null_count
            docs += len(keys)
            files[2].write(keys.fill_null(0).to_numpy().astype("<i8").tobytes())
            for text in batch.column(1):
                ids = encoder.ids(text.as_py()) + tail
                total += len(ids) // width
                files[0].write(ids)
                files[1].write(np.array([total], "<i8").tobytes())
        for file, name in zip(files, names):
            file.close()
            os.replace(file.name, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_nulls": [nulls], "n_tokens": [total], "dtype": [dtype]})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = None, dtype: str = "<u2", partitions: int | None = None) -> DataFrame:
    """Write every text's ids, then ``end`` if given, in ascending key order; returns the index.

    ``folder`` is mounted on all executors. A task writes files under names of its own and renames them when they are whole, so a
    repeated task replaces them by the same ones. Null keys come first; documents with equal keys follow each other in the order
    of a hash of their text, identical ones in input order, and may lie in several partitions. Null and empty texts have
    only ``end``. An empty table gives one empty partition or none. Other columns are left out.
    """
    path = mounted(folder)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    order = ["key", "__hash", "__row"]
    rows = rows.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).select("key", "text")
    counts = stored(ranged.mapInArrow(_write_part(path, tokenizer, dtype, end), INDEX), f"{folder}/counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = counts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.write.json(f"{folder}/index.json")
    return read_index(docs.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{INDEX}, base long").json(f"{folder}/index.json")


def open_part(folder: str, part: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped ids, offsets and keys of one partition."""

    def mapped(kind, dtype):
        name = f"{mounted(folder)}/{kind}-{part}.bin"
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)

    return mapped("tokens", dtype), mapped("offsets", "<i8"), mapped("keys", "<i8")


def read_documents(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: key, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, offsets, keys = open_part(folder, row["part"], row["dtype"])
                for first in range(0, len(keys), 1000):
                    spans = [(int(offsets[i]), int(offsets[i + 1])) for i in range(first, min(first + 1000, len(keys)))]
                    known = [None if first + i < row["n_nulls"] else int(keys[first + i]) for i in range(len(spans))]
                    out = {
                        "key": pa.array(known, pa.int64()),
                        "start": pa.array([row["base"] + a for a, _ in spans], pa.int64()),
                        "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in spans], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([tokens[a:b].tolist() for a, b in spans], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    index = read_index(spark, folder)
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    parts = max(1, index.count())  # a row per partition: as many tasks, however small the rows
    return index.repartition(parts, "part").mapInArrow(read, schema).withColumnRenamed("key", key)
