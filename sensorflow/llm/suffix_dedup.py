"""Removal of long byte strings that repeat across documents, by sorting suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Texts are stored once, as chunks of a few MB,
bucketed by chunk: with at least as many buckets as shuffle partitions, later joins move no text. Then

1. every window of ``length`` bytes is led by the ANCHOR bytes in it with the lowest hash. Equal windows have equal
   leaders, so a window can repeat only if its leader does. Chunks send their leaders' hashes, dealt by hash, and learn
   which of them occur elsewhere, too: one bit each.
2. for those leaders, chunks send the bytes of the windows they lead, each different string once with the smallest id that has it. All
   windows of one leader meet in one group, where their suffixes are sorted; equal ones follow each other
   and their smallest id is known. Chunks learn for each window, by one bit, whether a smaller id than their own has it.
3. chunks mark the bytes covered.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.shingles import Powers, byte_table, mixed, prefix_sums
from sensorflow.llm.staging import stored, work_folder
from sensorflow.llm.suffix_sort import WORD, sort_suffixes

LENGTH = 50
ANCHOR = 16
CHUNK_BYTES = 2 << 20
BLOCK = 1 << 19
POSITION_BITS = 20
KEY_BYTES = 5
GROUP_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max


def _chunks(batches):
    """Rows (id, text) of a partition become chunks of about CHUNK_BYTES; a longer text is a chunk of its own."""
    from pyspark import TaskContext

    base, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

    def packed():
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        lengths = pa.array([[len(text) for text in texts]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([ids], pa.list_(pa.int64())), lengths, pa.array([body], pa.binary()), pa.array([size])], ["chunk", "ids", "lengths", "body", "bytes"])

    for batch in batches:
        for known, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            text = text or b""
            if ids and size + len(text) > CHUNK_BYTES:
                yield packed()
                n, ids, texts, size = n + 1, [], [], 0
            ids.append(known)
            texts.append(text)
            size += len(text)
    if ids:
        yield packed()


def _rows(batches):
    """The rows of batches as dictionaries, one at a time: a row holds a whole chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


class Chunk:
    """A chunk's bytes, its documents' limits and ids (null ids are above all others), and its leaders."""

    def __init__(self, ids, lengths, body, length: int):
        self.known, self.length = ids, length
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.starts = self.ends - np.array(lengths, np.int64)
        size = int(self.ends[-1]) if len(ids) else 0
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(size, 1))
        self.data = np.frombuffer(raw, np.uint8)
        self.raw = raw

    def leaders(self):
        """key, low, high, document: the windows that start from low to high and share a leader with hash ``key``."""
        powers, table, size = Powers(), byte_table(False), len(self.data)
        out = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)]
        reach = self.length - ANCHOR + 1
        for first in range(0, size - self.length + 1, BLOCK):
            last = min(first + BLOCK, size - self.length + 1)
            data = self.data[first : last + self.length - 1]
            sums = prefix_sums(data, table, powers)
            n = len(data) - ANCHOR + 1
            _, down = powers.upto(len(data) + 1)
            keys = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[:n])
            low = (keys >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(n, dtype=np.uint64)
            have = 1
            while 2 * have <= reach:
                low = np.minimum(low[:-have], low[have:])
                have *= 2
            low = np.minimum(low[: n - reach + 1], low[reach - have :][: n - reach + 1])
            leader = (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
            usable = np.ones(last - first, bool)
            for end in self.ends[np.searchsorted(self.ends, first) :].tolist():
                begin = max(0, end - self.length + 1 - first)
                if begin >= last - first:
                    break
                usable[begin : max(0, end - first)] = False
            changed = np.ones(len(leader), bool)
            changed[1:] = (leader[1:] != leader[:-1]) | (usable[1:] != usable[:-1])
            begins = np.flatnonzero(changed)
            stops = np.append(begins[1:], len(leader)) - 1
            good = usable[begins]
            begins, stops = begins[good], stops[good]
            # Leaders have low hashes; mixed again, these are spread over all groups.
            out.append((mixed(keys[leader[begins]]), begins + first, stops + first))
        key, low, high = (np.concatenate(part) for part in zip(*out))
        return key, low, high, np.searchsorted(self.ends, low, "right")


def _dealt(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)


def _short(keys: np.ndarray) -> bytes:
    """The low KEY_BYTES of each key; its group is chosen by the high half."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _asked(groups: int, length: int):
    def ask(batches):
        for row in _rows(batches):
            key, _, _, _ = Chunk(row["ids"], row["lengths"], row["body"], length).leaders()
            keys = np.unique(key)
            limits = np.searchsorted(_dealt(keys, groups), np.arange(groups + 1, dtype=np.uint64))
            used = [g for g in range(groups) if limits[g] < limits[g + 1]]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(used, pa.int32()),
                    "chunk": pa.array([row["chunk"]] * len(used), pa.int64()),
                    "keys": pa.array([_short(keys[limits[g] : limits[g + 1]]) for g in used], pa.binary()),
                }
            )

    return ask


def _answer_keys(table: pa.Table) -> pa.Table:
    """For each chunk of one group, a bit per key: it came from other chunks, too."""
    parts = table.column("keys").to_pylist()
    counts = [len(part) // KEY_BYTES for part in parts]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, KEY_BYTES)
    _, place, n = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    found = np.split(n[place] > 1, np.cumsum(counts)[:-1])
    return pa.table(
        {
            "part": table.column("part"),
            "chunk": table.column("chunk"),
            "mask": pa.array([np.packbits(part).tobytes() for part in found], pa.binary()),
            "hits": pa.array([int(part.sum()) for part in found], pa.int64()),
        }
    )


def _records(chunk: Chunk, answers: list, groups: int, deal: int):
    """The strings of windows with a repeated leader: first the segments that have one (low, high, document, string number), then the strings of
    each group of ``deal`` with the smallest id that has them, in order of first occurrence."""
    key, low, high, doc = chunk.leaders()
    keys, place, n = np.unique(key, return_inverse=True, return_counts=True)
    shared = n > 1
    limits = np.searchsorted(_dealt(keys, groups), np.arange(groups + 1, dtype=np.uint64))
    for answer in answers:
        begin, end = limits[answer["part"]], limits[answer["part"] + 1]
        shared[begin:end] |= np.unpackbits(np.frombuffer(answer["mask"], np.uint8), count=end - begin).astype(bool)
    chosen = np.flatnonzero(shared[place])
    low, high, doc, part = low[chosen], high[chosen], doc[chosen], _dealt(mixed(key[chosen]), deal).astype(np.int64)
    raw, tail = chunk.raw, chunk.length
    ids = chunk.ids[doc].tolist()
    numbers, strings, owners, parts = [], {}, [], []
    for begin, end, known, g in zip(low.tolist(), (high + tail).tolist(), ids, part.tolist()):
        number = strings.setdefault(raw[begin:end], len(strings))
        if number == len(owners):
            owners.append(known)
            parts.append(g)
        elif known < owners[number]:
            owners[number] = known
        numbers.append(number)
    return (low, high, doc, np.array(numbers, np.int64)), list(strings), np.array(owners, np.int64), np.array(parts, np.int64)


def _sent(groups: int, deal: int, length: int):
    def send(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for row in _rows(batches):
            chunk = Chunk(row["ids"], row["lengths"], row["body"], length)
            _, strings, owners, parts = _records(chunk, row["answers"] or [], groups, deal)
            order, out = np.argsort(parts, kind="stable"), {"part": [], "chunk": [], "owners": [], "windows": [], "strings": []}
            for g in np.unique(parts).tolist():
                mine = order[np.searchsorted(parts[order], g) : np.searchsorted(parts[order], g, "right")].tolist()
                windows, text = bytes(len(strings[i]) - length + 1 for i in mine), b"".join([strings[i] for i in mine])
                for name, value in zip(out, (g, row["chunk"], pack(owners[mine].tobytes()), pack(windows), pack(text))):
                    out[name].append(value)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(out.values(), kinds)], list(out))

    return send


def _answer_windows(length: int):
    def answer(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        owners = [np.frombuffer(unpack(x), np.int64) for x in table.column("owners").to_pylist()]
        windows = [np.frombuffer(unpack(x), np.uint8) for x in table.column("windows").to_pylist()]
        bodies = [unpack(x) for x in table.column("strings").to_pylist()]
        # each different string once, with its smallest owner
        numbers, smallest, known = [], [], {}
        for own, count, body in zip(owners, windows, bodies):
            at = 0
            for owner, n in zip(own.tolist(), count.tolist()):
                string = body[at : at + n + length - 1]
                at += n + length - 1
                number = known.setdefault(string, len(known))
                if number == len(smallest):
                    smallest.append(owner)
                elif owner < smallest[number]:
                    smallest[number] = owner
                numbers.append(number)
        body = b"".join(known)
        counts = np.array([len(string) - length + 1 for string in known], np.int64)
        first_window = np.cumsum(counts) - counts
        first_byte = first_window + np.arange(len(counts)) * (length - 1)
        starts = np.repeat(first_byte - first_window, counts) + np.arange(counts.sum())
        owner_of = np.repeat(np.array(smallest, np.int64), counts)
        order, group = sort_suffixes(np.frombuffer(body + bytes(WORD), np.uint8), starts, length)
        least = np.full(int(group[-1]) + 1, NO_ID, np.int64)
        np.minimum.at(least, group, owner_of[order])
        best = np.empty(len(order), np.int64)
        best[order] = least[group]
        masks, at = [], 0
        for own, count in zip(owners, windows):
            mine = np.array(numbers[at : at + len(own)], np.int64)
            at += len(own)
            count = count.astype(np.int64)
            offset = np.cumsum(count) - count
            window = np.repeat(first_window[mine] - offset, count) + np.arange(count.sum())
            masks.append(np.packbits(best[window] < np.repeat(own, count)).tobytes())
        return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "mask": pa.array(masks, pa.binary())})

    return answer


def _marked(groups: int, deal: int, length: int, with_kept: bool):
    def mark(batches):
        for row in _rows(batches):
            chunk = Chunk(row["ids"], row["lengths"], row["body"], length)
            (low, high, doc, number), strings, owners, parts = _records(chunk, row["answers"] or [], groups, deal)
            counts = np.array([len(string) - length + 1 for string in strings], np.int64)
            order, offset = np.argsort(parts, kind="stable"), np.cumsum(counts) - counts
            gone = np.zeros(int(counts.sum()), bool)  # windows of each string that a smaller id than its owner has
            for found in row["found"] or []:
                mine = order[np.searchsorted(parts[order], found["part"]) : np.searchsorted(parts[order], found["part"], "right")]
                size = counts[mine]
                bits = np.unpackbits(np.frombuffer(found["mask"], np.uint8), count=int(size.sum())).astype(bool)
                gone[np.repeat(offset[mine] - (np.cumsum(size) - size), size) + np.arange(len(bits))] = bits
            size = high - low + 1
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            bad = gone[np.repeat(offset[number], size) + nth] | np.repeat(chunk.ids[doc] > owners[number], size)
            at = (np.repeat(low, size) + nth)[bad]
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            edge[at] += 1  # windows start at different places
            edge[at + length] -= 1
            covered = np.cumsum(edge)[:-1] > 0
            out = []
            for known, begin, end in zip(chunk.known, chunk.starts.tolist(), chunk.ends.tolist()):
                mine = covered[begin:end]
                removed = int(mine.sum())
                kept = chunk.raw[begin:end] if not removed else chunk.data[begin:end][~mine].tobytes()
                spans = int(mine[:1].sum()) + int((mine[1:] & ~mine[:-1]).sum()) if removed else 0
                out.append((known, end - begin, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), types)], names)

    return mark


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_kept: bool = False, folder: str | None = None) -> DataFrame:
    """Per input row: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (hex, of the remaining bytes put together) and, if asked
    for, those bytes as ``kept``. Strings are judged on the input, overlaps count, and matches never cross documents.

    Null and empty texts have 0 bytes. Null keys count as larger than all others. Rows with equal keys take nothing from each other.
    A repeat within one document stays. ``length`` is from 2 * ANCHOR to 255.
    """
    if not 2 * ANCHOR <= length <= 255:
        raise ValueError(f"length must be from {2 * ANCHOR} to 255")
    spark, folder = docs.sparkSession, folder or work_folder(docs.sparkSession, "repeats")
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    packed = source.mapInArrow(_chunks, "chunk long, ids array<long>, lengths array<long>, body binary, bytes long")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (16 * CHUNK_BYTES)))
    name = f"chunks_{uuid.uuid4().hex}"
    packed.write.bucketBy(buckets, "chunk").option("path", f"{folder}/chunks").saveAsTable(name)
    chunks = spark.table(name)
    per_leader = (length - ANCHOR + 2) / 2
    groups = max(1, round(total / per_leader * KEY_BYTES / GROUP_BYTES))
    asked = chunks.select("chunk", "ids", "lengths", "body").mapInArrow(_asked(groups, length), "part int, chunk long, keys binary")
    answers = stored(asked.groupBy("part").applyInArrow(_answer_keys, "part int, chunk long, mask binary, hits long"), f"{folder}/leaders")
    hits = answers.agg(F.sum("hits")).first()[0] or 0
    deal = max(1, round(hits * (per_leader / 2 + length) / GROUP_BYTES), groups // 4)

    def per_chunk(masks: DataFrame, column: str) -> DataFrame:
        return masks.groupBy(F.col("chunk").alias(f"{column}_chunk")).agg(F.collect_list(F.struct("part", "mask")).alias(column))

    told = per_chunk(answers, "answers")
    informed = chunks.join(told, F.col("chunk") == F.col("answers_chunk"), "left").select("chunk", "ids", "lengths", "body", "answers")
    sent = informed.mapInArrow(_sent(groups, deal, length), "part int, chunk long, owners binary, windows binary, strings binary")
    found = stored(sent.groupBy("part").applyInArrow(_answer_windows(length), "part int, chunk long, mask binary"), f"{folder}/windows")
    final = informed.join(per_chunk(found, "found"), F.col("chunk") == F.col("found_chunk"), "left").select("ids", "lengths", "body", "answers", "found")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = stored(final.mapInArrow(_marked(groups, deal, length, with_kept), schema), f"{folder}/result")
    spark.sql(f"DROP TABLE {name}")
    out = out.withColumnRenamed("id", key)
    return out if with_kept else out.drop("kept")
