"""Phrase collocations by HAT-trie counting.

1. Every task counts the word sequences of its texts in a HAT-trie over word ids of its own. When it is full, whole subtrees are spilled
   as sorted runs, one for each prefix partition (a hash of language and first two words), with their words spelled out.
2. The runs of a prefix partition are merged: sequences get their counts over all texts. Only those that are frequent enough go on;
   parts of a frequent sequence are frequent, too.
3. Cuts are scored, contained phrases dropped and ranks given by joins on frequent sequences.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.llm.hat_trie import HatTrie
from sensorflow.llm.shingles import MIX, mixed
from sensorflow.llm.staging import stored, work_folder, worker_memo

NO_LANG = "und"
END = b"."
# Upper-case letters are folded, ends of pieces become one sign of their own; ASCII white space is left to split().
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
BLOCK_WORDS = 1 << 19
SLICE_BYTES = 1 << 20
TRIE_ENTRIES = 3 << 19
TEXT_PER_PART = 8 << 20
HEAVY_SHARE = 10_000


def slices(text: bytes):
    """The text in parts of about SLICE_BYTES, cut at a blank."""
    first = 0
    while len(text) - first > SLICE_BYTES:
        end = text.find(b" ", first + SLICE_BYTES)
        if end < 0:
            break
        yield text[first:end]
        first = end
    yield text[first:]


class Vocabulary:
    """Word ids from 1 by language and word, in order of appearance; END has id 0."""

    def __init__(self):
        self.words, self.hashes, self.languages = [b""], array("Q", [0]), {}

    def __len__(self) -> int:
        return len(self.words)

    def language(self, name: str):
        """The function from word to id in one language."""
        if name not in self.languages:
            self.languages[name] = _Language(self, name.encode().hex().encode() + b"\t")
        return self.languages[name].__getitem__


class _Language(dict):
    def __init__(self, vocabulary: Vocabulary, prefix: bytes):
        super().__init__({END: 0})
        self.vocabulary, self.prefix = vocabulary, prefix

    def __missing__(self, word: bytes) -> int:
        spelled, known = self.prefix + word, self.vocabulary
        self[word] = number = len(known.words)
        known.words.append(spelled)
        known.hashes.append(xxhash.xxh64_intdigest(spelled))
        return number


def _packed_run(words: list[bytes], columns: list[np.ndarray], counts: np.ndarray, place: np.ndarray, pack) -> tuple[bytes, bytes, bytes]:
    """Words in order, then sequences as places in them (from 1, 0 for no word), then counts. ``place`` is a scratch array as long as ``words``."""
    place[:] = 0
    for column in columns:
        place[column] = 1
    place[0] = 0
    used = np.flatnonzero(place)
    place[used] = np.arange(1, len(used) + 1)
    places = [place[column].tobytes() for column in columns]
    return pack(b"\n".join([words[i] for i in used.tolist()])), pack(b"".join(places)), pack(counts.astype("<i8").tobytes())


def _counted(longest: int, parts: int, entries: int, most_ids: int | None = None):
    def count(batches):
        worker_memo().clear()
        pack = zstandard.ZstdCompressor(level=1).compress
        trie, vocabulary, ids = HatTrie(longest), Vocabulary(), array("q")
        max_id = trie.max_id if most_ids is None else most_ids

        def take(final: bool = False):
            if final:
                ids.extend([0] * (longest - 1))
            trie.add(np.array(ids, np.int64))
            del ids[: max(0, len(ids) - longest + 1)]

        def runs(keep: int):
            keys, counts = trie.spill(keep)
            if not len(keys):
                return
            columns = trie.columns(keys)
            order = sorted(range(1, len(vocabulary)), key=vocabulary.words.__getitem__)
            rank = np.zeros(len(vocabulary), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            words = [b"", *[vocabulary.words[i] for i in order]]
            hashes = np.frombuffer(vocabulary.hashes, np.uint64)
            prefix = mixed(hashes[columns[0]])
            if longest > 1:
                prefix = np.where(columns[1] > 0, mixed(prefix * MIX[0] + hashes[columns[1]]), prefix)
            part = ((prefix >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            columns = [rank[column] for column in columns]
            order = np.argsort(_joined(columns, trie.bits))
            order = order[np.argsort(part[order].astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")]
            place = np.zeros(len(words), "<u4")
            limits = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            for p, (first, last) in enumerate(zip(limits, limits[1:])):
                if first < last:
                    mine = order[first:last]
                    run = _packed_run(words, [column[mine] for column in columns], counts[mine], place, pack)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([last - first], pa.int64()), *[pa.array([x], pa.binary()) for x in run]], ["part", "n", "words", "places", "counts"]
                    )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                number = vocabulary.language(lang)
                for piece in slices(text or b""):
                    ids.extend(map(number, piece.translate(FOLD).replace(END, b" . ").split()))
                    if len(ids) >= BLOCK_WORDS:
                        take()
                        if len(trie) > entries:
                            yield from runs(entries // 2)
                        if len(vocabulary) + BLOCK_WORDS + SLICE_BYTES // 2 > max_id:
                            # All ids could be used before the next block; words not yet counted get ids of a new vocabulary.
                            yield from runs(0)
                            open_, old = ids.tolist(), vocabulary
                            vocabulary = Vocabulary()
                            number = vocabulary.language(lang)
                            ids = array("q", [number(old.words[i].split(b"\t", 1)[1]) if i else 0 for i in open_])
                ids.append(0)
        take(final=True)
        yield from runs(0)

    return count


def _joined(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """One number per sequence, in the order of the sequences; ranks stand for first parts where the bits do not suffice."""
    key = columns[0]
    for column in columns[1:]:
        if int(key.max()).bit_length() + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
        key = key << bits | column
    return key


def _merged(longest: int, least: int):
    def merge(table: pa.Table) -> pa.Table:
        """Frequent sequences of one prefix partition, and a row of size 0 per language with its number of words."""
        unpack = zstandard.ZstdDecompressor().decompress
        words = [unpack(x).split(b"\n") for x in table.column("words").to_pylist()]
        known = sorted(set().union(*words))
        place = {word: i for i, word in enumerate(known, 1)}
        columns = []
        for mine, places in zip(words, table.column("places").to_pylist()):
            here = np.array([0, *map(place.__getitem__, mine)], np.int64)
            columns.append(here[np.frombuffer(unpack(places), "<u4").reshape(longest, -1)])
        columns = np.concatenate(columns, axis=1)
        counts = np.concatenate([np.frombuffer(unpack(x), "<i8") for x in table.column("counts").to_pylist()])
        key = _joined(list(columns), len(known).bit_length())
        order = np.argsort(key, kind="stable")  # merges the sorted runs
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total, columns = np.add.reduceat(counts[order], begins), columns[:, order[begins]]

        single = np.flatnonzero(columns[1] == 0) if longest > 1 else np.arange(len(total))
        spoken = {}
        for i, n in zip(columns[0, single].tolist(), total[single].tolist()):
            lang = known[i - 1].split(b"\t", 1)[0]
            spoken[lang] = spoken.get(lang, 0) + n
        rows = [(lang, None, 0, n) for lang, n in spoken.items()]
        often = np.flatnonzero(total >= least)
        for sequence, n in zip(columns[:, often].T.tolist(), total[often].tolist()):
            spelled = [known[i - 1].split(b"\t", 1) for i in sequence if i]
            rows.append((spelled[0][0], b" ".join([word for _, word in spelled]), len(spelled), n))
        names = {lang: bytes.fromhex(lang.decode()).decode() for lang in {row[0] for row in rows}}
        return pa.table(
            {
                "lang": pa.array([names[row[0]] for row in rows], pa.string()),
                "phrase": pa.array([row[1] and row[1].decode() for row in rows], pa.string()),
                "size": pa.array([row[2] for row in rows], pa.int32()),
                "f": pa.array([row[3] for row in rows], pa.int64()),
            }
        )

    return merge


def count_phrases(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text", folder: str | None = None, entries: int = TRIE_ENTRIES, text_per_part: int = TEXT_PER_PART) -> DataFrame:
    """lang, phrase (words joined by a blank), size (words), f for all sequences of 1 to ``longest`` words that occur at least ``least`` times
    in a language; rows of size 0 add up to its number of word occurrences. Phrases lie within pieces, overlaps count. ``longest`` is from 1 to 3."""
    if not 1 <= longest <= 3:
        raise ValueError("longest must be from 1 to 3")
    spark, folder = docs.sparkSession, folder or work_folder(docs.sparkSession, "phrases")
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // text_per_part))
    runs = source.mapInArrow(_counted(longest, parts, entries), "part int, n long, words binary, places binary, counts binary")
    return stored(runs.groupBy("part").applyInArrow(_merged(longest, least), "lang string, phrase string, size int, f long"), f"{folder}/counted")


def _span(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def with_cut(candidates: DataFrame, parts: DataFrame, longest: int) -> DataFrame:
    """Candidates (lang, phrase, size, f) with l, r and score of their lowest-scoring cut, equal ones at the smallest place.

    ``parts`` has the counts of all shorter phrases. Those with at least one HEAVY_SHAREth of all occurrences, so at most that many of each
    size, are broadcast; a part that is left is looked up by few candidates, in proportion to its own count, and joined by shuffle.
    """
    words = F.split("phrase", " ")
    sides = F.array(
        F.struct(F.lit("l").alias("side"), _span(words, F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _span(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    cuts = candidates.select("lang", "phrase", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "f", "k", F.explode(sides).alias("s")).select("lang", "phrase", "size", "f", "k", "s.side", "s.part")
    spoken = parts.filter("size = 0").agg(F.sum("f")).first()[0] or 0
    least = spoken / HEAVY_SHARE
    count = parts.filter("size > 0").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("f").alias("n"))
    same = (F.col("lang") == F.col("p_lang")) & (F.col("part") == F.col("p_phrase"))
    first = cuts.join(F.broadcast(count.filter(F.col("n") >= least)), same, "left").drop("p_lang", "p_phrase")
    rest = first.filter("n IS NULL").drop("n").join(count.filter(F.col("n") < least), same).drop("p_lang", "p_phrase")
    found = first.filter("n IS NOT NULL").unionByName(rest)
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n"))).alias(f"{side}{k}")
    gathered = found.groupBy("lang", "phrase", "size", "f").agg(*[of(k, side) for k in range(1, longest) for side in "lr"])
    exact = lambda name: f"cast({name} AS decimal(16, 0))"  # noqa: E731  products up to 38 digits
    scored = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(F.expr(f"({exact('f')} * {exact('f')} * 1000000BD) div ({exact(f'l{k}')} * {exact(f'r{k}')})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")),
        )
        for k in range(1, longest)
    ]
    lowest = F.array_min(F.array(*scored))
    return gathered.withColumn("lowest", lowest).select("lang", "phrase", "size", "f", "lowest.l", "lowest.r", "lowest.score")


def not_contained(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates but those whose words lie contiguously in a longer one with at least ``percent`` of their count."""
    words, size = F.split("phrase", " "), F.col("size")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _span(words, i, n))))
    longer = candidates.filter("size > 2").select(F.col("lang").alias("i_lang"), F.explode(inner).alias("i_phrase"), F.col("f").alias("outer"))
    largest = longer.groupBy("i_lang", "i_phrase").agg(F.max("outer").alias("outer"))
    joined = candidates.join(largest, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("i_phrase")), "left")
    return joined.filter(F.col("outer").isNull() | (100 * F.col("outer") < percent * F.col("f"))).select(*candidates.columns)


def first_ranks(scored: DataFrame, first: int) -> DataFrame:
    """The first rows of each language by score, count and phrase; each language is ranked in salted groups before."""
    order = [F.desc("score"), F.desc("f"), "phrase"]
    groups = math.isqrt(scored.count() // first) + 1  # groups and what is left of them are about equally large
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= first).drop("rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= first)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, first: int = 2000, lang: str = "lang", text: str = "text", folder: str | None = None, **limits) -> DataFrame:
    """Per language its ``first`` phrases of 2 to ``longest`` words by score, count and UTF-8 bytes: lang, rank, phrase, a (its count), l, r (counts of the
    parts of its lowest-scoring cut), n (all words of the language), score = floor(10^6 a^2 / (l r)).

    Phrases occur at least ``least`` times and do not lie in a longer such phrase with at least ``percent`` of their count. Words are what blanks and tabs
    separate in pieces, A-Z lower-cased; pieces end at ``. , ; : ! ?`` and line ends. Null texts are empty, a null language is ``und``. Repeated rows count
    as often as they occur; extra columns are left out; an empty table gives no row. Counts up to 10^16 are scored exactly.
    A task holds one text and one prefix partition, whatever their number.
    """
    folder = folder or work_folder(docs.sparkSession, "phrases")
    counted = count_phrases(docs, longest, least, lang, text, folder, **limits)
    candidates = counted.filter("size > 1")
    scored = stored(with_cut(not_contained(candidates, percent), counted.filter(F.col("size") < longest), longest), f"{folder}/scored")
    spoken = counted.filter("size = 0").groupBy(F.col("lang").alias("s_lang")).agg(F.sum("f").alias("n"))
    ranked = first_ranks(scored, first).join(spoken, F.col("lang") == F.col("s_lang"))
    return ranked.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
