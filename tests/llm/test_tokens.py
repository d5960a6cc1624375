import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorflow.llm import packing, token_files, tokens
from sensorflow.llm.queries import END_ID, QUERIES

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["a", "Bc", " ", "  ", "\n", "é", "'s", "'", "1", "23", "\x1c", "\xa0", "́", "Σ", "İ", "ß", "漢", "\U0001f642", "<|endoftext|>", "\x85", "\t", ".", "_", "K", "क़", "#", "-"]


def plain(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole_text(name, given, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 100)
    rng, encoder, whole = random.Random(4), tokens.Encoder(public_tokenizers.path(name)), plain(name)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(3_000)] + [text for (text,) in given("SELECT text FROM documents LIMIT 60")]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(text)


def by_key(rows, ids):
    start, out = 0, []
    for key, text in sorted(rows, key=lambda row: (row[0] is not None, row[0])):
        found = [*ids(text), END_ID]
        out.append((key, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    return out


def test_token_files_query(spark, sf_dir, given):
    wanted = by_key(given("SELECT doc_id, text FROM documents"), plain("word_bpe_49k.json"))
    assert sorted(map(tuple, QUERIES["op10_token_files"](spark, sf_dir).collect())) == wanted


def test_token_files_of_odd_rows(clashing, odd, none, spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    index = token_files.write_tokens(clashing, f"file://{tmp_path}/t", path, end=END_ID, partitions=4)
    rows = sorted(token_files.read_documents(spark, f"file://{tmp_path}/t", with_ids=True).collect(), key=lambda r: r.start)
    ids = plain("word_bpe_49k.json")
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == sorted((str(r.doc_id), (*ids(r.text), END_ID)) for r in odd.collect())
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    part = index.orderBy(F.col("n_docs").desc()).first()
    ids_, offsets, _ = token_files.open_part(f"file://{tmp_path}/t", part.part, part.dtype)
    assert isinstance(ids_, np.memmap) and offsets[-1] == len(ids_) == part.n_tokens
    token_files.write_tokens(none, f"file://{tmp_path}/none", path)
    assert token_files.read_documents(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(none, "hdfs://somewhere/t", path)


def check_packing(rows, texts, capacity=packing.CAPACITY):
    """Every id of every document is placed once, sequences are gapless and not too long."""
    ids, pieces, sequences = plain("byte_bpe_50k.json"), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.piece, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key in {key for key, _ in texts}:
        wanted = []
        for other, text in texts:
            if other == key:
                whole = [*ids(text), END_ID]
                short = len(whole) % capacity  # only the first piece may be shorter
                starts = [0] * (short > 0) + list(range(short, len(whole), capacity))
                cut = [(a, whole[a:b]) for a, b in zip(starts, [*starts[1:], len(whole)])]
                wanted += [(a, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for i, (a, part) in enumerate(cut)]
        assert sorted(pieces[key]) == sorted(wanted)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_packing_query(spark, sf_dir, given):
    used, total = check_packing(QUERIES["op9_certified_packing"](spark, sf_dir).collect(), given("SELECT doc_id, text FROM documents"))
    assert used <= -(-total // packing.CAPACITY) * 1.01 + 1


def test_packing_of_odd_rows(odd, clashing, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(clashing, path, end=END_ID, with_ids=True).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(none, path).count() == 0


def test_partitions_exchange_documents_until_few_bins_are_left(spark, tmp_path):
    """Many partitions, each with a bin left half empty: repacking comes close to packing all documents in one partition."""
    lengths = np.random.default_rng(5).integers(20, 700, 4_000)
    items = spark.createDataFrame([(i, i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECE)
    used = packing.place(items, f"file://{tmp_path}/p", per_partition=250).select("sequence_id").distinct().count()
    alone = sum(int(packing.best_fit_decreasing(lengths[i::16], 1024)[0].max()) + 1 for i in range(16))
    together = int(packing.best_fit_decreasing(lengths, 1024)[0].max()) + 1
    assert packing.lower_bound(lengths, 1024) <= used < alone
    assert used <= together + 5


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(6)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 40))
        if rng.random() < 0.5:
            lengths = rng.choice([34, 51, 26, 100, 50], len(lengths))
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= bins.max() + 1
        assert np.bincount(bins, weights=lengths).max() <= 100
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
