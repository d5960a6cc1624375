import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sensorflow.llm import queries
from sensorflow.llm.sharding import read_shards, shard, write_shards


def path_bits(key):
    return bin(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def split(rows, limit, depth=0):
    """rows: (bits, size). Shard name of each distinct bits."""
    if sum(size for _, size in rows) <= limit or len(rows) == 1 or depth == 60:
        return {bits: "b" + bits[:depth] for bits, _ in rows}
    out = {}
    for bit in "01":
        side = [row for row in rows if row[0][depth] == bit]
        if side:
            out.update(split(side, limit, depth + 1))
    return out


@pytest.mark.parametrize("limit", [1_000, 20_000, 10**9])
def test_shards_match_recursive_splitting(spark, sf_dir, given, limit):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("n"))
    found = {r.doc_id: r for r in shard(docs, F.col("doc_id"), F.col("n"), limit).collect()}
    rows = given("SELECT doc_id, strlen(text) FROM documents")
    wanted = split([(path_bits(i), n) for i, n in rows], limit)
    assert {i: r.shard for i, r in found.items()} == {i: wanted[path_bits(i)] for i, _ in rows}
    totals = defaultdict(int)
    for i, n in rows:
        totals[found[i].shard] += n
    assert all(r.shard_bytes == totals[r.shard] and r.shard_depth == len(r.shard) - 1 for r in found.values())
    assert all(r.shard_bytes <= limit or r.shard_rows == 1 for r in found.values())


def test_hot_key_and_identical_rows_are_split(spark):
    hot = spark.range(400).select(F.lit(7).alias("k"), F.lit("same").alias("text")).unionByName(spark.range(300).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("text")))
    found = shard(hot, F.col("k"), F.lit(1), 50).collect()
    assert len(found) == 700
    assert all(r.shard_rows <= 50 for r in found)


def test_odd_rows(odd, clashing, none, tmp_path):
    found = shard(clashing, F.col("doc_id"), F.octet_length("text"), 2_000)
    assert set(clashing.columns) | {"shard", "shard_bytes", "shard_rows", "shard_depth"} == set(found.columns)
    rows = found.collect()
    assert len(rows) == odd.count() and all(r.shard_bytes <= 2_000 or r.shard_rows == 1 for r in rows)
    assert {r.id for r in rows} == {"own id"}
    assert shard(none, F.col("doc_id"), F.octet_length("text"), 10).count() == 0
    write_shards(shard(odd, F.col("doc_id"), F.octet_length("text"), 2_000), f"file://{tmp_path}/out")
    back = odd.sparkSession.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))


def test_the_query_reads_shards_within_the_limit_from_files(spark, sf_dir, given, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(queries, "work_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    found = {r.doc_id: r for r in queries.QUERIES["op1_extendible_sharding"](spark, sf_dir).collect()}
    texts = dict(given("SELECT doc_id, text FROM documents"))
    wanted = split([(path_bits(i), len((text or "").encode())) for i, text in texts.items()], 20_000)
    assert {i: r.shard for i, r in found.items()} == {i: wanted[path_bits(i)] for i in texts}
    written = spark.read.parquet(f"file://{tmp_path}/shards").groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert {r.shard: (r.n or 0, r.rows) for r in written} == {r.shard: (r.shard_bytes, r.shard_rows) for r in found.values()}
    assert len(written) > 5 and all(r.n <= 20_000 or r.rows == 1 for r in written)
    assert {i: r.text for r in spark.read.parquet(f"file://{tmp_path}/shards").collect() for i in [r.doc_id]} == texts


def test_shards_of_odd_rows_are_read_back(odd, tmp_path):
    dealt = shard(odd, F.col("doc_id"), F.octet_length("text"), 2_000)
    write_shards(dealt, f"file://{tmp_path}/out")
    back = read_shards(dealt, f"file://{tmp_path}/out", F.octet_length("text"))
    assert sorted(map(str, back.select(*sorted(dealt.columns)).collect())) == sorted(map(str, dealt.select(*sorted(dealt.columns)).collect()))
