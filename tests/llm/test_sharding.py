"""Shards against the splitting rule, applied bucket by bucket in plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from runledger.llm import sharding


def _hash(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)


def _brute(rows, limit):
    out, open_ = {}, [("", rows)]
    while open_:
        prefix, members = open_.pop()
        if sum(b for _, b in members) <= limit or len({h for h, _ in members}) == 1:
            out.update({h: prefix for h, _ in members})
            continue
        halves = defaultdict(list)
        for h, b in members:
            halves[h >> (59 - len(prefix)) & 1].append((h, b))
        open_ += [(prefix + str(bit), part) for bit, part in halves.items()]
    return out


@pytest.mark.parametrize("limit", [120, 400, 10**6])
def test_same_buckets_as_splitting_one_by_one(spark, limit):
    rows = [(i, "x" * (i % 37)) for i in range(300)] + [(None, "null key"), (5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit(1)).withColumn("shard", F.lit(2))
    got = {r.doc_id: r for r in sharding.shards(df, limit=limit).collect()}
    want = _brute([(_hash(k), len(t or "") + 16) for k, t in rows], limit)
    assert {k: r.shard for k, r in got.items()} == {k: want[_hash(k)] for k, _ in rows}
    assert all(r.shard_bytes <= limit and r.page is None and r.depth == len(r.shard) for r in got.values())


def test_a_hot_key_is_dealt_over_pages_that_fit(spark):
    rows = [(7, "y" * 10)] * 500 + [(7, "z" * 900)] + [(i, "x") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shards(df, limit=260).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(list)
    for r in got:
        sizes[r.shard, r.page].append(r.n_bytes)
    assert all(sum(v) <= 260 or len(v) == 1 for v in sizes.values())


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i % 40, "t" * i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, page int")
    sharding.write_shards(df, f"{tmp_path}/out", limit=600)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "page").collect()) == sorted(rows)


def test_empty_table(spark):
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
