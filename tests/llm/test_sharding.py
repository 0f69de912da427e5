import hashlib
import math
import zlib

from tallyforge.llm import sharding
from tallyforge.llm.sharding import Topology, assign


def test_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 25 < len(slots) < 110
    odd_rows = sharding.shard_documents(odd).collect()
    assert len(odd_rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in odd_rows if r.doc_id == 2} == {(1, 0)}
    assert len({r.shard for r in odd_rows if r.doc_id == 6}) == 1
    assert sharding.shard_documents(none).count() == 0


def test_a_weight_moves_keys_only_into_or_out_of_its_subtree(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    old, new = Topology.of(16), Topology.of(16).reweighted(5, 3.0)
    rows = assign(assign(keys, "k", old, "a"), "k", new, "b").collect()
    moved = [r for r in rows if r.a != r.b]
    # shard 5 is in region 0, rack 1 (shards 4-7): moves end in region 0, and those within region 0 end in rack 1
    assert moved and all(r.b < 8 for r in moved)
    assert all(4 <= r.b < 8 for r in moved if r.a < 8) and all(r.b == 5 for r in moved if 4 <= r.a < 8)
    share = sum(r.b == 5 for r in rows) / len(rows)
    assert abs(share - 3 / 18) < 0.02
    gone = Topology.of(16).reweighted(9, 0.0)
    assert all(r.b != 9 for r in assign(keys, "k", gone, "b").collect())


def test_slots_over_many_slices(spark):
    same = spark.range(3000).selectExpr("5L as k", "cast(id % 3 as int) as s")  # equal rows, in three shards
    rows = sharding.number_slots(same, "s", ["k"], per_slice=40).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.s == s) == list(range(1000))


def test_draws_are_recomputed(spark):
    """The tree's rule written out in plain Python: at each level the child with the least -ln(u) / weight."""
    topo = Topology.of(16).reweighted(5, 3.0)

    def child(key, level, above):
        weights = {}
        for leaf in topo.leaves:
            if leaf[:level] == above and leaf[3] > 0:
                weights[leaf[level]] = weights.get(leaf[level], 0) + leaf[3]
        if len(weights) == 1:
            return next(iter(weights))

        def draw(n):
            digest = hashlib.md5(f"{topo.seed}|{level}|{n}|{key}".encode()).hexdigest()
            return -math.log((int(digest[:12], 16) + 0.5) / 2**48) / weights[n]

        return min(weights, key=lambda n: (draw(n), n))

    for r in assign(spark.range(500).withColumnRenamed("id", "k"), "k", topo, "b").collect():
        region = child(r.k, 0, ())
        rack = child(r.k, 1, (region,))
        assert r.b == child(r.k, 2, (region, rack))


def test_no_python_in_the_plan(spark, odd):
    assert "Python" not in sharding.shard_documents(odd)._jdf.queryExecution().executedPlan().toString()
