import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from wordloom.llm.common import Scratch
from wordloom.llm.sharding import assign, build_tree, grow, numbered, op3_sharding


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r[0]: (r[1] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows, slots = op3_sharding(spark, d).collect(), defaultdict(list)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_movement_is_confined(spark):
    tree, keys = build_tree(), spark.range(40000)
    tree[0][0][1] = 3.0
    before, after = ({r["id"]: (r["region"], r["shard"]) for r in assign(keys, F.col("id"), t).collect()} for t in (build_tree(), tree))
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(after[k][0] == 0 for k in moved)  # only into the subtree whose weight grew
    n = sum(v[1] == 1 for v in after.values())
    assert abs(n - 40000 * 3 / 26) < 350
    grown = {r["id"]: r["shard"] for r in assign(keys, F.col("id"), grow(build_tree())).collect()}
    assert all(grown[k] in (before[k][1], 24) for k in grown) and abs(sum(v == 24 for v in grown.values()) - 1600) < 200


def test_odd_rows(spark, odd):
    rows = numbered(assign(odd.withColumn("region", F.lit("x")), F.col("doc_id"), build_tree()), Scratch(spark, "t")).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert numbered(assign(odd.limit(0), F.col("doc_id"), build_tree()), Scratch(spark, "t")).count() == 0
