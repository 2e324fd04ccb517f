import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as files
from tokenizers import Tokenizer

from wordloom.llm.packing import Encoder, Plan, best_pattern, cuts, op1_packing, pack


def check(rows, texts):
    slow = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, text in texts.items():
        ids = np.array(slow.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == cuts(len(ids), 2048)
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
    return len(by_seq), sum(r["length"] for r in rows)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    sequences, tokens = check(op1_packing(spark, d).collect(), texts)
    assert sequences <= 1.02 * -(-tokens // 2048) + 1


def test_odd_rows(spark, odd):
    rows = pack(odd.withColumn("sequence_id", odd.doc_id).withColumn("piece", odd.text)).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    check(rows, {r["doc_id"]: r["text"] for r in odd.filter("doc_id > 1").collect()})
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert pack(odd.limit(0)).count() == 0


def test_ids_match_the_tokenizers_library():
    e = Encoder()
    for text in ("Ça va? l'été 12 345\n\n\t  x", "don't  stop<|endoftext|>", "漢字 кот", "", " " * 50, "!!!\r\n"):
        assert e(text).tolist() == e.plain(text)


def test_the_query_takes_the_librarys_default_for_special_tokens(spark, tmp_path):
    text = "one <|endoftext|> two"
    spark.createDataFrame([(1, text), (2, "漢字" + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    for r in op1_packing(spark, str(tmp_path)).collect():
        ids = library.encode(text if r["doc_id"] == 1 else "漢字" + text, add_special_tokens=False).ids + [0]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and 50256 in ids


def test_tiny_tables_take_the_fewest_sequences():
    """Against all partitions of a few pieces."""
    rng = np.random.default_rng(8)

    def fewest(left, rooms, most):
        if not left:
            return len(rooms)
        best = most
        for i in range(len(rooms)):
            if rooms[i] >= left[0] and rooms.index(rooms[i]) == i:
                best = min(best, fewest(left[1:], [r - left[0] * (j == i) for j, r in enumerate(rooms)], best))
        return min(best, fewest(left[1:], [*rooms, 2048 - left[0]], best)) if len(rooms) + 1 < best else best

    total = least = 0
    for _ in range(60):
        lengths = sorted(rng.integers(200, 1500, 8).tolist(), reverse=True)
        p = Plan(dict(zip(*map(list, map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))))
        want = fewest(lengths, [], 9)
        assert want <= p.sequences <= want + 1
        total, least = total + p.sequences, least + want
    assert total <= 1.05 * least


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for n, top in ((1, 2047), (50, 2047), (3000, 2047), (3000, 100), (500, 1200)):
        counts = dict(zip(*map(list, map(np.ndarray.tolist, np.unique(rng.integers(1, top + 1, n), return_counts=True)))))
        p = Plan(counts)
        ranks, room = defaultdict(list), defaultdict(list)
        for length, rank, k, sequence, offset in p.rows:
            for i in range(k):
                ranks[length].append(rank + i)
                room[sequence + i].append((offset, length))
        assert {length: sorted(r) for length, r in ranks.items()} == {length: list(range(k)) for length, k in counts.items()}
        for own in room.values():
            assert all(a + b == c for (a, b), (c, _) in zip(sorted(own), sorted(own)[1:])) and sum(x for _, x in own) <= 2048
        assert set(room) == set(range(p.sequences))


def test_best_pattern_is_the_knapsack():
    sizes, values = np.array([700, 900, 1100]), np.array([0.34, 0.45, 0.56])
    value, pattern = best_pattern(sizes, values, 2048)
    assert round(value, 6) == 1.01 and (pattern @ sizes) <= 2048
