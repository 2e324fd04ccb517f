import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import neardup as n


def brute(texts, percent=85):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle, on strings."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_query_is_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.op9_near_duplicates(spark, d).collect()}
    assert got == brute(texts)


def test_a_crowd_of_edited_copies(spark):
    rng, base, rows = random.Random(9), [f"w{i}" for i in range(150)], []
    for d in range(150):
        own = list(rng.choice(rows)[1].split() if rows and rng.random() < 0.6 else base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute(dict(rows)).items()}


def test_borderline_pairs(spark):
    rng, rows = random.Random(5), []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 40, 200, 600]))]
        rows.append((3 * k, " ".join(words)))
        for j in (1, 2):
            own = list(words)
            for _ in range(max(1, len(own) // rng.choice([60, 70, 80, 100]))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((3 * k + j, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(dict(rows))
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert got == want


@pytest.mark.parametrize("percent", [85, 80])
def test_recall_at_the_threshold(spark, percent):
    """Pairs of sets, each alone with its copy, just similar enough: the share that is linked."""
    rng, rows = random.Random(percent), []
    size = 1000
    new = -(-size * (100 - percent) // (100 + percent)) - 1  # words at the end that differ: as many shingles
    for k in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(size + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: size + 4 - new] + [f"x{rng.randrange(10**9)}" for _ in range(new)]))]
    a, b = (set(zip(*[rows[i][1].split()[j:] for j in range(5)])) for i in (0, 1))
    assert percent <= 100 * len(a & b) / len(a | b) < percent + 0.5
    got = n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).filter("not kept").count()
    assert got >= 0.99 * 400


@pytest.mark.parametrize("size", [200, 10**6, 10**9])
def test_layout_follows_the_number_of_documents(size):
    chunks, width = n.layout(size, 85)
    assert 2**width >= size * 2**n.ROOM and (1 - (0.85 + 0.15 / 2**n.BITS) ** (width // n.BITS)) ** chunks <= n.MISS


def test_all_pairs_up_to_the_distance_share_a_key(spark):
    rng = np.random.default_rng(1)
    chunks, width, distance = 4, 10, 7
    a = rng.integers(0, 2, (400, chunks * width))
    b = a.copy()
    for row in b:
        row[rng.permutation(chunks * width)[: rng.integers(0, distance + 1)]] ^= 1
    word = lambda bits: [int(sum(int(x) << i for i, x in enumerate(bits[w * 30 : w * 30 + 30]))) for w in range(2)]
    rows = [(i, *word(x)) for i, x in enumerate(a)] + [(i + 1000, *word(x)) for i, x in enumerate(b)]
    nodes = spark.createDataFrame(rows, "node long, s0 long, s1 long")
    left = n.bucket_rows(nodes, ["node"], chunks, width, None)
    right = n.bucket_rows(nodes, [F.col("node").alias("other")], chunks, width, distance)
    found = {(r[0], r[1]) for r in left.join(right, "key").filter("other = node + 1000").select("node", "other").distinct().collect()}
    assert len(found) == 400


def test_odd_rows(spark, odd):
    rows = n.near_duplicates(odd.withColumn("kept", odd.n_chars).withColumn("s0", odd.text)).collect()
    assert len(rows) == odd.count() and {"kept_in", "s0_in"} <= set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["component_id"] == 7 and not by[8]["kept"] and by[7]["kept"]
    assert by[1]["component_id"] == 1 and by[1]["n_shingles"] == 0 and by[3]["kept"] and by[None]["kept"]
    assert n.near_duplicates(odd.limit(0)).count() == 0
