"""Exact sizes of the literal encodings, from histograms.

raw: a tag and the words at 1, 2 or 4 bytes; bitpack: a tag, a width and the words at
it; huffman: a header of 13 bytes, 5 bytes a symbol, and code bits. The smallest wins,
and the lower tag among equals.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
TAGS = {"raw": 0, "bitpack": 1, "huffman": 2, "rans": 3}
HEADER, HUFFMAN_ENTRY, RANS_ENTRY, RANS_LANES = 13, 5, 8, 4
MOST_SYMBOLS = {"huffman": 1 << 16, "rans": 1 << 14}


def storage(bits: int) -> int:
    return 1 if bits <= 8 else 2 if bits <= 16 else 4


def entropy(hist: DataFrame, keys: list[str]) -> DataFrame:
    """A bound in bytes that no code of single words beats. Sums are rounded to 1e-6 bits before the floor."""
    n = hist.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    both = hist.join(n, keys) if keys else hist.crossJoin(F.broadcast(n))  # a single row
    return both.groupBy(*keys).agg((F.floor(F.round(F.sum(-F.col("cnt") * F.log2(F.col("cnt") / F.col("n"))), 6) / 8) - 1).cast("bigint").alias("entropy_bytes"))


def sizes(hist: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """n, symbols, raw and bitpack of each stream."""
    width = F.greatest(F.lit(1), F.length(F.bin(F.max("word"))))
    one = hist.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.count("*").alias("symbols"), width.alias("width"))
    return one.select(*keys, "n", "symbols", (1 + F.col("n") * storage(bits)).alias("raw"), (2 + F.floor((F.col("n") * F.col("width") + 7) / 8)).cast("bigint").alias("bitpack"))


def best(sized: DataFrame, keys: list[str], codecs: list[str]) -> DataFrame:
    """bytes and codec of the smallest; sizes that are null don't apply."""
    options = F.array(*[F.struct(F.col(c).alias("bytes"), F.lit(TAGS[c]).alias("tag"), F.lit(c).alias("codec")) for c in codecs])
    won = F.array_min(F.filter(options, lambda o: o["bytes"].isNotNull()))
    return sized.select(*keys, won["bytes"].cast("bigint").alias("bytes"), won["codec"].alias("codec"))


def code_lengths(counts: list[tuple[int, int]]) -> dict[int, int]:
    """Code length of each symbol. ``counts`` is in ascending order of symbols; equal weights merge in order of making."""
    if len(counts) == 1:
        return {counts[0][0]: 1}
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(counts)]
    heapq.heapify(heap)
    out, made = dict.fromkeys((s for s, _ in counts), 0), len(heap)
    parent: dict[int, list] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[made] = [a, b]
        heapq.heappush(heap, (a[0] + b[0], made, ()))
        made += 1
    todo = [(heap[0], 0)]
    while todo:
        (_, i, own), depth = todo.pop()
        if i in parent:
            todo += [(x, depth + 1) for x in parent[i]]
        else:
            out[own[0]] = depth
    return out


def code_sizes(hist: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys and huffman: null where it doesn't apply. A stream's histogram has at most 65,536 rows where it does."""
    types = ", ".join(f"{k} {hist.schema[k].dataType.simpleString()}" for k in keys)
    few = hist.groupBy(*keys).agg(F.count("*").alias("symbols")).filter(F.col("symbols") <= MOST_SYMBOLS["huffman"])

    def run(pdf):
        import pandas as pd

        counts = sorted(zip(pdf["word"].tolist(), pdf["cnt"].tolist()))
        length = code_lengths(counts)
        bits_ = sum(length[s] * n for s, n in counts)
        size = HEADER + HUFFMAN_ENTRY * len(counts) + (bits_ + 7) // 8 if max(length.values()) <= 32 else None
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "huffman": [size]})

    return hist.join(few.drop("symbols"), keys, "left_semi").groupBy(*keys).applyInPandas(run, f"{types}, huffman bigint")
