"""Streams of words as DataFrames: optional keys, pos (from 0, gapless) and word.

Positions and running results of a stream without keys are made in two phases: blocks
are counted or summed in parallel, a table of blocks is scanned, and each block starts
with what comes before it. No task holds the stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions.words import cut, merge

#: Positions in a block of a running result.
BLOCK = 1 << 16
#: Rows in a range that positions are counted in, ranges at most (their bounds are a table of one row), rows sampled for a range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 1 << 20, 1 << 14, 32
#: Streams of so many ranges or fewer are cut by their first column alone.
FEW = 64


def _blocks(df: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """Rows with block, their range by the whole of its order, from a sample that is bounded by the number of ranges.

    Bounds are a local table, so that a lost task is done again with the same ranges. They
    are looked up in two steps, in lists of about the root of their number.
    """
    n = df.count()
    ranges = ranges or min(MOST_RANGES, max(df.sparkSession.sparkContext.defaultParallelism if n > BLOCK else 1, -(-n // RANGE_ROWS)))
    whole = df.withColumn("block", F.lit(0))
    if ranges < 2 or not n:
        return whole
    drawn = df.select(*order).sample(min(1.0, SAMPLED * ranges / n), seed=7)
    rows = drawn.orderBy(*order).collect()  # about SAMPLED * ranges rows
    bounds = list(dict.fromkeys(rows[i * len(rows) // ranges] for i in range(1, ranges))) if rows else []
    if not bounds:
        return whole
    k = math.isqrt(len(bounds)) + 1
    lists = [bounds[i : i + k] for i in range(0, len(bounds), k)]
    schema = T.StructType([T.StructField("__lists", T.ArrayType(T.ArrayType(drawn.schema)))])
    own, near = F.struct(*order), F.col("__at") - 1
    both = df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(lists,)], schema)))  # a single row
    both = both.withColumn("__at", F.size(F.filter("__lists", lambda x: x[0] < own)))
    block = F.when(F.col("__at") == 0, 0).otherwise(near * k + F.size(F.filter(F.get("__lists", near), lambda x: x < own)))
    return both.withColumn("block", block).drop("__lists", "__at")


def stream(df: DataFrame, word: Column, order: list[str], keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """keys, pos, word. ``order`` must be unique (within the keys), its first column a number if there are no keys.

    Ranges follow the number of rows unless given.
    """
    keys = keys or []
    if keys:
        pos = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
        return df.select(*keys, pos.cast("bigint").alias("pos"), word.cast("bigint").alias("word"))
    if ranges is None and df.count() <= FEW * RANGE_ROWS:  # a range can't be large: by the first column, bounds in the plan
        bounds = sorted(set(df.approxQuantile(order[0], [i / FEW for i in range(1, FEW)], 0.005)))
        block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order[0]))) if bounds else F.lit(0)
        rows = df.select(*order, word.cast("bigint").alias("word"), block.alias("block"))
    else:
        rows = _blocks(df.select(*order, word.cast("bigint").alias("__word")), order, ranges).withColumnRenamed("__word", "word")
    starts = rows.groupBy("block").agg(F.count("*").alias("n")).select("block", (F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    at = F.row_number().over(W.partitionBy("block").orderBy(*order)) - 1
    return rows.join(F.broadcast(starts), "block").select((F.col("start") + at).alias("pos"), "word")  # at most MOST_RANGES rows


def _running(op: str):
    return {"xor": F.bit_xor, "add_mod": F.sum}[op]


def scan(s: DataFrame, op: str, bits: int, initial: int | None = None, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Running xor or sum, modulo 2^bits. ``initial`` is put in front of the updates; without it the first word is its own."""
    keys, run = keys or [], _running(op)
    if initial is not None:
        first = (s.select(*keys).distinct() if keys else s.sparkSession.range(1).select()).select(*keys, F.lit(0).cast("bigint").alias("pos"), F.lit(initial).cast("bigint").alias("word"))
        s = s.select(*keys, (F.col("pos") + 1).alias("pos"), "word").unionByName(first)
    local = W.partitionBy(*keys, "__block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("__block", F.floor(F.col("pos") / block))
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    totals = s.groupBy(*keys, "__block").agg(cut(run("word"), bits).alias("__total"))
    carry = totals.select(*keys, "__block", F.coalesce(cut(run("__total").over(before), bits), F.lit(0).cast("bigint")).alias("__carry"))
    inside = run("word").over(local)
    total = inside.bitwiseXOR(F.col("__carry")) if op == "xor" else inside + F.col("__carry")
    return s.join(carry, [*keys, "__block"]).select(*keys, "pos", cut(total, bits).alias("word"))


def scan_inverse(s: DataFrame, op: str, bits: int, keys: list[str] | None = None) -> DataFrame:
    """The updates that make a stream from its first word: one fewer than it has words.

    A neighbour is met by a join on pos, which spreads a stream without keys over tasks.
    """
    keys = keys or []
    if keys:
        last = F.lag("word").over(W.partitionBy(*keys).orderBy("pos"))
        both = s.withColumn("__last", last).filter("pos > 0")
    else:
        both = s.join(s.select((F.col("pos") + 1).alias("pos"), F.col("word").alias("__last")), "pos")
    change = F.col("word").bitwiseXOR(F.col("__last")) if op == "xor" else F.col("word") - F.col("__last")
    return both.select(*keys, (F.col("pos") - 1).alias("pos"), cut(change, bits).alias("word"))


def length(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.groupBy(*keys).agg(F.count("*").alias("n"))


def concat(parts: list[DataFrame]) -> DataFrame:
    """Streams one after the other; every part is counted once, and its offset is the sum of the counts before it."""
    rows = None
    for i, p in enumerate(parts):
        own = p.select(F.lit(i).alias("__part"), "pos", "word")
        rows = own if rows is None else rows.unionByName(own)
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each part
    offset = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return rows.join(F.broadcast(counts.select("__part", offset.alias("__offset"))), "__part").select((F.col("pos") + F.col("__offset")).alias("pos"), "word")


def slice_of(s: DataFrame, lo: int, hi: int) -> DataFrame:
    return s.filter((F.col("pos") >= lo) & (F.col("pos") < hi)).select((F.col("pos") - lo).alias("pos"), "word")


def repeat(s: DataFrame, times: int, keys: list[str] | None = None) -> DataFrame:
    """Copies one after the other."""
    keys = keys or []
    n = length(s, keys)
    sized = s.join(n, keys) if keys else s.crossJoin(F.broadcast(n))  # a single row
    copies = sized.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.select(*keys, (F.col("pos") + F.col("__copy") * F.col("n")).alias("pos"), "word")


def constant(spark, n: int, word: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(word).cast("bigint").alias("word"))


def merge_streams(children: list[DataFrame], parts: list[tuple[int, int]], keys: list[str] | None = None) -> DataFrame:
    """Words of equal places, side by side in one word: one grouping, however many children there are."""
    keys, all_ = keys or [], None
    for c, (shift, _) in zip(children, parts, strict=True):
        moved = c.select(*keys, "pos", F.shiftleft("word", shift).alias("word"))
        all_ = moved if all_ is None else all_.unionByName(moved)
    return all_.groupBy(*keys, "pos").agg(F.bit_or("word").alias("word"))


def zip_merge(df: DataFrame, columns: list[str], parts: list[tuple[int, int]]) -> DataFrame:
    """Children that stand in columns of one row need no grouping."""
    return df.withColumn("word", merge([F.col(c) for c in columns], parts))


def planes(s: DataFrame, parts: list[tuple[int, int]], keys: list[str] | None = None) -> DataFrame:
    """keys, plane, pos, word: every child of a split."""
    children = F.array(*[cut(F.shiftright("word", shift), width) for shift, width in parts])
    return s.select(*(keys or []), "pos", F.posexplode(children).alias("plane", "word"))


def has_period(s: DataFrame, periods: list[int], keys: list[str]) -> DataFrame:
    """keys, period, periodic: whether word[i] = word[i + period] wherever both exist."""
    at = W.partitionBy(*keys).orderBy("pos")
    same = [F.bool_and(F.coalesce(F.col(f"__{p}") == F.col("word"), F.lit(True))).alias(str(p)) for p in periods]
    one = s.withColumns({f"__{p}": F.lead("word", p).over(at) for p in periods}).groupBy(*keys).agg(*same)
    return one.select(*keys, F.posexplode(F.array(*[F.col(f"`{p}`") for p in periods])).alias("i", "periodic")).select(*keys, F.get(F.array(*map(F.lit, periods)), F.col("i")).alias("period"), "periodic")


def histogram(s: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, cnt: partial counts in front of the shuffle."""
    return s.groupBy(*keys, "word").agg(F.count("*").alias("cnt"))


def summary(s: DataFrame, keys: list[str]) -> DataFrame:
    """n, uniform, required bits and the or of all words of each stream."""
    return s.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("word") == F.max("word")).alias("uniform"), F.greatest(F.lit(1), F.length(F.bin(F.max("word")))).alias("required_bits"), F.bit_or("word").alias("any_bits"))


def representatives(s: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, place, word: distinct words at k evenly spaced places, in order of their first place."""
    sized = s.join(length(s, keys), keys)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, k - 1)))
    return sized.filter(F.array_contains(places, F.col("pos"))).groupBy(*keys, "word").agg(F.min("pos").alias("place"))


def equal_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal, and how many places differ."""
    both = a.select("pos", F.col("word").alias("a")).join(b.select("pos", F.col("word").alias("b")), "pos", "full_outer")
    return both.agg(F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")), F.lit(0)).alias("differ")).select((F.col("differ") == 0).alias("equal"), "differ")
