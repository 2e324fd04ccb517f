"""Best-fit packing of tokenized documents by a linear grouping scheme.

1. Every document becomes pieces of at most ``CAPACITY`` tokens (its ids, then an
   end id). Full pieces fill a sequence each.
2. The lengths of the others are counted: at most ``CAPACITY`` numbers, however
   many documents there are. The plan is made from these counts alone.
3. Large pieces are sorted by length and split into groups of equal cardinality;
   each group's lengths are rounded up to its longest. Over these few sizes, the
   fractional best mix of configurations is found by column generation (a small
   simplex with a knapsack for the dual prices), and its whole part is used.
4. Actual pieces take the slots of their group, longest first; what no slot took,
   and then the small pieces, go by decreasing length where they fit best.
5. A plan row says that the pieces of one length with ranks r0 to r0+n-1 go to the
   sequences s0 to s0+n-1 at one offset. Ranks within a length are numbered in
   parallel, and each piece looks up its row.

The plan has at most (configurations + CAPACITY) times the slots of a configuration
rows for large pieces and at most one for each pair of a small length and a gap,
so its size doesn't depend on the number of documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import BATCH_BYTES, BATCH_ROWS, Scratch, table

CAPACITY, END_ID, GROUPS = 2048, 0, 256
#: Pieces up to this length count as small.
SMALL = CAPACITY // 3
PIECES = "doc_id {doc_id}, piece int, start bigint, length bigint, ids_crc32 bigint, __part bigint, __rank bigint"
#: Letters up to here have been classified alike in every version of Unicode that the two encoders may use.
_OTHER_SCRIPTS = re.compile("[^\x00-ɏ]")


class Encoder:
    """Ids of the byte-level BPE of ``json_path``, as the tokenizers library gives them.

    Texts in Latin script go through the same vocabulary as ranks (``rank_path``), which
    is several times faster and gives the same ids; a test compares the two. Special
    tokens written out in a text are plain text, or, with ``special``, the library's
    own default: their ids.
    """

    def __init__(self, json_path: str | None = None, rank_path: str | None = None, special: bool = False):
        import base64

        import public_tokenizers as files
        import tiktoken

        self.json_path = json_path or files.path("byte_bpe_50k.json")
        with open(rank_path or files.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow, self.special, self.names = None, special, None
        if special:
            self.names = re.compile("|".join(re.escape(t.content) for t in self._library().get_added_tokens_decoder().values()) or r"(?!)")

    def _library(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
            self.slow.encode_special_tokens = not self.special
        return self.slow

    def __call__(self, text: str) -> np.ndarray:
        if not _OTHER_SCRIPTS.search(text) and not (self.names and self.names.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.plain(text), np.uint32)

    def plain(self, text: str) -> list[int]:
        return self._library().encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes what whole pieces leave over."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """The pieces of every document, with ids (array of int) if asked for.

    ``__part`` and ``__rank`` number the pieces of each length within a partition;
    write the result once before using them.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = docs.select("doc_id", "text")
    schema = T._parse_datatype_string(PIECES.format(doc_id=docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else ""))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encode, seen, part = to_arrow_schema(schema), Encoder(special=special), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows = [[] for _ in schema]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(own.tobytes()), part, seen[length]] + ([own.astype(np.int32)] if with_ids else [])
                    seen[length] += 1
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


# ---- the plan: everything below works on counts of lengths -----------------------------


def group_large(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(rounded length, [(length, first rank, count), ...]) of each group, longest first; groups of one rounded length are merged."""
    total = sum(counts.values())
    share, out, left = -(-total // groups) if total else 1, [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            if not left:
                if not out or out[-1][0] != length:
                    out.append((length, []))
                left = share
            take = min(n, left)
            out[-1][1].append((length, rank, take))
            rank, n, left = rank + take, n - take, left - take
    return out


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration that fits: an unbounded knapsack, one item more in each round."""
    best, picks = np.zeros(capacity + 1), []
    while True:
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (size, value) in enumerate(zip(sizes, values, strict=True)):
            if value > 1e-12:
                with_g = best[: capacity + 1 - size] + value
                better = with_g > more[size:] + 1e-12
                more[size:][better] = with_g[better]
                pick[size:][better] = g
        if (pick < 0).all():
            break
        picks.append(pick)
        best = more
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pattern, how often) from the fractional optimum, rounded down."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(rounds):
        value, pattern = best_pattern(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        basis[:, r] = pattern
        x = x - ratio[r] * step
        x[r] = ratio[r]
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        x = np.maximum(x, 0)
    return [(basis[:, k].astype(int), int(x[k] + 1e-6)) for k in range(m) if int(x[k] + 1e-6)]


class Plan:
    """rows: (length, first rank, count, first sequence, offset). sequences: how many it uses."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        counts = {length: n for length, n in counts.items() if n}
        rest = [(length, 0, n) for length, n in counts.items() if length <= small]
        grouped = group_large({length: n for length, n in counts.items() if length > small}, groups)
        if grouped:
            rest += self._configure(grouped)
        for length, rank, n in sorted(rest, key=lambda x: (-x[0], x[1])):
            self._best_fit(length, rank, n)

    def _configure(self, grouped) -> list[tuple[int, int, int]]:
        """Fills the slots of the configurations; returns the pieces that got none."""
        sizes, demand = np.array([g[0] for g in grouped]), np.array([sum(x[2] for x in g[1]) for g in grouped], float)
        stock = [list(reversed(g[1])) for g in grouped]
        for pattern, times in configurations(sizes, demand, self.capacity):
            slots = [self._take(stock[g], times) for g in range(len(sizes)) for _ in range(pattern[g])]
            bounds = sorted({0, times} | {at for slot in slots for at, *_ in slot} | {at + n for slot in slots for at, _, _, n in slot})
            for lo, hi in zip(bounds, bounds[1:]):
                used = 0
                for slot in slots:
                    for at, length, rank, n in slot:
                        if at <= lo < at + n:
                            self.rows.append((length, rank + lo - at, hi - lo, self.sequences + lo, used))
                            used += length
                if used < self.capacity:
                    self.gaps[self.capacity - used].append((self.sequences + lo, hi - lo))
            self.sequences += times
        return [x for own in stock for x in own]

    @staticmethod
    def _take(stock: list, times: int) -> list[tuple[int, int, int, int]]:
        """Up to ``times`` pieces as (place, length, first rank, count)."""
        out, at = [], 0
        while stock and at < times:
            length, rank, n = stock.pop()
            k = min(n, times - at)
            if k < n:
                stock.append((length, rank + k, n - k))
            out.append((at, length, rank, k))
            at += k
        return out

    def _best_fit(self, length: int, rank: int, n: int) -> None:
        while n:
            gap = min((g for g, own in self.gaps.items() if g >= length and own), default=None)
            if gap is None:
                break
            first, times = self.gaps[gap].pop()
            k = min(n, times)
            if k < times:
                self.gaps[gap].append((first + k, times - k))
            self._put(length, rank, k, first, self.capacity - gap, gap - length)
            rank, n = rank + k, n - k
        each = self.capacity // length
        for times, items in ((n // each, each), (1, n % each)):
            if times and items:
                for i in range(items):
                    self.rows.append((length, rank + i * times, times, self.sequences, i * length))
                if items * length < self.capacity:
                    self.gaps[self.capacity - items * length].append((self.sequences, times))
                self.sequences += times
                rank += items * times

    def _put(self, length, rank, n, sequence, offset, left) -> None:
        self.rows.append((length, rank, n, sequence, offset))
        if left:
            self.gaps[left].append((sequence, n))


_RANK_BITS = 44


def _look_up(plan: Plan):
    """Arrow batches of length and rank to sequence and offset, by one binary search each."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    starts = (rows[:, 0] << _RANK_BITS) | rows[:, 1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            length, rank, part = (b.column(at[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank", "__part"))
            full = length == plan.capacity
            sequence, offset = -1 - ((part << 40) + rank), np.zeros(len(length), np.int64)
            if len(rows):
                hit = rows[np.maximum(np.searchsorted(starts, (length << _RANK_BITS) | rank, "right") - 1, 0)]
                sequence, offset = np.where(full, sequence, hit[:, 3] + rank - hit[:, 1]), np.where(full, 0, hit[:, 4])
            names = [n for n in b.schema.names if n[:2] != "__"]
            yield pa.RecordBatch.from_arrays([b.column(at[n]) for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Needs doc_id and text and takes no other column. A null text is empty: one piece
    that holds the end id. A null or repeated doc_id is a document like any other. An
    empty table gives an empty result. Full pieces have negative sequence ids. A special
    token that a text writes out is plain text, or with ``special`` its own id.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.save(pieces(docs, capacity, with_ids, special), "pieces")
    per_part = made.filter(F.col("length") < capacity).groupBy("length", "__part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # fewer than capacity rows
    before = W.partitionBy("length").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = per_part.select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = made.join(starts, ["length", "__part"], "left").withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0))).drop("__before")
    order = [c for c in made.columns]
    ranked = ranked.select(*order)
    out = T.StructType([f for f in ranked.schema if f.name[:2] != "__"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_look_up(Plan(counts, capacity)), out)


def op1_packing(spark, sf_dir) -> DataFrame:
    """Ids as the tokenizers library gives them by default, where only ``add_special_tokens`` is turned off."""
    return pack(table(spark, sf_dir, "documents"), special=True)
