"""What was learned: counts of productions by context, at three levels, and costs from them.

Fixed values of the format: ``BRGP``, u16 version 1, u16 scale 1024, u32 / u32 weight of
the learned part, u64 smoothing, u8 levels, then for each level u8 its number and u32
rows; a row is its context (u16 parent, u8 slot; at levels 0 and 1 u8 depth, type, bits;
at level 0 u8 length, zeros, distinct, repetition, differences), u8 entries, and (u16
production, u64 count) each. Rows are in order of contexts, entries of productions.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, defaultdict

import numpy as np

from wordloom.functions.dtypes import DTYPES, EngineError
from wordloom.operators.prior_tables import PRODUCTIONS, SAMPLES

MAGIC, VERSION, COST_SCALE, ROOT = b"BRGP", 1, 1024, 0xFFFF
KEYS = ["parent", "slot", "depth", "dtype", "bits", "length_bucket", "zero_bucket", "distinct_bucket", "repetition_bucket", "diff_bucket"]
_USED = {0: 10, 1: 5, 2: 2}
_IDS = sorted(PRODUCTIONS.values())


def log_cost(a: int, b: int) -> int:
    """-log2(a / b) in 1/1024 bits, rounded half up. Exact ratios near a rounding boundary differ in doubles by less than this rounds."""
    return math.floor((math.log2(b) - math.log2(a)) * COST_SCALE + 0.5)


def context(w: np.ndarray, bits: int, dtype: str, parent: int, slot: int, depth: int) -> tuple[int, ...]:
    """The ten features of a hole; those of data from evenly spaced samples."""
    n = len(w)
    head = (parent, slot, min(depth, 7), DTYPES[dtype].prior_id, bits)
    if not n:
        return (*head, 0, 0, 0, 0, 0)
    k = min(n, SAMPLES)
    at = np.arange(k) * (n - 1) // max(1, k - 1)
    x, later = w[at], at[1:]
    quarter = lambda a, b: min(3, 4 * a // b) if b else 0
    diff = (w[later] - w[later - 1]) & np.uint32((1 << bits) - 1) if k > 1 else np.zeros(0)
    own = np.array(list(Counter(diff.tolist()).values()), float)
    bucket = 0
    if len(own) > 1:
        p = own / own.sum()
        bucket = min(3, int(round(4 * float(-(p * np.log2(p)).sum()) / math.log2(min(own.sum(), 1 << bits)), 9)))
    return (*head, min(63, n.bit_length() - 1), quarter(int((x == 0).sum()), k), quarter(len(set(x.tolist())), k), quarter(int((w[later] == w[later - 1]).sum()) if k > 1 else 0, k - 1), bucket)


class Prior:
    """levels[k]: context (its first features) -> production -> count."""

    def __init__(self, numerator: int = 1, denominator: int = 1, smoothing: int = 1):
        if not 0 <= numerator <= denominator or denominator < 1 or smoothing < 1:
            raise EngineError("InvalidConfig")
        self.numerator, self.denominator, self.smoothing = numerator, denominator, smoothing
        self.levels: list[dict[tuple, Counter]] = [defaultdict(Counter) for _ in range(3)]

    def observe(self, key: tuple[int, ...], production: int, weight: int = 1) -> None:
        for level, used in _USED.items():
            self.levels[level][key[:used]][production] += weight

    @property
    def empty(self) -> bool:
        return not self.levels[2]

    def row(self, key: tuple[int, ...]) -> Counter | None:
        """The first level that has the context, as a whole."""
        return next((row for level, used in _USED.items() if (row := self.levels[level].get(key[:used]))), None)

    def costs(self, key: tuple[int, ...], admitted: list[int]) -> dict[int, int]:
        if not admitted:
            raise EngineError("EmptyLegalSet")
        if len(set(admitted)) != len(admitted):
            raise EngineError("DuplicateProduction")
        n, row = len(admitted), self.row(key)
        if row is None:
            return dict.fromkeys(admitted, log_cost(1, n))
        total = sum(row[p] for p in admitted) + self.smoothing * n
        a, b = self.numerator, self.denominator
        return {p: log_cost(a * n * (row[p] + self.smoothing) + (b - a) * total, b * n * total) for p in admitted}

    def bounds(self, least_admitted: int) -> dict[int, int]:
        """A cost of each production that no context beats."""
        most: Counter = Counter()
        for level in self.levels:
            for row in level.values():
                for p, c in row.items():
                    most[p] = max(most[p], c)
        n, s = least_admitted, self.smoothing
        return {p: min(log_cost(1, n), log_cost(most[p] + s, most[p] + s + (n - 1) * s)) for p in _IDS}

    def serialize(self) -> bytes:
        out = [MAGIC, struct.pack("<HHIIQB", VERSION, COST_SCALE, self.numerator, self.denominator, self.smoothing, 3)]
        for level, rows in enumerate(self.levels):
            out.append(struct.pack("<BI", level, len(rows)))
            for key in sorted(rows):
                entries = [(p, rows[key][p]) for p in _IDS if rows[key][p]]
                out.append(struct.pack("<H", key[0]) + bytes(key[1:]) + bytes([len(entries)]) + b"".join(struct.pack("<HQ", p, c) for p, c in entries))
        return b"".join(out)

    @classmethod
    def deserialize(cls, data: bytes) -> Prior:
        try:
            if data[:4] != MAGIC:
                raise EngineError("BadMagic")
            version, scale, a, b, s, levels = struct.unpack_from("<HHIIQB", data, 4)
            for ok, code in ((version == VERSION, "BadVersion"), (scale == COST_SCALE, "BadCostScale"), (levels == 3, "BadLevelCount")):
                if not ok:
                    raise EngineError(code)
            out, at = cls(a, b, s), 25
            for level in range(3):
                number, rows = struct.unpack_from("<BI", data, at)
                at, last = at + 5, None
                if number != level:
                    raise EngineError("NonCanonicalLevelOrder")
                for _ in range(rows):
                    used = _USED[level]
                    key = (struct.unpack_from("<H", data, at)[0], *data[at + 2 : at + 1 + used])
                    at += 1 + used
                    if last is not None and key <= last:
                        raise EngineError("DuplicateContext" if key == last else "NonCanonicalContextOrder")
                    n, last, before = data[at], key, -1
                    at += 1
                    if not 0 < n <= len(_IDS):
                        raise EngineError("InvalidEntryCount")
                    for _ in range(n):
                        p, c = struct.unpack_from("<HQ", data, at)
                        at += 10
                        if p not in _IDS or p <= before:
                            raise EngineError("InvalidProductionId")
                        if not c:
                            raise EngineError("InvalidCount")
                        out.levels[level][key][p], before = c, p
            if at != len(data):
                raise EngineError("TrailingData")
            return out
        except (struct.error, IndexError):
            raise EngineError("Truncated") from None
