"""Which productions apply to a stream of words, and the streams that they leave to generate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wordloom.functions import words as wd
from wordloom.functions.dtypes import DTYPES, EngineError
from wordloom.operators.encodings import storage
from wordloom.operators.prior_tables import PRODUCTIONS

from .program import MERGE_IDS, Node, leb, map_words, scan_updates, split_words


@dataclass(frozen=True)
class Limits:
    """Choices of each kind; ``clamped`` keeps them below the hard caps."""

    depth: int = 4
    period: int = 32
    splits: int = 3
    constants: int = 2
    rotations: int = 3
    fields: int = 3

    def clamped(self) -> Limits:
        return Limits(self.depth, min(self.period, 64), min(self.splits, 16), min(self.constants, 8), min(self.rotations, 8), min(self.fields, 8))


@dataclass(frozen=True)
class Choice:
    family: str
    param: int | str = 0

    @property
    def id(self) -> int:
        return PRODUCTIONS[self.family]


_MAP = {"MapXor": "xor", "MapAdd": "add_mod", "MapZigzag": "zigzag", "MapGray": "gray", "MapRotate": "rotate_left", "MapReverse": "bit_reverse"}
_SCAN = {"ScanXor": "xor", "ScanAdd": "add_mod"}
_MERGE = {"MergeFields": "fields", "MergeFloat": "float_fields", "MergeBits": "bit_planes", "MergeBytes": "byte_planes"}


def min_period(w: np.ndarray, most: int) -> int | None:
    n = len(w)
    return next((p for p in range(1, min(most, 64, n // 2) + 1) if n % p == 0 and (w[p:] == w[:-p]).all()), None)


def spread(top: int, k: int) -> list[int]:
    return [i * top // (k + 1) for i in range(1, k + 1)]


def representatives(w: np.ndarray, k: int) -> list[int]:
    return list(dict.fromkeys(int(w[i * (len(w) - 1) // max(1, k - 1)]) for i in range(k))) if len(w) else []


def propose(w: np.ndarray, bits: int, dtype: str, depth: int, limits: Limits = Limits()) -> list[Choice]:
    """All choices, literal first, in order of families; nothing that is an identity, an alias or dominated."""
    limits, n = limits.clamped(), len(w)
    out = [Choice("Lit")]
    if not n:
        return out
    uniform = bool((w == w[0]).all())
    if uniform:
        out.append(Choice("Const"))
    if depth >= limits.depth:
        return out
    m = wd.mask(bits)
    if n >= 2:
        out += [Choice("Concat", s) for s in dict.fromkeys(spread(n, min(limits.splits, n - 1))) if s]
    period = None if uniform else min_period(w, limits.period)
    if period:
        out.append(Choice("Repeat", n // period))
    values = [x for x in representatives(w, max(1, limits.constants)) if x][: limits.constants]
    out += [Choice("MapXor", x) for x in values]
    if bits > 1:
        out += [Choice("MapAdd", c) for c in dict.fromkeys((-x) & m for x in values) if c]
        out += [Choice("MapZigzag"), Choice("MapGray")]
        out += [Choice("MapRotate", k) for k in dict.fromkeys(spread(bits, min(limits.rotations, bits - 1))) if k]
        out.append(Choice("MapReverse"))
    if n >= 2:
        out += [Choice("ScanXor")] + ([Choice("ScanAdd")] if bits > 1 else [])
    if bits > 2:
        lows = spread(bits, min(limits.fields, bits - 1))
        if dtype.startswith("F8") and bits == 8 and lows:
            lows[-1] = bits - 1
        out += [Choice("MergeFields", k) for k in dict.fromkeys(lows) if k and not (k == 8 and 9 <= bits <= 16)]
    if DTYPES[dtype].is_float and bits == DTYPES[dtype].bits:
        out.append(Choice("MergeFloat", dtype))
    if bits > 1:
        out.append(Choice("MergeBits"))
    if bits > 8:
        out.append(Choice("MergeBytes"))
    return out


def parts(c: Choice, bits: int) -> list[tuple[int, int]]:
    return wd.layout(_MERGE[c.family], bits, low=c.param if c.family == "MergeFields" else None, dtype=DTYPES[c.param] if c.family == "MergeFloat" else None)


def children(c: Choice, w: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """(words, bits) of each child, such that the production of them gives w."""
    if c.family in ("Lit", "Const"):
        return []
    if c.family == "Concat":
        return [(w[: c.param], bits), (w[c.param :], bits)]
    if c.family == "Repeat":
        if len(w) % c.param or not (w.reshape(c.param, -1) == w[: len(w) // c.param]).all():
            raise EngineError("InvalidChoice")
        return [(w[: len(w) // c.param], bits)]
    if c.family in _MAP:
        return [(map_words(_MAP[c.family], c.param, w, bits, inverse=True), bits)]
    if c.family in _SCAN:
        return [(scan_updates(_SCAN[c.family], w, bits), bits)]
    return [(x, b) for x, (_, b) in zip(split_words(w, parts(c, bits)), parts(c, bits))]


def shapes(c: Choice, n: int, bits: int) -> list[tuple[int, int]]:
    """(length, bits) of each child, without making them."""
    if c.family in ("Lit", "Const"):
        return []
    if c.family == "Concat":
        return [(c.param, bits), (n - c.param, bits)]
    if c.family in _MERGE:
        return [(n, b) for _, b in parts(c, bits)]
    return [(n // c.param if c.family == "Repeat" else n - 1 if c.family in _SCAN else n, bits)]


def child(c: Choice, w: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The words of one child; the others of a merge aren't made."""
    return split_words(w, [parts(c, bits)[i]])[0] if c.family in _MERGE else children(c, w, bits)[i][0]


def storage_bytes(c: Choice, n: int, bits: int) -> int:
    """Bytes of the children's streams, without making them."""
    return sum(k * storage(b) for k, b in shapes(c, n, bits))


def fixed_bytes(c: Choice, w: np.ndarray, bits: int) -> int:
    """Bytes that a node has at least, without its children."""
    n = len(w)
    if c.family == "Lit":
        return 2 + len(leb(n)) + 2  # a body has a byte, and its length one
    if c.family == "Const":
        return 2 + len(leb(n)) + len(leb(int(w[0])))
    if c.family == "Concat":
        return 2
    if c.family == "Repeat":
        return 1 + len(leb(c.param))
    if c.family in _MAP:
        return 2 + (len(leb(c.param)) if c.family in ("MapXor", "MapAdd", "MapRotate") else 0)
    if c.family in _SCAN:
        return 2 + len(leb(int(w[0])))
    return 3 + (c.family in ("MergeFields", "MergeFloat"))


def build(c: Choice, w: np.ndarray, bits: int, kids: list[Node]) -> Node:
    if c.family == "Lit":
        return Node("Lit", bits, len(w), words=w)
    if c.family == "Const":
        return Node("Const", bits, len(w), param=int(w[0]))
    if c.family in ("Concat", "Repeat"):
        return Node(c.family, param=c.param if c.family == "Repeat" else 0, children=kids)
    if c.family in _MAP:
        return Node("Map", op=_MAP[c.family], param=c.param, children=kids)
    if c.family in _SCAN:
        return Node("Scan", op=_SCAN[c.family], param=int(w[0]), children=kids)
    return Node("Merge", op=_MERGE[c.family], param=c.param if c.family in ("MergeFields", "MergeFloat") else 0, children=kids)


def choice_of(p: Node, left: int = 0) -> Choice:
    """The production at the root of a program; ``left`` is the length of a concatenation's first child."""
    names = {v: k for k, v in (_MAP | _SCAN | _MERGE).items()}
    if p.kind in ("Lit", "Const"):
        return Choice(p.kind)
    if p.kind == "Concat":
        if len(p.children) != 2:
            raise EngineError("InvalidArity", "only two parts can be observed")
        return Choice("Concat", left)
    if p.kind == "Repeat":
        return Choice("Repeat", p.param)
    if p.kind == "Scan":
        return Choice({"xor": "ScanXor", "add_mod": "ScanAdd"}[p.op])
    if p.kind == "Map":
        return Choice({v: k for k, v in _MAP.items()}[p.op], p.param)
    return Choice(names[p.op], p.param if p.op in ("fields", "float_fields") else 0) if p.op in MERGE_IDS else Choice("Lit")
