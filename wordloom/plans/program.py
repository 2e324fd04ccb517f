"""Programs: trees that generate a stream of words, their types, bytes and execution.

Fixed values of the format: ``BRPG``, version 2, then nodes in preorder. Lit 1, bits,
n, body length, body. Const 2, bits, n, word. Concat 3, children. Repeat 4, times. Map 5,
op (xor 1, add_mod 2, zigzag 3, gray 4, rotate_left 5, bit_reverse 6), parameter of 1, 2
and 5. Scan 6, op (xor 1, add_mod 2), first word. Merge 7, op (fields 1 and low bits,
float_fields 2 and type, bit_planes 3, byte_planes 4), children. Numbers are LEB128.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import words as wd
from wordloom.functions.dtypes import BY_ID, DTYPES, EngineError, numel
from wordloom.operators import streams as st
from wordloom.operators.encodings import storage

from . import literals

MAGIC, VERSION = b"BRPG", 2
MAP_IDS = {"xor": 1, "add_mod": 2, "zigzag": 3, "gray": 4, "rotate_left": 5, "bit_reverse": 6}
SCAN_IDS = {"xor": 1, "add_mod": 2}
MERGE_IDS = {"fields": 1, "float_fields": 2, "bit_planes": 3, "byte_planes": 4}
MOST_NODES, MOST_DEPTH, MOST_BYTES, MOST_WORK = 1_000_000, 256, 512 << 20, 4 << 30


@dataclass
class Node:
    kind: str
    bits: int = 0  # of Lit and Const
    n: int = 0
    op: str = ""
    param: int | str = 0
    children: list[Node] = field(default_factory=list)
    words: np.ndarray | None = None

    def nodes(self) -> int:
        return 1 + sum(c.nodes() for c in self.children)

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=-1)


def lit(words, bits: int) -> Node:
    words = np.asarray(words, np.uint32)
    return Node("Lit", bits, len(words), words=words)


def const(word: int, bits: int, n: int) -> Node:
    return Node("Const", bits, n, param=word)


def type_of(p: Node) -> tuple[int, int]:
    """(bits, n); an ill-typed tree is an error."""
    kids = [type_of(c) for c in p.children]
    if p.kind in ("Lit", "Const"):
        mask = wd.mask(p.bits)
        if kids:
            raise EngineError("InvalidArity", p.kind)
        if p.kind == "Const" and (p.n < 1 or not 0 <= p.param <= mask):
            raise EngineError("InvalidLength" if p.n < 1 else "InvalidLiteralValue")
        if p.kind == "Lit" and len(p.words) and int(p.words.max()) > mask:
            raise EngineError("InvalidLiteralValue")
        return p.bits, p.n
    if not kids or any(n < 1 for _, n in kids):
        raise EngineError("InvalidLength" if kids else "InvalidArity", p.kind)
    bits, n = kids[0]
    if p.kind == "Concat":
        if len(kids) < 2:
            raise EngineError("InvalidArity")
        if any(b != bits for b, _ in kids):
            raise EngineError("TypeMismatch")
        return bits, sum(k for _, k in kids)
    if p.kind == "Repeat":
        if p.param < 2:
            raise EngineError("InvalidRepeatCount")
        return bits, n * p.param
    if p.kind in ("Map", "Scan"):
        if len(kids) != 1 or p.op not in (MAP_IDS if p.kind == "Map" else SCAN_IDS):
            raise EngineError("InvalidParameter", p.op)
        if not 0 <= p.param <= wd.mask(bits) or (p.op == "rotate_left" and p.param >= bits):
            raise EngineError("InvalidParameter", p.op)
        return bits, n + (p.kind == "Scan")
    if p.kind == "Merge":
        if not 2 <= len(kids) <= 32 or any(k != n for _, k in kids):
            raise EngineError("InvalidArity" if not 2 <= len(kids) <= 32 else "TypeMismatch")
        total = sum(b for b, _ in kids)
        if total > 32 or [w for _, w in merge_parts(p, total)] != [b for b, _ in kids]:
            raise EngineError("TypeMismatch", p.op)
        return total, n
    raise EngineError("InvalidParameter", p.kind)


def merge_parts(p: Node, bits: int) -> list[tuple[int, int]]:
    return wd.layout(p.op, bits, low=p.param if p.op == "fields" else None, dtype=DTYPES[p.param] if p.op == "float_fields" else None)


def work_bytes(p: Node) -> int:
    """Bytes that execution touches: what a node's children touch and what it writes."""
    bits, n = type_of(p)
    out = n * storage(bits)
    below = sum(work_bytes(c) for c in p.children)
    if p.kind == "Concat":
        return below
    return below + out * (len(p.children) + 1) if p.kind == "Merge" else below + out


# ---- execution on packed arrays ----------------------------------------------------------


def _reverse_bits(w: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(w)
    for i in range(bits):
        out |= ((w >> np.uint32(i)) & np.uint32(1)) << np.uint32(bits - 1 - i)
    return out


def map_words(op: str, c: int, w: np.ndarray, bits: int, inverse: bool = False) -> np.ndarray:
    m, one = np.uint32(wd.mask(bits)), np.uint32(1)
    if op == "xor":
        return (w ^ np.uint32(c)) & m
    if op == "add_mod":
        return (w + np.uint32((-c if inverse else c) & wd.mask(bits))) & m
    if op == "zigzag":
        return ((w >> one) ^ (np.uint32(0) - (w & one))) & m if inverse else ((w << one) ^ (np.uint32(0) - (w >> np.uint32(bits - 1)))) & m
    if op == "gray":
        if not inverse:
            return w ^ (w >> one)
        for s in (1, 2, 4, 8, 16):
            w = w ^ (w >> np.uint32(s))
        return w & m
    if op == "rotate_left":
        k = (bits - c) % bits if inverse else c
        return w if not k else ((w << np.uint32(k)) | (w >> np.uint32(bits - k))) & m
    return _reverse_bits(w, bits)


def scan_words(op: str, first: int, w: np.ndarray, bits: int) -> np.ndarray:
    w = np.concatenate([[first], w]).astype(np.uint32)
    return np.bitwise_xor.accumulate(w) if op == "xor" else (np.cumsum(w, dtype=np.uint64) & np.uint64(wd.mask(bits))).astype(np.uint32)


def scan_updates(op: str, w: np.ndarray, bits: int) -> np.ndarray:
    return w[1:] ^ w[:-1] if op == "xor" else (w[1:] - w[:-1]) & np.uint32(wd.mask(bits))


def split_words(w: np.ndarray, parts) -> list[np.ndarray]:
    return [(w >> np.uint32(s)) & np.uint32((1 << b) - 1) for s, b in parts]


def execute(p: Node) -> np.ndarray:
    if p.kind == "Lit":
        return p.words
    if p.kind == "Const":
        return np.full(p.n, p.param, np.uint32)
    kids = [execute(c) for c in p.children]
    bits, _ = type_of(p)
    if p.kind == "Concat":
        return np.concatenate(kids)
    if p.kind == "Repeat":
        return np.tile(kids[0], p.param)
    if p.kind == "Map":
        return map_words(p.op, p.param, kids[0], bits)
    if p.kind == "Scan":
        return scan_words(p.op, p.param, kids[0], bits)
    out = np.zeros(len(kids[0]), np.uint32)
    for k, (shift, _) in zip(kids, merge_parts(p, bits), strict=True):
        out |= k << np.uint32(shift)
    return out


def lower(spark: SparkSession, p: Node) -> DataFrame:
    """The program as a DataFrame plan over pos and word; literals become local relations."""
    if p.kind == "Lit":
        return spark.createDataFrame(list(enumerate(p.words.tolist())), "pos bigint, word bigint")
    if p.kind == "Const":
        return st.constant(spark, p.n, p.param)
    kids, (bits, _) = [lower(spark, c) for c in p.children], type_of(p)
    if p.kind == "Concat":
        return st.concat(kids)
    if p.kind == "Repeat":
        return st.repeat(kids[0], p.param)
    if p.kind == "Map":
        return kids[0].select("pos", wd.MAPS[p.op][0](F.col("word"), bits, p.param).alias("word"))
    if p.kind == "Scan":
        return st.scan(kids[0], p.op, bits, initial=p.param)
    return st.merge_streams(kids, merge_parts(p, bits))


# ---- bytes -------------------------------------------------------------------------------


def leb(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes(out) + bytes([x])


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EngineError("Truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def leb(self) -> int:
        out, shift = 0, 0
        while True:
            b = self.byte()
            out |= (b & 127) << shift
            if not b & 128:
                if (b == 0 and shift) or out >> 64:
                    raise EngineError("NonCanonicalInteger")
                return out
            shift += 7
            if shift > 63:
                raise EngineError("IntegerOverflow")


def _emit(p: Node) -> bytes:
    kids = b"".join(map(_emit, p.children))
    if p.kind == "Lit":
        body = literals.encode(p.words, p.bits)
        return b"\x01" + bytes([p.bits]) + leb(p.n) + leb(len(body)) + body
    if p.kind == "Const":
        return b"\x02" + bytes([p.bits]) + leb(p.n) + leb(p.param)
    if p.kind == "Concat":
        return b"\x03" + leb(len(p.children)) + kids
    if p.kind == "Repeat":
        return b"\x04" + leb(p.param) + kids
    if p.kind == "Map":
        return b"\x05" + bytes([MAP_IDS[p.op]]) + (leb(p.param) if p.op in ("xor", "add_mod", "rotate_left") else b"") + kids
    if p.kind == "Scan":
        return b"\x06" + bytes([SCAN_IDS[p.op]]) + leb(p.param) + kids
    extra = leb(p.param) if p.op == "fields" else bytes([DTYPES[p.param].program_id]) if p.op == "float_fields" else b""
    return b"\x07" + bytes([MERGE_IDS[p.op]]) + extra + leb(len(p.children)) + kids


def serialize(p: Node) -> bytes:
    type_of(p)
    return MAGIC + bytes([VERSION]) + _emit(p)


def size(p: Node) -> int:
    """Bytes of ``serialize`` without making literal payloads."""
    own = {"Lit": lambda: (lambda b: 2 + len(leb(p.n)) + len(leb(b)) + b)(literals.choose(p.words, p.bits)[0]), "Const": lambda: 2 + len(leb(p.n)) + len(leb(p.param)), "Concat": lambda: 1 + len(leb(len(p.children))), "Repeat": lambda: 1 + len(leb(p.param)), "Map": lambda: 2 + (len(leb(p.param)) if p.op in ("xor", "add_mod", "rotate_left") else 0), "Scan": lambda: 2 + len(leb(p.param)), "Merge": lambda: 2 + (p.op in ("fields", "float_fields")) + len(leb(len(p.children)))}
    return own[p.kind]() + sum(map(size, p.children))


def deserialize(data: bytes, most_nodes: int = MOST_NODES, most_depth: int = MOST_DEPTH, most_bytes: int = MOST_BYTES, most_work: int = MOST_WORK) -> Node:
    r, seen = Reader(data), [0, 0]
    if r.take(4) != MAGIC:
        raise EngineError("BadMagic")
    if r.byte() != VERSION:
        raise EngineError("BadVersion")
    names = lambda ids, k: {v: x for x, v in ids.items()}.get(k) or _bad("UnknownOpcode", k)

    def read(depth: int) -> Node:
        seen[0] += 1
        if seen[0] > most_nodes or depth > most_depth:
            raise EngineError("NodeLimitExceeded" if seen[0] > most_nodes else "DepthLimitExceeded")
        kids = lambda k: [read(depth + 1) for _ in range(k)] if k <= len(data) - r.at else _bad("Truncated", k)
        tag = r.byte()
        if tag == 1:
            bits, n = r.byte(), r.leb()
            wd.mask(bits)
            seen[1] += n * storage(bits)
            if seen[1] > most_bytes:
                raise EngineError("OutputLimitExceeded")
            return Node("Lit", bits, n, words=literals.decode(r.take(r.leb()), bits, n))
        if tag == 2:
            bits, n, word = r.byte(), r.leb(), r.leb()
            if n * storage(min(max(bits, 1), 32)) > most_bytes:
                raise EngineError("OutputLimitExceeded")
            return Node("Const", bits, n, param=word)
        if tag == 3:
            return Node("Concat", children=kids(r.leb()))
        if tag == 4:
            return Node("Repeat", param=r.leb(), children=kids(1))
        if tag == 5:
            op = names(MAP_IDS, r.byte())
            return Node("Map", op=op, param=r.leb() if op in ("xor", "add_mod", "rotate_left") else 0, children=kids(1))
        if tag == 6:
            op = names(SCAN_IDS, r.byte())
            return Node("Scan", op=op, param=r.leb(), children=kids(1))
        if tag == 7:
            op = names(MERGE_IDS, r.byte())
            param = r.leb() if op == "fields" else (BY_ID.get(k := r.byte()) or _bad("UnknownDtype", k)).name if op == "float_fields" else 0
            return Node("Merge", op=op, param=param, children=kids(r.leb()))
        raise EngineError("UnknownNode", str(tag))

    p = read(1)
    if r.at != len(data):
        raise EngineError("TrailingData")
    bits, n = type_of(p)
    if n * storage(bits) > most_bytes:
        raise EngineError("OutputLimitExceeded")
    if work_bytes(p) > most_work:
        raise EngineError("ExecutionWorkLimitExceeded")
    return p


def _bad(code: str, detail=""):
    raise EngineError(code, str(detail))


def bind(p: Node, dtype: str, shape: list[int]) -> None:
    """A program of a tensor has its width and as many words as it has elements."""
    bits, n = type_of(p)
    if bits != DTYPES[dtype].bits:
        raise EngineError("TensorWidthMismatch")
    if n != numel(shape):
        raise EngineError("TensorLengthMismatch")
