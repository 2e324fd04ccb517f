"""Archives: a table of tensors' programs, and one file of the same records for exchange.

Fixed values of the file: ``BRTA``, version 3, tensors, length and bytes of the checkpoint's
header; then records: length, tag 1, name, type, rank, dimensions, length and bytes of
the program, XXH3-64 of the tensor's bytes, little-endian. Numbers are LEB128.
"""

from __future__ import annotations

import struct

import xxhash

from wordloom.functions.dtypes import BY_ID, DTYPES, EngineError
from wordloom.plans import literals
from wordloom.plans.program import Reader, bind, deserialize, execute, leb

from .checkpoints import parse_header

MAGIC, VERSION, TAG = b"BRTA", 3, 1
#: Magic, version and two LEB128 numbers have at most so many bytes.
MOST_LEBS = 4 + 1 + 10 + 10
SCHEMA = "path string, ord int, name string, dtype string, shape array<bigint>, bytecode binary, checksum binary"


def checksum(data: bytes) -> bytes:
    return struct.pack("<Q", xxhash.xxh3_64_intdigest(data))


def encode_header(prefix: bytes, tensors: int) -> bytes:
    parse_header(prefix)
    return MAGIC + bytes([VERSION]) + leb(tensors) + leb(len(prefix)) + prefix


def record_head(name: str, kind: str, shape) -> bytes:
    """What a record says before its program."""
    raw = name.encode()
    return bytes([TAG]) + leb(len(raw)) + raw + bytes([DTYPES[kind].program_id]) + leb(len(shape)) + b"".join(map(leb, shape))


def encode_record(name: str, kind: str, shape, bytecode: bytes, check: bytes) -> bytes:
    body = record_head(name, kind, shape) + leb(len(bytecode)) + bytecode + check
    return leb(len(body)) + body


def frames(data: bytes) -> tuple[bytes, list[bytes]]:
    """The checkpoint's header and the bodies of the records, none decoded."""
    prefix, places = walk(lambda n, at: data[at : at + n], len(data))
    return prefix, [data[at : at + n] for at, n in places]


def walk(read_at, total: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The checkpoint's header and (place, bytes) of each record's body, from lengths alone. ``read_at(n, at)`` gives bytes of the file."""
    first = read_at(MOST_LEBS, 0)
    r = Reader(first)
    if r.take(4) != MAGIC:
        raise EngineError("BadMagic")
    if r.byte() != VERSION:
        raise EngineError("BadVersion")
    n, size = r.leb(), r.leb()
    if n > total or r.at + size > total:
        raise EngineError("Truncated")
    prefix, at, out = read_at(size, r.at), r.at + size, []
    for _ in range(n):
        r = Reader(read_at(10, at))
        size = r.leb()
        if at + r.at + size > total:
            raise EngineError("Truncated")
        out.append((at + r.at, size))
        at += r.at + size
    if at != total:
        raise EngineError("TrailingData")
    return prefix, out


def decode_record(body: bytes) -> tuple[str, str, list[int], bytes, bytes]:
    r = Reader(body)
    if r.byte() != TAG:
        raise EngineError("UnknownRecord")
    name = r.take(r.leb()).decode()
    kind = BY_ID.get(r.byte())
    if kind is None:
        raise EngineError("UnknownDtype")
    shape = [r.leb() for _ in range(r.leb())]
    bytecode, check = r.take(r.leb()), r.take(8)
    if r.at != len(body):
        raise EngineError("TrailingData")
    return name, kind.name, shape, bytecode, check


def restore(kind: str, shape, bytecode: bytes, check: bytes | None, most_bytes: int | None = None) -> bytes:
    """The tensor's bytes: decoded, bound to its type and shape, executed and compared with the checksum."""
    p = deserialize(bytecode, **({"most_bytes": most_bytes} if most_bytes else {}))
    bind(p, kind, list(shape))
    data = literals.packed(execute(p), DTYPES[kind].bits)
    if check is not None and checksum(data) != bytes(check):
        raise EngineError("ChecksumMismatch")
    return data
