"""Bodies of literals: four encodings, the smallest of which is stored.

Fixed values of the format: integers are little-endian; raw is tag 0 and the words at
their storage size; bitpack is tag 1, a width byte and the words, most significant bit
first; huffman is tag 2, u32 entries, (u32 symbol, u8 length) in order of length and
symbol, u64 bits, payload; rans is tag 3, u32 entries, (u32 symbol, u32 frequency) in
order of symbols, u64 bytes, payload. A rans payload has the lengths of four lanes as
big-endian u32, then the lanes; word i is in lane i mod 4; frequencies sum to 2^14,
states begin and end at 2^23, are kept as big-endian u32 and move by bytes.
"""

from __future__ import annotations

import struct

import numpy as np

from wordloom.functions.dtypes import EngineError
from wordloom.operators.encodings import MOST_SYMBOLS, TAGS, code_lengths, storage

SCALE_BITS, LOW, LANES = 14, 1 << 23, 4
SCALE = 1 << SCALE_BITS
#: Words (or bytes) that are worked on at once, a multiple of 8; bits that are looked up before a search.
CHUNK, PEEK = 1 << 14, 12
_TYPES = {1: "<u1", 2: "<u2", 4: "<u4"}


def packed(words: np.ndarray, bits: int) -> bytes:
    """The words at 1, 2 or 4 bytes each."""
    return words.astype(_TYPES[storage(bits)]).tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(data, _TYPES[storage(bits)]).astype(np.uint32)


def to_bits(words: np.ndarray, widths) -> bytes:
    """Words at their widths (one or an array), most significant bits first, padded with zeros."""
    widths = np.broadcast_to(np.asarray(widths, np.int64), len(words))
    out, left = bytearray(), np.zeros(0, np.uint8)
    for k in range(0, len(words), CHUNK):
        w, width = words[k : k + CHUNK].astype(np.uint64), widths[k : k + CHUNK]
        below = np.repeat(np.cumsum(width), width) - np.arange(int(width.sum())) - 1
        bits = np.concatenate([left, ((np.repeat(w, width) >> below.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)])
        whole = len(bits) // 8 * 8
        out += np.packbits(bits[:whole]).tobytes()
        left = bits[whole:]
    return bytes(out) + np.packbits(left).tobytes()


def check_padding(data: bytes, n: int) -> None:
    if len(data) != -(-n // 8) or (n % 8 and data[-1] & (0xFF >> n % 8)):
        raise EngineError("CorruptLiteralEncoding", "padding")


def from_bits(data: bytes, width: int, n: int) -> np.ndarray:
    check_padding(data, width * n)
    raw, out, up = np.frombuffer(data, np.uint8), np.empty(n, np.uint32), np.arange(width - 1, -1, -1, dtype=np.uint32)
    for k in range(0, n, CHUNK):
        m = min(CHUNK, n - k)  # CHUNK is a multiple of 8, so each part begins with a byte
        bits = np.unpackbits(raw[k * width // 8 : -(-(k + m) * width // 8)])[: m * width].reshape(m, width)
        out[k : k + m] = (bits.astype(np.uint32) << up).sum(1, dtype=np.uint32)
    return out


# ---- huffman ---------------------------------------------------------------------------


def canonical(entries: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), for (length, symbol) in order."""
    out, code, last = {}, 0, 0
    for length, symbol in entries:
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
        if code > 1 << length:
            raise EngineError("CorruptLiteralEncoding", "code lengths")
    return out


def _huffman(words, symbols, counts):
    length = code_lengths(list(zip(symbols.tolist(), counts.tolist())))
    entries = sorted((n, s) for s, n in length.items())
    codes = canonical(entries)
    at = np.searchsorted(symbols, words)
    code, width = np.array([codes[s][0] for s in symbols.tolist()], np.uint64)[at], np.array([codes[s][1] for s in symbols.tolist()])[at]
    head = struct.pack("<I", len(entries)) + b"".join(struct.pack("<IB", s, n) for n, s in entries)
    return head + struct.pack("<Q", int(width.sum())) + to_bits(code, width)


def _huffman_decode(entries, payload, size, n):
    """Finds the code at every bit of a part at once, then walks from code to code.

    Codes moved to the top of 32 bits ascend, so the code at a place is the last that
    isn't above its next 32 bits; most are told by the first PEEK bits alone.
    """
    if len({s for _, s in entries}) != len(entries) or entries != sorted(entries) or any(not 1 <= k <= 32 for k, _ in entries):
        raise EngineError("CorruptLiteralEncoding", "entries")
    check_padding(payload, size)
    codes = canonical(entries)
    symbol, length = np.array([s for _, s in entries], np.uint32), np.array([k for k, _ in entries], np.int64)
    first = np.array([codes[s][0] << 32 - k for k, s in entries], np.uint64)
    beyond = first + (np.uint64(1) << (32 - length).astype(np.uint64))
    low = np.arange(1 << PEEK, dtype=np.uint64) << np.uint64(32 - PEEK)
    peek, last = np.searchsorted(first, low, "right") - 1, np.searchsorted(first, low | np.uint64((1 << 32 - PEEK) - 1), "right") - 1
    peek[peek != last] = -1
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(5, np.uint8)]).astype(np.uint64)
    out, k, at = np.empty(n, np.uint32), 0, 0
    for a in range(0, size, 8 * CHUNK):
        b = min(size, a + 8 * CHUNK)
        if at >= b:
            continue
        part = raw[a // 8 : -(-b // 8) + 5]
        five = sum(part[i : len(part) - 5 + i] << np.uint64(32 - 8 * i) for i in range(5))
        ahead = ((five[:, None] >> np.arange(8, 0, -1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).ravel()[: b - a]
        own = peek[ahead >> np.uint64(32 - PEEK)]
        unclear = np.flatnonzero(own < 0)
        own[unclear] = np.searchsorted(first, ahead[unclear], "right") - 1
        step = np.where(ahead < beyond[own], length[own], 0).tolist()
        places, i, end = [], at - a, b - a
        while i < end:
            places.append(i)
            i += step[i] or end + 33  # no code begins here
        if i > end + 32:
            raise EngineError("CorruptLiteralEncoding", "no code")
        if k + len(places) > n:
            raise EngineError("CorruptLiteralEncoding", "too many words")
        out[k : k + len(places)] = symbol[own[places]]
        k, at = k + len(places), a + i
    if k != n or at != size:
        raise EngineError("CorruptLiteralEncoding", "too few words")
    return out


# ---- rans ------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of SCALE, none below 1; ties and halves go as the format fixes them."""
    f = np.maximum(1, np.floor(counts / counts.sum() * SCALE + 0.5)).astype(np.int64)
    over = int(f.sum()) - SCALE
    if over < 0:
        f[int(f.argmax())] -= over
    elif over > 0:
        slack = f - 1
        cut = np.minimum(slack * over // slack.sum(), slack)
        cut = np.minimum(cut, np.maximum(0, over - np.concatenate([[0], np.cumsum(cut)[:-1]])))
        f -= cut
        over -= int(cut.sum())
        while over:
            can = np.flatnonzero(f > 1)[:over]
            f[can] -= 1
            over -= len(can)
    return f


def rans_lanes(words: np.ndarray, symbols: np.ndarray, f: np.ndarray) -> list[bytes]:
    cum = np.concatenate([[0], np.cumsum(f)[:-1]])
    at = np.searchsorted(symbols, words)
    own_f, own_c = f[at].tolist(), cum[at].tolist()
    lanes = []
    for lane in range(LANES):
        state, out = LOW, bytearray()
        for i in range(len(words) - 1 - (len(words) - 1 - lane) % LANES if lane < len(words) else -1, -1, -LANES):
            most = (LOW >> SCALE_BITS << 8) * own_f[i]
            while state >= most:
                out.append(state & 255)
                state >>= 8
            state = ((state // own_f[i]) << SCALE_BITS) + state % own_f[i] + own_c[i]
        out += struct.pack("<I", state)
        lanes.append(bytes(out[::-1]))
    return lanes


def _rans(words, symbols, counts):
    f = frequencies(counts)
    lanes = rans_lanes(words, symbols, f)
    payload = b"".join(struct.pack(">I", len(x)) for x in lanes) + b"".join(lanes)
    return struct.pack("<I", len(symbols)) + b"".join(struct.pack("<II", s, k) for s, k in zip(symbols.tolist(), f.tolist())) + struct.pack("<Q", len(payload)) + payload


def rans_bound(counts: np.ndarray) -> int:
    """Bytes that a body has at least: the ideal code under the scaled frequencies, less what rounding may give."""
    n = int(counts.sum())
    ideal = float((-counts * np.log2(frequencies(counts) / SCALE)).sum()) / 8
    return 13 + 8 * len(counts) + 16 + max(0, int(ideal) - 2 - (n >> 20))


def _rans_decode(symbols, f, payload, n):
    if (f == 0).any() or f.sum() != SCALE or (np.diff(symbols) <= 0).any():
        raise EngineError("CorruptLiteralEncoding", "frequencies")
    if len(payload) < 4 * LANES:
        raise EngineError("TruncatedLiteralEncoding", "lanes")
    sizes = struct.unpack(">4I", payload[:16])
    if 16 + sum(sizes) != len(payload):
        raise EngineError("CorruptLiteralEncoding", "lanes")
    cum = np.concatenate([[0], np.cumsum(f)[:-1]])
    slot = np.repeat(np.arange(len(f)), f).tolist()
    fs, cs, out, at = f.tolist(), cum.tolist(), np.empty(n, np.uint32), 16
    for lane, size in enumerate(sizes):
        data, k = payload[at : at + size], 4
        at += size
        if size < 4:
            raise EngineError("TruncatedLiteralEncoding", "state")
        state = struct.unpack(">I", data[:4])[0]
        for i in range(lane, n, LANES):
            low = state & (SCALE - 1)
            j = slot[low]
            out[i] = symbols[j]
            state = fs[j] * (state >> SCALE_BITS) + low - cs[j]
            while state < LOW:
                if k >= size:
                    raise EngineError("TruncatedLiteralEncoding", "lane")
                state, k = state << 8 | data[k], k + 1
        if state != LOW or k != size:
            raise EngineError("CorruptLiteralEncoding", "state")
    return out


# ---- choice ----------------------------------------------------------------------------


def sizes(words: np.ndarray, bits: int, every: bool = False) -> dict[str, int]:
    """Bytes of each body that applies. Unless ``every``, rans is left out where its bound shows that it can't win."""
    n = len(words)
    out = {"raw": 1 + n * storage(bits)}
    if not n:
        return out
    out["bitpack"] = 2 + (n * max(1, int(words.max()).bit_length()) + 7) // 8
    symbols, counts = np.unique(words, return_counts=True)
    if len(symbols) <= MOST_SYMBOLS["huffman"]:
        length = code_lengths(list(zip(symbols.tolist(), counts.tolist())))
        if max(length.values()) <= 32:
            out["huffman"] = 13 + 5 * len(symbols) + (sum(length[s] * c for s, c in zip(symbols.tolist(), counts.tolist())) + 7) // 8
    if len(symbols) <= MOST_SYMBOLS["rans"] and (every or rans_bound(counts) < min(out.values())):
        out["rans"] = 13 + 8 * len(symbols) + 16 + sum(map(len, rans_lanes(words, symbols, frequencies(counts))))
    return out


def choose(words: np.ndarray, bits: int) -> tuple[int, str]:
    """(bytes, codec): the smallest body, the lower tag among equals."""
    size, _, name = min((n, TAGS[c], c) for c, n in sizes(words, bits).items())
    return size, name


def encode(words: np.ndarray, bits: int, codec: str | None = None) -> bytes:
    codec = codec or choose(words, bits)[1]
    tag = bytes([TAGS[codec]])
    if codec == "raw":
        return tag + packed(words, bits)
    if codec == "bitpack":
        width = max(1, int(words.max()).bit_length())
        return tag + bytes([width]) + to_bits(words, width)
    symbols, counts = np.unique(words, return_counts=True)
    return tag + (_huffman if codec == "huffman" else _rans)(words, symbols, counts)


def decode(body: bytes, bits: int, n: int) -> np.ndarray:
    """The words of any valid body; whatever isn't one is an error."""
    try:
        tag, rest = body[0], body[1:]
        if tag == 0:
            if len(rest) != n * storage(bits):
                raise EngineError("TruncatedLiteralEncoding" if len(rest) < n * storage(bits) else "TrailingLiteralBytes")
            out = unpacked(rest, bits)
        elif tag == 1:
            width = rest[0]
            if not 1 <= width <= bits or len(rest) - 1 != (n * width + 7) // 8:
                raise EngineError("CorruptLiteralEncoding", "width")
            out = from_bits(rest[1:], width, n)
        elif tag in (2, 3):
            count, step = struct.unpack_from("<I", rest)[0], 5 if tag == 2 else 8
            if not 0 < count <= n or count > 1 << bits or 4 + count * step + 8 > len(rest):
                raise EngineError("CorruptLiteralEncoding", "entries")
            entries = [struct.unpack_from("<IB" if tag == 2 else "<II", rest, 4 + i * step) for i in range(count)]
            size, payload = struct.unpack_from("<Q", rest, 4 + count * step)[0], rest[12 + count * step :]
            if len(payload) != ((size + 7) // 8 if tag == 2 else size):
                raise EngineError("TrailingLiteralBytes")
            out = _huffman_decode([(k, s) for s, k in entries], payload, size, n) if tag == 2 else _rans_decode(np.array([s for s, _ in entries]), np.array([k for _, k in entries]), payload, n)
        else:
            raise EngineError("UnknownLiteralEncoding", str(tag))
    except (IndexError, struct.error) as e:
        raise EngineError("TruncatedLiteralEncoding", str(e)) from None
    if bits < 32 and len(out) and int(out.max()) >> bits:
        raise EngineError("InvalidLiteralValue")
    return out
