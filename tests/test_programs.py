import random
import tracemalloc

import numpy as np
import pytest

from wordloom.functions.dtypes import DTYPES, EngineError
from wordloom.plans import grammar as gr
from wordloom.plans import literals as li
from wordloom.plans import program as pr
from wordloom.plans.prior import ROOT, Prior, context, log_cost
from wordloom.plans.search import Config, observe, synthesize

# Fixed bytes of the format: a program of all seven kinds of nodes, and its words.
GOLDEN = bytes.fromhex("4252504702030204020501010108020300010206020007010402020401010104010200 02".replace(" ", ""))


def test_golden_bytes(spark):
    p = pr.deserialize(GOLDEN)
    assert pr.serialize(p) == GOLDEN and pr.type_of(p) == (8, 6) and pr.execute(p).tolist() == [0, 3, 0, 3, 0, 33] and 5 + pr.size(p) == len(GOLDEN)
    assert [r["word"] for r in pr.lower(spark, p).orderBy("pos").collect()] == [0, 3, 0, 3, 0, 33]


def test_mutations_fail_safely_or_are_canonical():
    rng = random.Random(1)
    for _ in range(600):
        data = bytearray(GOLDEN)
        data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            p = pr.deserialize(bytes(data), most_bytes=1 << 20)
        except EngineError:
            continue
        assert pr.deserialize(pr.serialize(p)).kind == p.kind
    for n in range(len(GOLDEN)):
        with pytest.raises(EngineError):
            pr.deserialize(GOLDEN[:n])
    with pytest.raises(EngineError):
        pr.deserialize(GOLDEN + b"\0")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 12, 16, 23, 32])
def test_bodies_have_their_size_and_come_back(bits):
    rng = np.random.default_rng(bits)
    top = (1 << bits) - 1
    for w in (rng.integers(0, top + 1, 300), np.minimum(rng.geometric(0.5, 900), top), np.full(5, top), np.array([3 & top, 1])):
        w = w.astype(np.uint32)
        for codec, n in li.sizes(w, bits, True).items():
            body = li.encode(w, bits, codec)
            assert len(body) == n and np.array_equal(li.decode(body, bits, len(w)), w)
            for bad in (body[:-1], body + b"\0", bytes([9]) + body[1:]):
                with pytest.raises(EngineError):
                    li.decode(bad, bits, len(w))


def test_codec_choice():
    assert li.choose(np.array([8, 0]), 8) == (3, "raw") and li.choose(np.arange(256), 8)[1] == "raw"
    assert li.choose((np.arange(128) & 1).astype(np.uint32), 8)[1] == "bitpack"
    wide = np.array([0, (1 << 32) - 1] * 600, np.uint32)
    assert li.choose(wide, 32)[1] == "huffman"
    skewed = np.where(np.arange(8000) % 100, 0, (1 << 32) - 1).astype(np.uint32)
    assert li.choose(skewed, 32)[1] == "rans"
    f = li.frequencies(np.array([1, 1, 10**6]))
    assert f.sum() == li.SCALE and f.min() == 1
    assert li.frequencies(np.ones(10000)).sum() == li.SCALE


@pytest.mark.parametrize("dtype", ["U8", "F8_E4M3", "F16", "BF16", "U32", "F32"])
def test_every_choice_gives_its_stream(dtype):
    bits, rng = DTYPES[dtype].bits, np.random.default_rng(5)
    for w in (np.full(6, 3), rng.integers(0, 1 << bits, 12), np.tile(rng.integers(0, 1 << bits, 3), 4), np.zeros(0, int)):
        w = w.astype(np.uint32)
        choices = gr.propose(w, bits, dtype, 0)
        assert choices[0].family == "Lit" and len(choices) <= 59
        for c in choices:
            kids = gr.children(c, w, bits)
            assert sum(len(x) * gr.storage(b) for x, b in kids) == gr.storage_bytes(c, len(w), bits)
            p = gr.build(c, w, bits, [pr.lit(x, b) for x, b in kids])
            assert np.array_equal(pr.execute(p), w) and pr.type_of(p) == (bits, len(w))
            assert gr.fixed_bytes(c, w, bits) <= pr.size(p) - sum(pr.size(k) for k in p.children)


def test_search():
    a = np.array([0x3F800000, 0xBF800000] * 128, np.uint32)
    assert synthesize(a, "F32", Config(expansions=0)).program.kind == "Lit"
    r = synthesize(a, "F32", Config(expansions=64))
    assert r.program.kind == "Repeat" and r.bytes == len(pr.serialize(r.program)) and np.array_equal(pr.execute(r.program), a)
    s = np.array([((i & 1) << 31) | 0x3F800000 | (i * 7919) & 0x7FFFFF for i in range(256)], np.uint32)
    learned = synthesize(s, "F32", Config(expansions=64))
    prior = Prior()
    observe(prior, learned.program, s, 32, "F32")
    one = synthesize(s, "F32", Config(expansions=1), prior)
    assert one.program.kind != "Lit" and one.bytes < synthesize(s, "F32", Config(expansions=1)).bytes
    assert synthesize(np.full(9, 5), "U8", Config(expansions=16)).program.kind == "Const"
    assert synthesize(np.zeros(0), "U8").bytes == 5 + pr.size(pr.lit([], 8))
    for n in (1, 8, 32):
        plain = synthesize(s[:64], "F32", Config(expansions=n, heuristic=False))
        assert np.array_equal(pr.execute(plain.program), s[:64])


def test_prior():
    assert log_cost(1, 2) == 1024 and log_cost(1, 16) == 4096 and log_cost(1, 3) == 1623
    p, q = Prior(), Prior()
    keys = [context(np.arange(9, dtype=np.uint32), 8, "U8", ROOT, 0, 0), context(np.zeros(4, np.uint32), 8, "U8", 3, 1, 2)]
    for x, order in ((p, keys), (q, keys[::-1])):
        for k in order:
            x.observe(k, 0, 2)
            x.observe(k, 13)
    assert p.serialize() == q.serialize() == Prior.deserialize(p.serialize()).serialize()
    assert p.costs(keys[0], [0, 13, 20])[0] < p.costs(keys[0], [0, 13, 20])[13] < p.costs(keys[0], [0, 13, 20])[20]
    assert Prior().costs((), [0, 1]) == {0: 1024, 1: 1024}
    bounds = p.bounds(2)
    assert all(bounds[k] <= c for k, c in p.costs(keys[0], [0, 13]).items())
    for bad in (b"", p.serialize()[:-1], p.serialize() + b"\0", b"XXXX" + p.serialize()[4:]):
        with pytest.raises(EngineError):
            Prior.deserialize(bad)


def test_search_holds_one_branch_of_words():
    w = np.random.default_rng(3).normal(0, 1, 400_000).astype("<f4").view(np.uint32)
    tracemalloc.start()
    r = synthesize(w, "F32", Config(expansions=32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one branch, and the heap of one Huffman code, whose symbols are bounded
    assert np.array_equal(pr.execute(r.program), w) and peak < (32 << 20) + 12 * 4 * len(w)


def test_shapes_are_those_of_the_children():
    w = np.tile(np.random.default_rng(1).integers(0, 1 << 16, 3), 4).astype(np.uint32)
    for c in gr.propose(w, 16, "BF16", 0):
        kids = gr.children(c, w, 16)
        assert [(len(x), b) for x, b in kids] == gr.shapes(c, len(w), 16)
        assert all(np.array_equal(x, gr.child(c, w, 16, i)) for i, (x, _) in enumerate(kids))


@pytest.mark.parametrize("n", [1, 7, li.CHUNK - 1, li.CHUNK, 3 * li.CHUNK + 5])
def test_bits_across_parts(n):
    rng = np.random.default_rng(n)
    for bits in (1, 5, 17, 32):
        w = rng.integers(0, 1 << bits, n).astype(np.uint32)
        body = li.to_bits(w, bits)
        assert body == int("".join(f"{x:0{bits}b}" for x in w.tolist()).ljust(-(-n * bits // 8) * 8, "0"), 2).to_bytes(-(-n * bits // 8), "big")
        assert np.array_equal(li.from_bits(body, bits, n), w)
    w = np.minimum(rng.geometric(0.3, n), 30).astype(np.uint32)  # codes shorter and longer than what is looked up
    assert np.array_equal(li.decode(li.encode(w, 8, "huffman"), 8, n), w)


def test_huffman_rejects_bits_that_are_no_code():
    head = b"\x02" + (1).to_bytes(4, "little") + b"\x07\0\0\0\x01" + (3).to_bytes(8, "little")
    assert li.decode(head + b"\x00", 8, 3).tolist() == [7, 7, 7]
    for payload, n in ((b"\x40", 3), (b"\x00", 2), (b"\x00", 4), (b"\x01", 3)):
        with pytest.raises(EngineError):
            li.decode(head + payload, 8, n)
