import json
import struct

import numpy as np
import pytest

from wordloom import cli
from wordloom.functions.dtypes import EngineError
from wordloom.plans import api
from wordloom.plans.program import lit
from wordloom.plans.search import Config
from wordloom.sources import archives as ar
from wordloom.sources import checkpoints as ck
from wordloom.streaming import ingest

MULTI = [("repeat", "F32", (6,), np.array([1, -1] * 3, "<f4").tobytes()), ("constant", "U16", (4,), b"\7\0" * 4), ("empty", "U8", (0,), b""), ("näme \"x\"", "BF16", (2, 4), bytes(range(16)))]


def test_headers():
    data = ck.encode(MULTI)
    assert [(e.name, e.dtype, e.shape, body) for e, body in ck.decode(data)] == MULTI
    ok = {"dtype": "U8", "shape": [4], "data_offsets": [0, 4]}
    for change, code in (({"dtype": "I64"}, "UnsupportedDtype"), ({"shape": [-4]}, "MalformedCheckpoint"), ({"shape": [5]}, "ShapeDataMismatch"), ({"data_offsets": [4, 0]}, "InvalidDataOffsets"), ({"data_offsets": [1, 5]}, "NonContiguousTensorData"), ({"more": 1}, "MalformedCheckpoint")):
        head = json.dumps({"x": ok | change}).encode()
        with pytest.raises(EngineError, match=code):
            ck.parse_header(struct.pack("<Q", len(head)) + head + bytes(8))
    for bad in (b"", b"\xff" * 8, struct.pack("<Q", 4) + b"{}", data + b"\0", data[:-1]):
        with pytest.raises(EngineError):
            ck.decode(bad)
    for bad in ([("__metadata__", "U8", (0,), 0)], [("a", "U8", (1,), 1)] * 2, [("a", "U8", (2,), 1)]):
        with pytest.raises(EngineError):
            ck.build_header(bad)


def test_checksum_and_frames():
    assert ar.checksum(b"") == bytes.fromhex("c294d3380580062d")  # fixed by the format
    prefix = ck.build_header([("x", "U8", (2,), 2)])
    code = api.write_program(api.read_program(api.write_program(lit([1, 2], 8))))
    data = ar.encode_header(prefix, 1) + ar.encode_record("x", "U8", (2,), code, ar.checksum(b"\1\2"))
    got, bodies = ar.frames(data)
    name, kind, shape, bytecode, check = ar.decode_record(bodies[0])
    assert got == prefix and ar.restore(kind, shape, bytecode, check) == b"\1\2"
    for bad in (data[:-1], data + b"\0", b"X" + data[1:]):
        with pytest.raises(EngineError):
            ar.frames(bad)
    with pytest.raises(EngineError, match="ChecksumMismatch"):
        ar.restore(kind, shape, bytecode, bytes(8))
    with pytest.raises(EngineError):
        ar.restore(kind, [3], bytecode, check)


def test_files_round_trip(spark, tmp_path):
    source, archive, back = (str(tmp_path / n) for n in ("a.ckpt", "a.brv", "b.ckpt"))
    (tmp_path / "a.ckpt").write_bytes(ck.encode(MULTI + [("zz", "F32", (256,), np.array([1, -1] * 128, "<f4").tobytes())]))
    s = api.compress_file(spark, source, archive, Config(expansions=16))
    assert s["tensors"] == 5 and s["structured"] >= 1 and s["archive_bytes"] < s["source_bytes"]
    api.verify_file(spark, archive, source)
    assert api.decompress_file(spark, archive, back) == s["source_bytes"] and (tmp_path / "b.ckpt").read_bytes() == (tmp_path / "a.ckpt").read_bytes()
    (tmp_path / "c.brv").write_bytes((tmp_path / "a.brv").read_bytes()[:-1] + b"\x55")
    with pytest.raises(EngineError, match="ChecksumMismatch"):
        api.verify_file(spark, str(tmp_path / "c.brv"), source)
    heads = ck.read_headers(spark, source)
    assert heads.count() == 5 and ck.layout(heads).filter("not contiguous").count() == 0
    with pytest.raises(EngineError):
        api.compress_file(spark, source, source)


def test_headers_and_tensors_are_read_in_place(spark, tmp_path):
    rng = np.random.default_rng(2)
    many = [[(f"t{i}", "F32", (k, 3), rng.normal(size=3 * k).astype("<f4").tobytes()) for i, k in enumerate((5, 0, 400, 7))] for _ in range(3)]
    for i, tensors in enumerate(many):
        (tmp_path / f"m{i}").write_bytes(ck.encode(tensors))
    got = {(r["path"][-2:], r["ord"]): (r["name"], r["dtype"], tuple(r["shape"]), bytes(r["data"])) for r in ck.read_tensors(spark, str(tmp_path), part=100).collect()}
    assert got == {(f"m{i}", j): t for i, tensors in enumerate(many) for j, t in enumerate(tensors)}
    (tmp_path / "m3").write_bytes(ck.encode(many[0])[:-1])
    (tmp_path / "m4").write_bytes(b"short")
    (tmp_path / "m5").write_bytes((1 << 60).to_bytes(8, "little") + b"{}")
    errors = {r["path"][-2:]: r["error"] for r in ck.read_headers(spark, str(tmp_path)).filter("error is not null").collect()}
    assert errors == {"m3": "CheckpointTooShort", "m4": "CheckpointTooShort", "m5": "HeaderLimitExceeded"}
    with pytest.raises(Exception, match="CheckpointTooShort|HeaderLimitExceeded"):
        ck.read_tensors(spark, str(tmp_path)).count()


def test_headers_of_files_beyond_two_gibibytes(spark, tmp_path):
    size, tail = 3 << 30, b"\x07" * 8
    head = ck.build_header([("a", "U8", (1 << 31,), 1 << 31), ("b", "U8", (size - (1 << 31),), size - (1 << 31)), ("c", "U8", (8,), 8)])
    with open(tmp_path / "big", "wb") as f:  # sparse: takes no room
        f.write(head)
        f.seek(len(head) + size)
        f.write(tail)
    path = str(tmp_path / "big")
    assert [(r["name"], r["begin"], r["end"]) for r in ck.read_headers(spark, path).orderBy("ord").collect()] == [("a", 0, 1 << 31), ("b", 1 << 31, size), ("c", size, size + 8)]
    assert ck.read_prefix(spark, path) == (head, len(head) + size + 8)
    with pytest.raises(Exception, match="TensorLimitExceeded"):
        ck.read_tensors(spark, path).count()


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"old")

    def parts():
        yield b"new"
        raise EngineError("Truncated")

    with pytest.raises(EngineError):
        ck.write_parts(spark, str(tmp_path / "x"), parts())
    assert (tmp_path / "x").read_bytes() == b"old" and not (tmp_path / "x.part").exists()


def test_calibration_does_not_hurt_one_expansion(spark, tmp_path):
    rows = [("a", i, f"t{i}", "F32", [64], bytearray(np.array([i, -i] * 32, "<f4").tobytes())) for i in range(1, 7)]
    tensors = spark.createDataFrame(rows, "path string, ord int, name string, dtype string, shape array<bigint>, data binary")
    prior = api.calibrate(tensors, Config(expansions=16), 3)
    with_, without = (api.compress(tensors, Config(expansions=1), p).agg({"program_bytes": "sum"}).first()[0] for p in (prior, None))
    assert with_ <= without and api.verify(api.compress(tensors, Config(expansions=8)), tensors).count() == 0
    assert api.calibrate(tensors, Config(), 0).empty


def test_streamed_checkpoints(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(ck.encode(MULTI))
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), Config(expansions=2), once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(MULTI) and api.verify(got, ck.read_tensors(spark, str(tmp_path / "in"))).count() == 0


def test_command_line(capsys):
    assert cli.main(["config", "--max-expansions", "8"]) == 0 and json.loads(capsys.readouterr().out)["expansions"] == 8
    assert cli.main(["compress", "a", "b.zip"]) == 2
    assert cli.main(["config", "--max-concat-splits", "5", "--max-rotations", "2", "--astar-heuristic", "off"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["limits"]["splits"] == 5 and got["limits"]["rotations"] == 2 and not got["heuristic"] and cli.main(["config", "--max-map-constants", "-1"]) == 2


def test_limits_are_checked_from_headers(spark, tmp_path):
    source, archive = str(tmp_path / "a.ckpt"), str(tmp_path / "a.brv")
    (tmp_path / "a.ckpt").write_bytes(ck.encode(MULTI))
    entries, start = ck.parse_header(ck.encode(MULTI))
    largest, total = max(e.end - e.begin for e in entries), entries[-1].end
    exact = ck.Most(start, largest, total)
    api.compress_file(spark, source, archive, Config(expansions=0), most=exact)
    api.verify_file(spark, archive, source, exact)
    for most, code in ((ck.Most(prefix=start - 1), "HeaderLimitExceeded"), (ck.Most(tensor=largest - 1), "TensorLimitExceeded"), (ck.Most(total=total - 1), "SourceLimitExceeded")):
        with pytest.raises(EngineError, match=code):
            api.compress_file(spark, source, archive, most=most)
        with pytest.raises(EngineError, match=code):
            api.decompress_file(spark, archive, str(tmp_path / "b"), most)
    assert not (tmp_path / "b").exists()


def test_each_altered_checksum_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    from wordloom.plans import registry

    whole = range(1 << 24)  # numbers that F32 holds exactly
    zeros = next(i for i in whole if ar.checksum(np.array([i], "<f4").tobytes())[:2] == bytes(2))
    rows = spark.createDataFrame([(0, [float(zeros)]), (1, [float(zeros)]), (2, [1.0])], "vec_id bigint, embedding array<double>")
    rows.select("vec_id", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["archive_verify_mismatch"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["reason"]) for r in got) == [(0, "ChecksumMismatch"), (2, "ChecksumMismatch")]
