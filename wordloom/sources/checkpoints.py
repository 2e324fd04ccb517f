"""Tensor checkpoints: a header of JSON behind an 8-byte length, and tensors back to back.

Header entries: name -> dtype, shape, data_offsets; ``__metadata__`` is a map of strings.
Tensors must tile the data region. Files are listed and written through Spark, so any
store that Spark reaches will do. Where pyarrow knows the store too, tasks seek to the
header and to each tensor, so files may be larger than memory; where it doesn't, they
get whole files, which must then be below 2 GiB. A tensor is one value and must be
below 2 GiB in any case.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.dtypes import EngineError, dtype, numel

MOST_HEADER = 100 << 20
#: Bytes of a value that the JVM can hold; bytes of tensors that a task reads.
MOST_VALUE, PART = (1 << 31) - 64, 256 << 20
RESERVED = "__metadata__"
HEADERS = "ord int, name string, dtype string, shape array<bigint>, begin bigint, `end` bigint"


@dataclass(frozen=True)
class Entry:
    name: str
    dtype: str
    shape: tuple[int, ...]
    begin: int
    end: int


@dataclass(frozen=True)
class Most:
    """Bytes of a header, of a tensor and of all tensors that a file may have."""

    prefix: int = MOST_HEADER
    tensor: int = MOST_VALUE
    total: int = 1 << 50

    def check(self, entries: list[Entry], prefix: int) -> None:
        """From a header alone, before any data is read."""
        if prefix > self.prefix:
            raise EngineError("HeaderLimitExceeded")
        for e in entries:
            if e.end - e.begin > self.tensor:
                raise EngineError("TensorLimitExceeded", e.name)
        if entries and entries[-1].end > self.total:
            raise EngineError("SourceLimitExceeded")


def _entry(name: str, x) -> Entry:
    if not isinstance(x, dict) or set(x) != {"dtype", "shape", "data_offsets"} or not isinstance(x["dtype"], str):
        raise EngineError("MalformedCheckpoint", name)
    whole = lambda v: isinstance(v, list) and all(isinstance(i, int) and not isinstance(i, bool) and i >= 0 for i in v)
    if not whole(x["shape"]) or not whole(x["data_offsets"]) or len(x["data_offsets"]) != 2:
        raise EngineError("MalformedCheckpoint", name)
    begin, end = x["data_offsets"]
    size = dtype(x["dtype"]).bytes
    if begin > end:
        raise EngineError("InvalidDataOffsets", name)
    if numel(x["shape"]) * size != end - begin:
        raise EngineError("ShapeDataMismatch", name)
    return Entry(name, x["dtype"], tuple(x["shape"]), begin, end)


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise EngineError("DuplicateTensorName")
    return out


def parse_header(data: bytes, total: int | None = None, most: int = MOST_HEADER) -> tuple[list[Entry], int]:
    """Entries in order of their data, and where the data begins. ``total``: bytes of the file, if they are to be checked."""
    if len(data) < 8:
        raise EngineError("CheckpointTooShort")
    n = struct.unpack("<Q", data[:8])[0]
    if n > most:
        raise EngineError("HeaderLimitExceeded")
    if len(data) < 8 + n:
        raise EngineError("CheckpointTooShort")
    try:
        head = json.loads(data[8 : 8 + n], object_pairs_hook=_unique)
    except (ValueError, UnicodeDecodeError) as e:
        if isinstance(e, EngineError):
            raise
        raise EngineError("MalformedCheckpoint", "json") from None
    if not isinstance(head, dict):
        raise EngineError("MalformedCheckpoint", "json")
    meta = head.pop(RESERVED, {})
    if not isinstance(meta, dict) or not all(isinstance(v, str) for v in meta.values()):
        raise EngineError("MalformedCheckpoint", RESERVED)
    entries, at = [_entry(k, v) for k, v in head.items()], 0
    entries = [e for _, e in sorted(enumerate(entries), key=lambda x: (x[1].begin, x[1].end, x[0]))]
    for e in entries:
        if e.begin != at:
            raise EngineError("NonContiguousTensorData", e.name)
        at = e.end
    if total is not None and total != 8 + n + at:
        raise EngineError("UnclaimedTensorData" if total > 8 + n + at else "CheckpointTooShort")
    return entries, 8 + n


def build_header(tensors: list[tuple[str, str, tuple[int, ...], int]]) -> bytes:
    """From (name, dtype, shape, bytes), in order."""
    head, at = {}, 0
    for name, kind, shape, size in tensors:
        if name == RESERVED:
            raise EngineError("ReservedTensorName")
        if name in head:
            raise EngineError("DuplicateTensorName", name)
        if numel(list(shape)) * dtype(kind).bytes != size:
            raise EngineError("ShapeDataMismatch", name)
        head[name] = {"dtype": kind, "shape": list(shape), "data_offsets": [at, at + size]}
        at += size
    body = json.dumps(head, separators=(",", ":"), ensure_ascii=False).encode()
    return struct.pack("<Q", len(body)) + body


def encode(tensors: list[tuple[str, str, tuple[int, ...], bytes]]) -> bytes:
    return build_header([(n, d, s, len(b)) for n, d, s, b in tensors]) + b"".join(b for *_, b in tensors)


def decode(data: bytes) -> list[tuple[Entry, bytes]]:
    entries, start = parse_header(data, len(data))
    return [(e, data[start + e.begin : start + e.end]) for e in entries]


def _seekable(uri: str):
    """The file of a store that pyarrow knows, to be read at any place; None for other stores."""
    from pyarrow import fs

    try:
        if uri.startswith(("file:", "/")):
            store, at = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
        else:
            store, at = fs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001 - an unknown scheme, or a store that needs what isn't installed
        return None
    return store.open_input_file(at)


def _header_of(f, total: int) -> tuple[list[Entry], int]:
    first = f.read_at(8, 0)
    n = struct.unpack("<Q", first)[0] if len(first) == 8 else 0
    if n > MOST_HEADER:
        raise EngineError("HeaderLimitExceeded")
    return parse_header(first + f.read_at(min(n, max(0, total - 8)), 8), total)


def _listed(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """path and length of the files, and whether tasks can seek in them; otherwise their content too."""
    files = spark.read.format("binaryFile").load(path)
    one = files.select("path").limit(1).collect()
    f = _seekable(one[0][0]) if one else None
    if f:
        f.close()
    return files.select(*["path", "length"][: 2 if f else 1], *[] if f else [F.length("content").cast("bigint").alias("length"), "content"]), bool(f)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_headers`` and start: the tensor's place in its file. Reads headers alone where it can."""
    files, seek = _listed(spark, path)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                try:
                    if seek:
                        with _seekable(x.path) as f:
                            entries, start = _header_of(f, x.length)
                    else:
                        entries, start = parse_header(bytes(x.content), x.length)
                    rows += [(x.path, i, e.name, e.dtype, list(e.shape), e.begin, e.end, None, start + e.begin) for i, e in enumerate(entries)]
                except EngineError as e:
                    rows.append((x.path, -1, None, None, None, None, None, e.code, None))
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "dtype", "shape", "begin", "end", "error", "start"]).astype({"begin": "Int64", "end": "Int64", "start": "Int64"})

    return files.mapInPandas(run, f"path string, {HEADERS}, error string, start bigint")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, name, dtype, shape, begin, end of every tensor. A bad file is one row with its error."""
    return _entries(spark, path).drop("start")


def read_tensors(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """path, ord, name, dtype, shape, data of every tensor of the files; a bad file fails the read with its error.

    Headers are read first; then tensors are dealt to tasks of about ``part`` bytes, whatever
    file they are in, and each is read by itself.
    """
    files, seek = _listed(spark, path)
    schema, names = "path string, ord int, name string, dtype string, shape array<bigint>, data binary", ["path", "ord", "name", "dtype", "shape", "data"]
    if not seek:

        def whole(batches):
            import pandas as pd

            for pdf in batches:
                for p, data in zip(pdf["path"], pdf["content"]):
                    for i, (e, body) in enumerate(decode(bytes(data))):
                        yield pd.DataFrame([(p, i, e.name, e.dtype, list(e.shape), body)], columns=names)

        return files.select("path", "content").mapInPandas(whole, schema)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for x in pdf.itertuples(index=False):
                if x.error:
                    raise EngineError(x.error, x.path)
                size = int(x.end) - int(x.begin)
                if size > MOST_VALUE:
                    raise EngineError("TensorLimitExceeded", x.name)
                with _seekable(x.path) as f:
                    data = f.read_at(size, int(x.start))
                if len(data) != size:
                    raise EngineError("CheckpointTooShort", x.path)
                yield pd.DataFrame([(x.path, x.ord, x.name, x.dtype, list(x.shape), data)], columns=names)

    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // part))
    return _entries(spark, path).repartition(tasks, "path", "ord").mapInPandas(run, schema)


def layout(headers: DataFrame) -> DataFrame:
    """path, name, contiguous: whether each tensor begins where the one before ends."""
    from pyspark.sql import Window as W

    last = F.lag("end").over(W.partitionBy("path").orderBy("begin", "end", "ord"))
    return headers.select("path", "name", (F.col("begin") == F.coalesce(last, F.lit(0))).alias("contiguous"))


def write_parts(spark: SparkSession, path: str, parts: Iterable[bytes]) -> int:
    """One file in any store, from parts that are held one at a time; returns its bytes.

    Written beside its place, then renamed over it in one step, so that a crash leaves the old one or the new.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(conf)
    out, size = fs.create(tmp, True), 0
    try:
        for data in parts:
            for k in range(0, len(data), 1 << 20):
                out.write(bytearray(data[k : k + (1 << 20)]))
            size += len(data)
    except BaseException:
        out.close()
        fs.delete(tmp, False)
        raise
    out.close()
    to, tmp = fs.makeQualified(to), fs.makeQualified(tmp)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.valueOf("OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(tmp, to, over)
    return size


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    write_parts(spark, path, [data])


class DriverFile:
    """A file of any store, read at any place by the driver; for headers and lengths, not for data."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at) or not fs.getFileStatus(at).isFile():
            raise EngineError("FileNotFound", path)
        self.uri, self.size, self._in = fs.makeQualified(at).toString(), fs.getFileStatus(at).getLen(), fs.open(at)

    def read_at(self, n: int, at: int) -> bytes:
        self._in.seek(min(at, self.size))
        return bytes(self._in.readNBytes(max(0, min(n, self.size - at))))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._in.close()


def read_prefix(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """The header of a checkpoint as it stands in the file, and the bytes of the file."""
    with DriverFile(spark, path) as f:
        _, start = _header_of(f, f.size)
        return f.read_at(start, 0), f.size


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file."""
    with DriverFile(spark, path) as f:
        return f.read_at(f.size, 0)


def from_columns(df: DataFrame, name: str, column: str, kind: str) -> DataFrame:
    """Rows of an array column as tensors: path, ord, name, dtype, shape, data."""
    numpy_type = {"F32": "<f4", "F16": "<f2", "U8": "<u1", "U16": "<u2", "U32": "<u4", "I8": "<i1", "I16": "<i2", "I32": "<i4"}[kind]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            data = [np.asarray(x, numpy_type).tobytes() for x in pdf["x"]]
            yield pd.DataFrame({"path": "table", "ord": pdf["ord"].astype("int32"), "name": pdf["ord"].astype(str), "dtype": kind, "shape": [[len(x)] for x in pdf["x"]], "data": data})

    return df.select(F.col(name).cast("int").alias("ord"), F.col(column).alias("x")).mapInPandas(run, "path string, ord int, name string, dtype string, shape array<bigint>, data binary")
