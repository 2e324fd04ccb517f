"""Compress, decompress, verify and calibrate: tables of tensors in, tables out; files by way of the same."""

from __future__ import annotations

import itertools
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions.dtypes import DTYPES, EngineError
from wordloom.sources import archives, checkpoints

from . import literals, program
from .prior import Prior
from .search import Config, Result, observe, synthesize

TENSORS = ["path", "ord", "name", "dtype", "shape", "data"]
STATS = "source_bytes bigint, program_bytes bigint, status string, expanded int, completed int"
CALIBRATION = 256
#: Words of a tensor that calibration looks at.
SAMPLE_WORDS = 1 << 20


def write_program(p: program.Node) -> bytes:
    return program.serialize(p)


def read_program(data: bytes) -> program.Node:
    return program.deserialize(data)


def program_size(p: program.Node) -> int:
    return 5 + program.size(p)


def spread(tensors: DataFrame) -> DataFrame:
    """Tensors over four tasks a core by a hash of their place, the largest of a task first; two large ones may meet."""
    n = tensors.sparkSession.sparkContext.defaultParallelism * 4
    return tensors.repartition(n, "path", "ord").sortWithinPartitions(F.length("data").desc())


def compress(tensors: DataFrame, config: Config = Config(), prior: Prior | None = None) -> DataFrame:
    """The archive table and statistics of each tensor; the search of a tensor is one row's work."""
    raw = prior.serialize() if prior else None

    def run(batches):
        import pandas as pd

        known = Prior.deserialize(raw) if raw else None
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                data = bytes(x.data)
                r: Result = synthesize(literals.unpacked(data, DTYPES[x.dtype].bits), x.dtype, config, known)
                code = program.serialize(r.program)
                rows.append((x.path, x.ord, x.name, x.dtype, list(x.shape), code, archives.checksum(data), len(data), len(code), r.status, r.expanded, r.completed))
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "dtype", "shape", "bytecode", "checksum", "source_bytes", "program_bytes", "status", "expanded", "completed"])

    return spread(tensors.select(*TENSORS)).mapInPandas(run, f"{archives.SCHEMA}, {STATS}")


def decompress(archive: DataFrame) -> DataFrame:
    """path, ord, name, dtype, shape, data, error: a record that can't be restored has no data and its error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                try:
                    rows.append((x.path, x.ord, x.name, x.dtype, list(x.shape), archives.restore(x.dtype, x.shape, bytes(x.bytecode), x.checksum), None))
                except EngineError as e:
                    rows.append((x.path, x.ord, x.name, x.dtype, list(x.shape), None, e.code))
            yield pd.DataFrame(rows, columns=[*TENSORS, "error"])

    return archive.select("path", "ord", "name", "dtype", "shape", "bytecode", "checksum").mapInPandas(run, "path string, ord int, name string, dtype string, shape array<bigint>, data binary, error string")


def verify(archive: DataFrame, tensors: DataFrame) -> DataFrame:
    """The tensors that an archive doesn't give back exactly, with the reason. Nothing is written."""
    got = decompress(archive).select("path", "ord", F.struct("name", "dtype", "shape", "data").alias("got"), "error")
    want = tensors.select("path", "ord", F.struct("name", "dtype", "shape", "data").alias("want"))
    both = want.join(got, ["path", "ord"], "full_outer")
    reason = F.when(F.col("got").isNull(), "MissingRecord").when(F.col("want").isNull(), "MetadataMismatch").when(F.col("error").isNotNull(), F.col("error")).when(F.struct("got.name", "got.dtype", "got.shape") != F.struct("want.name", "want.dtype", "want.shape"), "MetadataMismatch").when(F.col("got.data") != F.col("want.data"), "SourceMismatch")
    return both.select("path", "ord", reason.alias("reason")).filter("reason is not null")


def select_for_calibration(tensors: DataFrame, most: int = CALIBRATION) -> DataFrame:
    """The first of each type and power of two of bytes, by turns from both ends; then the others from both ends of the files.

    Lengths alone are ranked; the tensors picked, ``most`` at most, are then looked up.
    """
    sized = tensors.select("path", "ord", "dtype", F.length("data").alias("__n")).withColumn("__bucket", F.length(F.bin(F.greatest("__n", F.lit(1)))) - 1)
    first = sized.withColumn("__r", F.row_number().over(W.partitionBy("dtype", "__bucket").orderBy("path", "ord")))
    up, down = W.partitionBy("dtype", "__lead").orderBy("__bucket"), W.partitionBy("dtype", "__lead").orderBy(F.col("__bucket").desc())
    ranked = first.withColumn("__lead", F.col("__r") == 1)
    turn = F.least(2 * (F.row_number().over(up) - 1), 2 * F.row_number().over(down) - 1)
    ranked = ranked.withColumn("__turn", F.when(F.col("__lead"), turn).otherwise(F.least("ord", F.lit(1 << 30))))
    picked = ranked.orderBy(F.col("__lead").desc(), "__turn", "dtype", "path", "ord").limit(most).select("path", "ord")
    return tensors.join(F.broadcast(picked), ["path", "ord"], "left_semi").select(*TENSORS)


def calibrate(tensors: DataFrame, config: Config = Config(), most: int = CALIBRATION) -> Prior:
    """Searches a sample of tensors without a prior and counts what the programs are made of.

    Tasks send counts by context, which Spark adds up; rows are contexts, not tensors.
    """

    def run(batches):
        import pandas as pd

        own, levels = Prior(), []
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                d = DTYPES[x.dtype]
                w = literals.unpacked(bytes(x.data)[: SAMPLE_WORDS * d.bytes], d.bits)
                if len(w):
                    observe(own, synthesize(w, x.dtype, config).program, w, d.bits, x.dtype)
        for level, rows in enumerate(own.levels):
            levels += [(level, [int(k) for k in key], int(p), int(c)) for key, row in rows.items() for p, c in row.items()]
        yield pd.DataFrame(levels, columns=["level", "context", "production", "cnt"])

    if most <= 0:
        return Prior()
    counted = select_for_calibration(tensors, most).repartition(tensors.sparkSession.sparkContext.defaultParallelism, "path", "ord").mapInPandas(run, "level int, context array<int>, production int, cnt bigint")
    prior = Prior()
    for r in counted.groupBy("level", "context", "production").agg(F.sum("cnt").alias("cnt")).collect():  # bounded by the calibration sample
        prior.levels[r["level"]][tuple(r["context"])][r["production"]] += r["cnt"]
    return prior


def compress_file(spark: SparkSession, source: str, target: str, config: Config = Config(), prior: Prior | None = None, calibration: int = CALIBRATION, most: checkpoints.Most = checkpoints.Most()) -> dict:
    """One checkpoint to one archive file; returns sums. Without a prior one is learned from the checkpoint itself."""
    if source == target:
        raise EngineError("InputOutputPathConflict")
    prefix, size = checkpoints.read_prefix(spark, source)
    entries = checkpoints.parse_header(prefix)[0]
    most.check(entries, len(prefix))
    tensors = checkpoints.read_tensors(spark, source)
    if prior is None and config.expansions > 0 and calibration > 0:
        teacher = replace(config, expansions=6, seed_float=True) if config.expansions == 1 else config
        prior = calibrate(tensors, teacher, min(calibration, 4) if config.expansions == 1 else calibration)
    with _parts(compress(tensors, config, prior), target) as records:
        head = archives.encode_header(prefix, len(entries))
        made = (archives.encode_record(r["name"], r["dtype"], r["shape"], bytes(r["bytecode"]), bytes(r["checksum"])) for r in _in_order(records, len(entries)))
        written = checkpoints.write_parts(spark, target, itertools.chain([head], made))
        s = records.agg(F.sum((F.substring("bytecode", 6, 1) != F.lit(bytearray(b"\x01"))).cast("int")).alias("structured"), F.sum("expanded").alias("expanded")).first()
    return {"tensors": len(entries), "source_bytes": size, "archive_bytes": written, "structured": s["structured"] or 0, "expanded": s["expanded"] or 0}


@contextmanager
def _parts(rows: DataFrame, target: str):
    """Rows as a table beside the file that is made of them, so that its order costs no second computation; deleted afterwards."""
    spark, folder = rows.sparkSession, f"{target}.parts"
    try:
        rows.write.mode("overwrite").parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _in_order(rows: DataFrame, n: int):
    """Rows by ord, a part at a time: the driver holds one part, never the file."""
    got = 0
    for r in rows.orderBy("ord").toLocalIterator():
        got += 1
        yield r
    if got != n:
        raise EngineError("MetadataMismatch", f"{got} of {n} tensors")


def archive_table(spark: SparkSession, path: str, most: checkpoints.Most = checkpoints.Most()) -> tuple[bytes, DataFrame]:
    """The checkpoint's header and the records of an archive file, each bound to its entry.

    The driver walks over lengths and heads; tasks read the records where they stand, or
    get them from the driver where the store can't be read in places.
    """
    with checkpoints.DriverFile(spark, path) as f:
        prefix, places = archives.walk(f.read_at, f.size)
        entries, rows = checkpoints.parse_header(prefix)[0], []
        most.check(entries, len(prefix))
        if len(entries) != len(places):
            raise EngineError("MetadataMismatch")
        local = checkpoints._seekable(f.uri)
        for i, (e, (at, n)) in enumerate(zip(entries, places)):
            head = archives.record_head(e.name, e.dtype, e.shape)
            if f.read_at(min(n, len(head)), at) != head:
                raise EngineError("MetadataMismatch", e.name)
            rows.append((f.uri, i, at, n, None if local else bytearray(f.read_at(n, at))))
        uri = f.uri
    if local:
        local.close()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for x in pdf.itertuples(index=False):
                if x.body is None:
                    with checkpoints._seekable(uri) as f:
                        body = f.read_at(int(x.n), int(x.at))
                else:
                    body = bytes(x.body)
                name, kind, shape, code, check = archives.decode_record(body)
                yield pd.DataFrame([(path, x.ord, name, kind, shape, code, check)], columns=["path", "ord", "name", "dtype", "shape", "bytecode", "checksum"])

    table = spark.createDataFrame(rows, "uri string, ord int, at bigint, n bigint, body binary")
    return prefix, table.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "ord").mapInPandas(run, archives.SCHEMA)


def decompress_file(spark: SparkSession, archive: str, target: str, most: checkpoints.Most = checkpoints.Most()) -> int:
    """The checkpoint of an archive file; returns its bytes. A record that can't be restored is an error, and nothing is put in place."""
    prefix, table = archive_table(spark, archive, most)
    n = len(checkpoints.parse_header(prefix)[0])

    def data(rows):
        for r in _in_order(rows, n):
            if r["error"]:
                raise EngineError(r["error"], r["name"])
            yield bytes(r["data"])

    with _parts(decompress(table), target) as rows:
        return checkpoints.write_parts(spark, target, itertools.chain([prefix], data(rows)))


def verify_file(spark: SparkSession, archive: str, source: str, most: checkpoints.Most = checkpoints.Most()) -> None:
    """An error unless the archive gives the checkpoint back, header and all. Tensors are compared as rows, where they are."""
    prefix, table = archive_table(spark, archive, most)
    if checkpoints.read_prefix(spark, source)[0] != prefix:
        raise EngineError("SourceMismatch")
    one = F.lit("")
    bad = verify(table.withColumn("path", one), checkpoints.read_tensors(spark, source).withColumn("path", one)).orderBy("ord").limit(1).collect()
    if bad:
        raise EngineError(bad[0]["reason"])


def execute(p: program.Node) -> np.ndarray:
    program.type_of(p)
    return program.execute(p)
