"""Queries over programs and archives: whole tensors through the packed engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.dtypes import DTYPES
from wordloom.sources import archives
from wordloom.sources.checkpoints import from_columns

from . import api, literals, program
from .search import Config

#: Expansions a tensor.
CONFIG = Config(expansions=16)


def tensors(spark, d) -> DataFrame:
    return from_columns(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "F32")


def _literal_sizes(spark, d) -> DataFrame:
    """Exact body sizes of each tensor's exponents."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, data in zip(pdf["ord"], pdf["data"]):
                s = literals.sizes(program.split_words(literals.unpacked(bytes(data), 32), [(23, 8)])[0], 8, True)
                rows.append((int(i), *[s.get(c) for c in ("raw", "bitpack", "huffman", "rans")]))
            yield pd.DataFrame(rows, columns=["vec_id", "raw", "bitpack", "huffman", "rans"])

    return tensors(spark, d).mapInPandas(run, "vec_id bigint, raw bigint, bitpack bigint, huffman bigint, rans bigint")


def rans_sizes(spark, d) -> DataFrame:
    return _literal_sizes(spark, d).select("vec_id", "rans")


def best_sizes(spark, d) -> DataFrame:
    from wordloom.operators import encodings as en

    return en.best(_literal_sizes(spark, d), ["vec_id"], ["raw", "bitpack", "huffman", "rans"])


def _words(archive: DataFrame) -> DataFrame:
    """vec_id, pos, word of what an archive gives back."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(int(i), literals.unpacked(bytes(data), 32).astype(np.int64)) for i, data in zip(pdf["ord"], pdf["data"])]
            yield pd.DataFrame(rows, columns=["vec_id", "w"])

    return api.decompress(archive).mapInPandas(run, "vec_id bigint, w array<bigint>").select("vec_id", F.posexplode("w").alias("pos", "word")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), "word")


def archive_roundtrip(spark, d) -> DataFrame:
    return _words(api.compress(tensors(spark, d), CONFIG))


def prog_roundtrip(spark, d) -> DataFrame:
    """Every tensor through a fixed program of fields, a scan and a map, its bytes and back."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                w = literals.unpacked(bytes(x.data), 32)
                kids = program.split_words(w, program.wd.layout("float_fields", 32, dtype=DTYPES["F32"]))
                gray = program.Node("Map", op="gray", children=[program.lit(program.map_words("gray", 0, kids[1], 8, inverse=True), 8)])
                scan = program.Node("Scan", op="add_mod", param=int(kids[2][0]), children=[program.lit(program.scan_updates("add_mod", kids[2], 23), 23)])
                p = program.Node("Merge", op="float_fields", param="F32", children=[program.lit(kids[0], 1), gray, scan])
                code = program.serialize(p)
                rows.append((x.path, x.ord, x.name, x.dtype, list(x.shape), code, archives.checksum(bytes(x.data))))
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "dtype", "shape", "bytecode", "checksum"])

    return _words(tensors(spark, d).mapInPandas(run, archives.SCHEMA))


def prog_lowered(spark, d) -> DataFrame:
    """A program of all kinds of nodes as a DataFrame plan."""
    half = program.Node("Merge", op="fields", param=4, children=[program.const(1, 4, 1), program.lit([2], 4)])
    p = program.Node("Concat", children=[program.Node("Repeat", param=2, children=[program.Node("Map", op="xor", param=1, children=[program.lit([1, 2], 8)])]), program.Node("Scan", op="add_mod", param=0, children=[half])])
    return program.lower(spark, p)


def prog_sizes(spark, d) -> DataFrame:
    """Bytes of each tensor as one raw literal's program."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["ord"].astype("int64"), "bytes": [5 + 3 + len(program.leb(1 + len(x))) + len(literals.encode(literals.unpacked(bytes(x), 32), 32, "raw")) for x in pdf["data"]]})

    return tensors(spark, d).mapInPandas(run, "vec_id bigint, bytes bigint")


def verify_mismatch(spark, d) -> DataFrame:
    """An archive whose even records have a bit of their checksum turned over: each is found, no other."""
    archive = api.compress(tensors(spark, d), Config(expansions=0))
    digits = F.hex("checksum")
    turned = F.translate(F.substring(digits, 1, 1), "0123456789ABCDEF", "1032547698BADCFE")  # whatever the digit was, it is another
    flip = F.when(F.col("ord") % 2 == 0, F.unhex(F.concat(turned, F.substring(digits, 2, 15)))).otherwise(F.col("checksum"))
    return api.verify(archive.withColumn("checksum", flip), tensors(spark, d)).select(F.col("ord").cast("bigint").alias("vec_id"), "reason")


def search_stats(spark, d) -> DataFrame:
    return api.compress(tensors(spark, d), CONFIG).select(F.col("ord").cast("bigint").alias("vec_id"), "source_bytes", "program_bytes", "status", "expanded", "completed")


def calibrated(spark, d) -> DataFrame:
    """The contexts and counts that calibration learns, at the widest level."""
    prior = api.calibrate(tensors(spark, d), CONFIG)
    rows = [(k[0], k[1], p, c) for k, row in sorted(prior.levels[2].items()) for p, c in sorted(row.items())]
    return spark.createDataFrame(rows, "parent int, slot int, production int, cnt bigint")


_EMB = "SELECT vec_id, (i - 1)::BIGINT AS pos, ((embedding[i]::FLOAT)::BIT::INTEGER)::BIGINT & 4294967295 AS word FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"
QUERIES = {
    "archive_roundtrip": (archive_roundtrip, _EMB), "prog_roundtrip_exact": (prog_roundtrip, _EMB), "prog_execute_lowered": (prog_lowered, "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (1, 3), (2, 0), (3, 3), (4, 0), (5, 33)) t(pos, word)"),
    "prog_size": (prog_sizes, "SELECT vec_id, (5 + 3 + CASE WHEN 1 + 4 * len(embedding) < 128 THEN 1 ELSE 2 END + 1 + 4 * len(embedding))::BIGINT AS bytes FROM embeddings"),
    "archive_verify_mismatch": (verify_mismatch, "SELECT vec_id, 'ChecksumMismatch' AS reason FROM embeddings WHERE vec_id % 2 = 0"), "search_stats": (search_stats, None), "calibrate_counts": (calibrated, None),
}
