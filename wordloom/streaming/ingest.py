"""Checkpoints that arrive in a folder are compressed as they come, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.plans.api import compress
from wordloom.plans.prior import Prior
from wordloom.plans.search import Config
from wordloom.sources.checkpoints import decode

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def start(spark: SparkSession, folder: str, archive: str, checkpoint: str, config: Config = Config(), prior: Prior | None = None, once: bool = False) -> StreamingQuery:
    """Appends to the Parquet table ``archive``, in a folder for each batch, which a batch done again writes over."""

    def split(batches):
        import pandas as pd

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                for i, (e, body) in enumerate(decode(data)):
                    yield pd.DataFrame([(p, i, e.name, e.dtype, list(e.shape), body)], columns=["path", "ord", "name", "dtype", "shape", "data"])

    def batch(files: DataFrame, number: int) -> None:
        tensors = files.select("path", "content").mapInPandas(split, "path string, ord int, name string, dtype string, shape array<bigint>, data binary")
        compress(tensors, config, prior).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{archive}/batch={number:09d}")

    files = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
