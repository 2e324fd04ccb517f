"""What the corpus operators share: reading tables, shared scratch tables and word patterns.

Conventions that hold for every operator of this package:

* a null text counts as an empty text unless an operator's docstring says otherwise;
* an operator names the input columns that it needs; further columns of the input
  are carried along only where the docstring says so, and one whose name clashes
  with an output column is returned as ``<name>_in``;
* repeated rows stay repeated rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: In Java's and DuckDB's syntax alike.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For Python: lower-case A to Z only, whatever the locale or script.
ASCII_LOWER = str.maketrans(UPPER, LOWER)

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below the shared one that the session names.

    Without ``spark.checkpoint.dir`` a local temporary folder serves, in local mode only.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        _roots[app] = f"{shared.rstrip('/')}/wordloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: at exit the JVM may be gone already."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_owner: ContextVar[list | None] = ContextVar("owner", default=None)


@contextmanager
def owned():
    """Deletes at its end the scratch tables that were made inside. For a caller who has saved whatever is read of them."""
    made: list[Scratch] = []
    token = _owner.set(made)
    try:
        yield
    finally:
        _owner.reset(token)
        for scratch in made:
            _remove(scratch.spark, scratch.base)


class Scratch:
    """Tables written once to the shared folder.

    A written table cuts the lineage, is computed once and outlives the executors
    that made it. ``drop`` frees one that no later step reads. What a result reads lives
    until the session ends, unless a caller who knows better ``owned`` it.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:8]}", {}
        self.made = 0
        if (made := _owner.get()) is not None:
            made.append(self)

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self.made += 1
        path = f"{self.base}/{name}-{self.made}"
        df.write.parquet(path, compression=compression)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, self.paths.pop(name))

    def only(self, *names: str) -> None:
        """Drops all but these: what an operator's result still reads."""
        self.drop(*[n for n in self.paths if n not in names])


def renamed_clashes(df: DataFrame, outputs: list[str], needed: list[str]) -> DataFrame:
    """``df`` with columns that clash with ``outputs`` (and are not needed) as ``<name>_in``, or with more ``_in`` if that is taken."""
    taken, new = {*df.columns, *outputs}, []
    for c in df.columns:
        name = c
        while name in outputs and c not in needed or name != c and name in taken:
            name += "_in"
        taken.add(name)
        new.append(F.col(f"`{c}`").alias(name))
    return df.select(new)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column, pattern: str = WORD) -> Column:
    """The runs that ``pattern``, a negated class, matches: splitting at the others takes a quarter of the time of extracting them."""
    return F.array_remove(F.split(text, pattern.replace("[^", "[", 1), -1), "")


#: Batches for Python stay below both bounds, so that long texts can't fill a worker.
BATCH_ROWS, BATCH_BYTES = 4000, 32 << 20


def arrow_columns(df: DataFrame, inputs: list[str], fields: str, fn, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) and the columns ``fields`` (DDL) that ``fn`` computes.

    ``fn`` gets the values of ``inputs`` as lists and returns a list of lists, one for
    each field; it runs once for each Arrow batch, and no row moves between partitions.
    """
    from pyspark.sql import types as T

    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    keep = df.columns if keep is None else keep
    added = T.StructType.fromDDL(fields) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(fields)
    out = T.StructType([f for f in (df.schema[c] for c in keep)] + list(added))
    need = list(dict.fromkeys([*keep, *inputs]))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(added)]
        for b in batches:
            made = fn(*[b.column(need.index(c)).to_pylist() for c in inputs])
            arrays = [b.column(need.index(c)) for c in keep] + [pa.array(v, t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])

    return df.select([F.col(f"`{c}`") for c in need]).mapInArrow(run, out)


def without(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't in ``told`` (doc_id, doc_key: xxhash64 of the text).

    A merge join at every size: what was told grows with the documents.
    """
    told = told.select(F.col("doc_id").alias("__d"), F.col("doc_key").alias("__k")).hint("merge")
    return docs.join(told, (F.xxhash64(docs["text"]) == F.col("__k")) & docs["doc_id"].eqNullSafe(F.col("__d")), "left_anti")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("doc_key"))
