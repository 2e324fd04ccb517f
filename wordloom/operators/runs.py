"""Tables of benchmark runs: totals, the latest record of each run, pivots and a matrix with gaps.

The test tables stand in for a log of runs: an order is an attempt, its customer the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("method"), F.when(F.col("o_orderkey") % 2 == 0, "compress").otherwise("decompress").alias("operation"), F.when(F.expr("o_orderkey div 2") % 2 == 0, "cold").otherwise("hot").alias("cache"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), (F.col("o_custkey") % 10).alias("checkpoint"), F.floor("o_totalprice").alias("source_bytes"), F.floor(F.col("o_totalprice") / 3).alias("output_bytes"), (F.col("o_orderkey") % 97 + 1).alias("wall_ms"), (F.col("o_custkey") * 1000).alias("rss"),
    )


LOG = "r AS (SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderpriority AS method, CASE WHEN o_orderkey % 2 = 0 THEN 'compress' ELSE 'decompress' END AS operation, CASE WHEN (o_orderkey // 2) % 2 = 0 THEN 'cold' ELSE 'hot' END AS cache, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, o_custkey % 10 AS checkpoint, floor(o_totalprice)::BIGINT AS source_bytes, floor(o_totalprice / 3)::BIGINT AS output_bytes, o_orderkey % 97 + 1 AS wall_ms, o_custkey * 1000 AS rss FROM orders)"


def aggregate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of bytes and time, the largest memory, the ratio in percent and the throughput (null without time)."""
    one = runs.filter("status = 'ok'").groupBy(*keys).agg(F.sum("source_bytes").alias("source_bytes"), F.sum("output_bytes").alias("output_bytes"), F.sum("wall_ms").alias("wall_ms"), F.max("rss").alias("rss"))
    one = one.withColumn("archive_percent", F.round(100 * F.col("output_bytes") / F.col("source_bytes"), 6))
    return one.withColumn("throughput_gib_s", F.col("source_bytes") * F.lit(1000.0) / F.expr("nullif(wall_ms, 0)") / F.lit(float(1 << 30)))


def latest(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c not in ("run_id",)]), "seq").alias("x")).select("run_id", "x.*")


def pivoted(runs: DataFrame) -> DataFrame:
    named = runs.filter("status = 'ok'").withColumn("what", F.concat_ws("_", "operation", "cache"))
    return named.groupBy("method").pivot("what", ["compress_cold", "compress_hot", "decompress_cold", "decompress_hot"]).agg(F.sum("wall_ms"))


def matrix(runs: DataFrame) -> DataFrame:
    """Each checkpoint and method of the log, with the status of its best attempt, or ``missing``. Both lists are short."""
    checkpoints, methods = runs.select("checkpoint").distinct(), runs.select("method").distinct()
    best = runs.groupBy("checkpoint", "method").agg(F.max("status").alias("status"), F.count_if(F.col("status") == "ok").alias("ok"))
    all_ = checkpoints.crossJoin(methods)  # the matrix has every pair
    return all_.join(best, ["checkpoint", "method"], "left").select("checkpoint", "method", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("ok", F.lit(0)).alias("ok"))


def verified(runs: DataFrame) -> DataFrame:
    """Successful attempts of runs that have a successful decompression."""
    good = runs.filter("status = 'ok' and operation = 'decompress'").select("run_id").distinct()
    return runs.filter("status = 'ok'").join(good, "run_id", "left_semi").groupBy("method").agg(F.count("*").alias("n"))


QUERIES = {
    "bench_aggregate": (lambda s, d: aggregate(log(s, d), ["checkpoint", "method"]), f"WITH {LOG} SELECT checkpoint, method, sum(source_bytes)::BIGINT AS source_bytes, sum(output_bytes)::BIGINT AS output_bytes, sum(wall_ms)::BIGINT AS wall_ms, max(rss) AS rss, round(100 * sum(output_bytes) / sum(source_bytes), 6) AS archive_percent, sum(source_bytes)::BIGINT::DOUBLE * 1000::DOUBLE / nullif(sum(wall_ms), 0)::BIGINT::DOUBLE / 1073741824::DOUBLE AS throughput_gib_s FROM r WHERE status = 'ok' GROUP BY ALL"),
    "bench_latest": (lambda s, d: latest(log(s, d)), f"WITH {LOG} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1"),
    "bench_pivot": (lambda s, d: pivoted(log(s, d)), f"WITH {LOG} SELECT method, " + ", ".join(f"(sum(wall_ms) FILTER (operation = '{o}' AND cache = '{c}'))::BIGINT AS {o}_{c}" for o in ("compress", "decompress") for c in ("cold", "hot")) + " FROM r WHERE status = 'ok' GROUP BY method"),
    "bench_matrix": (lambda s, d: matrix(log(s, d)), f"WITH {LOG} SELECT c.checkpoint, m.method, coalesce(max(r.status), 'missing') AS status, count(*) FILTER (r.status = 'ok') AS ok FROM (SELECT DISTINCT checkpoint FROM r) c CROSS JOIN (SELECT DISTINCT method FROM r) m LEFT JOIN r ON r.checkpoint = c.checkpoint AND r.method = m.method GROUP BY ALL"),
    "bench_verified": (lambda s, d: verified(log(s, d)), f"WITH {LOG} SELECT method, count(*) AS n FROM r WHERE status = 'ok' AND run_id IN (SELECT run_id FROM r WHERE status = 'ok' AND operation = 'decompress') GROUP BY method"),
}
