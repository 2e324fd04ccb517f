"""Statistics that order the search: context features, back-off counts, scores, legal productions and proposals.

Words come from part of the test tables: quantities of an order (8 bits), parts of a
supplier (16 bits). A context's data features come from at most 256 evenly spaced
places of a stream, in quarters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import streams as st

SAMPLES = 256
# Production ids of the sixteen families.
PRODUCTIONS = {"Lit": 0, "Const": 1, "Concat": 2, "Repeat": 3, "MapXor": 10, "MapAdd": 11, "MapZigzag": 12, "MapGray": 13, "MapRotate": 14, "MapReverse": 15, "ScanXor": 20, "ScanAdd": 21, "MergeFields": 30, "MergeFloat": 31, "MergeBits": 32, "MergeBytes": 33}
L_ORDER = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"]


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def supplier_parts(spark, d) -> DataFrame:
    return st.stream(table(spark, d, "lineitem"), F.col("l_partkey"), L_ORDER, ["l_suppkey"])


_S = f"s AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(L_ORDER)}) - 1 AS pos, l_partkey AS word FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM s GROUP BY 1)"
_PICK = f"p AS (SELECT DISTINCT l_suppkey, n, least(n, {SAMPLES}) AS k, CASE WHEN least(n, {SAMPLES}) = 1 THEN 0 ELSE i * (n - 1) // (least(n, {SAMPLES}) - 1) END AS pos, i FROM n, (SELECT unnest(range({SAMPLES})) AS i) WHERE i < least(n, {SAMPLES}))"
_AT = f"{_S}, {_PICK}, l AS (SELECT *, lag(word) OVER (PARTITION BY l_suppkey ORDER BY pos) AS prev FROM s), a AS (SELECT l.*, p.n, p.k, p.i FROM l JOIN p USING (l_suppkey, pos))"


def sampled(s: DataFrame, keys: list[str], most: int = SAMPLES) -> DataFrame:
    """keys, n, k, i, pos, word, prev at the sampled places; prev is the word before in the whole stream."""
    lagged = s.withColumn("prev", F.lag("word").over(W.partitionBy(*keys).orderBy("pos")))
    sized = st.length(s, keys).withColumn("k", F.least("n", F.lit(most)))
    places = sized.select(*keys, "n", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("i"))
    places = places.withColumn("pos", F.when(F.col("k") == 1, 0).otherwise(F.expr("i * (n - 1) div greatest(k - 1, 1)")))
    return lagged.join(places, [*keys, "pos"])


def _quarters(x, y):
    return F.when(y > 0, F.least(F.lit(3), F.floor(4 * x / F.greatest(y, F.lit(1))).cast("int"))).otherwise(0)


def features(s: DataFrame, keys: list[str]) -> DataFrame:
    """length_bucket, zero_bucket, distinct_bucket, repetition_bucket of each stream."""
    a = sampled(s, keys)
    one = a.groupBy(*keys).agg(F.max("n").alias("n"), F.max("k").alias("k"), F.count_if(F.col("word") == 0).alias("zero"), F.countDistinct("word").alias("distinct"), F.count_if((F.col("i") > 0) & (F.col("word") == F.col("prev"))).alias("again"))
    return one.select(*keys, F.least(F.lit(63), F.length(F.bin("n")) - 1).alias("length_bucket"), _quarters(F.col("zero"), F.col("k")).alias("zero_bucket"), _quarters(F.col("distinct"), F.col("k")).alias("distinct_bucket"), _quarters(F.col("again"), F.col("k") - 1).alias("repetition_bucket"))


_Q = lambda x, y: f"CASE WHEN {y} > 0 THEN least(3, 4 * ({x}) // greatest({y}, 1))::INT ELSE 0 END"
FEATURES_SQL = f"WITH {_AT} SELECT l_suppkey, (length(ltrim(bin(max(n)), '0')) - 1)::INT AS length_bucket, {_Q('count(*) FILTER (word = 0)', 'max(k)')} AS zero_bucket, {_Q('count(DISTINCT word)', 'max(k)')} AS distinct_bucket, {_Q('count(*) FILTER (i > 0 AND word = prev)', '(max(k) - 1)')} AS repetition_bucket FROM a GROUP BY l_suppkey"


def difference_entropy(s: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """diff_bucket: quarters of the largest entropy that the sampled differences to the word before could have."""
    a = sampled(s, keys).filter("i > 0").select(*keys, (F.col("word") - F.col("prev")).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("diff"))
    h = a.groupBy(*keys, "diff").agg(F.count("*").alias("c"))
    n = W.partitionBy(*keys)
    h = h.withColumn("m", F.sum("c").over(n)).groupBy(*keys).agg(F.sum(-F.col("c") / F.col("m") * F.log2(F.col("c") / F.col("m"))).alias("h"), F.count("*").alias("d"), F.max("m").alias("m"))
    top = F.log2(F.least(F.col("m"), F.lit(1 << bits)).cast("double"))
    return h.select(*keys, F.when(F.col("d") <= 1, 0).otherwise(F.least(F.lit(3), F.floor(F.round(4 * F.col("h") / top, 9)).cast("int"))).alias("diff_bucket"))


DIFF_SQL = f"WITH {_AT}, h AS (SELECT l_suppkey, (word - prev) & 65535 AS diff, count(*) AS c FROM a WHERE i > 0 GROUP BY ALL), t AS (SELECT l_suppkey, c, sum(c) OVER (PARTITION BY l_suppkey) AS m FROM h) SELECT l_suppkey, CASE WHEN count(*) <= 1 THEN 0 ELSE least(3, floor(round(4 * sum(-c / m * log2(c / m)) / log2(least(max(m), 65536)), 9))::INT) END AS diff_bucket FROM t GROUP BY l_suppkey"

#: A production for each order line, and the context that it was seen in: stands in for observed programs.
_OBS = "SELECT l_linenumber::INT AS parent, (l_orderkey % 3)::INT AS slot, (l_suppkey % 8)::INT AS depth, (l_partkey % 16)::BIGINT AS production FROM lineitem"


def observations(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("parent"), (F.col("l_orderkey") % 3).cast("int").alias("slot"), (F.col("l_suppkey") % 8).cast("int").alias("depth"), (F.col("l_partkey") % 16).alias("production"))


def back_off_counts(obs: DataFrame) -> DataFrame:
    """level, context and cnt at three levels, from one pass: dropped features are -1."""
    return obs.sparkSession.sql(
        "SELECT CASE WHEN grouping(depth) = 0 THEN 0 WHEN grouping(slot) = 0 THEN 1 ELSE 2 END AS level, parent, coalesce(slot, -1) AS slot, coalesce(depth, -1) AS depth, production, count(*) AS cnt "
        "FROM {obs} GROUP BY GROUPING SETS ((parent, slot, depth, production), (parent, slot, production), (parent, production))",
        obs=obs,
    )


COUNTS_SQL = f"SELECT (CASE WHEN grouping(depth) = 0 THEN 0 WHEN grouping(slot) = 0 THEN 1 ELSE 2 END)::INT AS level, parent, coalesce(slot, -1)::INT AS slot, coalesce(depth, -1)::INT AS depth, production, count(*) AS cnt FROM ({_OBS}) GROUP BY GROUPING SETS ((parent, slot, depth, production), (parent, slot, production), (parent, production))"


def scores(obs: DataFrame, holes: DataFrame, admitted: list[int], weight: float = 0.75, smooth: float = 1.0) -> DataFrame:
    """cost (1/1024 bits) of each admitted production in each hole (parent, slot, depth).

    A hole takes the first level that has any production in its context, as a whole;
    productions that the level lacks count 0. The mix with the uniform keeps all finite.
    """
    counts = back_off_counts(obs)
    n = len(admitted)
    options = holes.withColumn("production", F.explode(F.array(*[F.lit(p).cast("bigint") for p in admitted])))
    levels = [["parent", "slot", "depth"], ["parent", "slot"], ["parent"]]
    out = options
    for k, keys in enumerate(levels):
        own = counts.filter(F.col("level") == k)
        seen = own.select(*keys).distinct().withColumn(f"seen{k}", F.lit(True))
        out = out.join(seen, keys, "left").join(own.select(*keys, "production", F.col("cnt").alias(f"c{k}")), [*keys, "production"], "left")
    c = F.coalesce(F.when(F.col("seen0"), F.coalesce("c0", F.lit(0))), F.when(F.col("seen1"), F.coalesce("c1", F.lit(0))), F.when(F.col("seen2"), F.coalesce("c2", F.lit(0))))
    out = out.select("parent", "slot", "depth", "production", c.alias("c"))
    total = F.sum("c").over(W.partitionBy("parent", "slot", "depth"))
    p = F.when(F.col("c").isNull(), F.lit(1.0 / n)).otherwise(weight * (F.col("c") + smooth) / (total + smooth * n) + (1 - weight) / n)
    return out.select("parent", "slot", "depth", "production", F.floor(-F.log2(p) * 1024 + 0.5).cast("bigint").alias("cost"))


_ADMIT = [0, 1, 3, 7, 10, 13]
_holes = lambda s: s.range(8 * 4 * 9).select((F.col("id") % 8 + 1).cast("int").alias("parent"), (F.expr("id div 8") % 4).cast("int").alias("slot"), F.expr("id div 32").cast("int").alias("depth"))
SCORES_SQL = f"""WITH o AS ({_OBS}), h AS (SELECT (i % 8 + 1)::INT AS parent, ((i // 8) % 4)::INT AS slot, (i // 32)::INT AS depth FROM range(288) t(i)), opt AS (SELECT h.*, p AS production FROM h, (SELECT unnest({_ADMIT})::BIGINT AS p)),
c0 AS (SELECT parent, slot, depth, production, count(*) AS c FROM o GROUP BY ALL), c1 AS (SELECT parent, slot, production, count(*) AS c FROM o GROUP BY ALL), c2 AS (SELECT parent, production, count(*) AS c FROM o GROUP BY ALL),
x AS (SELECT opt.*, CASE WHEN EXISTS (SELECT 1 FROM c0 WHERE c0.parent = opt.parent AND c0.slot = opt.slot AND c0.depth = opt.depth) THEN coalesce(c0.c, 0) WHEN EXISTS (SELECT 1 FROM c1 WHERE c1.parent = opt.parent AND c1.slot = opt.slot) THEN coalesce(c1.c, 0) WHEN EXISTS (SELECT 1 FROM c2 WHERE c2.parent = opt.parent) THEN coalesce(c2.c, 0) END AS c
 FROM opt LEFT JOIN c0 USING (parent, slot, depth, production) LEFT JOIN c1 USING (parent, slot, production) LEFT JOIN c2 USING (parent, production))
SELECT parent, slot, depth, production, floor(-log2(CASE WHEN c IS NULL THEN 1.0::DOUBLE / 6 ELSE 0.75::DOUBLE * (c + 1.0::DOUBLE) / (sum(c) OVER (PARTITION BY parent, slot, depth) + 6.0::DOUBLE) + 0.25::DOUBLE / 6 END) * 1024 + 0.5)::BIGINT AS cost FROM x"""


def lower_bounds(obs: DataFrame, n: int, smooth: float = 1.0) -> DataFrame:
    """The least cost of a production in any context: its largest count anywhere, alone among n."""
    most = back_off_counts(obs).groupBy("production").agg(F.max("cnt").alias("m"))
    return most.select("production", F.floor(-F.log2((F.col("m") + smooth) / (F.col("m") + smooth + (n - 1) * smooth)) * 1024 + 0.5).cast("bigint").alias("bound"))


LOWER_SQL = f"WITH c AS ({COUNTS_SQL}) SELECT production, floor(-log2((max(cnt) + 1.0::DOUBLE) / (max(cnt) + 1.0::DOUBLE + 5.0::DOUBLE)) * 1024 + 0.5)::BIGINT AS bound FROM c GROUP BY production"

# ---- grammar -----------------------------------------------------------------------------


def legal_families(s: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys, n, families: production ids that apply to a stream of integers, ascending. Lit always does; an empty stream has nothing else."""
    one = s.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("word") == F.max("word")).alias("uniform"), F.max("word").alias("most"))
    period = st.has_period(s, [1, 2, 3, 4], keys).join(st.length(s, keys), keys)
    period = period.groupBy(*keys).agg(F.bool_or(F.col("periodic") & (F.col("n") % F.col("period") == 0) & (F.col("period") * 2 <= F.col("n"))).alias("repeats"))
    one = one.join(period, keys)
    wide = F.lit(bits > 1)
    rules = {"Lit": F.lit(True), "Const": F.col("uniform"), "Concat": F.col("n") >= 2, "Repeat": F.col("repeats") & ~F.col("uniform"), "MapXor": F.col("most") > 0, "MapAdd": wide & (F.col("most") > 0), "MapZigzag": wide, "MapGray": wide, "MapRotate": wide, "MapReverse": wide, "ScanXor": F.col("n") >= 2, "ScanAdd": wide & (F.col("n") >= 2), "MergeFields": F.lit(bits > 2), "MergeFloat": F.lit(False), "MergeBits": wide, "MergeBytes": F.lit(bits > 8)}
    return one.select(*keys, "n", F.concat_ws(",", *[F.when(c, F.lit(str(PRODUCTIONS[k]))) for k, c in rules.items()]).alias("families"))


_QS = f"q AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_extendedprice', 'l_shipdate'])}) - 1 AS pos, l_quantity::BIGINT AS word FROM lineitem)"
LEGAL_SQL = f"""WITH {_QS}, g AS (SELECT l_orderkey, count(*) AS n, min(word) = max(word) AS u, max(word) AS m FROM q GROUP BY 1), p AS (SELECT l_orderkey, p, bool_and(coalesce(word = nxt, true)) AS ok, count(*) AS n FROM (SELECT l_orderkey, p, word, lead(word, p) OVER (PARTITION BY l_orderkey, p ORDER BY pos) AS nxt FROM q, (SELECT unnest([1, 2, 3, 4]) AS p)) GROUP BY l_orderkey, p), r AS (SELECT l_orderkey, bool_or(ok AND n % p = 0 AND p * 2 <= n) AS rep FROM p GROUP BY 1)
SELECT l_orderkey, n, concat_ws(',', '0', CASE WHEN u THEN '1' END, CASE WHEN n >= 2 THEN '2' END, CASE WHEN rep AND NOT u THEN '3' END, CASE WHEN m > 0 THEN '10' END, CASE WHEN m > 0 THEN '11' END, '12', '13', '14', '15', CASE WHEN n >= 2 THEN '20' END, CASE WHEN n >= 2 THEN '21' END, '30', '32') AS families FROM g JOIN r USING (l_orderkey)"""


def _quantities(s, d) -> DataFrame:
    return st.stream(table(s, d, "lineitem"), F.col("l_quantity").cast("bigint"), ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"], ["l_orderkey"])


def _sized(s, d) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))


def even_places(df: DataFrame, most: int, top: str, minus: int = 1, name: str = "place") -> DataFrame:
    """Up to ``most`` evenly spaced whole numbers strictly inside (0, top), each once."""
    k = F.least(F.lit(most).cast("bigint"), F.col(top) - minus)
    return df.filter(k >= 1).select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1).cast("bigint"), k), lambda i: F.floor(i * F.col(top) / (k + 1))))).alias(name))


def strata(d: DataFrame) -> DataFrame:
    """The first tensor, in order of ids, of each kind and power of two of bytes."""
    w = W.partitionBy("kind", "bucket").orderBy("ord")
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def selected(first: DataFrame, most: int) -> DataFrame:
    """Rounds over kinds: small buckets and large ones by turns."""
    up, down = W.partitionBy("kind").orderBy("bucket"), W.partitionBy("kind").orderBy(F.col("bucket").desc())
    a, b = F.row_number().over(up) - 1, F.row_number().over(down) - 1
    ranked = first.withColumns({"a": a, "b": b}).withColumn("round", F.least(2 * F.col("a"), 2 * F.col("b") + 1))
    return ranked.orderBy("round", "kind").limit(most).select("kind", "bucket", "ord", "round")


def _tensors(s, d) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("kind")).select(F.col("o_custkey").alias("ord"), "kind", (F.length(F.bin(F.col("n") * 4)) - 1).alias("bucket"))


_T = "t AS (SELECT o_custkey AS ord, max(o_orderpriority) AS kind, (length(ltrim(bin(count(*) * 4), '0')) - 1)::INT AS bucket FROM orders GROUP BY 1), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind, bucket ORDER BY ord) = 1)"
_N = "n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)"

QUERIES = {
    "ctx_features": (lambda s, d: features(supplier_parts(s, d), ["l_suppkey"]), FEATURES_SQL),
    "ctx_diff_entropy": (lambda s, d: difference_entropy(supplier_parts(s, d), ["l_suppkey"], 16), DIFF_SQL),
    "prior_counts": (lambda s, d: back_off_counts(observations(s, d)), COUNTS_SQL),
    "prior_backoff_score": (lambda s, d: scores(observations(s, d), _holes(s), _ADMIT), SCORES_SQL),
    "prior_lower_bound": (lambda s, d: lower_bounds(observations(s, d), 6), LOWER_SQL),
    "legal_families": (lambda s, d: legal_families(_quantities(s, d), ["l_orderkey"], 8), LEGAL_SQL),
    "propose_splits": (lambda s, d: even_places(_sized(s, d), 3, "n"), f"WITH {_N} SELECT DISTINCT l_suppkey, n, i * n // (least(3, n - 1) + 1) AS place FROM n, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= least(3, n - 1)"),
    "propose_rotations": (lambda s, d: even_places(s.range(1, 33).select(F.col("id").alias("bits")), 3, "bits"), "SELECT DISTINCT bits, i * bits // (least(3, bits - 1) + 1) AS place FROM range(1, 33) t(bits), (SELECT unnest([1, 2, 3]) AS i) WHERE i <= least(3, bits - 1)"),
    "propose_fields": (lambda s, d: even_places(s.range(2, 33).select(F.col("id").alias("bits")), 3, "bits").filter(~((F.col("bits") == 2) | ((F.col("place") == 8) & F.col("bits").between(9, 16)))), "SELECT DISTINCT bits, i * bits // (least(3, bits - 1) + 1) AS place FROM range(2, 33) t(bits), (SELECT unnest([1, 2, 3]) AS i) WHERE i <= least(3, bits - 1) AND bits <> 2 AND NOT (bits BETWEEN 9 AND 16 AND i * bits // (least(3, bits - 1) + 1) = 8)"),
    "child_shapes": (lambda s, d: even_places(_sized(s, d), 3, "n").select("l_suppkey", F.col("place").alias("left_n"), (F.col("n") - F.col("place")).alias("right_n")), f"WITH {_N} SELECT DISTINCT l_suppkey, i * n // (least(3, n - 1) + 1) AS left_n, n - i * n // (least(3, n - 1) + 1) AS right_n FROM n, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= least(3, n - 1)"),
    "child_storage_bytes": (lambda s, d: _sized(s, d).select("l_suppkey", (F.col("n") * 32).alias("bit_planes"), (F.col("n") * 4).alias("byte_planes"), (F.col("n") * 5).alias("fields_8")), f"WITH {_N} SELECT l_suppkey, n * 32 AS bit_planes, n * 4 AS byte_planes, n * 5 AS fields_8 FROM n"),
    "strata_first": (lambda s, d: strata(_tensors(s, d)), f"WITH {_T} SELECT ord, kind, bucket FROM f"),
    "strata_select_topk": (lambda s, d: selected(strata(_tensors(s, d)), 12), f"WITH {_T}, r AS (SELECT *, least(2 * (row_number() OVER (PARTITION BY kind ORDER BY bucket) - 1), 2 * (row_number() OVER (PARTITION BY kind ORDER BY bucket DESC) - 1) + 1) AS round FROM f) SELECT kind, bucket, ord, round::INT AS round FROM r ORDER BY round, kind LIMIT 12"),
}
