"""Queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.functions import words as wd
from wordloom.functions.dtypes import DTYPES, dtype_table
from wordloom.operators import encodings as en
from wordloom.operators import prior_tables as pt
from wordloom.operators import runs as rn
from wordloom.operators import streams as st

from . import packed_queries

F32 = DTYPES["F32"]
L_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
#: name -> (table, Spark expression, SQL expression, order, bits)
STREAMS = {
    "QTY": ("lineitem", "CAST(l_quantity AS BIGINT)", "l_quantity::BIGINT", L_KEY, 8), "LNO": ("lineitem", "CAST(l_linenumber AS BIGINT)", "l_linenumber::BIGINT", L_KEY, 3), "PART": ("lineitem", "l_partkey", "l_partkey", L_KEY, 16),
    "OKEY": ("orders", "o_orderkey", "o_orderkey", ["o_orderkey"], 32), "CUST": ("orders", "o_custkey", "o_custkey", ["o_orderkey"], 16),
    "PRICE": ("orders", None, "((o_totalprice::FLOAT)::BIT::INTEGER)::BIGINT & 4294967295", ["o_orderkey"], 32), "DISC": ("lineitem", None, "((l_discount::FLOAT)::BIT::INTEGER)::BIGINT & 4294967295", L_KEY, 32), "SIZE": ("part", "CAST(p_size AS BIGINT)", "p_size::BIGINT", ["p_partkey"], 6),
}
FLOATS = {"PRICE": "o_totalprice", "DISC": "l_discount"}
EMB_SQL = "emb AS (SELECT vec_id, i - 1 AS pos, ((embedding[i]::FLOAT)::BIT::INTEGER)::BIGINT & 4294967295 AS word FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
Q: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def word_of(name: str):
    return wd.float_bits(F.col(FLOATS[name])) if name in FLOATS else F.expr(STREAMS[name][1])


def stream(spark, d, name: str, keys: list[str] | None = None) -> DataFrame:
    t, _, _, order, _ = STREAMS[name]
    return st.stream(table(spark, d, t), word_of(name), order, keys)


def words(spark, d, name: str, *keep: str) -> DataFrame:
    """The words alone, for what doesn't depend on their order."""
    return table(spark, d, STREAMS[name][0]).select(*keep, word_of(name).alias("word"))


def sql(name: str, keys: str = "", cte: str = "s") -> str:
    t, _, expr, order, _ = STREAMS[name]
    return f"{cte} AS (SELECT {keys + ', ' if keys else ''}row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY {', '.join(order)}) - 1 AS pos, {expr} AS word FROM {t})"


def emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), wd.float_bits(F.col("x")).alias("word"))


def add(name: str, query, oracle: str | None = None) -> None:
    Q[name] = query
    if oracle:
        SQL[name] = oracle


# ---- sources ---------------------------------------------------------------------------
add("src_word_stream_emb", lambda s, d: emb(s, d), f"WITH {EMB_SQL} SELECT vec_id, pos::BIGINT AS pos, word FROM emb")
_sizes = lambda s, d: table(s, d, "embeddings").select("vec_id", (F.size("embedding") * 4).cast("bigint").alias("bytes"))


def header_ranges(s, d) -> DataFrame:
    """begin and end of each tensor in one data region, in order of ids: a running sum in blocks."""
    sized = _sizes(s, d)
    placed = st.stream(sized, F.col("bytes"), ["vec_id"])
    ends = st.scan(placed, "add_mod", 32)
    ids = st.stream(sized.withColumn("id2", F.col("vec_id")), F.col("vec_id"), ["vec_id"]).withColumnRenamed("word", "vec_id")
    return ids.join(ends.withColumnRenamed("word", "end_at"), "pos").join(placed.withColumnRenamed("word", "bytes"), "pos").select("vec_id", (F.col("end_at") - F.col("bytes")).alias("begin_at"), "end_at")


add("src_header_ranges", header_ranges, "SELECT vec_id, (sum(b) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - b)::BIGINT AS begin_at, (sum(b) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING))::BIGINT AS end_at FROM (SELECT vec_id, len(embedding) * 4 AS b FROM embeddings)")


def layout_check(s, d) -> DataFrame:
    """Whether ranges tile their region: each begins where one ends, or at 0."""
    r = header_ranges(s, d)
    ends = r.select(F.col("end_at").alias("begin_at"), F.lit(True).alias("meets")).distinct()
    return r.join(ends, "begin_at", "left").select("vec_id", (F.coalesce("meets", F.lit(False)) | (F.col("begin_at") == 0)).alias("contiguous"))


add("src_layout_check", layout_check, "SELECT vec_id, (e - b = coalesce(lag(e) OVER (ORDER BY vec_id), 0)) AS contiguous FROM (SELECT vec_id, len(embedding) * 4 AS b, sum(len(embedding) * 4) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS e FROM embeddings)")
add("src_dtype_dim", lambda s, d: dtype_table(s), "SELECT * FROM (VALUES " + ", ".join(f"('{x.name}', {x.bits}::INT, {x.exponent if x.is_float else 'NULL'}::INT, {x.mantissa if x.is_float else 'NULL'}::INT, {x.program_id}::INT, {x.prior_id}::INT)" for x in DTYPES.values()) + ") t(name, bits, exponent, mantissa, program_id, prior_id)")

# ---- generators and sequences ----------------------------------------------------------
add("op_const", lambda s, d: table(s, d, "region").select("r_regionkey", F.explode(F.array_repeat(F.col("r_regionkey").cast("bigint"), 5)).alias("word")), "SELECT r_regionkey, r_regionkey::BIGINT AS word FROM region, range(5)")
add("op_concat", lambda s, d: st.concat([stream(s, d, "QTY"), stream(s, d, "SIZE")]), f"WITH {sql('QTY', cte='a')}, {sql('SIZE', cte='b')} SELECT pos, word FROM a UNION ALL SELECT pos + (SELECT count(*) FROM a), word FROM b")
add("op_concat_split", lambda s, d: (lambda t, n: t.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col("pos") < F.expr("n div 3"), 0).when(F.col("pos") < F.expr("2 * n div 3"), 1).otherwise(2)).select("part", (F.col("pos") - F.when(F.col("part") == 0, 0).when(F.col("part") == 1, F.expr("n div 3")).otherwise(F.expr("2 * n div 3"))).alias("pos"), "word"))(stream(s, d, "OKEY"), table(s, d, "orders").agg(F.count("*").alias("n"))), f"WITH {sql('OKEY')}, n AS (SELECT count(*) AS n FROM orders), p AS (SELECT *, CASE WHEN pos < n // 3 THEN 0 WHEN pos < 2 * n // 3 THEN 1 ELSE 2 END AS part FROM s, n) SELECT part::INT AS part, (pos - CASE part WHEN 0 THEN 0 WHEN 1 THEN n // 3 ELSE 2 * n // 3 END)::BIGINT AS pos, word FROM p")
add("op_repeat", lambda s, d: st.repeat(stream(s, d, "SIZE"), 3), f"WITH {sql('SIZE')} SELECT pos + range * (SELECT count(*) FROM s) AS pos, word FROM s, range(3)")


def periods(s, d) -> DataFrame:
    """Customers by nation, and for each nation (as -1 - nation) a stream of the same length that does repeat."""
    real = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), "o_orderkey", F.col("o_custkey").alias("word"))
    placed = st.stream(real, F.col("word"), ["o_orderkey"], ["nation"])
    cyclic = placed.select((-1 - F.col("nation")).alias("nation"), "pos", (F.col("pos") % 4).alias("word"))
    return st.has_period(placed.unionByName(cyclic), list(range(1, 9)), ["nation"])


_PERIOD = "SELECT nation, p::INT AS period, bool_and(coalesce(word = nxt, true)) AS periodic FROM (SELECT nation, p, word, lead(word, p) OVER (PARTITION BY nation, p ORDER BY pos) AS nxt FROM s, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS p)) GROUP BY nation, p"
add("op_has_period", periods, f"WITH r AS (SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS pos, o_custkey AS word FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT * FROM r UNION ALL SELECT -1 - nation, pos, pos % 4 FROM r) {_PERIOD}")

# ---- maps ------------------------------------------------------------------------------
_M = {8: 0xFF, 16: 0xFFFF, 32: 0xFFFFFFFF}
_REVERSE = lambda w, b: f"(list_sum(list_transform(range({b}), lambda i: (({w} >> i::INT) & 1) << ({b} - 1 - i)::INT)))::BIGINT"


def _gray_inverse(w: str, b: int) -> str:
    for shift in (1, 2, 4, 8, 16):
        if shift < b:
            w = f"(SELECT xor(v, v >> {shift}) FROM (SELECT {w} AS v))"
    return w


MAP_SQL = {
    "map_xor": (("xor", 0xBEEF), lambda b: f"xor(word, 48879) & {_M[b]}"), "map_add_mod": (("add_mod", 40503), lambda b: f"(word + 40503) & {_M[b]}"), "map_zigzag": (("zigzag", 0), lambda b: f"xor(word << 1, -(word >> {b - 1})) & {_M[b]}"),
    "map_gray": (("gray", 0), lambda b: f"xor(word, word >> 1) & {_M[b]}"), "map_rotl": (("rotate_left", 5), lambda b: f"((word << 5) | (word >> {b - 5})) & {_M[b]}"), "map_bitrev": (("bit_reverse", 0), lambda b: _REVERSE("word", b)),
}
INVERSE_SQL = {
    "map_xor": lambda b: f"xor(word, 48879) & {_M[b]}", "map_add_mod": lambda b: f"(word - 40503) & {_M[b]}", "map_zigzag": lambda b: f"xor(word >> 1, -(word & 1)) & {_M[b]}", "map_gray": lambda b: _gray_inverse("word", b), "map_rotl": lambda b: f"((word << {b - 5}) | (word >> 5)) & {_M[b]}",
}
for _name, ((_op, _c), _text) in MAP_SQL.items():
    for _suffix, _of in (("", "PART"), ("_f32", "PRICE")):
        _b = STREAMS[_of][4]
        add(_name + _suffix, lambda s, d, op=_op, c=_c, of=_of, b=_b: stream(s, d, of).select("pos", wd.MAPS[op][0](F.col("word"), b, c).alias("word")), f"WITH {sql(_of)} SELECT pos, ({_text(_b)})::BIGINT AS word FROM s")
        if _name in INVERSE_SQL:
            add(f"{_name}_inv{_suffix}", lambda s, d, op=_op, c=_c, of=_of, b=_b: stream(s, d, of).select("pos", wd.MAPS[op][1](F.col("word"), b, c).alias("word")), f"WITH {sql(_of)} SELECT pos, ({INVERSE_SQL[_name](_b)})::BIGINT AS word FROM s")

# ---- scans -----------------------------------------------------------------------------
_RUN = {"xor": "bit_xor(word) OVER ({}ORDER BY pos ROWS UNBOUNDED PRECEDING)", "add_mod": "(sum(word) OVER ({}ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT & 4294967295"}
for _op in _RUN:
    _diff = {"xor": "xor(word, lag(word) OVER ({}ORDER BY pos))", "add_mod": "(word - lag(word) OVER ({}ORDER BY pos)) & 4294967295"}[_op]
    add(f"scan_{_op}", lambda s, d, op=_op: st.scan(emb(s, d), op, 32, keys=["vec_id"]), f"WITH {EMB_SQL} SELECT vec_id, pos::BIGINT AS pos, ({_RUN[_op].format('PARTITION BY vec_id ')})::BIGINT AS word FROM emb")
    add(f"scan_{_op}_global", lambda s, d, op=_op: st.scan(stream(s, d, "OKEY"), op, 32, initial=7, block=512), f"WITH {sql('OKEY')}, t AS (SELECT pos + 1 AS pos, word FROM s UNION ALL SELECT 0, 7) SELECT pos, ({_RUN[_op].format('').replace('FROM s', 'FROM t')})::BIGINT AS word FROM t")
    add(f"scan_{_op}_inv", lambda s, d, op=_op: st.scan_inverse(emb(s, d), op, 32, ["vec_id"]), f"WITH {EMB_SQL} SELECT vec_id, (pos - 1)::BIGINT AS pos, u::BIGINT AS word FROM (SELECT vec_id, pos, {_diff.format('PARTITION BY vec_id ')} AS u FROM emb) WHERE pos > 0")
    add(f"scan_{_op}_inv_global", lambda s, d, op=_op: st.scan_inverse(stream(s, d, "CUST"), op, 32), f"WITH {sql('CUST')} SELECT (pos - 1)::BIGINT AS pos, u::BIGINT AS word FROM (SELECT pos, {_diff.format('')} AS u FROM s) WHERE pos > 0")


def scan_roundtrip(s, d) -> DataFrame:
    e = emb(s, d)
    first = e.filter("pos = 0")
    updates = st.scan_inverse(e, "add_mod", 32, ["vec_id"]).select("vec_id", (F.col("pos") + 1).alias("pos"), "word")
    return st.scan(first.unionByName(updates), "add_mod", 32, keys=["vec_id"])


add("scan_roundtrip", scan_roundtrip, f"WITH {EMB_SQL} SELECT vec_id, pos::BIGINT AS pos, word FROM emb")

# ---- merges and splits -----------------------------------------------------------------
_parts = {"fields": wd.layout("fields", 16, low=5), "float_fields": wd.layout("float_fields", 32, dtype=F32), "bit_planes": wd.layout("bit_planes", 16), "byte_planes": wd.layout("byte_planes", 16)}
_of = {"fields": "PART", "float_fields": "PRICE", "bit_planes": "CUST", "byte_planes": "PART"}
for _op, _p in _parts.items():
    _plane_sql = " UNION ALL ".join(f"SELECT {i} AS plane, pos, (word >> {sh}) & {(1 << w) - 1} AS word FROM s" for i, (sh, w) in enumerate(_p))
    add(f"split_{_op}", lambda s, d, op=_op: st.planes(stream(s, d, _of[op]), _parts[op]), f"WITH {sql(_of[_op])} SELECT plane::INT AS plane, pos, word FROM ({_plane_sql})")
    add(f"merge_{_op}", lambda s, d, op=_op: (lambda t: st.merge_streams([t.select("pos", c.alias("word")) for c in wd.split(F.col("word"), _parts[op])], _parts[op]))(stream(s, d, _of[op])), f"WITH {sql(_of[_op])}, c AS ({_plane_sql}) SELECT pos, bit_or(word << (CASE plane {' '.join(f'WHEN {i} THEN {sh}' for i, (sh, _) in enumerate(_p))} END)::INT)::BIGINT AS word FROM c GROUP BY pos")

# ---- statistics ------------------------------------------------------------------------
_EVENT = "e AS (SELECT event_type, user_id AS word FROM events)"
_events = lambda s, d: table(s, d, "events").select("event_type", F.col("user_id").alias("word"))
add("stat_uniform", lambda s, d: st.summary(words(s, d, "LNO", "l_orderkey"), ["l_orderkey"]).select("l_orderkey", "n", "uniform"), "SELECT l_orderkey, count(*)::BIGINT AS n, min(l_linenumber) = max(l_linenumber) AS uniform FROM lineitem GROUP BY l_orderkey")
add("stat_required_bits", lambda s, d: st.summary(_events(s, d), ["event_type"]).select("event_type", "required_bits"), "SELECT event_type, greatest(1, length(ltrim(bin(max(user_id)), '0')))::INT AS required_bits FROM events GROUP BY event_type")
add("stat_fits_width", lambda s, d: st.summary(_events(s, d), ["event_type"]).select("event_type", (F.col("any_bits").bitwiseAND(F.lit(~1023).cast("bigint")) == 0).alias("fits_10"), (F.col("any_bits").bitwiseAND(F.lit(~65535).cast("bigint")) == 0).alias("fits_16")), f"WITH {_EVENT} SELECT event_type, (bit_or(word) & ~1023::BIGINT) = 0 AS fits_10, (bit_or(word) & ~65535::BIGINT) = 0 AS fits_16 FROM e GROUP BY event_type")
add("stat_representatives", lambda s, d: st.representatives(emb(s, d), 4, ["vec_id"]), f"WITH {EMB_SQL}, n AS (SELECT vec_id, count(*) AS n FROM emb GROUP BY vec_id) SELECT vec_id, word, min(pos)::BIGINT AS place FROM emb JOIN n USING (vec_id) WHERE pos IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1) GROUP BY vec_id, word")


def min_period(s, d) -> DataFrame:
    """The least period of at most 4 that divides each order's quantities, if any."""
    q = stream(s, d, "QTY", ["l_orderkey"])
    p = st.has_period(q, [1, 2, 3, 4], ["l_orderkey"]).join(st.length(q, ["l_orderkey"]), "l_orderkey")
    return p.groupBy("l_orderkey").agg(F.min(F.when(F.col("periodic") & (F.col("n") % F.col("period") == 0) & (F.col("period") * 2 <= F.col("n")), F.col("period"))).alias("period"))


add("stat_min_period", min_period, f"WITH {sql('QTY', 'l_orderkey')}, p AS (SELECT l_orderkey, p, bool_and(coalesce(word = nxt, true)) AS ok, count(*) AS n FROM (SELECT l_orderkey, p, word, lead(word, p) OVER (PARTITION BY l_orderkey, p ORDER BY pos) AS nxt FROM s, (SELECT unnest([1, 2, 3, 4]) AS p)) GROUP BY l_orderkey, p) SELECT l_orderkey, (min(CASE WHEN ok AND n % p = 0 AND p * 2 <= n THEN p END))::INT AS period FROM p GROUP BY l_orderkey")
add("stat_equal_streams", lambda s, d: st.equal_streams(stream(s, d, "QTY"), stream(s, d, "LNO")), f"WITH {sql('QTY', cte='a')}, {sql('LNO', cte='b')} SELECT count(*) FILTER (a.word IS DISTINCT FROM b.word) = 0 AS equal, count(*) FILTER (a.word IS DISTINCT FROM b.word) AS differ FROM a FULL JOIN b USING (pos)")
add("shape_numel", lambda s, d: table(s, d, "part").select("p_partkey", F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7, F.lit(64).cast("bigint")).alias("shape")).select("p_partkey", F.when(F.array_contains("shape", 0), F.lit(0).cast("bigint")).otherwise(F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: F.try_multiply(a, x))).alias("numel")), "SELECT p_partkey, p_size::BIGINT * (p_partkey % 7) * 64 AS numel FROM part")

# ---- histograms and sizes --------------------------------------------------------------
add("hist_words", lambda s, d: st.histogram(words(s, d, "PART"), []), "SELECT l_partkey AS word, count(*) AS cnt FROM lineitem GROUP BY 1")
add("hist_exponent", lambda s, d: st.histogram(emb(s, d).select("vec_id", wd.split(F.col("word"), _parts["float_fields"])[1].alias("word")), ["vec_id"]), f"WITH {EMB_SQL} SELECT vec_id, (word >> 23) & 255 AS word, count(*) AS cnt FROM emb GROUP BY ALL")
_HEX = f"{EMB_SQL}, h AS (SELECT vec_id, (word >> 23) & 255 AS word, count(*) AS cnt FROM emb GROUP BY ALL)"
_exp = lambda s, d: st.histogram(emb(s, d).select("vec_id", wd.split(F.col("word"), _parts["float_fields"])[1].alias("word")), ["vec_id"])
add("entropy_bytes", lambda s, d: en.entropy(_exp(s, d), ["vec_id"]), f"WITH {_HEX} SELECT vec_id, (floor(round(sum(-cnt * log2(cnt / n)), 6) / 8) - 1)::BIGINT AS entropy_bytes FROM (SELECT *, sum(cnt) OVER (PARTITION BY vec_id) AS n FROM h) GROUP BY vec_id")
add("enc_raw_size", lambda s, d: en.sizes(_exp(s, d), ["vec_id"], 8).select("vec_id", "raw"), f"WITH {_HEX} SELECT vec_id, (1 + sum(cnt))::BIGINT AS raw FROM h GROUP BY vec_id")
_PACK = "(2 + (sum(cnt) * greatest(1, length(ltrim(bin(max(word)), '0'))) + 7) // 8)::BIGINT"
add("enc_bitpack_size", lambda s, d: en.sizes(_exp(s, d), ["vec_id"], 8).select("vec_id", "bitpack"), f"WITH {_HEX} SELECT vec_id, {_PACK} AS bitpack FROM h GROUP BY vec_id")
add("enc_best_simple", lambda s, d: en.best(en.sizes(_exp(s, d), ["vec_id"], 8), ["vec_id"], ["raw", "bitpack"]), f"WITH {_HEX}, z AS (SELECT vec_id, (1 + sum(cnt))::BIGINT AS raw, {_PACK} AS bitpack FROM h GROUP BY vec_id) SELECT vec_id, least(raw, bitpack) AS bytes, CASE WHEN raw <= bitpack THEN 'raw' ELSE 'bitpack' END AS codec FROM z")
add("enc_huffman_size", lambda s, d: en.code_sizes(_exp(s, d), ["vec_id"], 8).select("vec_id", "huffman"))
add("enc_rans_size", lambda s, d: packed_queries.rans_sizes(s, d))
add("enc_best", lambda s, d: packed_queries.best_sizes(s, d))
add("enc_huffman_two_symbols", lambda s, d: en.code_sizes(st.histogram(words(s, d, "OKEY", "o_orderkey").select((F.col("o_orderkey") % 25).alias("g"), (F.col("word") % 2).alias("word")), ["g"]), ["g"], 8).select("g", "huffman"), "SELECT o_orderkey % 25 AS g, (13 + 5 * count(DISTINCT o_orderkey % 2) + (count(*) + 7) // 8)::BIGINT AS huffman FROM orders GROUP BY 1")

# ---- context, prior, grammar, calibration, run tables, programs, archives ----------------
for _module in (pt, rn):
    for _k, (_query, _oracle) in _module.QUERIES.items():
        add(_k, _query, _oracle)
for _k, (_query, _oracle) in packed_queries.QUERIES.items():
    add(_k, _query, _oracle)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
