import itertools

import pytest
from pyspark.sql import functions as F

from wordloom.operators import streams as st


def rows(df):
    return [r["word"] for r in df.orderBy("pos").collect()]


def test_positions_without_keys_are_gapless_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 17 % 1000).alias("k")).repartition(7)
    s = st.stream(df, F.col("k") * 2, ["k"], ranges=9)
    assert [(r["pos"], r["word"]) for r in s.orderBy("pos").collect()] == [(i, 2 * i) for i in range(1000)]
    assert "SinglePartition" not in st.stream(df, F.col("k"), ["k"])._jdf.queryExecution().executedPlan().toString().split("Window")[0]


@pytest.mark.parametrize("op", ["xor", "add_mod"])
def test_two_phase_scan_is_the_running_result_and_its_inverse(spark, op):
    words = [(i * 2654435761) % 65536 for i in range(700)]
    s = spark.createDataFrame(list(enumerate(words)), "pos bigint, word bigint")
    f = (lambda a, b: a ^ b) if op == "xor" else (lambda a, b: (a + b) & 0xFFFF)
    want = list(itertools.accumulate([9, *words], f))
    made = st.scan(s, op, 16, initial=9, block=64)
    assert rows(made) == want and rows(st.scan_inverse(made, op, 16)) == words


def test_sequences(spark):
    a, b = st.constant(spark, 3, 7), spark.createDataFrame([(0, 1), (1, 2)], "pos bigint, word bigint")
    assert rows(st.concat([a, b, a])) == [7, 7, 7, 1, 2, 7, 7, 7]
    assert rows(st.repeat(b, 3)) == [1, 2] * 3
    assert rows(st.slice_of(st.concat([a, b]), 2, 4)) == [7, 1]
    assert st.equal_streams(a, a).first()["equal"] and not st.equal_streams(a, b).first()["equal"]
    assert rows(st.scan(a.limit(0), "xor", 8)) == []


def test_periods(spark):
    s = spark.createDataFrame([("a", i, i % 3) for i in range(12)] + [("b", i, i) for i in range(4)], "k string, pos bigint, word bigint")
    got = {(r["k"], r["period"]): r["periodic"] for r in st.has_period(s, [1, 2, 3, 6], ["k"]).collect()}
    assert got["a", 3] and got["a", 6] and not got["a", 1] and not got["b", 3] and got["b", 6]


def test_positions_where_one_value_leads_most_rows(spark):
    rows = [(1 if i % 10 else i, None if i == 3 else f"k{i:04d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, w int").repartition(7)
    want = [r[2] for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))]
    for ranges in (None, 1, 2, 40):
        assert [r["word"] for r in st.stream(df, F.col("w"), ["a", "b"], ranges=ranges).orderBy("pos").collect()] == want
    sizes = st._blocks(df, ["a", "b"], 40).groupBy("block").count().agg({"count": "max"}).first()[0]
    assert sizes < 300  # 2700 rows share their first value
    assert st.stream(df.limit(0), F.col("w"), ["a", "b"]).count() == 0
