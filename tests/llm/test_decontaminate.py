import duckdb
import pytest

from wordloom.llm import decontaminate as c


def test_query_is_its_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = c.op10_decontaminate(spark, d).toPandas()
    want = db.sql(c.SQL).df()[list(got.columns)]
    assert got.contaminated.sum() > 0
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


@pytest.mark.parametrize("limit", [c.BROADCAST_WINDOWS, 0])
def test_windows_and_short_items(spark, limit):
    long = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, long), (2, "One, TWO"), (3, "solo"), (4, ""), (5, None), (6, long)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " + long + " y"), (2, "one two three"), (3, " ".join(f"w{i}" for i in range(12))), (4, "Solo! solo"), (5, None), (6, long + " " + long), (None, "one two"), (None, "one two"), (7, " ".join(f"w{i}" for i in range(13)) + " z" * 400)],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["item_ids"]), r["contaminated"]) for r in c.contamination(docs, items, limit=limit).collect()}
    assert got == {
        (1, 22, 20, 2, ("1", "6"), True), (2, 3, 2, 1, ("2",), True), (3, 12, 0, 0, (), False), (4, 2, 2, 1, ("3",), True), (5, 0, 0, 0, (), False),
        (6, 40, 40, 2, ("1", "6"), True), (None, 2, 2, 1, ("2",), True), (7, 413, 13, 2, ("1", "6"), False),
    }


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "only words here")], "item_id long, text string")
    rows = c.contamination(odd.withColumn("n_hit", odd.n_chars).withColumn("words", odd.text), items).collect()
    assert len(rows) == odd.count() and {"n_hit_in", "words_in"} <= set(rows[0].asDict())
    assert [r["doc_id"] for r in rows if r["contaminated"]] == [None]
    assert c.contamination(odd, items.limit(0)).filter("contaminated").count() == 0
    assert c.contamination(odd.limit(0), items).count() == 0
