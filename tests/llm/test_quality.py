import duckdb
import pytest

from wordloom.llm import quality as q


def test_query_is_its_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = q.op4_quality(spark, d).toPandas()
    want = db.sql(q.SQL).df()[list(got.columns)]
    key = ["doc_id"]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_counts():
    assert q.counts(None) == (0, 0, 0, 0, 0, 0)
    assert q.counts("a b c a b c") == (6, 6, 0, 0, 6, 1)
    assert q.counts("a b a b\n\na b a b\n#x") == (9, 10, 1, 1, 8, 3)
    assert q.counts("x x x x") == (4, 4, 0, 0, 4, 1)


def test_junk_goes_and_clean_stays(spark):
    d = "/root/testdata/sf0.1"
    got = q.op4_quality(spark, d).filter("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    kept = q.op4_quality(spark, d).filter("kept").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").count().collect()
    total, kept = {r[0]: r[1] for r in got}, {r[0]: r[1] for r in kept}
    assert kept[1] >= 0.99 * total[1] and kept.get(0, 0) <= 0.05 * total[0]


def test_fences_come_from_the_sketches_and_decide(spark):
    """They differ between groups, and with one group's fences for all others verdicts change."""
    d = "/root/testdata/sf0.1"
    scored = q.score(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"])
    rows = q.Scratch(spark, "test").save(scored, "scored")
    fences = q.thresholds(q.sketches(rows)).toPandas()
    # sources of fewer than 100 documents share their language's
    assert fences["repeats_high"].nunique() >= 10 and fences["length_high"].nunique() >= 3
    lone = fences.sort_values("repeats_high").iloc[[0]].drop(columns=["lang_key", "source_key"])
    same = spark.createDataFrame(fences[["lang_key", "source_key"]].merge(lone, how="cross"))
    own, other = (dict(q.judge(rows, f).select("doc_id", "kept").collect()) for f in (q.thresholds(q.sketches(rows)), same))
    assert any(own[k] != other[k] for k in own)


def test_odd_rows(spark, odd):
    rows = q.quality(odd.withColumn("kept", odd.n_chars)).collect()
    assert len(rows) == odd.count() and "kept_in" in rows[0].asDict()
    assert not any(r["kept"] for r in rows)
    assert q.keep_good(odd.withColumn("level", odd.n_chars)).columns == [*odd.columns, "level"]
    both = odd.withColumn("level", odd.n_chars).withColumn("level_in", odd.text)
    assert {"level_in", "level_in_in"} <= set(q.quality(both).columns) and q.keep_good(both).columns == both.columns
    assert q.quality(odd.limit(0)).count() == 0


@pytest.mark.parametrize("p", [0.25, 0.5, 0.75])
def test_sketch_quantiles_are_within_the_accuracy(spark, p):
    values = [(i % 997 + 1) / 37 for i in range(5000)]
    rows = spark.createDataFrame([(int(v * 10**6), 10**6) for v in values], "word_chars long, n_words long")
    rows = rows.selectExpr("'e' lang", "'s' source", "false base_failed", "0L n_symbols", "0L n_dup_lines", "1L n_lines", "0L n_repeat_words", "word_chars", "n_words")
    r = q._quantiles(q.sketches(rows), ["lang_key"]).filter("feature = 'length'").first()
    exact = sorted(values)[-(-int(p * 5000) // 1) - 1]
    assert abs({0.25: r["low"], 0.5: r["mid"], 0.75: r["high"]}[p] - exact) <= 0.011 * exact
