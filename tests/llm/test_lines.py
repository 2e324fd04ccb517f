import itertools
import random

import duckdb
from pyspark.sql import functions as F

from wordloom.llm import lines as m
from wordloom.llm.common import Scratch


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(s))
        if kind == 0:
            s[at] = rng.choice("abcé🎉 ")
        elif kind == 1:
            s.insert(at, rng.choice("abcé🎉 "))
        else:
            del s[at]
    return "".join(s)


def test_within_is_edit_distance(spark):
    rng, rows = random.Random(2), []
    for _ in range(300):
        a = "".join(rng.choice("abc é🎉") for _ in range(rng.randrange(6, 30)))
        rows.append((a, edited(rng, a, rng.randrange(0, 5))))
    df = spark.createDataFrame(rows, "a string, b string")
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    for k in (1, 2, 3):
        got = df.select("a", "b", m.within(chars("a"), chars("b"), k).alias("ok")).collect()
        assert all(r["ok"] == (edit_distance(r["a"], r["b"]) <= k) for r in got)


def test_classes_are_brute_force(spark):
    rng, texts = random.Random(4), []
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 60))) for _ in range(40)]
    for d in range(120):
        texts.append((d, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(3)) + "\nshort"))
    got = m.near_lines(spark.createDataFrame(texts, "doc_id long, text string"), 2, 36).collect()
    lines = {(d, i): s for d, t in texts for i, s in enumerate(t.split("\n")) if len(s) >= 36}
    assert {(r["doc_id"], r["line"]) for r in got} == set(lines)
    distinct = sorted(set(lines.values()))
    near = {s: {s} for s in distinct}
    for a, b in itertools.combinations(distinct, 2):
        if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
            near[a].add(b), near[b].add(a)
    first = {}
    for s in distinct:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        first[s] = min(p for p, t in lines.items() if t in seen)
    for r in got:
        s = lines[(r["doc_id"], r["line"])]
        assert (r["class_doc"], r["class_line"], r["n_links"]) == (*first[s], len(near[s]) - 1)
        assert r["kept"] == (first[s] == (r["doc_id"], r["line"]))


def test_repeats_go_and_the_first_stays(spark):
    long = "the same passage in many documents, long enough to be compared at all, with words"
    rows = [(1, f"start\n{long}\nend", "x"), (2, f"other\n{long}!\nmore", "y"), (3, long, "z"), (4, None, "q"), (5, "", "q"), (6, "\n \n", "q")]
    out = {r["doc_id"]: r for r in m.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, line string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "other\nmore" and 3 not in out
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == "\n \n" and out[2]["line"] == "y"


def test_odd_rows(spark, odd):
    got = m.near_lines(odd.withColumn("kept", odd.n_chars).withColumn("place", odd.text)).collect()
    told = sorted((r["doc_id"] or 0, r["line"], r["kept"]) for r in got)
    assert told == [(0, 0, True), (4, 0, True), (5, 0, True), (6, 0, True), (6, 1, True), (7, 0, True), (7, 1, False), (8, 0, False), (8, 1, False)]
    assert m.near_lines(odd.limit(0)).count() == 0 and m.without_repeats(odd.limit(0)).columns == odd.columns
    out = [(r["doc_id"], r["text"]) for r in m.without_repeats(odd).collect()]
    assert len(out) == odd.count() - 1 and (7, "same text") in out and 8 not in {d for d, _ in out}


def test_query_is_its_sql(spark):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = m.op7_line_dedup(spark, d).toPandas()
    want = db.sql(m.SQL).df()[list(got.columns)]
    assert got.sort_values(["doc_id", "line"]).values.tolist() == want.sort_values(["doc_id", "line"]).values.tolist()


def test_short_lines_allow_fewer_edits(spark):
    words = ["x" * n for n in (5, 6, 17, 18, 19, 35, 36, 38)]
    rows = [(i, w) for i, w in enumerate(words)]
    rows += [(100 + i, w[:-1] + "y") for i, w in enumerate(words)] + [(200 + i, "z" + w[:-1] + "y") for i, w in enumerate(words)]
    got = {r["doc_id"]: r["n_links"] for r in m.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = dict(rows)
    for d, s in lines.items():
        near = {t for t in lines.values() if t != s and edit_distance(s, t) <= min(2, min(len(s), len(t)) // m.A_STEP)}
        assert got[d] == len(near), (s, near)


def test_template_lines_cost_in_proportion(spark, monkeypatch):
    """Lines of one opening and random ends: no table grows with the square of their number."""
    rng, sizes, save = random.Random(1), [], Scratch.save

    def counted(self, df, name, **how):
        out = save(self, df, name, **how)
        sizes[-1][name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    opening = "One opening of many characters that every line from a template has "
    for n in (5_000, 50_000):
        sizes.append({})
        rows = [(i, opening + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(30, 50)))) for i in range(n)]
        assert m.near_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").count() == n
    assert all(rows <= 12 * max(1000, sizes[0][name]) for name, rows in sizes[1].items() if name in sizes[0])


def test_keys_are_those_of_substrings_and_their_code_is_compiled(spark):
    """The JVM doesn't compile methods of more than 8000 bytes."""
    import re

    from pyspark.sql import functions as F

    from wordloom.llm import lines as m

    texts = ["a" * 17, "déjà vu " * 3, "x" + "0123456789" * 4, "0123456789" * 4, "0123456789" * 4 + "é", "漢字🎉 " * 20]
    lines = m.probe_keys(spark.createDataFrame([(s,) for s in texts], "s string").select(F.col("s").alias("of"), F.length("s").alias("n"), "s"), m.EDITS)
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "codegen"))
    assert all(int(x) <= 8000 for x in sizes)
    keys = {}
    for r in lines.collect():
        assert r["n"] == len(r["of"])
        for j, (k, shorter, i, shift) in enumerate(m.probes(m.EDITS)):
            size = r["n"] - shorter
            if min(size // m.A_STEP, m.EDITS) != k:
                assert r[f"k{j}"] is None
                continue
            short, longer = divmod(size, k + 1)
            start = short * i + max(0, i - (k + 1 - longer)) + shift
            part = r["of"][start : start + short + (i >= k + 1 - longer)]
            assert keys.setdefault((size, i, part), r[f"k{j}"]) == r[f"k{j}"]
    assert len(set(keys.values())) == len(keys)
