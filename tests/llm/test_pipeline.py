import duckdb
from test_neardup import brute
from test_packing import check

import corpus_pipeline as p
from wordloom.llm import decontaminate, quality
from wordloom.llm.common import Scratch, table

D = "/root/testdata/sf0.001"


def kept_lines(docs: dict[int, str]) -> dict[int, str]:
    """Without lines that are near (through others) one that comes before; DuckDB has the distances."""
    place = {(d, i): s for d, t in docs.items() for i, s in enumerate((t or "").split("\n")) if s.strip(" \t\n\r\x0b\x0c")}
    db = duckdb.connect()
    db.execute("create table l (s varchar)")
    texts = sorted(set(place.values()))
    db.executemany("insert into l values (?)", [[s] for s in texts])
    near = {s: [] for s in texts}
    for a, b in db.sql("select a.s, b.s from l a join l b on a.s < b.s and abs(length(a.s) - length(b.s)) <= 2 where levenshtein(a.s, b.s) <= least(2, least(length(a.s), length(b.s)) // 18)").fetchall():
        near[a].append(b), near[b].append(a)
    first, root = {}, {}
    for s in texts:
        if s not in root:
            seen, todo = set(), [s]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
            root.update(dict.fromkeys(seen, s))
    for at in sorted(place):
        first.setdefault(root[place[at]], at)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        own = [s for i, s in enumerate(lines) if (d, i) not in place or first[root[s]] == (d, i)]
        if len(own) == len(lines) or "".join(own).strip(" \t\n\r\x0b\x0c"):
            out[d] = t if len(own) == len(lines) else "\n".join(own)
    return out


def test_stages_are_brute_force(spark, monkeypatch):
    docs, scratch = table(spark, D, "documents"), Scratch(spark, "test")
    names, stages = docs.columns, []
    for k, (_, stage) in enumerate(p.STAGES):
        docs = scratch.save(stage(spark, docs, D), f"s{k}")
        assert k == 4 or docs.columns == names
        stages.append(docs)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{D}/documents.parquet'")
    db.sql(f"create view benchmark as select * from '{D}/benchmark.parquet'")
    before = dict(db.sql("select doc_id, text from documents").fetchall())
    good = {r[0] for r in db.sql(f"select doc_id from ({quality.SQL}) where kept").fetchall()}
    want = {d: before[d] for d in good}
    assert texts(stages[0]) == want
    want = kept_lines(want)
    assert texts(stages[1]) == want
    want = {d: want[d] for d, (_, c) in brute(want, 80).items() if c == d}
    assert texts(stages[2]) == want
    db.execute("create table d2 (doc_id bigint, text varchar)")
    db.executemany("insert into d2 values (?, ?)", list(want.items()))
    db.sql("create or replace view documents as select * from d2")
    dirty = {r[0] for r in db.sql(f"select doc_id from ({decontaminate.SQL}) where contaminated").fetchall()}
    want = {d: t for d, t in want.items() if d not in dirty}
    assert texts(stages[3]) == want
    sequences, tokens = check(stages[4].collect(), want)
    assert sequences <= 1.02 * -(-tokens // 2048) + 1
    monkeypatch.setattr(p, "STAGES", [p.STAGES[0], p.STAGES[4]])  # run() hands one stage's documents to the next
    assert p.run(spark, D).select("doc_id").distinct().count() == len(good)


def test_odd_rows(spark, odd):
    docs = odd.withColumn("kept", odd.n_chars).withColumn("line", odd.text)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns
        assert stage(spark, docs.limit(0), D).count() == 0
    assert p.STAGES[-1][1](spark, docs, D).count() >= docs.count()


def test_results_stand_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(p, "STAGES", [p.STAGES[0], p.STAGES[2], p.STAGES[4]])
    docs = table(spark, D, "documents")
    one, good = p.run(spark, D), p.quality_rules(spark, docs, D)
    rows, kept = one.count(), good.count()
    p.run(spark, D), p.quality_rules(spark, docs, D).count()
    assert one.count() == rows and good.count() == kept
