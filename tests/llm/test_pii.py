import hashlib
import math
import re
from collections import Counter

from wordloom.llm import pii as p

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    """The patterns as they are written."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1])]
            if (kind == 0) or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 14 <= len(digits) <= 19 and sum(double) % 10 == 0) or (kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_is_the_patterns():
    for text in (
        "a@b.c x@y a@b@c.de.f. ..@-.- é@x.y _a%+-b@c-d.e-f,q@r.s@t.u", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.4 1.2.3 1..2.3.4.5", "4670349892180623 4670-3498 9218 0623 46703498921806231 1 2 3  4", "+1 (504) 555-2652 +12 +1 (504) 555-2652) . +123456789012345678 ++1 555 555 5555-",
        "@@@ @a.b a@.b a@b. a@b.c@d.e", None, "",
    ):
        assert p.base_spans(text) == plain(text), text
    for slow in ("x" * 200000, "1" * 200000, "1." * 100000, "+" + "(" * 100000, "a@" * 50000):
        p.base_spans(slow)


def test_query_is_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    term = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    total, n_t, n_e, n_te, lines = 0, Counter(), Counter(), Counter(), {}
    for text in texts.values():
        for line in text.split("\n"):
            total += 1
            n_t.update({t for t in term.findall(low(line)) if len(t) >= 3})
            spans, masked = plain(line), list(low(line))
            for s, _, e in spans:
                masked[s:e] = " " * (e - s)
            for e in {p.entity(k, line[a:b]) for a, k, b in spans}:
                n_e[e] += 1
                for t in {t for t in term.findall("".join(masked)) if len(t) >= 3}:
                    n_te[e, t] += 1
                    lines.setdefault((e, t), set()).add(line)
    bad = {t for (e, t), n in n_te.items() if len(lines[e, t]) >= 2 and math.log2(n * total / (n_t[t] * n_e[e])) / -math.log2(n_e[e] / total) >= p.DISCLOSURE}
    rows = p.op5_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        base = plain(text)
        show = lambda spans: ",".join(f"{p.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(show(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        more = [(m.start(), 4, m.end()) for m in term.finditer(low(text)) if m[0] in bad and not any(s < m.end() and m.start() < e for s, _, e in base)]
        assert r["spans"] == show(base + more)


def test_a_telling_term_goes_with_the_entity(spark):
    rows = [(i, f"plain words of every day\nno news {i} at all") for i in range(60)]
    rows += [(100, "Zanzibar wrote from a@b.com today"), (101, "ask Zanzibar at A@B.com for news"), (102, "only Zanzibar here of every"), (None, None)]
    out = {r["doc_id"]: r for r in p.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["clean_text"] == "xxxxxxxx wrote from [EMAIL] today" and out[102]["clean_text"] == "only xxxxxxxx here of every"
    assert out[5]["clean_text"] == rows[5][1] and out[None]["clean_text"] is None


def test_odd_rows(spark, odd):
    got = p.find(odd.withColumn("spans", odd.n_chars).withColumn("base", odd.text)).collect()
    assert len(got) == odd.count() and {"spans_in", "base_in"} <= set(got[0].asDict()) and all(r["spans"] == [] for r in got)
    assert p.find(odd.limit(0)).count() == 0 and p.sanitise(odd.limit(0)).count() == 0
