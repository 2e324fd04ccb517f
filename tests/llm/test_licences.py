import random

import numpy as np
import pytest

from wordloom.llm import licences as l


@pytest.fixture(scope="module")
def fitted():
    return l.model(())


def plain(text, fitted):
    """family of each line that is a licence, by a loop."""
    weights, least = fitted
    out = {}
    for i, line in enumerate((text or "").split("\n")):
        own = sorted(l._AT[g] for g in l.grams(line) if g in l._AT)
        if own:
            z = weights[own].sum(0) + weights[-1]
            e = np.exp(z - z.max())
            if e[1:].sum() > e[0]:
                k = int(e[1:].argmax())
                out[i] = l.FAMILIES[k + 1] if e[k + 1] / e[1:].sum() >= least else "unknown"
    return out


def test_scan_is_the_loop(spark, fitted):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["line"]): r["family"] for r in l.scan(docs, fitted).collect()}
    assert got == {(r["doc_id"], i): f for r in docs.collect() for i, f in plain(r["text"], fitted).items()}


def test_the_notices_of_the_documents_are_found_and_nothing_else(spark):
    d = "/root/testdata/sf0.1"
    notices = {"GNU General Public License, version 3.": "gpl", "CC BY-NC 4.0.": "cc-by-nc", "MIT License.": "mit", "Apache License, Version 2.0.": "apache"}
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    for r in l.op2_licences(spark, d).collect():
        want = ",".join(sorted(f for n, f in notices.items() if n in texts[r["doc_id"]]))
        assert (r["families"], r["confirmed"], r["n_unknown"]) == (want, want, 0), (r, texts[r["doc_id"]][:200])


MIT = """Copyright (c) 2020 The Authors.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

The fish is in the river."""


def test_wrapped_notices_are_one_paragraph(spark, fitted):
    marks = {"plain": "{}", "slashes": "// {}", "stars": " * {}", "hashes": "# {}"}
    texts = {(kind, name): "\n".join(mark.format(x).rstrip() for x in text.split("\n")) for name, mark in marks.items() for kind, text in (("mit", MIT), ("bsd", BSD))}
    texts["mit", "windows"] = MIT.replace("\n", "\r\n")
    docs = spark.createDataFrame([(f"{k} {n}", t) for (k, n), t in texts.items()], "doc_id string, text string")
    found = {}
    for r in l.scan(docs, fitted).filter("family in ('mit', 'bsd')").collect():
        found.setdefault(r["doc_id"], []).append((r["line"], r["family"], r["confirmed"]))
    assert found == {f"{k} {n}": [(2 if k == "mit" else 0, k, True)] for k, n in texts}


def test_lines_that_end_sentences_are_paragraphs(spark):
    text = "one two\nthree.\nfour\n\nfive\n//\nsix; \x01\nSeven |\n" + "x" * 121 + "\nend. |\nlast\n"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(l.paragraphs("text").alias("p")).collect()
    assert [(x["line"], x["s"].split("\x01")) for x in rows[0]["p"]] == [(0, ["one two", "three."]), (2, ["four"]), (3, [""]), (4, ["five"]), (5, ["//"]), (6, ["six; \x02", "Seven |", "x" * 121]), (9, ["end. |"]), (10, ["last"]), (11, [""])]
    assert [(x["line"], x["s"]) for x in rows[1]["p"]] == [(0, "")] and rows[2]["p"] is None


def test_held_out_texts(fitted):
    rng = random.Random(77)
    test = l.examples(rng, [], 3)
    right = [(plain(t, fitted).get(0, "none"), f) for f, t in test]
    assert np.mean([a == b for a, b in right if b != "none"]) > 0.9
    assert np.mean([a == "none" for a, b in right if b == "none"]) > 0.95


def test_strange_licences_are_unknown(fitted):
    for text in ("This work is licensed under the Foo Bar Public License.", "Released under the license of the club."):
        assert plain(text, fitted).get(0) == "unknown", (text, plain(text, fitted))


def test_odd_rows(spark, odd, fitted):
    rows = l.licences(odd.withColumn("families", odd.n_chars).withColumn("line", odd.text)).collect()
    assert len(rows) == odd.count() and all(r["n_licences"] == 0 for r in rows) and "families_in" in rows[0].asDict()
    assert l.licences(odd.limit(0)).count() == 0
    two = spark.createDataFrame([(None, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert [r["confirmed"] for r in l.licences(two).collect()] == ["mit", "mit"]
