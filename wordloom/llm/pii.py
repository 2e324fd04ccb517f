"""Personal data: base patterns, and terms that give protected entities away.

The base finds emails, addresses, cards and phone numbers in whole texts. Every value
found is a protected entity. Contexts are lines. A term (a word of ``TERM_CHARS`` or
more letters and digits, A to Z lower-cased) reveals an entity by its pointwise mutual
information with it, measured against the entity's own information content:

    degree = log2(n(t, e) N / (n(t) n(e))) / -log2(n(e) / N)

with N lines in the corpus, n(e) and n(t) those that hold the entity and the term,
n(t, e) those that hold both, all counted over the whole corpus. A term whose degree
reaches ``DISCLOSURE`` for any entity, with both found together in ``SUPPORT``
different lines at least (one line and its copies prove nothing), is a span of kind
``term`` wherever it occurs. In sanitised text entities become their kind's mark,
terms of degree ``REMOVE`` or more are removed, and others generalised to their shape.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ASCII_LOWER, Scratch, arrow_columns, renamed_clashes, table, words_of
from .decontaminate import ascii_lower

KINDS = ["email", "ip", "card", "phone", "term"]
DISCLOSURE, REMOVE, SUPPORT, TERM_CHARS = 0.9, 0.999, 2, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the first digit of a run: from a later one a match would fail for the same reason, and slowly
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(ALNUM_WORD)
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ to both sides, which takes time in proportion to the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at and at >= last else None
        if domain:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; places in code points, ends exclusive."""
    text, out = text or "", []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()] if len(m[0]) < 40 else []
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """The value without the ways to write it."""
    return f"{KINDS[kind]}:{value.translate(ASCII_LOWER) if kind == 0 else re.sub('[^0-9.]' if kind == 1 else '[^0-9]', '', value)}"


def _terms(line: str) -> set[str]:
    return {t for t in _TERM.findall(line) if len(t) >= TERM_CHARS}


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each line with entities: a hash of the line, its entities and its terms outside of them."""
    from xxhash import xxh3_64_intdigest

    by_line: dict[int, list] = {}
    for s, kind, e in spans:
        by_line.setdefault(text.rfind("\n", 0, s) + 1, []).append((s, kind, e))
    out = []
    for start, own in by_line.items():
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        line, masked = text[start:end], list(text[start:end].translate(ASCII_LOWER))
        for s, _, e in own:
            masked[s - start : e - start] = " " * (min(e, end) - s)
        out.append({"line": xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63), "entities": sorted({entity(k, text[s:e]) for s, k, e in own}), "terms": sorted(_terms("".join(masked)))})
    return out


def find_base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with base (spans) and contexts."""

    def run(texts):
        spans = [base_spans(t) for t in texts]
        return [[[{"start": s, "kind": k, "end": e} for s, k, e in own] for own in spans], [contexts(t, own) if own else [] for t, own in zip(texts, spans, strict=True)]]

    return arrow_columns(docs, ["text"], f"base {SPANS}, contexts array<struct<line:bigint,entities:array<string>,terms:array<string>>>", run, keep)


def disclosing(docs: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """term and degree (its largest, for any entity) of the terms that reveal one."""
    seen = base.select(F.explode("contexts").alias("c")).select("c.line", F.explode("c.entities").alias("entity"), "c.terms")
    n_e = seen.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = seen.select("line", "entity", F.explode("terms").alias("term")).groupBy("entity", "term", "line").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("lines"))
    pairs = scratch.save(pairs.filter(F.col("lines") >= SUPPORT).join(n_e, "entity"), "pairs")
    lines = docs.select(F.explode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("line"))
    held = lines.select(F.explode(F.array_distinct(words_of(F.col("line"), ALNUM_WORD))).alias("term")).filter(F.length("term") >= TERM_CHARS).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))), F.lit(0)).cast("double").alias("n"))
    scored = pairs.join(held, "term").crossJoin(F.broadcast(total))  # a single row
    degree = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))) / F.greatest(-F.log2(F.col("n_e") / F.col("n")), F.lit(1e-9))
    return scored.withColumn("degree", degree).filter(F.col("degree") >= DISCLOSURE).groupBy("term").agg(F.max("degree").alias("degree"))


def _term_spans(texts, terms, bases):
    out = []
    for text, own, base in zip(texts, terms, bases, strict=True):
        own, spans, taken = {t["term"]: t["degree"] for t in own}, [], [(b["start"], b["end"]) for b in base]
        for m in _TERM.finditer((text or "").translate(ASCII_LOWER)):
            if m[0] in own and not any(s < m.end() and m.start() < e for s, e in taken):
                spans.append({"start": m.start(), "kind": 4, "end": m.end()})
        out.append(spans)
    return [out]


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with base and spans (arrays of start, kind and end, sorted; kind is a place in ``KINDS``) and terms (term, degree).

    Needs doc_id and text. A null text is empty and has no spans. Rows that repeat
    doc_id and text are told the same. Columns of the input whose names clash come back
    as ``<name>_in``. The text passes through Python once, and again for the documents
    that hold a disclosing term.
    """
    docs = renamed_clashes(docs, ["base", "spans", "terms", "contexts", "text_key"], [])
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    light = list(dict.fromkeys([*[c for c in keep if c != "text"], "doc_id", "text_key"]))
    base = scratch.save(find_base(docs, light), "base")
    terms = scratch.save(disclosing(docs, base, scratch), "terms")
    key = docs.select("doc_id", "text_key", F.explode(F.array_distinct(words_of(ascii_lower(F.col("text")), ALNUM_WORD))).alias("term")).join(terms, "term")
    hold = scratch.save(key.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("term", "degree")).alias("terms")), "hold")
    spans_of = hold.join(base.select("doc_id", "text_key", "base").dropDuplicates(["doc_id", "text_key"]), (hold["text_key"] == base["text_key"]) & hold["doc_id"].eqNullSafe(base["doc_id"])).select(hold["doc_id"], hold["text_key"], "terms", "base")
    texts = docs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "text").join(spans_of, (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))).drop("d", "k")
    more = arrow_columns(texts, ["text", "terms", "base"], f"more {SPANS}", _term_spans, ["doc_id", "text_key", "terms"]).dropDuplicates(["doc_id", "text_key"])
    rows = base if "text" not in keep else docs.join(base.select("doc_id", "text_key", "base").dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "__d", "text_key": "__k"}), (F.col("text_key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")))
    r, m = rows.alias("r"), more.alias("m")
    out = r.join(m, (F.col("r.text_key") == F.col("m.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")), "left")
    every = F.array_sort(F.concat(F.col("r.base"), F.coalesce(F.col("m.more"), F.array().cast(SPANS))))
    return out.select(*[F.col(f"r.`{c}`") for c in keep], F.col("r.base").alias("base"), every.alias("spans"), F.coalesce(F.col("m.terms"), F.array().cast("array<struct<term:string,degree:double>>")).alias("terms"))


def _rewrite(texts, spans, terms):
    out = []
    for text, own, known in zip(texts, spans, terms, strict=True):
        degrees, parts, at = {t["term"]: t["degree"] for t in known}, [], 0
        for x in own:
            if x["start"] < at:
                at = max(at, x["end"])
                continue
            value = text[x["start"] : x["end"]]
            if x["kind"] < 4:
                mark = f"[{KINDS[x['kind']].upper()}]"
            elif degrees.get(value.translate(ASCII_LOWER), 0) >= REMOVE:
                mark = ""
            else:
                mark = "".join("0" if c.isdigit() else "x" for c in value)
            parts += [text[at : x["start"]], mark]
            at = x["end"]
        out.append(None if text is None else "".join([*parts, text[at:]]))
    return [out]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, and clean_text: null where text is null. Needs doc_id and text."""
    names = renamed_clashes(docs, ["clean_text", "base", "spans", "terms", "contexts", "text_key"], []).columns
    return arrow_columns(find(renamed_clashes(docs, ["clean_text"], [])), ["text", "spans", "terms"], "clean_text string", _rewrite, names)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    of = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    n = [of(i) for i in range(4)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
