"""Quality rules with thresholds that adapt to each language and source.

Features of each document (symbols a word, share of repeated lines, share of
words in repeated three-word windows, mean word length) go into quantile
sketches: counts of values in buckets whose bounds grow by a constant ratio, so
that a quantile is right to ``ACCURACY`` and sketches merge by adding counts.
Sketches of language and source are merged into those of the language and of the
whole corpus; a group with fewer than ``LEAST`` documents takes the next wider
sketch. A fence lies ``SPREAD`` times as far from the group's median as an upper quantile
does (for word length the quartiles, on either side), so it is the sketches alone that
say how much is usual in a group. What a short document shows of a group's rate is
uncertain: a document is rejected if it lies outside the fences by more than ``ERRORS``
standard errors of its own counts (of a count, in units that can't come apart; of a
mean word length). Documents that fail the base rule are rejected before, and don't
count in the sketches.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Scratch, arrow_columns, renamed_clashes, table

ACCURACY, SPREAD, LEAST, ERRORS = 0.01, 4.0, 100, 4.0
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Feature: (what is counted, out of how many, upper quantile, unit). A repeat is two windows of three words at least.
FEATURES = {"symbols": ("n_symbols", "n_words", 0.75, 1), "lines": ("n_dup_lines", "n_lines", 0.9, 1), "repeats": ("n_repeat_words", "n_words", 0.9, 6), "length": ("word_chars", "n_words", 0.75, None)}
#: Standard deviation of the length of words within a text; length alone has a lower fence too.
LENGTHS = 2.0
#: Copies of each threshold row, so that a source with most rows spreads over tasks.
SALT = 64
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = "#*$%&|<>"
OUTPUTS = [*BASE, "base_failed", "kept", "level", "lang_key", "source_key", "__salt"]


def counts(text: str | None) -> tuple[int, ...]:
    """The values of ``BASE`` for a whole text; null counts as empty."""
    text = text or ""
    words = re.findall(WORD, text)
    n, repeated = len(words), 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if n > 3 and len(windows) < n - 2:
        end = 0
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            if windows[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            lines += 1
            again += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated, lines


def _count_all(texts):
    rows = [counts(t) for t in texts]
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in BASE]


def score(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``BASE`` and base_failed."""
    scored = arrow_columns(docs, ["text"], ", ".join(f"{c} bigint" for c in BASE), _count_all, keep)
    return scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _group(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("\x00"))


def sketches(scored: DataFrame) -> DataFrame:
    """lang_key, source_key, feature, bucket, n: bucket null holds zeros, i holds (gamma^(i-1), gamma^i]."""
    pairs = ", ".join(f"'{name}', CAST({count} / {of} AS DOUBLE)" for name, (count, of, _, _) in FEATURES.items())
    values = (
        scored.filter(~F.col("base_failed"))
        .select(_group("lang").alias("lang_key"), _group("source").alias("source_key"), F.expr(f"stack({len(FEATURES)}, {pairs}) AS (feature, value)"))
        .withColumn("bucket", F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(GAMMA)).cast("int")))
    )
    return values.groupBy("lang_key", "source_key", "feature", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lower quartile, median and upper quantile of each feature, and the number of values."""
    buckets = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "feature")
    running = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = buckets.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(group))
    value = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)), F.lit(0.0))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), value))
    upper = F.element_at(F.create_map(*[F.lit(x) for name, (_, _, q, _) in FEATURES.items() for x in (name, q)]), F.col("feature"))
    return ranked.groupBy(*keys, "feature").agg(F.max("total").alias("total"), at(F.lit(0.25)).alias("low"), at(F.lit(0.5)).alias("mid"), at(upper).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang_key, source_key, level and ``<feature>_low``, ``<feature>_high``; a row for each group that has documents."""
    own = _quantiles(sketch, ["lang_key", "source_key"])
    lang = _quantiles(sketch, ["lang_key"]).select("lang_key", "feature", *[F.col(c).alias(f"lang_{c}") for c in ("total", "low", "mid", "high")])
    every = _quantiles(sketch, []).select("feature", *[F.col(c).alias(f"all_{c}") for c in ("total", "low", "mid", "high")])
    wide = own.join(lang, ["lang_key", "feature"]).join(F.broadcast(every), ["feature"])  # a row for each feature
    level = F.when(F.col("total") >= LEAST, "source").when(F.col("lang_total") >= LEAST, "language").otherwise("corpus")
    pick = lambda c: F.when(F.col("level") == "source", F.col(c)).when(F.col("level") == "language", F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    wide = wide.withColumn("level", level).select("lang_key", "source_key", "feature", "level", *[pick(c).alias(c) for c in ("low", "mid", "high")])
    fences = []
    for name in FEATURES:
        one = lambda c, name=name: F.max(F.when(F.col("feature") == name, c))
        fences += [one(F.col("mid") - SPREAD * (F.col("mid") - F.col("low"))).alias(f"{name}_low"), one(F.col("mid") + SPREAD * (F.col("high") - F.col("mid"))).alias(f"{name}_high")]
    return wide.groupBy("lang_key", "source_key").agg(F.max("level").alias("level"), *fences)


def _inside(name: str) -> str:
    """SQL (Spark's and DuckDB's): whether a document lies inside a feature's fences, but for the error of its own counts."""
    count, of, _, unit = FEATURES[name]
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    if unit is None:
        error = f"{number(ERRORS * LENGTHS)} * sqrt({of})"
        return f"({count} BETWEEN {name}_low * {of} - {error} AND {name}_high * {of} + {error})"
    return f"({count} <= {name}_high * {of} + {number(ERRORS)} * sqrt({unit} * {name}_high * {of} + {unit * unit}))"


def judge(scored: DataFrame, fences: DataFrame) -> DataFrame:
    """``scored`` with kept and level; rows of a group without fences all fail the base rule."""
    salted = fences.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = scored.withColumns({"lang_key": _group("lang"), "source_key": _group("source"), "__salt": F.pmod(F.xxhash64(*[c for c in ("doc_id", *BASE) if c in scored.columns]), F.lit(SALT)).cast("int")})
    inside = F.expr(" AND ".join(f"coalesce({_inside(name)}, false)" for name in FEATURES))
    judged = rows.join(salted, ["lang_key", "source_key", "__salt"], "left")
    out = [F.col(f"`{c}`") for c in scored.columns]
    return judged.select(*out, (~F.col("base_failed") & inside).alias("kept"), F.coalesce("level", F.lit("none")).alias("level"))


def quality(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``BASE``, base_failed, kept and level.

    Needs text, lang and source; null languages and sources are groups of their own.
    Columns of the input whose names clash are returned as ``<name>_in``.
    An empty table gives an empty result; without words a document fails.
    """
    docs = renamed_clashes(docs, OUTPUTS, [])
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.save(score(docs, keep), "scored")
    return judge(scored, thresholds(sketches(scored)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    own = renamed_clashes(docs, OUTPUTS, [])
    good = quality(docs).filter("kept")
    return good.select([F.col(f"`{new}`").alias(old) for new, old in zip(own.columns, docs.columns, strict=True)])


def op4_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality(docs, ["doc_id", "lang", "source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level")


def _sql() -> str:
    stack = " UNION ALL ".join(f"SELECT lang_key, source_key, '{f}' AS feature, {count}::DOUBLE / nullif({of}, 0) AS value FROM good" for f, (count, of, _, _) in FEATURES.items())
    upper = "CASE feature " + " ".join(f"WHEN '{f}' THEN {q}" for f, (_, _, q, _) in FEATURES.items()) + " END"

    def quant(name, keys):
        by = ", ".join([*keys, "feature"])
        return f"""{name}_b AS (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket),
        {name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}) AS total, coalesce(pow({GAMMA!r}::DOUBLE, bucket) * {2 / (1 + GAMMA)!r}::DOUBLE, 0.0::DOUBLE) AS v FROM {name}_b),
        {name} AS (SELECT {by}, max(total) AS total, {", ".join(f"min(CASE WHEN upto >= ceil({q} * total) THEN v END) AS {c}" for q, c in ((0.25, "low"), (0.5, "mid"), (upper, "high")))} FROM {name}_r GROUP BY {by})"""

    pick = ", ".join(f"CASE WHEN s.total >= {LEAST} THEN s.{c} WHEN l.total >= {LEAST} THEN l.{c} ELSE a.{c} END AS {c}" for c in ("low", "mid", "high"))
    fences = ", ".join(f"max(CASE WHEN feature = '{f}' THEN mid - {SPREAD}::DOUBLE * (mid - low) END) AS {f}_low, max(CASE WHEN feature = '{f}' THEN mid + {SPREAD}::DOUBLE * (high - mid) END) AS {f}_high" for f in FEATURES)
    inside = " AND ".join(f"coalesce({_inside(f)}, false)" for f in FEATURES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, chr(0)) AS lang_key, coalesce(source, chr(0)) AS source_key FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, string_split(text, chr(10)) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c > 1) GROUP BY rid),
lin AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '{WORD}') GROUP BY rid),
s AS (SELECT rid, doc_id, lang_key, source_key, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lin.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lin.n, 0) AS n_lines
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lin USING (rid)),
scored AS (SELECT *, coalesce(wc, 0) AS word_chars, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
good AS (SELECT * FROM scored WHERE NOT base_failed),
sketch AS (SELECT lang_key, source_key, feature, CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(GAMMA)!r}::DOUBLE)::INT END AS bucket, count(*) AS n FROM ({stack}) GROUP BY ALL),
{quant("own", ["lang_key", "source_key"])}, {quant("lang", ["lang_key"])}, {quant("every", [])},
picked AS (SELECT s.lang_key, s.source_key, s.feature, CASE WHEN s.total >= {LEAST} THEN 'source' WHEN l.total >= {LEAST} THEN 'language' ELSE 'corpus' END AS level, {pick}
  FROM own s JOIN lang l ON s.lang_key = l.lang_key AND s.feature = l.feature JOIN every a ON a.feature = s.feature),
fences AS (SELECT lang_key, source_key, max(level) AS level, {fences} FROM picked GROUP BY lang_key, source_key)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND {inside}) AS kept, coalesce(level, 'none') AS level
FROM scored LEFT JOIN fences USING (lang_key, source_key)"""


SQL = _sql()
