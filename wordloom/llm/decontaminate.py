"""Benchmark decontamination by a prefix-filtered set join on word shingles.

Items are cut into windows of ``WINDOW`` words (shorter items are one window). A
window's shingles are ordered by how often documents hold them, rarest first. A
document holds the window only if it holds all its shingles, so for exact
containment the necessary prefix is one shingle, the rarest. Documents' shingles
are joined to these prefix shingles alone; the place of the shingle in the window
and in the document gives the start, which must leave room before and after
(positional and length bounds); then the words themselves are compared.

Everything is DataFrame operations. While the items have at most
``BROADCAST_WINDOWS`` windows, they are sent to the documents and no document
moves; beyond, shingles are joined by a shuffle, and words are fetched again for
the candidates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ALNUM_WORD, Scratch, keyed, lowered, renamed_clashes, table, without, words_of

WINDOW, SHINGLE = 13, 3
#: About 200 bytes each.
BROADCAST_WINDOWS = 200_000
KEY = ["doc_id", "text_key"]


def ascii_lower(text: Column) -> Column:
    """A to Z only; where all is ASCII, the built-in lower() does the same faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lowered(text))


def with_words(df: DataFrame, *keep: Column | str) -> DataFrame:
    return df.select(*keep, ascii_lower(F.col("text")).alias("low")).withColumn("words", words_of(F.col("low"), ALNUM_WORD)).drop("low")


def shingles(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """``keep``, at (from 0) and shingle (a hash) for each run of k words; words that hash alike are told apart later."""
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("words", i + 1, n).alias(f"w{i}") for i in range(k)])
    return df.select(*keep, F.posexplode(runs).alias("at", "run")).select(*keep, "at", F.xxhash64(*[F.col("run").getField(f"w{i}") for i in range(k)]).alias("shingle"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and window (array of words): each distinct one once. Items without words have none."""
    items = with_words(items, "item_id").filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return items.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s"), size).alias("window")).distinct()


def _sent(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def prefixes(docs: DataFrame, own: DataFrame, k: int, small: bool) -> DataFrame:
    """shingle, at, window: the rarest shingle of each window of ``own``; ties go to the smaller hash, then the first place."""
    parts = shingles(own.select("window", F.col("window").alias("words")), k, "window")
    held = shingles(docs.select("words"), k).select("shingle").join(_sent(parts.select("shingle").distinct(), small), "shingle").groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = parts.join(held, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "at")).alias("first"))
    return ranked.filter("first.often > 0").select(F.col("first.shingle").alias("shingle"), F.col("first.at").alias("within"), "window")


def occurrences(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = WINDOW, k: int = SHINGLE, limit: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, start, window) wherever a document holds a window, and the windows.

    text_key is xxhash64 of the text: rows with the same id and text are one.
    """
    own = scratch.save(windows(items, size), "windows")
    distinct = own.select("window").distinct()
    small = distinct.count() <= limit
    texts = with_words(docs, "doc_id", F.xxhash64("text").alias("text_key"))
    found = []
    # windows shorter than a shingle are shingles themselves
    for width in sorted(r[0] for r in distinct.select(F.least(F.size("window"), F.lit(k))).distinct().collect()):
        part = distinct.filter(F.least(F.size("window"), F.lit(k)) == width)
        first = scratch.save(prefixes(texts, part, width, small), f"prefixes{width}")
        start = F.col("at") - F.col("within")
        bounds = (F.col("at") >= F.col("within")) & (start + F.size("window") <= F.size("words"))
        equal = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
        if small:
            hits = shingles(texts, width, *KEY, "words").join(F.broadcast(first), "shingle").filter(bounds).filter(equal)
        else:
            near = shingles(texts, width, *KEY).join(first, "shingle").filter(F.col("at") >= F.col("within"))
            t = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "words")
            hits = near.join(t, (F.col("t") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))).filter(bounds).filter(equal)
        found.append(hits.select(*KEY, start.alias("start"), "window"))
    out = found[0] if found else docs.sparkSession.createDataFrame([], docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(0).alias("start"), F.array(F.lit("")).alias("window")).schema)
    for f in found[1:]:
        out = out.unionByName(f)
    return scratch.save(out.distinct(), "hits"), own


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, size: int = WINDOW, k: int = SHINGLE, limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Every row with n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    A word is hit if it lies inside any occurrence of a window; contaminated means that
    at least a twentieth of the words are hit. Needs doc_id, text of documents and
    item_id, text of items; null and empty texts have no words; items with equal
    windows all count; a null item_id is left out of item_ids. Columns of the input
    whose names clash come back as ``<name>_in``.
    """
    docs = renamed_clashes(docs, ["n_words", "n_hit", "n_items", "item_ids", "contaminated", "text_key", "words", "low"], [])
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits, own = occurrences(docs, items, scratch, size, k, limit)
    by_doc = W.partitionBy(*KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.groupBy(*KEY, "start").agg(F.max(F.size("window")).alias("n")).withColumn("end", F.col("start") + F.col("n"))
    spans = spans.withColumn("before", F.coalesce(F.max("end").over(by_doc), F.lit(0)))
    n_hit = spans.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    named = hits.select(*KEY, "window").distinct().join(own, "window").select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
    n_items = named.groupBy(*KEY).agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("item_ids"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    told = n_hit.alias("h").join(n_items.alias("i"), same("h", "i")).select("h.*", "n_items", "item_ids")
    light = list(dict.fromkeys([*keep, "doc_id"]))
    rows = with_words(docs, *[F.col(f"`{c}`") for c in light], F.xxhash64("text").alias("text_key")).withColumn("n_words", F.size("words").cast("long")).drop("words")
    out = rows.alias("r").join(told.alias("t"), same("r", "t"), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        *[F.col(f"r.`{c}`") for c in keep], "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, with its columns."""
    return without(docs, contamination(keyed(docs), items, ["doc_id", "doc_key"]).filter("contaminated"))


def op10_decontaminate(spark, sf_dir) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = contamination(docs, items, ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
runs AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT rid, i, runs.n, item_id FROM runs JOIN win ON runs.w = win.w AND runs.n = win.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
