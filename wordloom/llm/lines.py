"""Line dedup: a segment-partition join on edit distance, in DataFrame operations alone.

All lines that hold a word are compared. Two are linked if their edit distance is at most
k of the shorter one: an edit for each ``A_STEP`` characters, ``EDITS`` at most; shorter
lines are linked with their equals alone. Each distinct line is split into k + 1 segments.
Whatever k edits do to a line, one segment stays whole, at a place that the edits
left of it and the difference in length bound. So each line is indexed by its
segments, under its length, and probes the indexes of lines of its own length and up
to k shorter with its substrings at those places alone (for k = 2, 12 substrings).

Many lines may share a segment and nothing else, as lines from one template do. So what
meets is split again, whatever the number of lines: without the shared segment, the two
remainders are at most k edits apart. Each line's remainder is cut into ``PIECES``
pieces, of which any k + 1 have one that stays whole; it is indexed by those k + 1
that the fewest lines of the bucket have, and probed with all. Counts of twelve letters
(k edits change their sum by 2k at most) turn pairs away inside that join; the
others are verified by a bit-parallel automaton over the 2k + 1 diagonals that k
edits can reach.

Equal lines collapse into one node, named by a 128-bit digest, before anything is
compared, with partial sums in front of the shuffle. A class is a connected component
of links; its first line (smallest document, then smallest place in it) is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, table
from .graph import components

LEAST, EDITS, A_STEP = 1, 2, 18
#: Pieces of what two lines have besides a shared segment.
PIECES = 8
HAS_WORD = WORD.rstrip("+")
#: The most frequent letters of the languages at hand; any twelve give right results.
LETTERS, LETTER_BITS = "etanoirshdlu", 5


def split_lines(docs: DataFrame, *keep: str, least: int = LEAST) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), ``keep``, line (from 0), s (the line) for each line with a word and at least ``least`` characters."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), *keep, F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line", "s"))
    return lines.filter((F.length("s") >= least) & F.col("s").rlike(HAS_WORD))


def edits_of(n: Column, edits: int) -> Column:
    """The edits that a line of n characters allows."""
    return F.least(F.floor(n / A_STEP).cast("int"), F.lit(edits))


def segment(n: Column, i: int | Column, k: int | Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line of n characters: the last n mod (k+1) are one longer."""
    short, longer = F.floor(n / (k + 1)).cast("int"), F.pmod(n, F.lit(k + 1)).cast("int")
    before = F.greatest(F.lit(0), F.lit(i) - (k + 1 - longer))
    return short * i + before, short + F.when(F.lit(i) >= k + 1 - longer, 1).otherwise(0)


def probes(edits: int) -> list[tuple[int, int, int, int]]:
    """(k, characters fewer, segment, shift): where a line looks for segments of lines that allow k edits. Shift 0 in lines as long is its own."""
    return [(k, shorter, i, shift) for k in range(1, edits + 1) for shorter in range(k + 1) for i in range(k + 1) for shift in range(max(-i, shorter - (k - i)), min(i, shorter + k - i) + 1)]


def probe_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (n, s and others) without s, with a key k0, k1, ... of the substring of each of ``probes``; null where the lines that long allow other edits.

    Substrings are cut from 4 bytes a character, without counting characters from the
    left. A line that allows k edits has ``A_STEP`` * k characters, so every probe lies
    inside. In whole-stage code all keys would stand in one method that is too large for
    the JVM to compile; n goes through a function over an array, which changes nothing but
    that Spark then splits the code.
    """
    rest, n, keys = [c for c in lines.columns if c not in ("n", "s")], F.col("n"), []
    for j, (k, shorter, i, shift) in enumerate(probes(edits)):
        start, length = segment(n - shorter, i, k)
        keys.append(F.when(edits_of(n - shorter, edits) == k, F.xxhash64((n - shorter) * 16 + i, F.substring("wide", (start + shift) * 4 + 1, length * 4))).alias(f"k{j}"))
    same = F.get(F.transform(F.array(n), lambda x: x), F.lit(0)).alias("n")
    return lines.select(*rest, "n", F.encode("s", "UTF-32").alias("wide")).select(*rest, same, *keys)


def rest_pieces(met: DataFrame, edits: int) -> DataFrame:
    """``met`` (key, node, j, s, n, letters) as node, key, n, letters, k, piece, own, rest: pieces of s without the substring of probe j.

    Each piece is looked for wherever k edits can have moved it; own says that it is the line's own, at its place.
    """
    told = [F.element_at(F.array(*map(F.lit, column)), F.col("j") + 1) for column in zip(*probes(edits))]
    met = met.withColumns(dict(zip(("k", "shorter", "i", "shift"), told, strict=True)))
    start, length = segment(F.col("n") - F.col("shorter"), F.col("i"), F.col("k"))
    met = met.withColumns({"start": start + F.col("shift"), "length": length})
    met = met.withColumns({"left": F.concat(F.substring("s", F.lit(1), F.col("start")), F.substring("s", F.col("start") + F.col("length") + 1, F.col("n"))), "size": F.col("n") - F.col("length")})
    tries = F.array(*[F.struct(F.lit(piece).alias("piece"), F.lit(move).alias("move")) for piece in range(PIECES) for move in range(-(edits // 2), edits + 1)])
    met = met.withColumn("p", F.explode(tries)).select("*", "p.piece", "p.move")
    can = (2 * F.col("move") >= F.col("shorter") - F.col("k")) & (2 * F.col("move") <= F.col("shorter") + F.col("k"))
    first, wide = segment(F.col("size") - F.col("shorter"), F.col("piece"), PIECES - 1)
    met = met.filter(can).withColumns({"first": first + F.col("move"), "wide": wide}).filter((F.col("first") >= 0) & (F.col("first") + F.col("wide") <= F.col("size")))
    own = (F.col("shorter") == 0) & (F.col("shift") == 0) & (F.col("move") == 0)
    return met.select("node", "key", "n", "letters", "k", "piece", own.alias("own"), F.xxhash64("key", "piece", F.substring("left", F.col("first") + 1, F.col("wide"))).alias("rest"))


def letter_counts(s: Column) -> Column:
    """Counts of ``LETTERS`` modulo 32, packed."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND((1 << LETTER_BITS) - 1).cast("long"), i * LETTER_BITS))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """At most the sum of differences between the counts of two lines."""
    total, top = F.lit(0), (1 << LETTER_BITS) - 1
    for i in range(len(LETTERS)):
        d = (F.shiftright(a, i * LETTER_BITS) - F.shiftright(b, i * LETTER_BITS)).bitwiseAND(top)
        total = total + F.least(d, top + 1 - d)
    return total


def within(a: Column, b: Column, k: int) -> Column:
    """Whether arrays of characters are at most k edits apart: a bit-parallel automaton over 2k+1 diagonals.

    After i characters of a, bit k + d of row e says that they can be turned into the
    first i + d of b with at most e edits. A character keeps the bits whose diagonal
    matches; an edit takes a bit from the row above: the same diagonal (replaced), one
    lower (left out of b) or, in the new row, one higher (put into b).
    """
    mask = (1 << (2 * k + 1)) - 1
    # each character of a beside those of b that it can meet, so that the state is small
    beside = [F.slice(b, d + 1, F.size(a)) if d >= 0 else F.concat(F.array_repeat(F.lit(None).cast("string"), -d), b) for d in range(-k, k + 1)]
    zipped = F.slice(F.arrays_zip(a.alias("c"), *[x.alias(f"d{j}") for j, x in enumerate(beside)]), 1, F.size(a))
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << k & mask).alias(f"r{e}") for e in range(k + 1)])

    def step(state, x):
        match = F.lit(0)
        for j in range(2 * k + 1):
            match = match.bitwiseOR(F.when(x[f"d{j}"] == x["c"], 1 << j).otherwise(0))

        def rows(m):
            new = [state["r0"].bitwiseAND(m)]
            for e in range(1, k + 1):
                above = state[f"r{e - 1}"]
                new.append(state[f"r{e}"].bitwiseAND(m).bitwiseOR(above).bitwiseOR(F.shiftright(above, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(mask))
            return F.struct(*[c.alias(f"r{e}") for e, c in enumerate(new)])

        return F.element_at(F.transform(F.array(match), rows), 1)

    last = F.aggregate(zipped, start, step)[f"r{k}"]
    apart = F.size(b) - F.size(a)
    return (F.abs(apart) <= k) & (F.call_function("shiftright", last, F.greatest(apart + k, F.lit(0))).bitwiseAND(1) == 1) if k else a == b


def near_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """A row for each line with a word and at least ``least`` characters: doc_id, text_key, line, n_chars, class_doc, class_line, n_links, kept.

    class_doc and class_line name the first line of the class, n_links counts the
    different lines that are near enough to this one, and kept says that the row is the
    first of its class. Needs doc_id and text, and takes no other column. Rows with
    the same doc_id and text are one document: they are told the same. Null, empty and
    blank texts have no lines; a null doc_id comes before all others.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "lines")
    n = F.length("s").cast("int")
    digest = F.unhex(F.md5(F.col("s").cast("binary"))).alias("digest")
    lines = probe_keys(split_lines(docs, least=least).select("doc_id", "text_key", "line", n.alias("n"), digest, "s"), edits)
    keys = [c for c in lines.columns if c[0] == "k"]
    # the first place of each distinct line; every copy has the same keys
    nodes = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("place"), *[F.max(c).alias(c) for c in ("n", *keys)])
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    # keys that several lines have, counted with partial sums and joined back
    own = [j for j, (_, shorter, _, shift) in enumerate(probes(edits)) if (shorter, shift) == (0, 0)]
    places = nodes.select("node", F.posexplode(F.array(*keys)).alias("j", "key")).filter("key is not null")
    many = places.groupBy("key").agg(F.count("*").alias("many"), F.max(F.col("j").isin(own)).alias("indexed")).filter("many > 1 and indexed").select("key")
    shared = scratch.save(places.join(scratch.save(many, "many").hint("merge"), "key").select("key", "node", "j"), "shared")  # they grow with the lines
    wanted = scratch.save(nodes.join(shared.select("node").distinct(), "node").select("node", F.col("place.doc_id").alias("d"), F.col("place.text_key").alias("t"), F.col("place.line").alias("line")), "wanted")
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(wanted.hint("merge"), (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    texts = scratch.save(found.select("node", F.get(F.split("text", "\n", -1), F.col("line")).alias("s")).groupBy("node").agg(F.min("s").alias("s")), "texts")

    # among those, pieces that fewest lines have
    full = texts.select("node", "s", n.alias("n"), letter_counts(F.col("s")).alias("letters"))
    pieces = scratch.save(rest_pieces(shared.join(full, "node"), edits), "pieces")
    often = pieces.filter("own").groupBy("rest").agg(F.count("*").alias("often"))
    rarest = F.row_number().over(W.partitionBy("node", "key").orderBy("often", "piece"))
    index = scratch.save(pieces.filter("own").join(often, "rest").withColumn("rank", rarest).filter("rank <= k + 1").select("rest", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("letters").alias("vl"), "k"), "index")
    look = pieces.select(F.col("rest").alias("r"), F.col("node").alias("u"), F.col("n").alias("un"), F.col("letters").alias("ul"))
    order = (F.col("un") > F.col("vn")) | ((F.col("un") == F.col("vn")) & (F.col("u") > F.col("v")))
    near = (F.col("un") - F.col("vn") <= F.col("k")) & (counts_apart(F.col("ul"), F.col("vl")) <= 2 * F.col("k"))
    pairs = scratch.save(look.join(index, (F.col("r") == F.col("rest")) & order & near).select("u", "v", "k").distinct(), "pairs")
    chars = lambda c: F.regexp_extract_all(f"{c}s", F.lit("(?s)."), F.lit(0)).alias(f"{c}c")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("s").alias("us")), "u").join(texts.select(F.col("node").alias("v"), F.col("s").alias("vs")), "v")
    same = F.lit(False)
    for k in range(1, edits + 1):
        same = F.when(F.col("k") == k, within(F.col("uc"), F.col("vc"), k)).otherwise(same)
    links = scratch.save(both.select("u", "v", "k", chars("u"), chars("v")).filter(same).select("u", "v"), "links")

    classes = components(links, scratch, "classes")
    degree = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("node", "digest", "place").join(classes, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    told = scratch.save(placed.join(first, "component").select("digest", "first", F.coalesce("n_links", F.lit(0)).alias("n_links")), "told")
    scratch.only("told")
    each = split_lines(docs, least=least).select("doc_id", "text_key", "line", n.cast("long").alias("n_chars"), digest)
    here = F.struct("doc_id", "text_key", "line")
    return each.join(told, "digest").select("doc_id", "text_key", "line", "n_chars", F.col("first.doc_id").alias("class_doc"), F.col("first.line").alias("class_line"), "n_links", here.eqNullSafe(F.col("first")).alias("kept"))


def without_repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that are not the first of their class, with its columns.

    n_chars, if the documents have it, follows the new text. A document that had words
    and loses them all goes; documents that had none stay as they are.
    """
    names = docs.columns
    drops = near_lines(docs, edits, least).filter(~F.col("kept")).groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).agg(F.collect_set("line").alias("__lines"))
    rows = docs.withColumn("__k", F.xxhash64("text")).join(drops.hint("merge"), (F.col("__k") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    # copies of a line drop out of one text only if they are in its list; a set of places is as long as the text at most
    left = F.filter(F.split("text", "\n", -1), lambda s, i: ~F.array_contains(F.col("__lines"), i))
    rows = rows.withColumn("__text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    rows = rows.filter(F.col("__lines").isNull() | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("__text").alias("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("__lines").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return rows.select(*[new.get(c, F.col(f"`{c}`")) for c in names])


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    return near_lines(table(spark, sf_dir, "documents")).drop("text_key")


SQL = f"""
WITH RECURSIVE p AS (SELECT doc_id, i - 1 AS line, ls[i] AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(ls[i], '{HAS_WORD}') AND length(ls[i]) >= {LEAST}),
u AS (SELECT s, length(s) AS n, min({{'d': doc_id, 'l': line}}) AS place FROM p GROUP BY s),
links AS (SELECT a.s AS x, b.s AS y FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + {EDITS} AND (a.n < b.n OR a.s < b.s) WHERE levenshtein(a.s, b.s) <= least(a.n // {A_STEP}, {EDITS})),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, x AS y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
class AS (SELECT reach.x AS s, min(u.place) AS first FROM reach JOIN u ON u.s = reach.y GROUP BY reach.x),
degree AS (SELECT x AS s, count(*) AS k FROM edges GROUP BY x)
SELECT doc_id, line::INT AS line, length(s)::BIGINT AS n_chars, coalesce(first, place).d AS class_doc, (coalesce(first, place).l)::INT AS class_line, coalesce(k, 0)::BIGINT AS n_links, (coalesce(first, place).d = doc_id AND coalesce(first, place).l = line) AS kept
FROM p JOIN u USING (s) LEFT JOIN class USING (s) LEFT JOIN degree USING (s)"""
