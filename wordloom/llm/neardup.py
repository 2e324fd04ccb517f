"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct five-word shingles. ``BITS`` bits of each of some MinHash
values make its signature; a bit of two documents differs with probability (1 -
similarity) / 2. Signatures are cut into chunks of ``width`` bits. If two differ in at
most ``distance`` = chunks * r + a bits, then one of the first a + 1 chunks differs in at
most r bits or one of the others in at most r - 1 (pigeonhole); so every chunk is
indexed, and the values within r errors of the first a + 1 chunks (r - 1 of the others)
are enumerated and looked up. That finds all pairs up to ``distance`` bits, and all that
differ in fewer MinHash values than there are chunks. A pair just at the similarity
asked for usually lies beyond; ``layout`` takes as many chunks as miss it less than once
in 1 / ``MISS`` times, and chunks as wide as the number of documents asks for, so that a
bucket holds few strangers at any size. Candidates are confirmed on the full sets.

Equal sets collapse into one node before anything else. Buckets don't expand into pairs.
First each node is compared with one other: of its buckets' members that with the most
company. Confirmed links are joined into components. Buckets that still hold several
components go on: their nodes' rarest shingles, one more than a similar set can lack,
bring the nodes together that can be linked (prefix filter), without losing a link.
Again each node is compared with one other first; then the pairs that are in different
components, whose shingles' places leave room for the overlap and whose signatures are
near enough. The same is done with buckets of any size, and none is cut short.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, arrow_columns, keyed, renamed_clashes, table, without
from .graph import components

SHINGLE, PERCENT = 5, 85
#: Bits of a signature from each MinHash value.
BITS, SEED = 4, 7
#: How often a pair just at the threshold may share no chunk.
MISS = 1e-5
#: Bits of a chunk beyond the logarithm of the number of documents: a chunk meets a stranger once in 2 ** ROOM times.
ROOM = 10
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it has fewer words.

    A to Z are lower-cased and words are split at ASCII blanks, which is what
    bytes.lower and bytes.split do to UTF-8.
    """
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i : len(h) - k + 1 + i] + np.uint64(i))
    return np.unique(_mixed(acc ^ np.uint64(k)))


def layout(n: int, percent: int = PERCENT, miss: float = MISS) -> tuple[int, int]:
    """Chunks and their width for n documents: width follows log2(n), and chunks follow width."""
    values = math.ceil((math.log2(max(2, n)) + ROOM) / BITS)
    same = (percent / 100 + (1 - percent / 100) / (1 << BITS)) ** values
    return math.ceil(math.log(miss) / math.log1p(-same)) if same < 1 else 1, values * BITS


def hashers(values: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, values, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, values, np.uint32))


def signature(own: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each MinHash value, as an array of bits."""
    h, least = (own >> np.uint64(32)).astype(np.uint32), None
    step = 512
    for at in range(0, len(h), step):  # blocks that stay in the cache
        block = np.multiply.outer(multiply, h[at : at + step])
        block += add[:, None]
        low = block.min(1)
        least = low if least is None else np.minimum(least, low)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    least = (least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39)
    return ((least[:, None] >> np.arange(32 - BITS, 32, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).ravel()


def _in_a_word(width: int) -> int:
    """Chunks in a signed 64-bit number."""
    return max(1, min(3, 63 // width))


def _words(chunks: int, width: int) -> list[str]:
    return [f"s{i}" for i in range(-(-chunks // _in_a_word(width)))]


def signed(docs: DataFrame, chunks: int, width: int, keep: list[str]) -> DataFrame:
    """``keep`` with n_shingles, set_key (a 128-bit digest of the set) and the signature in words s0, s1, ..."""
    names, (multiply, add) = _words(chunks, width), hashers(-(-chunks * width // BITS))
    weights = 1 << np.arange(width * _in_a_word(width), dtype=np.int64)
    bits_in_all = len(names) * len(weights)

    def run(texts):
        from xxhash import xxh3_128_digest

        n, keys, sigs = [], [], [[] for _ in names]
        for text in texts:
            own = shingle_set(text)
            n.append(len(own))
            keys.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
            bits = np.zeros(bits_in_all, np.int64)
            if len(own):
                bits[: chunks * width] = signature(own, multiply, add)[: chunks * width]
            for column, word in zip(sigs, (bits.reshape(len(names), -1) * weights).sum(1).tolist(), strict=True):
                column.append(word)
        return [n, keys, *sigs]

    return arrow_columns(docs, ["text"], ", ".join(["n_shingles bigint", "set_key binary", *(f"{w} bigint" for w in names)]), run, keep)


def _chunk(i: int, width: int):
    per = _in_a_word(width)
    return F.shiftrightunsigned(F.col(f"s{i // per}"), i % per * width).bitwiseAND((1 << width) - 1)


def errors(width: int, most: int) -> list[int]:
    """Bit masks of 1 to ``most`` errors in a chunk."""
    return [sum(1 << b for b in own) for k in range(1, most + 1) for own in combinations(range(width), k)]


def _keys(chunks: int, width: int, distance: int | None) -> list:
    """The own value of each chunk, or, with ``distance``, what is enumerated around it."""
    if distance is None:
        return [F.lit(i << width).bitwiseOR(_chunk(i, width)) for i in range(chunks)]
    r, a = divmod(distance, chunks)
    return [F.lit(i << width).bitwiseOR(_chunk(i, width).bitwiseXOR(F.lit(mask))) for i in range(chunks) for mask in errors(width, r if i <= a else r - 1)]


def bucket_rows(nodes: DataFrame, carry: list, chunks: int, width: int, distance: int | None) -> DataFrame:
    """key and ``carry`` for each chunk; with ``distance`` for each enumerated value of it too."""
    keys = _keys(chunks, width, None) + ([] if distance is None else _keys(chunks, width, distance))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), *carry)


def loosest(bits: int, percent: int) -> int:
    """Differing bits that a pair at the threshold exceeds less than once in 200,000 times; bits of one value differ together."""
    q = 1 - percent / 100
    return math.ceil(bits * q / 2 + 4.5 * math.sqrt(bits / BITS * (q * BITS * (BITS + 1) / 4 - (BITS * q / 2) ** 2)))


def shared_buckets(nodes: DataFrame, chunks: int, width: int, distance: int) -> DataFrame:
    """key, node, n (nodes in the bucket) for the buckets of two nodes or more of which one is indexed there.

    Counted with partial sums and joined back, so that a large bucket can be split.
    """
    places = bucket_rows(nodes, ["node"], chunks, width, None).withColumn("own", F.lit(True))
    if around := _keys(chunks, width, distance):
        places = places.unionByName(nodes.select(F.explode(F.array(*around)).alias("key"), "node", F.lit(False).alias("own")))
    many = places.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("indexed")).filter("n > 1 and indexed").select("key", "n")
    return places.join(many, "key").select("key", "node", "n")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the wanted nodes."""
    found = nodes.select("node", "rep_doc", "text_key").join(wanted, "node", "left_semi")
    return docs.select(F.col("doc_id").alias("d"), "text", F.md5("text").alias("t")).join(found.hint("merge"), (F.col("t") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("rep_doc"))).select("node", "text").dropDuplicates(["node"])


def rare_shingles(texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, shingle, n (of the set), place (from 1): of each set the rarest, one more than a similar set can lack; ties go by hash.

    Shingles that no other set has come first and count for the places, but bring nobody
    together and are left out. Occurrences are counted with partial sums and joined back,
    so that a common shingle can be split.
    """
    run = lambda rows: [[shingle_set(t).astype(np.int64) for t in rows]]
    sets = scratch.save(arrow_columns(texts, ["text"], "shingles array<bigint>", run, ["node"]), "sets")
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    of_node = W.partitionBy("node")
    ranked = each.join(often, "shingle").withColumn("place", F.row_number().over(of_node.orderBy("often", "shingle")) + F.col("n") - F.count("*").over(of_node))
    return ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("node", "shingle", "n", "place")


#: Sets that a task keeps while it confirms pairs.
KEPT = 256


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")

    def run(us, u_texts, vs, v_texts):
        out, known = [], {}

        def of(node, text):
            if node not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[node] = shingle_set(text)
            return known[node]

        for u, a, v, b in zip(us, u_texts, vs, v_texts, strict=True):
            own, other = of(u, a), of(v, b)
            both = len(np.intersect1d(own, other, assume_unique=True))
            out.append(100 * both >= percent * (len(own) + len(other) - both))
        return [out]

    return arrow_columns(both, ["u", "u_text", "v", "v_text"], "linked boolean", run, ["u", "v"]).filter("linked").select("u", "v")


def _distance(names: list[str], a: str = "", b: str = ""):
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in names[1:]), F.bit_count(F.col(f"{a}{names[0]}").bitwiseXOR(F.col(f"{b}{names[0]}"))))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, percent: int = PERCENT, chunks: int | None = None, width: int | None = None, distance: int | None = None) -> DataFrame:
    """Every row with n_shingles, component_id and kept.

    component_id is the smallest doc_id that links reach; kept says that it is the
    row's own. Needs doc_id and text. Rows without words are linked with nothing
    and kept. Null doc_ids join components too; where a component has no other id,
    component_id is null and its rows are kept. Rows that repeat a doc_id are all
    kept or not. Columns of the input whose names clash come back as ``<name>_in``.
    ``chunks`` and ``width`` follow the number of rows, if not given, and ``distance`` the chunks.
    """
    if chunks is None or width is None:
        chunks, width = layout(docs.count(), percent)
    distance = chunks if distance is None else distance
    names = _words(chunks, width)
    docs = renamed_clashes(docs, ["n_shingles", "set_key", "component_id", "kept", "text_key", "node", "component", *names], [])
    keep = docs.columns if keep is None else keep
    light = list(dict.fromkeys([*keep, "doc_id"]))
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = scratch.save(signed(docs.withColumn("text_key", F.md5("text")), chunks, width, [*light, "text_key"]), "rows")
    # one node for each distinct set; rep_doc and text_key name one of its rows
    nodes = rows.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least_doc"), *[F.min(w).alias(w) for w in names])
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.text_key").alias("text_key"), "least_doc", *names), "nodes")
    loose = max(loosest(chunks * width, percent), distance)
    apart = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))

    # each node against one other: of all its buckets' members that with the most company
    shared = scratch.save(shared_buckets(nodes, chunks, width, distance), "shared")
    met = scratch.save(shared.groupBy("node").agg(F.sum("n").alias("met")), "met")
    signs = scratch.save(nodes.join(met, "node").select("node", "met", *names), "signs")
    sig = lambda c: signs.select(F.col("node").alias(c), *[F.col(w).alias(f"{c}{w}") for w in names])
    close = lambda pairs: pairs.join(sig("u"), "u").join(sig("v"), "v").filter(_distance(names, "u", "v") <= loose).select("u", "v")
    hubs = scratch.save(shared.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub")), "hubs")  # written, so that a large bucket's join can be split
    best = shared.join(hubs, "key").groupBy("node").agg(F.max("hub")["node"].alias("hub")).filter("node <> hub")
    tried = scratch.save(close(best.select(*apart("node", "hub")).distinct()), "stars")
    texts = scratch.save(texts_of(met.select("node"), nodes, docs), "texts", compression="zstd")
    links = scratch.save(_confirmed(tried, texts, percent), "links")
    joined = components(links, scratch, "first")

    # nodes of buckets with several components, by their rarest shingles
    placed = lambda joined: signs.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    at = scratch.save(placed(joined).select("node", "c"), "at")
    mixed = shared.select("key", "node").join(at, "node").groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    live = scratch.save(shared.select("key", "node").join(mixed.select("key"), "key", "left_semi").select("node").distinct(), "live")
    shingles = scratch.save(rare_shingles(texts.join(live, "node", "left_semi"), percent, scratch), "rare")

    # with the shingle the first that two share, what follows it on either side must be able to make the overlap
    def reach(a: str, b: str):
        overlap = F.ceil((F.col(f"{a}n") + F.col(f"{b}n")) * percent / (100 + percent))
        return (F.col(f"{a}n") - F.col(f"{a}place") + 1 >= overlap) & (F.col(f"{b}n") - F.col(f"{b}place") + 1 >= overlap)

    rare = shingles.join(placed(joined).select("node", "c", "met"), "node")
    hubs = rare.groupBy("shingle").agg(F.max(F.struct("met", "node", "c", "n", "place")).alias("h"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    hubs = scratch.save(hubs.select("shingle", F.col("h.met").alias("hmet"), F.col("h.node").alias("hub"), F.col("h.c").alias("hc"), F.col("h.n").alias("hn"), F.col("h.place").alias("hplace")), "rare_hubs")
    best = rare.join(hubs, (rare["shingle"] == hubs["shingle"]) & (F.col("c") != F.col("hc")) & reach("", "h")).groupBy("node").agg(F.max(F.struct("hmet", "hub"))["hub"].alias("hub"))
    stars = scratch.save(close(best.select(*apart("node", "hub")).distinct()).join(tried, ["u", "v"], "left_anti"), "rare_stars")
    links = scratch.save(links.unionByName(_confirmed(stars, texts, percent)), "rare_links")
    joined = components(links, scratch, "again")

    # every pair that is left
    rare = shingles.join(placed(joined), "node")
    split = rare.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("shingle")
    rare = scratch.save(rare.join(split, "shingle", "left_semi"), "split")
    side = lambda c: rare.select("shingle", *[F.col(x).alias(f"{c}{x}") for x in ("node", "c", "n", "place", *names)])
    u, v = side("u"), side("v")
    pairs = u.join(v, (u["shingle"] == v["shingle"]) & (F.col("uc") != F.col("vc")) & (F.col("unode") > F.col("vnode")) & reach("u", "v") & (_distance(names, "u", "v") <= loose))
    left = pairs.select(F.col("unode").alias("u"), F.col("vnode").alias("v")).distinct().join(tried.unionByName(stars), ["u", "v"], "left_anti")
    more = scratch.save(_confirmed(scratch.save(left, "apart"), texts, percent), "more")
    merged = components(links.unionByName(more), scratch, "second")

    member = nodes.join(merged, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), "least_doc")
    least = member.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    member = member.join(least, "component").select("set_key", "component_id")
    out = rows.select(*[F.col(f"`{c}`") for c in light], "n_shingles", "set_key").join(scratch.save(member, "member"), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = scratch.save(out.select(*[F.col(f"`{c}`") for c in keep], "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull()).alias("kept")), "out")
    scratch.only("out")
    return out


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id. Texts don't move but for the last join."""
    return without(docs, near_duplicates(keyed(docs), ["doc_id", "doc_key"], percent).filter(~F.col("kept")))


def op9_near_duplicates(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, ["doc_id"]).select("doc_id", "n_shingles", "component_id", "kept")


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
comp AS (SELECT reach.x AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (rid) JOIN comp USING (rid)"""
