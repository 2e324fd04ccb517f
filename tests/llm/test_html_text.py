import itertools
import random
import re

from wordloom.llm import html_text as h


def cost(gain, links, label):
    return sum(abs(g) for g, x in zip(gain, label) if (g > 0) != x) + sum(w for a, b, w in links if label[a] != label[b])


def test_min_cut_is_the_best_labelling():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(0, 14))]
        best = min(cost(gain, links, x) for x in itertools.product((True, False), repeat=n))
        assert abs(cost(gain, links, h.min_cut(gain, links)) - best) < 1e-9


def test_held_out_pages():
    w = h.fit(*h.training([]))
    rng, right, extra, missed = random.Random(99), 0, 0, 0
    for _ in range(200):
        page, own = h.made_page(rng)
        got = {b.text for b in h.main_blocks(page, w.tolist())}
        right, extra, missed = right + len(got & own), extra + len(got - own), missed + len(own - got)
    assert right / (right + extra) > 0.97 and right / (right + missed) > 0.97


def test_query_takes_the_articles(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = h.op8_html_text(spark, d).collect()
    assert len(rows) == len(pages)
    good = 0
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        want = "\n\n".join(b.text for b in h.blocks(article[1]))
        good += r["text"] == want
        assert r["n_chars"] == len(r["text"]) and not re.search(r"©|track\(|margin:0", r["text"])
    assert good >= 0.99 * len(rows)


def test_markup():
    page = "<p>a<br>b &amp; c&nbsp;d<p>e <b>f</b>\n g<!-- x > y --><script>if (a<b) '</p>'</script><td title='x>y'>h</td>< 5 <a href=\"q>r\">i</a>"
    assert [b.text for b in h.blocks(page)] == ["a b & c d", "e f g", "h", "< 5 i"] or [b.text for b in h.blocks(page)] == ["a b & c d", "e f g", "h< 5 i"]
    assert [b.text for b in h.blocks("<p>open <div")] == ["open"] and h.blocks(None) == [] and h.blocks("<!-- never ends") == []
    for slow in ("<" * 100000, "<a " * 50000, '<a b="' * 30000, "<!--" * 50000, "<p>" * 20000 + "x"):
        h.blocks(slow)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "y"), (None, "u", "<p>" + "word " * 40000, "z"), (2, "u", "<article><h1>T</h1><p>One two three. Four five.</p></article><nav><a>m</a></nav>", "w")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and {r["text_in"] for r in got} == set("xyzw")
    assert [r["text"] for r in got][:2] == ["", ""] and got[3]["text"] == "T\n\nOne two three. Four five."
    assert h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def texts(page):
    return [b.text for b in h.blocks(page)]


def test_a_head_ends_where_something_else_begins():
    for start in ("<body>", "<body><p>", "<div>", "<p>", ""):
        assert texts(f"<html><head><meta charset=utf-8><title>no</title><script>no</script>{start}one</html>") == ["one"], start
    assert texts("<head><template><p>no</p></template><noscript>no</noscript><link rel=x></head><body>one") == ["one"]


def test_stray_quotes_end_with_their_tag():
    for tag in ('p class="x""', "p title=it's", 'p "', "p class=x'y\"", 'p a="1"b', "p = '", "p a='>' b=\">\"", "p a = \">\""):
        assert texts(f"<p>one</p><{tag}>two</p><p>three</p>") == ["one", "two", "three"], tag
        assert texts(f"<p>one</p><{tag}>two's</p><p>three</p>")[1:] == ["two's", "three"], tag
    assert texts('<p>one</p><p class="x>two</p><p>three</p>') == ["one", "two", "three"]
    assert texts("<p>one</p><p class=x two") == ["one"]
