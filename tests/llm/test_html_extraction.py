import html
import re

from brindle.llm.html_extraction import Piece, Weights, best_region, extract, extract_pages, tokens, train_weights, weights_from
from brindle.llm.queries import op1_html_extraction, table

SF = "/root/testdata/sf0.001"


def brute(page):
    inner = re.split(r"</article>|<footer", page[page.index("<article>") + 9 :])[0]
    parts = re.split(r"</?p>|</?h1>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_pages_equal_a_direct_cut(spark):
    got = {r["page_id"]: r for r in op1_html_extraction(spark, SF).collect()}
    for p in table(spark, SF, "pages").collect():
        expected = brute(p["html"])
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (expected, len(expected), p["url"])


def test_scan_finds_the_best_run():
    import random

    rng = random.Random(7)
    for _ in range(100):
        values = [rng.randrange(-4, 4) for _ in range(rng.randrange(1, 12))]
        weights = Weights({f"k{v}": float(v) for v in range(-4, 4)})
        a, b = best_region([Piece(f"k{v}", 1) for v in values], weights)
        best = max(sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1))
        assert sum(values[a:b]) == best


PAGE = """<html><head><title>T</title><script>var a = "</p><p>not text";</script><style>p{}</style></head><body class="header">
<header><a href="/">Home</a></header><nav><ul><li>Menu one<li>Menu two</ul></nav><div class="cookie-notice">We use cookies on this site</div>
<div id="main"><div class="post"><h2>Title &amp; more</h2><p>First   paragraph with <b>bold</b>\n and <a href="x">a link</a> in it, long enough to count.
<p>Second &lt;one&gt;&nbsp;has &eacute;&#233;&#xe9; entities and five more words here.<br>After a break
<div class="ad">Buy now</div><aside>Side words that do not belong</aside><form><input value="x">Your mail</form>
<blockquote>Quoted words are content as well as the rest.</blockquote><p>Last one.</p></div>
<section class="comments"><p>First! I comment here with many words to read and score.</p></section></div>
<footer>Copyright words &copy;</footer></body></html>"""
EXPECTED = "Title & more\nFirst paragraph with bold and a link in it, long enough to count.\nSecond <one> has ééé entities and five more words here. After a break\nQuoted words are content as well as the rest.\nLast one."


def test_page_without_article_by_priors():
    assert extract(PAGE, Weights()) == EXPECTED


def test_nested_comments_and_article_headers():
    page = """<main><article class="post"><header class="post-header"><h1>Head line</h1></header><p>Body words go here and on.</p>
    <article class="comment"><p>Reader words, many of them, more than the body has, to be left out.</p></article><ol class=commentlist><li>And a reply</ol></article></main>
    <div class="page-header">Site words</div>"""
    assert extract(page, Weights()) == "Head line\nBody words go here and on."
    soup = """<div class="header">Site name and slogan</div><div class="entry-header"><h1>Head line</h1></div><div>Body words go here and on.</div>"""
    assert extract(soup, Weights()) == "Head line\nBody words go here and on."


def test_weights_come_from_labelled_pages(spark):
    weights = train_weights(table(spark, SF, "pages"))
    assert weights.of("w:p") > 0 > weights.of("w:noise") and weights.of("<li") < 0
    assert weights_from({}).of("w:p") == 1.0


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain text only", "<p>unclosed <b>tags <i>here", "<", "<p", "a < b and c > d", "<!-- only a comment", "<script>x", "<a title='x>y'>in</a> out", "<div>" * 3000 + "deep words here" + "</div>" * 3000, "<p>" + "word " * 200_000, "<article></article>", "&amp", "\x00<p>nul\x00 byte</p>"]
    df = spark.createDataFrame([(k, "u", x, "clash") for k, x in enumerate(odd)], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r["text"] for r in extract_pages(df, Weights()).collect()}
    assert [rows[k] for k in (0, 1, 2)] == ["", "", ""] and rows[3] == "plain text only" and rows[4] == "unclosed tags here"
    assert rows[8] == "" and rows[9] == "" and rows[11] == "deep words here" and rows[12] == " ".join(["word"] * 200_000) and rows[14] == "&"
    assert extract_pages(df.limit(0), Weights()).count() == 0 and train_weights(df.limit(0)).score == {}
    assert len(tokens("<p>a</p>")[0]) == 3


#: Ten and more ways that pages hold one article: where the marks go, which class words stand on it.
BODY = "<h1>Head line of it</h1><p>The first paragraph has a number of words to read.</p><div class='ad'>Buy this now</div><p>The second one has a few more of them, and ends.</p>"
TEXT = "Head line of it\nThe first paragraph has a number of words to read.\nThe second one has a few more of them, and ends."
SHELL = "<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/b>News</a></nav>{}<div class='sidebar'><p>Popular: one, two, three</p></div><section id='comments'><div class='comment'><p>I liked it a lot, a whole lot, as readers do.</p></div></section><footer>Copyright of all</footer></body></html>"
CLASSES = ["entry no-sidebar", "post comments-open", "content has-widgets", "single-post social-icons", "post ad-free", "article hidden-print", "post-content", "entryContent noAds", "story", "hentry post type-post with-sidebar", "main-column", ""]


def test_class_words_on_the_article_cost_no_text(spark):
    trained = train_weights(table(spark, SF, "pages"))
    for weights in (Weights(), trained):
        for words in CLASSES:
            for form in ('<article class="{}">{}</article>', '<div class="{}">{}</div>', '<main><div class="{}">{}</div></main>', '<div id="page"><article class="{}" itemprop="articleBody">{}</article></div>', '<table><tr><td class="{}">{}</td></tr></table>'):
                page = SHELL.format(form.format(words, BODY))
                assert extract(page, weights) == TEXT, (words, form)


def test_a_class_that_misleads_leaves_the_text():
    for words in ("sidebar-layout", "notice", "menu-page"):
        page = f"<html><body><div class='{words}'><p>All the words of this page stand here, and no others.</p></div><nav>Home</nav><div class='comments'><p>Nice one</p></div></body></html>"
        assert extract(page, Weights()) == "All the words of this page stand here, and no others."
    assert extract("<div class='comments'><p>Only what readers say, and they say much.</p></div>", Weights()) == ""


def test_weights_come_from_pages_that_mark_an_article(spark):
    plain = [(k, f"<html><body><div><p>words of page {k} without a mark</p></div></body></html>") for k in range(3000)]
    marked = [(5000 + k, f"<html><body><ul><li>menu {k}</ul><article><p>words of page {k} inside</p></article></body></html>") for k in range(5)]
    weights = train_weights(spark.createDataFrame(plain + marked, "page_id long, html string"), 100)
    assert weights.of("w:p") > 1.0 > 0 > weights.of("w:li")


def test_smallest_hashes_are_one_sample(spark):
    from pyspark.sql import functions as F

    from brindle.llm.sample import smallest

    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    df = df.unionAll(df.where("id < 40")).unionAll(spark.createDataFrame([(None, 1)], "id long, v long"))
    expected = sorted(r.id for r in df.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id")).limit(100).collect())
    for parts in (1, 7):
        assert sorted(r.id for r in smallest(df.repartition(parts), "id", 100).collect()) == expected
    assert smallest(df, "id", 10**6).count() == 5000 and smallest(df.limit(0), "id", 3).count() == 0
    hot = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, 0) for k in range(50)], "id long, v long")
    assert smallest(hot, "id", 20).count() == 20
