import re

import pyarrow.parquet as pq

from lodestrata.llm.html import extract_text, main_text, op3_html


def test_whole_table_keeps_article_and_leaves_the_rest(spark, sf_dir):
    import html as ents

    t = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    pages = dict(zip(t["page_id"], t["html"], strict=True))
    got = {r.page_id: r for r in op3_html(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        article = re.sub(r"<[^>]*$", "", article)
        want = " ".join(ents.unescape(re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?b>", m[0]) else " ", article)).split())
        assert got[i].text == want and got[i].n_chars == len(want)


def test_boilerplate_goes():
    page = """<html><head><title>T</title><style>x</style></head><body class="with-sidebar"><header>Site</header><div class="cookie-notice">We use cookies on this site a lot.</div>
    <nav><a href=1>Home</a></nav><div id="page-sidebar-wrapper"><main><article class="post"><header><h1>Head &amp; line</h1></header><p>First  para.<p>Tiny.<form>f</form>
    <div class="ad-slot">Buy now, buy a great many things today</div><blockquote>Quoted &#233;</blockquote><script>var a = "<p>no</p>";</script></article>
    <section id="comments"><p>A reader says very many words about this article here.</p></section></main></div><aside>More</aside><footer>&copy; foot</footer></body></html>"""
    assert main_text(page) == "Head & line First para. Tiny. Quoted é"


def test_pages_without_an_article_element():
    long = "Plenty of running words make up this paragraph of the text. " * 4
    page = f"<body><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul><div id=content><p>{long}<p>Short.<p>{long}</div><div><a href=3>last</a></div></body>"
    assert main_text(page) == " ".join(f"{long} Short. {long}".split())


LONG = "Plenty of running words make up this paragraph of the text. " * 4


def test_the_ratios_choose_where_no_element_tells():
    """The pages with all telling elements and names made plain ones: the clusters find the text, ratios turned upside down find less of it."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    want = [main_text(p) for p in pages]
    bare = []
    for p in pages:
        for tag in ("article", "nav", "footer"):
            p = p.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
        bare.append(p.replace('class="ad"', 'class="x1"'))
    good = sum(main_text(p) == w for p, w in zip(bare, want, strict=True))
    upside_down = sum(main_text(p, ratios=lambda r: 1 / (1 + r)) == w for p, w in zip(bare, want, strict=True))
    assert good >= 0.85 * len(pages) and upside_down < good - 0.03 * len(pages)


def test_names_that_only_sound_like_boilerplate():
    flat = " ".join(LONG.split())
    assert main_text(f'<body><nav>Home</nav><div class="share-page"><p>{LONG}</div></body>') == flat
    assert main_text(f'<article><p>{LONG}<div class="search-results-discussion"><p>On search {LONG}</div></article>') == f"{flat} On search {flat}"
    assert main_text(f'<div class="page-with-sidebar has-widget"><form action=x><article><p>{LONG}</article></form></div>') == flat
    assert main_text(f'<body class="ad"><div id="header"><div class="notice"><p>{LONG}</div></div></body>') == flat  # most of the page's text is there
    assert main_text(f'<article><p>{LONG}<p class="lead comment">{LONG}</article>') == f"{flat} {flat}"


def test_without_semantic_elements():
    flat = " ".join(LONG.split())
    two = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div class=row><div class=c1><div class=in><p>{LONG}<p>{LONG}<p>{LONG}</div></div><div class=c2><div class=in><p>{LONG}<p>{LONG}</div></div></div></body>"
    assert main_text(two) == " ".join([flat] * 5)
    heads = f"<body><div id=story><h1>Head</h1><p>{LONG}<p>Mid.<p>{LONG}<p>See <a href=3>this long link</a><p>End.</div><div><a href=4>x</a><a href=5>y</a></div></body>"
    assert main_text(heads) == f"Head {flat} Mid. {flat} See this long link End."
    small = f"<body><div class=top>Short offer of today for all of you</div><div><p>{LONG}<p>{LONG}</div><section id=comments><p>{LONG}</section></body>"
    assert main_text(small) == f"{flat} {flat}"
    assert main_text(f"<form><p>{LONG}</form>") == flat
    assert main_text("<body><p>Only a word</p></body>") == "Only a word"


def test_nulls_broken_and_long_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>just text"), (4, "u", "<article><p>cut &amp; off <b"), (5, "u", "<article>" + "<p>word " * 30_000), (5, "u", "plain"), (6, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in extract_text(df).collect())
    assert got == [(0, "just text", 9), (1, "", 0), (2, "", 0), (4, "cut & off", 9), (5, "plain", 5), (5, "word word word word ", 149_999), (6, "deep", 4)]
    assert extract_text(df.limit(0)).count() == 0
