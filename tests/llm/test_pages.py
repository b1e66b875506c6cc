"""Page operators: main text and URL verdicts."""

from __future__ import annotations

from loomtext.llm import html_extract as H
from loomtext.llm import url_filter as U

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body class="page-12">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content" class="post-17 entry"><h1>Head &amp; shoulders</h1><p>First <b>bold</b> para&shy;graph
 over lines, with a good deal of text so that it wins.<br>Next line&nbsp;here.<p>Second one is unclosed and long enough to count as well.
<form><input value="x">Subscribe</form><div class="ad">Buy!</div><ul><li>point one</li><li>point two</li></ul><script>if (a<b) {}</script><!-- <p>no</p> --></div>
<div class="comments"><p>A reader comment that is long, long, long, long, long and rather full of words.</p></div><aside>side</aside><footer>&copy; foot</footer></body></html>"""
TEXT = "Head & shoulders\nFirst bold para\xadgraph over lines, with a good deal of text so that it wins. Next line here.\nSecond one is unclosed and long enough to count as well.\npoint one\npoint two"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, paths string, host int, text string")


def test_extraction(spark):
    short = PAGE.replace("First", "1st")
    cut = PAGE[: PAGE.index("point two") + 5]
    rows = [(1, "http://a.org/x", PAGE), (2, "http://a.org/y", short), (3, "http://A.org", None), (4, None, ""), (5, "nonsense", "plain text &am"), (6, "http://a.org/z", cut), (6, "http://a.org/z", cut), (None, "http://b.org", "<p>x</p>")]
    out = {(r.page_id, r.url): r for r in H.extracted(pages(spark, [(*r, "p", 1, "t") for r in rows])).collect()}
    assert len(out) == 7 and H.extracted(pages(spark, [(*r, "p", 1, "t") for r in rows])).count() == 8
    assert out[1, "http://a.org/x"].text == TEXT and out[2, "http://a.org/y"].text == TEXT.replace("First", "1st")
    assert out[6, "http://a.org/z"].text == TEXT.removesuffix(" two")
    assert [out[k].text for k in ((3, "http://A.org"), (4, None), (5, "nonsense"), (None, "http://b.org"))] == ["", "", "plain text &am", "x"]
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert H.extracted(pages(spark, [])).count() == 0


def test_consensus_beats_a_page(spark):
    """A page whose loudest container is not the article follows its host."""
    odd = "<body><div class=main><p>short article text of this page</p></div><div class=more><p>" + "louder words beside it " * 20 + "</p></div></body>"
    usual = "<body><div class=main><p>" + "an article as articles are, with many words " * 20 + "</p></div><div class=more><p>more</p></div></body>"
    rows = [(k, "http://h.net/", usual, "p", 1, "t") for k in range(5)] + [(9, "http://h.net/9", odd, "p", 1, "t")]
    for share in (1 / 1000, 1.0):  # the host hot, and not
        assert {r.page_id: r.text for r in H.extracted(pages(spark, rows), hot_share=share).collect()}[9] == "short article text of this page"


def test_urls(spark):
    urls = [
        "http://a.com/en/1", "http://example.com/en/7x", "http://x.net/de/1", "https://m.example.net/de/81?a", "http://q.org/es/", "http://casino-win.com/", "http://x.com/a?casino", "http://cheap-pills.io/x", "http://freebets.io/",
        "http://Ads.track.io", "http://bets.io/bets", None, "", "no scheme", "://", "http://A.B/C?d#e", "http://x.de/xxxx", "ftp://a\nb.com/en/",
    ]
    rows = U.judge(pages(spark, [(k, u, None, "p", 1, "t") for k, u in enumerate(urls)])).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"),
        (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block"),
    ]
    assert [(r.host, r.path) for r in rows][11:16] == [("", "")] * 4 + [("a.b", "/C")]
    assert U.judge(pages(spark, [])).count() == 0


def test_articles_of_the_table(spark):
    """On pages whose article is marked as such, the text is that of its headings and paragraphs, taken here by another way."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>?", "", p.replace("<br>", " ")))).strip() for p in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in H.extracted(table).collect()} == want


def whole(page: str) -> list[str]:
    """Blocks of a page that is alone on its host."""
    found = H.blocks(page)
    return H.within(found, [p[0]] if (p := H.best(found)) else []).split("\n")


def test_nested_articles_are_whole():
    """The title and parts of an article beside its loudest inner container are kept."""
    long, short = "many words of a section " * 20, "few words of a part"
    for inner in (
        f"<h1>T</h1><p>intro</p><section><p>{long}</p></section><section><p>{long}</p></section>",
        f"<h1>T</h1><div class=body><p>{long}</p></div>",
        f"<h1>T</h1><p>{short}</p><ul><li>{long}</li><li>{long}</li></ul><p>{short}</p>",
        f"<h1>T</h1><section class=a><p>{short}</p></section><section class=b><div class=c><p>{long}</p></div></section>",
    ):
        want = [x.strip() for x in inner.replace("</", "<").split("<") for x in [x.partition(">")[2]] if x.strip()]
        for tag in ("article", "main", "div class=post"):
            page = f"<body><nav>menu</nav><{tag}>{inner}</{tag.split()[0]}><footer>foot</footer></body>"
            assert whole(page) == want, (tag, inner[:40])
    outer = f"<main><h1>T</h1><article><p>{short}</p></article><article class=b><p>{long}</p></article></main>"
    assert whole(f"<body>{outer}<div>x</div></body>") == ["T", short, long.strip()]
    assert whole(f"<body><div class=post><h2>T</h2><div class=body><p>{long}</p></div></div><div class=more><p>more</p></div></body>") == ["T", long.strip()]
    assert whole(f"<body><div class=head><h1>T</h1></div><div class=body><p>{long}</p></div></body>") == ["T", long.strip()]


def test_skipped_elements_do_not_cut_the_page():
    """Names that begin like a skipped element's, and skipped elements without an end tag."""
    long = "many words of an article " * 20
    page = f"<body><article><h1>T</h1>%s<p>{long}</p><p>end</p></article></body>"
    want = ["T", long.strip(), "end"]
    for x in ("<svg-icon name=a></svg-icon>", "<video-js></video-js>", "<button-group></button-group>", "<title-bar></title-bar>", "<script-x></script-x>"):
        assert whole(page % x) == want, x
    for x in ("<svg><title>t</title><path d=''/></svg>", "<button>Share</button>", "<select><option>a<option>b</select>", "<noscript><div><p>no</p></div></noscript>", "<video src=x><p>no</p></video>"):
        assert whole(page % x) == want, x
    for x in ("button", "object", "select", "canvas", "video", "math"):
        for at in (f"<div><{x}></div>", f"<{x}>"):
            assert whole(page % at) == want, at
    assert whole(page % "<div><button></div>" + "<button>x</button>")[:3] == want
    assert whole(page.replace("many", "m<svg><text>x</text></svg>any", 1) % "") == want
    assert whole("<body><p>a</p><script>var x = '<p>b</p>'") == ["a"]


def test_layout_names_do_not_drop_the_article():
    """Words of a wrapper's class or id that name boilerplate in passing, and wrappers that hold the article."""
    long = "many words of an article " * 20
    inner = f"<h1>T</h1><p>{long}</p>"
    want = ["T", long.strip()]
    for wrapper in ('div class="content with-sidebar"', 'div id="page" class="no-sidebar"', 'div class="layout fixed-header"', 'div class="header-fixed"', "div class=sidebar", "form id=all", "section id=social"):
        for held in (f"<article>{inner}</article>", inner):
            page = f"<body><nav><p>menu</p></nav><{wrapper}>{held}<div class='ad'>Buy</div></{wrapper.split()[0]}><footer>foot</footer></body>"
            assert whole(page) == want, (wrapper, held[:9])
        assert whole(f"<body><{wrapper}><p>{long}</p></{wrapper.split()[0]}><div class=comments><p>short</p></div></body>") == want[1:], wrapper
    assert whole(f"<article><header class='entry-header'><h1>T</h1></header><p>{long}</p></article>") == want
    assert whole(f"<article><header class='header'><h2>T</h2></header><p>{long}</p></article>") == want
    # What is around an article still goes.
    assert whole(f"<body><div class=site-header><p>other text</p></div>{inner}</body>") == want
    for x in ("div class=cookie-notice", "aside", "div class='box sidebar'", "div class=main-sidebar", "div id=comments-area", "div class='related-posts x'"):
        assert whole(f"<body><main>{inner}<{x}><p>other text</p></{x.split()[0]}></main></body>") == want, x
    talk = f"<div class=comments><article class=comment-body><p>{long}{long}</p></article></div>"
    assert whole(f"<body><div class=post>{inner}</div>{talk}</body>") == want
    assert whole(f"<body><article>{inner}</article><aside><p>{long}{long}</p></aside></body>") == want
