"""Main text and url verdicts of pages, against expected texts and plain Python."""

import itertools

from tallymark.llm.html_text import extract, main_text
from tallymark.llm.url_filter import SITE_RULES, UNWANTED, judge

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no, no</p>";</script><style>p { x: y }</style></head><body>
<header><a href="/">Site, name</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<article><h1>Head &amp; line</h1><p>First  paragraph, with <b>bold</b> and &eacute;&#33; words.</p><p>Second
 paragraph; more<br>text here.</p><div class="comments"><p>Reader says hello, at length, with many, many words.</p></div></article>
<aside>Side, text.</aside><form><p>Sign up, now.</p></form><div class="cookie-notice">We use cookies, a lot.</div><footer>Footer, 2020.</footer></body></html>"""
TEXT = "Head & line\nFirst paragraph, with bold and é! words.\nSecond paragraph; more text here."


def test_article_without_its_surroundings():
    assert main_text(PAGE) == TEXT


def test_page_without_an_article_element():
    body = "".join(f"<p>Paragraph {i}, one of several; it goes on for a while, as prose does.</p>" for i in range(4))
    page = f"<body><div class='menu'><a href='/'>Home</a></div><div id='story'>{body}</div><div class='sidebar'><p>Other, things.</p></div></body>"
    assert main_text(page).split("\n") == [f"Paragraph {i}, one of several; it goes on for a while, as prose does." for i in range(4)]


LONG = "Prose, which goes on for a while; it has points, as prose does, and then it ends. " * 5


def test_lists_tables_and_titles_without_an_article_element():
    lines = [f"{LONG}Number {i}." for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in lines)
    short = "<ul><li>One short entry</li><li>Another</li></ul><table><tr><td>Cell</td><td>7</td></tr></table><blockquote>Said</blockquote>"
    links = "<div><ul><li><a href='/a'>Elsewhere</a></li></ul></div>"
    page = f"<body><div id='story'><div><h1>Title</h1></div>{body}{short}</div>{links}</body>"
    assert main_text(page).split("\n") == ["Title", *lines, "One short entry", "Another", "Cell", "7", "Said"]
    # the same with the title beside the container, and with paragraphs that are containers
    page = f"<body><div><h1>Title</h1></div><div id='story'>{body.replace('<p', '<div').replace('/p>', '/div>')}{short}</div>{links}</body>"
    assert main_text(page).split("\n") == ["Title", *lines, "One short entry", "Another", "Cell", "7", "Said"]


def test_a_compound_class_does_not_take_most_of_the_text():
    for name in ("ad-free", "long-form", "social-history"):
        for inner in (f"<p>{LONG}</p>", f"<article><p>{LONG}</p></article>"):
            assert main_text(f"<body><div class='x {name}'>{inner}</div><div class='site-footer'><p>Foot, 2020.</p></div></body>") == LONG.strip()
    assert main_text(f"<body><div><p>{LONG}</p></div><div class='cookie-notice'><p>We use cookies, a lot.</p></div></body>") == LONG.strip()


def test_formulas_drawings_and_fallbacks_are_text():
    math = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math>"
    assert main_text(f"<article><p>So {math}, or <svg><title>no</title><path d='M0'/><text>drawn</text></svg>.</p></article>") == "So x=2, or drawn ."
    assert main_text("<p>See <object data='x'>the fallback</object>, here.</p>") == "See the fallback, here."
    assert main_text("<body><noscript><p>Only this, without scripts.</p></noscript></body>") == "Only this, without scripts."


def test_broken_and_blank_markup():
    assert main_text(None) == main_text("") == main_text(" <p> </p>\n") == ""
    assert main_text("<p>One, two.</i></p><!-- <p>gone</p>") == "One, two."
    assert main_text("<p>One, two.<script>gone") == "One, two."
    assert main_text("<p>One, &lt;b&gt; two.") == "One, <b> two."


def test_nothing_of_a_long_page_is_dropped():
    lines = [f"Line {i}, of the article." for i in range(5_000)]
    assert main_text("<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>").split("\n") == lines
    word = "a" * 1_000_000
    assert main_text(f"<article><p>{word}, b.</p></article>") == f"{word}, b."


def test_pages_table(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE, "x", 0), (1, "u", PAGE, "x", 0), (2, None, None, None, None), (None, "v", "", "", 1)]
    found = sorted(map(tuple, extract(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert found == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], kind)).collect() == []


def verdict(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule in SITE_RULES:
        own, _, start = rule.name.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule.name) > len(best.name)):
            best = rule
    if best:
        return host, path, best.name, best.verdict
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in host).split()
    return host, path, None, "block" if set(words) & set(UNWANTED) else "allow"


def test_urls_equal_plain_rules(spark):
    hosts = ["net", "example.net", "a.Example.NET", "badexample.net", "example.com", "x.example.com", "org", "fr.org", "orgs", "net.org", "ads.de", "loads.de", "a-xxx.example.com", "casino.net", "", "ünet", "ü.net"]
    paths = ["", "/", "/en", "/en/", "/EN/a", "/en/a?x=/de/", "/de/", "/de/x#y", "/fr/", "/fr/x", "?/en/", "#/fr/", "/a//fr/", "//en/"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + ["net/", "", None, "://net/", "a://b://net/", "http:/net/", "https://user@net/", "https://net:80/"]
    rows = [(i, u, "x", "y", "z") for i, u in enumerate([*urls, *urls[:5]])] + [(None, "http://net/", "x", "y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, token string")
    found = sorted((tuple(r) for r in judge(pages).collect()), key=str)
    assert found == sorted(((i, *verdict(u)) for i, u, *_ in rows), key=str)
    assert judge(pages.where("false")).collect() == []
