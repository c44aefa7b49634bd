import math
import time

import pytest

from bomspark.llm.html_text import _cut, _measure, extract, extract_pages, parse

LONG = "These are many plain words of an article that goes on for quite some time, with commas and all. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is a very good thing to buy and you will like it a lot.</div>
<div class="cookie-notice">We use cookies.</div><div id="content"><article><h1>Title  of &quot;it&quot;</h1><p><b>{LONG}<br><p>Second&nbsp;one: 1 &lt; 2.
 {LONG}</p><div class="advert">Inner ad</div><p>Short.</article>
<div class="comments"><p>I think this is a very long reader comment that says nothing much at all but goes on.</p></div></div>
<aside>Related</aside><form><label>Mail</label><input></form><footer>&copy; me &middot; all rights</footer></body></html>"""


def test_article_without_its_surroundings():
    one = " ".join(LONG.split())
    assert extract(PAGE) == f'Title of "it"\n{one}\nSecond one: 1 < 2. {one}\nShort.'


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text", "just text"), ("<p>a &amp; b", "a & b"), ("<p>cut <b", "cut <b"), ("<!-- open comment", ""), ("<script>x", ""), ("<div class=ad>x</div>", ""), ("x < y > z", "x < y > z"), ("<p>one<p>two", "one\ntwo")])
def test_odd_pages(page, want):
    assert extract(page) == want


def test_very_deep_and_very_long_pages_end():
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert len(extract("<p>" + "word " * 300_000)) == 300_000 * 5 - 1
    assert extract("<a href='" * 5000 + "x") != "never ends"


def test_query_keeps_every_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (2, None, None, 0), (None, "v", "<p>x", 0)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_pages(pages).collect())
    assert got[0] == (0, "v", "x", 1) and got[2:] == [(2, None, "", 0)] * 2 and got[1][3] == len(extract(PAGE))
    assert extract_pages(pages.limit(0)).count() == 0


def paragraphs(key, n=3, chars=300):
    return [f"{key}{i} ".ljust(chars, "x") for i in range(n)]


def test_article_split_over_siblings_is_whole():
    a, b, c = paragraphs("a"), paragraphs("b"), paragraphs("c", 8, 200)
    tags = lambda texts, name="p": "".join(f"<{name}>{t}</{name}>" for t in texts)
    nav = "<div>" + "<a href=x>some link</a> " * 5 + "</div>"
    assert extract(f"<body>{nav}<article><section>{tags(a)}</section><section>{tags(b)}</section></article>{nav}</body>") == "\n".join(a + b)
    assert extract(f"<article><h1>Title</h1><section>{tags(a)}</section>{nav}<h2>Next</h2>loose <i>text</i><p>Short.</p><section>{tags(b)}</section></article>") == "\n".join(["Title", *a, "Next", "loose text", "Short.", *b])
    assert extract(f"<article>{tags(a)}<ul>{tags(c, 'li')}</ul>{tags(b)}</article>") == "\n".join(a + c + b)


@pytest.mark.parametrize("head, tail", [("<div class='content no-sidebar'>", "</div>"), ("<div id=post class=with-sidebar>", "</div>"), ("<div class='post comments-enabled'>", "</div>"), ("<div class=search-result>", "</div>"), ("<form action=x><div>", "</div></form>"), ("<div class=sidebar>", "</div>"), ("<form><article>", "</article></form>")])
def test_names_alone_do_not_cut_the_article(head, tail):
    texts = paragraphs("t", 4)
    body = "".join(f"<p>{t}</p>" for t in texts)
    assert extract(f"<body><nav><a href=a>Home</a></nav>{head}{body}{tail}<footer>the owner</footer></body>") == "\n".join(texts)


def test_elements_by_name_parts_are_cut_by_their_links():
    texts = paragraphs("t", 4)
    body = "".join(f"<p>{t}</p>" for t in texts)
    links = "".join(f"<a href={i}>another story</a> " for i in range(9))
    page = f"<article><header><h1>Title</h1></header>{body}<div class=related-posts>{links}</div><div class=post-related>More.</div><div class=comments><p>{texts[0]}</p></div></article>"
    assert extract(page) == "\n".join(["Title", *texts, "More."])
    posts = "".join(f"<div class='post comments-enabled'><p>{t}</p></div>" for t in texts)
    assert extract(f"<body><header><h1>Site</h1></header>{posts}</body>") == "\n".join(texts)


def plain_measures(node):
    """Characters, link characters, tags, link tags of what is shown below a node, counted anew."""
    shown = [x for x in node.items if isinstance(x, str) or not x.off]
    chars = sum(len(" ".join(x.split())) for x in shown if isinstance(x, str))
    inner = [plain_measures(x) for x in shown if not isinstance(x, str)]
    names = [x.name for x in shown if not isinstance(x, str)]
    chars += sum(m[0] for m in inner)
    links = chars if node.name == "a" else sum(m[1] for m in inner)
    return chars, links, sum(m[2] + 1 for m in inner), sum(m[3] + (n == "a") for m, n in zip(inner, names))


def test_densities_of_all_pages_equal_a_plain_count(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    checked = 0
    for page in pages:
        root = parse(page)
        _cut(root)
        order = _measure(root)
        body = next((n for n in order if n.name == "body"), root)
        bc, bl, _, _ = plain_measures(body)
        for node in order:
            c, lc, t, lt = plain_measures(node)
            t, lt = max(t, 1), max(lt, 1)
            want = 0.0
            if c:
                base = math.log(math.log(c * lc / max(c - lc, 1) + (bl / bc if bc else 0) * c + math.e))
                want = max(c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / base if base > math.log(1.0001) else c / t, 0.0)
            assert node.density == pytest.approx(want, rel=1e-6)
            assert node.total == pytest.approx(sum(k.density for k in node.kids))
            checked += 1
        inside = [n for n in order if n is body or body in _ancestors(n)]
        assert not body.chars or body.top.total == max(n.total for n in inside)
    assert checked > 1000


def _ancestors(node):
    while node.parent is not None:
        node = node.parent
        yield node


@pytest.mark.parametrize("part", ["<![CDATA[", "<a ", '<a "', "<i>", "</i>", "<div>", "<p>", "<li>", "<td>", "<a<", "<", "<span><li>"])
def test_time_grows_with_the_page_alone(part):
    page = part * (200_000 // len(part))
    began = time.perf_counter()
    extract(page)
    extract(page + ">")
    assert time.perf_counter() - began < 8


#: Blocks that stand inside an article but are none of its text.
INNER = {
    "newsletter form": "<form><label>Mail</label><p>Get our letter every week.</p><input></form>",
    "reply form": "<form><fieldset><legend>Reply</legend><p>Write what you think.</p></fieldset></form>",
    "comments-area": "<div id='comments-area'><p>A reader says something.</p></div>",
    "user-comments": "<div class='user-comments'><p>I like it very much.</p></div>",
    "comment-list": "<ol class='comment-list'><li><article class='comment'>So do I.</article></li></ol>",
    "commentBox": "<div class='userCommentBox'>Me too.</div>",
    "ad-box": "<div class='ad-box'>Buy it.</div>",
    "ad_slot": "<div class='ad_slot'><p>Buy two of them.</p></div>",
    "cookie-banner": "<div class='cookie-banner'><p>We use cookies on this page.</p></div>",
    "newsletter-box": "<section class='newsletter-box'><h3>News</h3><p>Every week.</p></section>",
    "site-notice": "<div class='site-notice'><p>The site is down tonight.</p></div>",
    "aside": "<aside><p>Beside the point.</p></aside>",
    "share": "<div class='share'><span>Tell a friend</span></div>",
    "menu": "<ul class='article-menu'><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>",
}
OUTER = {"article": ("<article>", "</article>"), "post": ("<div class='post'>", "</div>"), "main": ("<main><div id=content>", "</div></main>"), "post share": ("<div class='post share'>", "</div>"), "comments-enabled": ("<div class='layout comments-open'>", "</div>")}


@pytest.mark.parametrize("inner", INNER)
@pytest.mark.parametrize("outer", OUTER)
def test_blocks_that_are_no_article_text(outer, inner):
    texts = paragraphs("t", 4, 120)
    body = [f"<p>{t}</p>" for t in texts]
    head, tail = OUTER[outer]
    assert extract(f"<body>{head}{''.join(body[:2])}{INNER[inner]}{''.join(body[2:])}{tail}</body>") == "\n".join(texts)


@pytest.mark.parametrize("chars", [5, 60, 150, 190, 200, 210, 400, 5000])
def test_short_pages_are_treated_as_long_ones(chars):
    text = "word ".ljust(chars + 1, "x")
    for name in ("post share", "sidebar", "layout no-comments", "page header"):
        assert extract(f"<body><nav><a href=a>Home</a></nav><div class='{name}'><p>{text}</p></div></body>") == text
    for name in ("ad", "comments", "cookie notice"):
        assert extract(f"<body><div class='{name}'><p>{text}</p></div></body>") == ""
