import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from statementspark.llm import html_text as H

from ..conftest import SF

LONG = "This paragraph is long enough to look like the text of an article and not like a menu at all. " * 3
PAGE = f"""<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=#>Home</a></li><li><a>About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, please accept them all before you go on reading.</div>
<article><h1>Head &amp; line</h1><p>{LONG}<p>Short one.</p><p>two
  lines&nbsp;here</p><div class="ad">Buy this now, it is a very good thing to have and to hold for ever.</div><p>{LONG}</p></article>
<aside>Side text that goes on for quite a while so that it looks like text.</aside><section class="comments"><p>{LONG}</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    assert H.extract(PAGE) == "\n".join(["Head & line", LONG.strip(), "Short one.", "two lines here", LONG.strip()])


def test_without_an_article_element():
    plain = PAGE.replace("<article>", "<div id=content>").replace("</article>", "</div>")
    assert H.extract(plain) == H.extract(PAGE)


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<script>x", ""), ("<p>a<b>c &lt; d", "ac < d"), ("<nav>menu</nav>", ""), ("</p></div>x<", "x<")])
def test_odd_pages(html, text):
    assert H.extract(html) == text


def test_smoothing_keeps_a_constant_and_the_order():
    assert np.allclose(H.smooth(np.full(7, 3.0)), 3.0)
    assert H.smooth(np.array([0.0, 0, 9, 0, 0])).argmax() == 2


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "<article>" + "<p>" + "word " * 100_000 + "</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((str(r.page_id), r.url or "", len(r.text)) for r in H.extract_pages(df).collect())
    assert [g[:2] for g in got] == [("1", "u"), ("1", "u"), ("3", "v"), ("None", "")]
    assert got[2][2] == 499_999 and got[3][2] == 0
    assert H.extract_pages(df.where("false")).count() == 0


def test_no_line_outside_boilerplate_is_lost():
    long, other = LONG.strip(), LONG.strip().upper()
    # Two articles in one main, of unequal size.
    assert H.extract(f"<main><article><p>{long}</p><p>{long}</p></article><article><p>{other}</p></article></main>") == "\n".join([long, long, other])
    # A tenth of the clustered text stands beside the element that holds the rest.
    many = "".join(f"<p>{long}</p>" for _ in range(12))
    assert H.extract(f"<body><div><div>{many}</div><p>{other}</p></div></body>") == "\n".join([long] * 12 + [other])
    # Short paragraphs directly in body, and with no element around at all.
    short = "".join("<p>Short.</p>" for _ in range(12))
    want = "\n".join([long, *["Short."] * 12, long])
    assert H.extract(f"<body><p>{long}</p>{short}<p>{long}</p></body>") == want
    assert H.extract(f"<p>{long}</p>{short}<p>{long}</p>") == want
    assert H.extract(f"Short.<p>{long}</p>") == f"Short.\n{long}"


@pytest.mark.parametrize("named", ["content has-sidebar", "post-header-large main", "no-comments entry", "ad", "sidebar"])
def test_a_class_never_empties_a_page(named):
    page = f"<body><div id=menu><a>Home</a> <a>About</a></div><div class='{named}'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert H.extract(page) == "\n".join(["Head", LONG.strip(), LONG.strip()])
    # Without a heading too, if there is no other text.
    assert H.extract(f"<body><div class='{named}'><p>{LONG}</p></div></body>") == LONG.strip()


def test_comments_that_are_articles_go():
    comments = "".join(f"<article class='comment-body'><p>{LONG}</p></article>" for _ in range(5))
    assert H.extract(f"<body><div id=post><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><section class=comments>{comments}</section></body>") == "\n".join(["Head", LONG.strip(), LONG.strip()])


def score(got, want):
    got, want = got.split("\n"), want.split("\n")
    met = sum(min(got.count(x), want.count(x)) for x in set(want))
    return 2 * met / (len(got) + len(want))


def plain_pages():
    """Pages of div and p alone: a block of short links around one longer line, then the text with short paragraphs in it."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        word = lambda k: " ".join(f"w{x}" for x in rng.integers(100, 999, k))
        links = lambda k: "".join(f"<p><a href=x>{word(2)}</a></p>" for _ in range(k))
        text = [word(int(k)) for k in rng.choice([4, 50, 70, 90], 14, p=[0.2, 0.3, 0.3, 0.2])]
        text[0] = text[-1] = word(70)
        yield f"<html><body><div>{links(8)}<p>{word(40)}</p>{links(8)}</div><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div>{links(9)}</div></body></html>", "\n".join(text)


def test_smoothed_ratios_select_the_region():
    pages = list(plain_pages())
    found = {sigma: np.mean([score(H.extract(html, sigma), want) for html, want in pages]) for sigma in (0, H.SIGMA)}
    assert found[H.SIGMA] > 0.97 and found[0] < found[H.SIGMA] - 0.1
    # Without a threshold the whole page is left.
    assert np.mean([score(H.extract(html, spread=-9), want) for html, want in pages]) < 0.7


def test_given_pages_without_their_elements_and_classes(spark):
    rows = [r.html for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").select("html").collect()]
    bare = lambda html: re.sub(r"<(/?)(?:li|h1)\b[^>]*>", r"<\1p>", re.sub(r"<(/?)(?:nav|article|footer|ul)\b[^>]*>", r"<\1div>", html)).replace(' class="ad"', "")
    found = {spread: np.mean([score(H.extract(bare(html), spread=spread), H.extract(html)) for html in rows]) for spread in (H.SPREAD, -9)}
    assert found[H.SPREAD] > 0.9 and found[-9] < 0.75


@pytest.mark.parametrize("kind", ["<p>a b", "<div>a b", "<b>x</i>", "<td>x", "<li><ul>x"])
def test_time_is_linear(kind):
    took = {}
    for n in (5_000, 100_000):
        began = time.process_time()
        assert len(H.extract("<html><body>" + kind * n)) >= n
        took[n] = time.process_time() - began
    assert took[100_000] < 60 * took[5_000] + 1


def test_implied_end_tags():
    page = H.Lines()
    page.feed("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td><p>x<td>y<tr><td>z</table><p>e<p>f")
    page.close()
    assert [x[0] for x in page.lines] == ["a", "b", "c", "d", "x", "y", "z", "e", "f"]
    depth = lambda k: 0 if k < 0 else 1 + depth(page.parents[k])
    assert [depth(x[2]) for x in page.lines] == [2, 2, 4, 2, 4, 3, 3, 1, 1]


@pytest.mark.parametrize("gone", ["</head>", "<head>", "<body>", "</body>", "</html>", "<html>", "</p>", "</li>", "</head>|<body>", "<head>|</head>", "<html>|<head>|</head>|<body>|</body>|</html>"])
def test_optional_tags_left_out(spark, gone):
    """The given pages say the same without tags that HTML allows to leave out."""
    pages = [r.html for r in spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").collect()]
    cut = re.compile("|".join(f"<{x.strip('<>')}(?: [^>]*)?>" for x in gone.split("|")), re.IGNORECASE)
    assert sum(len(cut.sub("", p)) < len(p) for p in pages) > len(pages) // 2
    assert [H.extract(cut.sub("", p)) for p in pages] == [H.extract(p) for p in pages]


def test_a_head_ends_where_text_or_another_tag_begins():
    assert H.extract("<html><head><title>T</title>Hello there") == "Hello there"
    assert H.extract("<head><title>T</title><noscript><img src=x></noscript><meta name=a><p>Hello") == "Hello"
    assert H.extract("<head><title>T<body><p>Hello") in ("", "Hello")
