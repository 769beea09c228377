import random
import re
from collections import Counter

import pytest

from sondage.llm.html_blocks import SURGE, WINDOW, between, extract, lines, main_text
from sondage.llm.queries import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now</div><div id="cookie-notice"><p>We use cookies</p></div>
<article><h1>A &amp; B</h1><p><b>First<br>line &lt;x&gt;<p>Second &eacute;&nbsp; text</p><aside>side</aside><form><input value="q">Send</form>
<footer>by me</footer></article><section class="comments"><p>I disagree with all of this strongly</p></section><footer>&copy; 2020</footer></body></html>"""
TEXT = "This paragraph is long enough to be the text of the page, with a good many words in it."
LINKS = "".join(f'<div><a href="/{i}">go to page {i}</a></div>' for i in range(9))
JUNK = "<div>Home</div><div>Log in</div><div>Share</div>"


def test_article():
    assert extract(PAGE) == "A & B First line <x> Second é text"


def test_without_article():
    page = f'<div class="menu"><a href="/">Home</a></div><div><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p></div><ul><li><a href="x">one</a></li><li><a href="y">two</a></li></ul><div id="footer">foot</div>'
    assert extract(page) == f"{TEXT} Short. {TEXT}"


def test_windows_find_unmarked_text_among_meaningless_class_names():
    page = f'<div class="q1">{JUNK}{LINKS}</div><div class="q2"><h2>On blocks</h2><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p></div><div class="q3">{LINKS}{JUNK}</div>'
    assert extract(page) == f"On blocks {TEXT} Short. {TEXT}"
    rows = [x[0] for x in lines(page) if x[0]]
    assert "Home" in rows and "go to page 3" in rows and "Share" in rows  # only the windows leave these out


def test_misleading_class_names_and_marks():
    assert extract(f'<div class="layout with-sidebar has-comments"><article><p>Few words.</p></article></div>') == "Few words."
    assert extract(f'<form><div class="sidebar-layout"><main><p>{TEXT}</p><form>mail</form></main></div></form>') == TEXT
    assert extract(f"<article>Teaser</article><div>{''.join(f'<p>{TEXT}</p>' for _ in range(4))}</div>") == " ".join(["Teaser", *[TEXT] * 4])
    assert extract(f"<article><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></article><div><p>{TEXT}</p></div>") == " ".join([TEXT] * 3)
    assert extract('<div class="comments"><article class="comment">so wrong</article><article>me too</article></div>') == ""


def intervals(weights, marked):
    """Surge and dive points found from the definition: for each line the sum ahead, then whole intervals of unmarked lines."""
    ahead = lambda i: sum(x for j, x in enumerate(weights) if i <= j < i + WINDOW)
    n = len(weights)
    largest = max([ahead(i) for i in range(n)] or [0])
    top = max([ahead(i) for i in range(n) if marked[i]] or [0])
    need = min(largest, max(SURGE, top))
    out = set()
    for i in range(n):
        if marked[i]:
            a = max((j + 1 for j in range(i) if not marked[j]), default=0)
            b = min((j for j in range(i, n) if not marked[j]), default=n)
            if top and max(ahead(j) for j in range(a, b)) >= min(SURGE, top):
                out.add(i)
        else:  # a surge since the last dive or marked line
            since = max((j + 1 for j in range(i + 1) if marked[j] or (ahead(j) == 0)), default=0)
            if any(weights[j] and ahead(j) >= need for j in range(since, i + 1)):
                out.add(i)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_windows_as_defined(seed):
    r = random.Random(seed)
    for _ in range(300):
        n = r.randrange(30)
        weights = [r.choice([0, 0, 0, 3, 20, 60, 150]) for _ in range(n)]
        marked = [w > 0 and r.random() < (0.3 if seed % 2 else 0) for w in weights]
        assert between(weights, marked) == intervals(weights, marked)


def test_malformed_and_empty():
    assert extract(None) == extract("") == extract("<nav>only</nav>") == ""
    assert extract("<p>x") == "x"
    assert extract("<article>cut <b>here</ar") == "cut here"
    assert extract("<article>a < b and 3 > 2 &am") == "a < b and 3 > 2 &am"
    assert extract("<ARTICLE><P CLASS='x>y'>q</P>" + "z " * 50000).startswith("q z z")


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = [tuple(r) for r in main_text(df).orderBy("page_id").collect()]
    assert out == [(1, "u", extract(PAGE), len(extract(PAGE)))] * 2 + [(2, None, "", 0)]
    assert main_text(df.limit(0)).count() == 0


def neutral(page):
    """The page without what marks its article; ``bare``: and without any class, id or role."""
    same = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page, flags=re.I)
    same = re.sub(r"""\b(class|id|itemprop)\s*=\s*("[^"]*(?:article|content|post|entry|story|main)[^"]*"|'[^']*(?:article|content|post|entry|story|main)[^']*')""", 'data-x="1"', same, flags=re.I)
    return same, re.sub(r"""\s(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", same, flags=re.I)


def test_windows_find_the_text_of_pages_that_mark_nothing(spark, sf_dir):
    """Recall and precision of words against the marked article, over all pages of the table."""
    pages = [r["html"] or "" for r in table(spark, sf_dir, "pages").select("html").collect()]
    for which, least in ((0, 0.98), (1, 0.95)):
        hit = there = found = 0
        for page in pages:
            want, got = Counter(extract(page).split()), Counter(extract(neutral(page)[which]).split())
            hit, there, found = hit + sum((want & got).values()), there + want.total(), found + got.total()
        assert there and hit / there >= 0.95 and hit / found >= 0.95, (which, hit / there, hit / found)
        assert hit / there >= least
