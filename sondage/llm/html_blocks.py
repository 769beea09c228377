"""HTML extraction by line-block distribution.

Markup is stripped to lines, one per block; menus, footers, forms, adverts, comments and the like are stripped to
empty lines, and so is the border of a container that the page marks as its article. A line's weight is its text
length outside links. The weights are summed over sliding windows of ``WINDOW`` lines. Where the sum reaches the limit
the text surges, where it falls to nothing it dives, and the lines between are kept. The limit is ``SURGE``, or the
largest sum of a page that never gets so far.

Marks add no weight. A marked article is kept or left as a whole, by the highest window in it (pages mark teasers as
articles, and articles have short lines and lines of links); lines outside it must surge as high as that window.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import narrow_batches
from ._words import released

WINDOW, SURGE = 3, 80
_DROP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<\?.*?(?:>|$)|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|audio|video)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<![a-zA-Z][^>]*>|<(?:/?[a-zA-Z!][^<>]*)?$""")
_ATTR = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCK = {*"address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()}
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
#: Containers that never hold the article's text, and the words of class, id or role that mark others.
_BOILER = {*"nav footer aside form menu dialog button head fieldset label".split()}
_MARKED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|sidebar|side-bar|side|aside|footer|foot|header|masthead|banner|breadcrumbs?|crumbs?|ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|disclaimer|newsletter|subscribe|subscription|signup|sign-up|login|popup|modal|overlay|related|recommended|recommendations|share|sharing|social|comment|comments|commentlist|disqus|respond|replies|widget|widgets|pagination|pager|toolbar|search|copyright|legal|skip|toc|tags|contentinfo|complementary|paywall|teaser)(?=$|[\s_-])", re.I)
_ARTICLE = re.compile(r"(?:^|\s)(?:articlebody|article-body|article_body|article-content|post-content|post-body|entry-content|main-content|story-body|articlecontent)(?=$|\s)", re.I)
#: Parts of a class name that say a container has, or has not, what follows.
_ABOUT = re.compile(r"(?:^|\s)(?:with|has|no|without|not|is)[-_]\S+", re.I)
_CONTAINERS = {*"div section article main header ul ol table td tr tbody p span dl figure details body center blockquote".split()} | _BOILER
_SPACE = re.compile(r"\s+")
NOT, MAYBE, SURELY = 0, 1, 2


def _boilerplate(name: str, marks: str, is_article: bool, inside: bool) -> int:
    """Whether a container is boilerplate; MAYBE unless an article is in it (a form, or a mark that only modifies a name)."""
    if name == "article":
        return SURELY if re.search(r"(?:^|[\s_-])comments?(?=$|[\s_-])", marks, re.I) else NOT
    if name in ("body", "main") or is_article:
        return NOT
    if name == "form":
        return MAYBE
    if name in _BOILER or (name == "header" and not inside):
        return SURELY
    found = [m.end() for m in _MARKED.finditer(_ABOUT.sub(" ", marks))] if marks else []
    if not found:
        return NOT
    text = _ABOUT.sub(" ", marks)
    return SURELY if any(end == len(text) or text[end].isspace() for end in found) else MAYBE


def lines(page: str) -> Iterator[tuple[str, int, bool]]:
    """(text, weight, in a marked article) of each block of a page, in order; ``WINDOW`` empty lines where text was stripped.

    Lines for what was stripped inside an article belong to it; those at its border don't.
    """
    source = _DROP.sub(" ", page)
    open_: list[list] = []  # name, boilerplate, article
    boiler = article = links = 0
    text: list[str] = []
    weight = at = 0
    gap = border = False

    def close(name: str) -> None:
        nonlocal boiler, article
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                for _, b, a in open_[i:]:
                    boiler -= b > NOT
                    article -= a
                del open_[i:]
                return

    def add(piece: str) -> None:
        nonlocal weight, gap
        if not piece:
            return
        if boiler:
            gap = gap or not text
            return
        text.append(piece)
        if not links:
            weight += len(piece.strip())

    def flush() -> Iterator[tuple[str, int, bool]]:
        nonlocal weight, gap, border
        if gap or border:
            yield from [("", 0, article > 0 and not border)] * WINDOW
            gap = border = False
        line = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
        if line:
            yield line, weight, article > 0
        text.clear()
        weight = 0

    for m in _TAG.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends = bool(m[1] or m[4])
        if name in _BLOCK:
            yield from flush()
        if name == "a":
            links = 0 if ends else 1
        if name in _VOID or name not in _CONTAINERS:
            continue
        before = article > 0
        if ends:
            close(name)
        else:
            if name == "body":
                close("head")
            elif name in _BLOCK and open_ and open_[-1][0] == "p":
                close("p")
            attrs = m[3] or m[6] or ""
            marks = " ".join(x[0] or x[1] or x[2] for x in _ATTR.findall(attrs)) if "=" in attrs else ""
            is_article = name in ("article", "main") or bool(marks and _ARTICLE.search(marks))
            kind = _boilerplate(name, marks, is_article, before)
            if is_article and not kind:
                for outer in open_:
                    if outer[1] == MAYBE:
                        outer[1] = NOT
                        boiler -= 1
            open_.append([name, kind, is_article])
            boiler += kind > NOT
            article += is_article
        border = border or (before != (article > 0) and not text)
    add(source[at:])
    yield from flush()


def between(weights: list[int], marked: list[bool]) -> list[int]:
    """The lines from where the text surges to where it dives, and the marked runs that reach a surge."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    top = max((s for s, m in zip(sums, marked, strict=True) if m), default=0)
    limit = min(max(SURGE, top), max(sums, default=0))
    kept, inside, i = [], False, 0
    while i < len(sums):
        if marked[i]:
            end = next((j for j in range(i, len(sums)) if not marked[j]), len(sums))
            if 0 < min(SURGE, top) <= max(sums[i:end]):
                kept.extend(range(i, end))
            inside, i = False, end
            continue
        if not inside and weights[i] > 0 and sums[i] >= limit:
            inside = True  # surge
        elif inside and sums[i] == 0:
            inside = False  # dive
        if inside:
            kept.append(i)
        i += 1
    return kept


def extract(page: str | None) -> str:
    """The main text of a page; an empty string if it has none."""
    rows = list(lines(page or ""))
    return " ".join(rows[i][0] for i in between([x[1] for x in rows], [x[2] for x in rows]) if rows[i][0])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``id_col``, ``url_col``, text (empty if none), n_chars (its code points).

    Null and empty pages give an empty text; malformed and cut markup is read as far as it goes, and pages of any
    length whole. Rows that repeat an id each get a row; ids and urls keep their types, nulls stay. Other columns
    aren't read, whatever their names. An empty table gives an empty result.
    """
    narrow_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(released(batches), f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
