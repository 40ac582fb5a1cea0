"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, with menus, notices and the like left out by element and by
class. Every line has a weight: its characters outside links, more if it stands in an article element, less if the page
has such elements and it stands outside. Over all lines of a page the weights are summed in sliding windows; the main
text runs from the window where the sums surge to where they dive for good. So tags only weigh: pages without them, and
text beside them, are judged by the same sums.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

#: Lines in a window, and the weight that windows must sum to.
WINDOW, SURGE = 3, 80
#: What an article element adds to the weight of each line in it, and the share that is left to lines outside of it.
INSIDE, OUTSIDE = SURGE + 1, 0.05

#: Elements left out whole; the text of the first ones isn't markup.
RAW = frozenset("script style noscript template textarea iframe svg math title".split())
LEFT_OUT = RAW | frozenset("head nav header footer aside form button select dialog menu object audio video canvas".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line.
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody tfoot thead tr ul caption legend".split()
) | (LEFT_OUT - {"svg", "math", "button"})
#: Words in class, id or role that mark what isn't the article, and words that may stand beside them in a name.
NOT_MAIN = re.compile(
    r"ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|header|masthead|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"comments?|commentlist|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|widget\w*|pagination|pager|complementary|contentinfo"
)
BESIDE = frozenset(
    "site main page top bottom left right first last primary secondary global local post posts article articles box block wrap wrapper container outer inner area region section list item items link links bar slot unit button buttons form icons media js".split()
)


def not_main(marks: str) -> bool:
    """Whether one of the names says that an element isn't the article: a whole name, or its parts, are such words, with none but BESIDE between them."""
    for name in marks.split():
        parts = [x for x in re.split(r"[_-]+", name) if x]
        if any(NOT_MAIN.fullmatch(x) for x in parts) and all(x in BESIDE or x.isdigit() or NOT_MAIN.fullmatch(x) for x in parts):
            return True
    return False


TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z|(?=<))|([^<]+)|(<)""", re.S)
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ARTICLE = re.compile(r"""itemprop\s*=\s*["']?articleBody|role\s*=\s*["']?(?:main|article)\b""", re.I)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters of it outside links, number of the article it is in or 0) of each line that isn't left out."""
    lines: list[tuple[str, int, int]] = []
    text: list[str] = []
    links = skip = in_link = articles = 0
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether left out, article number before it
    opened: dict[str, int] = {}  # how many of each name are open
    now = at = 0

    def flush() -> None:
        nonlocal links
        if (line := " ".join(html.unescape("".join(text)).split())):
            lines.append((line, max(0, len(line) - links), now))
        text.clear()
        links = 0

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if (plain := m[4] or m[5]) is not None:
            if not skip:
                text.append(plain)
                links += len(plain) * (in_link > 0)
            continue
        if m[2] is None:  # a comment or declaration
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS and not skip:
                flush()
            if opened.get(name):
                while stack:
                    own, left_out, before = stack.pop()
                    opened[own] -= 1
                    skip -= left_out
                    in_link -= own == "a"
                    if before != now:
                        flush()
                        now = before
                    if own == name:
                        break
            continue
        if name in ("br", "hr", "td", "th", "img") and not skip:
            text.append(" ")
        if name in BLOCKS and not skip:
            flush()
        if name in VOID or m[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:  # its content is no markup
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        marks = " ".join(filter(None, (x for y in MARKS.findall(m[3]) for x in y))).lower() if m[3] else ""
        left_out = name in LEFT_OUT or name not in ("html", "body", "article", "main") and bool(marks) and not_main(marks)
        left_out = left_out or name == "article" and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", marks))
        if name in ("p", "li", "option", "tr", "td", "th", "dd", "dt") and stack and stack[-1][0] == name:
            skip -= stack.pop()[1]  # its end tag may be left out
            opened[name] -= 1
        stack.append((name, left_out, now))
        opened[name] = opened.get(name, 0) + 1
        if left_out:
            if not skip:
                flush()
            skip += 1
        elif not skip and not now and (name in ("article", "main") or m[3] and ARTICLE.search(m[3])):
            flush()
            articles += 1
            now = articles
        in_link += name == "a"
    if not skip:
        flush()
    return lines


def main_range(weights: list[float], surge: float, window: int = WINDOW) -> tuple[int, int]:
    """First line and end of the main text: where window sums first exceed ``surge``, to where the last such window ends.

    Dives between two surges are part of it if the lines there have weight of their own (a list of short items, say);
    lines without any, such as blocks of links, part the text, and of the parts the one with the most weight is it.
    Lines at either end that a line without weight cuts off, or that no large line is near, are not part of it.
    """
    before = [0.0]
    for x in weights:
        before.append(before[-1] + x)
    n = len(weights)
    high = [i for i in range(n) if before[min(i + window, n)] - before[i] > surge]
    if not high:
        return 0, 0
    runs, start = [], high[0]
    for x, y in zip(high, [*high[1:], None], strict=True):
        end = min(n, x + window)
        if y is None or y > end and not all(weights[end:y]):
            runs.append((before[end] - before[start], -start, end))
            start = y
    _, first, end = max(runs)
    first = -first
    # from the lines that make the sums large outwards, as far as every line has weight
    large = [i for i in range(first, end) if weights[i] * window > surge]
    lo, hi = (large[0], large[-1] + 1) if large else (first, end)
    while lo > first and weights[lo - 1]:
        lo -= 1
    while hi < end and weights[hi]:
        hi += 1
    return lo, hi


def weights_of(lines: list[tuple[str, int, int]]) -> list[float]:
    """The weight of each line: characters outside links, by whether it is in one of the page's article elements.

    Where articles lie side by side, those with less than a tenth of the text of the longest are teasers: outside.
    """
    sizes: dict[int, int] = {}
    for text, _, article in lines:
        if article:
            sizes[article] = sizes.get(article, 0) + len(text)
    if not sizes:
        return [own for _, own, _ in lines]
    most = max(sizes.values())
    return [len(text) + INSIDE if 10 * sizes.get(article, 0) >= most else OUTSIDE * own for text, own, article in lines]


def main_text(page: str) -> str:
    """The lines of a page's main text, joined by newlines; empty if it has none."""
    lines = lines_of(page)
    weights = weights_of(lines)
    first, end = main_range(weights, SURGE)
    if first == end:  # no surge: a page with so little text is kept as it is
        first, end = main_range(weights, 0)
    if any(x[2] for x in lines):  # what doesn't surge between two articles or beside one
        return "\n".join(x[0] for x, w in zip(lines[first:end], weights[first:end], strict=True) if w > INSIDE or w * WINDOW > SURGE)
    return "\n".join(x[0] for x in lines[first:end])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page; null and empty pages have empty text. Every row gives one row.

    Other columns aren't read; a null url stays null; an empty table gives an empty one.
    """
    source = pages.select(F.struct(F.col(id_col), F.col("url")).alias("own"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("data"))

    def text(data: bytes) -> tuple[str, int]:
        found = main_text(data.decode("utf-8", "replace"))
        return found, len(found)

    return per_row(source, text, "text string, n_chars long", "own").select(F.col(f"own.{id_col}"), "own.url", "text", "n_chars")
