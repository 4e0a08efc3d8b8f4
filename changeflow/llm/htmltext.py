"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page; elements that are no article (menus,
scripts, adverts, ...) give none. Text lengths are summed over a sliding window of lines; where the
sum surges above a threshold the text begins, where it dives to nothing it ends. Lines made of links
weigh nothing. ``article`` and ``main`` only change weights: where such elements hold most of the
page's text, their lines weigh more and those outside less, and no window reaches across their
edges. Every step of the parser takes constant time, so a page's time is that of its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import per_row, ready, table

#: Lines summed up, and the sum that starts a text where no element says so.
WINDOW, SURGE = 3, 86
#: A line is a link line when links make up this share of it.
LINKS = 0.5
#: Where article and main elements hold this share of a page's text, their lines weigh so much
#: more, those outside so much less.
SHARE, MORE, LESS = 0.5, 100, 0.1

# Element names and words of the HTML standard and of common page templates.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
CORE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|"
    r"sidebar|side|aside|widget|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|foot|"
    r"cookie|cookies|consent|notice|notices|popup|modal|alert|disclaimer|comment|comments|disqus|replies|reply|respond|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|signup|login|pagination|pager|toolbar)s?(?=$|[\s_-])",
    re.I,
)
#: Class names that say what a wrapper has beside its content, not what it is.
MODIFIERS = re.compile(r"^(?:has|no|not|with|without|hide|show|toggle|is-not|js)[-_]|[-_](?:left|right|none|off|on|open|closed|active|enabled|disabled)$", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)


@dataclass
class Line:
    """A block's text, what of it stands in links, and where it stands."""

    text: str
    linked: int
    core: bool


def _apart(tag: str, attrs: str, core: bool) -> bool:
    """Whether an element is no part of the article."""
    if tag in ASIDE and not (tag == "header" and core):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(
            NAMES.search(word) and not MODIFIERS.search(word) for word in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).split()
        ):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The page's blocks of visible text in page order, without those of apart elements.

    Tags may be left open or closed in the wrong order; a paragraph or list item ends where the
    next block begins.
    """
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, apart, core, link; each with all above it
    now: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if now:
            text = " ".join("".join(now).split())
            if text:
                out.append(Line(text, linked, state[2]))
            now.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not state[1]:
            text = html.unescape(raw) if "&" in raw else raw
            now.append(text)
            if state[3]:
                linked += len(text.strip())

    def push(entry: tuple[str, bool, bool, bool]) -> None:
        opened[entry[0]] += 1
        if entry[0] in BLOCK:
            blocks.append(len(stack))
        stack.append(entry)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    outside = ("", False, False, False)
    opened: Counter[str] = Counter()  # how many of a tag are on the stack
    blocks: list[int] = []  # where blocks stand on the stack
    state = outside
    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            said(page[at:])
            break
        said(page[at : found.start()])
        at = found.end()
        if found["cdata"] is not None:
            said(found["cdata"])
        tag = found["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if found["close"]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                pop_to(depth)
        else:
            if tag in BLOCK:
                flush()
                if tag not in VOID and blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] == tag == "li"):
                    pop_to(blocks[-1])
                state = stack[-1] if stack else outside
            if tag in RAW and not found["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not (found["attrs"].endswith("/") and tag not in BLOCK and tag != "a"):
                apart = state[1] or _apart(tag, found["attrs"], state[2])
                push((tag, apart, state[2] or tag in CORE and not apart, state[3] or tag == "a"))
        state = stack[-1] if stack else outside
    flush()
    return out


def spans(weights: list[int], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Runs of lines from a surge point to a dive point of the windowed sums, ends exclusive.

    A run begins where the sum from a line on exceeds ``surge`` and ends before the first line
    from which the sum is zero.
    """
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, start = [], None
    for i, total in enumerate(sums):
        if start is None and total > surge and weights[i]:
            start = i
        elif start is not None and not total:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(weights)))
    return out


def _segments(found: list[Line]) -> Iterator[list[Line]]:
    """Lines in a row that stand all inside, or all outside, of ``article`` and ``main``."""
    for _, lines_ in groupby(found, key=lambda line: line.core):
        yield list(lines_)


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The article's blocks in page order, joined by one space; empty if there is none.

    A line of links is kept where it stands alone between lines of the article.
    """
    if not page:
        return ""
    found = lines(page)
    plain = lambda line: 0 if line.linked >= LINKS * len(line.text) else len(line.text)
    inside, total = sum(plain(x) for x in found if x.core), sum(map(plain, found))
    marked = inside > 0 and inside >= SHARE * total
    kept: list[str] = []
    for limit in (surge, 0):
        for segment in _segments(found) if marked else [found]:
            weights = [plain(x) * ((MORE if x.core else LESS) if marked else 1) for x in segment]
            for a, b in spans(weights, window, limit):
                for i in range(a, b):
                    alone = a < i < b - 1 and weights[i - 1] and weights[i + 1]
                    if weights[i] or alone:
                        kept.append(segment[i].text)
        if kept:
            break
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row, repeated ones too.

    Null or empty pages and pages without an article have an empty text. A page of any length is read
    whole, in time that grows with its length. Other columns are left out. No rows give no rows.
    """
    ready(pages.sparkSession)
    picked = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    ).withColumn("page_id", F.col("page_id").cast("long"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        def one(page_id, url, page):
            text = main_text(page)
            return page_id, url, text, len(text)

        return one

    return per_row(picked, ["page_id", "url", "html"], schema, "page_id long, url string, text string, n_chars long", make)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
