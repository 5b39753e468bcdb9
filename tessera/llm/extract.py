"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Two kinds of elements are taken out first: those whose tag says that
they hold something beside the article (menus, headers, footers, sidebars, forms, scripts), and those with a class, id or
role that is, as a whole, one of ``BESIDE`` or ``PERHAPS``, where the page's text agrees. An element of ``BESIDE`` stays
where the rest of the page has no article or first heading and less text than it; one of ``PERHAPS`` also stays where its
lines are dense enough to surge.

The rest is judged by its distribution. A line weighs its length, or nothing if it is mostly links; weights are summed over
sliding windows of ``window`` lines inside a run: the lines of one ``article`` or ``main``, or those between two of them.
A run surges where a sum reaches the threshold and dives behind the last line of the last such window. Runs without a
surge are dropped. Of a run outside articles everything from its first surge to its last dive is kept, short lines too, but
for two or more lines of links on end; in an article a surge spreads to the article's edges. The threshold is ``surge``
characters, or half the largest sum of the page's articles if that is less; without an article, half that of the page.

Character references are decoded after markup is gone; white space in a block becomes one space; blocks are joined by
line feeds. Text is never cut or capped.

Nulls: a null or empty page has an empty text and n_chars 0. Unclosed elements end with the element around them. A raw
element (``svg``, ``object`` and the like) that closes itself or has no end tag is skipped alone, but for scripts and styles.
Repeated rows are extracted each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas"}
#: Raw elements that run to the end of the page where they have no end tag, and that a slash does not close.
SCRIPT = {"script", "style"}
#: The end of the attributes of a tag that closes itself; a slash inside an unquoted value is part of it.
EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$|(?:^|\s)[^\s=/]+/\s*$")
ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "select", "button", "head", "label", "datalist"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption", *ASIDE,
} - {"label", "button"}
ARTICLE = {"article", "main"}
#: Elements that an open one of the same kind ends.
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "option"}
#: Whole classes, ids and roles of what stands beside a text.
BESIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "ad-banner", "ad-box", "ad-container", "ad-slot", "sponsored",
    "sponsor", "promo", "promoted", "banner-ad", "sidebar", "side-bar", "left-sidebar", "right-sidebar", "nav", "navbar",
    "navigation", "main-nav", "top-nav", "site-nav", "menu", "main-menu", "top-menu", "site-menu", "menubar", "breadcrumb",
    "breadcrumbs", "pagination", "pager", "site-header", "page-header", "masthead", "site-footer", "page-footer", "footer",
    "contentinfo", "complementary", "comments", "comment", "comment-list", "commentlist", "comments-section", "comments-area",
    "user-comments", "reader-comments", "disqus", "disqus_thread", "replies", "cookie", "cookies", "cookie-notice",
    "cookie-banner", "cookie-consent", "cookie-bar", "consent", "gdpr", "newsletter", "newsletter-signup", "subscribe",
    "subscription", "popup", "modal", "toolbar", "share-buttons", "social-links", "social-share", "related-posts",
    "related-articles",
}
#: Names that a part of a text may also have.
PERHAPS = {
    "alert", "banner", "header", "login", "notice", "notices", "related", "search", "share", "sharing", "signup", "social",
    "widget", "tags", "skip", "skip-link",
}
WINDOW, SURGE = 3, 86


@dataclass
class Line:
    text: str
    weight: int
    section: int  # the number of the article, 0 outside
    heading: bool
    gone: bool = False


def _named(attributes: str) -> set[str]:
    """Which of BESIDE and PERHAPS the element is named."""
    found = {x for _, *values in ATTRIBUTE.findall(attributes) for x in "".join(values).lower().split()}
    return found & (BESIDE | PERHAPS)


def lines(page: str) -> list[Line]:
    """The lines of a page; ``gone`` marks those of elements beside the text."""
    out: list[Line] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, int]] = []  # name, beside by its tag, article, its place in the named elements
    beside, section, sections = False, 0, 0
    named: list[list] = []  # first line, line after the last, whether the name is one of BESIDE
    endless: set[str] = set()  # raw elements with no end tag in the rest of the page

    def end() -> None:
        nonlocal text, linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            heading = any(x[0] == "h1" for x in stack)
            if line:
                out.append(Line(line, 0 if 2 * linked > len(line) else len(line), section, heading, beside))
            text, linked = [], 0

    def pop(k: int) -> None:
        nonlocal beside, section
        end()
        for x in stack[k:]:
            if x[3] >= 0:
                named[x[3]][1] = len(out)
        del stack[k:]
        beside, section = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        piece = page[at : found.start() if found else size]
        if piece:
            text.append(piece)
            if any(x[0] == "a" for x in stack[-4:]):
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        closing, name, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not name:
            continue
        if closing:
            if name in BLOCK:
                end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    changed = stack[k][1] != (k > 0 and stack[k - 1][1])
                    if name in BLOCK or changed or any(x[0] in BLOCK or x[3] >= 0 for x in stack[k:]):
                        pop(k)
                    else:
                        del stack[k:]
                    break
                # an inline end does not reach out of its block, nor a block's end out of the article
                if stack[k][0] in ARTICLE and name not in ("body", "html") or name not in BLOCK and stack[k][0] in BLOCK:
                    break
        elif name in RAW:
            if name in SCRIPT or name not in endless and not EMPTY.search(attributes):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else size if name in SCRIPT else at
                if not stop:
                    endless.add(name)
        elif name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                end()
        else:
            if name in BLOCK:
                end()
                if name in SELF_ENDING:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            pop(k)
                            break
                        if stack[k][0] in BLOCK:
                            break
            elif name in ("td", "th"):
                text.append(" ")
            aside = name in ASIDE or name == "header" and not section
            names = _named(attributes) if "=" in attributes and name not in ("html", "body") else set()
            if aside and not beside or names:
                end()
            if name in ARTICLE and not section and not beside and not aside:
                end()
                sections += 1
                section = sections
            beside = beside or aside
            if names:
                named.append([len(out), -1, bool(names & BESIDE)])
            stack.append((name, beside, section, len(named) - 1 if names else -1))
    end()
    for span in named:
        _judge_named(out, span[0], span[1] if span[1] >= 0 else len(out), span[2])
    return out


def _judge_named(out: list[Line], first: int, last: int, surely: bool) -> None:
    """Takes the lines of an element with a telling name out, where the page's text agrees."""
    own = out[first:last]
    if not surely and max(_sums([x.weight for x in own if not x.gone], WINDOW), default=0) >= SURGE:
        return
    rest = [x for part in (out[:first], out[last:]) for x in part if not x.gone]
    if any(x.section or x.heading for x in rest) or sum(len(x.text) for x in rest) >= sum(len(x.text) for x in own):
        for x in own:
            x.gone = True


def _sums(weights: list[int], window: int) -> list[int]:
    """The sum of the window that begins at each place; windows at the end are shorter."""
    total = [0, *accumulate(weights)]
    return [total[min(i + window, len(weights))] - total[i] for i in range(len(weights))]


def between(found: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines from surges to dives."""
    runs = [list(part) for _, part in groupby((x for x in found if not x.gone), lambda x: x.section)]
    sums = [_sums([x.weight for x in run], window) for run in runs]
    peak = max((max(s) for run, s in zip(runs, sums, strict=True) if run[0].section), default=0)
    inside = min(surge, peak / 2)
    outside = surge if peak else min(surge, max((max(s) for s in sums), default=0) / 2)
    kept = []
    for run, total in zip(runs, sums, strict=True):
        article = run[0].section > 0
        high = [i for i, t in enumerate(total) if t and t >= (inside if article else outside)]
        if not high:
            continue
        if article:
            kept += [x.text for x in run]
            continue
        # the first window that is high may begin with lines that weigh nothing
        part = run[high[0] : high[-1] + window]
        while not part[0].weight:
            del part[0]
        while not part[-1].weight:
            del part[-1]
        for weighs, group in groupby(part, lambda x: x.weight > 0):
            group = list(group)
            if weighs or len(group) < 2:
                kept += [x.text for x in group]
    return kept


def main_text(page: str | None) -> str:
    return "\n".join(between(lines(page))) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in blocks(batches, "html", 4 << 20):
            texts = [main_text(x.decode("utf-8", "replace")) if x else "" for x in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col("page_id").cast("long"), "url", "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
