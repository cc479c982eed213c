"""Main text of web pages by the distribution of text over lines.

Markup is stripped and every block element becomes a line. A line counts its characters, or none if it
is boilerplate: inside navigation, header, footer, sidebar, form, advert, notice or comments (by element,
role, class or id), outside the article element where the page has one, or a short one made of links. Lengths are
summed over a sliding window of lines. Text surges where a sum reaches ``SURGE`` and dives where it is
back at zero; the stretch between, grown to the lines with text before the surge, is kept. Each article
is a distribution of its own, with a lower surge; an article whose highest sum is small beside the page's
highest (a teaser card, a related story) is not kept.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed elements end with
the page, except that an article ends any open boilerplate; a page cut inside a tag loses that tag only;
repeated rows give equal rows; only the three named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

WINDOW, SURGE, LINK_SHARE = 3, 80, 0.6
#: Within articles: where text surges, and the least share of the page's highest window sum that an article must reach.
ARTICLE_SURGE, PEAK_SHARE = 20, 0.2
# Elements that open a line, that hold no text of the page, and that hold none of the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
                   "table tbody tfoot thead tr ul".split())
BOILERPLATE = frozenset("nav aside form footer header button menu dialog label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names of boilerplate; the second list only outside an article.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
                  "consent gdpr notice notification popup modal overlay newsletter subscribe subscription sidebar sidenav menu nav navbar "
                  "navigation breadcrumb breadcrumbs comment comments respond disqus replies share sharing social related recommended widget "
                  "toolbar login signin signup search pagination pager hidden".split())
OUTER_NAMES = frozenset("header footer masthead topbar bottom copyright legal side alert".split())
# Elements whose content is no markup, which run to the end of the page if nothing closes them.
TEXT_ONLY = frozenset("script style title textarea".split())
_RAW = re.compile(r"""<!--|<(script|style|title|textarea)\b(?:"[^"]*"|'[^']*'|[^'">])*+>|<(noscript|template|svg|annotation|annotation-xml|iframe|object|canvas|audio|video|select)(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*+>(?<!/>)""", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)\Z""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
EXTRACTED = "page_id long, url string, text string, n_chars long"


def _is_boilerplate(name: str, attributes: str, inside: bool) -> bool:
    if name in BOILERPLATE and not (name in ("header", "label") and inside):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id") and name not in ("body", "html", *CONTENT):
            words = {w.lower() for w in _NAME_WORD.findall(value)}
            if words & NAMES or not inside and words & OUTER_NAMES:
                return True
        if key in ("class", "id") and name in CONTENT and {w.lower() for w in _NAME_WORD.findall(value)} & {"comment", "comments", "reply"}:
            return True
    return False


def without_raw(page: str) -> str:
    """The page without comments and elements that hold none of its text; what nothing closes loses its tag only, but for ``TEXT_ONLY``."""
    parts: list[str] = []
    unclosed: set[str] = set()
    at = 0
    while m := _RAW.search(page, at):
        name = (m[1] or m[2] or "").lower()
        parts += [page[at:m.start()], " " if name else ""]
        if name in unclosed:
            at = m.end()
            continue
        end = re.compile(rf"</{name}\s*>" if name else "-->", re.I).search(page, m.end())
        if end:
            at = end.end()
        elif name and name not in TEXT_ONLY:
            unclosed.add(name)
            at = m.end()
        else:
            at = len(page)
    return "".join([*parts, page[at:]])


def lines_of(page: str) -> tuple[list[str], list[bool], list[int], list[float], dict[int, int]]:
    """Lines of text; for each whether it is boilerplate, the number of the article it lies in or 0, and the share of link text; the article around each."""
    page = _COMMENT.sub("", without_raw(page))
    lines: list[str] = []
    spare: list[bool] = []
    content: list[int] = []
    parents: dict[int, int] = {}
    open_: list[int] = []
    links: list[float] = []
    parts: list[str] = []
    linked = total = 0
    skip, depth, in_link = "", 0, False

    def close() -> None:
        nonlocal linked, total
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(text)
            spare.append(bool(skip))
            content.append(open_[-1] if open_ else 0)
            links.append(linked / max(total, 1))
        parts.clear()
        linked = total = 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            size = len(piece.strip())
            total += size
            linked += size if in_link else 0
        at = m.end()
        end, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6) if m[5] else m.group(7, 8, 9)
        name = name.lower()
        if name == "a":
            in_link = not end
        if name in ("br", "td", "th", "img"):
            parts.append(" ")
        if name in BLOCKS:
            close()
        if end:
            if skip == name:
                depth -= 1
                if depth == 0:
                    close()
                    skip = ""
            elif name in CONTENT and not skip:
                del open_[-1:]
            continue
        if name in VOID:
            continue
        if name in CONTENT and not _is_boilerplate(name, attributes, bool(open_)):
            close()
            skip, depth = "", 0
            parents[len(parents) + 1] = open_[-1] if open_ else 0
            open_.append(len(parents))
            continue
        if skip:
            if name == skip:
                if name in ("p", "li"):
                    skip, depth = "", 0
                else:
                    depth += 1
                    continue
            else:
                continue
        if _is_boilerplate(name, attributes, bool(open_)):
            close()
            skip, depth = name, 1
    parts.append(page[at:])
    close()
    return lines, spare, content, links, parents


def _stretches(weight: np.ndarray, least: int) -> np.ndarray:
    """Lines between a surge of the window sums to ``least`` and the dive to zero, grown to the lines with text before the surge."""
    sums = np.convolve(weight, np.ones(WINDOW, int))[WINDOW - 1:]  # over each line and the next ones
    keep = np.zeros(len(weight), bool)
    i = 0
    limit = min(least, int(sums.max()))
    while i < len(weight) and limit > 0:
        if sums[i] < limit:
            i += 1
            continue
        dive = i
        while dive < len(weight) and sums[dive] > 0:
            dive += 1
        surge = i
        while surge > 0 and sums[surge - 1] > 0:
            surge -= 1
        keep[surge:dive] = True
        i = dive
    return keep


def main_text(page: str) -> str:
    """The stretches of lines between surges and dives, joined by empty lines."""
    lines, spare, content, links, parents = lines_of(page)
    if not lines:
        return ""
    weight = np.array([len(x) for x in lines])
    weight[np.array(spare)] = 0
    article = np.array(content)
    if ((article > 0) & (weight > 0)).any():
        weight[article == 0] = 0
        keep = np.zeros(len(lines), bool)
        of = {a: np.flatnonzero(article == a) for a in sorted(set(content) - {0})}
        peak = {a: int(np.convolve(weight[at], np.ones(WINDOW, int)).max()) for a, at in of.items()}
        for a, at in of.items():
            if peak[a] >= PEAK_SHARE * max(peak.values()):
                keep[at] = _stretches(weight[at], ARTICLE_SURGE)
        for i in np.flatnonzero((article[:-1] > 0) & (article[1:] > article[:-1]))[::-1]:  # short heading of an element before the article in it
            if keep[i + 1] and parents.get(content[i + 1]) == content[i]:
                keep[max(0, i - 1):i + 1] |= article[max(0, i - 1):i + 1] == article[i]
    else:
        for i, (line, share) in enumerate(zip(lines, links)):
            if share > LINK_SHARE and len(line) < SURGE or re.match(r"(©|\(c\)|copyright\b|all rights reserved)", line, re.I):
                weight[i] = 0
        keep = _stretches(weight, SURGE)
    return "\n\n".join(line for line, k, w in zip(lines, keep, weight) if k and w > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), run, EXTRACTED)
