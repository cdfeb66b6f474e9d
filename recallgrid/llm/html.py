"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to one line per block element, and the elements around the lines are kept as a tree. The text lengths
of ``WINDOW`` lines from each line on are summed; where the sums surge and where they dive bound the dense stretches.
The densest stretch leads to its container, the innermost article, else main, else any element that holds nearly all of
its text, and an article's short first and last lines are kept with it. Where the container is no article or main, the
lines of all dense stretches under the container's parent are kept too, so adverts may part an article into siblings.

Menus, page headers, footers, sidebars, notices, adverts, forms and reader comments count as empty lines. They are told by
their elements and by class, id and role; the text decides where words may deceive: an element that holds most of the
text, of that in articles where there are any, isn't set aside for its class. A header within an article holds its title and stays.

A null, empty or blank page, and one without any text, give an empty text; equal pages equal texts; of stretches with
equal text the first counts. Pages of any length and depth are read whole in time that grows with their length. An empty
table gives an empty result, and columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import strings

WINDOW = 3
#: A window's characters at which text surges and below which it dives.
SURGE, DIVE = 60, 1
#: The share of the stretch's characters that the element to which its bounds are widened must hold.
HELD = 0.9
TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "fieldset", "input"}
#: Elements that can hold an article; the bounds of a stretch are never a single paragraph's.
HOLDERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
#: Words that set an element aside wherever a class, id or role has them, and words that do so alone or before a word for a box.
STRONG = re.compile(r"(?:^|[_-])(?:advert\w*|adsense|sponsor\w*|promo|nav|navbar|navigation|menu|submenu|sidebar|footer|masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|popup|modal|subscribe|newsletter|signup|login|social|related|recommended|recommendations?|comments?|commentlist|disqus|pagination|pager|widgets?|toolbar|complementary|contentinfo)(?:$|[_-])")
WEAK = re.compile(r"(?:site-?|page-?|global-?|main-?)?(?:ads?|side|aside|header|banner|notices?|share|sharing|search|copyright|legal|reply|replies|respond|discussion|responses|reactions)(?:[_-]?(?:bar|box|block|wrap|wrapper|container|section|area|list|form|links|buttons?|banner|panel|slot|unit|row|items?|thread|tools?|\d+))*")
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SPACE = re.compile(r"\s+")


def _set_aside(attributes: str) -> bool:
    words = " ".join(x.strip("\"'").lower() for x in ATTRIBUTE.findall(attributes)).split()
    return any(STRONG.search(w) or WEAK.fullmatch(w) for w in words)


class Page:
    """A page's lines and the tree of its block elements, both in page order; element 0 is the page."""

    def __init__(self, page: str) -> None:
        self.text: list[str] = []
        self.element: list[int] = []  # of each line
        self.name, self.parent = ["html"], [0]
        self.by_tag, self.by_class = [False], [False]  # whether an element is set aside
        self._parse(page)

    def _parse(self, page: str) -> None:
        stack, open_names = [0], Counter()
        buffer: list[str] = []
        articles = 0
        hidden: list[str] = []  # inline elements that are set aside, and those within them
        hidden_names = Counter()

        def flush() -> None:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                self.text.append(text)
                self.element.append(stack[-1])

        def close() -> None:
            nonlocal articles
            name = self.name[stack.pop()]
            open_names[name] -= 1
            articles -= name in ("article", "main")

        at, low = 0, page.lower()
        if len(low) != len(page):  # a character whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
        ends: dict[str, int] = {}  # no end of a raw element behind here
        for m in iter(lambda: TAG.search(page, at), None):
            if not hidden:
                buffer.append(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing = (m[1] or m[4]) == "/"
            attributes = m[3] or m[6] or ""
            alone = m[0].endswith("/>")
            if name in RAW:
                if not closing and not alone:
                    end = -1 if name in ends else low.find(f"</{name}", at)
                    if end < 0:
                        ends[name] = at
                        at = len(page)
                    else:
                        at = low.find(">", end) + 1 or len(page)
                continue
            if name in INLINE:
                if name == "br":
                    buffer.append(" ")
                elif name not in VOID and not alone:
                    if closing and hidden_names[name]:
                        last = ""
                        while last != name:
                            last = hidden.pop()
                            hidden_names[last] -= 1
                    elif not closing and (hidden or _set_aside(attributes)):
                        hidden.append(name)
                        hidden_names[name] += 1
                continue
            hidden.clear()  # a block ends what inline elements are open
            hidden_names.clear()
            flush()
            if name in VOID:
                continue
            if closing:
                if open_names[name]:
                    while self.name[stack[-1]] != name:
                        close()
                    close()
                continue
            if len(stack) > 1 and (self.name[stack[-1]] in CLOSED_BY.get(name, ()) or self.name[stack[-1]] == "p"):
                close()
            if alone:
                continue
            self.name.append(name)
            self.parent.append(stack[-1])
            self.by_tag.append(name in ASIDE or name == "header" and not articles)
            self.by_class.append(name not in ("html", "body", "main") and _set_aside(attributes))
            stack.append(len(self.name) - 1)
            open_names[name] += 1
            articles += name in ("article", "main")
        if not hidden:
            buffer.append(page[at:])
        flush()

    def held(self, sizes: list[int]) -> list[int]:
        """Each element's sum over the lines in it; an element's number is above its parent's."""
        out = [0] * len(self.name)
        for e, n in zip(self.element, sizes):
            out[e] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def aside(self) -> list[bool]:
        """Whether each element is set aside, by itself or by one around it."""
        tags, articles = [False] * len(self.name), [False] * len(self.name)
        for e in range(1, len(tags)):
            tags[e] = tags[self.parent[e]] or self.by_tag[e]
            articles[e] = articles[self.parent[e]] or self.name[e] in ("article", "main")
        sizes = [0 if tags[e] else len(t) for t, e in zip(self.text, self.element)]
        within = [n if articles[e] else 0 for n, e in zip(sizes, self.element)]
        held = self.held(within if any(within) else sizes)  # of the articles' text, where there are any
        out = [False] * len(tags)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or tags[e] or self.by_class[e] and 2 * held[e] <= held[0]
        return out


def stretches(sizes: list[int]) -> list[tuple[int, int]]:
    """First and last line but one of each stretch between a surge and the dive behind it."""
    n, out, i = len(sizes), [], 0
    blocks = [sum(sizes[i : i + WINDOW]) for i in range(n)]
    while i < n:
        if blocks[i] >= SURGE:
            j = i
            while j < n and blocks[j] >= DIVE:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def main_text(page: str) -> str:
    p = Page(page)
    aside = p.aside()
    sizes = [0 if aside[e] else len(t) for t, e in zip(p.text, p.element)]
    if not sum(sizes):
        return ""
    dense = stretches(sizes)
    # short pages have no surge
    best = max(dense, key=lambda x: (sum(sizes[x[0] : x[1]]), -x[0])) if dense else (0, len(sizes))
    held = p.held([n if best[0] <= i < best[1] else 0 for i, n in enumerate(sizes)])
    # the innermost article, else main, else any element that holds the stretch; an inner element has a higher number
    holders = [e for e in range(len(held)) if p.name[e] in HOLDERS and held[e] >= HELD * held[0]]
    inner = max(holders, key=lambda e: ({"article": 2, "main": 1}.get(p.name[e], 0), e))
    inside, around = [False] * len(held), [False] * len(held)
    for e in range(len(held)):
        inside[e] = e == inner or bool(e) and inside[p.parent[e]]
        around[e] = e == p.parent[inner] or bool(e) and around[p.parent[e]]
    keep = [inside[e] for e in p.element]
    if p.name[inner] not in ("article", "main"):
        for a, b in dense or [best]:
            for i in range(a, b):
                keep[i] = keep[i] or around[p.element[i]]
    return "\n".join(t for t, n, k in zip(p.text, sizes, keep) if n and k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in strings(batch, "html")]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")
