"""Main text of web pages by text-to-tag ratios.

The parser's events are streamed into lines: a block element begins a new line, and each line has its text,
its number of tags and the containers around it. The ratio of text to tags per line is smoothed with a
Gaussian kernel; lines at or above the threshold (the standard deviation of the smoothed ratios) are one
cluster, the others the second one. The innermost container that holds nearly all text of the first cluster
is widened to the article or else the main element around it; where there is neither, the region is the
innermost container that holds the whole first cluster and the h1 headings. Within the region every line
stays, short ones too; runs of short links go where no article or main element bounds the region. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by
element, role and class wherever they stand, but a form or a class that holds most of the text in several
blocks, with no h1, article or main outside, is a layout and stays, and so does a header by class that holds the
only h1. Omitted end tags are implied as in HTML.

Null, empty and wholly boilerplate pages give an empty text. Unclosed elements and truncated pages are read
as far as they go. Repeated rows are each extracted; columns besides the three used are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("script style noscript template iframe object svg canvas head title nav footer aside form button select textarea menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv adbox advert adverts advertisement advertising adslot adsense banner banners promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond discussion sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar "
    "masthead toolbar share sharing social widget widgets login search pagination pager footer skip copyright alert".split()
)
#: Names of lists of other pages, alone or with one of the words after them.
OTHERS, OTHERS_OF = frozenset("related recommended recommendations".split()), frozenset("posts post articles article links stories story items content products news reading list box block section widget pages videos".split())
#: Names of a page's header, alone or with one of the words after them; it stays if it has the only h1.
HEADERS, HEADERS_OF = frozenset(["header"]), frozenset("site top global main web blog inner nav bar fixed sticky".split())
#: Words that make a compound with a name, as in "cookie-box" or "sidebar-right"; with any other word a name is part of a topic, as in "social-history".
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons center close col column content count cta desktop fixed floating form google header icon icons id info inline inner item items js left link links list "
    "main message mobile nav note panel policy pop post primary right row secondary section site slot small sticky tag text title toggle top unit up view wrap zone".split()
)
#: Names that an article's own blocks bear as well: there they are left out only if most of their text is links.
COMMON = frozenset("alert copyright discussion rail replies reply respond search side skip toolbar widget widgets".split())
#: Left out without ending the line around them.
INLINE_OUT = frozenset("script style template iframe object svg canvas button select textarea".split())
#: The group of text inside such an element.
MUTE = -2
#: With one of these a name tells of a layout around the content, as in "with-sidebar".
LAYOUT = frozenset("has with no without layout wrapper container page".split())
#: Left out only if the page's text is elsewhere.
SOFT = frozenset(["form"])
#: Start tags that do not end an open paragraph, and those that may stand in a head.
IN_P = frozenset("body head html legend noscript option optgroup select tbody td tfoot th thead title tr frameset".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
#: Open elements that the start of the key ends, and those that keep it from looking further out.
_LISTS = BLOCKS - frozenset("address div p li dt dd".split())
IMPLIED = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), _LISTS),
    "dd": (frozenset(["dt", "dd"]), _LISTS),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    **dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset("tbody td tfoot th thead tr".split()), frozenset(["table"]))),
}
CONTAINERS = frozenset("article main section div td body html blockquote".split())
_CLASS_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Share of the first cluster's text that the container holds at least from which an article or main element is looked for.
SHARE = 0.9


class Lines(HTMLParser):
    """Collects lines as [text parts, tags, container, group left out or -1, length of link text, whether in an h1]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        #: Open elements as (tag, container, group, link, h1), the last four as they hold inside.
        self.open: list[tuple[str, int, int, bool, bool]] = []
        self.many: Counter[str] = Counter()
        self.parents: dict[int, int] = {0: -1}
        self.tags: dict[int, str] = {0: ""}
        #: Groups of lines left out, as (group around it, kind).
        self.groups: list[tuple[int, str]] = []
        self.begin()

    def inner(self) -> tuple[str, int, int, bool, bool]:
        return self.open[-1] if self.open else ("", 0, -1, False, False)

    def begin(self) -> None:
        _, at, group, _, h1 = self.inner()
        if group == MUTE:
            return
        if self.lines and not self.lines[-1][0]:
            self.lines.pop()
        self.lines.append([[], 0, at, group, 0, h1])

    def cut(self, at: int) -> None:
        """Ends the open elements from a place on."""
        group = self.inner()[2]
        for tag, *_ in self.open[at:]:
            self.many[tag] -= 1
        del self.open[at:]
        if MUTE not in (group, self.inner()[2]) and self.inner()[2] != group:
            self.begin()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end goes on to the end of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def place(self, tags: frozenset[str], stops: frozenset[str]) -> int:
        """The place of the innermost open element of the tags, -1 if there is none or it stands outside one of the stops."""
        if any(self.many[t] for t in tags):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in tags:
                    return i
                if self.open[i][0] in stops:
                    return -1
        return -1

    def imply(self, tag: str) -> None:
        """Ends what HTML ends where the tag starts."""
        if self.many["head"] and tag not in IN_HEAD and self.open[-1][0] in ("head", "title"):
            self.cut(self.place(frozenset(["head"]), frozenset()))
        if tag in BLOCKS and tag not in IN_P and (at := self.place(frozenset(["p"]), TABLE | {"button"})) >= 0:
            self.cut(at)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            while (at := self.place(ends, stops)) >= 0:
                self.cut(at)
        if tag == "a":
            self.end_inline("a")

    def end_inline(self, tag: str) -> None:
        """Ends an inline element alone: blocks that were opened in it stay open."""
        at = self.place(frozenset([tag]), TABLE)
        if at < 0:
            return
        if not any(t in BLOCKS for t, *_ in self.open[at + 1 :]):
            self.cut(at)
        elif tag == "a":
            self.many[tag] -= 1
            self.open[at:] = [(t, c, g, False, h) for t, c, g, _, h in self.open[at + 1 :]]

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """"hard", "soft" (may turn out to be a layout), "header" (may turn out to have the title), "links" (goes if it is mostly links) or nothing."""
        if tag in LEFT_OUT - SOFT or tag == "header" and not (self.many["article"] or self.many["main"]):
            return "hard"
        if tag in ("body", "html", "article", "main"):
            return ""
        found = "soft" if tag in SOFT else ""
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in ROLES:
                return "hard"
            if name in ("class", "id"):
                inside = bool(self.many["article"] or self.many["main"])
                kinds = {self.boilerplate(part) for part in (value or "").split()}
                if "common" in kinds:
                    kinds.add("links" if inside else "soft")
                found = "soft" if "soft" in kinds else found or ("header" if "header" in kinds and not inside else "links" if "links" in kinds else "")
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I):
                return "hard"
        return found

    @staticmethod
    def boilerplate(name: str) -> str:
        words = {w.lower() for w in _CLASS_WORDS.findall(name)}
        if words & LAYOUT:
            return ""
        of = lambda names, more: bool(words & names) and (words <= names or bool(words & more))
        names = {w for w in words if not w.isdigit()}
        if words & NAMES and names <= NAMES | BESIDE:
            return "soft" if words & (NAMES - COMMON) else "common"
        return "soft" if of(OTHERS, OTHERS_OF) else "header" if of(HEADERS, HEADERS_OF) else ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.imply(tag)
        block = tag in BLOCKS
        if tag not in VOID:
            _, at, group, link, h1 = self.inner()
            if group == MUTE:
                block = False
            elif tag in INLINE_OUT:
                group = MUTE
            elif (group < 0 or self.groups[group][1] != "hard") and (kind := self.unwanted(tag, attrs)):
                self.groups.append((group, kind))
                group = len(self.groups) - 1
                block = True
            if tag in CONTAINERS:
                self.parents[len(self.tags)] = at
                at = len(self.tags)
                self.tags[at] = tag
            self.open.append((tag, at, group, link or tag == "a" and any(name == "href" for name, _ in attrs), h1 or tag == "h1"))
            self.many[tag] += 1
        if block:
            self.begin()
        if tag == "br":
            self.lines[-1][0].append(" ")
        self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        if tag in ("body", "html"):  # what follows still belongs to the open elements
            return
        if tag not in BLOCKS:
            self.end_inline(tag)
            return
        at = self.place(frozenset([tag]), frozenset(["table"]) if tag in TABLE else TABLE)
        if at >= 0:
            self.cut(at)
        self.begin()

    def handle_data(self, data: str) -> None:
        if self.inner()[2] == MUTE:
            return
        line = self.lines[-1]
        line[0].append(data)
        if self.inner()[3]:
            line[4] += len(data)

    def left_out(self, lines: list[tuple]) -> list[bool]:
        """By line, whether a group leaves it out. A group that may be a layout is one if it has most of the text in several blocks, and no h1, article or main stands outside; a header stays if it has all h1 lines, and one that goes for its links if less than half of its text is links.

        Groups and containers are numbered as they begin, so that one pass from the last to the first sums up what stands in each.
        """
        hard: list[bool] = []
        for around, kind in self.groups:
            hard.append(kind == "hard" or around >= 0 and hard[around])
        anchored: list[bool] = []
        for at in range(len(self.tags)):
            anchored.append(self.tags[at] in ("article", "main") or self.parents[at] >= 0 and anchored[self.parents[at]])
        n = len(self.groups)
        own, size, blocks, first, titles, linked = (np.zeros(n, np.int64) for _ in range(6))
        whole = anchors = headings = 0
        for text, _, at, group, links, h1 in lines:
            if group >= 0 and hard[group]:
                continue
            length = max(0, len(text) - links)
            anchor = h1 or anchored[at]
            whole, anchors, headings = whole + length, anchors + anchor, headings + h1
            if group >= 0:
                for total, value in ((own, len(text)), (size, length), (blocks, length >= 40), (first, anchor), (titles, h1), (linked, links)):
                    total[group] += value
        for g in range(n - 1, -1, -1):
            if (around := self.groups[g][0]) >= 0:
                for total in (own, size, blocks, first, titles, linked):
                    total[around] += total[g]
        stays: list[bool] = []
        for g, (around, kind) in enumerate(self.groups):
            layout = not hard[g] and own[g] and 2 * size[g] > whole and blocks[g] >= 3 and first[g] == anchors
            keeps = layout or kind == "header" and 0 < titles[g] == headings or kind == "links" and 2 * linked[g] < own[g]
            stays.append(bool(keeps) and (around < 0 or stays[around]))
        return [group >= 0 and not stays[group] for _, _, _, group, _, _ in lines]


def smoothed(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """The ratios under a Gaussian kernel whose deviation is the radius; borders see the part of the kernel that lies inside."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * radius**2))
    near = np.convolve(np.pad(ratios, radius), kernel, "valid")
    return near / np.convolve(np.pad(np.ones(len(ratios)), radius), kernel, "valid")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(" ".join("".join(parts).split()), *rest) for parts, *rest in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, *_ in lines]))
    threshold = float(ratios.std())
    wanted = [i for i, out in enumerate(parser.left_out(lines)) if not out]
    dense = [i for i in wanted if ratios[i] >= threshold] or wanted
    depth: dict[int, int] = {}
    for c in parser.parents:
        depth[c] = 0 if parser.parents[c] < 0 else depth[parser.parents[c]] + 1

    def around(chosen: list[int], share: float) -> int:
        """The innermost container with a share of the chosen lines' text."""
        weight = [0] * len(parser.tags)
        for i in chosen:
            weight[lines[i][2]] += len(lines[i][0])
        for c in range(len(weight) - 1, 0, -1):
            weight[parser.parents[c]] += weight[c]
        return max((c for c, w in enumerate(weight) if w and w >= share * weight[0]), key=lambda c: (depth[c], weight[c]), default=0)

    at, outer = around(dense, SHARE), {}
    while at >= 0:
        outer[parser.tags[at]] = at
        at = parser.parents[at]
    bounded = "article" in outer or "main" in outer
    region = outer.get("article", outer.get("main", 0)) if bounded else around(sorted({*dense, *(i for i in wanted if lines[i][5])}), 1)

    within: list[bool] = []
    for c in range(len(parser.tags)):
        within.append(c == region or c > 0 and within[parser.parents[c]])

    kept = [(i, lines[i][0], lines[i][4] >= 0.9 * len(lines[i][0])) for i in wanted if within[lines[i][2]]]
    out, k = [], 0
    while k < len(kept):
        end = k
        while end < len(kept) and kept[end][2]:
            end += 1
        if end - k >= 3 and not bounded and sum(len(text.split()) for _, text, _ in kept[k:end]) < 5 * (end - k):  # a list of short links is a menu
            k = end
            continue
        end = max(end, k + 1)
        out += [text for _, text, _ in kept[k:end]]
        k = end
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: the id, url, text and n_chars (code points). One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.pieces(batches, "html"):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    found = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return found.toDF(id_col, url_col, "text", "n_chars")
