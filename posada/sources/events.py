"""Pages read as a stream of parser events: no tree is built, only the open elements are held, and the text that a reader still needs."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Elements without content, and those whose content is no text of a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = ("script", "style")
#: What stands for the name of the page itself, which holds all elements.
PAGE = "#page"


class Element:
    """An element: its number in page order, and its first and last piece of text (``end`` from its close on). The rest is for readers."""

    __slots__ = ("tag", "attrs", "number", "start", "end", "card", "waiting", "last", "before", "bold", "roles", "inner")

    def __init__(self, tag: str, attrs: dict[str, str], number: int, start: int):
        self.tag, self.attrs, self.number, self.start, self.end = tag, attrs, number, start, start
        self.card = self.bold = None
        self.waiting: list | None = None
        self.last: dict[str, str] | None = None
        self.before = ""
        self.roles: list[str] | None = None
        self.inner = 0


class Reader(HTMLParser):
    """Calls ``opened`` with each element before its content and ``closed`` after it.

    An end tag closes the nearest open element of its name and all within it; without one it is ignored. What is open at
    the end of the page is closed there, the page itself (number 0) at last. Data is kept in ``pieces`` while ``keeps``.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element(PAGE, {}, 0, 0)]
        self.names: Counter[str] = Counter()
        self.count = self.silent = 0
        self.pieces: list[str] = []
        self.keeps = False

    def opened(self, x: Element) -> None: ...

    def closed(self, x: Element) -> None: ...

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        x = Element(tag, {k: v or "" for k, v in attrs}, self.count, len(self.pieces))
        self.opened(x)
        if tag in VOID:
            self.closed(x)
            return
        x.start = x.end = len(self.pieces)
        self.open.append(x)
        self.names[tag] += 1
        self.silent += tag in SILENT

    def _end(self) -> Element:
        x = self.open.pop()
        self.names[x.tag] -= 1
        self.silent -= x.tag in SILENT
        x.end = len(self.pieces)
        self.closed(x)
        return x

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            while self._end().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.keeps and not self.silent:
            self.pieces.append(data)

    def read(self, html: str | None) -> None:
        """Reads a whole page."""
        self.feed(html or "")
        self.close()
        while self.open:
            self._end()

    def text(self, x: Element) -> str:
        """The text of a closed element, blanks collapsed."""
        return " ".join(" ".join(self.pieces[x.start : x.end]).split())
