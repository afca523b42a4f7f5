"""Reading a page: bindings and visible prose."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

BINDING_ATTRIBUTE = "data-lineage"
# Fixed values of the format.
HIDDEN_TAGS = {"head", "script", "style", "noscript", "template"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What stands between < and > in markup that is read without a parser: a start tag with quoted attributes, an end tag, a doctype.
_TAG = re.compile(r"""(?P<tag>[a-z][a-z0-9]*)(?P<attrs>(?:[ \t\n]+[a-z][a-z-]*="[^"<>&]*")*)|/(?P<end>[a-z][a-z0-9]*)|!doctype html""")
_BOUND = re.compile(rf"""[ \t\n]{BINDING_ATTRIBUTE}="([^"]*)\"""")
#: Elements in which a parser looks for their end only; plain pages have one text in them at most.
_RAW = {"script", "style", "title", "textarea", "noscript", "xmp", "iframe", "noembed", "noframes"}


def collapse(text: str) -> str:
    return " ".join(text.replace("\ufeff", " ").split())


class Binding(NamedTuple):
    id: str
    text: str
    offset: int


class Prose(NamedTuple):
    text: str
    node: str | None
    ancestors: tuple[str, ...]
    offset: int


class _Reader(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.open: list[tuple[str, int | None, bool]] = []  # tag, its binding, whether hidden
        self.found: list[tuple[str, list[str], int]] = []
        self.prose: list[Prose] = []
        self.feed(html)
        self.close()

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        bound = None
        for name, value in attrs:
            if name == BINDING_ATTRIBUTE:
                bound = len(self.found)
                self.found.append((value or "", [], self._offset()))
                break
        if tag not in VOID_TAGS:
            hidden = tag in HIDDEN_TAGS or bool(self.open and self.open[-1][2])
            self.open.append((tag, bound, hidden))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        around = [b for _, b, _ in self.open if b is not None]
        for b in around:
            self.found[b][1].append(data)
        if not (self.open and self.open[-1][2]) and (text := collapse(data)):
            ids = tuple(self.found[b][0] for b in around)
            self.prose.append(Prose(text, ids[-1] if ids else None, ids, self._offset()))


def _tag(text: str) -> tuple[str, str | None, str | None, bool] | None:
    """Name, end's name, binding and whether its texts are hidden of what stands between < and >; None if it isn't plain."""
    if (m := _TAG.fullmatch(text)) is None or m["tag"] == "plaintext":
        return None
    bound = _BOUND.search(m["attrs"]) if m["attrs"] else None
    return m["tag"] or "", m["end"], bound and bound[1], m["tag"] in HIDDEN_TAGS


_known_tag = lru_cache(4096)(_tag)


def _plain(html: str, texts: bool = True, prose: bool = True, only: Callable[[str], object] | None = None) -> tuple[list[tuple[str, list[str], int]], list[Prose]] | None:
    """What ``_Reader`` finds, for pages of plain markup alone, or its bindings without their ``texts``, no ``prose``, or ``only`` some; None for others."""
    found: list[tuple[str, list[str], int]] = []
    runs: list[Prose] = []
    opened: list[tuple[str, int | None, bool]] = []
    around: list[int] = []
    hidden, raw = False, None
    code: list[str] | None = None  # of an open script
    pieces = iter(html.split("<"))
    tag, text, begin, at = None, next(pieces), 0, 0
    while True:
        # a text, from begin on
        if code is not None:
            code.append(text)
        elif text:
            if "&" in text:
                return None
            if texts:
                for b in around:
                    found[b][1].append(text)
            if prose and not hidden and (only is None or only(text)) and (said := collapse(text)):
                ids = tuple([found[b][0] for b in around])
                runs.append(Prose(said, ids[-1] if ids else None, ids, begin))
        at = begin + len(text)
        if (piece := next(pieces, None)) is None:
            return (found, runs) if raw is None else None
        if code is not None:
            if piece[:1] not in ("/", "!"):
                text, begin = "<" + piece, at
                continue
            if not piece.startswith("/script>"):
                return None
            if texts and (data := "".join(code)):
                for b in inside:
                    found[b][1].append(data)
            raw = code = None
            text, begin = piece[8:], at + 9
            continue
        tag, closed, text = piece.partition(">")
        if not closed or (read := _known_tag(tag) if len(tag) < 200 else _tag(tag)) is None:
            return None
        begin = at + len(tag) + 2
        name, end, bound, hides = read
        if end is not None:
            if raw is not None and end != raw:
                return None
            raw = None
            if opened and opened[-1][0] == end:
                if opened.pop()[1] is not None:
                    around = around[:-1]
                hidden = opened[-1][2] if opened else False
                continue
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == end:
                    del opened[k:]
                    around = [b for _, b, _ in opened if b is not None]
                    hidden = opened[-1][2] if opened else False
                    break
        elif raw is not None:
            return None
        elif name:
            mark = None
            if bound is not None:
                mark = len(found)
                found.append((bound, [], at))
            if name == "script":
                raw, code, inside = name, [], around if mark is None else [*around, mark]
                continue
            if name in _RAW:
                raw = name
            if name not in VOID_TAGS:
                hidden = hidden or hides
                opened.append((name, mark, hidden))
                if mark is not None:
                    around = [*around, mark]


def read_page(html: str) -> tuple[list[Binding], list[Prose]]:
    """Bindings in document order, and every visible text with the bindings around it."""
    if (read := _plain(html)) is None:
        reader = _Reader(html)
        read = reader.found, reader.prose
    return [Binding(i, collapse("".join(parts)), at) for i, parts, at in read[0]], read[1]


def bindings_of(html: str) -> list[Binding]:
    """``read_page``'s bindings."""
    found = _Reader(html).found if (read := _plain(html, prose=False)) is None else read[0]
    return [Binding(i, collapse("".join(parts)), at) for i, parts, at in found]


def prose_of(html: str, only: Callable[[str], object]) -> list[Prose]:
    """``read_page``'s texts of which ``only`` holds; white space must not matter to it."""
    if (read := _plain(html, texts=False, only=only)) is None:
        return [p for p in _Reader(html).prose if only(p.text)]
    return read[1]


def bound_ids(html: str) -> list[str]:
    """The ids of ``read_page``'s bindings."""
    if (read := _plain(html, texts=False, prose=False)) is None:
        return [i for i, _, _ in _Reader(html).found]
    return [i for i, _, _ in read[0]]


def counted(prose: list[Prose], keeps: Callable[[str], bool]) -> list[Prose]:
    """Prose whose every binding is one that ``keeps`` its text in view."""
    return [p for p in prose if all(map(keeps, p.ancestors))]
