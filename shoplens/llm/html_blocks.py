"""Leaf blocks of HTML pages: runs of text between the borders of block elements, with what surrounds them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Element names of HTML.
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td textarea tfoot th thead title tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never rendered.
SILENT_TAGS = frozenset("script style template iframe noembed noframes annotation annotation-xml desc metadata".split())
#: Their content is text like any other. Like those of silent elements, their end tags close what is left open inside.
EMBEDDING_TAGS = frozenset("noscript object svg math canvas audio video map".split())
_CLOSES_ALL = SILENT_TAGS | EMBEDDING_TAGS
#: An implied end does not leave an open element of these.
_ENCLOSED = SILENT_TAGS | {"object", "svg"}
#: An open element of the key is closed by a start tag of the values.
_CLOSED_BY = {
    "p": BLOCK_TAGS - {"button", "caption", "body", "html", "head", "legend", "option", "optgroup", "td", "th", "tr", "title"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
#: Such an implied end does not reach beyond an open element of these.
_WALLS = frozenset("table ul ol dl div section article aside nav main header footer form blockquote fieldset".split())


#: Ancestors that tell what a block is part of.
TELLING_TAGS = frozenset("article main nav aside footer header form".split())
_OUTER = ("html", "body")


class Path:
    """The open elements of a block as a chain to the parent's chain, with what features need kept up to date:
    the set of tags, the innermost tag other than html and body, the innermost telling tag. Making one costs
    the same at any depth; iterating gives the tags outermost first."""

    __slots__ = ("tag", "up", "tag_set", "parent", "near")

    def __init__(self, tag: str, up: Path | None):
        self.tag, self.up = tag, up
        below = up.tag_set if up is not None else frozenset()
        self.tag_set = below if tag in below else below | {tag}
        self.parent = tag if tag not in _OUTER else (up.parent if up is not None else "")
        self.near = tag if tag in TELLING_TAGS else (up.near if up is not None else "")

    def __iter__(self):
        out, node = [], self
        while node is not None:
            out.append(node.tag)
            node = node.up
        return iter(reversed(out))


class Block:
    """text: white space is one blank, trimmed; tags: open elements, outermost first (made from a Path only when
    asked for); names: parts of their classes, ids and roles; link_chars: characters of the text inside links."""

    __slots__ = ("text", "_tags", "names", "link_chars")

    def __init__(self, text: str, tags: tuple[str, ...] | Path | None, names: frozenset[str], link_chars: int):
        self.text, self._tags, self.names, self.link_chars = text, tags, names, link_chars

    @property
    def tags(self) -> tuple[str, ...]:
        return tuple(self._tags) if self._tags is not None else ()

    def __repr__(self) -> str:
        return f"Block({self.text!r}, {self.tags!r}, {set(self.names)!r}, {self.link_chars})"

    def _summary(self) -> tuple[frozenset, str, str]:
        if isinstance(self._tags, Path):
            return self._tags.tag_set, self._tags.parent, self._tags.near
        inner = [t for t in self.tags if t not in _OUTER]
        return (frozenset(self.tags), inner[-1] if inner else "",
                next((t for t in reversed(inner) if t in TELLING_TAGS), ""))

    @property
    def inner_tags(self) -> frozenset[str]:
        """Open tags other than html and body."""
        return self._summary()[0] - set(_OUTER)

    @property
    def parent(self) -> str:
        return self._summary()[1]

    @property
    def near(self) -> str:
        return self._summary()[2]


def _name_parts(attributes: list[tuple[str, str | None]]) -> frozenset[str]:
    given = " ".join(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v) for k, v in attributes if k in ("class", "id", "role") and v)
    return frozenset(p for p in re.split(r"[^a-z]+", given.lower()) if p) if given else frozenset()


#: For a start tag, the open elements it may close.
_CLOSES = {}
for _key, _closers in _CLOSED_BY.items():
    for _tag in _closers:
        _CLOSES.setdefault(_tag, []).append(_key)


class _BlockParser(HTMLParser):
    """Open elements are a stack; for each tag name the places where it is open, and the places of open walls,
    are kept beside it, so that a start or end tag finds what it closes, or what stops it, without a walk."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, frozenset[str], Path]] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.barriers: list[int] = []
        self.pieces: list[str] = []
        self.linked, self.silent, self.links = 0, 0, 0

    # declarations the standard parser rejects or leaves open are comments, as browsers read them
    def parse_html_declaration(self, i):
        rawdata = self.rawdata
        if rawdata.startswith("<!--", i):
            ends = [e for e in (rawdata.find("-->", i + 4), rawdata.find("--!>", i + 4)) if e >= 0]
            if not ends:
                return len(rawdata)  # a comment never closed runs to the end of the page
            end = min(ends)
            return end + (3 if rawdata.startswith("-->", end) else 4)
        if rawdata[i:i + 9].lower() == "<!doctype":
            close = rawdata.find(">", i)
            bracket = rawdata.find("[", i)
            if 0 <= bracket < close or (close < 0 <= bracket):
                close = rawdata.find("]>", bracket)
                return len(rawdata) if close < 0 else close + 2
            return len(rawdata) if close < 0 else close + 1
        close = rawdata.find(">", i + 2)
        return len(rawdata) if close < 0 else close + 1

    def parse_pi(self, i):
        return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        return self.parse_html_declaration(i)

    def parse_bogus_comment(self, i, report=0):
        close = self.rawdata.find(">", i + 2)
        return len(self.rawdata) if close < 0 else close + 1

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            top = self.open[-1] if self.open else None
            self.blocks.append(Block(text, top[2] if top else None, top[1] if top else frozenset(), self.linked))
        self.pieces, self.linked = [], 0

    def _pop_to(self, place: int) -> None:
        for tag, _, _ in self.open[place:]:
            self.silent -= tag in SILENT_TAGS
            self.links -= tag == "a"
            self.places[tag].pop()
        del self.open[place:]
        while self.walls and self.walls[-1] >= place:
            self.walls.pop()
        while self.barriers and self.barriers[-1] >= place:
            self.barriers.pop()

    def handle_starttag(self, tag, attributes):
        if tag in BLOCK_TAGS:
            self._flush()
            closable = max((self.places[k][-1] for k in _CLOSES.get(tag, ()) if self.places.get(k)), default=-1)
            if closable > (self.barriers[-1] if self.barriers else -1):
                self._pop_to(closable)
        elif tag == "br":
            self.pieces.append(" ")
        if tag not in VOID_TAGS:
            below = self.open[-1] if self.open else None
            names = _name_parts(attributes)
            names = (below[1] | names if names else below[1]) if below else names
            place = len(self.open)
            self.open.append((tag, names, Path(tag, below[2] if below else None)))
            self.places.setdefault(tag, []).append(place)
            if tag in _WALLS:
                self.walls.append(place)
            if tag in _WALLS or tag in _ENCLOSED:
                self.barriers.append(place)
            self.silent += tag in SILENT_TAGS
            self.links += tag == "a"

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag in _CLOSES_ALL:  # '<svg/>' is closed; '<div/>' is not, in HTML
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._flush()
        if not self.places.get(tag):
            return
        place = self.places[tag][-1]
        passes_walls = tag in _WALLS or tag in _CLOSES_ALL or tag in _OUTER
        if not passes_walls and self.walls and self.walls[-1] > place:
            return
        self._pop_to(place)

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order; none for a null or empty page. What is not closed ends with the page.

    Malformed declarations end at the next '>' (marked sections included), a comment never closed and a
    doctype's unclosed internal subset run to the end of the page; nothing of them becomes text. Time and memory
    grow in proportion to the page, however many elements stay open or end tags stray.
    """
    parser = _BlockParser()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.blocks
