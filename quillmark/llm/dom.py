"""Leaf blocks of web pages: runs of text between block-level tags, with what stands above them.

One linear scan in the manner of the HTML parsing rules, for any depth and any length of an attribute. Quotes count in attribute values only.
``script``, ``style``, ``title``, ``textarea``, ``iframe`` and their like end at their own end tag. ``svg`` and ``math`` nest, may close themselves, and
end where an HTML element begins. Elements whose content isn't shown (``template``, ``noscript``, ``select``, ``button``, ``canvas``, media) hide it until
they or an element around them end; an unclosed ``button`` or ``select`` ends at the next block-level tag. ``head`` hides nothing by itself.

Each open element carries the set of features of all elements above it, shared between elements with the same ones, so that a
block costs the same at any depth.
"""

from __future__ import annotations

import functools
import html
import re

# Fixed values of HTML: element names by what they do to a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("template noscript select button object canvas audio video datalist".split())
SHORT = frozenset("button select datalist".split())
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml".split())
BREAKOUT = BLOCKS | frozenset("b big br code em embed font i img nobr ruby s small span strike strong sub sup tt u var a".split()) - {"a"}
CONTAINERS = frozenset("article aside body center details dialog div fieldset footer form header html main nav search section td th".split())
#: An opening tag ends these open elements, unless one of the listed borders is nearer.
IMPLIED = {
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "p"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "p"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "p"), ("table",)),
    "option": (("option",), ("optgroup",)),
}
CLOSES_P = BLOCKS - frozenset("html body li dt dd tr td th tbody thead tfoot caption option optgroup legend summary".split())
TABLE = frozenset("table tr td th tbody thead tfoot caption".split())
SCOPE = ("td", "th", "table", "caption")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)""", re.S)
_HINTED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_OPENS = re.compile(r"</?[A-Za-z]|<[!?]")
#: Hint words in class, id and role values, by what they tell.
HINTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion",
    "foot": "footer copyright legal colophon contentinfo",
    "head": "header masthead topbar logo branding",
    "side": "sidebar aside widget related recommended trending popular tags share sharing social newsletter subscribe complementary",
    "notice": "cookie cookies consent notice popup modal overlay alert gdpr",
    "talk": "comment comments commentlist reply replies respond disqus discussion",
    "form": "form search login signup",
    "main": "article content post entry body main story text prose markdown",
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}


class State:
    """Features of the open elements, and whether their content is shown."""

    __slots__ = ("features", "hidden", "onward")

    def __init__(self, features: frozenset, hidden: bool):
        self.features, self.hidden, self.onward = features, hidden, {}

    def inside(self, tag: str, hints: tuple[str, ...]) -> State:
        found = self.onward.get((tag, hints))
        if found is None:
            new = {f"hint:{h}" for h in hints} | ({f"in:{tag}"} if tag not in ("html", "body") else set())
            hidden = self.hidden or tag in HIDDEN or tag in FOREIGN
            found = self if new <= self.features and hidden == self.hidden else State(self.features | new, hidden)
            self.onward[tag, hints] = found
        return found


class Block:
    """A leaf block. ``container``: number of the nearest sectioning element; ``linked``: code points inside links."""

    __slots__ = ("text", "state", "tag", "hints", "container", "linked")

    def __init__(self, text: str, state: State, tag: str, hints: tuple[str, ...], container: int, linked: int):
        self.text, self.state, self.tag, self.hints, self.container, self.linked = text, state, tag, hints, container, linked


@functools.lru_cache(maxsize=64)
def _raw_end(name: str):
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


@functools.lru_cache(maxsize=8192)
def _known_hints(values: str) -> tuple[str, ...]:
    found = {_HINT_OF[w] for w in _WORD.findall(values) if w in _HINT_OF}
    return tuple(sorted(found - {"main"} if len(found) > 1 else found))


def hints_of(attributes: str) -> tuple[str, ...]:
    """What class, id and role tell; another hint outweighs that of main text."""
    if not attributes:
        return ()
    out: set[str] = set()
    for m in _HINTED.finditer(attributes):
        out.update(_known_hints(m[1].lower()) if len(m[1]) < 400 else {_HINT_OF[w] for w in _WORD.findall(m[1].lower()) if w in _HINT_OF})
    if not out:
        return ()
    return tuple(sorted(out - {"main"} if len(out) > 1 else out))


class _Scan:
    def __init__(self, page: str):
        self.page = page
        self.out: list[Block] = []
        # name, state, hints, container
        self.stack: list[tuple[str, State, tuple, int]] = [("", State(frozenset(), False), (), 0)]
        self.places: dict[str, list[int]] = {}
        self.parents = [-1]  # of containers; 0 is the page
        self.buffer: list[str] = []
        self.owner = self.stack[0]  # where the buffered text began
        self.linked = 0
        self.link = 0  # size of the stack where the open link began
        self.hidden = 0  # place of the outermost element whose content isn't shown

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, name: str, hints: tuple[str, ...] = ()) -> None:
        _, state, _, container = self.stack[-1]
        if name in CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        self.places.setdefault(name, []).append(len(self.stack))
        state = state.inside(name, hints)
        if state.hidden and not self.hidden:
            self.hidden = len(self.stack)
        self.stack.append((name, state, hints, container))

    def cut(self, size: int) -> None:
        """Close all elements from this place of the stack on; text that was shown before ends here."""
        if not size:
            return
        if self.hidden >= size:
            self.hidden = 0
            self.flush()
        while len(self.stack) > size:
            self.places[self.stack.pop()[0]].pop()
        if self.link > size:
            self.link = 0

    def uncover(self, name: str) -> None:
        """Close a hidden element in the middle of a text, which goes on."""
        places = self.places.get(name)
        if places:
            held, self.buffer, linked = self.buffer, [], self.linked
            self.cut(places[-1])
            self.buffer, self.linked = held, linked

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(html.unescape("".join(self.buffer)).split())
            if text:
                name, state, hints, container = self.owner
                self.out.append(Block(text, state, name, hints, container, min(self.linked, len(text))))
            self.buffer = []
        self.linked = 0

    def keep(self, text: str) -> None:
        if text and not self.hidden:
            if not self.buffer:
                self.owner = self.stack[-1]
            self.buffer.append(text)
            if self.link:
                self.linked += len(text.strip())

    def closed(self, name: str) -> None:
        if name in HEADINGS and not self.places.get(name):
            name = max(HEADINGS, key=lambda h: self.last((h,)))
        at = self.last((name,))
        if not at or name not in TABLE and at < self.last(SCOPE) or name == "li" and at < self.last(("ul", "ol")):
            return
        self.cut(at)

    def opened(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and (at := self.last(("p",))) > max(self.last(SCOPE), self.hidden):
            self.cut(at)
        if name in IMPLIED:
            ended, borders = IMPLIED[name]
            border = max(self.last(borders), self.hidden)
            for n in ended:  # from the outermost on
                if (at := self.last((n,))) > border:
                    self.cut(at)
        self.push(name, hints_of(attributes))

    def tag(self, name: str, closing: str, attributes: str, at: int) -> int:
        """Take a tag in; the place where the scan goes on."""
        foreign = self.last(FOREIGN)
        if closing and (name in FOREIGN or name in INTEGRATION and foreign):
            self.uncover(name)
            return at
        if foreign > self.last(INTEGRATION):
            if not closing and (name in FOREIGN or name in INTEGRATION):
                if not attributes.endswith("/"):
                    self.push(name)
                return at
            if name not in BREAKOUT or closing and not self.places.get(name):
                return at
            if not closing:
                self.uncover(self.stack[min(self.places[f][0] for f in FOREIGN if self.places.get(f))][0])
                while outer := self.last(FOREIGN):
                    self.uncover(self.stack[outer][0])
        if name in RAW:
            if not closing:
                end = _raw_end(name).search(self.page, at)
                return end.end() if end else len(self.page)
        elif name in FOREIGN:
            if not attributes.endswith("/"):
                self.push(name)
        elif name == "br":
            self.keep(" ")
        elif name == "a":
            if not self.hidden:
                self.link = 0 if closing else len(self.stack)
        elif name in HIDDEN:
            if closing:
                self.uncover(name)
            else:
                self.push(name)
        elif name in BLOCKS:
            if short := self.last(SHORT):
                if name in ("option", "optgroup", "hr"):
                    return at
                if not closing or self.last((name,)) < short:
                    while short := self.last(SHORT):
                        self.uncover(self.stack[short][0])
            if not self.hidden:
                self.flush()
            if name == "hr":
                return at
            if closing:
                self.closed(name)
            elif name not in ("html", "body") or not self.places.get(name):
                self.opened(name, attributes)
        return at

    def run(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        last_close = page.rfind(">")
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.keep(page[at:])
                break
            if lt > last_close:  # no tag ends after this place: text, up to a tag that is cut off
                m = _OPENS.search(page, lt)
                self.keep(page[at : m.start() if m else n])
                break
            self.keep(page[at:lt])
            m = _TAG.match(page, lt)
            if m is None:
                self.keep("<")
                at = lt + 1
                continue
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name:
                at = self.tag(name.lower(), closing, attributes, at)
        self.flush()


def leaf_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Shown leaf blocks in page order, and the parent of each container."""
    scan = _Scan(page)
    scan.run()
    return scan.out, scan.parents
