"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

``dom`` gives the leaf blocks: runs of text between block-level tags, with the elements above them. Each block has binary features: the
tags and hints (words in class, id and role values) above it, its own tag, its text (length, link share, punctuation, cue words),
its neighbours' length and links, its place in the page, and the share of the page's text and the link density of the
sectioning elements around it. No container decides by itself: the training pages put main text in articles, plain or oddly named
``div``, table cells and the bare body, and boilerplate inside articles. The field has two labels, main text and the rest; blocks are
decoded together by Viterbi. It is trained by gradient ascent on pages that this module builds with labels from a fixed seed.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones are left out, and
main blocks are joined in page order by two line breaks. ``br`` counts as white space. Null html counts as empty; a page without main
text gives an empty string. Pages of any length are scanned whole, in memory in proportion to one page. Equal pages and repeated rows
give equal texts, each row its own; ties in decoding go to the rest. Empty tables give empty results. Columns beyond id, html and
``also`` are left out, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .dom import Block, leaf_blocks

_WORD = re.compile(r"[a-z]+")
CUES = frozenset("cookie cookies copyright subscribe newsletter advertisement sponsored login comments share menu privacy".split())
#: A line that says no more than that remarks of readers follow, in some languages, with or without their number.
_REMARKS = re.compile(r"\W*(?:\d+\W*)?(?:(?:leave|post|add|write) an? )?(?:comments?|replies|reply|responses?|discussion|kommentare?|commentaires?|r[eé]actions?|comentarios?)(?: section)?\W*(?:\d+\W*)?", re.I)
_STOPS = ".!?:\"'”»…"


@functools.lru_cache(maxsize=8192)
def state_features(features: frozenset, tag: str, hints: tuple) -> tuple[str, ...]:
    out = set(features) | {"bias", f"own:{tag}"} | {f"ownhint:{h}" for h in hints}
    if tag in ("h1", "h2", "h3"):
        out |= {f"heading:{x}" for x in features if x.startswith("hint:") or x in ("in:header", "in:aside", "in:footer", "in:nav")}
    return tuple(sorted(out))


def _length(n: int) -> int:
    return 0 if n < 20 else 1 if n < 80 else 2 if n < 300 else 3


def text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    out = [f"len:{_length(n)}"]
    if block.linked * 2 > n:
        out.append("linked")
    elif block.linked * 5 > n:
        out.append("some links")
    if text[-1] in _STOPS:
        out.append("stop")
    if "©" in text[:40] or text[:9].lower() == "copyright":
        out.append("copyright" if n < 200 else "copyright in a long text")
    if n < 300 and not CUES.isdisjoint(_WORD.findall(text.lower())):
        out.append("cue")
    return out


def _share(x: float) -> int:
    return 0 if x < 0.05 else 1 if x < 0.2 else 2 if x < 0.5 else 3


def section_features(blocks: list[Block], parents: list[int]) -> list[tuple[str, ...]]:
    """By container: its share of the page's text outside links, its link density, and its parent's share."""
    plain, linked = [0] * len(parents), [0] * len(parents)
    for b in blocks:
        plain[b.container] += len(b.text) - b.linked
        linked[b.container] += b.linked
    for c in range(len(parents) - 1, 0, -1):  # children come after their parents
        plain[parents[c]] += plain[c]
        linked[parents[c]] += linked[c]
    total = max(1, plain[0])
    out = []
    for c, up in enumerate(parents):
        density = linked[c] / max(1, plain[c] + linked[c])
        out.append((f"section:{_share(plain[c] / total)}", f"density:{_share(density)}", f"around:{_share(plain[up] / total) if up >= 0 else 3}"))
    return out


def context_features(blocks: list[Block]) -> list[list[str]]:
    """What a block's neighbours and its place tell."""
    size = [_length(len(b.text)) for b in blocks]
    links = [b.linked * 2 > len(b.text) for b in blocks]
    headings = [b.tag in ("h1", "h2", "h3", "h4") for b in blocks]
    first = headings.index(True) if any(headings) else -1
    n, out = len(blocks), []
    remarks = next((i for i, b in enumerate(blocks) if len(b.text) < 40 and (b.tag[:1] == "h" or i) and _REMARKS.fullmatch(b.text)), n)
    for i, b in enumerate(blocks):
        found = []
        for j, side in ((i - 1, "before"), (i + 1, "after")):
            if 0 <= j < n:
                found.append(f"{side}:{'linked' if links[j] else size[j]}")
                if blocks[j].container == b.container:
                    found.append(f"{side}:same")
            else:
                found.append(f"{side}:none")
        if first >= 0 and i < first:
            found.append("over heading")
        if i >= remarks:
            found.append("remarks" if i == remarks else "under remarks")
        if i == n - 1:
            found.append("last:" + ("copyright" if "©" in b.text[:40] or b.text[:9].lower() == "copyright" else str(size[i])))
        found.append(f"place:{min(2, 3 * i // n)}")
        out.append(found)
    return out


class Chains:
    """Pages as padded chains: which features each block has, its label, and which places are real."""

    def __init__(self, pages: list[list[tuple[list[str], int]]]):
        self.names: dict[str, int] = {}
        self.n, self.length = len(pages), max(map(len, pages))
        self.y, self.real = np.zeros((self.n, self.length), int), np.zeros((self.n, self.length), bool)
        rows = []
        for p, page in enumerate(pages):
            for i, (found, label) in enumerate(page):
                rows += [(p * self.length + i, self.names.setdefault(f, len(self.names))) for f in found]
                self.y[p, i], self.real[p, i] = label, True
        self.at, self.feature = np.array(rows).T

    def objective(self, w: np.ndarray, move: np.ndarray, first: np.ndarray):
        """Log-likelihood of the labels, and its gradient by the weights of label 1, the transitions and the start."""
        n, length, y, real = self.n, self.length, self.y, self.real
        e = np.zeros((n, length, 2))
        e[:, :, 1] = np.bincount(self.at, w[self.feature], minlength=n * length).reshape(n, length)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = first + e[:, 0]
        score = np.take_along_axis(alpha[:, 0], y[:, :1], axis=1).sum()
        for i in range(1, length):
            alpha[:, i] = np.where(real[:, i, None], np.logaddexp.reduce(alpha[:, i - 1, :, None] + move, axis=1) + e[:, i], alpha[:, i - 1])
            on = real[:, i]
            score += move[y[on, i - 1], y[on, i]].sum() + e[on, i, y[on, i]].sum()
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        g_move = np.zeros((2, 2))
        for i in range(length - 2, -1, -1):
            onward = move + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            both = np.exp(alpha[:, i, :, None] + onward - total[:, None, None]) * real[:, i + 1, None, None]
            g_move -= both.sum(axis=0)
            beta[:, i] = np.where(real[:, i + 1, None], np.logaddexp.reduce(onward, axis=2), 0)
            pair = y[:, i][real[:, i + 1]] * 2 + y[:, i + 1][real[:, i + 1]]
            g_move += np.bincount(pair, minlength=4).reshape(2, 2)
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
        g = np.bincount(self.feature, ((y - one) * real).reshape(-1)[self.at], minlength=len(w))
        g_first = np.array([(1 - y[:, 0]).sum() - (1 - one[:, 0]).sum(), y[:, 0].sum() - one[:, 0].sum()])
        return score - total.sum(), g, g_move, g_first


class Field:
    """Two-label linear-chain field: emission weights for label 1, and transition scores."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.move = np.zeros((2, 2))
        self.first = np.zeros(2)
        self._states: dict[tuple, float] = {}

    def fit(self, pages: list[list[tuple[list[str], int]]], epochs: int = 150, rate: float = 0.15, l2: float = 3e-4) -> Field:
        """Gradient ascent (Adam) on the mean log-likelihood a block less a quadratic penalty."""
        chains = Chains([p for p in pages if p])
        n, blocks = len(chains.names), chains.real.sum()
        x, moments = np.zeros(n + 6), [np.zeros(n + 6), np.zeros(n + 6)]
        for step in range(1, epochs + 1):
            _, g, g_move, g_first = chains.objective(x[:n], x[n : n + 4].reshape(2, 2), x[n + 4 :])
            grad = np.concatenate([g, g_move.ravel(), g_first]) / blocks - l2 * x
            for m, (decay, v) in zip(moments, ((0.9, grad), (0.99, grad * grad)), strict=True):
                m *= decay
                m += (1 - decay) * v
            x = x + rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        self.weights = {k: float(x[i]) for k, i in chains.names.items()}
        self.move, self.first = x[n : n + 4].reshape(2, 2), x[n + 4 :]
        return self

    def emissions(self, blocks: list[Block], parents: list[int]) -> list[float]:
        weight = self.weights.get
        sections = [sum(weight(f, 0.0) for f in found) for found in section_features(blocks, parents)]
        out = []
        for b, around in zip(blocks, context_features(blocks), strict=True):
            key = (b.state.features, b.tag, b.hints)
            e = self._states.get(key)
            if e is None:
                e = sum(weight(f, 0.0) for f in state_features(*key))
                if len(self._states) < 65536:
                    self._states[key] = e
            e += sections[b.container]
            for f in text_features(b):
                e += weight(f, 0.0)
            for f in around:
                e += weight(f, 0.0)
            out.append(e)
        return out

    def decode(self, emissions: list[float]) -> list[int]:
        """Viterbi: the likeliest labels together."""
        if not emissions:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one = self.first.tolist()
        back = []
        for i, e in enumerate(emissions):
            if i == 0:
                one += e
                continue
            z, o = (zero + m00, 0) if zero + m00 >= one + m10 else (one + m10, 1), (zero + m01, 0) if zero + m01 >= one + m11 else (one + m11, 1)
            back.append((z[1], o[1]))
            zero, one = z[0], o[0] + e
        out = [int(one > zero)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def extract(self, page: str | None) -> str:
        blocks, parents = leaf_blocks(page or "")
        return "\n\n".join(b.text for b, y in zip(blocks, self.decode(self.emissions(blocks, parents)), strict=True) if y)


# ---- labelled pages


class _Maker:
    """A page built from parts, each known to be main text or not; the parts pass through the same parser."""

    def __init__(self, r: random.Random):
        self.r, self.parts = r, []  # markup, and the label of the blocks that it makes
        self.noise = r.choice(("", "", "", "***", "!!", "$$$", " |"))

    def word(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 9)))

    def words(self, a: int, b: int) -> str:
        s = " ".join(self.word() + self.noise for _ in range(self.r.randint(a, b)))
        return s.upper() if self.noise == "!!" else s.capitalize()

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 14) + "." for _ in range(self.r.randint(a, b)))

    def add(self, markup: str, label: int | None = None) -> None:
        self.parts.append((markup, label))

    def wrapped(self, opening: str, fill) -> None:
        self.add(f"<{opening}>")
        fill()
        self.add(f"</{opening.split()[0]}>")

    def odd(self) -> str:
        """An attribute that tells nothing."""
        return self.r.choice(("", "", f' class="{self.word()}q"', f' id="{self.word()}z"', f' style="x:{self.word()}"'))

    def links(self, k: int) -> None:
        plain = self.r.random() < 0.2
        for _ in range(k):
            if plain:
                self.add("<div>")
                self.add(f'<a href="/{self.word()}">{self.words(1, 3)}</a>', 0)
                self.add("</div>")
            else:
                self.add("<li>")
                self.add(f'<a href="/{self.word()}">{self.words(1, 3)}</a>', 0)
                self.add("</li>")

    def notice(self) -> None:
        r = self.r
        kind = r.choice(('class="cookie-banner"', 'class="consent"', 'class="notice"', 'id="popup"', "class=alert"))
        text = r.choice((f"We use cookies. {self.sentences(1, 2)}", self.sentences(1, 2)))
        tag, inner = r.choice(("div", "div", "section", "aside")), r.random() < 0.5
        self.wrapped(f"{tag} {kind}", lambda: (self.add("<p>" if inner else ""), self.add(text, 0), self.add("</p>" if inner else "")))

    def advert(self) -> None:
        r = self.r
        tag = r.choice(("div", "div", "div", "p", "aside", "section"))
        self.wrapped(f'{tag} class="{r.choice(("ad", "advert", "ads banner", "sponsored", "promo"))}"', lambda: self.add(self.sentences(1, 3), 0))

    def menu(self) -> None:
        opening = self.r.choice(("nav", "nav", 'div class="menu"', 'ul class="nav navbar"', "ul", 'div id="navigation"', "div"))
        nested = not opening.startswith("ul")
        k = self.r.randint(3, 8)
        self.wrapped(opening, lambda: self.wrapped("ul", lambda: self.links(k)) if nested else self.links(k))

    def sidebar(self) -> None:
        r = self.r

        def fill():
            self.add("<h3>")
            self.add(self.words(1, 3), 0)
            self.add("</h3>")
            if r.random() < 0.6:
                self.add("<p>")
                self.add(self.sentences(1, 2), 0)
                self.add("</p>")
            self.wrapped("ul", lambda: self.links(r.randint(1, 5)))

        self.wrapped(r.choice(('aside class="sidebar"', "aside", 'div class="related"', 'div class="widget"', 'div id="sidebar"', 'section class="recommended"')), fill)

    def comments(self) -> None:
        r = self.r
        one = r.choice(('div class="comment"', 'li class="comment"', 'article class="comment"', "div", "p"))

        def fill():
            if r.random() < 0.4:
                self.wrapped(r.choice(("h2", "h3")), lambda: self.add(r.choice(("Comments", self.words(1, 2))), 0))
            for _ in range(r.randint(1, 4)):
                inner = one != "p" and r.random() < 0.6
                self.wrapped(one, lambda inner=inner: (self.add("<p>" if inner else ""), self.add(r.choice((self.sentences(1, 4), self.words(1, 5) + ".")), 0), self.add("</p>" if inner else "")))

        if r.random() < 0.4:
            self.remarks()
        elif "comment" in one and r.random() < 0.3:  # hinted entries that nothing holds
            fill()
        else:
            self.wrapped(f'{r.choice(("section", "div", "ol", "aside"))} {r.choice(("class=", "id="))}"{r.choice(("comments", "comment-list", "discussion", "replies"))}"', fill)

    def remarks(self) -> None:
        """Remarks of readers in containers that say nothing: a heading with or without a number, names, dates, texts, links to reply."""
        r = self.r
        word, k = r.choice(("Comments", "Comments", "Comment", "Replies", "Responses", "Discussion", "Kommentare", "Commentaires", "Comentarios", "Leave a comment")), r.randint(1, 60)
        heading = r.choice((word, f"{k} {word}", f"{word} ({k})", f"{word}:"))

        def fill():
            self.wrapped(r.choice(("h2", "h3", "h3", "h4", "p", "div")), lambda: self.add(heading, 0))
            one, name = r.choice(("div", "p", "li", "p", "blockquote")), r.random()
            for _ in range(r.randint(1, 5)):
                if name < 0.3:
                    self.wrapped(r.choice(("p", "div", "h4")), lambda: self.add(self.words(1, 2), 0))
                if name > 0.8:
                    self.wrapped("div", lambda: self.add(f"{r.randint(2, 30)} {r.choice(('days', 'hours', 'weeks'))} ago", 0))
                self.wrapped(one, lambda: self.add((f"<b>{self.words(1, 2)}</b> " if 0.3 < name < 0.6 else "") + r.choice((self.sentences(1, 4), self.words(1, 6) + ".", self.words(1, 6))), 0))
                if 0.5 < name < 0.7:
                    self.wrapped("p", lambda: self.add('<a href="#r">Reply</a>', 0))

        around = r.choice((f"section{self.odd()}", f"div{self.odd()}", "section", "div", ""))
        self.wrapped(around, fill) if around else fill()

    def form(self) -> None:
        def fill():
            kind = self.r.choice(("p", "label", "p"))
            self.wrapped(kind, lambda: self.add(self.words(1, 5), 0))
            self.add('<input type="text"><button>go</button>' if self.r.random() < 0.5 else '<input type="text">')

        self.wrapped("form" + self.odd(), fill)

    def footer(self) -> None:
        r = self.r
        text = r.choice((f"&copy; {self.word()}.example &middot; {self.sentences(1, 2)}", self.sentences(1, 2), "Copyright " + self.words(1, 3)))
        if r.random() < 0.45:  # a line at the end that nothing holds
            year, sign = r.randint(1995, 2026), r.choice(("&copy;", "&#169;", "Copyright", "Copyright &copy;"))
            line = f"{sign} {year} {self.words(1, 3)}" + r.choice(("", ".", ". All rights reserved.", f", {self.words(1, 2)}."))
            tag = r.choice(("small", "p", "div", "", "p", "center"))
            self.add("<hr>" if r.random() < 0.7 or tag in ("", "small") else "")
            self.add(f"<{tag}>" if tag else "")
            self.add(line, 0)
            self.add(f"</{tag}>" if tag else "")
            return
        opening = r.choice(("footer", "footer", "footer", 'div class="footer"', 'div id="footer"')) if not text.startswith("&copy;") else r.choice(("footer", "footer", 'div class="footer"', "div"))
        inner = r.random() < 0.4
        self.wrapped(opening, lambda: (self.add("<p>" if inner else ""), self.add(text, 0), self.add("</p>" if inner else "")))

    def body(self) -> None:
        """The main text, with what may stand inside its container."""
        r = self.r
        if r.random() < 0.85:
            header, level = r.random() < 0.15, r.choice(("h1", "h1", "h1", "h2"))
            if header:
                self.add("<header>")
            self.wrapped(level, lambda: self.add(self.words(1, 9), 1))
            if header:
                self.add("</header>")
        text = r.choice(("p", "p", "p", "p", "div", "p" + self.odd()))
        if r.random() < 0.08:  # one run of text without paragraphs
            self.add(self.sentences(2, 9), 1)
        for _ in range(r.randint(1, 8)):
            kind = r.random()
            if kind < 0.72:
                words = r.choice((self.sentences(1, 1), self.sentences(1, 6), self.sentences(3, 9), self.words(1, 4), self.words(1, 2) + "."))
                link = f' <a href="/x">{self.words(1, 2)}</a>' if r.random() < 0.15 else ""
                close = f"</{text.split()[0]}>" if not text.startswith("p") or r.random() < 0.7 else ""
                self.add(f"<{text}>" + r.choice(("", "", "<b>")))
                self.add(words + link + r.choice(("", "", "<br>")), 1)
                self.add(close)
            elif kind < 0.8:
                self.wrapped(r.choice(("h2", "h3")), lambda: self.add(self.words(1, 6), 1))
            elif kind < 0.86:
                self.wrapped(r.choice(("ul", "ol")), lambda: [self.wrapped("li", lambda: self.add(self.words(2, 9), 1)) for _ in range(r.randint(1, 4))])
            elif kind < 0.9:
                self.wrapped("blockquote", lambda: self.wrapped("p", lambda: self.add(self.sentences(1, 2), 1)))
            elif kind < 0.92:
                self.wrapped("table", lambda: self.wrapped("tr", lambda: [self.wrapped("td", lambda: self.add(self.words(1, 3), 1)) for _ in range(2)]))
            else:
                r.choice((self.advert, self.advert, self.sidebar, self.form, self.notice))()
        if r.random() < 0.25:
            r.choice((self.footer, self.comments, self.comments, self.notice, self.sidebar))()

    def bare(self) -> None:
        """A few blocks of main text and little or nothing else."""
        r = self.r
        menu, footer = r.random() < 0.4, r.random() < 0.4
        short = r.random() < 0.4
        line = lambda: self.words(1, 3) + "." if short else self.sentences(1, 4)
        if menu:
            self.menu()
        if r.random() < 0.3:
            self.advert()
        if r.random() < 0.25:
            self.add(self.sentences(1, 5), 1)
            self.add("<hr>")
        else:
            title = r.random() < 0.5

            def fill():
                if title:
                    self.wrapped("h1", lambda: self.add(self.words(1, 9), 1))
                for _ in range(r.randint(1, 3)):
                    self.wrapped("p", lambda: self.add(line(), 1))

            self.wrapped(r.choice(("article", "div", "main", "body", "section", f"div{self.odd()}")), fill)
        if r.random() < 0.2:
            self.remarks()
        if footer:
            self.footer()

    def page(self) -> list[tuple[list[str], int]]:
        kind = self.r.random()
        if kind < 0.06:  # a paragraph or two and nothing else
            for _ in range(self.r.randint(1, 2)):
                self.wrapped(self.r.choice(("p", "p", "div")), lambda: self.add(self.r.choice((self.sentences(1, 1), self.sentences(1, 30))), 1))
        elif kind < 0.28:
            self.bare()
        else:
            self.full()
        markup = "<html><body>" + "".join(m for m, _ in self.parts) + "</body></html>"
        blocks, parents = leaf_blocks(markup)
        labels = [label for _, label in self.parts if label is not None]
        if len(blocks) != len(labels):
            raise AssertionError(f"labels don't fit the blocks: {markup}")
        sections, around = section_features(blocks, parents), context_features(blocks)
        return [([*state_features(b.state.features, b.tag, b.hints), *sections[b.container], *text_features(b), *c], y) for b, c, y in zip(blocks, around, labels, strict=True)]

    def full(self) -> None:
        r = self.r
        if r.random() < 0.4:
            opening = r.choice(("header", "header", 'div class="header"', 'div id="masthead"'))
            site = r.choice(("p", "div", "h2", "h1"))
            motto = r.random() < 0.3
            self.wrapped(opening, lambda: (self.wrapped(site, lambda: self.add(self.words(1, 5), 0)), motto and self.wrapped("p", lambda: self.add(self.words(1, 6), 0))))
        around = [f"div{self.odd()}" for _ in range(r.choice((0, 0, 0, 1, 2, 4)))]
        for opening in around:
            self.add(f"<{opening}>")
        for part in r.sample((self.menu, self.menu, self.advert, self.notice), r.randint(1, 3)):
            part()
        if r.random() < 0.2:
            self.sidebar()
        main = r.choice(("article", "article", "main", "section", "div", "div", f"div{self.odd()}", f"div{self.odd()}", f"section{self.odd()}", 'div class="content"', 'div id="post-body"', 'section class="entry"', "td", "td", "", "", ""))
        if main == "td":
            self.add("<table><tr>")
            if r.random() < 0.5:
                self.wrapped("td", lambda: self.wrapped("ul", lambda: self.links(r.randint(2, 6))))
            self.wrapped("td" + self.odd(), self.body)
            self.add("</tr></table>")
        elif main:
            nested = r.random() < 0.3
            self.wrapped(main, lambda: self.wrapped(f"div{self.odd()}", self.body) if nested else self.body())
        else:
            self.body()
            self.add("<hr>")
        for part in r.sample((self.comments, self.sidebar, self.form, self.advert, self.menu), r.randint(0, 3)):
            part()
        if r.random() < 0.9:
            self.footer()
        for opening in around:
            self.add(f"</{opening.split()[0]}>")


@functools.lru_cache(maxsize=1)
def field(pages: int = 1200, seed: int = 5) -> Field:
    r = random.Random(seed)
    return Field().fit([_Maker(r).page() for _ in range(pages)])


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: id, ``also``, ``text``, ``n_chars`` (code points)."""
    shared = df.sparkSession.sparkContext.broadcast(field())  # a few hundred weights

    def make():
        trained = shared.value

        def apply(pages):
            texts = [trained.extract(p) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    return map_texts(df, id_col, html_col, "text string, n_chars bigint", make, also)
