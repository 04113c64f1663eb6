"""Main text by what blocks are like, not by their container; the parser's borders; the field against enumeration."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from quillmark.llm import dom, html_text

S = "This is a sentence of the text that goes on for a while, with some words more. "
P = "".join(f"<p>{S * k}</p>" for k in (2, 3, 1))
MAIN = "\n\n".join((S * k).strip() for k in (2, 3, 1))


@pytest.mark.parametrize("name", ["div", "section", "main", 'div class="x12 col"', "td", None])
def test_renamed_container(spark, sf_dir, name):
    field = html_text.field()
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    same = 0
    for page in pages:
        opening, closing = (f"<{name}>", f"</{name.split()[0]}>") if name else ("", "")
        if name == "td":
            opening, closing = "<table><tr><td>", "</td></tr></table>"
        other = re.sub("<article[^>]*>", opening, page).replace("</article>", closing)
        same += field.extract(page) == field.extract(other) != ""
    assert same >= 0.95 * len(pages)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body>" + P, MAIN),
        ("<p>Only one short sentence here.</p>", "Only one short sentence here."),
        ("<table><tr><td><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><td>" + P + "</table>", MAIN),
        ("<article><h1>Title</h1>" + P + "<footer>&copy; 2020 Somebody</footer></article>", "Title\n\n" + MAIN),
        ('<article><h1>Title</h1>' + P + '<div class="comments"><div class="comment"><p>Nice one.</p></div></div></article>', "Title\n\n" + MAIN),
        ('<article><h1>Title</h1>' + P + '<div class="comment">Short.</div></article>', "Title\n\n" + MAIN),
        ('<article><div class="notice"><p>Please accept.</p></div><h1>Title</h1>' + P + "</article>", "Title\n\n" + MAIN),
        ("<article><h1>Title</h1><svg/>" + P + "</article>", "Title\n\n" + MAIN),
        ("<article><svg><svg><text>in</text></svg><text>out</text></svg>" + P + "</article>", MAIN),
        ("<article><h1>Title</h1><button>Go" + P + "</article>", "Title\n\n" + MAIN),
        ("<html><head><title>x</title><h1>Title</h1>" + P, "Title\n\n" + MAIN),
        ("<div>" * 300 + "<article>" + P + "</article>" + "</div>" * 300, MAIN),
        ('<article><p title="' + "y>" * 70_000 + '">' + P[3:] + "</article>", MAIN),
        ('<div class="a1"><div class="b2"><div>' + S * 3 + "</div><div>" + S * 2 + "</div></div></div>", (S * 3).strip() + "\n\n" + (S * 2).strip()),
        ('<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>' + P + "<div>&copy; 2024 x. All rights reserved.</div>", MAIN),
        ("<nav><ul><li><a href=x>m</a><li><a href=x>n</a></ul></nav><footer>c</footer>", ""),
    ],
)
def test_pages(page, want):
    assert html_text.field().extract(page) == want


def texts(page):
    return [b.text for b in dom.leaf_blocks(page)[0]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><p>a<b>b</b> c<p>d</body>", ["ab c", "d"]), ("<p>x <svg/> y</p>", ["x y"]), ("<p>x <svg><title>t</title><g>q</g></svg> y</p>", ["x y"]),
        ("<p>x<svg><p>y", ["x", "y"]), ("<button>go<p>text</p><div>more", ["text", "more"]), ("<div><p>one<noscript><p>no</p></noscript> two</div>", ["one two"]),
        ("<select><option>a<option>b</select>t", ["t"]), ("<select><option>a<p>t", ["t"]), ("a < b and 3 > 2", ["a < b and 3 > 2"]), ("text <!-- c --> more <!--> x", ["text more x"]),
        ("<p>t <di", ["t"]), ("<p>x<template><p>t</p></template>y</p>", ["xy"]), ("<h1>t</h2><p>u", ["t", "u"]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c<div>x</table>y", ["a", "b", "c", "x", "y"]), ("<script>if (a</p>b) </script>c", ["c"]), ("<textarea><p>x</textarea>y", ["y"]),
        ("<p title='a > b' class=x>t</p>", ["t"]), ("&amp;lt; &eacute;&#233;", ["&lt; éé"]), ("", []),
    ],
)
def test_leaf_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x" + "</div>" * 200_000, "<li><ul>" + "<div>" * 100_000 + "<li></li>" * 50_000, '<a ="' * 100_000 + ">", '<p a="x>' * 100_000, "<" * 300_000 + ">", "<!--" * 200_000, "<svg>" * 100_000 + "<p>x", "</div>" * 200_000 + "x"], ids=range(8))
def test_scan_is_linear(page):
    began = time.monotonic()
    dom.leaf_blocks(page)
    assert time.monotonic() - began < 20


def small_chains(seed):
    r = random.Random(seed)
    return [[([f"f{r.randrange(5)}" for _ in range(r.randint(1, 3))], r.randrange(2)) for _ in range(r.randint(1, 5))] for _ in range(4)]


def path_score(page, labels, w, move, first):
    out = first[labels[0]]
    for i, ((found, _), y) in enumerate(zip(page, labels, strict=True)):
        out += y * sum(w[f] for f in found) + (move[labels[i - 1], y] if i else 0)
    return out


def test_field_against_enumeration():
    """Likelihood, gradient and decoding against all labellings of short chains."""
    for seed in range(5):
        pages, rng = small_chains(seed), np.random.default_rng(seed)
        chains = html_text.Chains(pages)
        n = len(chains.names)
        x = rng.standard_normal(n + 6)

        def likelihood(x, pages=pages, chains=chains, n=n):
            w, move, first = {k: x[i] for k, i in chains.names.items()}, x[n : n + 4].reshape(2, 2), x[n + 4 :]
            out = 0.0
            for page in pages:
                every = [path_score(page, y, w, move, first) for y in itertools.product((0, 1), repeat=len(page))]
                out += path_score(page, [y for _, y in page], w, move, first) - np.logaddexp.reduce(every)
            return out

        value, g, g_move, g_first = chains.objective(x[:n], x[n : n + 4].reshape(2, 2), x[n + 4 :])
        assert np.isclose(value, likelihood(x))
        step = 1e-5 * np.eye(n + 6)
        numeric = [(likelihood(x + d) - likelihood(x - d)) / 2e-5 for d in step]
        assert np.allclose(numeric, np.concatenate([g, g_move.ravel(), g_first]), atol=1e-6)
        field = html_text.Field()
        field.move, field.first = x[n : n + 4].reshape(2, 2), x[n + 4 :]
        w = {k: x[i] for k, i in chains.names.items()}
        for page in pages:
            best = max(itertools.product((0, 1), repeat=len(page)), key=lambda y: path_score(page, y, w, field.move, field.first))
            assert field.decode([sum(w[f] for f in found) for found, _ in page]) == list(best)


NAV = "<nav><ul><li><a href=a>Home</a><li><a href=b>About us</a><li><a href=c>Contact</a></ul></nav>"
LINES = [(S * k).strip() for k in (2, 3, 1)]
LAYOUTS = {
    'foot':(NAV + '<h1>Title</h1>' + P + '<div id="footer"><p>Some company, Street 1. All rights reserved.</p></div>',['Title'] + LINES),
    'cookie':('<div class="cookie-consent"><p>We use cookies to improve your visit to this page.</p><button>OK</button></div>'+NAV + '<main><h1>Title</h1>' + P + '</main>',['Title'] + LINES),
    'cookieend':(NAV + '<main><h1>Title</h1>' + P + '</main><div id="gdpr-popup">' + S * 2 + '</div>',['Title'] + LINES),
    'tableside':('<table><tr><td><h3>Menu</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></td><td><h1>Title</h1>' + P + '</td></tr></table>',['Title'] + LINES),
    'short':(NAV + '<article><h1>Talk</h1>'+''.join(f'<p>{x}</p>' for x in ('Yes.','No, never.','Why not?','Because.'))+'</article><aside class="sidebar"><h3>Related</h3><p>' + S * 3 + '</p></aside>',['Talk','Yes.','No, never.','Why not?','Because.']),
    'sitehead':('<header><h1>Site name</h1><p>The motto</p></header>'+NAV + '<div><h2>Title</h2>' + P + '</div><footer>&copy; x</footer>',['Title'] + LINES),
    'list':(NAV + '<article><h1>Title</h1>' + P + '<ul><li>First point of it</li><li>Second point of it</li></ul><h2>More</h2><p>' + S + '</p></article>',['Title'] + LINES+['First point of it','Second point of it','More',S.strip()]),
    'quote':('<article><h1>Title</h1>' + P + '<blockquote>' + S + '</blockquote></article>',['Title'] + LINES+[S.strip()]),
    'adin':('<article><h1>Title</h1><p>' + S + '</p><div class="advertisement">Buy now and save a lot.</div><p>' + S * 2 + '</p></article>',['Title',S.strip(),(S * 2).strip()]),
    'asidein':('<article><h1>Title</h1><p>' + S + '</p><aside><h3>See also</h3><ul><li><a href=x>Other page</a></li></ul></aside><p>' + S * 2 + '</p></article>',['Title',S.strip(),(S * 2).strip()]),
    'comments':('<article><h1>Title</h1>' + P + '</article><section id="comments"><h2>Comments</h2><ol><li class="comment"><p>' + S * 3 + '</p></li><li class="comment"><p>I agree.</p></li></ol></section>',['Title'] + LINES),
    'artcomments':('<main><article><h1>Title</h1>' + P + '</article><div class="comments"><article class="comment"><p>' + S * 2 + '</p></article></div></main>',['Title'] + LINES),
    'form':('<article><h1>Title</h1>' + P + '</article><form><p>Subscribe to the list</p><label>Mail</label><input></form>',['Title'] + LINES),
    'pre':('<article><h1>Title</h1><pre>x = 1\ny = 2</pre>' + P + '</article>',['Title','x = 1 y = 2'] + LINES),
    'fig':('<article><h1>Title</h1><figure><img src=a><figcaption>A caption of it.</figcaption></figure>' + P + '</article>',['Title','A caption of it.'] + LINES),
    'onlynav':(NAV + '<footer>&copy; 2020</footer>',[]),
    'search':('<form class="search"><label>Search the site</label><input></form><div class="content"><h1>Title</h1>' + P + '</div><div class="pagination"><a href=1>1</a> <a href=2>2</a></div>',['Title'] + LINES),
    'bread':('<div class="breadcrumb"><a href=a>Home</a> &gt; <a href=b>News</a></div><h1>Title</h1>' + P,['Title'] + LINES),
    'plaindivnav':('<div><a href=a>Home</a><a href=b>News</a><a href=c>Sport</a></div><div><h1>Title</h1><div>' + S * 2 + '</div><div>' + S + '</div></div>',['Title',(S * 2).strip(),S.strip()]),
    'longpar':('<p>' + S * 200 + '</p>',[(S * 200).strip()]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_text.field().extract(f"<html><body>{page}</body></html>") == "\n\n".join(want)


_PARAGRAPHS = "<p>The first sentence of the article stands here, with some words to read.</p><p>A second paragraph follows it, as long as the first one is. It has two sentences.</p>"
_MAIN = "The first sentence of the article stands here, with some words to read.\n\nA second paragraph follows it, as long as the first one is. It has two sentences."


@pytest.mark.parametrize("heading", ["12 Comments", "Comments (3)", "Comments", "3 Replies", "Kommentare", "Discussion:"])
@pytest.mark.parametrize("opening", ["section", "div", 'div class="qxz"'])
def test_remarks_without_a_hint_go(heading, opening):
    remarks = f"<{opening}><h2>{heading}</h2><div><b>Ann</b> I think that this is quite right, and well put.</div><div><b>Bob</b> No, it is not. Read it again.</div><p>Thanks for this.</p></{opening.split()[0]}>"
    for page in (f"<article><h1>A headline</h1>{_PARAGRAPHS}</article>{remarks}", f"<div><h1>A headline</h1>{_PARAGRAPHS}{remarks}</div>", f"<h1>A headline</h1>{_PARAGRAPHS}{remarks}<footer>About us</footer>"):
        assert html_text.field().extract(page) == f"A headline\n\n{_MAIN}"


@pytest.mark.parametrize("line", ["<hr><small>© 2020 Example</small>", "<hr><p>&copy; 1999 Some Name. All rights reserved.</p>", "<hr>Copyright 2021 Example", "<p>Copyright &copy; 2011 Example Press</p>", "<div>© Example</div>"])
def test_copyright_lines_without_a_footer_go(line):
    assert html_text.field().extract(f"<body>{_PARAGRAPHS}{line}</body>") == _MAIN
    assert html_text.field().extract(f"<body><h1>A headline</h1>{_PARAGRAPHS}{line}</body>") == f"A headline\n\n{_MAIN}"


def test_words_about_comments_stay():
    page = "<article><h1>A headline</h1><p>Comments on the law came from many sides, and replies to them too. The discussion went on.</p><h2>Comments on the second part</h2><p>It was long. Nobody read it to the end.</p></article>"
    assert html_text.field().extract(page).count("\n\n") == 3
