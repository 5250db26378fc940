"""Main text of pages: densities against a plain recursion, wrappers, comments, and pages marked by hand."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from lexweave.llm import html_density

SENTENCE = "A sentence of the story that goes on for a while and says something. "
STORY = [SENTENCE * 6, "Another paragraph, " + SENTENCE * 4, "And the last one. " + SENTENCE * 5]
TEXT = "\n".join(" ".join(s.split()) for s in STORY)
P = "".join(f"<p>{s}</p>" for s in STORY)
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>"
FOOT = "<footer><p>Copyright 2020 Somebody, all rights reserved, and so on.</p></footer>"


class Tree(HTMLParser):
    """Well-formed pages as nested [tag, children or texts]."""

    def __init__(self, source):
        super().__init__()
        self.stack = [["#page", []]]
        self.root = self.stack[0]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def density(c, t, lc, lt, share):
    if not c:
        return 0.0
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)


def measured(node, linked=False):
    """(characters, tags, link characters, link tags, node, parts) of a nested node."""
    linked = linked or node[0] in ("a", "nav", "footer", "aside", "form")
    parts = [measured(x, linked) if isinstance(x, list) else x for x in node[1]]
    own = sum(len(x.strip()) for x in parts if isinstance(x, str))
    below = [x for x in parts if not isinstance(x, str)]
    return (own + sum(x[0] for x in below), 1 + sum(x[1] for x in below), own * linked + sum(x[2] for x in below), linked + sum(x[3] for x in below), node[0], parts, linked)


@pytest.mark.parametrize("seed", range(20))
def test_densities_and_sums_as_by_recursion(seed):
    rng = random.Random(seed)

    def page(depth):
        if not depth or rng.random() < 0.3:
            return "word " * rng.randint(0, 30)
        tag = rng.choice(["div", "section", "div", "a", "b", "nav", "aside", "blockquote"])
        return f"<{tag}>" + "".join(page(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    source = "<html><body><div>" + "plain words of the page " * 99 + "</div>" + "".join(page(5) for _ in range(4)) + "</body></html>"
    got = html_density.Page(source)
    whole = measured(Tree(source).root)
    share, want = whole[2] / max(whole[0], 1), []

    def walk(m):
        direct = [x for x in m[5] if isinstance(x, str)]
        sums = sum(density(*x[:4], share) for x in m[5] if not isinstance(x, str)) + sum(density(len(x.strip()), 1, len(x.strip()) * m[6], int(m[6]), share) for x in direct)
        want.append((density(*m[:4], share), sums))
        for x in m[5]:
            if not isinstance(x, str):
                walk(x)

    walk(whole)
    assert not any(m for m in got.marked if m is None) and len(want) == len(got.tag)
    assert [pytest.approx(d) for d, _ in want] == got.density
    assert [pytest.approx(s) for _, s in want] == got.sums


@pytest.mark.parametrize("name", ["has-sidebar", "no-ads", "post no-ads", "content with-sidebar", "notice-text", "story social-history", "page-header comments-open", "comments-open", "sidebar", "widget", "elementor-widget theme-post-content"])
def test_wrappers_keep_their_text(name):
    for wrapped in (P, f"<article>{P}</article>", f"<div><div>{P}</div></div>"):
        assert html_density.main_text(f'<body>{MENU}<div class="{name}">{wrapped}</div>{FOOT}</body>') == TEXT


COMMENTS = [
    '<section class="responses"><p>Nice piece by you, it is quite long and good!</p></section>',
    '<div id="discussion"><p>I disagree with all of it, and I say why at some length here.</p></div>',
    '<section class="xq"><h3>3 comments</h3><ul><li><b>Ann</b><p>So true, I have said so for years now.</p></li></ul></section>',
    '<section><h4>What readers say</h4><div>Somebody says something that is long enough to be dense text.</div></section>',
    "".join(f'<div class="q"><span class="user-name">A{k}</span> <time>today</time><p>{SENTENCE}</p></div>' for k in range(5)),
    f'<h2>Comments (2)</h2><p>{SENTENCE}</p><p>{SENTENCE}</p>',
    f'<h2>Kommentare</h2><ol><li>{SENTENCE}</li></ol>',
    f'<div class="disqus-thread"><p>{SENTENCE * 40}</p></div>',
]


@pytest.mark.parametrize("comments", COMMENTS)
def test_comments_of_any_name_go(comments):
    for page in (f"<article>{P}{comments}</article>", f"<div class=story>{P}{comments}</div>", f"<div class=story>{P}</div>{comments}", f"<article>{P}</article>{comments}"):
        assert html_density.main_text(f"<body>{MENU}{page}{FOOT}</body>") == TEXT


def test_sections_of_papers_stay():
    paper = "".join(f'<section id="{n}"><h2>{n.title()}</h2>{P}</section>' for n in ("introduction", "methods", "discussion"))
    assert html_density.main_text(f"<body>{MENU}<div>{paper}</div>{FOOT}</body>") == "\n".join(f"{n}\n{TEXT}" for n in ("Introduction", "Methods", "Discussion"))


#: Pages without article or main elements, and what a reader takes for their text.
MARKED = [
    (f"<body>{MENU}<h1>Title of it</h1>{P}{FOOT}</body>", f"Title of it\n{TEXT}"),
    (f'<body><div id="top">Site name</div>{MENU}<div id="c1"><div class="t"><h2>Title</h2></div><div class="b">{P}</div></div><div id="r"><h4>Latest</h4><ul><li><a href=1>One thing</a></li><li><a href=2>Other thing</a></li></ul></div>{FOOT}</body>', f"Title\n{TEXT}"),
    (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Title</h1>{P}</td></tr><tr><td colspan=2>Imprint</td></tr></table></body>", f"Title\n{TEXT}"),
    ("<body>" + MENU + "<div>" + "<br><br>".join(STORY) + "</div><div>Imprint</div></body>", " ".join(TEXT.split())),
    (f'<body>{MENU}<div><div class="sec"><h2>One</h2>{P}</div><div class="sec"><h2>Two</h2>{P}<p>Short.</p></div><p>The end.</p></div><div>All rights reserved</div></body>', f"One\n{TEXT}\nTwo\n{TEXT}\nShort.\nThe end."),
    (f'<body><form method=post id=aspnetForm>{MENU}<div>{P}<ul><li>First point of it</li><li>Second point of it</li></ul></div><input name=q><div class="cookie-banner"><p>{SENTENCE * 3}</p></div></form></body>', f"{TEXT}\nFirst point of it\nSecond point of it"),
    (f'<body><div class="wrap">{MENU}<div class="ad">{SENTENCE}</div>{P}<blockquote>Said by someone.</blockquote>{P}<div class="related-posts"><p>{SENTENCE}</p></div></div>{FOOT}</body>', f"{TEXT}\nSaid by someone.\n{TEXT}"),
    ("<body><pre>line one\n  line two</pre></body>", "line one line two"),
]


@pytest.mark.parametrize("page, want", MARKED)
def test_pages_marked_by_hand(page, want):
    assert html_density.main_text(page) == want


def test_time_grows_with_the_page():
    n = 20_000
    began = time.perf_counter()
    for page in ("<b>" * n + "x" + "</i>" * n, "<i><section>" + "<b>" * n + "x" + "</i>" * n, "<b>" * n + "<hr>" * n, "<h3>comments</h3>" * n, "<div class=thread>x</div>" * n, "<li>" * n + "</ul>" * n):
        html_density.main_text(page)
    assert time.perf_counter() - began < 30
