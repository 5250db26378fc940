"""Main text of web pages by composite text density.

Every DOM node gets its characters, tags, link characters and link tags. Its density is characters per tag, weighted by a
logarithm that falls with the share of links. Its sum is the sum of the densities of its children, a run of text of its own
counting as a child. The subtree with the largest sum is the text. The smallest density on its path to the body is the
threshold: what stands beside the path belongs to the text if it reaches the threshold, and shorter blocks belong to it
where they stand among such text (or inside the article element that the path passes), or are the page's title. Outside
of that article element, what joins must have half of the best sum itself.

Tag names, roles and names are evidence, not verdicts: characters and tags of an element that looks like boilerplate
(navigation, forms, adverts, comments, ...) count as link characters and link tags, so it has no density and can't reach any
threshold. An element that holds the page's content loses that mark (_unwrap), however it is called. Readers' comments are
known by their names, by a heading over them, or as repeated items that carry an author and a time (_threads). Hidden
elements count for nothing.

Output: character references decoded, white space inside a block (br included) as one blank, blocks joined by newlines.

Defined cases: null or empty html and pages without text give an empty text. Unclosed and misnested tags are closed as
browsers close them; a lone "<" is text. Pages are handled whole, whatever their length, in time that grows with it. Null
and repeated ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table, text_batches, text_or_empty

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|audio|video|canvas|math|select|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split())
#: Elements that are closed by an opening tag of the same row, up to the nearest of the second set.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ()),
}
#: Closing tags don't reach beyond these.
FENCES = frozenset("table td th article main section aside nav".split())
#: An open paragraph is looked for up to the nearest of these.
STOPS = tuple((BLOCKS | FENCES) - {"p"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form button input label fieldset dialog menu head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar related recommended recommendations share sharing social "
    "newsletter subscribe subscription signup login paywall pagination pager skip".split()
)
#: Words that are boilerplate outside an article only: inside, they may hold its title.
OUTER_WORDS = frozenset("header masthead topbar banner footer foot legal copyright alert search".split())
TALK_WORDS = frozenset("comment comments commenters disqus respond reply replies responses reactions".split())
#: Words of comments that are also the names of an article's sections.
WEAK_TALK_WORDS = frozenset("conversation discussion discussions feedback reviews talk thread threads".split())
#: A name with one of these at either end speaks of a state, as in has-sidebar, no-ads or comments-open.
STATE_WORDS = frozenset("allow allowed closed disable disabled enable enabled has have hide is no non not off on open show with without".split())
#: Last words of names that say nothing: of sidebar-inner, sidebar counts. social-history is a history.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box btn button buttons card cell col column container content element entry feed first frame group holder icons inner item items label layer left line link links list main module "
    "outer panel placeholder post posts primary right row secondary section slot space text top unit widget widgets wrap wrapper zone".split()
)
AUTHOR_WORDS = frozenset("author avatar byline commenter nick nickname poster user username vcard".split())
TIME_WORDS = frozenset("ago date datetime posted published time timestamp".split())
#: Headings over comments, in the languages of the corpus.
TALK_HEADING = re.compile(
    r"(?i)\W*(?:[\d.,]+\s+|no\s+|all\s+|reader'?s?'?\s+|user\s+|view\s+|post\s+(?:a\s+)?|add\s+(?:a\s+)?|leave\s+(?:a\s+)?|join\s+the\s+|what\s+(?:our\s+)?readers\s+)*"
    r"(?:comments?|responses?|repl(?:y|ies)|reactions?|discussion|conversation|say|kommentare?|commentaires?|réactions?|comentarios?|respuestas?|antworten)(?:\s*\(?[\d.,]+\)?|\s+on\b.*|\s*:)?\W*"
)
STRONG_HEADING = re.compile(r"(?i)comment|repl|respon|kommentar|comentario|respuesta|antwort")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): next(x for x in (m[2], m[3], m[4], "") if x is not None) for m in ATTRIBUTE.finditer(source)}


def _named(names: str) -> set[str]:
    """The words that the names in a class or id are about."""
    out = set()
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in STATE_WORDS and len(words) > 1 or words[-1] in STATE_WORDS:
            continue
        while len(words) > 1 and words[-1] in PLAIN_WORDS:
            words.pop()
        out.add(words[-1])
    return out


class Stack:
    """Open elements, with the places of each tag name."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#page"]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: int, tag: str) -> None:
        self.places[tag].append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()

    def last(self, tags: tuple[str, ...] | frozenset[str]) -> int:
        """The place of the innermost of these, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags: tuple[str, ...], place: int) -> int:
        """The outermost of these beyond a place, or 0."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, place)) < len(p)]
        return min(found, default=0)


class Page:
    """Nodes as parallel lists, in page order; node 0 is the page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.inside, self.shape = ["#page"], [0], [False], [""]
        #: Boilerplate by the element's own name; hidden by its own attributes; comments; an article or main element.
        self.marked, self.hidden, self.talk, self.weak, self.core = [False], [False], [False], [False], [""]
        self.author, self.time, self.linked = [False], [False], [False]
        #: (node, text) in page order; (-1, "") where a block begins or ends.
        self.items: list[tuple[int, str]] = []
        self._read(source)
        self._threads()
        self._unwrap()
        self._add_up()

    def _open(self, tag: str, source: str, parent: int) -> int:
        node = len(self.tag)
        core = tag if tag in ("article", "main") else ""
        inside = self.inside[parent] or bool(core)
        boiler, hidden, talk, weak, shape = tag in BOILERPLATE_TAGS or tag == "header" and not inside, False, False, False, ""
        author, time = tag == "cite", tag == "time"
        if "=" in source or "hidden" in source:
            a = _attributes(source)
            role, shape = a.get("role", "").lower(), a.get("class", "")
            core = core or (role if role in ("main", "article") else "article" if a.get("itemprop") == "articleBody" else "")
            inside = inside or bool(core)
            names = f"{shape} {a.get('id', '')}"
            words, said = _named(names), {w.lower() for w in WORD.findall(names)}
            if tag not in ("html", "body") and not core:
                boiler = boiler or role in BOILERPLATE_ROLES or bool(words & BOILERPLATE_WORDS) or not inside and bool(words & OUTER_WORDS)
                weak = bool(words & WEAK_TALK_WORDS)
            if tag not in ("html", "body"):
                talk = bool(words & TALK_WORDS)
                boiler = boiler or tag == "article" and bool(words & BOILERPLATE_WORDS)
            author = author or bool(said & AUTHOR_WORDS) or a.get("rel") == "author" or a.get("itemprop") in ("author", "creator")
            time = time or bool(said & TIME_WORDS)
            hidden = a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or re.search(r"(?:^|\s)hidden(?=\s|/|$)", ATTRIBUTE.sub(" ", source)) is not None
        for column, value in (
            (self.tag, tag), (self.parent, parent), (self.inside, inside), (self.shape, shape), (self.marked, boiler or talk), (self.hidden, hidden), (self.talk, talk),
            (self.weak, weak), (self.core, core), (self.author, author), (self.time, time), (self.linked, self.linked[parent] or tag == "a"),
        ):
            column.append(value)
        return node

    def _text(self, node: int, text: str) -> None:
        self.items.append((node, entities.unescape(text) if "&" in text else text))

    def _read(self, source: str) -> None:
        stack, at, items = Stack(), 0, self.items
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(stack.nodes[-1], source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name = name.lower()
            if m[2] or m[5]:  # a closing tag
                place = stack.last((name,))
                if place and (name in BLOCKS or name in FENCES or place > stack.last(FENCES)):
                    stack.cut(place)
                if name in BLOCKS:
                    items.append((-1, ""))
                elif name in ("td", "th"):
                    items.append((stack.nodes[-1], " "))
                continue
            if name in ("br", "td", "th"):
                items.append((stack.nodes[-1], " "))
            if name in BLOCKS:
                items.append((-1, ""))
                # A block ends an open paragraph; in browsers only p holds no blocks.
                place = stack.places["p"][-1] if stack.places["p"] else 0
                if place and place > stack.last(STOPS):
                    stack.cut(place)
            if name in CLOSES:
                like, until = CLOSES[name]
                fence = stack.last(until)
                place = stack.first_after(like, fence) if name == "tr" else stack.last(like)
                if place > fence:
                    stack.cut(place)
            source_of = m[4] or m[7] or ""
            node = self._open(name, source_of, stack.nodes[-1])
            if name not in VOID and not source_of.endswith("/"):
                stack.push(node, name)
        if at < len(source):
            self._text(stack.nodes[-1], source[at:])

    def _threads(self) -> None:
        """Mark readers' comments that no name gives away."""
        n = len(self.tag)
        own: list[list[str]] = [[] for _ in range(n)]
        for node, piece in self.items:
            if node >= 0 and self._heading_of(node) is not None:
                own[self._heading_of(node)].append(piece)
        kids: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            kids[self.parent[node]].append(node)
        place = [0] * n
        for row in kids:
            for k, node in enumerate(row):
                place[node] = k
        # Sections with headings, by parent and tag: of more than two, none is a thread, as in a paper's Discussion.
        sections: dict[tuple[int, str], set[int]] = defaultdict(set)
        for node in range(1, n):
            if self.tag[node] in HEADINGS and self.parent[node]:
                up = self.parent[node]
                sections[self.parent[up], self.tag[up]].add(up)
        author, time = self.author[:], self.time[:]
        for node in range(n - 1, 0, -1):
            author[self.parent[node]] |= author[node]
            time[self.parent[node]] |= time[node]

        def mark(node: int) -> None:
            self.marked[node] = self.talk[node] = True

        def section(node: int) -> bool:
            return len(sections[self.parent[node], self.tag[node]]) > 2

        for node in range(1, n):
            if self.weak[node] and not section(node):
                mark(node)
        for node in range(n):
            if not own[node] or len(title := " ".join("".join(own[node]).split())) > 60 or not TALK_HEADING.fullmatch(title):
                continue
            up = self.parent[node]
            if not place[node] and self.tag[up] not in ("body", "html", "#page") and not self.core[up]:
                if not section(up):
                    mark(up)
                continue
            # The heading stands among other blocks: with it goes what follows, up to the next heading of its rank.
            after, k = kids[up], place[node] + 1
            while k < len(after) and not (self.tag[after[k]] in HEADINGS and self.tag[after[k]] <= self.tag[node]):
                k += 1
            rest = after[place[node] + 1 : k]
            if rest and (STRONG_HEADING.search(title) or all(self.tag[x] != "p" for x in rest)):
                for x in (node, *rest):
                    mark(x)
        for node in range(n):
            items: dict[tuple[str, str], list[int]] = defaultdict(list)
            for k in kids[node]:
                if author[k] and time[k] and self.tag[k] in ("li", "div", "article", "section", "dd", "details"):
                    items[self.tag[k], self.shape[k]].append(k)
            for like in items.values():
                if len(like) > 1:
                    for k in like:
                        mark(k)

    def _heading_of(self, node: int) -> int | None:
        """The heading that a node is or stands in directly."""
        for x in (node, self.parent[node]):
            if self.tag[x] in HEADINGS:
                return x
        return None

    def _unwrap(self) -> None:
        """Take the mark from elements that wrap the content: those around the largest article or main element, if it is a
        main element or larger than all text outside of marks, and those that hold more than half of the page's link-free
        text, if less than a quarter of that (comments: nothing) is outside of marks."""
        n = len(self.tag)
        if not any(self.marked):
            return
        plain = [0] * n
        for node, piece in self.items:
            if node >= 0 and not self.linked[node]:
                plain[node] += len(piece.strip())
        free = plain[:]  # of these, not in marked elements below
        for node in range(n - 1, 0, -1):
            if not self.hidden[node]:
                plain[self.parent[node]] += plain[node]
                free[self.parent[node]] += 0 if self.marked[node] else free[node]
        shown = [True] * n
        for node in range(1, n):
            shown[node] = shown[self.parent[node]] and not self.hidden[node]
        outside = free[0]
        for node in [i for i in range(n) if self.marked[i] and shown[i] and 2 * plain[i] > plain[0]]:
            if outside * 4 >= plain[node] or self.talk[node] and outside:
                break
            self.marked[node] = False
            outside += free[node]
        cores = [i for i in range(n) if self.core[i] and shown[i] and not self.marked[i] and plain[i]]
        if not cores:
            return
        main = [i for i in cores if self.core[i] == "main"]
        best = max(main or cores, key=lambda i: (plain[i], -i))
        around, up = [], self.parent[best]
        while up:
            around += [up] if self.marked[up] else []
            up = self.parent[up]
        if main or plain[best] > outside:
            for node in around:
                self.marked[node] = False

    def _add_up(self) -> None:
        n = len(self.tag)
        self.boiler, shown = self.marked[:], [not h for h in self.hidden]
        for node in range(1, n):
            up = self.parent[node]
            self.boiler[node], shown[node] = self.boiler[node] or self.boiler[up], shown[node] and shown[up]
        link_like = [b or a for b, a in zip(self.boiler, self.linked, strict=True)]
        self.chars, self.link_chars = [0] * n, [0] * n
        self.tags = [int(s) for s in shown]
        self.link_tags = [int(s and k) for s, k in zip(shown, link_like, strict=True)]
        runs: list[tuple[int, int]] = []
        for node, piece in self.items:
            if node >= 0 and shown[node] and (size := len(piece.strip())):
                self.chars[node] += size
                self.link_chars[node] += size if link_like[node] else 0
                runs.append((node, size))
        for node in range(n - 1, 0, -1):
            up = self.parent[node]
            for column in (self.chars, self.tags, self.link_chars, self.link_tags):
                column[up] += column[node]
        share = self.link_chars[0] / max(self.chars[0], 1)
        self.density = [composite_density(c, t, lc, lt, share) for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True)]
        self.sums = [0.0] * n
        for node in range(1, n):
            self.sums[self.parent[node]] += self.density[node]
        for node, size in runs:
            link = link_like[node]
            self.sums[node] += composite_density(size, 1, size * link, int(link), share)
        self.boiler = [b or not s for b, s in zip(self.boiler, shown, strict=True)]

    def content(self) -> list[bool]:
        """Which nodes belong to the main text."""
        n = len(self.tag)
        best = max((i for i in range(n) if not self.boiler[i]), key=lambda i: (self.sums[i], -i))
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        threshold = min((self.density[i] for i in path if self.tag[i] not in ("#page", "html")), default=self.density[0])
        above, under = set(path[1:]), [i == best for i in range(n)]
        for node in range(best + 1, n):
            under[node] = under[self.parent[node]]
        titled = any(u and t == "h1" for u, t in zip(under, self.tag, strict=True))
        # Titles: h1 and h2, and what holds nothing else.
        top, lower = ([self.chars[i] if self.tag[i] == t else 0 for i in range(n)] for t in ("h1", "h2"))
        for node in range(n - 1, 0, -1):
            for column, t in ((top, "h1"), (lower, "h2")):
                if self.tag[self.parent[node]] != t:
                    column[self.parent[node]] += column[node]
        # Beside the path: what reaches the threshold, and how much doesn't. Outside of an article element that the path passes,
        # a block must also have at least half of the best sum, so be a body of text itself.
        passed = any(self.inside[i] for i in path)
        dense, strong, short = set(), [0] * n, [0] * n
        for node in range(1, n):
            up = self.parent[node]
            if up in above and node not in above and node != best and not self.boiler[node]:
                plain = self.chars[node] - self.link_chars[node]
                if self.density[node] >= threshold and (not passed or self.inside[up] or 2 * self.sums[node] >= self.sums[best]):
                    dense.add(node)
                    strong[up] += plain
                else:
                    short[up] += plain
        whole = {i for i in above if self.inside[i] or strong[i] and strong[i] >= short[i]}
        keep = [False] * n
        keep[best] = True
        for node in range(n):
            up = self.parent[node]
            if self.boiler[node]:
                keep[node] = False
            elif node in above:
                keep[node] = node in whole
            elif node == best:
                keep[node] = True
            elif up in above:
                title = self.chars[node] and (top[node] == self.chars[node] and not titled or top[node] + lower[node] == self.chars[node] and self.tag[up] != "body")
                keep[node] = up in whole or node in dense or title
            elif node:
                keep[node] = keep[up]
        return keep

    def text(self) -> str:
        keep = self.content()
        blocks, current = [], []
        for node, piece in [*self.items, (-1, "")]:
            if node >= 0:
                if keep[node]:
                    current.append(piece)
            elif current:
                if line := " ".join("".join(current).split()):
                    blocks.append(line)
                current = []
        return "\n".join(blocks)


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, weighted by links; share is that of link characters in the whole page."""
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    weight = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(weight, 1.0)) / base


def main_text(source: str) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
