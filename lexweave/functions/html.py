"""HTML and URL functions on columns; procedural ones as Arrow-batched functions at the end."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date
from itertools import accumulate
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ends of article addresses in their order of precedence; y, m and d are the day's parts.
ARTICLE_ADDRESSES = [
    r"t(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})_\d+\.s?html?",
    r"/art/(?P<y>\d{4})(?:/(?P<m>\d{1,2})/(?P<d>\d{1,2}))?/art_[0-9a-f_]+\.s?html?",
    r"/(?P<y>\d{4})-(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?:content|c)_\d+\.s?html?",
    r"/(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})/[0-9a-f]{8,}/c\.s?html?",
    r"/web/[^\"]*?/(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})\d{4,}/index\.s?html?",
    r"/(?P<y>\d{4})/(?P<m>\d{2})/(?P<d>\d{2})/ARTI\d+\.s?html?",
    r"/\d{5,9}/index\.s?html?",
    r"/(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})\d{4,}/index\.s?html?",
    r"/(?P<y>\d{4})(?P<m>\d{2})/[0-9a-f]{32}\.s?html?",
    r"/pnidpv\d+\.s?html?",
    r"/c\d+/content\.s?html?",
    r"/portal/article/\d+/[0-9a-f]{8,}",
    r"/p1/(?:\d+/)+\d+\.s?html?",
    r"/fabu/xiangqing/\d+\.s?html?",
    r"/(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})/\d+\.s?html?",
    r"/safe/(?P<y>\d{4})/(?P<m>\d{2})(?P<d>\d{2})/\d+\.s?html?",
    r"/(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})/\d+\.s?html?",
    r"/(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})/[0-9a-f]{32}\.s?html?",
    r"/columns/[a-f0-9-]{36}/(?P<y>\d{4})(?P<m>\d{2})/(?P<d>\d{2})/[a-f0-9-]{36}\.s?html?",
    r"/(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})/[0-9a-f]{32}\.s?html?",
]

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def to_text(html: Column) -> Column:
    """H5: scripts, styles and comments go, block ends become line breaks, tags go, common entities are decoded."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", "")
    for entity, text in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{3000}]+", " "), r"\s*\n\s*", "\n"))


def container(html: Column, opening: str, ends: list[str]) -> Column:
    """The source from a container's opening pattern up to the first end marker, cut before any costly pattern."""
    start = F.regexp_instr(html, F.lit(opening))
    rest = F.substring(html, start, F.length(html))
    cuts = [F.nullif(F.instr(rest, e), F.lit(0)) for e in ends]
    cut = F.least(*cuts, F.length(rest) + 1) if cuts else F.length(rest) + 1
    return F.when(start > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise("")


def body_text(html: Column, opening: str, ends: list[str], least: int = 50) -> Column:
    """H1: text of the container, '' if shorter than least."""
    text = to_text(container(html, opening, ends))
    return F.when(F.length(text) >= least, text).otherwise("")


def embedded_json(html: Column, key: str) -> Column:
    """H2: a JSON string value inside a page, unescaped."""
    raw = F.regexp_extract(html, rf'"{key}"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    return F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]


def paragraphs(html: Column, noise: str | None = None, least: int = 1) -> Column:
    """H7: texts of p elements without noise."""
    inner = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), to_text)
    keep = F.filter(inner, lambda p: F.length(p) >= least)
    return F.filter(keep, lambda p: ~p.rlike(noise)) if noise else keep


def title(html: Column, suffix: str = r"\s*[|_-][^|_-]*$") -> Column:
    """H8: og:title, h1, title in this order; of title the site's suffix goes."""
    found = lambda p: F.nullif(F.trim(to_text(F.regexp_extract(html, p, 1))), F.lit(""))
    return F.coalesce(found(r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"'), found(r"(?is)<h1\b[^>]*>(.*?)</h1>"), F.regexp_replace(found(r"(?is)<title>(.*?)</title>"), suffix, ""), F.lit(""))


def links(html: Column) -> Column:
    """Hrefs in page order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))


def attachment(html: Column, patterns: list[str] | None = None) -> Column:
    """H9: the first attachment address by ordered patterns."""
    patterns = patterns or [rf'(?i)href="([^"]+\.{e})"' for e in ("pdf", "docx", "doc", "xlsx", "xls", "zip")]
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns], F.lit(""))


def is_stub(body: Column, hints: str, most: int = 200) -> Column:
    """a short body that points elsewhere."""
    return (F.length(F.coalesce(body, F.lit(""))) < most) & F.coalesce(body, F.lit("")).rlike(hints)


SOFT_404_WORDS = r"(?i)找不到|页面不存在|not found|404|无法找到|错误页面"  # fixed values


def soft_404(body: Column, most: int = 2000, words: str = SOFT_404_WORDS) -> Column:
    """A body shorter than most, blanks at its ends aside, that says that the page is missing. Empty or null: no."""
    return F.coalesce((F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) < most) & body.rlike(words), F.lit(False))


def cms(html: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first system whose sign the page has."""
    out = F.lit("unknown")
    for pattern, name in reversed(rules):
        out = F.when(html.rlike(pattern), name).otherwise(out)
    return out


def source_status(http: Column, system: Column, held: Column) -> Column:
    """A source is crawled if documents of it are held; else its answer and page system decide."""
    answers = http == "200"
    return F.when(held, "CRAWLED").when(answers & (system != "unknown"), "BUILDABLE").when(answers, "REACHABLE-UNKNOWN-CMS").when(http.isin("403", "412", "406"), "ANTI-BOT").otherwise("BLOCKED")


def meta(html: Column, name: str) -> Column:
    """T33x: content of a meta tag."""
    return F.regexp_extract(html, rf'(?is)<meta[^>]+name="{re.escape(name)}"[^>]+content="([^"]*)"', 1)


def table_pairs(html: Column) -> Column:
    """T33x: label and value cells as a map; of equal labels the last counts."""
    part = lambda k: F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>"), F.lit(k)), to_text)
    return F.map_from_entries(F.array_distinct(F.transform(F.map_entries(F.map_from_arrays(F.transform(part(1), lambda x, i: F.concat_ws("\u0001", i, x)), part(2))), lambda e: F.struct(F.substring_index(e["key"], "\u0001", -1).alias("key"), e["value"].alias("value")))))


def normalize_url(url: Column) -> Column:
    """Without scheme, query, fragment, www. and trailing slash."""
    c = F.regexp_replace(F.trim(url), r"^(?:https?:)?//", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^www\.", "")
    return F.regexp_replace(c, r"/+$", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?:)?//([^/?#]+)", 1)


def same_site(url: Column, page: Column) -> Column:
    """same host (or relative) and no climbing path."""
    return ((host(url) == "") | (host(url) == host(page))) & ~url.contains("/../")


def section(url: Column) -> Column:
    """First path segment."""
    return F.regexp_extract(url, r"^(?:https?:)?//[^/]+/([^/?#]+)", 1)


def url_day(url: Column) -> Column:
    """A day in the address, or null."""
    p = r"(?:^|[^\d])((?:19|20)\d{2})[-/]?(0[1-9]|1[0-2])[-/]?(0[1-9]|[12]\d|3[01])(?:[^\d]|$)"
    return F.when(url.rlike(p), F.try_to_date(F.concat_ws("-", *[F.regexp_extract(url, p, k) for k in (1, 2, 3)]), "yyyy-MM-dd"))


def total_pages(html: Column, patterns: list[str], per_page: int | None = None) -> Column:
    """The first pattern that gives a number; a count of rows is divided by per_page and rounded up."""
    n = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")).cast("int") for p in patterns], F.lit(1))
    return F.ceil(n / per_page).cast("int") if per_page else n


def flat_json(raw: Column) -> Column:
    """A JSON object of plain values as a map."""
    return F.from_json(raw, "map<string,string>")


@F.pandas_udf(StringType())
def balanced_div(htmls: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """H4: inner source of the div whose opening tag contains the marker, up to its own closing tag."""
    tags = re.compile(r"<(/?)div\b[^>]*>", re.I)

    def cut(html: str | None, marker: str | None) -> str:
        opening = re.search(rf"<div\b[^>]*{re.escape(marker or '')}[^>]*>", html or "", re.I)
        if not opening:
            return ""
        depth = 1
        for m in tags.finditer(html, opening.end()):
            depth += -1 if m[1] else 1
            if not depth:
                return html[opening.end() : m.start()]
        return html[opening.end() :]

    for html, marker in htmls:
        yield pd.Series([cut(h, m) for h, m in zip(html, marker, strict=True)])


@F.pandas_udf(StringType())
def densest_div(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """H3: of the elements whose p characters reach nine tenths of the most, the innermost; its p texts, a line each."""
    token = re.compile(r"<(/?)(div|p|td|section|article)\b[^>]*>", re.I)

    def best(html: str | None) -> str:
        stack, spans = [], []
        for m in token.finditer(re.sub(r"(?is)<(script|style)\b.*?</\1>", "", html or "")):
            if m[1]:
                while stack and stack[-1][0] != m[2].lower():
                    stack.pop()
                if stack:
                    tag, start, depth = stack.pop()
                    spans.append((tag, start, m.start(), depth))
            else:
                if m[2].lower() == "p" and stack and stack[-1][0] == "p":
                    tag, start, depth = stack.pop()
                    spans.append((tag, start, m.start(), depth))
                stack.append((m[2].lower(), m.end(), len(stack)))
        source = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", html or "")
        clean = lambda s: " ".join(re.sub(r"<[^>]+>", " ", s).split())
        texts = sorted((a, b, clean(source[a:b])) for t, a, b, _ in spans if t == "p")
        # Spans nest, so the paragraphs of a box are those that start in it.
        starts, sizes = [a for a, *_ in texts], [0, *accumulate(len(x) for *_, x in texts)]
        boxes = [(sizes[bisect_left(starts, b)] - sizes[bisect_left(starts, a)], d, a, b) for t, a, b, d in spans if t != "p"]
        if not boxes or not max(boxes)[0]:
            return "\n".join(x for *_, x in texts if x)
        most = max(boxes)[0]
        _, _, a, b = max((x for x in boxes if x[0] >= 0.9 * most), key=lambda x: (x[1], -x[2]))
        return "\n".join(x for p, q, x in texts if a <= p and q <= b and x)

    for html in htmls:
        yield pd.Series([best(h) for h in html])


def list_rows(html: Column, page_url: Column, addresses: list[str] | None = None, before: int = 240, after: int = 60) -> Column:
    """H6: articles (url, title, day) of a list page, in page order.

    An anchor counts if its address ends like one of the addresses, the first of which gives the day, and stays on the
    page's host. The title comes from an attribute, else from the anchor's text; a day near the anchor goes before the
    address's. The first anchor of an address counts, even if it has no title and so gives no row. Null page: no rows;
    days that don't exist: null.
    """
    # Of several ends the first in the list counts, whichever starts earlier in the address.
    ends = [re.compile(rf"(?:{p})\Z") for p in addresses or ARTICLE_ADDRESSES]
    opening = re.compile(r'<a\s[^<>]*?\bhref="([^"]*)"[^<>]*>', re.I)
    closing, attribute, near = re.compile(r"</a>", re.I), re.compile(r'title="([^"]+)"'), re.compile(r"\d{4}-\d{2}-\d{2}")

    def day(y: str, m: str, d: str) -> date | None:
        try:
            return date(int(y), int(m), int(d))
        except ValueError:
            return None

    def plain(text: str) -> str:
        return " ".join(entities.unescape(re.sub(r"<[^>]*>", "", text)).split())

    def rows(page: str | None, base: str | None) -> list[dict]:
        page, base = page or "", base or ""
        stops, out, seen = [m.start() for m in closing.finditer(page)], [], set()
        for m in opening.finditer(page):
            found = next((f for f in (e.search(m[1]) for e in ends) if f), None)
            k = bisect_left(stops, m.end())
            if not found or k == len(stops):
                continue
            try:
                url = urljoin(base, entities.unescape(m[1]))
                inside = urlparse(url).netloc == urlparse(base).netloc and "/../" not in url
            except ValueError:
                continue
            if url in seen:
                continue
            seen.add(url)
            named = attribute.search(page, m.start(), stops[k])
            title = plain(named[1] if named else page[m.end() : stops[k]])
            if inside and title:
                parts = found.groupdict()
                beside = near.search(page, max(0, m.start() - before), stops[k] + len("</a>") + after)
                when = day(*beside[0].split("-")) if beside else day(parts["y"], parts.get("m") or "1", parts.get("d") or "1") if "y" in parts else None
                out.append({"url": url, "title": title, "day": when})
        return out

    @F.pandas_udf("array<struct<url:string,title:string,day:date>>")
    def listed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, urls in batches:
            yield pd.Series([rows(p, u) for p, u in zip(pages, urls, strict=True)], dtype=object)

    return listed(html, page_url)


@F.pandas_udf(StringType())
def balanced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The value in braces or square brackets that follows the opening pattern, up to its own end. Brackets inside quoted
    strings don't count. Null if there is none or it doesn't end."""
    token = re.compile(r"""\"(?:[^"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{}\[\]]""", re.S)

    def cut(text: str | None, opening: str) -> str | None:
        start = re.search(opening + r"(?=[{\[])", text or "")
        depth = 0
        for m in token.finditer(text, start.end()) if start else ():
            depth += (m[0] in "{[") - (m[0] in "}]")
            if not depth:
                return text[start.end() : m.end()]
        return None

    for texts, openings in batches:
        yield pd.Series([cut(t, o) for t, o in zip(texts, openings, strict=True)], dtype=object)
