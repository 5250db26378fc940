"""Text functions on columns. Patterns of the default lexicons are Unicode-aware: (?U) makes \\d and \\s match all scripts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """One alternation instead of a chain of tests."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def contains_all(c: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.contains(w) for w in words], F.lit(True))


def first_rule(c: Column, rules: list[tuple[str, str]], missing: str, otherwise: str) -> Column:
    """The value of the first pattern that is found in c (T18x, J18)."""
    out = F.when(F.coalesce(c, F.lit("")) == "", F.lit(missing))
    for pattern, value in rules:
        out = out.when(c.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def first_prefix(c: Column, table: dict[str, list[str]], otherwise: str) -> Column:
    """The first group one of whose prefixes starts c (T5x)."""
    out = None
    for value, prefixes in table.items():
        test = reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(otherwise))


def longest_prefix(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The value of the longest prefix that starts c (T6x): the table is tested from its longest entry down."""
    out = None
    for prefix in sorted(table, key=lambda p: (-len(p), p)):
        out = F.when(c.startswith(prefix), table[prefix]) if out is None else out.when(c.startswith(prefix), table[prefix])
    return out.otherwise(otherwise)


def formal_refs(body: Column, pattern: str = L.FORMAL_REF) -> Column:
    """T1x: reference numbers in order of appearance."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(1))


def named_refs(body: Column, pattern: str = L.NAMED_REF) -> Column:
    """T2x: names in book quotes, 8 to 100 characters."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), F.lit(1))


def is_policy(name: Column, words: Iterable[str] = L.POLICY_WORDS, excluded: Iterable[str] = L.NOT_POLICY_WORDS) -> Column:
    """T3x: excluded words win."""
    return contains_any(name, words) & ~contains_any(name, excluded)


def named_level(name: Column) -> Column:
    """T4x: level of a named reference, six tests in order."""
    district = contains_any(name, L.DISTRICT_NAMES)
    return (
        F.when(contains_any(name, L.CENTRAL_NAMES), "central")
        .when(contains_any(name, L.PROVINCIAL_NAMES), "provincial")
        .when(name.contains("深圳市") & ~district, "municipal")
        .when(district, "district")
        .when(name.contains("深圳") & ~name.contains("区"), "municipal")
        .otherwise("unknown")
    )


def strip_meta(number: Column, metas: list[str] = L.META_PREFIXES) -> Column:
    """Each meta prefix once, in order."""
    for meta in metas:
        number = F.regexp_replace(number, f"^{re.escape(meta)}", "")
    return number


def admin_level(number: Column, table: dict[str, list[str]] = L.LEVEL_PREFIXES) -> Column:
    """T5x: level by the document number's prefix."""
    return first_prefix(strip_meta(F.coalesce(number, F.lit(""))), table, "unknown")


def issuer(number: Column, table: dict[str, str] = L.ISSUERS) -> Column:
    """T6x: issuer by longest prefix, else the leading characters, else Unknown."""
    lead = F.regexp_extract(number, r"^([\x{4e00}-\x{9fff}]+)", 1)
    return longest_prefix(number, table, F.when(lead != "", lead).otherwise("Unknown"))


def normalize_ref(ref: Column, lead_in: str = L.LEAD_IN) -> Column:
    """T7x: without words that lead in."""
    return F.trim(F.regexp_replace(ref, lead_in, ""))


def ref_core(ref: Column) -> Column:
    """T8x: bracketed year and number at the end, or ''."""
    return F.regexp_extract(ref, f"(?U){L.FORMAL_CORE}", 0)


def ref_issuer(ref: Column) -> Column:
    """T8x: what stands before the core; null without a core."""
    core = ref_core(ref)
    return F.when(core != "", F.substring(ref, F.lit(1), F.length(ref) - F.length(core)))


def norm_title(title: Column, punctuation: str = L.TITLE_PUNCTUATION, prefix: str = L.TITLE_PREFIX) -> Column:
    """T11x."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), f"(?U){punctuation}", "")
    return F.regexp_replace(bare, f"^{prefix}", "") if prefix else bare


def norm_docnum(number: Column) -> Column:
    """T12x."""
    return F.regexp_replace(F.coalesce(number, F.lit("")), f"(?U){L.DOCNUM_PUNCTUATION}", "")


def source_level(number: Column, site_level: Column) -> Column:
    """T13x: the number's level, else the site's; department counts as municipal."""
    site = F.when(site_level == "department", "municipal").otherwise(F.coalesce(site_level, F.lit("unknown")))
    return F.coalesce(F.nullif(admin_level(number), F.lit("unknown")), site)


def occurrences(c: Column, term: str) -> Column:
    """T29x: count of a term, not overlapping."""
    return (F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))


def relevance(title: Column, body: Column, keywords: Column, terms: dict[str, int] = L.AI_TERMS) -> Column:
    """T19x/T20x: weighted keyword density from 0 to 1. Titles and keywords count three times; from the fourth mention on
    a term grows with the square root; length and number of distinct terms are allowed for."""
    body, head = F.coalesce(body, F.lit("")), F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(keywords, F.lit("")))
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in terms.items()])
    count = lambda c, t: (F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)
    effective = lambda n: F.when(n > 3, 3 + F.sqrt(F.greatest(n - 3, F.lit(0.0)))).otherwise(n)
    # Terms that don't occur drop out before anything is counted; the sum runs over the table, so the plan stays small.
    present = F.filter(table, lambda e: F.contains(body, e["t"]) | F.contains(head, e["t"]))
    parts = F.transform(present, lambda e: e["w"] * (effective(count(body, e["t"])) + 3 * count(head, e["t"])))
    raw, hits = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x), F.size(present)
    density = raw / F.sqrt(F.greatest(F.length(body), F.lit(100)))
    adjusted = density * (1 + F.least(hits, F.lit(8)) * 0.1)
    score = F.bround(F.least(adjusted / (adjusted + 8), F.lit(1.0)), 3)
    # The alternation is tested first: most texts hold no term and skip the count of all terms.
    return F.when(contains_any(F.concat_ws(" ", head, body), sorted(terms, key=len, reverse=True)), score).otherwise(F.lit(0.0))


def amounts(body: Column) -> Column:
    """T21x: array of (value in ten thousands, raw, context) within 0.5 and 10 million.
    The context is greedy, as the results are defined: it takes all but the last digit of a whole number."""
    group = lambda k: F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(f"(?U){L.AMOUNT_IN_CONTEXT}"), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("before"), group(2).alias("number"), group(3).alias("unit"), group(4).alias("after"))
    items = F.transform(
        zipped,
        lambda m: F.struct(
            (m["number"].cast("double") * F.when(m["unit"] == "亿元", 10000.0).otherwise(1.0)).alias("amount_value"),
            F.concat(m["number"], m["unit"]).alias("amount_raw"),
            F.substring(F.concat(F.trim(m["before"]), m["number"], m["unit"], F.trim(m["after"])), 1, 200).alias("amount_context"),
        ),
    )
    return F.filter(items, lambda x: x["amount_value"].between(0.5, 10000000))


def plain_amounts(body: Column) -> Column:
    """As amounts() without context, which there may swallow leading digits: array of (value, raw)."""
    group = lambda k: F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?U)(\d+(?:\.\d+)?)\s*(万元|亿元)"), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("number"), group(2).alias("unit"))
    items = F.transform(zipped, lambda m: F.struct((m["number"].cast("double") * F.when(m["unit"] == "亿元", 10000.0).otherwise(1.0)).alias("amount_value"), F.concat(m["number"], m["unit"]).alias("amount_raw")))
    return F.filter(items, lambda x: x["amount_value"].between(0.5, 10000000))


def sectors(body: Column, words: list[str] = L.SECTORS) -> Column:
    """T22x: the words that occur, in the list's order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.coalesce(body.contains(w), F.lit(False)))


def masthead_number(body: Column, jurisdiction: Column | None = None, head: int = 140) -> Column:
    """T23x: first reference number among the first characters; a site's jurisdiction sign must lead it if given."""
    found = F.regexp_extract(F.substring(F.coalesce(body, F.lit("")), 1, head), f"(?U){L.FORMAL_REF}", 1)
    return found if jurisdiction is None else F.when(found.startswith(jurisdiction), found).otherwise("")


def language_ratio(text: Column) -> Column:
    """T30x: CJK share of letters; 0 without letters."""
    cjk = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when(cjk + latin > 0, cjk / (cjk + latin)).otherwise(F.lit(0.0))


def slug_title(slug: Column, small: Iterable[str] = ("of", "the", "and", "for", "in", "on", "to", "a", "an")) -> Column:
    """T31x: words of a slug in title case; small words stay low except at the start."""
    words = F.split(slug, "-")
    keep = F.array(*[F.lit(w) for w in small])
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(keep, w), w).otherwise(F.initcap(w))), " ")


def key_block(text: Column, keys: Iterable[str]) -> Column:
    """T32x: 'Key: value' lines as a map."""
    pairs = []
    for k in keys:
        pairs += [F.lit(k), F.trim(F.regexp_extract(text, rf"(?im)^\s*{re.escape(k)}\s*[:：]\s*(.*)$", 1))]
    return F.create_map(*pairs)


def strip_punctuation(c: Column, marks: str = "《》「」『』【】（）()“”\"'‘’，。、；：！？· ") -> Column:
    """T26x."""
    return F.translate(c, marks, "")


def snippet(text: Column, query: str, size: int = 150) -> Column:
    """T27x: a window around the first hit, with the hit marked; the start of the text without one."""
    at = F.locate(query, text)
    start = F.greatest(F.lit(1), at - F.lit(size // 2))
    part = F.when(at > 0, F.substring(text, start, F.lit(size))).otherwise(F.substring(text, 1, size))
    return F.replace(part, F.lit(query), F.lit(f"<mark>{query}</mark>"))


def marks(text: Column) -> Column:
    """T28x: text with {marked} clauses -> array of (text, marked)."""
    parts = F.split(text, r"[{}]")
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("marked"))), lambda s: s["text"] != "")


def flatten(text: Column, size: int = 260) -> Column:
    """white space as single blanks, cut."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, size)


def looks_corrupted(text: Column, share: float = 0.3) -> Column:
    """T41x: too many question marks."""
    return (F.length(text) > 0) & (occurrences(text, "?") / F.length(text) > share)


def has_chinese(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def translation_faults(source: Column, target: Column) -> Column:
    """T39x: names of failed checks: length ratio, missing numbers, long untranslated run."""
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    missing = F.size(F.array_except(F.regexp_extract_all(source, F.lit(r"\d{2,}"), F.lit(0)), F.regexp_extract_all(target, F.lit(r"\d{2,}"), F.lit(0)))) > 0
    return F.array_compact(F.array(F.when((ratio < 0.5) | (ratio > 10), "length"), F.when(missing, "number"), F.when(target.rlike(r"[\x{4e00}-\x{9fff}]{15,}"), "untranslated")))


def glossary_subset(text: Column, glossary: dict[str, str]) -> Column:
    """T40x: entries whose term occurs."""
    table = F.create_map(*[F.lit(x) for kv in glossary.items() for x in kv])
    return F.map_filter(table, lambda k, _: text.contains(k))


def normalize_org(org: Column) -> Column:
    """T35x: organisation key of a post, or null."""
    text = F.trim(org)
    cut = F.lit(None).cast("int")
    for marker in reversed(L.POST_MARKERS):
        at = F.instr(text, marker) - 1
        cut = F.when(at > 4, at).otherwise(cut)
    kept = F.regexp_replace(F.when(cut.isNull(), text).otherwise(F.substring(text, F.lit(1), cut)), r"(?U)[，,、；;\s]+$", "")
    good = contains_any(kept, L.ORG_SIGNS) & F.length(kept).between(4, 50) & ~contains_any(text, L.NOT_ORGS)
    return F.when(good, kept)


def llm_json(raw: Column, schema: str) -> Column:
    """T43x: the outermost {...} of a model's answer, fences and talk around it ignored; null if it isn't JSON."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)


def clamp(value: Column, allowed: Iterable[str], otherwise: str) -> Column:
    """T43x: a value of a closed list."""
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(otherwise))


def truncate_marked(snippet: Column, most: int = 150) -> Column:
    """T27x: cut at `most` characters, but never inside a marked word; cut texts end in an ellipsis."""
    s = F.coalesce(snippet, F.lit(""))
    cut = F.substring(s, 1, most)
    last = lambda tag: F.length(cut) - F.length(F.substring_index(cut, tag, -1))  # noqa: E731  0 without the tag
    inside = last("<mark>") > last("</mark>")
    end = F.locate("</mark>", F.substring(s, last("<mark>") + 1, F.length(s)))
    whole = F.substring(s, F.lit(1), last("<mark>") + end + F.lit(len("</mark>") - 1))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.when(inside & (end > 0), whole).otherwise(cut), F.lit("…")))
