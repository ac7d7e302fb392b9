"""Text, titles, dates and links of pages, as expressions over the arrays of ``html.PAGE``.

An element's strings are a slice of the page's, and what is below it is a range of numbers, so no rule walks a tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import squeeze_space

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """Where a kind of page has its text: roots in order of choice (or all of them), what is removed, what is taken."""

    roots: tuple[str, ...]
    removed: tuple[str, ...] = ()
    taken: tuple[str, ...] = ("p", "h1", "h2", "h3", "li")
    least: int = 40
    least_for: tuple[str, ...] | None = None  # the tags that ``least`` holds for; None: all
    all_roots: bool = False
    fold_case: bool = True
    squeezed: bool = True
    unwanted: tuple[str, ...] = ()  # a block that holds all of these is left out


# The extraction rules of each kind of page, where dates are, and selectors that always give their first element alone.
_CHROME = ("script", "style", "noscript", "header", "footer", "form", "aside")
RULES = {
    "encyclopedia": Rule(
        ("div.mw-parser-output", "div#mw-content-text"),
        ("table", "div.navbox", "div.infobox", "div.reflist", "div.mw-editsection", "sup.reference", "span.mw-editsection", "div#toc", "div.thumb", "ol.references", "ul.gallery"),
        ("p", "h2", "h3", "li"),
    ),
    "news": Rule(("article", "[itemprop=articleBody]", "main"), _CHROME),
    "blog": Rule(("article", "main"), _CHROME, least=30, unwanted=("подпис", "телег")),
    "early_news": Rule(
        ("article", "[itemprop=articleBody]", ".article__content", ".content", ".article-content", ".text", "main"),
        taken=("p",), all_roots=True, fold_case=False, squeezed=False,
    ),
    "early_blog": Rule(
        ("article", "main", ".content", ".article__content", ".post__content", ".text", ".material-content"),
        taken=("p", "h2", "h3", "li"), least_for=("p",), all_roots=True, fold_case=False,
    ),
}
DATE_METAS = (
    ("property", "article:published_time"), ("name", "article:published_time"), ("property", "og:pubdate"),
    ("name", "pubdate"), ("itemprop", "datePublished"), ("name", "date"),
)
ONCE = {"article", "[itemprop=articleBody]", "main"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def attribute(e: Column, name: str) -> Column:
    return F.coalesce(e["attrs"][F.lit(name)], F.lit(""))


def has_word(e: Column, name: str, word: str) -> Column:
    return F.array_contains(F.split(attribute(e, name), r"[ \t\n\r\f]+"), word)


def fits(selector: str) -> Test:
    """A test for ``tag``, ``tag.class``, ``.class``, ``tag#id`` or ``[name=value]``."""
    if m := re.fullmatch(r"\[([\w-]+)=([\w-]+)\]", selector):
        return lambda e: attribute(e, m[1]) == m[2]
    tag, sign, name = re.fullmatch(r"([\w-]*)([.#]?)([\w-]*)", selector).groups()
    tests: list[Test] = [lambda e: e["tag"] == tag] if tag else []
    tests += [{".": lambda e: has_word(e, "class", name), "#": lambda e: attribute(e, "id") == name}[sign]] if sign else []
    return lambda e: tests[0](e) & tests[1](e) if len(tests) > 1 else tests[0](e)


def any_of(selectors: tuple[str, ...]) -> Test:
    def test(e: Column) -> Column:
        out = F.lit(False)
        for s in selectors:
            out = out | fits(s)(e)
        return out

    return test


def numbered(page: Column) -> Column:
    """The elements, each with its number ``i``."""
    return F.transform(page["elements"], lambda e, i: F.struct(i.cast("int").alias("i"), *[e[c].alias(c) for c in ("tag", "attrs", "last", "first", "n")]))


def all_that(elements: Column, test: Test) -> Column:
    return F.filter(elements, test)


def first_that(elements: Column, test: Test) -> Column:
    return F.get(F.filter(elements, test), F.lit(0))


def shown(strings: Column, e: Column) -> Column:
    """What an element shows: ``strings`` within it, joined by spaces; null ones are left out."""
    return F.array_join(F.slice(strings, e["first"] + 1, e["n"]), " ")


def visible(page: Column) -> Column:
    return F.transform(page["strings"], lambda t: F.when(~t["silent"], t["text"]))


def _roots(page: Column, elements: Column, rule: Rule) -> Column:
    spot = [F.lit(x).cast("int") for x in (-1,)] + [F.lit(None), F.lit(None), F.size(elements), F.lit(0).cast("int"), F.size(page["strings"])]
    kinds = ("int", "string", "map<string,string>", "int", "int", "int")
    whole = F.array(F.struct(*[v.cast(k).alias(c) for v, k, c in zip(spot, kinds, ("i", "tag", "attrs", "last", "first", "n"), strict=True)]))
    found = [F.slice(all_that(elements, fits(s)), 1, 1) if s in ONCE or not rule.all_roots else all_that(elements, fits(s)) for s in rule.roots]
    every = F.concat(*found)
    return let(every, lambda x: F.when(F.size(x) > 0, x if rule.all_roots else F.slice(x, 1, 1)).otherwise(whole))


def _lines(page: Column, elements: Column, rule: Rule, root: Column) -> Column:
    """The blocks below a root as lines, those that the rule takes."""
    within = lambda e: (e["i"] > root["i"]) & (e["i"] <= root["last"])
    removed = all_that(elements, lambda e: within(e) & any_of(rule.removed)(e)) if rule.removed else None

    def of(gone: Column | None) -> Column:
        inside = lambda i: F.exists(gone, lambda r: (r["i"] <= i) & (i <= r["last"]))
        cut = lambda i: F.exists(gone, lambda r: (r["first"] <= i) & (i < r["first"] + r["n"]))
        strings = visible(page) if gone is None else F.transform(visible(page), lambda t, i: F.when(~cut(i), t))
        blocks = all_that(elements, lambda e: within(e) & e["tag"].isin(*rule.taken) & (~inside(e["i"]) if gone is not None else F.lit(True)))
        text = (lambda s, b: squeeze_space(shown(s, b))) if rule.squeezed else shown
        lines = let(strings, lambda s: F.transform(blocks, lambda b: F.struct(b["tag"].alias("tag"), text(s, b).alias("t"))))
        held = (lambda x: F.lit(True)) if rule.least_for is None else lambda x: x["tag"].isin(*rule.least_for)
        low = lambda x: F.lower(x["t"])

        def wanted(x: Column) -> Column:
            ok = (x["t"] != "") & ~((F.length(x["t"]) < rule.least) & held(x))
            for n, part in enumerate(rule.unwanted):
                bad = F.contains(low(x), F.lit(part)) if n == 0 else bad & F.contains(low(x), F.lit(part))
            return ok & ~bad if rule.unwanted else ok

        return F.transform(F.filter(lines, wanted), lambda x: x["t"])

    return of(None) if removed is None else let(removed, of)


def main_text(page: Column, rule: Rule) -> Column:
    """The distinct blocks of a page's main part, in order, a line each."""

    def text(elements: Column) -> Column:
        lines = F.flatten(F.transform(_roots(page, elements, rule), lambda root: _lines(page, elements, rule, root)))
        if not rule.fold_case:
            return F.array_join(F.array_distinct(lines), "\n")

        def once(x: Column) -> Column:
            return let(F.transform(x, F.lower), lambda keys: F.filter(x, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1))

        return F.array_join(let(lines, once), "\n")

    return let(numbered(page), text)


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def title(page: Column, with_og: bool) -> Column:
    """The first heading, else (``with_og``) og:title, else the title element."""
    elements = page["elements"]
    of = lambda tag: squeeze_space(shown(visible(page), first_that(elements, fits(tag))))
    content = lambda e: squeeze_space(attribute(e, "content"))
    metas = F.filter(elements, lambda e: (e["tag"] == "meta") & (attribute(e, "property") == "og:title") & (content(e) != ""))
    og = [_filled(content(F.get(metas, F.lit(0))))] if with_og else []
    return F.coalesce(_filled(of("h1")), *og, of("title"), F.lit(""))


def _meta(name: str, value: str) -> Test:
    return lambda e: (e["tag"] == "meta") & (attribute(e, name) == value)


def date(page: Column, keys: tuple[str, ...]) -> Column:
    """A page's date as it is written: of a time element, a meta element, or JSON-LD under one of ``keys``."""
    elements = page["elements"]
    stripped = lambda e, name: F.trim(squeeze_space(attribute(e, name)))
    time = first_that(elements, fits("time"))
    found = [_filled(F.when(attribute(time, "datetime") != "", stripped(time, "datetime")).otherwise(stripped(time, "content")))]
    for name, value in DATE_METAS:
        found.append(_filled(stripped(first_that(elements, _meta(name, value)), "content")))
    scripts = F.filter(elements, lambda e: (e["tag"] == "script") & (attribute(e, "type") == "application/ld+json"))
    source = lambda e: F.array_join(F.transform(F.slice(page["strings"], e["first"] + 1, e["n"]), lambda t: t["text"]), "")
    # a lone object is read as an array of one
    schema = f"array<struct<{', '.join(f'{k}: string' for k in keys)}>>" if keys else "array<struct<none: string>>"
    item = lambda x: F.coalesce(*[_filled(F.trim(x[k])) for k in keys]) if keys else F.lit(None).cast("string")
    told = F.flatten(F.transform(scripts, lambda e: F.coalesce(F.transform(F.from_json(source(e), schema), item), F.array().cast("array<string>"))))
    return F.coalesce(*found, F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def canonical(page: Column, base: Column) -> Column:
    """The canonical link, made absolute against ``base`` where it begins with a slash; null without one."""
    links = F.filter(page["elements"], lambda e: (e["tag"] == "link") & has_word(e, "rel", "canonical") & (attribute(e, "href") != ""))
    href = F.btrim(attribute(F.get(links, F.lit(0)), "href"), F.lit(" \t\r\n\f\u000b"))
    root = F.regexp_extract(F.coalesce(base, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?", 0)
    scheme, host = F.lower(F.regexp_extract(root, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(root, "//(.*)$", 1)
    absolute = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(
        F.startswith(href, F.lit("/")), F.concat(scheme, F.lit("://"), host, href)
    )
    return F.when(F.size(links) > 0, absolute.otherwise(href))


def hrefs(page: Column) -> Column:
    """The targets of links, in order, as they are written."""
    found = F.transform(F.filter(page["elements"], fits("a")), lambda e: F.btrim(attribute(e, "href"), F.lit(" \t\r\n\f\u000b")))
    return F.filter(found, lambda h: h != "")
