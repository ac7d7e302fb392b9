"""From raw pages to documents and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import page_rules as R
from textloom.functions.html import page as page_arrays
from textloom.functions.text import content_hash, short_url_id, word_count
from textloom.functions.urls import normalize_url, resolve_link


def article_records(pages: DataFrame, kind: str | Column = "news", also: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, url, doc_id, title, date, text, approx_words, canonical, links`` of each page.

    ``kind`` names the rule for all pages or is a column that names it for each; pages of no known kind are left out. Columns
    named in ``also`` are kept.
    """
    page, url = F.col("page"), F.col("url")
    blog = lambda k: "blog" in k
    known = pages if isinstance(kind, str) else pages.filter(kind.isin(*R.RULES))
    names = [] if isinstance(kind, str) else [kind.alias("page_kind")]
    of = (lambda f: f(kind)) if isinstance(kind, str) else lambda f: _by_kind(F.col("page_kind"), f)
    parsed = known.select("page_id", "url", *also, *names, page_arrays(F.col("html")).alias("page"))
    text = of(lambda k: R.main_text(page, R.RULES[k]))
    title = of(lambda k: R.title(page, blog(k)))
    date = of(lambda k: R.date(page, ("datePublished", "dateCreated") if blog(k) else ("datePublished",)))
    found = parsed.select("page_id", "url", *also, title.alias("title"), date.alias("date"), text.alias("text"), R.canonical(page, url).alias("canonical"), R.hrefs(page).alias("links"))
    return found.select(
        "page_id", "url", short_url_id(url).alias("doc_id"), "title", "date", "text",
        word_count(F.col("text")).alias("approx_words"), "canonical", "links", *also,
    )


def _by_kind(kind: Column, f: Callable[[str], Column]) -> Column:
    """``f`` of each row's kind of page."""
    out = None
    for k in R.RULES:
        out = F.when(kind == k, f(k)) if out is None else out.when(kind == k, f(k))
    return out


def fetched_documents(pages: DataFrame, sites: dict[str, tuple[str, int]], fetched_at: int) -> DataFrame:
    """Pages ``(page_id, source, url, html)`` of several sources in the shape of documents, in one pass.

    ``sites`` has the kind of page and the least number of words of each source; pages of other sources and
    shorter ones are left out.
    """
    by = lambda n, kind: F.create_map(*[F.lit(x) for k, v in sites.items() for x in (k, v[n])])[F.col("source")].cast(kind)
    rows = article_records(pages, by(0, "string"), ("source",)).filter(F.col("approx_words") >= by(1, "int"))
    return rows.select(
        "source", normalize_url(F.col("url")).alias("url_norm"), F.col("text").alias("parsed_text"),
        content_hash(F.col("text")).alias("content_hash"), F.col("approx_words").alias("word_count"),
        F.lit(fetched_at).cast("long").alias("fetched_at"),
    )


def page_links(pages: DataFrame, kind: str = "news", keep: Column | None = None) -> DataFrame:
    """``page_id, link``: the distinct absolute links of each page, those for which ``keep`` over ``link`` holds."""
    found = article_records(pages, kind).select("page_id", "url", F.explode("links").alias("href"))
    links = found.select("page_id", resolve_link(F.col("url"), F.col("href")).alias("link"))
    return (links if keep is None else links.filter(keep)).distinct()


# Which URLs are articles, by kind of site and crawler. Hosts are parameters.
BANNED_SEGMENTS = ("/rss/", "/video/", "/photo/", "/auth/", "/social/", "/forum/")


def _host_and_path(url: Column) -> tuple[Column, Column]:
    parts = (F.coalesce(F.try_parse_url(url, F.lit(x)), F.lit("")) for x in ("HOST", "PATH"))
    return next(parts), next(parts)


def news_article(url: Column, host: str) -> Column:
    """``/football/article-`` pages of hosts that contain ``host``, without a banned segment anywhere in the URL."""
    at, path = _host_and_path(url)
    banned = F.exists(F.array(*map(F.lit, BANNED_SEGMENTS)), lambda x: F.contains(url, x))
    return F.contains(at, F.lit(host)) & path.contains("/football/article-") & path.endswith(".html") & ~F.coalesce(banned, F.lit(True))


def news_article_strict(url: Column, host: str) -> Column:
    """The robot's rule: a numbered article of the host, with or without ``www.``, in any case, and no query."""
    name = host.replace(".", r"\.")
    return F.coalesce(url.rlike(rf"(?i)^https?://(www\.)?{name}/football/article-\d+.*\.html$"), F.lit(False))


def blog_article(url: Column, host: str) -> Column:
    """Numbered blog pages of the host."""
    at, path = _host_and_path(url)
    return (F.lower(at) == host) & path.rlike(r"^/football/blogs/\d+\.html$")


def blog_article_loose(url: Column, host: str) -> Column:
    """The robot's rule: the host's name and the blogs' path somewhere in the URL."""
    return F.coalesce(F.contains(url, F.lit(host)) & F.contains(url, F.lit("/football/blogs/")), F.lit(False))


def category_priority(title: Column) -> Column:
    """999: not to be followed, 2: low, 0: normal."""
    name = F.trim(F.coalesce(title, F.lit("")))
    # Patterns of category titles.
    year = r"(?iu)^Категория:\s*\d{3,4}\s*год\s+в\s+футболе$"
    banned = r"(?iu)^Категория:Википедия:|^Категория:Портал:|по годам|год в футболе|по алфавиту|незавершённые статьи"
    low = r"(?iuU)\bсписки\b|по городам|по странам|по частям света|владельцы футбольных клубов"
    return F.when((name == "") | name.rlike(year) | name.rlike(banned), 999).when(name.rlike(low), 2).otherwise(0)
