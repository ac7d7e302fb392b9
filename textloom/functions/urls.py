"""URLs: normal form, titles, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query keys that only track visits.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("gclid", "yclid", "fbclid", "mc_cid", "mc_eid")


def _escapes_made_whole(text: Column) -> Column:
    """``%`` that begins no escape as ``%25``, so that decoding leaves it as it is."""
    return F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")


def _form_encoded(text: Column) -> Column:
    """As forms encode text; ``~`` stays and ``*`` does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _sorted_query(query: Column) -> Column:
    """A query's pairs in order, without those that only track visits, decoded and encoded anew."""
    decoded = lambda x: F.url_decode(_escapes_made_whole(x))

    def pair(x: Column) -> Column:
        key = F.substring_index(x, "=", 1)
        value = F.when(F.contains(x, F.lit("=")), F.substr(x, F.length(key) + 2)).otherwise("")
        return F.struct(decoded(key).alias("k"), decoded(value).alias("v"))

    def wanted(x: Column) -> Column:
        key = F.lower(x["k"])
        return ~(F.startswith(key, F.lit(TRACKING_PREFIX)) | key.isin(*TRACKING_KEYS))

    pairs = F.filter(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair), wanted)
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(_form_encoded(x["k"]), F.lit("="), _form_encoded(x["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """One form for URLs of one page: lower scheme (``https`` if there is none) and host, no fragment, no tracking
    keys, sorted query, single slashes and none at the end."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda n: F.regexp_extract(clean, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", n)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    path = F.regexp_replace(F.when(part(3) == "", "/").otherwise(part(3)), "/{2,}", "/")
    path = F.when((path != "/") & ~path.endswith(".html/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    there = F.when((host != "") & ~path.startswith("/"), F.concat(F.lit("//"), host, F.lit("/"), path)).when(
        (host != "") | path.startswith("/"), F.concat(F.lit("//"), host, path)
    )
    query = _sorted_query(part(4))
    head = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), there.otherwise(path))
    return F.when(query == "", head).otherwise(F.concat(head, F.lit("?"), query))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def percent_decode(text: Column) -> Column:
    """``%XX`` to bytes and ``+`` to a space; what is no escape stays as it is."""
    return F.url_decode(_escapes_made_whole(text))


def title_from_url(url: Column) -> Column:
    """What follows ``/wiki/``, or else the last ``/`` unless that ends the URL, decoded, ``_`` as a space."""
    wiki = F.regexp_extract(url, r"/wiki/(.*)$", 1)
    tail = F.regexp_extract(url, r"([^/]*)$", 1)
    part = F.when(url.contains("/wiki/"), wiki).when(tail != "", tail).otherwise(url)
    part = F.translate(part, "_", " ")
    return percent_decode(part)


def _joined_path(base: Column, path: Column) -> Column:
    """A path, seen from the folder of the path ``base`` unless it begins with a slash, without dots and empty parts within."""
    folder = F.filter(F.split(base, "/"), lambda x, i: (i < F.size(F.split(base, "/")) - 1) | (x == ""))
    parts = F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(F.concat(folder, F.split(path, "/")))
    inner = lambda p: F.filter(p, lambda x, i: (x != "") | (i == 0) | (i == F.size(p) - 1))
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    step = lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    def walked(p: Column) -> Column:
        kept = F.aggregate(p, F.array().cast("array<string>"), step)
        kept = F.when(F.element_at(p, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.coalesce(F.nullif(F.array_join(kept, "/"), F.lit("")), F.lit("/"))

    # bound once, as it is used several times
    return F.get(F.transform(F.transform(F.array(parts), inner), walked), F.lit(0))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``; null where either is null."""
    link = F.btrim(href, F.lit(" \t\r\n\f\u000b"))
    whole = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//[^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    of = lambda text, n: F.regexp_extract(text, whole, n)
    scheme = F.lower(of(base, 1))
    elsewhere = (of(link, 1) != "") & (F.lower(of(link, 1)) != scheme)
    filled = lambda c: F.when(F.length(c) > 1, c).otherwise("")  # noqa: E731  a sign without what it announces goes
    query, fragment = filled(of(link, 4)), filled(of(link, 5))
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), of(base, 2))
    path = _joined_path(of(base, 3), of(link, 3))
    path = F.when((of(base, 2) != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    same_page = F.concat(head, of(base, 3), F.when(query != "", query).otherwise(filled(of(base, 4))), fragment)
    return (
        F.when(link.isNull() | base.isNull(), F.lit(None).cast("string")).when(link == "", base).when(base == "", link).when(elsewhere, link)
        .when(of(link, 2) != "", F.concat(scheme, F.when(scheme != "", ":").otherwise(""), of(link, 2), of(link, 3), query, fragment))
        .when(of(link, 3) == "", same_page)
        .otherwise(F.concat(head, path, query, fragment))
    )


#: Signs that an encyclopedia's URLs keep, in the order in which their escapes are undone; ``%`` is last, so that none is undone twice.
KEPT_SIGNS = ":/(),%"


def page_url(title: Column, root: Column) -> Column:
    """An encyclopedia page's URL from its title; null where either is null."""
    path = _form_encoded(F.translate(title, " ", "_"))
    for sign in KEPT_SIGNS:
        path = F.replace(path, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return F.concat(root, path)


def listing_urls(listings: DataFrame) -> DataFrame:
    """``listings (pattern, first_page, first, last, ...)`` with a row for each ``page``, and its ``url``.

    ``pattern`` holds ``{}`` for the number; page 1 is ``first_page`` where that is not null.
    """
    paged = listings.withColumn("page", F.explode(F.sequence("first", "last")))
    usual = F.replace("pattern", F.lit("{}"), F.col("page").cast("string"))
    url = F.when((F.col("page") == 1) & F.col("first_page").isNotNull(), F.col("first_page")).otherwise(usual)
    return paged.withColumn("url", url).drop("pattern", "first_page", "first", "last")
