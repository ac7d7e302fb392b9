import random
import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.urls import normalize_url, page_url, resolve_link, strip_fragment, title_from_url
from textloom.operators import tokenize


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


TOKENS = {
    "Лига-чемпионов 2024": ["Лига-чемпионов", "2024"], "a--b": ["a", "b"], "-a-": ["a"], "a-b-c": ["a-b-c"],
    "978-5-17-044765-7": ["978-5-17-044765-7"], "U-21's": ["U-21", "s"], "foo_bar": ["foo", "bar"],
    "А.С. Пушкин": ["А", "С", "Пушкин"], "Étion für": ["tion", "f", "r"], "éa": ["éa"], "": [], None: [],
}


def test_tokens(spark):
    assert column(spark, list(TOKENS), T.tokens) == list(TOKENS.values())


def plain_tokens(text):
    base = lambda c: c.isascii() and c.isalnum() or "Ѐ" <= c <= "ԯ"
    mark = lambda c: any(a <= c <= b for a, b in ("̀ͯ", "᪰᫿", "᷿᷀", "⃐⃿", "︠︯"))
    out, now = [], ""
    for i, c in enumerate(text):
        if base(c) or now and mark(c) and now[-1] != "-":
            now += c
        elif c == "-" and now and now[-1] != "-" and i + 1 < len(text) and base(text[i + 1]):
            now += c
        else:
            out, now = out + [now] * bool(now), ""
    return out + [now] * bool(now)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab9-- ЯёԠ́é._", max_size=12), min_size=60, max_size=60))
def test_tokens_like_a_scanner(spark, texts):
    assert column(spark, texts, T.tokens) == [plain_tokens(t) for t in texts]


def test_word_count(spark):
    got = column(spark, ["a-b-c", "Лига-чемпионов 2024", "978-5-17-044765-7", "a--b", None], T.word_count)
    assert got == [2, 2, 3, 2, 0]


STEMS = {
    "running": "runn", "played": "play", "quickly": "quick", "matches": "match", "goals": "goal", "goes": "go", "used": "us",
    "this": "thi", "bring": "br", "sing": "sing", "king": "king", "bus": "bus", "2024": "2024", "co-op": "coop", "а": "а",
    "игрок": "игрок", "игроки": "игрок", "игроков": "игрок", "футбола": "футбол", "футбольных": "футбольных", "МАТЧА": "МАТЧА",
    "матча": "матч", "мяча": "мяч", "лига": "лиг", "команда": "команд", "сборная": "сборн", "историями": "истор",
    "клубами": "клуб", "забивает": "забивает", "x": "",
}


def test_stems(spark):
    assert column(spark, list(STEMS), T.stem) == list(STEMS.values())


def test_case_is_ascii_only(spark):
    assert column(spark, ["ABC МАТЧ É"], T.ascii_lower) == ["abc МАТЧ É"]


def test_retry_delay(spark):
    assert column(spark, [0, 1, 2, 6, 7, -3], T.retry_delay, "int") == [30, 60, 120, 1920, 3600, 30]


def test_source_name(spark):
    assert column(spark, ["My Site!", "", None, "a_b"], T.source_name) == ["my_site", "source", "source", "a_b"]


URLS = {
    "HTTPS://A.Example.com//x//y/?b=2&utm_source=f&a=1#top": "https://a.example.com/x/y?a=1&b=2",
    "https://a.example.com": "https://a.example.com/", "https://a.example.com/x.html/": "https://a.example.com/x.html/",
    "https://a.example.com/x?q=": "https://a.example.com/x?q=", "https://a.example.com/x?GCLID=1": "https://a.example.com/x",
    "http://H/a/#f": "http://h/a", "http://h/п/": "http://h/п", None: None,
}


def test_normalize_url(spark):
    assert column(spark, list(URLS), normalize_url) == list(URLS.values())


def plain_normal(url):
    parts = urlsplit(url)
    pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not re.match("(?i)utm_", k) and k.lower() not in ("gclid", "yclid", "fbclid", "mc_cid", "mc_eid")]
    path = re.sub("/{2,}", "/", parts.path or "/")
    path = path[:-1] if path != "/" and path.endswith("/") and not path.endswith(".html/") else path
    return urlunsplit((parts.scheme.lower() or "https", parts.netloc.lower(), path, urlencode(sorted(pairs)), ""))


def test_normalize_url_like_a_library(spark):
    rnd = random.Random(1)
    pieces = ["a", "B", "=", "&", "%20", "%D0%A4", "%zz", "+", "~", "*", "/", "//", ".html/", "utm_x=1", "GCLID=2", "é", "-._", ":", "@", "x=1", "#f", "?", ";", "%"]
    urls = [rnd.choice(["http://H.Ex/", "https://a:80", "HTTPS://b/c", "x/y", "/z"]) + "".join(rnd.choice(pieces) for _ in range(rnd.randrange(14))) for _ in range(2500)]
    urls = [u for u in urls if not re.search("^[^/]*:[^/]", u)]
    got = column(spark, urls, normalize_url)
    assert [(u, g) for u, g in zip(urls, got)] == [(u, plain_normal(u)) for u in urls]


def test_ranked_form(spark):
    words = ["co-op", "A_b!c", "é~Ü", "", None, "".join(map(chr, range(1, 300)))]
    assert column(spark, words, T.norm_ranked) == [w and re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[^A-Za-z0-9_\x80-\U0010ffff]", "", w)) for w in words]


def test_dirty_bytes(spark):
    got = column(spark, [bytearray(b"a\xff-b"), bytearray("é".encode()), None], T.repaired_utf8, "binary")
    assert got == ["a\ufffd-b", "é", None]
    assert column(spark, [bytearray(b"ab\xc3cd")], lambda c: T.tokens(T.repaired_utf8(c)), "binary") == [["ab", "cd"]]


def test_space(spark):
    assert column(spark, [" a \t\u00a0 b\n", None, ""], T.squeeze_space) == ["a b", None, ""]
    assert column(spark, ["\x0b a b\u00a0 "], T.trim_ascii_space) == ["a b\u00a0"]
    assert column(spark, ["http://h/a#b#c", "x"], strip_fragment) == ["http://h/a", "x"]


def test_titles(spark):
    urls = ["https://h/wiki/%D0%A4_x", "https://h/a/b_c", "https://h/a/", "https://h/a/100%zz", "https://h/a/x+y"]
    assert column(spark, urls, title_from_url) == ["Ф x", "b c", "https://h/a/", "100%zz", "x y"]


def test_links_and_page_urls(spark):
    assert column(spark, ["/x", "//h/y", "z", "http://o/"], lambda c: resolve_link(F.lit("https://b/a/"), c)) == ["https://b/x", "https://h/y", "https://b/a/z", "http://o/"]
    titles = ["a b", "é/(x):,-~*+", "100%3A", "", None]
    want = [None if t is None else "https://e/wiki/" + quote(t.replace(" ", "_"), safe=":/()%_,-") for t in titles]
    assert column(spark, titles, lambda c: page_url(c, F.lit("https://e/wiki/"))) == want


def test_links_resolve_as_the_standard_says(spark):
    bases = ["https://b/a/c?x=1#f", "http://b", "https://b/a//d/", "https://b:8/a/../e.html"]
    parts = ["", "x", "./y", "../z", "../../../w", "/r/./s/../t", "//h/p/../q", "?k=v", "#g", "a/b//c/", "..", ".", "mailto:m@x", "http://o/u/../v", "HTTPS://O/k", "/", "x?y#z", "a:b"]
    pairs = [(b, h) for b in bases for h in parts] + [(None, "x"), ("https://b/", None)]
    table = spark.createDataFrame(pairs, "b string, h string")
    got = {(r["b"], r["h"]): r["u"] for r in table.select("b", "h", resolve_link(F.col("b"), F.col("h")).alias("u")).collect()}
    for b, h in pairs:
        assert got[b, h] == (None if b is None or h is None else urljoin(b, h)), (b, h)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a-b é c")]])
def test_figures(spark, rows):
    got = tokenize.token_figures(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got["docs"] == len(rows)
    assert got["tokens"] == (2 if rows and rows[0][1] else 0)
    if got["tokens"]:
        assert (got["avg_token_bytes"], got["avg_token_chars"]) == (2.0, 1.5)
