import pytest
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.operators import crawl, web
from textloom.plans.config import config_from
from textloom.sources import files

LONG = "words of a paragraph that is longer than forty characters"
PAGE = f"""<html><head><title>T &amp; t</title><meta property="og:title" content="OG"><link rel="canonical" href="/c">
<meta name="date" content="2024-01-02"><script type="application/ld+json">{{"datePublished": "x"}}</script></head><body>
<header><p>{LONG} in the header</p></header><article><h1>Head</h1><p><b>{LONG}<br><p>{LONG.upper()}<p>short
<ul><li>{LONG} one<li>{LONG} two</ul><script>var t="</p>";</script><aside><p>{LONG} aside</aside></article>
<a href="/a">x</a><a href=" //h/b ">y</a></body>"""


def read(spark, source, kind="news", url="https://h/x"):
    pages = spark.createDataFrame([(1, url, source)], "page_id long, url string, html string")
    return web.article_records(pages, kind).first()


def test_flat_pages():
    page = H.flat('<p a="1" a="2">x<b>y</p><script>z &lt;</script><br>')
    assert [(e["tag"], e["last"], e["first"], e["n"]) for e in page["elements"]] == [("p", 1, 0, 2), ("b", 1, 1, 1), ("script", 2, 2, 1), ("br", 3, 3, 0)]
    assert page["elements"][0]["attrs"] == [("a", "1")] and page["strings"][2] == {"text": "z <", "silent": True}


def test_news_rule(spark):
    lines = read(spark, PAGE)["text"].split("\n")
    assert lines == [LONG, f"{LONG} one", f"{LONG} two"]  # equal but for case: once


def test_other_rules(spark):
    wiki = f'<div class="mw-parser-output x"><table><tr><td><p>{LONG} t</p></table><h2>{LONG} h</h2><div id="toc"><li>{LONG} c</li></div><p>{LONG}<sup class="reference">no</sup></p></div><p>{LONG} out</p>'
    assert read(spark, wiki, "encyclopedia")["text"].split("\n") == [f"{LONG} h", LONG]
    assert read(spark, f"<p>{LONG}", "encyclopedia")["text"] == LONG
    blog = f"<main><p>Подписка на телеграм, {LONG}</p><p>{LONG}</p></main>"
    assert read(spark, blog, "blog")["text"] == LONG
    assert read(spark, PAGE, "early_news")["text"].split("\n")[:2] == [LONG, LONG.upper()]
    assert "one" in read(spark, PAGE, "early_blog")["text"]


def test_meta(spark):
    got = read(spark, PAGE)
    assert (got["title"], got["date"], got["canonical"]) == ("Head", "2024-01-02", "https://h/c")
    assert read(spark, "<title> a  b </title>", "blog")["title"] == "a b"
    assert read(spark, '<meta property="og:title" content="o"><title>t</title>', "blog")["title"] == "o"
    ld = '<script type="application/ld+json">{}</script>'
    assert read(spark, ld.format('[{"dateCreated": "d"}]'), "blog")["date"] == "d"
    assert read(spark, ld.format("{") + ld.format('{"dateCreated": "c", "datePublished": "p"}'))["date"] == "p"
    assert read(spark, '<time datetime="t">')["date"] == "t" and read(spark, "<p>")["date"] == ""
    assert read(spark, '<link rel="x canonical" href=" //o/p ">')["canonical"] == "https://o/p" and read(spark, "<p>")["canonical"] is None


def test_cut_references_in_titles(spark):
    assert read(spark, "<h1>a = &quot</h1>", "blog")["title"] == "a = &quot"
    assert read(spark, "<h1>&quot;a&copy; &ampb &amp;quot &copy; &copyc &middot; &notit; \ue000 &a</h1>")["title"] == '"a© &b &quot © &copyc · &notit; \ue000 &a'
    page = H.flat('<a href="/x?a=1&copy=2&amp;b"></a><script>&quot</script>')
    assert page["elements"][0]["attrs"] == [("href", "/x?a=1&copy=2&b")] and page["strings"] == [{"text": '"', "silent": True}]


CUT = f"<article><h1>A heading of thirty-odd characters and one = &quot</h1><p>{LONG} &quot;&quot</p></article>"


@pytest.mark.parametrize("kind", ["blog", "news"])
def test_cut_references_in_text(spark, kind):
    assert read(spark, CUT, kind)["text"].split("\n") == ["A heading of thirty-odd characters and one = &quot", f'{LONG} "&quot']


def test_cut_references_count_as_words(spark):
    pages = spark.createDataFrame([(1, "https://h/x", CUT, "s")], "page_id long, url string, html string, source string")
    got = web.fetched_documents(pages, {"s": ("blog", 1)}, 10).first()
    # ``quot`` twice; a whole reference is no word
    assert got["word_count"] == 8 + 1 + 9 + 1 and got["parsed_text"].endswith('"&quot')


@pytest.mark.parametrize("source", ["", "<", "</p></p>", "<p" * 2000, "<div>" * 3000, None])
def test_broken_pages(spark, source):
    pages = spark.createDataFrame([(1, "http://h/", source)], "page_id long, url string, html string")
    assert web.article_records(pages, "news").count() == 1


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://s/q", PAGE)], "page_id long, url string, html string")
    assert {r["link"] for r in web.page_links(pages).collect()} == {"https://s/a", "https://h/b"}


def test_article_urls(spark):
    urls = ["https://n.x/football/article-1.html", "https://n.x/football/article-1.html?u=/rss/", "https://b/football/blogs/12.html", "https://b/football/blogs/x.html", "https://[", "", None]
    u = F.col("u")
    rules = [web.news_article(u, "n.x"), web.news_article_strict(u, "n.x"), web.blog_article(u, "b"), web.blog_article_loose(u, "b")]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in urls], "u string").select(rules).collect()]
    none = (False,) * 4
    assert got == [(True, True, False, False), none, (False, False, True, True), (False, False, False, True), none, none, none]


def test_pages_of_several_sources(spark):
    rows = [(1, "w", "https://w/a", PAGE), (2, "n", "https://n/b?utm_x=1", PAGE), (3, "other", "https://o/", PAGE), (4, "n", "https://n/short", "<p>x"), (5, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, source string, url string, html string")
    got = {(r["source"], r["url_norm"]): r["parsed_text"] for r in web.fetched_documents(pages, {"w": ("early_news", 1), "n": ("news", 5)}, 7).collect()}
    assert set(got) == {("w", "https://w/a"), ("n", "https://n/b")}
    assert got["n", "https://n/b"].split("\n") == [LONG, f"{LONG} one", f"{LONG} two"] and got["w", "https://w/a"].split("\n")[:2] == [LONG, LONG.upper()]


def task(url, **more):
    row = {"source": "s", "url_norm": url, "state": "queued", "priority": 0, "retries": 0, "next_fetch_at": 0, "locked_until": 0, "locked_by": "", "created_at": 1, "started_at": None, "finished_at": None, "note": "", "last_error": "", "meta": {}}
    return row | more


def states(df):
    return {r["url_norm"]: r for r in df.collect()}


def test_claim_finish_release(spark):
    tasks = spark.createDataFrame([task("a"), task("b", priority=2), task("c", next_fetch_at=99), task("d", state="done"), task("e", state="fetching", locked_until=5)], crawl.TASKS)
    claimed = crawl.claim(tasks, 10, 60, "w", 1)
    got = states(claimed)
    assert {u for u, r in got.items() if r["locked_by"] == "w"} == {"b"} and got["b"]["locked_until"] == 70
    outcomes = spark.createDataFrame([("s", "b", "error", "boom")], "source string, url_norm string, outcome string, detail string")
    after = states(crawl.finish(claimed, outcomes, 20, max_retries=3))
    assert (after["b"]["state"], after["b"]["next_fetch_at"], after["b"]["retries"], after["b"]["last_error"]) == ("error", 50, 1, "boom")
    assert states(crawl.release_expired(tasks, 10))["e"]["state"] == "queued"


def test_aliases_queue_their_canonical_page(spark):
    tasks = spark.createDataFrame([task("a", state="fetching"), task("b", state="fetching"), task("https://h/c", state="done", created_at=3, next_fetch_at=9000)], crawl.TASKS)
    told = [("s", "a", "alias", "HTTPS://H/c/#x"), ("s", "b", "alias", "https://h/new")]
    got = states(crawl.finish_and_follow(tasks, spark.createDataFrame(told, "source string, url_norm string, outcome string, detail string"), 50))
    assert got["a"]["state"] == got["b"]["state"] == "done" and got["a"]["note"] == "alias->canonical HTTPS://H/c/#x"
    assert (got["https://h/new"]["state"], got["https://h/new"]["next_fetch_at"], got["https://h/new"]["meta"]) == ("queued", 50, {"alias": "b"})
    assert (got["https://h/c"]["state"], got["https://h/c"]["next_fetch_at"], got["https://h/c"]["created_at"]) == ("done", 50, 3)


def test_listing_stops(spark):
    pages = [("a", p, 404 if p in (2, 3, 5, 6, 7, 9) else 200) for p in range(1, 12)] + [("b", p, 404 if p % 2 else 200) for p in range(1, 9)]
    df = spark.createDataFrame(pages, "site string, page long, status int")
    got = crawl.listing_pages_read(df, 3, ("site",)).collect()
    assert sorted((r["site"], r["page"]) for r in got) == [("a", p) for p in range(1, 8)] + [("b", p) for p in range(1, 9)]
    assert sorted(r["page"] for r in crawl.listing_pages_read(df.filter("site = 'a'"), 2).collect()) == [1, 2, 3]


def test_counters(spark):
    rows = [("<p>é", "é", 5), ("<p>", None, 1), (None, "x", None)]
    got = crawl.crawl_counters(spark.createDataFrame(rows, "raw_html string, parsed_text string, word_count int"), 5).first()
    assert tuple(got) == (3, 1, 2, 8, 5, 5, 2)


def test_frontier_resumes(spark):
    edges = spark.createDataFrame([("a", "списки б"), ("a", "c"), ("c", "d"), ("списки б", "e"), ("d", "a"), ("d", "f")], "parent string, child string")
    seeds = spark.createDataFrame([("a",)], "node string")
    whole = [tuple(r) for r in crawl.discover_categories(edges, seeds, 2)[0].orderBy("place").collect()]
    assert whole == [("a", 0, 0, 1), ("c", 0, 1, 2), ("d", 0, 2, 3), ("списки б", 2, 1, 4), ("e", 0, 2, 5)]
    done, frontier = None, None
    for most in (1, 3, 9):
        done, frontier = crawl.discover_categories(edges, seeds, 2, most, done, frontier)
        assert done.count() == min(most, 5)
    assert [tuple(r) for r in done.orderBy("place").collect()] == whole and frontier.isEmpty()


def test_upsert_tasks(spark):
    tasks = spark.createDataFrame([task("a", next_fetch_at=5, state="done", priority=1)], crawl.TASKS)
    found = spark.createDataFrame([("s", "a", 9, 7, {"k": "1"}, 1), ("s", "n", 3, 1, {}, 1), ("s", "n", 4, 2, {"k": "2"}, 2)], "source string, url_norm string, next_fetch_at long, priority int, meta map<string,string>, seq int")
    got = states(crawl.upsert_tasks(tasks, found, 100))
    assert (got["a"]["state"], got["a"]["next_fetch_at"], got["a"]["priority"], got["a"]["meta"]) == ("done", 5, 7, {"k": "1"})
    assert (got["n"]["state"], got["n"]["next_fetch_at"], got["n"]["priority"], got["n"]["created_at"]) == ("queued", 3, 2, 100)


def test_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "parent string, child string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in crawl.breadth_first(edges, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_files(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": {"parsed_text": "one \\u0444 \\"q\\""}, "parsed_text": 5}\n{"parsed_text": "two"}\n', encoding="utf-8")
    assert {r["value"] for r in files.json_string_field(spark, str(path)).collect()} == {'one ф "q"', "two"}
    words = tmp_path / "t.txt"
    words.write_text("1\tab\nbad\n 2  c d\n")
    assert {tuple(r) for r in files.token_pairs(spark, str(words)).collect()} == {(1, "ab"), (2, "c")}
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    got = files.fetch(urls, lambda u: (200, "ok") if u == "u1" else 1 / 0)
    assert {(r["url"], r["status"]) for r in got.collect()} == {("u1", 200), ("u2", None)}


def test_fetch_retries_and_waits(spark, tmp_path):
    log = str(tmp_path / "log")

    def get(link):
        with open(log, "a") as f:
            f.write(link + "\n")
        with open(log) as f:
            if link == "u2" or f.read().count(link) < 3:
                raise OSError("down")
        return 200, "ok"

    def note(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds:.1f}\n")

    urls = spark.createDataFrame([("s", "u1"), ("s", "u2")], "site string, url string").coalesce(1)
    got = {r["url"]: (r["status"], r["body"]) for r in files.fetch(urls, get, tries=3, source="site", sleep=note).collect()}
    assert got == {"u1": (200, "ok"), "u2": (None, "down")}
    assert sorted(open(log).read().split()) == sorted(["u1"] * 3 + ["u2"] * 3 + ["0.5", "1.0"] * 2)
    assert [files.retry_sleep(n) for n in (0, 1, 5)] == [0.5, 1.0, 5.0]
    waited = files.fetch(urls, lambda u: (200, u), delay=60.0, source="site", sleep=note)
    assert waited.count() == 2 and float(open(log).read().split()[-1]) > 59


def test_states_and_records(spark, tmp_path):
    path, schema = f"{tmp_path}/state", "node string, depth int"
    assert [tuple(r) for r in files.read_or_default(spark, path, schema, [("a", 0)]).collect()] == [("a", 0)]
    for n in (1, 2):
        files.append_records(spark.createDataFrame([("b", n)], schema), path)
    assert sorted(tuple(r) for r in files.read_or_default(spark, path, schema).collect()) == [("b", 1), ("b", 2)]
    lines = tmp_path / "pairs.txt"
    lines.write_text("-1 a\n4294967296 b\n4294967295 c\n007 d\n")
    assert {tuple(r) for r in files.token_pairs(spark, str(lines)).collect()} == {(4294967295, "c"), (7, "d")}
    assert {tuple(r) for r in files.signed_token_pairs(spark, str(lines)).collect()} == {(-1, "a"), (7, "d")}
    asked = tmp_path / "q.txt"
    asked.write_text("a\n\nb && c\n")
    assert sorted(map(tuple, files.query_table(spark, str(asked)).collect())) == [(1, "a"), (2, ""), (3, "b && c")]


def test_config():
    got = config_from('{"logic": {"max_retries": "7", "delay_seconds": 1}, "sources": {"w": {"kind": "encyclopedia", "min_words": 450, "seed_categories": ["x"]}, "n": null, "off": {"enabled": false}}, "logs": {}}')
    assert (got.logic.max_retries, got.logic.delay_seconds, got.logic.recrawl_seconds) == (7, 1.0, 86_400)
    assert got.enabled() == ["w", "n"] and got.sources["w"].seed_categories == ("x",)
    assert got.sites() == {"w": ("encyclopedia", 450), "n": ("news", 900)} and config_from("").sources == {}
