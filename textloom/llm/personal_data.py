"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Fixed patterns give the seeds: e-mail addresses, IP addresses, card numbers and phone numbers. The two
words before a seed, on its line, are a lexical pattern of its kind. Patterns and instances form a graph whose edges
are scored in rounds: a pattern is as good as the mean of its instances, and an instance is as good as
its patterns together say. Patterns that several seeds support and whose instances are good on the
whole then point at identifiers that no fixed pattern knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import settle

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts if so many different seeds, or instances found so far, stand behind it ...
SUPPORT = 3
#: ... and if its confidence is this high; the same holds for instances.
CONFIDENT = 0.6
#: A longer word of a pattern is known by its hash, so that patterns stay short.
WORD_CHARS = 32
#: Matches of a text that are gathered into one list before lists are joined.
GATHERED = 64
# The base patterns. Possessive repeats keep Java's matcher from recursing on long runs, and
# "no such character before, or where the last match ended" keeps it from trying each place of a run anew;
# neither changes a match. A card's run of digits is matched whole, so shorter ones can be left out.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words with a digit or an at sign, which may be identifiers.
CANDIDATE = r"(?<![^\s])[^\s0-9@]*+[0-9@]\S*+"
SPAN = "struct<s:int,e:int,m:string,c:string>"


def _last_words(text: str) -> str:
    """SQL for the end of the last line of ``text``: two words or more, long ones as hashes of the whole word."""
    line = rf"substring_index(translate({text}, '\r\u000b\u000c', '\n\n\n'), '\n', -1)"
    words = rf"split(substring_index(regexp_replace({line}, '[ \t]+', ' '), ' ', -3), ' ')"
    return f"array_join(transform({words}, w -> if(char_length(w) > {WORD_CHARS}, md5(w), w)), ' ')"


def _spans(text: str, pattern: str, needed: str) -> str:
    """SQL for the matches' places in code points, with the words before each, earlier matches included.

    Matches are gathered in lists of ``GATHERED``, and these in one list, as adding to a list copies it. A name is
    bound to a value by ``transform`` over a list of one.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    one = f"""transform(array({_last_words("concat(u.past, x.`0`)")}), p -> struct(
        u.at + char_length(x.`0`) + coalesce(char_length(x.`1`), 0) as at,
        if(x.`1` is null, u.out, concat(u.out, array(struct(
            u.at + char_length(x.`0`) as s, u.at + char_length(x.`0`) + char_length(x.`1`) as e, x.`1` as m, p as c)))) as out,
        concat(p, coalesce(x.`1`, '')) as past))[0]"""
    some = f"aggregate(part, struct(a.at as at, cast(array() as array<{SPAN}>) as out, a.past as past), (u, x) -> {one})"
    run = f"""transform(array(arrays_zip(split({text}, {quoted}, -1), regexp_extract_all({text}, {quoted}, 0))), z -> aggregate(
        transform(sequence(0, (size(z) - 1) div {GATHERED}), b -> slice(z, b * {GATHERED} + 1, {GATHERED})),
        struct(0 as at, cast(array() as array<array<{SPAN}>>) as out, '' as past),
        (a, part) -> transform(array({some}), v -> struct(v.at as at, concat(a.out, array(v.out)) as out, v.past as past))[0],
        a -> flatten(a.out)))[0]"""
    there = f"contains({text}, '{needed}')" if needed else f"{text} rlike {quoted}"
    return f"if({there}, {run}, cast(array() as array<{SPAN}>))"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(F.lpad(p, 3, "0"), F.lit("999")) <= 255))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        n = F.length(digits)
        places = F.sequence(F.lit(1), n)
        digit = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
        twice = lambda i: digit(i) * F.when((n - i) % 2 == 1, 2).otherwise(1)
        value = lambda i: F.when(twice(i) > 9, twice(i) - 9).otherwise(twice(i))
        total = F.aggregate(places, F.lit(0), lambda a, i: a + value(i))
        return n.between(14, 19) & (total % 10 == 0)
    return F.lit(True)


def _context(before: Column) -> Column:
    """The two words before, or the one that begins the line, without case and with digits as 0; null where there are none."""
    words = F.substring_index(F.trim(before), " ", -2)
    return F.nullif(F.regexp_replace(F.lower(words), "[0-9]", "0"), F.lit(""))


def _holds(kind: str):
    return lambda x: _valid(kind, x["m"])


def _is(n: int):
    return lambda x: x["k"] == n


def _numbered(n: int):
    """A span of the n-th kind, its fields in the order by which spans are sorted."""
    return lambda x: F.struct(
        x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), x["m"].alias("m"), _context(x["c"]).alias("c")
    )


def _meets(spans: Column, x: Column) -> Column:
    """Whether ``x`` meets one of ``spans``, which are in order and apart: the last that begins before ``x`` ends, by halving."""
    n = F.size(spans)
    halves = F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1))

    def further(k: Column, i: Column) -> Column:
        more = k + F.call_function("shiftleft", F.lit(1), i)
        return F.when((more <= n) & (F.get(spans, more - 1)["s"] < x["e"]), more).otherwise(k)

    before = F.aggregate(halves, F.lit(0), further)
    return (n > 0) & F.coalesce(F.get(spans, before - 1)["e"] > x["s"], F.lit(False))


def _mentions(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, maybe``: per row of ``docs`` its base spans and the candidates outside of these.

    Texts are read once; what the patterns find is written before it is worked on, as an expression that
    is used inside another one's function would be computed for each element.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select("doc_id", text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        *[F.expr(_spans("text", PATTERNS[kind], NEEDED[kind])).alias(kind) for kind in KINDS],
        F.expr(_spans("text", CANDIDATE, "")).alias("maybe"),
    )
    raw = settle(raw, "matches")
    held = F.array(*[F.transform(F.filter(k, _holds(k)), _numbered(n)) for n, k in enumerate(KINDS)])
    out = settle(raw.select("row", "doc_id", held.alias("by_kind"), "maybe"), "base-spans")

    def trimmed(x: Column) -> Column:
        left = F.regexp_replace(x["m"], r"^[^\p{L}\p{N}@+]++", "")
        core = F.regexp_replace(left, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        start = x["s"] + F.length(x["m"]) - F.length(left)
        return F.struct(start.alias("s"), (start + F.length(core)).alias("e"), core.alias("m"), _context(x["c"]).alias("c"))

    def may_be(x: Column) -> Column:
        digits = F.length(F.regexp_replace(x["m"], "[^0-9]", ""))
        free = ~F.exists("by_kind", lambda spans: _meets(spans, x))
        return x["c"].isNotNull() & (F.length(x["m"]) >= 6) & ((digits >= 4) | F.contains(x["m"], F.lit("@"))) & free

    maybe = F.filter(F.transform("maybe", trimmed), may_be)
    return out.select("row", "doc_id", F.array_sort(F.flatten("by_kind")).alias("base"), maybe.alias("maybe"))


def confident_patterns(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``c, k, confidence``: the patterns (words before, kind) that seeds and their likes support."""
    seeds = mentions.select(F.explode("base").alias("b")).filter("b.c is not null")
    seeds = seeds.select("b.c", "b.m", "b.k").distinct().withColumn("seed", F.lit(1.0))
    others = mentions.select(F.explode("maybe").alias("b")).select("b.c", "b.m").distinct()
    seeds, others = settle(seeds, "seed-edges"), settle(others, "candidate-edges")
    good = seeds.select("m", "k", F.col("seed").alias("score")).distinct()
    patterns = None
    for n in range(rounds):
        edges = seeds.select("c", "m").unionByName(others).distinct()
        size = edges.groupBy("c").agg(F.count("*").alias("n"))
        told = edges.join(good, "m").groupBy("c", "k").agg(F.sum("score").alias("sum"), F.count("*").alias("support"))
        patterns = settle(
            told.filter(F.col("support") >= SUPPORT)
            .join(size, "c")
            .select("c", "k", (F.col("sum") / F.col("n")).alias("confidence"))
            .filter(F.col("confidence") >= CONFIDENT),
            "patterns",
        )
        if n == rounds - 1 or patterns.isEmpty():
            break
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-3))))
        found = others.join(patterns, "c").groupBy("m", "k").agg((1 - F.exp(doubt)).alias("score"))
        good = seeds.select("m", "k", F.col("seed").alias("score")).distinct().unionByName(found)
        good = settle(good.groupBy("m", "k").agg(F.max("score").alias("score")), "instances")
    return patterns


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the fixed patterns' spans; ``spans`` also has the identifiers that
    confident patterns point at, under the pattern's kind. Work on a text grows with its length, however many
    matches it has. A null text counts as empty and has no spans;
    repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    found = settle(_mentions(docs), "mentions")
    patterns = confident_patterns(found)
    told = (
        found.select("row", F.explode("maybe").alias("x"))
        .select("row", "x.*")
        .join(patterns, "c")
        .groupBy("row", "s", "e")
        .agg(F.max(F.struct("confidence", (-F.col("k")).alias("k"))).alias("best"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("s", (-F.col("best.k")).alias("k"), "e")).alias("more"))
    )
    rows = found.join(settle(told, "told-spans"), "row", "left")
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    counts = [F.size(F.filter("base", _is(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))
