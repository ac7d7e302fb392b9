"""The operators against plain versions, and on null, empty, long, repeated and missing rows."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, links, mixing, near_dedup, personal_data, secret_scan, suffix_dedup, topk, toxicity, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def table(spark, rows):
    """rows of (doc_id, text[, source])"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (4, LONG), (4, "other"), (5, "\n \t"), (6, "é😀 ÿ"), (2, "")]


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- exact ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "bits"), [(4096, 40), (3, 40), (3, 2)])
def test_exact_dedup(spark, block, bits):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(12)))) for i in range(150)] + [(i, t if t is None or len(t) < 99 else "L" * 500) for i, t in ODD]
    got = exact_dedup.exact_dedup(table(spark, rows), block, bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        taken = False
        for i in ids:
            want.append((i, keep, len(ids), i == keep and not taken, hashlib.sha256(t.encode()).hexdigest()))
            taken |= i == keep
    assert sorted(map(str, map(tuple, got))) == sorted(str(x) for x in want)


def test_drop_copies_keeps_columns(spark):
    docs = table(spark, ODD).withColumn("bucket", F.lit("b")).withColumn("kept", F.lit("k")).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert by_row(out, "doc_id", "text") == sorted([(2, ""), (3, "x"), (4, LONG), (4, "other"), (5, "\n \t"), (6, "é😀 ÿ")], key=str)
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


# ---- near -----------------------------------------------------------------------------------------


def test_near_classes(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefghijkl") * 3 for _ in range(60))) for i in range(30)]
    for i in range(30, 90):
        w = rows[rnd.randrange(30)][1].split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(i + 100 if i else None, t) for i, t in ODD]
    got = near_dedup.near_classes(table(spark, rows)).collect()
    sets, root = [brute.shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    want = sorted(str((d, min((x for x in ids if x is not None), default=None))) for ids in groups.values() for d in ids)
    assert sorted(str((r["doc_id"], r["class_id"])) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    # of the repeated rows without words, each its own class, one stays
    assert near_dedup.drop_near_copies(table(spark, rows)).count() == len(groups) - 1
    assert near_dedup.near_classes(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [500, 7])
def test_large_buckets_compare_all(spark, monkeypatch, block):
    """Near copies inside a family that shares a template: in large buckets too, each pair of candidates is settled."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(12)
    template, rows = [f"t{i}" for i in range(120)], []
    for i in range(40):
        own = [f"o{i}x{k}" for k in range(40)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:-2] + [f"z{i}", "z"]))]
    rnd.shuffle(rows)
    sets = {i: brute.shingle_set(t) for i, t in rows}
    assert all((len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) == (i // 2 == j // 2) for i in sets for j in sets)
    docs = table(spark, rows)
    bands = {r["doc_id"]: set(r["bands"]) for r in near_dedup.signatures(docs, bands=2, band_rows=1).collect()}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs, bands=2, band_rows=1).collect()}
    assert sum(bool(bands[i] & bands[i + 1]) for i in range(0, 80, 2)) > 30
    assert got == {i: i - i % 2 if bands[i] & bands[i ^ 1] else i for i in sets}


@pytest.mark.parametrize("block", [512, 16])
def test_chains_and_clusters(spark, monkeypatch, block):
    """Chains in which only neighbours are near, clusters of mutual copies, and outliers near a single text of a large class."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SALTED", block)
    rnd = random.Random(21)
    texts = []
    for c in range(3):  # each drops five words of the one before and takes five more
        chain = [f"c{c}w{k}" for k in range(100 + 5 * 40)]
        texts += [" ".join(chain[5 * i : 5 * i + 100]) for i in range(40)]
    for c in range(2):
        base = [f"k{c}w{k}" for k in range(200)]
        for i in range(60):
            own = list(base)
            own[rnd.randrange(200)] = f"k{c}x{i}"
            texts.append(" ".join(own))
        edge = base[:160] + [f"k{c}e{k}" for k in range(18)]
        texts += [" ".join(edge), " ".join(edge[20:] + [f"k{c}f{k}" for k in range(20)])]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table(spark, rows)).collect()}
    assert got == brute.links_of_all_pairs(rows) and len(set(got.values())) < 12


def test_recall_on_the_real_table(spark):
    """Of the pairs of rows whose id is divisible by 100 with all rows, those at 0.8 or more are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    asked = {i: brute.shingle_set(t) for i, t in rows if i % 100 == 0}
    have = {}
    for i, shingles in asked.items():
        for x in shingles:
            have.setdefault(x, []).append(i)
    label = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    near = found = 0
    for j, t in rows:
        own = brute.shingle_set(t)
        both = Counter(i for x in own for i in have.get(x, ()) if i != j)
        for i, n in both.items():
            if n >= 0.8 * (len(own) + len(asked[i]) - n):
                near, found = near + 1, found + (label[i] == label[j])
    assert near > 20 and found >= 0.99 * near, (found, near)


def test_similar_in_group():
    rnd = np.random.default_rng(22)
    sets = [np.sort(rnd.choice(40, rnd.integers(1, 40), replace=False)) for _ in range(60)]
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    label = rnd.integers(0, 30, 60)
    for late in (np.zeros(60, int), np.sort(rnd.integers(0, 2, 60))):
        want = {
            (i, j) for i in range(60) for j in range(60)
            if (late[i] < late[j] if late.any() else i < j) and label[i] != label[j]
            and len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))
        }
        assert {tuple(x) for x in near_dedup._similar_in_group(sizes, flat, label, late, 0.5).tolist()} == want and want


def test_repeated_passages_are_near(spark):
    """However often a text repeats a passage, the similarity is that of the sets."""
    rows = []
    for i in range(8):
        own, passage = [f"o{i}x{k}" for k in range(104)], [f"p{i}x{k}" for k in range(40)]
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(own + passage * 100))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(16)}


def test_repeats_can_weigh(spark):
    """With ``repeats`` the similarity is that of the shingles counted as often as they occur."""
    rnd, rows = random.Random(23), []
    for i in range(6):
        own, passage = [f"o{i}x{k}" for k in range(60)], [f"p{i}x{k}" for k in range(10)]
        rows += [(i * 10 + n, " ".join(own + passage * n)) for n in (1, 2, 3, 8, 9)]
    rnd.shuffle(rows)
    bags = {i: Counter(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    want = {i: min(j for j in bags if j // 10 == i // 10 and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()) for i in bags}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table(spark, rows), repeats=True).collect()}
    assert {i % 10: want[i] % 10 for i in range(1, 10) if i in want} == {1: 1, 2: 1, 3: 2, 8: 8, 9: 8}
    assert got == {i: i // 10 * 10 + (1 if i % 10 < 4 else 8) for i in bags}


def test_prob_min_hash_estimates():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(1, 1 << 62, 400, dtype=np.uint64), rnd.integers(1, 1 << 62, 100, dtype=np.uint64)
    elements, rows = np.concatenate([a, b, a]), np.repeat([0, 1], [500, 400])
    signs = near_dedup.prob_min_hash(elements, rows, np.ones(900), 3, 2000)
    assert abs((signs[0] == signs[1]).mean() - 0.8) < 0.04
    assert (signs[2] == 0).all() and (signs[:2] != 0).all()
    heavy = near_dedup.prob_min_hash(np.array([1, 2], np.uint64), np.array([0, 0]), np.array([9.0, 1.0]), 1, 2000)
    assert abs((heavy == 1).mean() - 0.9) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["label"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# ---- mixing ---------------------------------------------------------------------------------------


def test_mixing(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randrange(1, 30), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(1000, None, "a"), (1001, "", "empty")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["target"] for r in {(r["source_size"], r["target"]): r for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - target) <= 30 and target <= 2 * size for (size, target), v in by.items())
    assert by_row(mixing.mix(docs.repartition(7)), *docs.select("doc_id").columns, "taken") == sorted([(r["doc_id"], r["taken"]) for r in got], key=str)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(table(spark, [])).count() == 0


def test_mix_equals_plain_version(spark):
    rnd = random.Random(15)
    for sources in (["a", "a", "a", "b", "c", None], ["a", "b"], ["a"]):
        rows = [(i, "w " * rnd.randrange(30), rnd.choice(sources)) for i in range(300)]
        times, got = brute.mixed(rows), mixing.mix(table(spark, rows)).collect()
        assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["size"] * times[r["doc_id"]] for r in got}


def test_mixed_documents_repeat_no_empty_text_more_than_twice(spark):
    rows = [(i, "" if i < 40 else "w " * 9, "a") for i in range(60)] + [(100 + i, "w " * 400, "b") for i in range(9)]
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(table(spark, rows)).collect())
    assert max(out.values()) == 2 and out == {i: n for i, n in brute.mixed(rows).items() if n}
    assert mixing.mixed_documents(table(spark, [])).count() == 0


def test_mixed_documents_keep_clashing_columns(spark):
    docs = table(spark, [(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(60)])
    for name in ("mix_cut", "MIX_Whole", "mix_source", "mix_copy", "cut", "whole", "target", "source_size"):
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(brute.mixed([(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(60)]).values())


def test_mix_budgets_are_nested(spark):
    docs = table(spark, [(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(300)])
    few, many = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, share=s).collect()} for s in (0.4, 0.7))
    assert all(many[i] >= few[i] for i in few)


# ---- bpe ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lines():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(lines):
    ranks = bpe._vocabulary(lines).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder(lines, reference):
    coder, rnd = bpe.Encoder(lines, public_tokenizers.PATTERN), random.Random(5)
    texts = ["".join(rnd.choice("ab éÿ\x1c\x85\xa0.,1'\n") for _ in range(50)) for _ in range(200)]  # Latin-1 alone
    texts += [rnd.choice(["", " "]) + "".join(rnd.choice("abcdeé") for _ in range(n)) for n in range(bpe.LONG_PIECE - 4, bpe.LONG_PIECE + 5) for _ in range(4)]
    texts += ["", "Hello world's  end\n\n x", "a" * 5000, "😀é  \x1c x\x85", "<|endoftext|>"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0x500), 32, 10, 0x1F600])) for _ in range(60)) for _ in range(300)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_append_and_edit(lines):
    vocabulary, rnd = bpe._vocabulary(lines), random.Random(6)
    for _ in range(40):
        data = bytes(rnd.choice(b"abcdefg etnoris") for _ in range(200))
        kept = bpe.PrefixEncoding(vocabulary, data[:100])
        kept.append(data[100:])
        a = rnd.randrange(150)
        redone = kept.replace(a, a + rnd.randrange(5), b"xy" * rnd.randrange(4))
        assert kept.ids == vocabulary.ids_of_prefixes(kept.data) and redone < 150


def test_digests(spark, reference):
    got = bpe.encoding_digests(table(spark, ODD), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for (i, text), r in zip(ODD, sorted(got, key=lambda r: 0), strict=True):
        ids = reference.encode_ordinary(text or "")
        want = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert want in {tuple(x) for x in got}
    ids = bpe.encode(table(spark, ODD), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    again = bpe.encode(ids, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert again.columns[-1] == "token_ids_" and again.filter("token_ids <> token_ids_").count() == 0
    assert ids.columns[-1] == "token_ids" and ids.filter("text is null").first()["token_ids"] == []


# ---- secrets and personal data --------------------------------------------------------------------

PARTS = ["+", "1", "23", ".", " ", "-", "@", "a", "b.c", "com", "5555", "(", ")", "12.3.4.5", "4111 1111 1111 1111", "4111111111111111", "\n", "é", "😀", "0", "255", "token", "=", '"', "PassWord: ", "AKIA", "ABCDEFGH12345678", "deadbeef", "apikey", "ſ", "K", "'", "secret=", "+1 (017) 555-7713", "x@y.z"]


def texts_of_parts():
    rnd = random.Random(7)
    rows = [(100 + i, "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40)))) for i in range(600)]
    hard = ["a" * 9000, "1" * 9000, "1." * 4000, "a@b" + ".c" * 4000, "+1" + " 1" * 4000, "a." * 4000 + "@", "'" * 5000, "a=" * 4000]
    return ODD + rows + [(2000 + i, t) for i, t in enumerate(hard)]


def test_secrets(spark):
    rows = texts_of_parts()
    want = sorted(str((i, *(sum(s[1] == k for s in spans) for k in range(3)), digest)) for i, t in rows for spans, digest in [brute.secrets(t)])
    got = secret_scan.secret_counts(table(spark, rows))
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == want
    assert secret_scan.find_secrets(table(spark, rows)).filter("kind = 'hex'").count() == got.agg(F.sum("n_hex")).first()[0]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('key1 = "Zx8$kQ2!pL0v"\npassword = key1', ["Zx8$kQ2!pL0v"]),
        ('db_pwd: str = "qW3r" + "tY7u9!"', ["qW3r", "tY7u9!"]),
        ("<secretKey>aB3dE5gH7jK9</secretKey>", ["aB3dE5gH7jK9"]),
        ('{"credential": "aB3$E5gH7jK9"}', ["aB3$E5gH7jK9"]),
        ('pwd = "changeme"; token_url = "https://a.b/cD3"; pwd = "$' + '{X1aB2cD3}"', []),
        ('title = "Zx8$kQ2!pL0v"', []),
    ],
)
def test_assignments(text, found):
    assert [text[a:b] for a, b, _, _ in secret_scan.found_literals(text)] == found


def test_precision_and_recall_of_literals():
    """Keys assigned in several syntaxes, directly or by way of constants, among harmless assignments."""
    rnd = random.Random(20)
    key = lambda: "".join(rnd.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=20)) + "9$"
    word = lambda: rnd.choice(["ready", "main_page", "https://a.b/c", "12345678", "changeme", "the quick fox", "%d items", "index.html"])
    sensitive, plain = ["db_pwd", "privateKey", "client.credential", "signing-key", "SECRET_KEY_BASE"], ["title", "color", "token_count", "password_hint", "retries", "key_file"]
    hit = missed = extra = 0
    for _ in range(400):
        name, lines, planted = rnd.choice(sensitive), [f'{rnd.choice(plain)} = "{rnd.choice([word, key])()}"', f'{rnd.choice(sensitive)} = "{word()}"'], key()
        if rnd.random() < 0.5:
            lines += rnd.choice([[f'{name} = "{planted}"'], [f"{name}: '{planted}'"], [f'"{name}": "{planted}",'], [f"<{name}>{planted}</{name}>"], [f'v = "{planted}"', f"{name} = v"], [f'{name}: str = "{planted[:9]}" + "{planted[9:]}"']])
        else:
            planted = None
        rnd.shuffle(lines) if planted is None else None
        text = "\n".join(lines)
        got = "".join(text[a:b] for a, b, _, _ in secret_scan.found_literals(text))
        hit, missed, extra = hit + bool(planted and planted in got), missed + bool(planted and planted not in got), extra + (got not in ("", planted))
    assert hit > 150 and hit / (hit + missed) >= 0.95 and hit / (hit + extra) >= 0.95, (hit, missed, extra)


def test_long_values_and_names():
    rnd = random.Random(13)
    key = "".join(rnd.choice("abcdefgABCDEFG0123456789+/") for _ in range(1600))
    text = f"<privateKey>{key}</privateKey>"
    assert [text[a:b] for a, b, _, _ in secret_scan.found_literals(text)] == [key]
    text = f'{{"{"my " * 40}password": "{key[:30]}"}}'
    assert [text[a:b] for a, b, _, _ in secret_scan.found_literals(text)] == [key[:30]]
    lines = [key[i : i + 16] for i in range(0, 1600, 16)]
    text = "k = " + " + \\\n  ".join(f'"{x}"' for x in lines) + "\npassword = k\n"
    assert [text[a:b] for a, b, _, _ in secret_scan.found_literals(text)] == lines
    text = 'a0 = "Zx8$kQ2!pL0v"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(300)) + "password = a300"
    assert [text[a:b] for a, b, _, _ in secret_scan.found_literals(text)] == ["Zx8$kQ2!pL0v"]


def test_personal_data(spark):
    rows = texts_of_parts()
    want = sorted(str((i, *(sum(s[1] == k for s in spans) for k in range(4)), digest)) for i, t in rows for spans, digest in [brute.private(t)])
    got = personal_data.personal_data(table(spark, rows))
    assert sorted(str(tuple(r)[:6]) for r in got.collect()) == want
    assert personal_data.personal_data(table(spark, [])).count() == 0


def test_contexts_find_more(spark):
    rows = [(i, f"please call office +1 (017) 555-77{i:02d} or write") for i in range(20)] + [(50, "please call office 0171-555 now"), (51, "some other words 0171-555 now")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(table(spark, rows)).collect()}
    assert got[50] == "phone:19:27" and got[51] == ""
    assert got[3] == "phone:19:36"


def test_contexts_reach_over_matches(spark):
    """The words before are those of the text, also where one of them is itself a match."""
    rows = [(i, f"ref A-1 fax +1 (017) 555-77{i:02d} or write") for i in range(20)] + [(50, "ref A-1 fax 0171-555 now")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(table(spark, rows)).collect()}
    assert got[50] == "phone:12:20" and got[3] == "phone:12:29"


def test_contexts_of_long_words_and_lines(spark):
    """No word before a mention is too long to be a pattern's, and patterns do not reach over lines."""
    long = "w" * 500
    rows = [(i, f"{long} tel: +1 (017) 555-77{i:02d} or") for i in range(20)]
    rows += [(50, f"so {long}\ttel:  0171-555 now"), (51, f"{long}\ntel: 0171-555"), (52, f"{long} tel:\r\n0171-555")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(table(spark, rows)).collect()}
    assert got[50] == "phone:510:518" and got[51] == got[52] == ""


def test_many_matches_in_one_text(spark):
    """A text of a megabyte with some 60,000 matches takes time in proportion."""
    text = "".join(f"10.0.{i % 256}.{i // 256 % 256} call 12-{i:06d}\n" for i in range(40_000))
    row = personal_data.personal_data(table(spark, [(1, text)])).first()
    spans, digest = brute.private(text)
    assert row["n_ip"] == 40_000 == len(spans) and row["base_sha256"] == digest


def test_precision_and_recall_of_added_spans(spark):
    """Identifiers of unseen forms: in seeds' contexts they are found, in other contexts they are not."""
    rnd = random.Random(14)
    fill = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rnd.randrange(3, 9)))
    seeds = {
        "phone": (["office phone", "mobile number"], lambda: f"+1 (0{rnd.randrange(10, 99)}) 555-{rnd.randrange(1000, 9999)}"),
        "email": (["write to", "mail address"], lambda: f"u{rnd.randrange(9999)}@example.com"),
        "ip": (["server at", "host address"], lambda: f"10.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}"),
    }
    new = {"phone": lambda: f"0{rnd.randrange(100, 999)}/{rnd.randrange(100000, 999999)}", "email": lambda: f"u{rnd.randrange(9999)}@intranet", "ip": lambda: f"fe80::{rnd.randrange(1000, 9999)}:1"}
    rows, planted = [], set()
    for i in range(600):
        kind = rnd.choice(list(seeds))
        contexts, seed = seeds[kind]
        if i % 3:
            rows.append((i, f"{fill()} {rnd.choice(contexts)} {seed()} {fill()}"))
        elif i % 2:
            before, value = f"{fill()} {rnd.choice(contexts)} ", new[kind]()
            rows.append((i, f"{before}{value} {fill()}"))
            planted.add((i, f"{kind}:{len(before)}:{len(before) + len(value)}"))
        else:
            rows.append((i, f"{fill()} {rnd.choice(['order number', 'in year', 'part no'])} {new[kind]()} {fill()}"))
    got = personal_data.personal_data(table(spark, rows)).collect()
    base = {i: {f"{brute.PRIVATE[k]}:{a}:{b}" for a, k, b in brute.private(t)[0]} for i, t in rows}
    added = {(r["doc_id"], x) for r in got for x in r["spans"].split(",") if x and x not in base[r["doc_id"]]}
    assert len(planted) > 80 and len(added & planted) >= 0.9 * len(planted) and len(added & planted) >= 0.9 * len(added)


# ---- toxicity -------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) + (" You IDIOT!" if i % 4 == 0 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows + [(5000, None), (None, "")]), labels).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held == [i for i, _ in rows if got[i]["held_out"]]
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in held) and 0 < got[5000]["score"] < 0.7
    docs = table(spark, rows).withColumn("score", F.lit(1))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 675
    assert toxicity.toxicity(table(spark, rows), labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(table(spark, []), labels).count() == 0


def test_toxicity_equals_plain_version(spark):
    rnd = random.Random(16)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(25)) + (f" bad{rnd.randrange(3)} thing" if i % 3 == 0 and rnd.random() < 0.9 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs, rates = table(spark, rows), toxicity.Rates()
    known = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id", "text")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    texts = dict(rows)
    score = brute.calibrated_ftrl([(int(i % 3 == 0), brute.text_features(texts[i])) for i in known], rates)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert max(abs(got[i] - score(brute.text_features(t))) for i, t in rows) < 1e-6
    assert max(got.values()) > 0.7 > 0.3 > min(got.values())


def test_toxicity_on_held_out_rows(spark):
    """Ranks the held-out labelled rows of the real tables, and a text of a megabyte is scored whole."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    long = spark.createDataFrame([(-1, "calm words " * 90_000 + "you stupid idiot")], "doc_id long, text string")
    scores = toxicity.toxicity(docs.select("doc_id", "text").unionByName(long), labels)
    rows = scores.filter("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    wins = np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good])
    assert wins > 0.98 and len(bad) > 30 and len(good) > 300
    assert np.mean(np.array(bad) >= 0.7) > 0.8 and np.mean(np.array(good) >= 0.7) < 0.005
    assert scores.filter("doc_id = -1").count() == 1


def test_word_hashes():
    column = pa.array(["One two", None, "", "two  ONE two", "x"])
    data, at = words.bytes_of(column, lower=True)
    hashes, counts = words.word_hashes(data, at, words.ALNUM)
    assert counts.tolist() == [2, 0, 0, 3, 1] and hashes[0] == hashes[3] and hashes[1] == hashes[2] == hashes[4]
    assert [len(x) for x in words.shingles(hashes, counts, 2)] == [4, 4]


# ---- warc -----------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big, rows = "h" * 100, [(5, "http://a/\r\nX: y", "é" * 60), (2, None, None), (7, "u", "h" * 100), (3, "u", "h" * 100), (9, "u", "short"), (8, "u", "short"), (None, "n", "h" * 100), (3, "u", "h" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = by_row(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    want = [(5, 120, "response", None), (2, 0, "response", None), (7, 100, "revisit", 3), (3, 100, "response", None), (9, 5, "response", None), (8, 5, "response", None), (None, 100, "revisit", 3), (3, 100, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    index = warc.write_archives(warc.with_referrals(pages), f"file://{tmp_path}/w")
    some = {r["page_id"]: r for r in warc.read_records(index.filter("page_id in (5, 9)"), f"file://{tmp_path}/w").collect()}
    assert bytes(some[5]["payload"]).decode() == "é" * 60 and some[9]["url"] == "u" and len(some) == 2 and big


def test_warc_of_large_pages(spark, tmp_path):
    """Records of some megabytes are read by several tasks, and every record has a name of its own."""
    rnd = random.Random(17)
    rows = [(i, None if i == 4 else f"u{i}", "".join(rnd.choices("abcdefghé<>", k=1_500_000))) for i in range(8)] + [(3, "v", "x" * 200), (3, "w", "x" * 200), (2, "t", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.with_referrals(pages), folder)
    read = warc.read_records(index, folder)
    assert read.rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, index.agg(F.sum("length")).first()[0] >> 20) > 1
    got = sorted((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read.filter("url is not null").collect())
    assert len(got) == 10 and got[3:5] != got[4:5] and [x[3:] for x in got if x[2] == 200] == [("response", None), ("revisit", 2), ("revisit", 2)]
    assert sorted(hashlib.sha256(r["payload"]).hexdigest() for r in read.filter("payload_bytes > 200").collect()) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, _, t in rows[:8])
    heads = [x for f in (tmp_path / "w").iterdir() for x in gzip.decompress(f.read_bytes()).decode(errors="replace").split("\r\n") if x.startswith("WARC-Record-ID: <urn:uuid:")]
    assert len(heads) == len(set(heads)) == len(rows)


# ---- top k ----------------------------------------------------------------------------------------


def test_top_k(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(i, [1.0] * 8) for i in range(200, 230)]
    rows += [(300, None), (301, []), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (320, [1e12] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    f32 = lambda x: float(np.float32(x))
    ints = {i: [int(np.floor(64 * f32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:20]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(c, -s) for s, c in scored]
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 64 * 128)]


@pytest.mark.parametrize(("group", "block", "pivots"), [(50, 4, 3), (20, 1, 64), (1000, 4, 1)])
def test_top_k_in_groups(spark, group, block, pivots):
    """Clusters of vectors, one of them a third of all rows, and several groups and blocks of queries."""
    rnd = random.Random(19)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in rnd.choice(centres)]) for i in range(160)] + [(i, centres[0]) for i in range(160, 240)]
    rnd.shuffle(rows)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, every=5, group=group, block=block, pivots=pivots).collect()
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    for q in (i for i in ints if i % 5 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:7]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(c, -s) for s, c in scored]
    assert len(got) == 48 * 7


def test_large_components_are_cut(spark):
    rows = [(0, [6e13, 1.0]), (20, [6e13, 2.0]), (40, [-6e13, 0.0]), (3, [1e300, 0.0]), (5, [-1e300, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").collect()
    high, low = (1 << 63) - 1, -(1 << 63)
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, high), (20, high), (5, low), (40, low)]


# ---- repeated passages ----------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{"shard_bytes": 700}, {"shard_bytes": 700, "piece_bytes": 60}, {}, {"shard_bytes": 700, "hot_shards": 1}, {"shard_bytes": 500, "hot_shards": 3}])
def test_remove_repeats(spark, options):
    rnd = random.Random(10)
    words_, rows = ["alpha ", "beta ", "é ", "gamma", "x", "zz "], [(i, t if t != LONG else "word " * 60) for i, t in ODD]
    phrases = ["".join(rnd.choice(words_) for _ in range(12)) for _ in range(6)]
    rows += [(rnd.randrange(60), "".join(rnd.choice(phrases) if rnd.random() < 0.3 else rnd.choice(words_) for _ in range(rnd.randrange(25)))) for _ in range(80)]
    rows += [(900, "a" * 500), (901, "a" * 500), (902, "b" + "a" * 300), (1, "q" * 70), (1, "q" * 70)]
    got = suffix_dedup.remove_repeats(table(spark, rows), length=20, **options)
    want = sorted(str((i, *x)) for (i, _), x in zip(rows, brute.repeats(rows, 20), strict=True))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_no_documents(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_equal_keys_are_proved(monkeypatch):
    """With a hash that tells nothing apart the bytes decide."""
    monkeypatch.setattr(suffix_dedup, "kgram_hashes", lambda data, k: np.zeros(len(data) - k + 1, np.uint64))
    run = lambda owner, text: (np.array([owner]), np.array([len(text) - 3], np.int32), text)
    masks = suffix_dedup.later_strings([run(1, b"abcdx"), run(2, b"abcdy"), run(3, b"qqqq")], 4)
    assert [m.tolist() for m in masks] == [[False, False], [True, False], [False]]


def test_suffix_array():
    rnd = random.Random(11)
    for alphabet in (b"ab", b"abcdefgh"):
        text = bytes(rnd.choice(alphabet) for _ in range(600))
        data = np.frombuffer(text, np.uint8)
        order, key, close = suffix_dedup.suffix_array(data, 50)
        shared = suffix_dedup.common_prefixes(data, order, key, np.arange(600) > 0, 8)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            assert text[a : a + 50] <= text[b : b + 50]
            n = next((i for i in range(600 - max(a, b)) if text[a + i] != text[b + i]), 600 - max(a, b))
            assert shared[b] == n or shared[b] <= n < 8


def test_anchors_of_many_shards_meet_in_buckets(spark):
    rows = [(i, f"{i} a line that very many documents have in common {i * i}") for i in range(500)]
    docs = table(spark, rows)
    got = suffix_dedup.remove_repeats(docs, length=20, shard_bytes=16)  # some 1,900 shards, most of which have the line
    assert "hot_strings" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "hot_strings" in suffix_dedup.remove_repeats(docs, length=20, shard_bytes=16, hot_shards=1024)._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(str((i, *x)) for (i, _), x in zip(rows, brute.repeats(rows, 20), strict=True))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_passages_travel_in_few_bytes():
    rng = np.random.default_rng(3)
    place = np.concatenate([np.arange(100, 1100), [5000, 5002], np.arange(100, 600)])
    at, count = (np.frombuffer(x, np.int32) for x in suffix_dedup._marks(place))
    assert list(zip(at.tolist(), count.tolist(), strict=True)) == [(100, 1000), (5000, 1), (5002, 1)]
    found = np.unique(suffix_dedup._short(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)))
    blob = suffix_dedup._written(found)
    assert len(blob) == 5 * len(found) and (suffix_dedup._read(blob) == found).all()
    begin, count, owner = np.arange(0, 6400, 64), np.full(100, 15), np.repeat(np.arange(10), 10)
    text = b"words of a passage that many documents have in common, each some " * 200
    text = text[: int(count.sum()) + 100 * 49]
    sent = suffix_dedup._segments(begin, count, owner, text)
    assert sum(map(len, sent)) < len(text) // 4
    back = suffix_dedup._segments_of(dict(zip("abcd", sent, strict=True)), 50)
    assert all((x == y).all() for x, y in zip(back, (begin, count, owner), strict=False)) and back[3] == text
