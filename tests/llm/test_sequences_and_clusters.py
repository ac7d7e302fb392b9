"""Packing, repair of conversations and clustering against plain versions, and on null, empty, long, repeated and missing rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import clustering, conversations, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    None, "", " ", "x", "Don't you'LL'S'ſ ''s !'s 's.", "a\x1cb\x1d c\x85d\xa0e f　g", "İstanbul ŒUVRE ﬁn ÄÖ", "é ́a Å",
    "<|endoftext|> x<|startoftext|>y <|", "😀👍🏽 漢字かな", "ΑΣ ΟΔΟΣ. Σ", "1234 ¼½ ²³ ٣", "word. word, WORD! a.b,c;d", "\x00\x7f\xad-", "A" * 9000,
]


def want_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "KEPT_PIECES", 2)
    tokenizer = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    rnd = random.Random(4)
    letters = "aAbB'sSt.,!?; \t\n-_09éÉßÿŁıſ<|>\x1f\xa0́Σς漢"
    texts = ODD_TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(400)]
    for text in texts:
        assert array("I", encoder.ids(text or "")).tolist() == want_ids(tokenizer, text), text


def test_open_bins_are_best_fit():
    rnd = random.Random(5)
    got, bins, made = packing.OpenBins(20, 4), [], 0
    for _ in range(600):
        n = rnd.randrange(1, 21)
        b, place = got.place(n)
        fits = [x for x in bins if x[1] >= n]
        if fits:
            free = min(x[1] for x in fits)
            chosen = next(x for x in bins if x[0] == b)
            assert chosen[1] == free and place == 20 - free
            chosen[1] -= n
        else:
            if len(bins) == 4:
                least = min(x[1] for x in bins)
                closed = [x for x in bins if x[1] == least]
                assert len(bins) - len(closed) <= got.n
                still = set(got.still_open())
                bins.remove(next(x for x in closed if x[0] not in still))
            assert (b, place) == (made, 0)
            made += 1
            bins.append([b, 20 - n])
        bins = [x for x in bins if x[1]]
        assert sorted(got.still_open()) == sorted(x[0] for x in bins) and got.n == len(bins) <= 4


@pytest.mark.parametrize(("size", "limit", "group"), [(2048, 8192, 8192), (16, 3, 2)])
def test_pack(spark, size, limit, group):
    tokenizer, rnd = Tokenizer.from_file(WORDS), random.Random(6)
    texts = ODD_TEXTS + ["short", "short"] + [" ".join(rnd.choice(["north", "sea", "quietly"]) for _ in range(rnd.randrange(60))) for _ in range(150)]
    rows = [(None if i == 3 else i // 2, t, 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin int, place int, length int").repartition(3)
    got = packing.pack(docs, WORDS, size, limit, group).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = want_ids(tokenizer, text) + [0]
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want[doc, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    tokens = sum(r["length"] for r in got)
    assert len(sequences) <= math.ceil(tokens / size) * (1.01 if limit > 99 else 1.5) + 1
    assert packing.pack(docs.limit(0), WORDS).count() == 0


# ---- conversations --------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """The fields of one conversation's damaged rows; edits by Dijkstra over (cost, labels)."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], zlib.crc32(r[3].encode())))
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, labels, i, roles, kept = heapq.heappop(heap)
        state = (i, roles[-1:])
        if state in done and not (i == len(rows) and re.fullmatch("(s?(ua)+)?", roles)):
            continue
        done.add(state)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        more = [(5, "I", r, i, ({"u": "user", "a": "assistant"}[r], "")) for r in "ua"]
        if i < len(rows):
            _, _, role, text = rows[i]
            more.append((2, "D", "", i + 1, None))
            if faults[i] not in ("b", "d"):
                extra = 5 * (faults[i] == "t")
                more += [(1 + extra, "R", r, i + 1, ({"u": "user", "a": "assistant"}[r], text)) for r in "ua"]
                more += [(extra, "K", initials[i], i + 1, (role, text))] if initials[i] else []
        for plus, label, role, to, row in more:
            if re.fullmatch("s?(ua)*u?", roles + role):
                heapq.heappush(heap, (cost + plus, labels + label, to, roles + role, kept + ((row,) if row else ())))
    text = "\n".join(f"{role}:{text}" for role, text in kept)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in "bdt"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, labels, hashlib.sha256(text.encode()).hexdigest(),
    )


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_repair(spark, coalesce):
    rnd = random.Random(7)
    texts = ["yes.", "no!", "why?", "cut off", " \n", "", None, "yes.", "a. b", "\x85", "long " * 500 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None]
    row = lambda conv, turn: (conv, turn, rnd.choice(roles), rnd.choice(texts))
    rows = [row(conv, rnd.choice([None, *range(9)])) for conv in [None, *range(60)] for _ in range(rnd.randrange(1, 9))]
    # a conversation that holds a third of all rows, its turns repeated, and one whose rows are all dropped
    rows += [row(1000, rnd.choice([None, *range(40)])) for _ in range(len(rows) // 2)] + [(7, 3, "user", "again."), (7, 3, "user", "again.")]
    gone = next(c for c in range(2000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(gone, 1, "user", "x"), (-5, 1 << 62, "user", "far."), (-5, -(1 << 62), "assistant", "away.")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], CONVERSATIONS + ", part int, pos int").repartition(5)
    damaged = defaultdict(list, {r[0]: [] for r in rows})
    for r in plain_damage(rows):
        damaged[r[0]].append(r)
    want = {conv: plain_repair(own) for conv, own in damaged.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = conversations.repair_damaged(table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want)
    for r in got:
        expected = list(want[r["conv_id"]])
        expected[0] = min(expected[0], (1 << 63) - 1)
        assert list(r)[1:] == expected, r["conv_id"]
    assert conversations.repair_damaged(table.limit(0)).count() == 0


def test_stretches_compose():
    """Weights over stretches, composed, are those over all rows; long ones stay linear."""
    rnd = random.Random(8)
    kinds = [conversations.arcs(f, i) for f in ("", "", "truncated", "blank") for i in ("s", "u", "a", "t", "")]
    for n in (0, 1, 5, 40, 3000):
        rows = [rnd.choice(kinds) for _ in range(n)]
        best, cuts = {0: (0, "")}, sorted(rnd.randrange(n + 1) for _ in range(3))
        for a, b in zip([0, *cuts], [*cuts, n]):
            step = conversations.composed(best, {s: conversations.shortest(rows[a:b], s) for s in conversations.STATES})
            best = {state: weight for state, (weight, _) in step.items()}
        assert best == conversations.shortest(rows)


# ---- clusters -------------------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, width):
    kept = [(i, [min(max(math.floor(64 * np.float64(np.float32(x))), -(1 << 63)), (1 << 63) - 1) for x in v])
            for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        for k, vs in held.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs)]
    most = (1 << 63) - 1
    found = [(i, k, min(d, most)) for i, v in kept for d, k in [near(v)]]
    sums = Counter()
    for _, k, d in found:
        sums[k] += d
    whole = min(sum(sums.values()), most)
    return sorted(str((i, k, d, min(sums[k], most), whole, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())) for i, k, d in found)


@pytest.mark.parametrize("huge", [False, True])
def test_clusters(spark, huge):
    rnd = random.Random(9)
    centres = [[rnd.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(160)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [0.5] * 5), (2003, [0.5] * 5 + [None]), (2004, [math.nan] * 6), (2005, [math.inf] * 6)]
    rows += [(3000, [1e30, -1e30, 0.0, 1e17, 2.0, 3.0]), (3001, [1e17, 5.0, 0.0, -1e17, 2.0, 3.0])] if huge else []
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)
    got = clustering.cluster(table, clusters=8, width=6, size=64, leaf=4).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_clusters(rows, 8, 3, 6)
    few = table.filter("vec_id in (1, 2, 3)")
    assert sorted(str(tuple(r)) for r in clustering.cluster(few, width=6).collect()) == plain_clusters([r for r in rows if r[0] in (1, 2, 3)], 16, 3, 6)
    assert clustering.cluster(table.limit(0), width=6).count() == 0


def test_trees_prune_but_keep_the_nearest():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(16, 64)) * 500
    x = np.floor(centres[rng.integers(0, 16, 1000)] + rng.normal(size=(1000, 64)) * 20)
    x[100:300] = x[0]
    tree, of_centroids = clustering.cover_tree(x, 16), clustering.cover_tree(centres, 1)
    assert sorted(tree.order) == list(range(1000))
    for (a, b), pivot, radius in zip(tree.rows, tree.pivot, tree.radius, strict=True):
        assert np.sqrt(((x[tree.order[a:b]] - x[pivot]) ** 2).sum(axis=1)).max() <= radius + 1e-6
    mask = clustering.candidates(x, tree, centres, of_centroids)
    best = ((x[tree.order][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert mask[np.arange(1000), best].all() and mask.sum() < 2 * len(x)
