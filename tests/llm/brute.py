"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np


def _digest(spans, kinds):
    text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return hashlib.sha256(text.encode()).hexdigest()


SECRETS = ("assign", "access", "hex")


def secrets(text):
    text = text or ""
    word = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + ")"
    out = []
    for k, (pattern, group, least) in enumerate((
        (word + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return out, _digest(out, SECRETS)


PRIVATE = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    out = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(checks) for m in re.finditer(p, text) if ok(m)]
    return out, _digest(out, PRIVATE)


def repeats(rows, length):
    """rows of (doc_id, text): {index: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    last = (1 << 63) - 1
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        doc = last if doc is None else doc
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(doc, first.get(s, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        doc = last if doc is None else doc
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def links_of_all_pairs(rows):
    """Classes by all pairs: the smallest id that chains of links lead to."""
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def text_features(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {*w, *zip(w, w[1:]), *((a, None, b) for a, b in zip(w, w[2:]))}


def calibrated_ftrl(examples, rates, shift=0.0):
    """A function from features to a score: all examples' model, its log-odds stretched and moved to suit every fourth example.

    Slope and offset are found by golden sections, one within the other; the loss is convex.
    """

    def order(n):
        turns = np.random.default_rng(7)
        return [i for _ in range(rates.epochs) for i in turns.permutation(n).tolist()]

    def odds(score, features):
        p = score(features)
        return math.log(p / (1 - p)) + shift

    seen = [x for i, x in enumerate(examples) if i % 4]
    part = ftrl(seen, rates, order(len(seen)))
    spared = [(y, odds(part, f), math.exp(shift) if y else 1.0) for y, f in examples[::4]]
    whole = len(spared) / sum(w for _, _, w in spared)

    def least(f, lo, hi):
        cut = (math.sqrt(5) - 1) / 2
        while hi - lo > 1e-9:
            a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
            lo, hi = (lo, b) if f(a) < f(b) else (a, hi)
        return (lo + hi) / 2

    x, y, w = (np.array([s[k] for s in spared], float) for k in (1, 0, 2))

    def loss(slope, offset):
        v = slope * x + offset
        return float((w * whole * (np.logaddexp(0, v) - y * v)).sum()) + ((slope - 1) ** 2 + offset**2) / 2

    offset_of = lambda slope: least(lambda o: loss(slope, o), -20, 20)
    slope = least(lambda s: loss(s, offset_of(s)), -20, 20)
    offset, full = offset_of(slope), ftrl(examples, rates, order(len(examples)))
    return lambda features: 1 / (1 + math.exp(-(slope * odds(full, features) + offset)))


def ftrl(examples, rates, order):
    """FTRL-proximal with dictionaries: examples of (label, features) in the order of ``order``; a function from features to a score."""
    z, n, bias = {}, {}, object()

    def weight(f):
        if f not in z or (f is not bias and abs(z[f]) <= rates.l1):
            return 0.0
        l1 = 0.0 if f is bias else math.copysign(rates.l1, z[f])
        return (l1 - z[f]) / ((rates.beta + math.sqrt(n[f])) / rates.alpha + rates.l2)

    def score(features):
        return 1 / (1 + math.exp(-sum(map(weight, [*features, bias]))))

    for at in order:
        label, features = examples[at]
        w = {f: weight(f) for f in [*features, bias]}
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
        for f in w:
            grown = n.get(f, 0.0) + g * g
            z[f] = z.get(f, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(f, 0.0))) / rates.alpha * w[f]
            n[f] = grown
    return score


def mixed(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """rows of (doc_id, text, source): how often each is taken."""
    size = {i: len(re.findall(r"[^ \t\n\v\f\r]+", t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    left, open_ = share * sum(total.values()), {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > most * total[s]]
        for s in full or list(open_):
            target[s] = most * total[s] if full else level * open_[s]
            left -= target[s] if full else 0
            del open_[s]
    times = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        need, upto = target[s] - whole * total[s], 0
        for h, i in sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i, _, x in rows if x == s):
            times[i] = min(int(most), whole + (2 * upto + size[i] <= 2 * need))
            upto += size[i]
    return times
