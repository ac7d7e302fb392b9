"""Secret scans by assignment-aware lexing.

Fixed patterns find the plain cases. Beside them, each text is read as source or configuration: names
with an assignment sign and an expression of literals, names and ``+`` become name-literal pairs.
Names that stand for constants are replaced by the literals that were assigned to them, so that
``x = "..."; password = x`` points at the first literal. A pair is scored by how sensitive the target's
name is and by how much its literal looks like a key rather than a word; high scores are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
SCORE = 1.0
# The base patterns. ASCII case folding only, so that no other letter counts as one of these.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Parts of names and what they say about the value.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9,
    "credential": 0.8, "bearer": 0.8, "authkey": 0.9, "connectionstring": 0.7,
}
HARMLESS = re.compile(r"(?i)(url|uri|path|file|name|length|size|count|type|expir\w*|ttl|hint|policy|regex|pattern)$")
PLACEHOLDER = re.compile(r"(?i)^(.)\1*$|example|changeme|change_me|placeholder|your[-_ ]|dummy|sample|\$\{|\{\{|^<.*>$|^%\w+%$|xxxx|\*{3}")
#: Words and file names joined by signs, and addresses without a user's part.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[._/-]+(?:[A-Z]?[a-z]+|[A-Z]+))*|[a-z][a-z0-9+.-]*://[^@]*")
MAYBE = re.compile(r"(?i)pass|pwd|secret|token|key|credential|bearer|connection")

STRING = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'" + r"|`[^`\n]*`"
HEAD = re.compile(r"(?<![\w$.-])(?:(?P<name>[A-Za-z_$][\w$.-]*)|(?P<q>[\"'])(?P<quoted>[\w$. -]++)(?P=q))[ \t]*(?:=>|:=|\?=|=(?!=)|:(?![:/]))[ \t]*")
TERM = re.compile(rf"(?P<string>{STRING})|(?P<word>[^\s,;()\[\]{{}}+\"'`<>]+)")
ANNOTATED = re.compile(r"[ \t]*=(?!=)[ \t]*")
PLUS = re.compile(r"[ \t]*\+[ \t]*(?:\\?\n[ \t]*)?")
TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]++)</\1>")
NAME = re.compile(r"[A-Za-z_$][\w$.-]*\Z")

Span = tuple[int, int]
#: What an expression comes to: spans of literals, and the parts of constants, which are shared and not copied.
Parts = list["Span | Parts"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the fixed patterns find, each kind leftmost and non-overlapping."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    if HARMLESS.search(name):
        return 0.0
    flat = re.sub(r"[^a-z]", "", name.lower())
    return max((s for part, s in SENSITIVE.items() if part in flat), default=0.0)


def literal_score(value: str) -> float:
    """From 0 to 1: long, mixed and without order is high; words, numbers and placeholders are 0."""
    n = len(value)
    if n < 8 or PLACEHOLDER.search(value) or WORDS.fullmatch(value) or re.search(r"\s", value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes < 2 or entropy < 2.5:
        return 0.0
    return min(1.0, entropy / 4 + 0.1 * (classes - 2) + 0.1 * (n >= 20))


def resolved(parts: Parts) -> list[Span]:
    """The literals of ``parts`` in order, each once, however often constants repeat it: so work is in proportion to the text."""
    spans: list[Span] = []
    seen: set[int | Span] = set()
    stack = parts[::-1]
    while stack:
        part = stack.pop()
        mark = id(part) if isinstance(part, list) else part
        if mark in seen:
            continue
        seen.add(mark)
        if isinstance(part, list):
            stack += part[::-1]
        else:
            spans.append(part)
    return spans


def pairs(text: str) -> Iterator[tuple[str, Parts]]:
    """Targets' names in order, each with what its expression comes to."""
    constants: dict[str, Parts] = {}
    at = 0
    while head := HEAD.search(text, at):
        name, at = head["name"] or head["quoted"], head.end()
        term = TERM.match(text, at)
        if term and term["word"] and (annotated := ANNOTATED.match(text, term.end())):
            at = annotated.end()  # name: type = value
            term = TERM.match(text, at)
        spans: Parts = []
        bare = False
        while term:
            at = term.end()
            if term["string"]:
                spans.append((term.start() + 1, term.end() - 1))
            elif known := constants.get(term["word"]):
                spans.append(known)
            elif not NAME.match(term["word"]) or "=" not in text[head.end("name") : head.end()]:
                spans.append(term.span())
                bare = True
            plus = PLUS.match(text, at)
            term = TERM.match(text, plus.end()) if plus else None
        if spans:
            if not bare or len(spans) == 1:
                constants[name] = spans[0] if len(spans) == 1 and isinstance(spans[0], list) else spans
            yield name, spans
        at = max(at, head.end())
    for tag in TAG.finditer(text):
        yield tag[1], [tag.span(2)]


def found_literals(text: str) -> list[tuple[int, int, float, str]]:
    """``(start, end, score, name)`` of the literals whose targets and looks say that they are secrets."""
    if not MAYBE.search(text):
        return []
    out: dict[Span, tuple[float, str]] = {}
    for name, parts in pairs(text):
        sensitive = name_score(name)
        if sensitive:
            spans = resolved(parts)
            score = sensitive + literal_score("".join(text[a:b] for a, b in spans)) - 0.5
            if score >= SCORE:
                for span in spans:
                    out[span] = max(out.get(span, (0.0, "")), (score, name))
    return [(a, b, s, n) for (a, b), (s, n) in sorted(out.items()) if a < b]


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the added ones that lie in no base span."""
    base = base_spans(text)
    more, i, reach = [], 0, 0
    for a, b, _, _ in found_literals(text):
        while i < len(base) and base[i][0] <= a:
            reach, i = max(reach, base[i][2]), i + 1
        if b > reach:
            more.append((a, 3, b))
    return base, sorted(base + more)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per secret: ``doc_id, kind, start, end, value``; positions are code points, ends exclusive.

    Added spans are of kind ``literal``; a value that expressions and constants make is scored from its literals, each once. Null and empty
    texts, and an empty table, give no row; repeated rows give theirs each; spans of one start are in the order of the kinds. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kind, start, end, value = [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                for a, k, b in all_spans(text)[1]:
                    for column, v in zip((at, kind, start, end, value), (i, KINDS[k], a, b, text[a:b]), strict=True):
                        column.append(v)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "start", "end", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, kind string, start long, end long, value string")


def secret_counts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Counts and digest are of the fixed patterns' spans; ``spans`` has the lexer's as well. A null text
    counts as empty and has no spans; repeated rows give repeated results; an empty table gives an
    empty result; other columns are ignored. Rows stay in their partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for x in batch.column(1):
                base, every = all_spans(x.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
