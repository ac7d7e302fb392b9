"""Boolean queries: text to a tree to a Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import LOWER, UPPER

_ITEM = re.compile(r"\s+|&&?|\|\|?|[!()]|[^\s&|!()]+")
_FOLD = str.maketrans(UPPER, LOWER)


class QueryError(ValueError):
    """A query that cannot be read; the message says why."""


@dataclass(frozen=True)
class Node:
    """``term``, ``not``, ``and`` or ``or``."""

    kind: str
    term: str = ""
    parts: tuple["Node", ...] = ()


def lex(query: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of each item: terms in lower ASCII case, ``and``, ``or``, ``not``, brackets."""
    signs = {"&": "and", "|": "or", "!": "not", "(": "(", ")": ")"}
    items = (x for x in _ITEM.findall(query) if not x.isspace())
    return [(signs[x[0]], x) if x[0] in signs else ("term", x.translate(_FOLD)) for x in items]


def with_implied_and(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``and`` between an operand's end and the next one's beginning."""
    out: list[tuple[str, str]] = []
    for item in items:
        if out and out[-1][0] in ("term", ")") and item[0] in ("term", "(", "not"):
            out.append(("and", ""))
        out.append(item)
    return out


def parse(query: str) -> Node | None:
    """The query's tree; None where it has no term at all, which finds nothing and is no error.

    ``not`` binds closest, then ``and``, then ``or``. Operators wait until one that binds less closely, a bracket
    or the end makes them take their operands. Brackets that do not match are told before operands that lack.
    """
    items = with_implied_and(lex(query))
    if not any(kind == "term" for kind, _ in items):
        return None
    binding = {"or": 1, "and": 2, "not": 3}
    made: list[Node] = []
    waiting: list[str] = []
    faults: list[str] = []

    def apply_until(stop: Callable[[str], bool]) -> None:
        while waiting and not stop(waiting[-1]):
            sign = waiting.pop()
            if sign == "(":
                raise QueryError("Unmatched '('")
            need = 1 if sign == "not" else 2
            if len(made) < need:
                faults.append("NOT without operand" if sign == "not" else "Binary operator without 2 operands")
                continue
            parts = tuple(made[-need:])
            del made[-need:]
            made.append(Node(sign, parts=parts))

    for kind, text in items:
        if kind == "term":
            made.append(Node("term", text))
        elif kind == "(":
            waiting.append(kind)
        elif kind == ")":
            apply_until(lambda x: x == "(")
            if not waiting:
                raise QueryError("Unmatched ')'")
            waiting.pop()
        else:
            # of two equal ones the earlier goes first, but for ``not``, which stands before its operand
            apply_until(lambda x: x == "(" or binding[x] < binding[kind] + (kind == "not"))  # noqa: B023
            waiting.append(kind)
    apply_until(lambda _: False)
    if faults or len(made) != 1:
        raise QueryError(faults[0] if faults else "Bad expression")
    return made[0]


def terms(node: Node) -> list[str]:
    """The distinct terms, in order."""
    found = [node.term] if node.kind == "term" else [t for part in node.parts for t in terms(part)]
    return list(dict.fromkeys(found))


def evaluate(node: Node, holds: Callable[[str], bool]) -> bool:
    if node.kind == "term":
        return holds(node.term)
    values = [evaluate(part, holds) for part in node.parts]
    return not values[0] if node.kind == "not" else all(values) if node.kind == "and" else any(values)


def needs_universe(node: Node) -> bool:
    """Whether documents with none of the terms are found."""
    return evaluate(node, lambda _: False)


def condition(node: Node, flag: Callable[[str], Column]) -> Column:
    """The query as a condition over one Boolean column per term."""
    if node.kind == "term":
        return flag(node.term)
    parts = [condition(part, flag) for part in node.parts]
    if node.kind == "not":
        return ~parts[0]
    return parts[0] & parts[1] if node.kind == "and" else parts[0] | parts[1]


def flags(names: list[str], term: str = "term") -> list[Column]:
    """Per document, whether it has each term: aggregates over its postings."""
    return [F.bool_or(F.col(term) == name).alias(f"t{i}") for i, name in enumerate(names)]
