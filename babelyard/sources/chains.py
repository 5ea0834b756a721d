"""Shapes of single expressions: member and call chains, conditionals, alternatives.

An expression is read into tokens in which every bracketed part is one token with its own content, so calls may be
nested to any depth. What isn't balanced reads as no tokens, and no tokens have no shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)"""
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>\?\.(?!\d)|\?\?|\|\||&&|=>|\S)",
    re.S,
)
CLOSERS = {"(": ")", "[": "]", "{": "}"}
ALTERNATIVES = ("||", "&&", "??")
#: Names that hold no value of the program's own.
CONSTANTS = ("true", "false", "null", "this")


@dataclass
class Token:
    kind: str  # string, name, number, sign, or the opening bracket of a part
    text: str
    start: int
    end: int
    inner: list[Token] = field(default_factory=list)


@dataclass
class Step:
    kind: str  # root, field, index or call
    name: str
    end: int
    inner: list[Token] = field(default_factory=list)


def blank(source: str, ranges: Iterable[tuple[int, int]]) -> str:
    """source with spaces in place of the ranges, so that markup within an expression isn't read as code."""
    for a, b in ranges:
        source = source[:a] + " " * (b - a) + source[b:]
    return source


def read(source: str) -> list[Token]:
    top: list[Token] = []
    open_parts: list[Token] = []
    for m in TOKEN.finditer(source):
        at, sign = (open_parts[-1].inner if open_parts else top), m[0]
        if m.lastgroup == "sign" and sign in CLOSERS:
            at.append(Token(sign, sign, m.start(), m.end()))
            open_parts.append(at[-1])
        elif m.lastgroup == "sign" and sign in CLOSERS.values():
            if not open_parts or CLOSERS[open_parts[-1].kind] != sign:
                return []
            open_parts.pop().end = m.end()
        else:
            at.append(Token(m.lastgroup, sign, m.start(), m.end()))
    return [] if open_parts else top


def _split(tokens: list[Token], signs: tuple[str, ...]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.kind == "sign" and t.text in signs:
            out.append([])
        else:
            out[-1].append(t)
    return out


def chain(tokens: list[Token]) -> list[Step]:
    """The steps of a.b?.c[d](e): a root and what is taken from it; empty for anything else."""
    if not tokens or tokens[0].kind not in ("name", "("):
        return []
    root = tokens[0]
    if root.kind == "name" and root.text in CONSTANTS and len(tokens) == 1:
        return []
    steps, dotted = [Step("root", root.text if root.kind == "name" else "", root.end, root.inner)], False
    for t in tokens[1:]:
        if t.kind == "sign" and t.text in (".", "?.") and not dotted:
            dotted = True
        elif t.kind == "name" and dotted:
            steps.append(Step("field", t.text, t.end))
            dotted = False
        elif t.kind in ("(", "["):
            steps.append(Step("call" if t.kind == "(" else "index", "", t.end, t.inner))
            dotted = False
        elif not (t.kind == "sign" and t.text == "!" and not dotted):
            return []
    return [] if dotted else steps


def member(steps: list[Step]) -> str | None:
    """c of a chain that ends in b.c, where b is a name too."""
    if len(steps) < 2 or steps[-1].kind != "field":
        return None
    return steps[-1].name if steps[-2].kind in ("root", "field") and steps[-2].name else None


def variable(steps: list[Step], number: int) -> str | None:
    """The name under which a name or member stands in a text; None where a chain is neither."""
    if not steps or steps[-1].kind == "call" or len(steps) == 1 and not steps[0].name:
        return None
    inner = steps[-1].inner
    if steps[-1].kind == "index":
        return inner[0].text if len(inner) == 1 and inner[0].kind == "name" else f"var{number}"
    return steps[-1].name


def conditional(tokens: list[Token]) -> tuple[list[Token], list[Token]] | None:
    """The two outcomes of test ? a : b."""
    signs = [(k, t.text) for k, t in enumerate(tokens) if t.kind == "sign" and t.text in ("?", ":", "=>")]
    if not signs or signs[0][1] != "?":
        return None
    depth = 0
    for k, sign in signs:
        depth += {"?": 1, ":": -1}.get(sign, 0)
        if depth == 0:
            return tokens[signs[0][0] + 1 : k], tokens[k + 1 :]
    return None


def takes(tokens: list[Token], names: frozenset[str]) -> bool:
    """Whether a value comes from one of the named fields, in any of its alternatives; arguments don't count."""
    if outcomes := conditional(tokens):
        return any(takes(o, names) for o in outcomes)
    operands = _split(tokens, ALTERNATIVES)
    if len(operands) > 1:
        return any(takes(o, names) for o in operands)
    cast = next((k for k, t in enumerate(tokens) if k and t.kind == "name" and t.text == "as"), len(tokens))
    steps = chain(tokens[:cast])
    if not steps:
        return False
    return any(s.kind == "field" and s.name in names for s in steps) or not steps[0].name and takes(steps[0].inner, names)


def calls(tokens: list[Token], name: str) -> bool:
    """Whether a chain names a method."""
    return any(s.kind == "field" and s.name == name for s in chain(tokens))


def parameters(source: str) -> set[str]:
    """The plain parameters of an arrow function that source begins with; taken apart ones are none."""
    m = re.match(r"\s*(?:async\s+)?(?:([A-Za-z_$][\w$]*)\s*=>|(?=\())", source)
    if not m:
        return set()
    if m[1]:
        return {m[1]}
    depth, end = 0, 0
    for end in range(m.end(), len(source)):
        depth += (source[end] in "([{") - (source[end] in ")]}")
        if depth == 0:
            break
    listed = _split(read(source[m.end() + 1 : end]), (",",))
    return {p[0].text for p in listed if p and p[0].kind == "name" and (len(p) == 1 or p[1].text in (":", "?"))}
