"""A tolerant scanner for component sources: elements, object literals, calls and scopes.

It reads strings, templates, comments, regular expressions, JSX, functions and object literals,
and nothing else of the language. What it can't read raises SyntaxError. Offsets count characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from babelyard.sources.chains import parameters

IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
BEFORE_EXPRESSION = {"return", "case", "typeof", "default", "await", "yield", "in", "of", "do", "else", "void", "delete", "new", "instanceof"}
VALUE_END = re.compile(r"[\w$)\]}\"'`]")


@dataclass
class Scope:
    name: str
    start: int
    end: int
    is_default: bool
    body: int | None = None

    @property
    def is_component(self) -> bool:
        return bool(re.match("[A-Z]", self.name)) or self.is_default


@dataclass
class Text:
    value: str
    start: int
    end: int


@dataclass
class Expr:
    """{...} among children or as an attribute's value; source is what stands inside, without comments around it."""

    source: str
    start: int
    end: int
    at: int
    comments: list[str]
    elements: list = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.source


@dataclass
class Attribute:
    name: str
    value: str | Expr | None
    start: int
    end: int


@dataclass
class Element:
    name: str
    attributes: list[Attribute]
    children: list
    start: int
    end: int
    line: int
    self_closing: bool
    comments: list[str] = field(default_factory=list)


@dataclass
class Property:
    key: str
    key_start: int
    key_end: int
    quoted: bool
    value: str | None
    value_start: int
    value_end: int


@dataclass
class Literal:
    """An object literal; is_style by where it stands or what it is assigned to."""

    properties: list[Property]
    in_style: bool


@dataclass
class Loop:
    """receiver.map(x => ...): the receiver's source, the callback's parameters and where the call's brackets stand."""

    receiver: str
    parameters: set[str]
    start: int
    end: int


@dataclass
class Str:
    value: str
    start: int
    end: int


class Source:
    """Everything that one scan of a file finds."""

    def __init__(self, text: str):
        self.text = text
        self.roots: list[Element] = []
        self.objects: list[Literal] = []
        self.scopes: list[Scope] = []
        self.calls: list[tuple[str, Str]] = []
        self.exports: list[tuple[int, int]] = []
        self.loops: list[Loop] = []
        self._names: list[str] = []
        self._attribute = ""
        self._code(0, "", self.roots)

    # -- small readers -------------------------------------------------------

    def _fail(self, at: int, what: str):
        raise SyntaxError(f"{what} at {at}")

    def _space(self, at: int, comments: list[str] | None = None) -> int:
        text = self.text
        while at < len(text):
            if text[at].isspace():
                at += 1
            elif text.startswith("//", at):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                if comments is not None:
                    comments.append(text[at + 2 : end])
                at = end
            elif text.startswith("/*", at):
                end = text.find("*/", at + 2)
                if end < 0:
                    self._fail(at, "comment without end")
                if comments is not None:
                    comments.append(text[at + 2 : end])
                at = end + 2
            else:
                break
        return at

    def _string(self, at: int) -> Str:
        quote, end, out = self.text[at], at + 1, []
        while end < len(self.text) and self.text[end] != quote:
            sign = self.text[end]
            if sign == "\n":
                self._fail(at, "string without end")
            if sign == "\\":
                end += 1
                if end >= len(self.text):
                    break
                sign = {"n": "\n", "t": "\t", "r": "\r"}.get(self.text[end], self.text[end])
            out.append(sign)
            end += 1
        if end >= len(self.text):
            self._fail(at, "string without end")
        return Str("".join(out), at, end + 1)

    def _template(self, at: int, elements: list) -> int:
        end = at + 1
        while end < len(self.text) and self.text[end] != "`":
            if self.text[end] == "\\":
                end += 2
            elif self.text.startswith("${", end):
                end = self._code(end + 2, "}", elements)
            else:
                end += 1
        if end >= len(self.text):
            self._fail(at, "template without end")
        return end + 1

    def _regex(self, at: int) -> int:
        end, inside = at + 1, False
        while end < len(self.text) and self.text[end] != "\n":
            sign = self.text[end]
            if sign == "\\":
                end += 1
            elif sign == "[":
                inside = True
            elif sign == "]":
                inside = False
            elif sign == "/" and not inside:
                return re.compile("[a-z]*").match(self.text, end + 1).end()
            end += 1
        return at + 1

    # -- code ----------------------------------------------------------------

    def _code(self, at: int, closer: str, elements: list) -> int:
        """Reads code up to closer, and returns the place after it."""
        text, before, declared, exported, is_default, since = self.text, "(" if closer in (")", "]") else "", "", None, False, 0
        operand, dot, mapped = at, at, None
        while True:
            comments: list[str] = []
            line = text.count("\n", since, at) if since else 0
            moved = self._space(at, comments)
            new_line = "\n" in text[at:moved] or line > 0
            at = moved
            if at >= len(text):
                if closer:
                    self._fail(at, f"{closer} is missing")
                self._end_export(exported, at)
                return at
            sign, since = text[at], at
            expression = not before or not VALUE_END.match(before[-1]) or before in BEFORE_EXPRESSION
            if expression and before != ".":
                operand = at
            if sign == closer:
                self._end_export(exported, at)
                return at + 1
            if new_line and not expression and IDENTIFIER.match(text, at) and not closer.strip(")]"):
                declared = ""
            if sign in "\"'":
                at, before = self._string(at).end, sign
            elif sign == "`":
                at, before = self._template(at, elements), sign
            elif sign == "/" and expression:
                at, before = self._regex(at), '"'
            elif sign in "([":
                end = self._nested(at + 1, ")" if sign == "(" else "]", elements, declared)
                if mapped and mapped[1] == at:
                    self.loops.append(Loop(text[operand : mapped[0]], parameters(text[at + 1 : end]), at, end))
                at, before = end, ")"
            elif sign == "{":
                at = self._braces(at, expression and before not in (")", "=>"), elements, declared, before)
                before = "}"
                if not closer:
                    exported = self._end_export(exported, at) if not text[at : at + 1] in ",;" else exported
            elif sign in ")]}":
                self._fail(at, f"unexpected {sign}")
            elif sign == "<" and (expression or before == "}") and self._opens(at):
                element, at = self._element(at, comments)
                elements.append(element)
                before = ")"
            elif text.startswith("=>", at):
                at = self._arrow(at + 2, declared, is_default, elements)
                before, declared, is_default = ")", "", False
            elif word := IDENTIFIER.match(text, at):
                own = word[0]
                if own == "function":
                    at = self._function(word.end(), declared, is_default, elements)
                    before, declared, is_default = "}", "", False
                    continue
                if own in ("const", "let", "var") and before != ".":
                    name = IDENTIFIER.match(text, self._space(word.end()))
                    if name:
                        declared, at, before = name[0], name.end(), name[0]
                        continue
                if own == "export":
                    exported = at
                if own == "default" and before == "export":
                    is_default = True
                nxt = self._space(word.end())
                if before != "." and text[nxt : nxt + 1] == "(":
                    inner = self._space(nxt + 1)
                    if text[inner : inner + 1] in ('"', "'") and text[inner : inner + 1]:
                        self.calls.append((own, self._string(inner)))
                if own == "map" and before == ".":
                    mapped = (dot, nxt)
                at, before = word.end(), own
            else:
                if sign == ";":
                    declared, is_default = "", False
                    exported = self._end_export(exported, at)
                dot = at
                if text.startswith("?.", at):
                    at, before = at + 2, "."
                else:
                    number = re.compile(r"\d[\w.]*").match(text, at)
                    at, before = (number.end(), "0") if number else (at + 1, sign)

    def _end_export(self, exported: int | None, at: int):
        if exported is not None:
            self.exports.append((exported, at))

    def _nested(self, at: int, closer: str, elements: list, declared: str) -> int:
        self._names.append(declared)
        attribute, self._attribute = self._attribute, ""
        end = self._code(at, closer, elements)
        self._attribute = attribute
        self._names.pop()
        return end

    def _braces(self, at: int, may_be_object: bool, elements: list, declared: str, before: str) -> int:
        if may_be_object and before not in (";", "}", ""):
            kept = len(self.objects), len(self.scopes), len(elements), len(self.calls), len(self.loops)
            try:
                return self._object(at, elements, declared)
            except SyntaxError:
                del self.objects[kept[0] :], self.scopes[kept[1] :], elements[kept[2] :], self.calls[kept[3] :], self.loops[kept[4] :]
        return self._nested(at + 1, "}", elements, declared)

    def _object(self, at: int, elements: list, declared: str) -> int:
        """An object literal; SyntaxError if it is something else."""
        text, place, properties = self.text, len(self.objects), []
        names = [*self._names, declared]
        style = self._attribute in ("style", "sx", "css") or any("style" in n.lower() or "css" in n.lower() for n in names if n)
        self.objects.append(Literal(properties, style))
        attribute, self._attribute = self._attribute, ""
        self._names.append(declared)
        at = self._space(at + 1)
        while text[at : at + 1] != "}":
            if text.startswith("...", at):
                at = self._value(at + 3, elements)
            else:
                start, quoted = at, False
                if text[at : at + 1] in ("'", '"') and text[at : at + 1]:
                    own = self._string(at)
                    key, at, quoted = own.value, own.end, True
                elif text[at : at + 1] == "[":
                    at, key = self._nested(at + 1, "]", elements, declared), None
                elif word := re.compile(r"[A-Za-z_$][\w$]*|\d+").match(text, at):
                    key, at = word[0], word.end()
                else:
                    self._fail(at, "no property")
                end = at
                at = self._space(at)
                if text[at : at + 1] == ":":
                    first = self._space(at + 1)
                    at = self._value(first, elements)
                    raw = re.sub(r"\s+as\s+[\w.]+$", "", text[first:at].strip())
                    value = self._string(first).value if raw[:1] in ("'", '"') and self._string(first).end == first + len(raw) else None
                    if key is not None:
                        properties.append(Property(key, start, end, quoted, value, first, first + len(raw)))
                elif text[at : at + 1] == "(":
                    at = self._space(self._nested(at + 1, ")", elements, ""))
                    if text[at : at + 1] != "{":
                        self._fail(at, "no method")
                    at = self._nested(at + 1, "}", elements, "")
                elif text[at : at + 1] not in (",", "}"):
                    self._fail(at, "no property")
                elif key is not None:
                    properties.append(Property(key, start, end, quoted, None, start, end))
            at = self._space(at)
            if text[at : at + 1] == ",":
                at = self._space(at + 1)
            elif text[at : at + 1] != "}":
                self._fail(at, "no end of a property")
        self._names.pop()
        self._attribute = attribute
        assert self.objects[place].properties is properties
        return at + 1

    def _value(self, at: int, elements: list) -> int:
        """An expression up to a comma or closing bracket of its own level."""
        text, before, start = self.text, ":", at
        while True:
            comments: list[str] = []
            at = self._space(at, comments)
            if at >= len(text):
                self._fail(at, "no end of a value")
            sign = text[at]
            expression = not VALUE_END.match(before[-1]) or before in BEFORE_EXPRESSION
            if sign in ",)]};":
                if at == start or sign == ";":
                    self._fail(at, "no value")
                return at
            if sign in "\"'":
                at, before = self._string(at).end, sign
            elif sign == "`":
                at, before = self._template(at, elements), sign
            elif sign == "/" and expression:
                at, before = self._regex(at), '"'
            elif sign in "([":
                at, before = self._nested(at + 1, ")" if sign == "(" else "]", elements, ""), ")"
            elif sign == "{":
                at = self._braces(at, expression, elements, "", before)
                before = "}"
            elif sign == "<" and expression and self._opens(at):
                element, at = self._element(at, comments)
                elements.append(element)
                before = ")"
            elif text.startswith("=>", at):
                at, before = self._arrow(at + 2, "", False, elements), ")"
            elif word := IDENTIFIER.match(text, at):
                if word[0] == "function":
                    at, before = self._function(word.end(), "", False, elements), "}"
                else:
                    nxt = self._space(word.end())
                    inner = self._space(nxt + 1)
                    if before != "." and text[nxt : nxt + 1] == "(" and text[inner : inner + 1] and text[inner] in "\"'":
                        self.calls.append((word[0], self._string(inner)))
                    at, before = word.end(), word[0]
            else:
                number = re.compile(r"\d[\w.]*").match(text, at)
                at, before = (number.end(), "0") if number else (at + 1, sign)

    def _function(self, at: int, declared: str, is_default: bool, elements: list) -> int:
        text = self.text
        at = self._space(at)
        at = self._space(at + 1) if text[at : at + 1] == "*" else at
        name = IDENTIFIER.match(text, at)
        own, at = (name[0], self._space(name.end())) if name else (declared, at)
        if text[at : at + 1] == "<":
            at = self._space(text.index(">", at) + 1)
        if text[at : at + 1] != "(":
            self._fail(at, "no parameters")
        at = self._nested(at + 1, ")", elements, "")
        body = text.find("{", at)
        if body < 0:
            self._fail(at, "no body")
        scope = Scope(own, body, body, is_default, body + 1)
        self.scopes.append(scope)
        scope.end = self._nested(body + 1, "}", elements, declared)
        return scope.end

    def _arrow(self, at: int, declared: str, is_default: bool, elements: list) -> int:
        at = self._space(at)
        scope = Scope(declared, at, at, is_default)
        self.scopes.append(scope)
        if self.text[at : at + 1] == "{":
            scope.body = at + 1
            scope.end = self._nested(at + 1, "}", elements, declared)
        elif self.text[at : at + 1] == "(":
            scope.end = self._nested(at + 1, ")", elements, declared)
        elif self.text[at : at + 1] == "<" and self._opens(at):
            element, scope.end = self._element(at, [])
            elements.append(element)
        else:
            scope.end = at
        return scope.end

    # -- elements ------------------------------------------------------------

    def _opens(self, at: int) -> bool:
        return re.compile(r"<(?:>|[A-Za-z_$](?![\w$]*(?:,|\s+extends\s)))").match(self.text, at) is not None

    def _element(self, at: int, comments: list[str]) -> tuple[Element, int]:
        text, start = self.text, at
        name = re.compile(r"<([\w$.:-]*)").match(text, at)
        at, attributes = self._space(name.end()), []
        while text[at : at + 1] not in (">", "/"):
            if text[at : at + 1] == "{":
                at = self._space(self._code(at + 1, "}", []))
                continue
            own = re.compile(r"[\w$:.-]+").match(text, at)
            if not own:
                self._fail(at, "no attribute")
            first, at, value = at, self._space(own.end()), None
            if text[at : at + 1] == "=":
                at = self._space(at + 1)
                if text[at : at + 1] in ("'", '"') and text[at : at + 1]:
                    end = text.find(text[at], at + 1)
                    if end < 0:
                        self._fail(at, "string without end")
                    value, value_at, at = text[at + 1 : end], at, end + 1
                elif text[at : at + 1] == "{":
                    value_at = at
                    value, at = self._expression(at, own[0])
                else:
                    self._fail(at, "no attribute value")
                attributes.append(Attribute(own[0], value, value_at, at))
            else:
                attributes.append(Attribute(own[0], None, first, own.end()))
            at = self._space(at)
        line = text.count("\n", 0, start) + 1
        if text.startswith("/>", at):
            return Element(name[1], attributes, [], start, at + 2, line, True, comments), at + 2
        if text[at] != ">":
            self._fail(at, "no end of a tag")
        children, at = self._children(at + 1)
        close = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
        if not close or close[1] != name[1]:
            self._fail(at, f"no end of {name[1]}")
        return Element(name[1], attributes, children, start, close.end(), line, False, comments), close.end()

    def _children(self, at: int) -> tuple[list, int]:
        text, children = self.text, []
        while True:
            if at >= len(text):
                self._fail(at, "element without end")
            if text.startswith("</", at):
                return children, at
            if text[at] == "{":
                own, at = self._expression(at, "")
                children.append(own)
            elif text[at] == "<":
                own, at = self._element(at, [])
                children.append(own)
            else:
                end = re.compile(r"[^<{]+").match(text, at).end()
                children.append(Text(text[at:end], at, end))
                at = end

    def _expression(self, at: int, attribute: str) -> tuple[Expr, int]:
        comments: list[str] = []
        first, elements = self._space(at + 1, comments), []
        outer, self._attribute = self._attribute, attribute
        self._names.append("")
        if self.text[first : first + 1] == "{":
            end = self._braces(first, True, elements, "", "(")
            end = self._code(end, "}", elements)
        else:
            end = self._code(at + 1, "}", elements)
        self._names.pop()
        self._attribute = outer
        return Expr(self.text[first : end - 1].rstrip(), at, end, first, comments, elements), end

    # -- questions -----------------------------------------------------------

    def enclosing(self, at: int) -> list[Scope]:
        """The functions around a place, from the outermost in."""
        return sorted((s for s in self.scopes if s.start <= at < s.end), key=lambda s: s.start)

    def loop(self, at: int) -> Loop | None:
        """The map() whose callback is the nearest arrow function around a place."""
        inner = max((p for p in self.loops if p.start < at < p.end), key=lambda p: p.start, default=None)
        if inner and sum(inner.start < s.start <= at < s.end for s in self.scopes) <= 1:
            return inner
        return None

    def in_export(self, at: int) -> bool:
        return any(a <= at < b for a, b in self.exports)
