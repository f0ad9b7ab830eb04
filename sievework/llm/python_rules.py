"""Rules of Python's syntax beyond an LL(1) table, over the tokens of a file that the table derives.

What may stand left of an assignment, the order of arguments and parameters, displays that mix sets and mappings, literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_OPEN = {"(": ")", "[": "]", "{": "}"}
_HEADS = {"if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "async", "MATCH", "CASE"}
_PLAIN = {"pass", "break", "continue", "return", "raise", "assert", "global", "nonlocal", "import", "from", "TYPE"}
#: Tokens that no primary expression has outside its brackets.
_OPERATORS = {"or", "and", "not", "in", "is", "if", "else", "for", "lambda", "await", "yield", "COMPARE", "OPERATOR", "<", ">", "*", "**", "-", "+", "~", "|", "/", "@", ":=", ","}
_ENDS = {"NAME", "STR", ")", "]", "}"}
_OCTAL = re.compile(r"0[0_]*[1-9][\d_]*\Z")
_PREFIX = re.compile(r"[A-Za-z]{0,2}(?=[\"'])")
_CONVERSION = re.compile(r"!\s*[rsa]\s*\Z")
_DEBUG = re.compile(r"(?<![=!<>])=\s*\Z")


class _Broken(Exception):
    """Raised with the place of the first token that breaks a rule."""


class Rules:
    """The rules over one file's tokens. parse tells whether a field of a formatted string is an expression."""

    def __init__(self, kinds: list[str], places: list[int], text: str, parse: Callable[[str], bool], fields: Callable[[str, int], list[str]]):
        self.kinds, self.places, self.text, self.parse, self.fields = kinds, places, text, parse, fields
        self.match: dict[int, int] = {}
        self.heads: set[int] = set()  # brackets of parameters and bases
        stack: list[int] = []
        for k, kind in enumerate(kinds):
            if kind in _OPEN:
                stack.append(k)
            elif kind in (")", "]", "}") and stack:
                self.match[stack.pop()] = k

    def need(self, ok: bool, at: int) -> None:
        if not ok:
            raise _Broken(at)

    def flat(self, a: int, b: int) -> Iterator[int]:
        """The tokens of a stretch outside its brackets, the opening ones included; the heads of lambdas are left out."""
        waiting, k = 0, a
        while k < b:
            kind = self.kinds[k]
            if kind == "lambda":
                waiting += 1
                yield k
            elif waiting and kind == ":":
                waiting -= 1
            elif not waiting:
                yield k
            k = self.match[k] if kind in _OPEN and k in self.match else k
            k += 1

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """The stretches between commas; an empty one at the end stands for a trailing comma."""
        cuts, targets = [], False  # a comma between the targets of a comprehension parts nothing
        for k in self.flat(a, b):
            kind = self.kinds[k]
            targets = kind == "for" or targets and kind != "in"
            if kind == "," and not targets:
                cuts.append(k)
        return list(zip([a, *(c + 1 for c in cuts)], [*cuts, b]))

    def target(self, a: int, b: int, single: bool = False, star: bool = True) -> None:
        """A list of targets of an assignment; single: one name, attribute or subscript."""
        self.need(a < b, min(a, len(self.kinds) - 1))
        parts = self.parts(a, b)
        if len(parts) > 1:
            self.need(not single, a)
            for k, (x, y) in enumerate(parts):
                if x < y or k < len(parts) - 1:
                    self.target(x, y, star=star)
            return
        if self.kinds[a] == "*":
            self.need(star and not single and a + 1 < b, a)
            a += 1
        last, kind = b - 1, self.kinds[b - 1]
        if self.kinds[a] in ("(", "[") and self.match.get(a) == last:
            if not single:
                if a + 1 < last:
                    self.target(a + 1, last, star=star)
            else:
                self.need(self.kinds[a] == "(", a)
                self.target(a + 1, last, single=True)
            return
        for k in self.flat(a, b):
            self.need(self.kinds[k] not in _OPERATORS, k)
        if kind == "NAME":
            self.need(b - a == 1 or self.kinds[last - 1] == ".", a)
        else:
            self.need(kind == "]", a)

    def arguments(self, a: int, b: int, generator: bool = True) -> None:
        parts = self.parts(a, b)
        named = unpacked = False
        for x, y in parts:
            if x >= y:
                continue
            if self.kinds[x] == "**":
                unpacked = True
                continue
            if self.kinds[x] == "*":
                self.need(not unpacked, x)
                continue
            equal = [k for k in self.flat(x, y) if self.kinds[k] == "="]
            if equal:
                self.need(len(equal) == 1 and equal[0] == x + 1 and self.kinds[x] == "NAME" and y > x + 2, x)
                named = True
                continue
            if any(self.kinds[k] == "for" for k in self.flat(x, y)):
                self.need(generator and len(parts) == 1, x)
            self.need(not named and not unpacked, x)

    def parameters(self, a: int, b: int) -> None:
        default = star = slash = bare = False
        parts = [(x, y) for x, y in self.parts(a, b) if x < y]
        for n, (x, y) in enumerate(parts):
            kind = self.kinds[x]
            if kind == "/":
                self.need(n > 0 and not slash and not star, x)
                slash = True
            elif kind == "*":
                self.need(not star, x)
                star, bare = True, y - x == 1
                self.need(not bare or n + 1 < len(parts) and self.kinds[parts[n + 1][0]] == "NAME", x)
            elif kind == "**":
                self.need(n == len(parts) - 1, x)
            else:
                own = any(self.kinds[k] == "=" for k in self.flat(x, y))
                self.need(own or star or not default, x)
                default = default or own

    def statements(self) -> Iterator[tuple[int, int]]:
        """Simple statements and heads of compound ones."""
        start, waiting, k, n = 0, 0, 0, len(self.kinds)
        while k < n:
            kind = self.kinds[k]
            if kind in ("NEWLINE", "INDENT", "DEDENT", ";", "END"):
                if start < k:
                    yield start, k
                start, waiting = k + 1, 0
            elif kind == "lambda":
                waiting += 1
            elif kind == ":":
                if waiting:
                    waiting -= 1
                elif self.kinds[start] in _HEADS:
                    yield start, k
                    start = k + 1
            k = self.match.get(k, k) + 1 if kind in _OPEN else k + 1
        if start < n:
            yield start, n

    def statement(self, a: int, b: int) -> None:
        first = self.kinds[a]
        if first == "async" and a + 1 < b:
            a += 1
            first = self.kinds[a]
        if first in _PLAIN:
            return
        if first == "del":
            self.target(a + 1, b, star=False)
        elif first == "with":
            for k in range(a, b):
                if self.kinds[k] == "as":
                    end = next((m for m in self.flat(k + 1, b) if self.kinds[m] in (",", ")")), b)
                    self.target(k + 1, end)
        elif first == "def":
            k = next(k for k in self.flat(a, b) if self.kinds[k] == "(")
            self.heads.add(k)
            self.parameters(k + 1, self.match[k])
        elif first == "class":
            k = next((k for k in self.flat(a, b) if self.kinds[k] == "("), None)
            if k is not None:
                self.heads.add(k)
                self.arguments(k + 1, self.match[k], generator=False)
        elif first not in _HEADS:
            marks = [k for k in self.flat(a, b) if self.kinds[k] in ("=", "AUGMENT", ":")]
            if marks and self.kinds[marks[0]] in ("AUGMENT", ":"):
                self.target(a, marks[0], single=True)
                return
            for k in marks:
                self.target(a, k)
                a = k + 1

    def literals(self) -> None:
        kinds, text = self.kinds, self.text
        for k, kind in enumerate(kinds):
            at = self.places[k] if k < len(self.places) else len(text)
            if kind == "NUM" and text[at] == "0":
                word = re.compile(r"[\w.]+").match(text, at).group()
                self.need(not _OCTAL.match(word), k)
            elif kind == "STR":
                prefix = _PREFIX.match(text, at).group().lower()
                if "b" in prefix:
                    # a string ends before the next token
                    end = self.places[k + 1] if k + 1 < len(self.places) else len(text)
                    body = re.compile(r"[A-Za-z]{0,2}(\"\"\"|'''|\"|')((?:\\.|(?!\1).)*)\1", re.S).match(text, at, end)
                    self.need(body is None or body.group(2).isascii(), k)
                if k and kinds[k - 1] == "STR":
                    self.need(("b" in prefix) == ("b" in _PREFIX.match(text, self.places[k - 1]).group().lower()), k)
                if "f" in prefix:
                    for field in self.fields(text, at):
                        body = _DEBUG.sub("", _CONVERSION.sub("", field.strip())).strip()
                        self.need(bool(body) and self.parse(body), k)

    def inside(self) -> None:
        """Calls, displays, comprehensions and assignments within expressions."""
        kinds = self.kinds
        for k, kind in enumerate(kinds):
            if kind == "(" and k and kinds[k - 1] in _ENDS and k not in self.heads and k in self.match:
                self.arguments(k + 1, self.match[k])
            elif kind == "{" and k in self.match:
                forms = set()
                for x, y in self.parts(k + 1, self.match[k]):
                    if x < y:
                        forms.add(kinds[x] == "**" or any(kinds[m] == ":" for m in self.flat(x, y)))
                self.need(len(forms) < 2, k)
            elif kind == "lambda":
                end = next((m for m in self._head(k + 1)), None)
                if end is not None:
                    self.parameters(k + 1, end)
            elif kind == ":=":
                self.need(k > 0 and kinds[k - 1] == "NAME" and (k < 2 or kinds[k - 2] not in (".", *_ENDS, "OPERATOR", "COMPARE", "+", "-", "*", "/")), k)
            elif kind == "for":
                end = next((m for m in self.flat(k + 1, len(kinds)) if kinds[m] in ("in", "NEWLINE", "END")), None)
                if end is not None and kinds[end] == "in":
                    self.target(k + 1, end)

    def _head(self, a: int) -> Iterator[int]:
        """The colon of the lambda whose head begins at a token."""
        waiting, k = 1, a
        while k < len(self.kinds):
            kind = self.kinds[k]
            waiting += (kind == "lambda") - (kind == ":")
            if not waiting:
                yield k
                return
            k = self.match.get(k, k) + 1 if kind in _OPEN else k + 1


def first_broken(kinds: list[str], places: list[int], text: str, parse: Callable[[str], bool], fields: Callable[[str, int], list[str]]) -> int | None:
    """The number of a token at which a rule is broken, of the first kind of rule that is; None if all hold."""
    rules = Rules(kinds, places, text, parse, fields)
    try:
        for a, b in rules.statements():
            rules.statement(a, b)
        rules.inside()
        rules.literals()
    except _Broken as broken:
        return broken.args[0]
    return None
