"""Source files that do not parse: token streams of whole files through table-driven parsers of bundled grammars."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammars
from .languages import language_of
from .python_rules import first_broken

LANGUAGES = ("python", "java", "c", "c++", "json")

#: The languages' keywords by token class; a keyword without a class is a token of its own.
_PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_JAVA_WORDS = {w: w for w in "assert break case catch class continue default do else enum extends finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while true false null".split()}
_JAVA_WORDS |= dict.fromkeys("public private protected abstract final native transient volatile strictfp".split(), "MODIFIER") | dict.fromkeys("boolean byte char short int long float double".split(), "PRIMITIVE")
_JAVA_WORDS |= dict.fromkeys(("goto", "const"), "ERROR")
_C_WORDS = {w: w for w in "break case continue default do else enum extern for goto if return sizeof struct switch typedef union while typeof _Static_assert".split()}
_C_WORDS |= dict.fromkeys("void char short int long float double signed unsigned _Bool _Complex __int128".split(), "TYPE")
_C_WORDS |= dict.fromkeys("const volatile restrict static register inline auto _Noreturn _Thread_local _Atomic __inline __inline__ __restrict __restrict__ __volatile__ __extension__ __const".split(), "QUALIFIER")
_C_WORDS |= {"__attribute__": "ATTRIBUTE", "__declspec": "ATTRIBUTE", "_Alignas": "ATTRIBUTE", "asm": "ASM", "__asm__": "ASM", "__asm": "ASM", "__typeof__": "typeof", "_Alignof": "sizeof", "static_assert": "_Static_assert"}
_CPP_WORDS = {w: w for w in "break case catch class continue co_await decltype default delete do else enum explicit extern false for friend goto if inline namespace new noexcept nullptr operator requires return sizeof static_assert struct switch template this throw true try typedef typename union using virtual while auto mutable constexpr".split()}
_CPP_WORDS |= dict.fromkeys("void char short int long float double signed unsigned bool wchar_t char8_t char16_t char32_t __int128".split(), "TYPE")
_CPP_WORDS |= dict.fromkeys("const volatile static register thread_local consteval constinit __restrict __restrict__ __inline __inline__ __volatile__ __extension__".split(), "QUALIFIER")
_CPP_WORDS |= dict.fromkeys("public private protected".split(), "ACCESS") | dict.fromkeys("static_cast dynamic_cast const_cast reinterpret_cast".split(), "CAST")
_CPP_WORDS |= {"__attribute__": "ATTRIBUTE", "__declspec": "ATTRIBUTE", "alignas": "ATTRIBUTE", "asm": "ASM", "__asm__": "ASM", "alignof": "sizeof", "typeid": "sizeof", "co_return": "return", "co_yield": "throw"}
_CPP_WORDS |= dict.fromkeys("and or xor bitand bitor and_eq or_eq xor_eq not_eq".split(), "BINARY") | {"not": "PREFIX", "compl": "~"}
#: Preprocessor directives.
_DIRECTIVES = {"include", "include_next", "define", "undef", "if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif", "pragma", "error", "warning", "line", "ident", "import", "embed", ""}

_C_BINARY = {"/", "%", "|", "^", "||", "==", "!=", "<=", ">=", "<<", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "<=>", "->*", ".*"}
_JAVA_OCTAL = re.compile(r"0[0-9_]*[89][0-9_]*[lL]?\Z")
_JAVA_BINARY = (_C_BINARY - {"<=>", "->*", ".*"}) | {"&&", ">>>=", ">>="}

_NUMBER_C = r"(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]{0,4}|_\w+)(?![\w])"
_C = re.compile(
    rf"([ \t\f\v\r\n]+|\\\r?\n|//(?:\\\r?\n|[^\n])*|/\*.*?\*/)|(#(?:\\\r?\n|/\*.*?\*/|(?!//)[^\n])*)|([A-Za-z_$]\w*)|({_NUMBER_C})"
    r"|((?:u8|[uUL])?R\"([^\s()\\]{0,16})\(.*?\)\6\"|(?:u8|[uUL])?\"(?:\\(?:\r?\n|.)|[^\"\\\n])*\")|((?:u8|[uUL])?'(?:\\.|[^'\\\n])+')"
    r"|(\.\.\.|<<=|>>=|<=>|->\*|->|\+\+|--|&&|\|\||<<|[<>=!+\-*/%&|^]=|::|\.\*|[{}()\[\];,.<>=!~?:+\-*/%&|^])|(.)",
    re.S,
)
_STRING_PREFIX = re.compile(r"(?:u8|[uUL])?R?[\"']")
_JAVA = re.compile(
    r"([ \t\f\r\n\x1a]+|//[^\n]*|/\*.*?\*/)|(@interface\b)|([^\W\d]\w*|\$\w*)|((?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.(?![A-Za-z_]{2})[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w))"
    r"|(\"\"\"[ \t\f]*\r?\n(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\")|('(?:\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.)|[^'\\\n])')"
    r"|(\.\.\.|>>>=|<<=|>>=|->|::|\+\+|--|&&|\|\||<<|[<>=!+\-*/%&|^]=|[{}()\[\];,.<>=!~?:+\-*/%&|^@])|(.)",
    re.S,
)
_PYTHON = re.compile(
    r"([ \t\f]+|\\\r?\n|#[^\r\n]*)|(\r?\n|\r)|((?i:br|rb|b|r|u|f|fr|rf)?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\(?:\r\n|.)|[^\"\\\r\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*'))"
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))|([^\W\d]\w*)"
    r"|(\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|[<>=!+\-*/%&|^@]=|[{}()\[\];,.<>=~:+\-*/%&|^@])|(.)",
    re.S,
)
_PYTHON_OPERATORS = dict.fromkeys(("==", "!=", "<=", ">="), "COMPARE") | dict.fromkeys(("//", "%", "&", "^", "<<", ">>"), "OPERATOR") | dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=", "**=", "//=", ">>=", "<<="), "AUGMENT")
_JSON = re.compile(r"([ \t\r\n]+)|(\"(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})|[^\"\\\x00-\x1f])*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)\b|([{}\[\],:])|(.)", re.S)
_SOFT = re.compile(r"(match|case|type)[ \t]+(?:[^\W\d]|[\"'\d({\[*\-]|\.\.\.)")

Tokens = tuple[list[str], list[int]]


def json_tokens(text: str) -> Tokens:
    kinds, places = [], []
    for m in _JSON.finditer(text):
        k = m.lastindex
        if k != 1:
            kinds.append("STR" if k == 2 else "NUM" if k == 3 else "ERROR" if k == 6 else m.group())
            places.append(m.start())
    return kinds, places


_PYTHON_STRING = re.compile(r"(?i:br|rb|b|r|u)?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\(?:\r\n|.)|[^\"\\\r\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*')", re.S)
_FORMATTED = re.compile(r"(?i:fr|rf|f)(\"\"\"|'''|\"|')")


def formatted_end(text: str, at: int, found: list[tuple[int, int]] | None = None) -> int | None:
    """The end of the f-string that begins at a place; its fields may hold strings with the same quotes. None if it has no end.

    found gets the begin and end of the expression of each field.
    """
    m = _FORMATTED.match(text, at)
    quote, i = m.group(1), m.end()
    fields: list[tuple[int, bool]] = []  # of open fields: brackets open in the expression; whether in the format part
    begins: list[int] = []
    while i < len(text):
        c = text[i]
        if not fields or fields[-1][1]:
            if text.startswith(quote, i):
                return i + len(quote) if not fields else None
            if c == "\\":
                i += 2
            elif c == "{":
                if not fields and text.startswith("{{", i):
                    i += 2
                else:
                    fields.append((0, False))
                    begins.append(i + 1)
                    i += 1
            elif c == "}" and fields:
                fields.pop()
                begins.pop()
                i += 1
            elif c in "\r\n" and len(quote) == 1:
                return None
            else:
                i += 1
            continue
        depth = fields[-1][0]
        if _FORMATTED.match(text, i):
            end = formatted_end(text, i)
            if end is None:
                return None
            i = end
            continue
        if (c in "\"'" or c.isalpha()) and (s := _PYTHON_STRING.match(text, i)):
            i = s.end()
            continue
        if c in "\"'":
            return None
        if c in "([{":
            fields[-1] = (depth + 1, False)
        elif c in ")]}" and depth:
            fields[-1] = (depth - 1, False)
        elif c == "}":
            fields.pop()
            if found is not None:
                found.append((begins[-1], i))
            begins.pop()
        elif c == ":" and not depth:
            fields[-1] = (0, True)
            if found is not None:
                found.append((begins[-1], i))
        elif c == "#":
            stop = text.find("\n", i)
            i = stop if stop >= 0 else len(text)
        if c.isalnum() or c == "_":
            i = _WORD_END.match(text, i).end()
        else:
            i += 1
    return None


_WORD_END = re.compile(r"\w+")


def fields_of(text: str, at: int) -> list[str]:
    """The expressions in the fields of the f-string at a place."""
    found: list[tuple[int, int]] = []
    formatted_end(text, at, found)
    return [text[a:b] for a, b in found]


@lru_cache(65536)
def is_expression(text: str) -> bool:
    """Whether a text is an expression, as the field of an f-string."""
    own = f"({text}\n)\n"
    kinds, places = python_tokens(own)
    return parser("python").error([*kinds, grammars.END]) is None and first_broken(kinds, places, own, is_expression, fields_of) is None


def python_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    words = dict.fromkeys(_PYTHON_WORDS)
    indents = [(0, 0)]
    depth, fresh = 0, True  # open brackets; whether the line has no token yet
    line = 1 if text.startswith("﻿") else 0
    place, size, match = line, len(text), _PYTHON.match
    while place < size:
        m = match(text, place)
        k, at, place = m.lastindex, m.start(), m.end()
        if k == 1:
            continue
        if k == 2:
            if not depth and not fresh:
                kinds.append("NEWLINE")
                places.append(at)
                fresh = True
            line = m.end() if not depth else line
            continue
        if fresh:
            fresh = False
            lead = text[line:at]
            lead = lead[lead.rfind("\f") + 1 :]
            if "\\" in lead or "\n" in lead:
                lead = re.match(r"[ \t]*", lead).group()
            column, narrow = len(lead.expandtabs(8)), len(lead.replace("\t", " "))
            if column == indents[-1][0]:
                if narrow != indents[-1][1]:
                    kinds.append("ERROR")
                    places.append(at)
            elif column > indents[-1][0]:
                kinds.append("INDENT" if narrow > indents[-1][1] else "ERROR")
                places.append(at)
                indents.append((column, narrow))
            else:
                while column < indents[-1][0]:
                    indents.pop()
                    kinds.append("DEDENT")
                    places.append(at)
                if (column, narrow) != indents[-1]:
                    kinds.append("ERROR")
                    places.append(at)
            if k == 5 and (s := _SOFT.match(text, at)) and not re.compile(r"(?:in|is|and|or|not|if|else)\b").match(text, s.end() - 1):
                stop = text.find("\n", at)
                head = text[at : stop if stop >= 0 else None].split("#")[0].rstrip()
                if s.group(1) == "type" and "=" in head or s.group(1) != "type" and head[-1:] in (":", "(", "[", "{", ",") or s.group(1) == "case" and ":" in head:
                    kinds.append(s.group(1).upper())
                    places.append(at)
                    continue
        word = m.group()
        if k == 3 or k == 5 and text[place : place + 1] in ("'", '"'):
            kind = "STR" if k == 3 else "ERROR"
            if word[0] in "fFrR" and _FORMATTED.match(text, at):
                end = formatted_end(text, at)
                place, kind = (place, "ERROR") if end is None else (end, "STR")
        elif k == 4:
            kind = "NUM"
        elif k == 5:
            kind = word if word in words else "NAME"
        elif k == 6:
            kind = _PYTHON_OPERATORS.get(word, word)
            if word in "([{":
                depth += 1
            elif word in ")]}":
                depth = max(0, depth - 1)
        elif ("_" + word).isidentifier():
            # a letter's mark, which goes on with a name or begins one
            if kinds and kinds[-1] == "NAME" and re.compile(r"\w").match(text, at - 1):
                continue
            kind = "NAME"
        else:
            kind = "ERROR"
        kinds.append(kind)
        places.append(at)
    if depth:
        return kinds, places
    if not fresh:
        kinds.append("NEWLINE")
        places.append(len(text))
    kinds += ["DEDENT"] * (len(indents) - 1)
    places += [len(text)] * (len(indents) - 1)
    return kinds, places


def java_tokens(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    words = _JAVA_WORDS
    for m in _JAVA.finditer(text):
        k = m.lastindex
        if k == 1:
            continue
        word = m.group()
        if k == 3:
            kind = words.get(word, "NAME")
        elif k == 7:
            kind = "BINARY" if word in _JAVA_BINARY else "PREFIX" if word in "!~" else word
        else:
            kind = ("@interface", "", "NUM", "STR", "CHAR")[k - 2] if k < 8 else "ERROR"
            if kind == "NUM" and _JAVA_OCTAL.match(word):
                kind = "ERROR"
        if kind == "MODIFIER" and kinds and kinds[-1] == kind and text.startswith(word, places[-1]) and not text[places[-1] + len(word)].isalnum():
            kind = "ERROR"
        kinds.append(kind)
        places.append(m.start())
    _java_contextual(text, kinds, places)
    for i in range(len(kinds) - 2):
        if kinds[i] == "NAME" == kinds[i + 1] and kinds[i + 2] in ("(", "<") and text.startswith("record", places[i]) and (not i or kinds[i - 1] in ("MODIFIER", "static", "{", "}", ";", ")")):
            if text[places[i] : places[i] + 7].strip() == "record" and text[places[i + 1]].isupper():
                kinds[i] = "record"
    return kinds, places


def _java_contextual(text: str, kinds: list[str], places: list[int]) -> None:
    """Words that are keywords in some places only: sealed, non-sealed, permits, module; and record patterns, which become names."""
    word = lambda i, w: 0 <= i < len(kinds) and kinds[i] == "NAME" and text.startswith(w, places[i]) and not text[places[i] + len(w) : places[i] + len(w) + 1].isalnum()
    types = ("class", "interface", "MODIFIER", "static")
    head = False
    i = 0
    while i < len(kinds):
        kind = kinds[i]
        if kind in ("class", "interface"):
            head = True
        elif kind in ("{", ";"):
            head = False
        elif kind == "NAME":
            if head and word(i, "permits") and kinds[i - 1] in ("NAME", ">") and kinds[i + 1 : i + 2] == ["NAME"]:
                kinds[i] = "permits"
            elif word(i, "sealed") and i + 1 < len(kinds) and kinds[i + 1] in types:
                kinds[i] = "MODIFIER"
                if i > 1 and kinds[i - 1] == "-" and word(i - 2, "non"):
                    del kinds[i - 2 : i], places[i - 2 : i]
                    i -= 2
            elif word(i, "module") and kinds[i + 1 : i + 2] == ["NAME"] and (i == 0 or kinds[i - 1] == ";" or word(i - 1, "open")) and not head and "{" not in kinds[:i]:
                kinds[i] = "module"
                if i and word(i - 1, "open"):
                    del kinds[i - 1], places[i - 1]
                    i -= 1
            elif i and kinds[i + 1 : i + 2] == ["("] and (kinds[i - 1] in ("case", "instanceof") or kinds[i - 1] == "." and "case" in kinds[max(0, i - 6) : i]):
                end = _record_pattern(kinds, i + 1)
                if end:
                    # the pattern becomes a type and a name
                    named = kinds[end : end + 1] == ["NAME"] and not word(end, "when")
                    kinds[i + 1 : end], places[i + 1 : end] = [] if named else ["NAME"], [] if named else [places[i + 1]]
        i += 1


def _record_pattern(kinds: list[str], at: int) -> int:
    """The end of the list of patterns whose bracket opens at a token; 0 if it is none."""
    i, some = at + 1, False
    while i < len(kinds):
        start = i
        while i < len(kinds) and kinds[i] in ("NAME", "PRIMITIVE", ".", "[", "]", "<", ">", "final", "?", "MODIFIER"):
            i += 1
        if i < len(kinds) and kinds[i] == "(" and i > start:
            i = _record_pattern(kinds, i)
            if not i:
                return 0
            some = True
            i += kinds[i : i + 1] == ["NAME"]
        elif i - start >= 2 and kinds[i - 1] == "NAME":
            some = True
        elif not (i == start and kinds[start] == ")"):
            return 0
        if kinds[i : i + 1] == [")"]:
            return i + 1 if some else 0
        if kinds[i : i + 1] != [","]:
            return 0
        i += 1
    return 0


def c_tokens(text: str, words: dict[str, str], plus: bool, last: bool = False) -> Tokens:
    """Tokens of the first branch of each conditional, or of the last; `#if 0` gives way to its other branch. An open conditional is an error."""
    kinds: list[str] = []
    places: list[int] = []
    branches: list[str] = []  # on: this branch counts; done: another one did; off: inside what does not count
    starts: list[int] = []  # how many tokens there were where each conditional began
    for m in _C.finditer(text):
        k = m.lastindex
        if k == 1:
            continue
        at = m.start()
        if k == 2:
            if text[text.rfind("\n", 0, at) + 1 : at].strip(" \t/*"):
                k = 9
            else:
                d = re.compile(r"#[ \t]*(\w*)[ \t]*(.{0,3})", re.S).match(m.group())
                name = d.group(1)
                counts = not branches or branches[-1] == "on"
                if name in ("if", "ifdef", "ifndef"):
                    starts.append(len(kinds))
                    branches.append("off" if not counts else "next" if name == "if" and d.group(2).strip() == "0" else "on")
                    continue
                if name in ("else", "elif", "elifdef", "elifndef") and branches:
                    if last and branches[-1] == "on":
                        del kinds[starts[-1] :], places[starts[-1] :]
                        continue
                    branches[-1] = {"on": "done", "next": "on"}.get(branches[-1], branches[-1])
                    continue
                if name == "endif" and branches:
                    branches.pop()
                    starts.pop()
                    continue
                if not counts:
                    continue
                if name in _DIRECTIVES and name not in ("else", "elif", "endif"):
                    continue
                k = 9
        if branches and branches[-1] != "on":
            continue
        word = m.group()
        if k == 3:
            kind = words.get(word, "NAME")
            if plus and word in ("final", "override") and kinds and (kinds[-1] in (")", "QUALIFIER", "noexcept", "override", "final") or kinds[-2:-1] and kinds[-2] in ("class", "struct")):
                kind = word
        elif k == 8:
            kind = "BINARY" if word in _C_BINARY else "PREFIX" if word == "!" else word
            if word == "::" and (not plus or "ASM" in kinds[-40:] and ";" not in kinds[len(kinds) - kinds[::-1].index("ASM") :]):
                # two colons, as between the operands of an assembler statement
                kinds.append(":")
                places.append(at)
                kind = ":"
        else:
            kind = {4: "NUM", 5: "STR", 6: "STR", 7: "CHAR"}.get(k, "ERROR")
        if kind == "TYPE" and kinds and kinds[-1] == kind and word != "long" and text.startswith(word, places[-1]) and not text[places[-1] + len(word) : places[-1] + len(word) + 1].isalnum():
            kind = "ERROR"
        kinds.append(kind)
        places.append(at)
    _macro_calls(text, kinds, places)
    if branches:
        kinds.append("ERROR")
        places.append(len(text))
    return kinds, places


_MACRO = re.compile(r"[A-Z][A-Z0-9_]{2,}\b|\w*(?:for_?each|FOREACH)\w*\b")
_STARTS = {"NAME", "TYPE", "QUALIFIER", "struct", "union", "enum", "typedef", "extern", "class", "template", "namespace", "using", "inline", "constexpr", "auto", "}", "if", "for", "while", "do", "switch", "return", "END"}


def _macro_calls(text: str, kinds: list[str], places: list[int]) -> None:
    """Calls of macros that stand as statements or declarations without a semicolon: those before a block become loops, the others go.

    Such a macro is written in capitals, or named after for each; what follows it begins on another line.
    """
    i = 0
    while i + 2 < len(kinds):
        if kinds[i] == "NAME" and kinds[i + 1] == "(" and (not i or kinds[i - 1] in (";", "{", "}")) and _MACRO.match(text, places[i]):
            depth, end = 0, i + 1
            while end < len(kinds):
                depth += (kinds[end] == "(") - (kinds[end] == ")")
                end += 1
                if not depth:
                    break
            if depth or end >= len(kinds):
                return
            if kinds[end] == "{" and "for" in text[places[i] : places[i + 1]].lower() and "{" in kinds[:i]:
                kinds[i], places[i] = "while", places[i]
                kinds[i + 2 : end - 1], places[i + 2 : end - 1] = ["NUM"], [places[i + 2]]
            elif kinds[end] in _STARTS and "\n" in text[places[end - 1] : places[end]]:
                del kinds[i:end], places[i:end]
                continue
        i += 1


_PARSERS: dict[str, grammars.Parser] = {}


def parser(language: str) -> grammars.Parser:
    """The parser of a language; its table is built once in each process."""
    if language not in _PARSERS:
        text = {"json": grammars.JSON, "python": grammars.PYTHON, "java": grammars.JAVA, "c": grammars.C, "c++": grammars.CPP}[language]
        _PARSERS[language] = grammars.Parser(text, frozenset({")", "QUALIFIER", "override", "final", "noexcept", "&", "&&"}))
    return _PARSERS[language]


def tokens(text: str, language: str, last: bool = False) -> Tokens:
    if language == "json":
        return json_tokens(text)
    if language == "python":
        return python_tokens(text)
    if language == "java":
        return java_tokens(text)
    return c_tokens(text, _CPP_WORDS if language == "c++" else _C_WORDS, language == "c++", last)


def first_error(text: str, language: str) -> int | None:
    """The line, from 1, of the first token that the language's grammar admits no file with; None for valid files.

    A C or C++ file must be valid both with the first and with the last branch of each of its conditionals. Empty and blank
    texts are valid except in JSON. In Python the rules that no such table can hold are checked on the tokens it derives.
    """
    kinds, places = tokens(text, language)
    at = parser(language).error([*kinds, grammars.END])
    if at is None and language in ("c", "c++") and re.search(r"^[ \t]*#[ \t]*el", text, re.M):
        kinds, places = tokens(text, language, True)
        at = parser(language).error([*kinds, grammars.END])
    if at is None and language == "python":
        at = first_broken(kinds, places, text, is_expression, fields_of)
    if at is None:
        return None
    place = places[at] if at < len(places) else len(text)
    return text.count("\n", 0, place) + 1


def error_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
    names = ["block_key", "tree_id", "language", "error_line"]
    for batch in batches:
        out = []
        for key, tree, path, language, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            own = language_of(language, path)
            if own in LANGUAGES:
                out.append((key, tree, own, first_error(text, own)))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)


def checked(blocks: DataFrame) -> DataFrame:
    """(block_key, tree_id, language, error_line): every whole file in one of the languages; error_line is null for valid ones.

    Rows of other kinds and file types and null contents are no files to check. Distinct.
    """
    files = blocks.where((F.col("kind") == "file") & F.col("content").isNotNull() & F.col("block_key").isNotNull())
    files = files.select(F.col("block_key").cast("long").alias("block_key"), "tree_id", "file_path", "language", "content")
    return files.mapInArrow(error_rows, "block_key long, tree_id string, language string, error_line int").distinct()


def invalid_files(blocks: DataFrame) -> DataFrame:
    return checked(blocks).where("error_line IS NOT NULL").select("block_key").distinct()


def rates(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate); files of unknown trees have a null repo."""
    repos = trees.select("tree_id", "repo").dropDuplicates(["tree_id"])
    by = checked(blocks).join(repos, "tree_id", "left").groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("error_line").alias("n_invalid"))
    return by.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
