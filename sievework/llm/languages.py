"""The language of a block, and its source with comments and literals blanked out."""

from __future__ import annotations

import re

#: Spellings of the languages, and file name extensions, that stand for each language.
SPELLINGS = {
    "python": "python", "py": "python", "python3": "python", "python 3": "python",
    "java": "java",
    "c": "c",
    "c++": "c++", "cpp": "c++", "cxx": "c++", "cc": "c++", "cplusplus": "c++",
    "json": "json",
}
EXTENSIONS = {
    "py": "python", "pyi": "python", "java": "java", "c": "c", "h": "c", "cpp": "c++", "cc": "c++", "cxx": "c++",
    "hpp": "c++", "hh": "c++", "hxx": "c++", "json": "json",
}


def language_of(language: str | None, file_path: str | None) -> str | None:
    """python, java, c, c++ or json; None for anything else. An unknown or empty language leaves it to the extension."""
    name = (language or "").strip().lower()
    if name in SPELLINGS:
        return SPELLINGS[name]
    path = (file_path or "").strip().lower()
    return EXTENSIONS.get(path.rsplit(".", 1)[-1]) if "." in path.replace("\\", "/").rsplit("/", 1)[-1] else None


_PYTHON = re.compile(r"#[^\n]*|(?i:\b[rbuf]{1,2})?(?:'''(?:\\.|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)", re.S)
_BRACES = re.compile(
    r"//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z)|^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*|R\"([^\s()\\]{0,16})\(.*?(?:\)\1\"|\Z)"
    r"|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|(?<![0-9A-Za-z_])'(?:\\.|[^'\\\n])*'?",
    re.S | re.M,
)
_INK = re.compile(r"[^\s]")


_DIRECTIVE = re.compile(r"[ \t]*\#[ \t]*(if|ifdef|ifndef|else|elif|elifdef|elifndef|endif)\b")
#: Marks left in blanked sources where a conditional begins, goes on with another branch, and ends.
IF, ELSE, ENDIF = "\x01", "\x02", "\x03"


def blanked(text: str, language: str) -> str:
    """The text with its comments, strings and preprocessor lines turned to spaces; all places stay.

    Of a conditional directive the first place holds its mark.
    """
    if language == "python":
        return _PYTHON.sub(lambda m: _INK.sub(" ", m.group(0)), text)

    def blank(m: re.Match) -> str:
        out = _INK.sub(" ", m.group(0))
        if d := _DIRECTIVE.match(m.group(0)):
            mark = IF if d.group(1).startswith("if") else ENDIF if d.group(1) == "endif" else ELSE
            out = mark + out[1:]
        return out

    return _BRACES.sub(blank, text)
