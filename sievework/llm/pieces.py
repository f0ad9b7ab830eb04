"""Cutting oversized texts at natural boundaries.

Every place where a piece may begin has a strength: the start of a member's line, a line after a blank one, a line start, a
space, any character. A sparse table answers which cut is strongest in a window of permissible lengths (the rightmost of
equals); the next piece steps back by the overlap, to the first line start in it where there is one. The natural boundaries of
a text are the cuts of the greatest strength that the same table gives, window by window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import ELSE, ENDIF, IF, blanked, language_of

LIMIT = 4000
OVERLAP = 200
NEVER, ANYWHERE, SPACE, LINE, PARAGRAPH, MEMBER = range(6)

_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+def|def|class)[ \t]+(\w+)", re.M)
_CLASS = re.compile(r"\b(?:class|struct|interface|record)\s+(?:alignas\s*\([^)]*\)\s*)?(\w+)")
_CALL = re.compile(r"(~?\w+|operator\s*[^\s\w(]+)\s*\(")
_ANNOTATION = re.compile(r"@\w+(?:\.\w+)*(?:\s*\([^()]*\))?|\btemplate\s*<[^{};]*?>(?=\s*\w)|__attribute__\s*\(\(.*?\)\)", re.S)
_OUTER = re.compile(r"^\s*(?:inline\s+)?namespace\b[\w\s:]*$|^\s*extern\s*$")
_MARKS = {ord(c): " " for c in (IF, ELSE, ENDIF)}
#: Words before a parenthesis that define nothing.
_NO_NAME = {"if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else", "try", "synchronized", "new", "throw", "noexcept", "decltype", "alignas"}


def _python_members(code: str) -> list[int]:
    """Places of the names of functions and classes directly in the block or in an outermost class of it."""
    found = [(len(m.group(1).expandtabs(8)), code[m.start(1) : m.start(2)].split()[-1] == "class", m.start(2)) for m in _DEF.finditer(code)]
    if not found:
        return []
    stack: list[int] = []
    parents: list[int | None] = []
    for k, (indent, _, _) in enumerate(found):
        while stack and found[stack[-1]][0] >= indent:
            stack.pop()
        parents.append(stack[-1] if stack else None)
        stack.append(k)
    base = min(found[k][0] for k in range(len(found)) if parents[k] is None)
    inner: dict[int, int] = {}
    for k, p in enumerate(parents):
        if p is not None and parents[p] is None and found[p][1]:
            inner[p] = min(inner.get(p, 1 << 30), found[k][0])
    return [at for k, (indent, _, at) in enumerate(found) if (indent == base if (p := parents[k]) is None else p in inner and inner[p] == indent)]


def _named(header: str, begin: int) -> tuple[int, bool] | None:
    """(place of the name, whether a class) that a header before a brace defines."""
    header = _ANNOTATION.sub(lambda m: " " * len(m.group(0)), header)
    if _CLASS.search(header) and "(" not in header.split(":")[0]:
        m = next(_CLASS.finditer(header))
        return (begin + m.start(1), True) if "enum" not in header[: m.start()].split() else None
    m = _CALL.search(header)
    if m is None or m.group(1) in _NO_NAME or "=" in header[: m.start(1)]:
        return None
    return begin + m.start(1), False


def _brace_members(code: str) -> list[int]:
    out: list[int] = []
    level: list[str] = []  # of open braces: class, outer (namespace), inside
    begin = 0
    branches: list[list[str]] = []  # the open braces where each conditional began
    for m in re.finditer(r"[{};\x01\x02\x03]", code):
        at, c = m.start(), m.group(0)
        if c in (IF, ELSE, ENDIF):
            if c == IF:
                branches.append(list(level))
            elif branches:
                level = list(branches[-1]) if c == ELSE else level
                if c == ENDIF:
                    branches.pop()
            continue
        open_here = not any(x == "inside" for x in level) and sum(x == "class" for x in level) <= 1
        if c == "{":
            kind = "inside"
            if open_here:
                header = code[begin:at].translate(_MARKS)
                if _OUTER.match(header) and "class" not in level:
                    kind = "outer"
                elif named := _named(header, begin):
                    out.append(named[0])
                    if named[1] and "class" not in level:
                        kind = "class"
            level.append(kind)
        elif c == "}" and level:
            level.pop()
        begin = at + 1
    return out


def members(text: str, language: str | None) -> list[int]:
    """Places of the names of the members defined in a block; none in markup, configuration and data."""
    if language not in ("python", "java", "c", "c++"):
        return []
    code = blanked(text, language)
    return _python_members(code) if language == "python" else _brace_members(code)


def strengths(text: str, language: str | None) -> np.ndarray:
    """The strength of a cut before each character of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.full(len(codes), ANYWHERE, np.int8)
    if not len(codes):
        return s
    blank = np.isin(codes, (9, 10, 13, 32))
    s[1:][blank[:-1] & ~blank[1:]] = SPACE
    ends = np.flatnonzero(codes == 10)
    starts = ends[ends + 1 < len(codes)] + 1
    s[starts] = LINE
    # a line after an empty one, if it is none itself
    empty = np.zeros(len(codes) + 1, np.bool_)
    lines = np.concatenate(([0], ends + 1))
    ink = np.concatenate(([0], np.cumsum(~blank, dtype=np.int32)))
    stop = np.append(ends, len(codes))
    empty[lines] = ink[stop] == ink[np.minimum(lines, len(codes))]
    after = lines[1:][empty[lines[:-1]] & ~empty[lines[1:]]]
    s[after[after < len(codes)]] = PARAGRAPH
    for at in members(text, language):
        s[text.rfind("\n", 0, at) + 1] = MEMBER
    s[1:][(codes[1:] == 10) & (codes[:-1] == 13)] = NEVER
    s[0] = MEMBER
    return s


class RangeMaximum:
    """Sparse table: the place of the greatest value of any window up to a length, the rightmost of equals.

    It is built by blocks as windows ask for them, and only the last block is held, so its size does not grow with the text.
    """

    def __init__(self, values: np.ndarray, longest: int):
        self.values, self.longest = values, min(longest, len(values))
        self.block = max(4 * longest, 1 << 14)
        self.at, self.levels = -1, []

    def _build(self, at: int) -> None:
        self.at, begin = at, at * self.block
        v = self.values[begin : begin + self.block + self.longest]
        levels, width = [np.arange(len(v), dtype=np.int32)], 1
        while 2 * width <= min(self.longest, len(v)):
            a, b = levels[-1][:-width], levels[-1][width:]
            levels.append(np.where(v[b] >= v[a], b, a))
            width *= 2
        self.levels = levels

    def best(self, begin: int, end: int) -> int:
        """Over begin <= place < end, of at most `longest` places."""
        if begin // self.block != self.at:
            self._build(begin // self.block)
        k, base = (end - begin).bit_length() - 1, self.at * self.block
        a, b = int(self.levels[k][begin - base]) + base, int(self.levels[k][end - (1 << k) - base]) + base
        return b if self.values[b] >= self.values[a] else a

    def natural(self, strength: int = MEMBER) -> list[int]:
        """The places of all cuts of the greatest strength there is: in each window the strongest, then the strongest before it."""
        out: list[int] = []
        for begin in range(0, len(self.values), self.longest or 1):
            end, own = min(begin + self.longest, len(self.values)), []
            while end > begin and self.values[at := self.best(begin, end)] >= strength:
                own.append(at)
                end = at
            out += own[::-1]
        return out


def cut(text: str, language: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of pieces of at most `limit` characters that cover the text, neighbours overlapping by up to `overlap`."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    s = strengths(text, language)
    table = RangeMaximum(s, limit)
    lines = np.flatnonzero(s >= LINE)
    pieces, begin = [], 0
    while n - begin > limit:
        low = begin + max(overlap + 1, limit // 2)
        end = table.best(min(low, begin + limit), begin + limit + 1)
        pieces.append((begin, end))
        k = int(np.searchsorted(lines, end - overlap))
        begin = int(lines[k]) if overlap and k < len(lines) and lines[k] <= end else end - overlap
        if begin and s[begin] == NEVER:
            begin += 1
    pieces.append((begin, n))
    return pieces


def _blocks(batch: pa.RecordBatch):
    for key, path, language, start, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
        yield key, language_of(language, path), start, text


def found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, numbers = [], []
        for key, language, start, text in _blocks(batch):
            places = RangeMaximum(strengths(text, language), LIMIT).natural()
            ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
            lines = np.unique(np.searchsorted(ends, places)) + (start if start is not None else 1)
            keys += [key] * len(lines)
            numbers += lines.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32())], names=["block_key", "line_no"])


def piece_rows(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = ("block_key", "piece_no", "begin_char", "end_char", "start_line", "end_line", "content")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        rows = []
        for key, language, start, text in _blocks(batch):
            first = start if start is not None else 1
            for k, (a, b) in enumerate(cut(text, language, limit, overlap)):
                line = first + text.count("\n", 0, a)
                rows.append((key, k, a, b, line, line + text.count("\n", a, max(a, b - 1)), text[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))


def oversized(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(block_key, file_path, language, start_line, content) of the blocks above the limit; deliveries count once downstream."""
    return blocks.where(F.length("content") > limit).select(F.col("block_key").cast("long"), "file_path", "language", "start_line", "content")


def boundaries(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(block_key, line_no): every file line at which a piece of an oversized block may naturally begin. Distinct.

    Null, empty and small contents give nothing; a null start_line counts as 1.
    """
    return oversized(blocks, limit).mapInArrow(found_rows, "block_key long, line_no int").distinct()


def pieces(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized block, numbered, with character offsets and file lines. Distinct."""
    schema = "block_key long, piece_no int, begin_char long, end_char long, start_line int, end_line int, content string"
    return oversized(blocks, limit).mapInArrow(lambda b: piece_rows(b, limit, overlap), schema).dropDuplicates(["block_key", "piece_no"])
