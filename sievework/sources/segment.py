"""Segmenting source files into blocks: functions, classes, methods, headers, whole files."""

from __future__ import annotations

import ast
import re
import warnings
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER_LINES = 80
BLOCKS = "tree_id string, file_path string, seq int, kind string, name string, start_line int, end_line int, language string, heuristic boolean, content string"
Block = tuple[str, str | None, int, int, str | None, bool]  # kind, name, first and last line, language, heuristic

_HEADER = re.compile(r"^(\s*)(async\s+def|def|class)\s+(\w+)")
_NO_METHOD = re.compile(r"\s*(?:if|for|while|switch|catch|do|else|try|synchronized)\b|.*\bnew\s|\s*[}@/*]")
_METHOD = re.compile(r"([A-Za-z_]\w*)\s*\([^;]*\)[^;=]*\{\s*$")
_CLASS = re.compile(r"\bclass\s+(\w+)")


def python_blocks(text: str, lines: list[str]) -> list[Block]:
    """Functions and classes in breadth-first order, by the parser; by indentation where the file does not parse or defines nothing."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        tree = None
    out: list[Block] = []
    queue = deque([tree] if tree else [])
    while queue:
        node = queue.popleft()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append((type(node).__name__, node.name, node.lineno, min(node.end_lineno or node.lineno, len(lines)), "python", False))
        queue.extend(ast.iter_child_nodes(node))
    if out:
        return out
    for i, line in enumerate(lines):
        if m := _HEADER.match(line):
            indent, end = len(m.group(1)), i + 1
            while end < len(lines) and (not lines[end].strip() or lines[end].lstrip().startswith("#") or len(lines[end]) - len(lines[end].lstrip()) > indent):
                end += 1
            kind = "ClassDef" if m.group(2) == "class" else "AsyncFunctionDef" if m.group(2).startswith("async") else "FunctionDef"
            out.append((kind, m.group(3), i + 1, end, "python", True))
    return out or [("Module", None, 1, len(lines), "python", False)]


def java_blocks(lines: list[str]) -> list[Block]:
    """Methods and constructors by their header lines and balanced braces, after the head of the file if there are any."""
    owner = next((m.group(1) for line in lines if (m := _CLASS.search(line))), None)
    out: list[Block] = []
    for i, line in enumerate(lines):
        if "(" not in line or _NO_METHOD.match(line) or not (m := _METHOD.search(line)):
            continue
        depth, end = 0, i
        for end in range(i, len(lines)):
            depth += lines[end].count("{") - lines[end].count("}")
            if depth <= 0:
                break
        out.append(("ConstructorDeclaration" if m.group(1) == owner else "MethodDeclaration", m.group(1), i + 1, end + 1, "java", True))
    return [("header", None, 1, min(HEADER_LINES, len(lines)), "java", True), *out] if out else []


def segment(path: str, text: str) -> list[Block]:
    """The blocks of a file; a file of another type, or Java without methods, is one block."""
    lines = text.split("\n")
    if path.endswith(".py"):
        return python_blocks(text, lines)
    found = java_blocks(lines) if path.endswith(".java") else []
    return found or [("file", None, 1, len(lines), None, False)]


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            tree, path, text = (c[k].as_py() for c in batch.columns)
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            lines = text.split("\n")
            rows = [(tree, path, seq, kind, name, a, b, lang, rough, "\n".join(lines[a - 1 : b])) for seq, (kind, name, a, b, lang, rough) in enumerate(segment(path, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)


def blocks(files: DataFrame, tree: str = "tree_id", path: str = "file_path", text: str = "content") -> DataFrame:
    """The blocks of each file, in emission order. Rows with a null path or text are skipped. Row by row, no shuffle."""
    known = files.where(F.col(path).isNotNull() & F.col(text).isNotNull())
    return known.select(F.col(tree).cast("string"), F.col(path), F.col(text)).mapInArrow(block_rows, BLOCKS)
