"""Functions and calls of C, C++ and Java sources, by their braces: the graph blocks of languages without an installed front end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .facts import FACTS

_NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|^[ \t]*#(?:\\\n|[^\n])*", re.S | re.M)
_TYPE = re.compile(r"\b(?:class|struct|interface|enum|record|namespace)\s+(\w+)[^()=;]*$")
_FUNCTION = re.compile(r"((?:\w+::)*~?\w+)\s*\((?:[^()]|\([^()]*\))*\)[^;=(){}]*(?::[^;{}]*)?$")
_CALL = re.compile(r"(?:\b(\w+)\s*(?:\.|->|::)\s*)?\b(\w+)\s*\(")
#: Words before a parenthesis that call nothing.
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "synchronized", "new", "throw", "else", "do", "try", "assert", "defined", "super", "this"}
SUFFIXES = (".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx", ".java")


def functions(text: str) -> list[tuple[str, str | None, int, int, int, int]]:
    """(qualified name, owner, first and last line, body's begin and end) of each function with a body."""
    code = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out: list[tuple[str, str | None, int, int, int, int]] = []
    open_: list[tuple[str | None, str | None, int, int]] = []  # kind, name, header's begin, body's begin
    begin = 0
    for m in re.finditer(r"[{};]", code):
        at, sign = m.start(), m.group()
        if sign == "{":
            header = code[begin:at]
            inside = any(kind == "function" for kind, *_ in open_)
            kind = name = None
            if not inside and (t := _TYPE.search(header)):
                kind, name = "type", t.group(1)
            elif not inside and (f := _FUNCTION.search(header)) and f.group(1) not in _KEYWORDS:
                kind, name = "function", f.group(1).replace("::", ".")
            open_.append((kind, name, begin + len(header) - len(header.lstrip()), at))
        elif sign == "}" and open_:
            kind, name, start, body = open_.pop()
            if kind == "function":
                owners = [n for k, n, *_ in open_ if k == "type"]
                out.append((".".join([*owners, name]), owners[-1] if owners else None, text.count("\n", 0, start) + 1, text.count("\n", 0, at) + 1, body, at))
        begin = at + 1
    return sorted(out, key=lambda f: f[4])


def calls(text: str, begin: int, end: int) -> list[tuple[str, int]]:
    """(name, line) of the calls in a stretch of code; a receiver stays as `x.name`."""
    code = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text[begin:end])
    first = text.count("\n", 0, begin) + 1
    found = [(m, m.group(2)) for m in _CALL.finditer(code) if m.group(2) not in _KEYWORDS]
    return [(f"{m.group(1)}.{name}" if m.group(1) and m.group(1) not in ("this", "return", "new") else name, first + code.count("\n", 0, m.start())) for m, name in found]


def fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, path, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text.replace("\r\n", "\n")
            module = path.rsplit(".", 1)[0].replace("\\", "/").strip("/").replace("/", ".")
            for name, owner, a, _, body, end in functions(text):
                own = f"{module}.{name}"
                out.append((tree, module, "def", module, own, owner, a))
                out += [(tree, module, "call", own, call, owner, line) for call, line in calls(text, body, end)]
        kinds = (pa.string(),) * 6 + (pa.int32(),)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in FACTS.split(", ")])


def facts(files: DataFrame) -> DataFrame:
    """Facts of C, C++ and Java files of (tree_id, file_path, content), in the form `facts.call_edges` resolves."""
    ok = F.lit(False)
    for s in SUFFIXES:
        ok = ok | F.lower("file_path").endswith(s)
    return files.where(ok & F.col("content").isNotNull()).select(F.col("tree_id").cast("string"), "file_path", "content").mapInArrow(fact_rows, FACTS)


def symbol_edges(rows: DataFrame) -> DataFrame:
    """(tree_id, src, dst, edge_kind) of calls by the symbol they name: the definition in the caller's file, else those of any file of the tree.

    A call `a.f` or `C::f` names the function f of that class if there is one; else the caller's own class is tried first. Symbols that very many
    calls name are split over several tasks.
    """
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    defs = rows.where("fact = 'def'").select("tree_id", F.col("module").alias("def_module"), F.col("name").alias("dst"), F.col("target").alias("def_class"), last("name").alias("symbol")).distinct()
    calls = rows.where("fact = 'call'").select("tree_id", "module", F.col("owner").alias("src"), F.col("target").alias("own_class"), F.col("name").alias("call"), last("name").alias("symbol")).distinct()
    met = salted_join(calls, defs, ["tree_id", "symbol"], F.col("src"))
    receiver = F.regexp_extract("call", r"^(.*)\.", 1)
    near = F.when(F.col("def_class") == receiver, 1).when((F.col("module") == F.col("def_module")) & F.col("own_class").eqNullSafe(F.col("def_class")), 2).when(F.col("module") == F.col("def_module"), 3).otherwise(4)
    met = met.withColumn("near", near)
    least = met.groupBy("tree_id", "src", "call").agg(F.min("near").alias("near"))
    return met.join(least, ["tree_id", "src", "call", "near"]).select("tree_id", "src", "dst", F.lit("call").alias("edge_kind")).distinct()


BLOCKS = "tree_id string, file_path string, qualname string, func_name string, start_line int, end_line int, content string"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, path, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text.replace("\r\n", "\n")
            lines = text.split("\n")
            module = path.rsplit(".", 1)[0].replace("\\", "/").strip("/").replace("/", ".")
            out += [(tree, path, f"{module}.{name}", name.rsplit(".", 1)[-1], a, b, "\n".join(lines[a - 1 : b])) for name, _, a, b, _, _ in functions(text)]
        kinds = (pa.string(),) * 4 + (pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def blocks(files: DataFrame) -> DataFrame:
    """The function blocks of C, C++ and Java files, for alignment with graph nodes."""
    ok = F.lit(False)
    for s in SUFFIXES:
        ok = ok | F.lower("file_path").endswith(s)
    return files.where(ok & F.col("content").isNotNull()).select(F.col("tree_id").cast("string"), "file_path", "content").mapInArrow(block_rows, BLOCKS)
