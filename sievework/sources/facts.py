"""Facts of Python sources for call graphs: definitions, imports, calls and bases, one file at a time; and their resolution by joins."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import module_name

FACTS = "tree_id string, module string, fact string, owner string, name string, target string, line int"


class _Visitor(ast.NodeVisitor):
    """Collects (fact, owner, name, target, line). Bodies of with, finally and else are visited like any other."""

    def __init__(self, module: str):
        self.module, self.scope, self.classes, self.rows = module, [module], [], []

    def add(self, fact: str, name: str, target: str | None, line: int) -> None:
        self.rows.append((fact, ".".join(self.scope), name, target, line))

    def visit_def(self, node) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.add("def", ".".join([*self.scope, node.name]), self.classes[-1] if self.classes else None, node.lineno)
        self.scope.append(node.name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_def

    def visit_ClassDef(self, node) -> None:
        own = ".".join([*self.scope, node.name])
        self.add("class", own, None, node.lineno)
        for base in node.bases:
            if name := dotted(base):
                self.add("base", own, name, node.lineno)
        self.scope.append(node.name)
        self.classes.append(own)
        for child in node.body:
            self.visit(child)
        self.classes.pop()
        self.scope.pop()

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], node.lineno)

    def visit_ImportFrom(self, node) -> None:
        parts = self.module.split(".")
        base = ".".join(parts[: max(0, len(parts) - node.level)]) if node.level else ""
        source = ".".join(x for x in (base, node.module) if x)
        for a in node.names:
            self.add("import", a.asname or a.name, f"{source}.{a.name}" if source else a.name, node.lineno)

    def visit_Call(self, node) -> None:
        if name := dotted(node.func):
            self.add("call", name, self.classes[-1] if self.classes else None, node.lineno)
        self.generic_visit(node)


def dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, module, text in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    parsed = ast.parse(text)
                v = _Visitor(module)
                v.visit(parsed)
            except (SyntaxError, ValueError, RecursionError):
                continue
            out += [(tree, module, *r) for r in v.rows]
        kinds = (pa.string(),) * 6 + (pa.int32(),)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in FACTS.split(", ")])


def facts(files: DataFrame) -> DataFrame:
    """Facts of the Python files of (tree_id, file_path, content); files that do not parse give none."""
    py = files.where(F.col("file_path").endswith(".py") & F.col("content").isNotNull())
    return py.select(F.col("tree_id").cast("string"), module_name(F.col("file_path")).alias("module"), "content").mapInArrow(fact_rows, FACTS)


def call_edges(rows: DataFrame) -> DataFrame:
    """(tree_id, src, dst, edge_kind) of the calls whose target is known.

    By turns: a definition of the caller's module, an imported name, a method of the own class or a base through self, the
    only definition of that last name in the tree. A class stands for its __init__ where it has one.
    """
    defs = rows.where("fact IN ('def', 'class')").select("tree_id", F.col("name").alias("dst")).distinct()
    calls = rows.where("fact = 'call'").select("tree_id", "module", F.col("owner").alias("src"), F.col("name").alias("call"), F.col("target").alias("own"))
    calls = calls.withColumn("head", F.substring_index("call", ".", 1)).withColumn("rest", F.expr("substring(call, length(head) + 1)"))
    imports = rows.where("fact = 'import'").groupBy("tree_id", "module", F.col("name").alias("head")).agg(F.min("target").alias("source"))
    bases = rows.where("fact = 'base'").select("tree_id", F.col("name").alias("own"), F.element_at(F.split("target", r"\."), -1).alias("base_last")).distinct()
    classes = rows.where("fact = 'class'").select("tree_id", F.col("name").alias("base"), F.element_at(F.split("name", r"\."), -1).alias("base_last"))
    known = calls.join(imports, ["tree_id", "module", "head"], "left")
    options = [known.withColumn("dst", F.concat_ws(".", "module", "call")).withColumn("tier", F.lit(1)), known.where("source IS NOT NULL").withColumn("dst", F.concat("source", "rest")).withColumn("tier", F.lit(2)), known.where("head = 'self' AND own IS NOT NULL").withColumn("dst", F.concat("own", "rest")).withColumn("tier", F.lit(3))]
    inherited = known.where("head = 'self' AND own IS NOT NULL").join(bases, ["tree_id", "own"]).join(classes, ["tree_id", "base_last"]).withColumn("dst", F.concat("base", "rest")).withColumn("tier", F.lit(4))
    columns = ["tree_id", "src", "call", "dst", "tier"]
    tried = options[0].select(columns)
    for o in (*options[1:], inherited):
        tried = tried.unionByName(o.select(columns))
    found = tried.join(defs, ["tree_id", "dst"], "left_semi")
    unique = defs.withColumn("last", F.element_at(F.split("dst", r"\."), -1)).groupBy("tree_id", "last").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    loose = known.withColumn("last", F.element_at(F.split("call", r"\."), -1)).join(unique, ["tree_id", "last"]).withColumn("tier", F.lit(5)).select(columns)
    best = found.unionByName(loose).groupBy("tree_id", "src", "call").agg(F.min_by("dst", F.struct("tier", "dst")).alias("dst"))
    init = defs.where(F.col("dst").endswith(".__init__")).select("tree_id", F.regexp_replace("dst", r"\.__init__$", "").alias("dst"), F.col("dst").alias("ctor"))
    out = best.join(init, ["tree_id", "dst"], "left")
    return out.select("tree_id", "src", F.coalesce("ctor", "dst").alias("dst"), F.lit("call").alias("edge_kind")).distinct()
