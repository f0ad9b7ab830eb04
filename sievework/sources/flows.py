"""Where values of Python sources flow: one file at a time into a table of flows; then points-to sets by joins to a fixed point.

Objects are functions and classes (their dotted names), instances (`i:` and the class) and modules (`m:` and the name). Places
are variables (`v:scope.name`, instance attributes `v:class.name`, elements of containers `v:scope.name[]`), returns (`r:function`)
and expressions (`scope|text`). Flow-insensitive: both branches of a condition and all turns of a loop count, and so do the
bodies of with, finally and else. Containers are one element each, whatever the index.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import module_name
from .facts import call_edges
from .tables import materialize

FLOWS = "tree_id string, kind string, a string, b string, c string"
ROUNDS = 12


class _Flow(ast.NodeVisitor):
    """Collects (kind, a, b, c)."""

    def __init__(self, module: str):
        self.scope, self.owner, self.rows = module, [], [("module", module, None, None)]
        self.kinds = [("module", module)]  # of the open scopes

    def add(self, kind: str, a: str | None, b: str | None = None, c: str | None = None) -> None:
        self.rows.append((kind, a, b, c))

    # expressions: each gives the places its value may come from

    def places(self, node) -> list[str]:
        if isinstance(node, ast.Name):
            place = f"{self.scope}|{node.id}"
            self.add("name", self.scope, node.id, place)
            return [place]
        if isinstance(node, ast.Attribute):
            return [self.step("attr", base, node.attr, f"{base}.{node.attr}") for base in self.places(node.value)]
        if isinstance(node, ast.Subscript):
            self.visit(node.slice)
            return [self.step("item", base, None, f"{base}[]") for base in self.places(node.value)]
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, (ast.Await, ast.YieldFrom, ast.Starred)):
            return self.places(node.value)
        if isinstance(node, ast.NamedExpr):
            found = self.places(node.value)
            self.bind(node.target, found)
            return found
        if isinstance(node, ast.IfExp):
            self.visit(node.test)
            return self.places(node.body) + self.places(node.orelse)
        if isinstance(node, ast.BoolOp):
            return [p for v in node.values for p in self.places(v)]
        if isinstance(node, ast.Lambda):
            own = f"{self.scope}.<lambda{node.lineno}_{node.col_offset}>"
            self.add("def", own, "function", None)
            self.function(own, node.args, [ast.Return(node.body)], False)
            self.add("object", f"{self.scope}|{own}", own)
            return [f"{self.scope}|{own}"]
        if isinstance(node, (ast.List, ast.Tuple, ast.Set, ast.Dict, ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            box = f"{self.scope}|<box{node.lineno}_{node.col_offset}>"
            for generator in getattr(node, "generators", ()):
                self.visit(generator)
            inner = [node.value] if isinstance(node, ast.DictComp) else [node.elt] if hasattr(node, "elt") else node.values if isinstance(node, ast.Dict) else node.elts
            for e in inner:
                for p in self.places(e):
                    self.add("copy", p, None, f"{box}[]")
            self.add("box", box, None, None)
            return [box]
        self.generic_visit(node)
        return []

    def step(self, kind: str, base: str, name: str | None, place: str) -> str:
        self.add(kind, base, name, place)
        return place

    def call(self, node) -> list[str]:
        given = [(str(k), v) for k, v in enumerate(node.args) if not isinstance(v, ast.Starred)] + [(k.arg, k.value) for k in node.keywords if k.arg]
        values = [(at, self.places(v)) for at, v in given]
        for v in [*[v for v in node.args if isinstance(v, ast.Starred)], *[k.value for k in node.keywords if not k.arg]]:
            self.places(v)
        out = []
        for callee in self.places(node.func):
            self.add("site", self.scope, ast.unparse(node.func)[:200] if len(callee) < 2000 else None, callee)
            for at, places in values:
                for p in places:
                    self.add("arg", callee, at, p)
            out.append(self.step("call", callee, None, f"{callee}()"))
        return out

    def bind(self, target, places: list[str]) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for e in target.elts:
                self.bind(e, [self.step("item", p, None, f"{p}[]") for p in places])
        elif isinstance(target, ast.Starred):
            self.bind(target.value, places)
        elif isinstance(target, ast.Name):
            for p in places:
                self.add("assign", self.scope, target.id, p)
        elif isinstance(target, ast.Attribute):
            for base in self.places(target.value):
                for p in places:
                    self.add("store", base, target.attr, p)
        elif isinstance(target, ast.Subscript):
            self.visit(target.slice)
            for base in self.places(target.value):
                for p in places:
                    self.add("fill", base, None, p)

    # statements

    def function(self, own: str, args, body, method: bool) -> None:
        before, self.scope = self.scope, own
        self.kinds.append(("function", own))
        positional = [*args.posonlyargs, *args.args]
        for k, p in enumerate(positional):
            self.add("param", own, str(k - method) if k >= method else "self", p.arg)
            self.add("param", own, p.arg, p.arg)
        for p in args.kwonlyargs:
            self.add("param", own, p.arg, p.arg)
        outer = self.scope
        for p, d in [*zip(positional[len(positional) - len(args.defaults) :], args.defaults), *[(p, d) for p, d in zip(args.kwonlyargs, args.kw_defaults) if d is not None]]:
            self.scope = before
            found = self.places(d)
            self.scope = outer
            for place in found:
                self.add("assign", own, p.arg, place)
        for s in body:
            self.visit(s)
        self.kinds.pop()
        self.scope = before

    def visit_def(self, node) -> None:
        own, in_class = f"{self.scope}.{node.name}", self.kinds[-1][0] == "class"
        static = False
        for d in node.decorator_list:
            # what a decorator returns may stand for the function
            static = static or isinstance(d, ast.Name) and d.id == "staticmethod"
            for place in self.places(d):
                self.add("site", self.scope, None, place)
                self.add("arg", place, "0", f"{self.scope}|{own}")
                self.add("call", place, None, f"{place}()")
                self.add("assign", self.scope, node.name, f"{place}()")
        self.add("def", own, "function", self.kinds[-1][1] if in_class and not static else None)
        self.add("object", f"{self.scope}|{own}", own)
        self.add("assign", self.scope, node.name, f"{self.scope}|{own}")
        self.function(own, node.args, node.body, in_class and not static)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_def

    def visit_ClassDef(self, node) -> None:
        own = f"{self.scope}.{node.name}"
        for d in node.decorator_list:
            self.places(d)
        for base in node.bases:
            for p in self.places(base):
                self.add("base", own, None, p)
        for k in node.keywords:
            self.places(k.value)
        self.add("def", own, "class", None)
        self.add("object", f"{self.scope}|{own}", own)
        self.add("assign", self.scope, node.name, f"{self.scope}|{own}")
        before, self.scope = self.scope, own
        self.kinds.append(("class", own))
        for s in node.body:
            self.visit(s)
        self.kinds.pop()
        self.scope = before

    def visit_Import(self, node) -> None:
        for a in node.names:
            name = a.asname or a.name.split(".")[0]
            self.add("import", self.scope, name, a.name if a.asname else name)

    def visit_ImportFrom(self, node) -> None:
        parts = self.kinds[0][1].split(".")
        source = ".".join(x for x in ([*parts[: max(0, len(parts) - node.level)]] if node.level else []) + ([node.module] if node.module else []))
        for a in node.names:
            if a.name == "*":
                self.add("star", self.scope, source)
            else:
                self.add("import", self.scope, a.asname or a.name, f"{source}.{a.name}" if source else a.name)

    def visit_Assign(self, node) -> None:
        found = self.places(node.value)
        for t in node.targets:
            self.bind(t, found)

    def visit_AnnAssign(self, node) -> None:
        if node.value is not None:
            self.bind(node.target, self.places(node.value))

    def visit_Return(self, node) -> None:
        if node.value is not None:
            for p in self.places(node.value):
                self.add("return", self.scope, None, p)

    def visit_Yield(self, node) -> None:
        if node.value is not None:
            for p in self.places(node.value):
                self.add("copy", p, None, f"r:{self.scope}[]")

    def visit_For(self, node) -> None:
        found = []
        for p in self.places(node.iter):
            for name in ("__iter__", "__next__"):
                self.add("attr", p, name, f"{p}.{name}")
                self.add("site", self.scope, None, f"{p}.{name}")
            self.add("call", f"{p}.__next__", None, f"{p}.__next__()")
            found += [self.step("item", p, None, f"{p}[]"), f"{p}.__next__()"]
        self.bind(node.target, found)
        for s in (*node.body, *node.orelse):
            self.visit(s)

    visit_AsyncFor = visit_For

    def visit_comprehension(self, node) -> None:
        self.bind(node.target, [self.step("item", p, None, f"{p}[]") for p in self.places(node.iter)])
        for c in node.ifs:
            self.visit(c)

    def visit_With(self, node) -> None:
        for item in node.items:
            found = []
            for p in self.places(item.context_expr):
                for name in ("__enter__", "__exit__"):
                    self.add("attr", p, name, f"{p}.{name}")
                    self.add("site", self.scope, None, f"{p}.{name}")
                found.append(self.step("call", f"{p}.__enter__", None, f"{p}.__enter__()"))
            if item.optional_vars is not None:
                self.bind(item.optional_vars, found)
        for s in node.body:
            self.visit(s)

    visit_AsyncWith = visit_With

    def visit(self, node):
        if isinstance(node, ast.expr) and not isinstance(node, ast.Yield):
            self.places(node)
            return None
        return super().visit(node)


def flow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, module, text in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    v = _Flow(module)
                    for s in ast.parse(text).body:
                        v.visit(s)
            except (SyntaxError, ValueError, RecursionError):
                continue
            out += [(tree, *r) for r in dict.fromkeys(v.rows)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(5)], names=[c.split()[0] for c in FLOWS.split(", ")])


def flows(files: DataFrame) -> DataFrame:
    """The flows of the Python files of (tree_id, file_path, content); files that do not parse give none."""
    py = files.where(F.col("file_path").endswith(".py") & F.col("content").isNotNull())
    return py.select(F.col("tree_id").cast("string"), module_name(F.col("file_path")).alias("module"), "content").mapInArrow(flow_rows, FLOWS)


def _var(scope: str, name: str) -> Column:
    return F.concat(F.lit("v:"), F.col(scope), F.lit("."), F.col(name))


def points_to(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tree_id, place, object): what each place may be, from the flows of whole trees. Written.

    Every round follows all flows by one step from the new pairs and the known ones, joined within a tree; it ends when a
    round adds none, or after `rounds`.
    """
    rows = materialize(rows, "flows")
    kind = lambda k, **names: rows.where(F.col("kind") == k).select("tree_id", *[F.col(c).alias(n) for c, n in names.items()]).distinct()
    pair = lambda df, place, obj: df.select("tree_id", F.col(place).alias("place") if isinstance(place, str) else place.alias("place"), F.col(obj).alias("object") if isinstance(obj, str) else obj.alias("object"))
    edge = lambda df, source, target: df.select("tree_id", source.alias("source"), target.alias("place"))
    defs = kind("def", a="own", b="what", c="cls")
    modules = kind("module", a="module")
    params = kind("param", a="own", b="at", c="name")
    imports = kind("import", a="scope", b="name", c="target").unionByName(kind("star", a="scope", b="source").join(kind("assign", a="source", b="name", c="value").select("tree_id", "source", "name").distinct(), ["tree_id", "source"]).select("tree_id", "scope", "name", F.concat("source", F.lit("."), "name").alias("target")))
    # names by the nearest scope that binds them; a class's scope is seen from itself only
    assigned = kind("assign", a="scope", b="name", c="value")
    binding = assigned.select("tree_id", "scope", "name").unionByName(params.select("tree_id", F.col("own").alias("scope"), "name")).unionByName(imports.select("tree_id", "scope", "name")).distinct()
    binding = binding.join(defs.where("what = 'class'").select("tree_id", F.col("own").alias("scope"), F.lit(True).alias("in_class")), ["tree_id", "scope"], "left")
    names = kind("name", a="at", b="name", c="place")
    parts = F.split("at", r"\.")
    chain = names.withColumn("scope", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    seen = chain.join(binding, ["tree_id", "scope", "name"]).where(F.col("in_class").isNull() | (F.col("scope") == F.col("at")))
    seen = seen.groupBy("tree_id", "place", "name").agg(F.max_by("scope", F.length("scope")).alias("scope"))
    looked_up = edge(seen, _var("scope", "name"), F.col("place"))
    # what imports name: a module, or a variable of one (definitions are variables too)
    found = imports.join(modules.select("tree_id", F.col("module").alias("target")), ["tree_id", "target"], "left_semi")
    base = [pair(kind("object", a="place", b="object"), "place", "object"), pair(found, _var("scope", "name"), F.concat(F.lit("m:"), F.col("target"))), pair(kind("box", a="box"), "box", F.concat(F.lit("b:"), F.col("box")))]
    base.append(pair(params.where("at = 'self'").join(defs.where("cls IS NOT NULL"), ["tree_id", "own"]), _var("own", "name"), F.concat(F.lit("i:"), F.col("cls"))))
    copies = [looked_up, edge(assigned, F.col("value"), _var("scope", "name")), edge(imports, F.concat(F.lit("v:"), F.col("target")), _var("scope", "name")), edge(kind("copy", a="source", c="place"), F.col("source"), F.col("place")), edge(kind("return", a="own", c="value"), F.col("value"), F.concat(F.lit("r:"), F.col("own")))]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    static = materialize(union(copies).distinct(), "copies")
    known = materialize(union(base).distinct(), "points")
    attrs, items, calls = kind("attr", a="base", b="name", c="place"), kind("item", a="base", c="place"), kind("call", a="base", c="place")
    stores, fills, args, bases = kind("store", a="base", b="name", c="value"), kind("fill", a="base", c="value"), kind("arg", a="base", b="at", c="value"), kind("base", a="own", c="place")
    functions, cls = defs.where("what = 'function'").select("tree_id", F.col("own").alias("object")), defs.where("what = 'class'").select("tree_id", F.col("own").alias("object"))
    for _ in range(rounds):
        at = known.withColumnRenamed("place", "base")
        # the classes whose members an object has: its own and those it inherits from
        parents = bases.join(known, ["tree_id", "place"]).select("tree_id", "own", F.col("object").alias("up")).distinct()
        grand = parents.join(parents.select("tree_id", F.col("up").alias("mid"), F.col("own").alias("own2")).select("tree_id", F.col("own2").alias("up"), F.col("mid").alias("top")), ["tree_id", "up"]).select("tree_id", "own", F.col("top").alias("up"))
        lines = parents.unionByName(grand).distinct()
        owner = F.regexp_replace("object", "^[im]:", "")
        through = at.where("object NOT LIKE 'b:%'").withColumn("own", owner)
        through = through.select("tree_id", "base", "own").unionByName(through.join(lines, ["tree_id", "own"]).select("tree_id", "base", F.col("up").alias("own"))).distinct()
        dynamic = [
            edge(attrs.join(through, ["tree_id", "base"]), _var("own", "name"), F.col("place")),
            edge(stores.join(through, ["tree_id", "base"]), F.col("value"), _var("own", "name")),
            edge(items.join(at.where("object LIKE 'b:%'"), ["tree_id", "base"]), F.concat(F.expr("substring(object, 3)"), F.lit("[]")), F.col("place")),
            edge(fills.join(at.where("object LIKE 'b:%'"), ["tree_id", "base"]), F.col("value"), F.concat(F.expr("substring(object, 3)"), F.lit("[]"))),
            edge(calls.join(at, ["tree_id", "base"]).join(functions, ["tree_id", "object"]), F.concat(F.lit("r:"), F.col("object")), F.col("place")),
        ]
        called = at.join(functions, ["tree_id", "object"], "left_semi").select("tree_id", "base", F.col("object").alias("own"))
        made = at.join(cls, ["tree_id", "object"], "left_semi")
        inits = made.select("tree_id", "base", F.col("object").alias("own")).unionByName(made.withColumnRenamed("object", "own").join(lines, ["tree_id", "own"]).select("tree_id", "base", F.col("up").alias("own")))
        called = called.unionByName(inits.select("tree_id", "base", F.concat("own", F.lit(".__init__")).alias("own"))).distinct()
        dynamic.append(edge(args.join(called, ["tree_id", "base"]).join(params, ["tree_id", "own", "at"]), F.col("value"), _var("own", "name")))
        flowing = static.unionByName(union(dynamic).distinct())
        step = known.withColumnRenamed("place", "source").join(flowing, ["tree_id", "source"]).select("tree_id", "place", "object")
        instances = pair(calls.join(made, ["tree_id", "base"]), "place", F.concat(F.lit("i:"), F.col("object")))
        new = materialize(step.unionByName(instances).distinct().join(known, ["tree_id", "place", "object"], "left_anti"), "new")
        if new.isEmpty():
            break
        known = materialize(known.unionByName(new), "points")
    return known


def resolved_edges(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(tree_id, src, dst, edge_kind) of the Python files of trees: `call` where names alone tell the target, `points_to` where only
    the flow of values does. A class stands for its __init__, its own or an inherited one, where there is one; an instance for its __call__."""
    from .facts import facts

    rows = materialize(flows(files) if rows is None else rows, "flows")
    known = points_to(rows)
    sites = rows.where("kind = 'site'").select("tree_id", F.col("a").alias("src"), F.col("c").alias("place")).distinct()
    defs = rows.where("kind = 'def'").select("tree_id", F.col("a").alias("dst"), F.col("b").alias("what"))
    met = sites.join(known, ["tree_id", "place"]).select("tree_id", "src", "object")
    bases = rows.where("kind = 'base'").select("tree_id", F.col("a").alias("own"), F.col("c").alias("place")).join(known, ["tree_id", "place"]).select("tree_id", "own", F.col("object").alias("up")).distinct()
    method = lambda df, name: df.unionByName(df.join(bases, ["tree_id", "own"]).select("tree_id", "src", "root", F.col("up").alias("own"))).select("tree_id", "src", "root", F.concat("own", F.lit(f".{name}")).alias("dst")).join(defs.select("tree_id", "dst"), ["tree_id", "dst"], "left_semi")
    direct = met.withColumnRenamed("object", "dst").join(defs, ["tree_id", "dst"])
    classes = direct.where("what = 'class'").select("tree_id", "src", F.col("dst").alias("root"), F.col("dst").alias("own"))
    inits = method(classes, "__init__").groupBy("tree_id", "src", "root").agg(F.max_by("dst", F.col("dst").startswith(F.concat("root", F.lit(".")))).alias("dst"))
    plain = classes.join(inits, ["tree_id", "src", "root"], "left_anti").select("tree_id", "src", F.col("root").alias("dst"))
    own = F.expr("substring(object, 3)")
    dunder = method(met.where("object LIKE 'i:%'").select("tree_id", "src", own.alias("root"), own.alias("own")), "__call__")
    flow = direct.where("what = 'function'").select("tree_id", "src", "dst").unionByName(inits.select("tree_id", "src", "dst")).unionByName(plain).unionByName(dunder.select("tree_id", "src", "dst")).distinct()
    named = call_edges(facts(files)).select("tree_id", "src", "dst")
    both = named.withColumn("edge_kind", F.lit("call")).unionByName(flow.join(named, ["tree_id", "src", "dst"], "left_anti").withColumn("edge_kind", F.lit("points_to")))
    return both.distinct()
