import datetime as dt
import json
import pathlib

from pyspark.sql import functions as F

from sievework.cli import description, main
from sievework.operators import graph, spans
from sievework.plans import decide, judge, pipeline
from sievework.sources import braces, diffs, facts, segment, sinks, trees
from sievework.streaming import scan

DIFF = """diff --git a/src/x.py b/src/x.py
--- a/src/x.py
+++ b/src/x.py
@@ -1,3 +1,3 @@
 def f(a):
-    return OPTION_RE.finditer(a)
+    return parse_options(a)
 # end
@@ -9 +9,0 @@
-gone = True
--- /dev/null
+++ b/new.c
@@ -0,0 +1,2 @@
+int a;
+int b;
"""


def test_diff():
    h = diffs.parse(DIFF)
    assert [x[:8] for x in h] == [(0, 0, "src/x.py", "src/x.py", 1, 3, 1, 3), (0, 1, "src/x.py", "src/x.py", 9, 1, 9, 0), (1, 0, None, "new.c", 0, 0, 1, 2)]
    assert h[0][9] == "def f(a):\n    return parse_options(a)\n# end"
    assert diffs.parse(None) == [] and diffs.parse("no diff") == []


def test_segments(spark):
    py = "class A:\n    def m(self):\n        pass\n\ndef f():\n    pass\n"
    assert [(b[0], b[1], b[2], b[3]) for b in segment.segment("a.py", py)] == [("ClassDef", "A", 1, 3), ("FunctionDef", "f", 5, 6), ("FunctionDef", "m", 2, 3)]
    broken = "def f(:\n    x\n\nclass B\n    y\n"
    assert [(b[0], b[1], b[5]) for b in segment.segment("a.py", "def f(x:\n    x\nasync def g():\n    y\n")] == [("FunctionDef", "f", True), ("AsyncFunctionDef", "g", True)]
    assert segment.segment("a.py", broken)[0][1] == "f"
    assert segment.segment("a.py", "x = 1")[0][0] == "Module" and segment.segment("a.c", "int x;\n")[0][:4] == ("file", None, 1, 2)
    java = "package p;\nclass A {\n  A(int x) {\n  }\n  int m() {\n    if (a) {\n    }\n  }\n}\n"
    assert [(b[0], b[1], b[2], b[3]) for b in segment.segment("A.java", java)] == [("header", None, 1, 10), ("ConstructorDeclaration", "A", 3, 4), ("MethodDeclaration", "m", 5, 8)]
    df = spark.createDataFrame([("t", "a.py", py), ("t", None, "x"), ("t", "b.c", None)], "tree_id string, file_path string, content string")
    assert [r.content for r in segment.blocks(df).orderBy("seq").collect()][1] == "def f():\n    pass"


def test_facts(spark):
    files = [("t", "pkg/a.py", "from pkg.b import helper\nimport pkg.b as q\nclass A(Base):\n    def run(self):\n        self.go()\n        helper()\n        with x:\n            q.other()\n"), ("t", "pkg/b.py", "def helper():\n    pass\ndef other():\n    pass\nclass Base:\n    def __init__(self):\n        pass\n    def go(self):\n        Base()\n"), ("t", "pkg/c.py", "def (")]
    rows = facts.facts(spark.createDataFrame(files, "tree_id string, file_path string, content string"))
    got = {(r.src, r.dst) for r in facts.call_edges(rows).collect()}
    assert got == {("pkg.a.A.run", "pkg.b.Base.go"), ("pkg.a.A.run", "pkg.b.helper"), ("pkg.a.A.run", "pkg.b.other"), ("pkg.b.Base.go", "pkg.b.Base.__init__")}


def test_trees_and_cli(spark, tmp_path, capsys):
    (tmp_path / "t/src").mkdir(parents=True)
    (tmp_path / "t/src/x.py").write_bytes(b"def f(a):\r\n    return OPTION_RE.finditer(a)\n# end \xff\n")
    (tmp_path / "t/B.PY").write_text("no")
    got = trees.files(spark, str(tmp_path / "t")).collect()
    assert [(r.path, r.text) for r in got] == [("src/x.py", "def f(a):\n    return OPTION_RE.finditer(a)\n# end \n")]
    assert trees.packages(trees.files(spark, str(tmp_path / "t"))).first().module == "src.x"
    (tmp_path / "p.diff").write_text(DIFF)
    (tmp_path / "d.md").write_text("words")
    assert description(str(tmp_path / "d.md")) == "words" and description("plain") == "plain"
    main(["--vuln-id", "V1", "--patch", str(tmp_path / "p.diff"), "--desc", "d", "--target-root", str(tmp_path / "t")])
    assert "V1" in capsys.readouterr().out
    lines = spark.createDataFrame([("a>=1",), ("# x",), ("",), ("-r other",)], "l string")
    assert [tuple(r) for r in trees.requirements(lines, F.col("l")).collect()] == [("a", ">=1")]


def test_verify(spark):
    known = spark.createDataFrame([(1, "V", "desc", DIFF)], "knowledge_key long, vuln_id string, desc_text string, patch_diff string")
    bad, good = "def f(a):\n    return OPTION_RE.finditer(a)\n# end", "def f(a):\n    return parse_options(a)\n# end"
    targets = spark.createDataFrame([("bad", 1, "src/x.py", bad), ("good", 2, "lib/y.py", good), ("none", 3, "z.py", "unrelated = 1")], "tree_id string, block_key long, file_path string, content string")
    got = {r.tree_id: r for r in pipeline.verify(known, targets).collect()}
    assert set(got) == {"bad", "good"} and got["bad"].has_vuln and not got["good"].has_vuln
    assert judge.rule_judge("no json") == "" and judge.replay_judge({})("x") == ""


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("anon:1", "a"), ("anon:2", "b")], "cache_key string, v string")
    sinks.cache_write(df, str(tmp_path / "c"))
    assert [r.v for r in sinks.cache_read(spark, str(tmp_path / "c"), "anon:2").collect()] == ["b"]
    assert sinks.cache_read(spark, str(tmp_path / "c"), "anon:3") is None and sinks.cache_read(spark, str(tmp_path / "no"), "x") is None
    edges = spark.createDataFrame([("t", "a", "b")], "tree_id string, src string, dst string")
    sinks.graph_json(graph.adjacency(edges, ["tree_id"]), str(tmp_path / "g"))
    line = next(pathlib.Path(tmp_path / "g").glob("*.json")).read_text()
    assert json.loads(line) == {"src": "a", "dsts": ["b"]}
    nodes = spark.createDataFrame([("m", "f")], "module string, node string")
    calls = spark.createDataFrame([("m", "n", "f", "g")], "src_module string, dst_module string, src string, dst string")
    sinks.fasten_json(nodes, calls, "p", str(tmp_path / "f"))
    assert json.loads(next(pathlib.Path(tmp_path / "f").glob("*.json")).read_text())["namespace"] == ["//p/m/f"]


def test_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "int a = b;", t), (1, "int a = b;", t + dt.timedelta(hours=1)), (2, "other words", t)], "block_key long, content string, ingested_at timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    refs = spark.createDataFrame([("r", "int a = b;")], "id string, content string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = scan.known_blocks(scan.first_deliveries(stream), refs)
    q = out.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.block_key, r.ref_id) for r in spark.sql("select * from found").collect()] == [(1, "r")]


def test_braces(spark):
    java = "package p;\nclass A {\n  A(int x) { init(x); }\n  // void no() {\n  int m() {\n    if (a) { this.n(\"}\"); }\n    return b.k(1);\n  }\n  void n(String s) {}\n}\n"
    assert [(f[0], f[1], f[2], f[3]) for f in braces.functions(java)] == [("A.A", "A", 3, 3), ("A.m", "A", 5, 8), ("A.n", "A", 9, 9)]
    files = [("t", "src/A.java", java), ("t", "x.c", "int twice(int a)\n{\n    return a;\n}\nint go(void) { return twice(twice(1)); }\n"), ("t", "y.c", None), ("t", "z.py", "f()")]
    df = spark.createDataFrame(files, "tree_id string, file_path string, content string")
    got = {(r.src, r.dst) for r in facts.call_edges(braces.facts(df)).collect()}
    assert got == {("src.A.A.m", "src.A.A.n"), ("x.go", "x.twice")}
    assert {(r.func_name, r.start_line, r.end_line) for r in braces.blocks(df).where("file_path = 'x.c'").collect()} == {("twice", 1, 4), ("go", 5, 5)}


def test_crop(spark):
    segments = spark.createDataFrame([("f", 0, 1, 9, "class"), ("f", 1, 3, 6, "method")], "path string, seq int, start_line int, end_line int, content string")
    b = spark.createDataFrame([(1, "f", 4, 5, "x"), (2, "g", 1, 1, "y")], "id int, path string, start_line int, end_line int, content string")
    pick = lambda outer: {(r.id, r.content, r.cropped) for r in spans.crop(b, segments, ["path"], "id", outer).collect()}
    assert pick(False) == {(1, "method", True), (2, "y", False)} and pick(True) == {(1, "class", True), (2, "y", False)}


def test_decide(spark):
    known = spark.createDataFrame([("V", "desc", DIFF)], "vuln_id string, desc_text string, patch_diff string")
    refs = pipeline.reference_blocks(known)
    seen = []

    def answer(prompt):
        return "[VULN_CAUSE] bad regex [POSITIVE_TESTS]\n- a\n- b\n[FIX_DESC]\nparsed"

    p = decide.patterns(known, refs, answer).first()
    assert (p.vuln_cause, p.positive_tests, p.fix_desc, p.fix_ctrlflow, p.negative_tests) == ("bad regex", ["a", "b"], "parsed", "N/A", [])
    assert p.vuln_spans[0].startswith("src/x.py:") and len(p.vuln_spans) <= 3
    c = spark.createDataFrame([("V", "t", k, f"src/f{k}.py", 1, 2, f"body {k}") for k in range(9)], "vuln_id string, tree_id string, block_key long, file_path string, start_line int, end_line int, content string")
    names = spark.createDataFrame([("V", "f7.py")], "vuln_id string, name string")
    ask_two = lambda prompt: '{"important_ids": ["3", "999"]}'
    say = lambda prompt: "YES\n0.9\n" + judge.sections(prompt)["CODE"].split("\n")[0]
    r = decide.decide(known, c, names, ask_two, say).first()
    assert (r.n_shown, r.n_chosen, r.has_vuln, r.confidence, r.reason) == (9, 1, True, 0.9, "[f3.py:1-2]")
    r = decide.decide(known, c, names, lambda prompt: "none", say).first()
    assert (r.n_chosen, r.reason) == (5, "[f7.py:1-2]") and not seen
