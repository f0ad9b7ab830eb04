from sievework.operators import dedup, graph
from sievework.plans import context, pipeline

DIFF = "--- a/src/x.py\n+++ b/src/x.py\n@@ -1,2 +1,2 @@\n def f(a):\n-    return OPTION_RE.finditer(a)\n+    return parse_options(a)\n"
BLOCKS = [
    ("v", 1, "src/x.py", 1, "FunctionDef", "f", "def f(a):\n    return OPTION_RE.finditer(a)"),
    ("v", 2, "src/w.py", 1, "FunctionDef", "caller", "def caller():\n    return f(seven)"),
    ("v", 3, "src/u.py", 1, "FunctionDef", "hub", "def hub(everything):\n    pass"),
    ("t", 4, "lib/x.py", 1, "FunctionDef", "f", "def f(a):\n    return OPTION_RE.finditer(a)"),
    ("t", 5, "lib/y.py", 4, "FunctionDef", "g", "def g(b):\n    x = 1\n    return f(b)"),
    ("t", 6, ".\\lib\\y.py", 5, None, None, "    x = 1"),
    ("t", 7, "lib/z.py", 1, "FunctionDef", "alone", "def alone():\n    pass"),
    ("t", 8, "lib/whole.py", 1, "file", None, "import q\n\n\ndef k():\n    return f(2)\n"),
]
EDGES = [("v", "src.w.caller", "src.x.f"), *[("v", f"n{k}", "src.u.hub") for k in range(5)], ("t", "lib.y.g", "lib.x.f"), ("t", "lib.whole.k", "lib.x.f"), ("t", "lib.x.f", None)]


def made(spark):
    blocks = spark.createDataFrame(BLOCKS, "tree_id string, block_key long, file_path string, start_line int, kind string, name string, content string")
    trees = spark.createDataFrame([("v", "roots/v"), ("t", "roots/t")], "tree_id string, proj_root string")
    code = context.Code(trees, blocks, spark.createDataFrame(EDGES, "tree_id string, src string, dst string"))
    known = spark.createDataFrame([(1, "V", "d", DIFF, "roots/v", None)], "knowledge_key long, vuln_id string, desc_text string, patch_diff string, vuln_proj_root string, fix_proj_root string")
    return code, known, blocks.where("tree_id = 't'").select("tree_id", "block_key", "file_path", "content")


def test_references(spark):
    code, known, _ = made(spark)
    expanded = spark.createDataFrame([("V", "vuln", "lib/whole.py", 1, 1)], "vuln_id string, role string, path string, first int, last int")
    got = {(r.role, r.path, r.start_line, r.end_line) for r in pipeline.reference_blocks(known, code, expanded=expanded).collect()}
    # the hunks of both sides, the caller of f, and hub by its authority; whole.py is not in the vulnerable tree
    assert got == {("vuln", "src/x.py", 1, 2), ("fix", "src/x.py", 1, 2), ("vuln", "src/w.py", 1, 2), ("vuln", "src/u.py", 1, 2)}


def test_candidates(spark):
    code, known, targets = made(spark)
    suggestions = spark.createDataFrame([("V", 6), ("V", 7)], "vuln_id string, block_key long")
    refs = pipeline.reference_blocks(known)
    got = {r.block_key: r.reason for r in pipeline.candidates(refs, targets, code=code).collect()}
    assert got == {4: "similar", 5: "one hop", 8: "one hop"}
    # the suggested line stands for the function around it, which is then there once
    got = {r.block_key: r.reason for r in pipeline.candidates(refs, targets, code=code, suggestions=suggestions).collect()}
    assert got == {4: "similar", 6: "suggested", 7: "suggested", 8: "one hop"}
    wide = {r.block_key: (r.start_line, r.end_line, r.content) for r in context.shown(code.blocks.select("block_key"), code).collect()}
    assert wide[6] == (4, 6, BLOCKS[4][6]) and wide[8] == (1, 5, BLOCKS[7][6]) and len(wide) == len(BLOCKS)
    assert {r.tree_id: r.n_blocks for r in pipeline.verify(known, targets, code=code).collect()}["t"] >= 3


def test_top_blocks(spark):
    scores = spark.createDataFrame([("t", n, a) for n, a in (("no", 0.9), ("a1", 0.8), ("a2", 0.7), ("b", 0.6), ("c", 0.5))], "tree_id string, node string, authority double")
    blocks = spark.createDataFrame([("t", "a1", "A"), ("t", "a2", "A"), ("t", "b", "B"), ("t", "c", "C"), ("t", "no", None)], "tree_id string, node string, block string")
    assert [(r.block, r.node, r["rank"]) for r in graph.top_blocks(scores, blocks, ["tree_id"], 2).orderBy("rank").collect()] == [("A", "a1", 1), ("B", "b", 2)]


def test_fallback_blocks(spark):
    schema = "tree_id string, path string, block_key long"
    parsed = spark.createDataFrame([("t", "a.c", 1), ("t", "a.c", 2)], schema)
    files = spark.createDataFrame([("t", "a.c", 3), ("u", "a.c", 4), ("t", "b.c", 5), ("t", None, 6)], schema)
    assert {r.block_key for r in dedup.with_fallback(parsed, files, ["tree_id", "path"]).collect()} == {1, 2, 4, 5, 6}


def test_decide_takes_each_text_once(spark, monkeypatch):
    from sievework.plans import decide

    code, known, _ = made(spark)
    chosen = spark.createDataFrame([(v, "t", k) for v in ("V", "W", "X") for k in (4, 5, 6, 8)], "vuln_id string, tree_id string, block_key long")
    apart, texts = context.shown_apart(chosen, code)
    # block 6 is shown as the function 5 that holds it
    assert sorted(r.text_key for r in texts.collect()) == [4, 5, 8]
    known = spark.createDataFrame([("V", "d", DIFF), ("W", "d", "+ none"), ("X", None, None)], "vuln_id string, desc_text string, patch_diff string")
    names = spark.createDataFrame([("V", "x.py")], "vuln_id string, name string")
    answer = lambda prompt: f'{{"important_ids": ["{prompt.count("ID=")}"]}}' if "important_ids" in prompt else f"YES\n0.5\n{prompt}"
    whole = {tuple(r) for r in decide.decide(known, context.shown(chosen, code), names, answer, answer).collect()}
    monkeypatch.setattr(decide, "HOT", 2)
    split = {tuple(r) for r in decide.decide(known, apart, names, answer, answer, texts=texts).collect()}
    assert whole == split and {r[:4] for r in split} == {(v, "t", 4, 1) for v in ("V", "W", "X")}
    assert all("def f(a):\n    return OPTION_RE" in r[-1] and "~ " in r[-1] for r in split)
