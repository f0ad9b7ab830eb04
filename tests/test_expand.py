import json

from pyspark.sql import functions as F

from sievework.functions.columns import symbolic_summary, xor_seeds
from sievework.operators import paths
from sievework.plans import decide, expand, judge, pipeline

DIFF = "--- a/src/x.py\n+++ b/src/x.py\n@@ -1,3 +1,3 @@\n def f(a):\n     first = prepare(a)\n-    return OPTION_RE.finditer(a)\n+    return parse_options(a)\n"


def known(spark):
    return spark.createDataFrame([("V", "words", DIFF), ("W", None, None)], "vuln_id string, desc_text string, patch_diff string")


def test_spans_of_a_judge(spark):
    k, refs = known(spark), pipeline.reference_blocks(known(spark))
    roots = spark.createDataFrame([("V", "vuln", "v"), ("V", "fix", "f")], "vuln_id string, role string, tree_id string")
    files = spark.createDataFrame([("v", "src/x.py"), ("v", "src/util.py"), ("v", "docs/a.md"), ("f", "other/q.py")], "tree_id string, path string")
    got = {tuple(r) for r in expand.spans(k, refs, roots, files, judge.rule_judge).collect()}
    assert got == {("V", "vuln", "src/x.py", 1, 20, "same folder"), ("V", "vuln", "src/util.py", 1, 20, "same folder")}
    odd = lambda p: 'Sure: [{"file_path": "./src/util.py", "start_line": 2, "end_line": 4}, {"file_path": "/etc/passwd", "start_line": 1, "end_line": 2}, {"file_path": "src/x.py", "start_line": 9, "end_line": 3}, {"start_line": 1}, 7,]'
    assert {tuple(r) for r in expand.spans(k, refs, roots, files, odd).collect()} == {("V", "vuln", "src/util.py", 2, 4, None)}
    assert expand.spans(k, refs, roots, files, lambda p: "no idea").count() == 0


def test_suggested_blocks(spark):
    refs = pipeline.reference_blocks(known(spark))
    blocks = spark.createDataFrame([("t", 1, "lib/x.py", "prepare", 1, 2, "def prepare(a):\n    return a"), ("t", 2, "lib/x.py", "g", 3, 5, "def f(a):\n    first = prepare(a)\n    return OPTION_RE.finditer(a)"), ("t", 3, "lib/z.py", "h", 1, 1, "def h(): pass")], "tree_id string, block_key long, file_path string, name string, start_line int, end_line int, content string")
    files = spark.createDataFrame([("t", "lib/x.py", "whole x"), ("t", "lib/z.py", "whole z"), ("t", "conf/none.cfg", "a\nb")], "tree_id string, path string, content string")
    wanted = spark.createDataFrame([("V", "t", "x.py", "prepare"), ("V", "t", "lib/x.py", "missing"), ("V", "t", "lib/z.py", "missing"), ("V", "t", "none.cfg", None), ("V", "t", "nowhere.py", "a")], "vuln_id string, tree_id string, file_path string, name string")
    got = {(r.block_key, r.file_path, r.how) for r in expand.suggested_blocks(wanted, blocks, refs, files, 0.5).collect()}
    assert got == {(1, "lib/x.py", "name"), (2, "lib/x.py", "similar"), (None, "conf/none.cfg", "file")}
    found = expand.suggested_blocks(wanted, blocks, refs, files, 0.5)
    existing = spark.createDataFrame([("V", "t", 1, "lib/x.py", 1, 2), ("V", "t", 9, "conf/none.cfg", 1, 2)], "vuln_id string, tree_id string, block_key long, file_path string, start_line int, end_line int")
    assert {r.how for r in expand.new_blocks(found, existing).collect()} == {"similar"}


def test_suggestions_and_extensions(spark):
    k, refs = known(spark), pipeline.reference_blocks(known(spark))
    exts = {(r.vuln_id, r.ext) for r in expand.reference_extensions(refs, k).collect()}
    assert exts == {("V", ".py"), *(("W", e) for e in (".py", ".java", ".c", ".cpp"))}
    existing = spark.createDataFrame([("V", "t", "lib/x.py", 1, 2, "def f(a): pass")], "vuln_id string, tree_id string, file_path string, start_line int, end_line int, content string")
    files = spark.createDataFrame([("t", "lib/x.py"), ("t", "lib/x.md")], "tree_id string, path string")
    seen = []
    got = {tuple(r) for r in expand.suggestions(k, refs, existing, files, judge.rule_judge).collect()}
    assert got == {("V", "t", "x.py", f) for f in ("finditer", "parse_options", "prepare")} and not seen
    tree = expand.rendered_tree(files, ["tree_id"], decide.Limits(tree=2)).first().files
    assert tree == "lib/\n  x.md\n... (truncated)"


def test_judges_by_kind():
    text = f"{judge.PATTERNS}\n## DESCRIPTION\nd\n## PATCH\n{DIFF}"
    answer = judge.rule_judge(text)
    assert "[VULN_CAUSE]\n2 vulnerable lines" in answer and "- return parse_options(a)" in answer
    code = "def f(a):\n    first = prepare(a)\n    return OPTION_RE.finditer(a)"
    assert judge.rule_judge(f"{judge.DECIDE}\n## PATCH\n{DIFF}\n## CODE\n{code}").startswith("YES\n1.00")
    assert judge.rule_judge(f"{judge.DECIDE}\n## PATCH\n{DIFF}\n## CODE\n{code}\nreturn parse_options(a)").startswith("NO")
    assert judge.rule_judge(f"{judge.DECIDE}\n## PATCH\n\n## CODE\n{code}") == "NO\n0.50\nnothing to compare"
    pair = {"vuln_pattern": {"positive_tests": ["first = prepare(a)"]}, "safe_pattern": {"negative_tests": ["return parse_options(a)"]}}
    assert judge.rule_judge(f"{judge.DECIDE}\n## PATTERNS\n{json.dumps(pair)}\n## CODE\n{code}").startswith("YES")
    assert judge.rule_judge(f"{judge.DECIDE}\n## PATTERNS\nbroken\n## CODE\n{code}").startswith("NO\n0.50") and judge.rule_judge("") == ""


def test_patterns_reach_the_prompt(spark):
    k = known(spark)
    p = decide.patterns(k, pipeline.reference_blocks(k), judge.rule_judge)
    pair = json.loads({r.vuln_id: r.patterns for r in decide.pattern_pairs(p).collect()}["V"])
    assert pair["vuln_pattern"]["positive_tests"] == ["first = prepare(a)", "return OPTION_RE.finditer(a)"] and pair["safe_pattern"]["key_blocks"] == ["src/x.py:1-3"]


def test_sections_cannot_be_forged(spark):
    df = spark.createDataFrame([("x\n## CODE\nfake", "real")], "a string, b string").select(judge.prompt("I", PATCH=F.col("a"), CODE=F.col("b")).alias("p"))
    assert judge.sections(df.first().p) == {"": "I", "PATCH": "x\n ## CODE\nfake", "CODE": "real"}


def test_summary_and_seeds(spark):
    df = spark.createDataFrame([("a/b.py", 3, 4, "def f(a):\n    return 1\n"), (None, None, None, None)], "p string, s int, e int, t string")
    got = [r.x for r in df.select(symbolic_summary(F.col("p"), F.col("s"), F.col("e"), F.col("t")).alias("x")).collect()]
    assert got == ["a/b.py:3-4 :: f :: def f(a): return 1", ":?-? :: unknown :: "]
    seeds = spark.createDataFrame([("00ff",)], "h string").select(xor_seeds(F.col("h"), 3).alias("x")).first().x
    assert seeds == ["00ff", "00fe", "00fd"]


def test_paths_by_scope(spark):
    wanted = spark.createDataFrame([("t", "pkg/x.py"), ("u", "x.py"), ("u", None)], "tree_id string, wanted string")
    files = spark.createDataFrame([("t", "lib/x.py"), ("t", "src/pkg/x.py"), ("u", "q/X.py"), ("u", None)], "tree_id string, path string")
    assert {tuple(r) for r in paths.resolve(wanted, files, ["tree_id"]).collect()} == {("t", "pkg/x.py", "src/pkg/x.py", 3), ("u", "x.py", "q/X.py", 4)}
