import pytest
from pyspark.sql import functions as F

from sievework.plans import pipeline, run
from sievework.plans.judge import rule_judge
from sievework.sources import braces, builders, sinks
from tests.test_context import made

C_FILES = [("t", "src/a.c", "static int helper(int x) { return x; }\nint caller(void) { return helper(1) + far(2); }\n"), ("t", "src/b.c", "int far(int x) {\n  return x;\n}\nint helper(int y) { return y; }\n"), ("t", "q/M.java", "class M {\n  int value() { return 1; }\n  int caller() { return this.value() + Other.value(); }\n}\nclass Other {\n  static int value() { return 2; }\n}\n")]


def files(spark, rows):
    return spark.createDataFrame(rows, "tree_id string, file_path string, content string")


def test_calls_across_files_by_symbol(spark):
    edges = {(r.src, r.dst) for r in braces.symbol_edges(braces.facts(files(spark, C_FILES))).collect()}
    assert edges == {("src.a.caller", "src.a.helper"), ("src.a.caller", "src.b.far"), ("q.M.M.caller", "q.M.M.value"), ("q.M.M.caller", "q.M.Other.value")}


def test_builders(spark):
    df = files(spark, [*C_FILES, ("t", "p/m.py", "class A:\n    def f(self):\n        return g()\ndef g():\n    pass\n")])
    got = {(r.qualname, r.start_line, r.end_line) for r in builders.builder_of("Python").blocks(df).collect()}
    assert got == {("p.m.A.f", 2, 3), ("p.m.g", 4, 5)}
    assert builders.builder_of("cobol") is builders.NONE and builders.NONE.edges(df).count() == 0 and builders.builder_of(None).blocks(df).count() == 0
    assert ("p.m.A.f", "p.m.g") in {(r.src, r.dst) for r in builders.whole_graph(df).collect()}
    builders.register("cobol", builders.builder_of("c"))
    assert builders.builder_of("COBOL") is builders.builder_of("c")
    del builders._BUILDERS["cobol"]


@pytest.mark.parametrize("with_cache", [False, True])
def test_whole_run(spark, tmp_path, with_cache):
    code, known, targets = made(spark)
    asked = spark.sparkContext.accumulator(0)

    def judge(text):
        asked.add(1)
        return rule_judge(text)

    path = f"file://{tmp_path}/cache" if with_cache else None
    first = {(r.vuln_id, r.tree_id): (r.has_vuln, r.n_shown) for r in run.run(known, targets, code, judge, cache=path).collect()}
    assert first["V", "t"][0] and first["V", "t"][1] >= 3
    if with_cache:
        again = {(r.vuln_id, r.tree_id): (r.has_vuln, r.n_shown) for r in run.run(known, targets, code, judge, cache=path).collect()}
        assert again == first and spark.read.parquet(f"{path}/done").count() == 1
        other = known.withColumn("desc_text", F.lit("other"))
        run.cached(other, code, path, judge)
        assert spark.read.parquet(f"{path}/done").count() == 2


def test_graph_document(spark, tmp_path):
    nodes = spark.createDataFrame([("m", "A"), ("m", "A.f"), ("n", "g")], "module string, node string")
    edges = spark.createDataFrame([("m", "n", "A.f", "g"), ("m", "m", "A", "A.f")], "src_module string, dst_module string, src string, dst string")
    bases = spark.createDataFrame([("m", "A", "B"), ("m", "A", "C")], "module string, node string, base string")
    needs = spark.createDataFrame([("x", ">=1")], "product string, constraint string")
    sinks.fasten_json(nodes, edges, "p", f"file://{tmp_path}/g", bases, needs)
    rows = {r.module: r for r in spark.read.json(f"file://{tmp_path}/g").collect()}
    assert rows["m"].cha[0].bases == ["B", "C"] and rows["n"].depset[0].product == "x" and rows["m"].namespace == ["//p/m/A", "//p/m/A.f"]


def test_references_of_hunks_alone(spark):
    _, known, _ = made(spark)
    assert pipeline.reference_blocks(known).count() == 2
