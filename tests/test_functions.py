import textwrap

import pytest
from pyspark.sql import functions as F

from sievework.functions import columns as c
from sievework.functions.python import salvage, shorten, tolerant_json


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_grams(spark):
    assert one(spark, "a b a", c.grams) == ["a", "b", "a::b", "b::a"]
    assert one(spark, "x", c.grams) == ["x"]
    assert one(spark, "", c.grams) == [] and one(spark, None, c.grams) == []


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r.x, 6) for r in df.select(c.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [0.333333, 0.0]


@pytest.mark.parametrize("path, norm, base, ext, module", [
    ("./a//b/C.py", "a/b/C.py", "C.py", ".py", "a.b.C"), ("src\\x\\__init__.py", "src/x/__init__.py", "__init__.py", ".py", "src.x"),
    ("__init__.py", "__init__.py", "__init__.py", ".py", "module"), ("Makefile", "Makefile", "Makefile", "", "Makefile"),
])
def test_paths(spark, path, norm, base, ext, module):
    row = spark.createDataFrame([(path,)], "p string").select(c.norm_path(F.col("p")).alias("n"), c.basename(F.col("p")).alias("b"), c.extension(F.col("p")).alias("e"), c.module_name(F.col("p")).alias("m")).first()
    assert tuple(row) == (norm, base, ext, module)


def test_strip_diff_prefix(spark):
    assert [one(spark, p, c.strip_diff_prefix) for p in ("a/x.c", "./x.c", ".github/x", "src/a/x")] == ["x.c", "x.c", ".github/x", "src/a/x"]


def test_line_slice(spark):
    text = "1\r\n2\n3\n4"
    pick = lambda a, b: one(spark, text, lambda t: c.line_slice(t, F.lit(a), F.lit(b)))
    assert (pick(2, 3), pick(4, 9), pick(5, 9), pick(3, 2), pick(0, 1)) == ("2\n3", "4", "", "", "1")


@pytest.mark.parametrize("raw, yes, confidence, reason", [
    ("YES\n0.75\nbecause\nof", True, 0.75, "because\nof"), ("no\n\n1\n", False, 1.0, "no\n1"), ("Yes\n85%\nx", True, 0.5, "x"), ("", False, 0.0, ""), (None, False, 0.0, ""),
])
def test_verdict(spark, raw, yes, confidence, reason):
    assert tuple(one(spark, raw, c.verdict)) == (yes, confidence, reason)


def test_sections(spark):
    raw = "[CAUSE] x\ny [FIX]\n- a\n• b\n\n[END]"
    assert one(spark, raw, lambda t: c.tagged(t, "CAUSE")) == "x\ny" and one(spark, raw, lambda t: c.tagged(t, "TESTS")) == "N/A"
    assert one(spark, "- a\n  • b \n\n", c.bullets) == ["a", "b"]


def test_names(spark):
    assert one(spark, "a.<lambda1>.b", c.without_interior) == "a" and one(spark, "<builtin>.x", c.without_interior) is None
    assert one(spark, "a.<if1>.b.<while>", c.without_scopes) == "a.b"
    assert one(spark, "x\n  def run(self):", c.symbol_name) == "run" and one(spark, None, c.symbol_name) == "unknown"
    assert one(spark, "```json\n{\"important_ids\": [\"a\", \"b\",]}\n```", c.important_ids) == ["a", "b"]


def test_common_suffix(spark):
    df = spark.createDataFrame([("a/b.py", "x/B.py"), ("", "x"), ("q", "z")], "a string, b string")
    assert [r.x for r in df.select(c.common_suffix(F.col("a"), F.col("b")).alias("x")).collect()] == [5, 0, 0]


def test_version_range(spark):
    assert tuple(one(spark, "Foo_Bar[x]>=1.2, <2 ; python_version>'3'  # c", c.version_range)) == ("foo-bar", ">=1.2,<2")
    assert tuple(one(spark, "plain", c.version_range)) == ("plain", "*")
    assert one(spark, "# only a comment", c.version_range).product == ""


def test_shorten_and_json(spark):
    text = "some  words\nof a text " * 4
    assert one(spark, text, lambda t: shorten(t, F.lit(20))) == textwrap.shorten(text, 20, placeholder="...")
    assert one(spark, None, lambda t: shorten(t, F.lit(20))) is None
    assert salvage("Sure: [1, 2,] done") == "[1, 2]" and salvage('```\n{"a": 1,}\n```') == '{"a": 1}' and salvage("none") is None
    assert one(spark, "x {\"a\": [1]} y", tolerant_json) == '{"a": [1]}'


def test_cache_key(spark):
    df = spark.createDataFrame([("d", "p"), (None, None)], "d string, p string").select(c.cache_key(F.col("d"), F.col("p")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert all(k.startswith("anon:") and len(k) == 21 for k in keys) and len(set(keys)) == 2
