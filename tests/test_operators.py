import math
import random
import re

from pyspark.sql import functions as F

from sievework.operators import dedup, graph, paths, rank, similarity, spans


def items(text):
    t = re.findall(r"[A-Za-z0-9_]+", text or "")
    return set(t) | {f"{a}::{b}" for a, b in zip(t, t[1:])}


def test_exact_similarity_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(40)]
    texts += [t + " extra" for t in texts[:10]] + [texts[0], "", None, texts[0], texts[3], texts[3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "k long, t string").withColumn("items", F.lit(1)).withColumn("id", F.lit(2))
    for threshold in (0.3, 0.6, 1.0):
        got = {(r.target, r.ref): round(r.similarity, 9) for r in similarity.exact(df, df.where("k % 3 = 0"), "k", "t", threshold).collect()}
        want = {}
        for a, x in rows:
            for b, y in rows:
                s, u = items(x), items(y)
                if a != b and b % 3 == 0 and s and u and len(s & u) / len(s | u) >= threshold:
                    want[a, b] = round(len(s & u) / len(s | u), 9)
        assert got == want
        links = {r.target: (r.n_refs, r.ref, round(r.similarity, 9)) for r in similarity.links(df, lambda k: k % 3 == 0, "k", "t", threshold).collect()}
        best = {}
        for (a, b), v in want.items():
            n, ref, top = best.get(a, (0, None, 0))
            best[a] = (n + 1, *min(((ref, top), (b, v)), key=lambda x: (-x[1], x[0] if x[0] is not None else 1 << 60)))
        assert links == best
    for threshold in (0.6, 0.9):
        found = {(r.target, r.ref) for r in similarity.minhash(df, df.where("k % 3 = 0"), "k", "t", threshold).collect()}
        exact = {(r.target, r.ref) for r in similarity.exact(df, df.where("k % 3 = 0"), "k", "t", threshold).collect()}
        assert found <= exact and len(found) >= 0.99 * len(exact)


def test_similarity_modes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "a b"), (4, None)], "k long, t string")
    assert {(r.id, r.n_group) for r in similarity.shared_min(df, "k", "t").collect()} == {(1, 2), (2, 1), (3, 2)}
    split = similarity.exact(df, df, "k", "t", 0.5)
    assert {(r.target, r.ref) for r in split.collect()} == {(1, 3), (3, 1), (1, 2), (2, 1), (2, 3), (3, 2)}
    assert similarity.as_shipped(df, df, "k").count() == 4 and similarity.as_shipped(df, df.limit(0), "k").count() == 0
    assert similarity.exact(df.limit(0), df, "k", "t").count() == 0


def test_minhash_meets_no_pairs_far_apart(spark, monkeypatch):
    shared = " ".join(f"s{k}" for k in range(20))
    texts = [f"{shared} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (60, texts[0]), (61, f"{texts[3]} more"), (62, None)], "k long, t string")
    met, written, join, write = [], [], similarity.salted_join, similarity.materialize

    def counted(*args, **kw):
        met.append(join(*args, **kw))
        return met[-1]

    def kept(rows, label):
        written.append(write(rows, label))
        return written[-1]

    monkeypatch.setattr(similarity, "salted_join", counted)
    monkeypatch.setattr(similarity, "materialize", kept)
    found = {(r.target, r.ref): r.similarity for r in similarity.minhash(df, df.where("k % 3 = 0 AND k < 60"), "k", "t").collect()}
    assert found == {(60, 0): 1.0, (61, 3): 79 / 81}
    # a third of the items in common, as all texts have here, is no reason to meet
    assert sum(m.select("t_rep", "r_rep").distinct().count() for m in met) == 21
    # nor are the sets of the other targets written
    assert sum(w.selectExpr("sum(size(items)) n").first().n for w in written if "items" in w.columns and "digest" in w.columns) < 40 * 79


def test_hot_keys_are_split(spark, monkeypatch):
    from sievework.operators import skew

    many = spark.createDataFrame([(k % 3, k) for k in range(90)], "a int, x int")
    few = spark.createDataFrame([(0, "u"), (0, "v"), (1, "w"), (9, "z")], "a int, y string")
    for hot in (5, 1000):
        got = {tuple(r) for r in skew.salted_join(many, few, ["a"], F.col("x"), hot_from=hot).collect()}
        assert got == {(k % 3, k, y) for k in range(90) for a, y in ((0, "u"), (0, "v"), (1, "w")) if a == k % 3}


def test_spans(spark):
    rng = random.Random(2)
    a = [("f" if rng.random() < 0.5 else "g", s := rng.randint(1, 900), s + rng.randint(0, 300)) for _ in range(60)]
    b = [("f" if rng.random() < 0.5 else "g", s := rng.randint(1, 900), s + rng.randint(0, 30)) for _ in range(20)]
    schema = "path string, start_line int, end_line int"
    got = sorted(tuple(r) for r in spans.overlapping(spark.createDataFrame(a + [(None, 1, 2), ("f", None, 3)], schema), spark.createDataFrame(b, schema), ["path"]).collect())
    assert got == sorted(x for x in a if any(x[0] == y[0] and y[1] <= x[2] and x[1] <= y[2] for y in b))
    blocks = spark.createDataFrame([("f", 1, 90, "outer"), ("f", 10, 20, "inner"), ("g", 1, 5, "other")], f"{schema}, name string")
    points = spark.createDataFrame([(1, "f", 15), (2, "f", 95), (3, "g", 5)], "id int, path string, at int")
    first = spans.first_enclosing(points, blocks, ["path"], "at", "id", ["start_line", "end_line"])
    assert {(r.id, r.name) for r in first.collect()} == {(1, "outer"), (3, "other")}
    files = spark.createDataFrame([("f", "a\nb\nc")], "path string, content string")
    cut = spans.cut(spark.createDataFrame([("f", 2, 9), ("f", 3, 2), ("../etc", 1, 1)], "path string, first int, last int"), files, ["path"])
    assert {(r.first, r.content) for r in cut.collect()} == {(2, "b\nc"), (3, "")}


def brute_hits(edges, rounds):
    nodes = sorted({x for e in edges for x in e})
    h = {n: 1 / math.sqrt(len(nodes)) for n in nodes}
    a = dict(h)
    for _ in range(rounds):
        a = {n: sum(h[s] for s, d in edges if d == n) for n in nodes}
        h = {n: sum(a[d] for s, d in edges if s == n) for n in nodes}
        for v in (a, h):
            norm = math.sqrt(sum(x * x for x in v.values()))
            for n in nodes:
                v[n] = v[n] / norm if norm else 0.0
    return a


def test_hits(spark):
    edges = [("a", "b"), ("a", "b"), ("c", "b"), ("b", "d"), ("d", "d")]
    df = spark.createDataFrame([("t", *e) for e in edges] + [("t", "a", None), ("u", "x", "y")], "tree_id string, src string, dst string")
    got = {(r.tree_id, r.node): r.authority for r in graph.hits(df, ["tree_id"], max_iter=3, fixed=True).collect()}
    for n, v in brute_hits(edges, 3).items():
        assert abs(got["t", n] - v) < 1e-9
    scores = graph.hits(df, ["tree_id"])
    assert abs(sum(r.authority**2 for r in scores.where("tree_id = 't'").collect()) - 1) < 1e-6
    assert [r.node for r in graph.top_k(scores, ["tree_id"], 1).orderBy("tree_id").collect()] == ["b", "y"]
    assert graph.hits(df.limit(0), ["tree_id"]).count() == 0
    for rounds, fixed in ((3, True), (10, False)):
        one, many = ({(r.tree_id, r.node): (r.authority, r.hub) for r in graph.hits(df, ["tree_id"], rounds, fixed=fixed, local_edges=n).collect()} for n in (500_000, 0))
        assert one.keys() == many.keys() and all(math.isclose(x, y, abs_tol=1e-5) for k in one for x, y in zip(one[k], many[k]))


def test_graph_tables(spark):
    df = spark.createDataFrame([("t", "a", "b"), ("t", "c", "a"), ("t", "c", None), ("u", "a", "z")], "tree_id string, src string, dst string")
    starts = spark.createDataFrame([("t", "a")], "tree_id string, node string")
    assert {r.node for r in graph.one_hop(df, starts, ["tree_id"]).collect()} == {"b", "c"}
    assert {(r.src, r.dsts) for r in graph.adjacency(df, ["tree_id"]).collect()} == {("a", "b"), ("c", "a"), ("a", "z")}
    nodes = spark.createDataFrame([("t", "m.f"), ("t", "x.g"), ("t", "x.h")], "tree_id string, node string")
    blocks = spark.createDataFrame([("t", "m.f", "f", "b1"), ("t", "k.g", "g", "b2"), ("t", "k.h", "h", "b3"), ("t", "l.h", "h", "b4")], "tree_id string, qualname string, func_name string, block string")
    assert {(r.node, r.block) for r in graph.align(nodes, blocks, ["tree_id"]).collect()} == {("m.f", "b1"), ("x.g", "b2"), ("x.h", None)}
    raw = spark.createDataFrame([("t", "a.<if>.b", "c.<lambda>.d"), ("t", "a", "<builtin>.len"), ("t", "a", "a.<x>"), ("t", "", "b")], "tree_id string, src string, dst string")
    assert {(r.src, r.dst) for r in graph.clean_edges(raw, ["tree_id"]).collect()} == {("a.b", "c")}
    ctor = spark.createDataFrame([("t", "X"), ("t", "X.__init__"), ("t", "Y.__init__")], "tree_id string, node string")
    assert [tuple(r) for r in graph.constructor_links(ctor, ["tree_id"]).collect()] == [("t", "X", "X.__init__")]
    diff = graph.difference(df.where("src = 'a'"), df.where("tree_id = 't'"), ["tree_id", "src", "dst"])
    assert {(r.src, r.dst, r.change) for r in diff.collect()} == {("c", "a", "added"), ("c", None, "added"), ("a", "z", "removed")}


def test_dedup(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 3, "b"), ("y", 2, "c"), (None, 4, "d"), (None, 5, "e")], "id string, seq int, v string")
    assert {r.v for r in dedup.first_wins(df, ["id"], [F.col("seq")]).collect()} == {"a", "c", "d"}
    clash = df.withColumn("position", F.lit(9))
    assert {(r.id, r.v, r.position) for r in dedup.last_wins(clash, ["id"], "seq").collect()} == {("x", "b", 1), ("y", "c", 2), (None, "e", 4)}
    c = spark.createDataFrame([("1", "p", "n"), ("2", "p", "m"), ("3", "q", None)], "id string, path string, name string")
    assert {r.id for r in dedup.not_selected(c, c.where("id = '1'")).collect()} == {"2", "3"}


def test_paths(spark):
    catalogue = spark.createDataFrame([("src/a/x.py",), ("lib/b/x.py",), ("src/only.c",), ("Doc/READ.md",)], "path string")
    wanted = spark.createDataFrame([("src/a/x.py",), ("a/b/x.py",), ("b/other/only.c",), ("read.MD",), ("none.py",), (None,)], "wanted string")
    assert {(r.wanted, r.path, r.tier) for r in paths.resolve(wanted, catalogue).collect()} == {("src/a/x.py", "src/a/x.py", 1), ("a/b/x.py", "lib/b/x.py", 3), ("b/other/only.c", "src/only.c", 2), ("read.MD", "Doc/READ.md", 4)}
    tree = paths.file_tree(catalogue.withColumn("t", F.lit(1)), ["t"], 3)
    assert [(r.entry, r.is_dir) for r in tree.orderBy("position").collect()] == [("Doc", 1), ("Doc/READ.md", 0), ("lib", 1)]


def test_rank(spark):
    known = spark.createDataFrame([("v", "+++ b/Foo.java\n see bar.py"), ("w", None)], "vuln_id string, patch_diff string")
    names = rank.important_names(known)
    assert {r.name for r in names.collect()} == {"Foo.java", "bar.py"}
    blocks = spark.createDataFrame([("t", 1, "a/z.c", 1), ("t", 2, "q/bar.py", 1), ("t", 3, "a/b.c", 4)], "tree_id string, block_key long, file_path string, start_line int")
    assert [r.block_key for r in rank.listing(blocks, names, ["tree_id"], 2).orderBy("position").collect()] == [2, 3]
    texts = spark.createDataFrame([("t", "eval(x)"), ("t", None), ("u", None)], "tree_id string, content string")
    assert {(r.tree_id, r.e) for r in rank.signals(texts, "content", {"e": "eval("}, ["tree_id"]).collect()} == {("t", True), ("u", False)}
