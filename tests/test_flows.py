import pytest

from sievework.sources import flows

FILES = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def __init__(self, hook):\n        self.hook = hook\n    def run(self):\n        return self.hook()\n    def __enter__(self):\n        return self\n    def __exit__(self, *a):\n        pass\n    def __call__(self):\n        return 1\n",
    "pkg/app.py": """from .base import Base as B
from pkg import util as u
import pkg.util

def one(): return two
def two(): pass
def three(): pass

class Child(B):
    def go(self, other: int = 0):
        self.run()
        self.later = two
        return Child(three)
    def end(self):
        self.later()

def main(flag):
    x = one
    x()()
    c = Child(two)
    c.go().run()
    table = {"a": three, "b": u.helper}
    table["a"]()
    for f in [one, three]:
        f()
    with Child(one) as w:
        w.end()
    g = two if flag else three
    g()
    h = lambda: one()
    h()
    c()
    pick(key=two)
    y: object = u.helper
    y()
    pkg.util.helper()
    a, b = one, two
    b()

def pick(key):
    key()

def wrap(f):
    def inner():
        return f()
    return inner

@wrap
def decorated(): pass

def use():
    decorated()
""",
    "pkg/util.py": "def helper(): pass\n",
    "bad.py": "def (",
}
WANT = {
    ("pkg.app.main", "pkg.app.one"), ("pkg.app.main", "pkg.app.two"), ("pkg.app.main", "pkg.app.three"), ("pkg.app.main", "pkg.base.Base.__init__"), ("pkg.app.main", "pkg.app.Child.go"), ("pkg.app.main", "pkg.base.Base.run"),
    ("pkg.base.Base.run", "pkg.app.two"), ("pkg.base.Base.run", "pkg.app.three"), ("pkg.app.Child.go", "pkg.base.Base.run"), ("pkg.app.Child.end", "pkg.app.two"), ("pkg.app.main", "pkg.base.Base.__enter__"), ("pkg.app.main", "pkg.app.Child.end"),
    ("pkg.app.main", "pkg.base.Base.__call__"), ("pkg.app.pick", "pkg.app.two"), ("pkg.app.main", "pkg.util.helper"), ("pkg.app.wrap.inner", "pkg.app.decorated"), ("pkg.app.use", "pkg.app.wrap.inner"), ("pkg.app.main", "pkg.app.pick"),
}


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame([("t", p, t) for p, t in FILES.items()] + [("u", "pkg/util.py", "def helper(): pass\nhelper()\n"), (None, "x.py", "def f(): f()"), ("t", "n.py", None)], "tree_id string, file_path string, content string")
    return {(r.tree_id, r.src, r.dst): r.edge_kind for r in flows.resolved_edges(df).collect()}


def test_edges_by_the_flow_of_values(edges):
    got = {(s, d) for t, s, d in edges if t == "t"}
    assert WANT <= got, WANT - got
    assert any(s.startswith("pkg.app.main.<lambda") and d == "pkg.app.one" for s, d in got)
    assert not [d for s, d in got if s == "pkg.app.pick" and d != "pkg.app.two"] and ("pkg.app.Child.end", "pkg.app.three") not in got


def test_trees_stay_apart(edges):
    assert {(s, d) for t, s, d in edges if t == "u"} == {("pkg.util", "pkg.util.helper")}
    assert edges["t", "pkg.app.main", "pkg.app.pick"] == "call" and edges["t", "pkg.app.pick", "pkg.app.two"] == "points_to"


def test_no_files(spark):
    assert flows.resolved_edges(spark.createDataFrame([], "tree_id string, file_path string, content string")).count() == 0
