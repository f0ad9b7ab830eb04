from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import pieces
from sievework.llm.languages import language_of

PY = '''import os

# def not_me():
class A(B):
    """doc
    def nor_me(self):
    """
    x = "def no(): {"

    @property
    def one(self):
        def inner():
            pass

    async def two(
        self,
    ):
        pass

    class Nested:
        def deep(self):
            pass


def top():
    pass
'''
JAVA = '''package p;
public final class A<T> {
    private int x = f("{");
    // void no() {
    public A(int y) {
        if (y > 0) { g(); }
    }
    @Override
    public Map<String, Integer> m(List<T> z)
    {
        String s = "}";
        return null;
    }
    static class N {
        void deep() {}
    }
    int[] data = { 1, 2 };
}
'''
CPP = '''#include <x.h>
#define M(a) {
namespace n {
struct P {
    int a;
};
class Q : public P {
public:
    Q() : a(1) {}
    ~Q();
    int run(int k) const {
#ifdef X
        if (k) {
#else
        if (!k) {
#endif
        }
        return 1;
    }
};
static int
later(struct P *p)
{
    return 0;
}
}
'''


def names(text, language):
    out = []
    for at in pieces.members(text, language):
        end = at
        while end < len(text) and (text[end].isalnum() or text[end] in "_~"):
            end += 1
        out.append(text[at:end])
    return out


def test_members():
    assert names(PY, "python") == ["A", "one", "two", "Nested", "top"]
    assert names(JAVA, "java") == ["A", "A", "m", "N"]
    assert names(CPP, "c++") == ["P", "Q", "Q", "run", "later"]
    assert pieces.members(PY, "json") == [] and pieces.members("", "java") == []


def test_language():
    assert [language_of(*x) for x in (("PYTHON", "a.c"), (None, "x/y.HPP"), ("", "a.json"), (None, "a.yaml"), (None, None), ("cobol", "a.py"), (None, "py"))] == ["python", "c++", "json", None, None, "python", None]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n\r中{};", max_size=300), st.integers(20, 60), st.integers(0, 9))
def test_cut(text, limit, overlap):
    got = pieces.cut(text, "java", limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in got)
    for (_, b), (c, _) in zip(got, got[1:]):
        assert 0 <= b - c <= overlap
    assert all(text[a - 1 : a + 1] != "\r\n" for a, _ in got[1:] if a)


def test_range_maximum():
    import numpy as np

    v = np.array([3, 1, 3, 2, 3, 0], np.int8)
    t = pieces.RangeMaximum(v, 6)
    for a in range(6):
        for b in range(a + 1, 7):
            assert t.best(a, b) == max(range(a, b), key=lambda i: (v[i], i))


def test_range_maximum_by_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, 50_000).astype(np.int8)
    t = pieces.RangeMaximum(v, 100)
    for a in (*range(16_300, 16_500, 7), 0, 49_950, 3):
        b = min(len(v), a + 1 + a % 100)
        assert t.best(a, b) == max(range(a, b), key=lambda i: (v[i], i))
    assert t.natural(5) == np.flatnonzero(v == 5).tolist() and pieces.RangeMaximum(v[:0], 100).natural() == []


def test_blocks(rows):
    big = JAVA.replace("return null;", "return null;\r\n        // " + "x" * 5000)
    data = [(1, "a.java", "Java", 11, big), (1, "a.java", "Java", 11, big), (2, "b.json", None, 1, "[" + "1," * 3000 + "1]"), (3, "c.py", None, None, PY), (4, None, None, 1, None), (5, "d.py", "python", None, "x" * 9000)]
    df = rows(data, "block_key long, file_path string, language string, start_line int, content string")
    got = {tuple(r) for r in pieces.boundaries(df).collect()}
    assert got == {(1, 11), (1, 12), (1, 15), (1, 19), (1, 25), (2, 1), (5, 1)}
    cut = pieces.pieces(df).collect()
    assert {r.block_key for r in cut} == {1, 2, 5} and all(len(r.content) <= 4000 and r.start_line <= r.end_line for r in cut)
    assert sum(r.block_key == 1 for r in cut) == len(pieces.cut(big, "java"))
    assert not pieces.boundaries(df.limit(0)).count()
