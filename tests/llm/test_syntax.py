import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from sievework.llm import grammars, syntax

GOOD = {
    "json": ['{"a": [1, -2.5e3, "x\\u00e9", null, true]}', "3", ' "s" '],
    "python": ["", "x = 1\n", "def f(a, /, b: int = 2, *c, d, **e) -> None:\n    return (yield a)\n", "match x:\n    case {'a': [1, *_], **r} if r:\n        pass\n    case A(b=1) | None:\n        pass\n", "with (open(a) as b, c):\n    x: int = [i async for i in y if i]\n", "if a:\n\tb\nelse:\n\tc\n", "x = f'{a!r:>{w}}' \"b\"\nlambda *a, k=1: (a, k)\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    del a[1:2, ...]\n", "match = 1\nmatch(x)\ntype X[T] = list[T]\n@d\nasync def g(): await h\n"],
    "java": ["", "package a.b; import static c.D.*; @X(y = {1, 2}) public final class A<T extends B & C> extends D implements E { static { f(); } A(int... x) throws Y { this(); } <U> Map<String, List<int[]>> m(final T t) { for (int i = 0, j; i < 3; i++) { a[i] = b -> b + 1; } for (String s : x.y()) continue; label: while (true) { break label; } try (R r = new R(); q) { } catch (A | B e) { throw e; } finally { } switch (k) { case 1, 2 -> { } default: x(); } int[] z = {1, 2}, w[] = new int[3][]; Runnable r = () -> { }; return (String) o.<T>g(A::new, int[]::new) instanceof String s ? a : (b, c) -> b; } enum E { X(1) { void f() { } }, Y; int q; } interface I { default void f() { } int g(); } record R(int a, String b) { R { } } @interface Z { int v() default 1; } }", 'class A { String t = """\n  x " y\n  """; char c = \'\\u0041\'; long n = 0x1_FL + 1_000; List<Map<A, B>> x = new ArrayList<>() { }; }'],
    "c": ["", "#include <a.h>\n#define X(a) {\nstatic const char *const s[] = { \"a\" \"b\", [3] = \"c\" };\ntypedef struct n { int a : 3; struct n *next; union { int x; } u; } n_t;\nenum { A, B = 2, };\nint (*fp)(int, char **) = 0;\nunsigned long f(const n_t *p, ...)\n{\n    size_t i, *q = (size_t *)p; uint8_t b[4] = {0};\n    for (int k = 0; k < 3; k++) { q[k] = p->a ? ~k : -k; }\n    do { goto out; } while (i--);\n    switch (i) { case 'a': default: break; }\n    if (sizeof(int) > 2 && !f(p, &b)) return (n_t){ .a = 1 }.a;\nout:\n    foo * bar;\n    return a << 2 | b;\n}\n#ifdef Y\nint g(void) {\n#else\nint g(int a) {\n#endif\n return 1; }\n"],
    "c++": ["", "#include <a>\nnamespace a::b { template <typename T, int N = 3> class X final : public Y<T>, private Z { public: explicit X(int a) : m(a), n{1} {} virtual ~X() = default; X &operator=(const X &) = delete; T f() const noexcept override { return *this; } static constexpr int k = 2; friend class W; using U = std::vector<T>; private: int m, n; }; }\nstd::vector<std::map<int, std::string>> g(const std::string &s, int &&x = 3) {\n  std::string a = h(s, 1); std::vector<int> v{1, 2}; auto l = [&, this](int y) mutable -> int { return y; };\n  for (const auto &[k, w] : m) { std::cout << k << static_cast<int>(w); }\n  try { throw E(\"x\"); } catch (const E &e) { } catch (...) { }\n  int *p = new int[3]; delete[] p; foo::bar baz = x ? y : z; return {a, b};\n}\nenum class C : int { A = 1, B };\nX<int>::X() {}\nint X<int>::f() { return 1; }\nextern \"C\" { void q(); }\n"],
}
BAD = {
    "json": ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", '{"a": "b\n"}', "<html>"],
    "python": ["def f(:\n    pass\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n", "if a:\nb\n", "  x\n y\n", "print 'a'\n", "x = 'abc\n", "class A\n    pass\n", "9 x = 1\n", "package a.b;\n", '"""abc\n'],
    "java": ["class A { void f( { } }", "class A { int x = 1 }", "class A {", "#include <x>\n", "class A { void f() { a[1 = 2; } }", "class A { String s = \"abc; }\n}", "def f():\n    pass\n", "class A {\n<<<<<<< HEAD\n int a;\n}", "<!DOCTYPE html>", "class A { void f() { 9 x = 1; } }"],
    "c": ["int f(void) {", "int f( { return 1; }", "int f(void) { return a[1; }", "int f(void) { return 1 }", "package a.b;\nclass X { }", "import os\nfrom a.b import c\n", "# Title\n\ntext here\n", "int f(void) {\n>>>>>>> x\n}", "std::string s;", "#ifdef X\nint a;\n", "int f(void) { printf(\"a); }\n", "#if A\nint a;\n#else\n<<<<<<< HEAD\nint b;\n#endif\n", "struct x { int a; "],
    "c++": ["class A { void f( { } };", "class A { int x }", "class A {", "public class A { }", "package a.b;\n", "def f(x):\n    return 1\n", "int f() { if a > 1) { } }", "int f() {\n=======\n}"],
}

#: Forms of newer language versions, of the preprocessor and of other compilers; and what a table alone would let pass.
MORE_GOOD = {
    'java': ['sealed interface S permits A {}', 'public sealed class B permits C, D { } non-sealed class C extends B { } final class D extends B { }', 'class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> 1; case Point(int x, int y) -> x + y; case Line(Point(var a, var b), Point p) when a > b -> 2; case null, default -> 0; }; } }', 'class A { void f(Object o) { if (o instanceof Point(int x, int y) && x > 0) { g(x); } } }', 'module a.b { requires java.base; exports c.d to e, f; }', 'class A { int sealed = 1; void permits() { } void f() { try { } finally { } try (R r = q()) { } } }', 'class A { void f() { "abc".length(); this.x = 1; new B().go(); int[] a = {1}; a[0]++; (x).y(); } }'],
    'c': ['void f(void) { asm volatile("nop" ::: "memory"); }', 'void f(void) { asm("x" : "=r"(a) : "r"(b)); }', 'void f(void) {\n  LIST_FOREACH(e, &h, next) {\n    g(e);\n  }\n}\nEXPORT_SYMBOL(f)\nint x;\n', 'int a[9] = { [0 ... 3] = 1 };', 'long long x; unsigned long long int y;', 'MODULE_LICENSE("GPL");\nint y;', 'void f(void) {\n  list_for_each_entry(p, &head, list) {\n g(p);\n }\n}'],
    'c++': ['auto [x, y] = p;', 'void f() { auto [x, y] = p; auto& [a, b] = q; for (auto& [k, v] : m) { } }', 'template <typename T> concept C = requires(T a) { a + a; { a.f() } -> std::same_as<int>; typename T::type; };', 'template <class... Ts> struct O : Ts... { using Ts::operator()...; };', 'void f() { asm volatile("nop" ::: "memory"); }', 'template <typename T> requires C<T> T g(T a) { return a; }'],
    'python': ['del (a, b[0]), c.d', 'for a, *b in c: pass', 'f(x for x in y)', '[a, b] = c', '(a) = (b) = c', '() = x', 'a.b[0].c = 1', 'x: int = 3', 'lambda a=1, b=2: a', 'lambda *, k: k', '(y := f(x))', 'f"{x!r:>{w}} {y=} {d[\'k\']}"', 'with (a as b, c as (d, e)): pass', '{x: y for x, y in z}', 'x = yield', 'f(a=1, *b)', '0_0', '0777.5', 'def f(a, /, b, *, c=1, d, **e): pass', 'def f[T: (int, str)](a: T = 1, *, b): pass', 'match x:\n  case A(a=1, b=[*_]): pass', 'f(**{"a": 1}, b=2)', 'dict((k, v) for k, v in z)'],
}
MORE_BAD = {
    'java': ['class A { void f() { 1 + 2; } }', 'class A { void f() { 5 = x; } }', 'class A { int x = 08; }', 'class A { void f() { try { } } }', 'class A { private private int x; }', 'class A { void f() { g(a b); } }', 'clas A { }'],
    'c': ['int int x;', 'std::string s;', 'int f(void) { FOO(1) }'],
    'c++': ['int int x;', 'void f() { auto [x, = p; }'],
    'python': ['f() = 1', '1 = x', 'None = 1', '0777', 'f(a=1, 2)', 'f(**a, *b)', 'f(**a, b)', 'def f(a=1, b): pass', 'def f(*): pass', 'def f(*, **k): pass', '{**a, b}', '{a: 1, b}', 'del f()', 'f"{a b}"', 'f"{}"', 'b"é"', 'a, b += 1', 'for 1 in x: pass', 'class A(x for x in y): pass', 'f(x for x in y, 1)', 'a + b = 1', 'a, b: int', 'lambda a=1, b: a', '(a.b := 1)', 'b"a" "b"', 'f"{x:{y z}}"', 'with a as 1: pass', '[x for 1 in y]', 'f(a.b=1)', 'x if y else z = 1', 'def f(/): pass', 'def f(a, *b, *c): pass'],
}


@pytest.mark.parametrize("language", MORE_GOOD)
def test_more(language):
    for text in MORE_GOOD[language]:
        assert syntax.first_error(text, language) is None, text
    for text in MORE_BAD[language]:
        assert syntax.first_error(text, language) is not None, text


def test_python_rules_agree_with_the_interpreter():
    for text in (*MORE_GOOD["python"], *MORE_BAD["python"]):
        try:
            ast.parse(text)
            valid = True
        except SyntaxError:
            valid = False
        assert (syntax.first_error(text, "python") is None) == valid, text


@pytest.mark.parametrize("language", GOOD)
def test_good(language):
    for text in GOOD[language]:
        assert syntax.first_error(text, language) is None, text[: 200 if language == "python" else None]


@pytest.mark.parametrize("language", BAD)
def test_bad(language):
    for text in BAD[language]:
        assert syntax.first_error(text, language) is not None, text


def test_python_grammar_accepts_the_standard_library():
    files = sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:90]
    parser = syntax.parser("python")
    for f in files:
        text = f.read_text(encoding="utf-8", errors="ignore")
        kinds, places = syntax.tokens(text, "python")
        at = parser.error([*kinds, grammars.END])
        assert syntax.first_error(text, "python") is None, f.name
        assert at is None, (f.name, text[places[at] - 60 : places[at] + 30])


def test_error_line():
    assert syntax.first_error("x = 1\ny = )\n", "python") == 2


def test_files(rows):
    data = [(1, "t", "file", "a.py", None, "x = ("), (1, "t", "file", "a.py", None, "x = ("), (2, "t", "file", "b.py", "PYTHON", "x = 1"), (3, "t", "file", "c.yaml", None, ":::"), (4, "t", "FunctionDef", "d.py", None, "x = ("), (5, None, "file", "e.json", None, ""), (6, "t", "file", "f.json", None, None)]
    df = rows(data, "block_key long, tree_id string, kind string, file_path string, language string, content string")
    assert {r.block_key for r in syntax.invalid_files(df).collect()} == {1, 5}
    trees = rows([("t", "r"), ("t", "r")], "tree_id string, repo string")
    assert {tuple(r) for r in syntax.rates(df, trees).collect()} == {("r", "python", 2, 1, 0.5), (None, "json", 1, 1, 1.0)}
    assert not syntax.checked(df.where(F.lit(False))).count()
