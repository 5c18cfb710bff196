import ast

import pytest

from codeweft.llm.parsing import invalid_files, parse_rates, parsed_files, syntax_errors
from codeweft.llm.syntax import errors

VALID = {
    "python": [
        "", "# only\n", "\ufeffx = 1\r\n", "x: int = 5; y = [*a, *b]\n", "async def f(a, /, b=1, *c, d, **e) -> int:\n    async with a as b, c: return await d\n", "lambda *a, k=1: (yield)\n",
        "class A(B, metaclass=C):\n\n    @d.e(1)\n    def f(self): pass\n\n    x = 1\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "x = 1\nmatch x:\n    case [1, *_] if y:\n        pass\n    case A(b=1) | None:\n        pass\n",
        "with (open(a) as b, open(c)):\n    pass\n", "x = a if b else c\nif (n := 10) > 5: pass\nelif z: pass\nelse: pass\n", "d = {**a, 'b': 1, **c}\ns = {x for y in z if w for x in y}\n", "print(*a, sep='', **k)\nx[1:2, ::3] += 4\n", "from . import (a, b as c,)\nfrom .x import *\n",
        "a = b = c, d = 1, 2\n(a, [b, *c]) = d\nfor x, *y in z: pass\n", 'x = """a\n"b" {"""\nf"{a!r:>{w}}"\n', "del a[0], b.c\nglobal q\nassert a, 'b'\n", "x = not a in b is not c\nmatch = 1\ncase = match\n", "if a:\n\tb\n\tif c:\n\t\td\n", "x = (\n  1,\n# c\n  2)\n", "x = 1 if a else 2 if b else 3\nx = a @ b ** -c\n",
    ],
    "javascript": [
        "", "// c", "const { a, b: [c = 1], ...d } = require('x');\nlet e = async (x, y = 2) => ({ ...x, [y]: 1, get z() { return 1 } });", "for (const [k, v] of Object.entries(o)) { if (k in v) continue; else break }", "label: for (let i = 0, n = 3; i < n; i++) ;",
        "class A extends B.C { static #p = 1; constructor() { super(); } static async *gen() { yield* x } get v() { return this.#p } }", "const r = s.replace(/[\"'{/]/g, \"\") / 2;", "var f = function* g() {}, h = x => x ? y : z\nfoo()\n", "switch (a) { case 1: case 2: b(); break; default: c() }",
        "try { a() } catch { b() } finally { c() }", "const t = `a ${b + `${c}`} {`;", "export default class {}\nexport { a as b, c }\nimport d, { e as f } from 'g'\nimport * as h from \"i\"", "a?.b?.[c]?.(d) ?? e", "if (a) b(); else if (c) d()\nelse { }", "do { a++ } while (b)\n!function(){}()", "x = a\n  .b()\n  .c()\nthrow new Error(`x`)", "new Foo\nnew Foo(1).bar\ntypeof a === 'b' && void 0",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D { readonly a?: string; b(x: number): void; [k: string]: any }", "type X = { a: 1 } | 'b' | (string | number)[] | ((x: A) => B);", "export abstract class Q<T> implements R { constructor(private readonly a: string, public b = 1) {} protected c!: Map<string, number[]>; abstract d(): void; }",
        "enum E { A = 1, B, 'C' = 3 }", "const f = async <T,>(a: T, ...b: T[]): Promise<T> => { return a as T };", "let v = (x as any[]).map((y) => y * 2)!;\nfunction is(a: unknown): a is string { return typeof a === 'string' }", "import type { A } from 'b';\nexport type { A };\nnamespace N { export const a = 1 }", "const m = new Map<string, Array<number>>();\nlet t: [a: string, b?: number] = ['x'];",
    ],
    "java": [
        "", "/* c */", "package a.b;\nimport static c.D.*;\npublic final class A<T extends B & C> extends D<T> implements E, F {\n  @X(y = 1) private static final int[] a = {1, 2}, b = new int[3];\n  static { a[0] = 1; }\n  A() throws G { super(); this.x = 1; }\n  abstract <U> U f(final int x, String... y);\n}",
        "class A { void f() { for (int i = 0; i < 3; i++) { } for (String s : t) ; List<Map<String, Integer>> l = new ArrayList<>() { }; Runnable r = () -> { return; }; x = (a, b) -> a + b; y = A::new; z = (int) q; w = (String) v; } }",
        "enum E { A(1), B { void f() { } }; E() { } }\ninterface I { default int f() { return 1; } int X = 1; }\n@interface J { int a() default 1; }\nrecord R(int a, String b) { R { } }", "class A { int f(Object o) { if (o instanceof String s && s.length() > 1) return 1; switch (x) { case 1: break; default: } return switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; } }",
        "class A { void f() { try (var a = b(); c) { } catch (D | E e) { throw e; } finally { } synchronized (this) { } do { } while (x); a: while (true) break a; char c = '\\u0041'; int i = x > 1 ? 2 : 3; assert x : \"m\"; String t = \"\"\"\n  a \"b\" {\n  \"\"\"; } }",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\t*C\n}\n\ntype I interface {\n\tF(x int) (string, error)\n\tE\n}\n", "package a\nfunc (t *T[K]) F(a int, b ...string) (n int, err error) {\n\tif x := f(); x > 1 {\n\t\treturn\n\t} else if y {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tfor {\n\t\tbreak\n\t}\n\treturn 1, nil\n}\n",
        "package a\nvar (\n\tx = map[string]int{\"a\": 1}\n\ty = []T{{1, 2}, {a: 3}}\n\tz func(int) error\n)\nconst c = iota\n", "package a\nfunc f() {\n\tswitch t := x.(type) {\n\tcase int, *T:\n\t\tg()\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { h() }()\n\tdefer mu.Unlock()\n\ta[1:2], b = <-c, &T{x: 1}\n\tp := r.(io.Reader)\n}\n", "package a\n\nfunc Map[T any, U comparable](x []T, f func(T) U) []U {\n\treturn make([]U, 0, len(x))\n}\n",
    ],
    "c": [
        "", "#include <a.h>\n#define M(x) \\\n  do { x } while (0)\n", "/* caf\xe9 */ int x;", "typedef struct s { int a : 3; char *b[2]; union { int c; } d; } S, *P;\nenum e { A, B = 2, };\nextern const unsigned long long *volatile x;\n",
        "static int f(const char *a, size_t n, ...) {\n  int (*g)(int, char) = 0, h[3] = { [0] = 1, 2 };\n  struct s t = { .a = 1, .b = { 0 } };\n  for (size_t i = 0; i < n; i++) if (a[i] == '\\'') continue; else break;\n  switch (n) { case 1: default: return (int)n << 2 & 0xffu; }\n  do x--; while (x);\n  goto end;\nend:\n  return sizeof(int) + sizeof x ? -1 : (unsigned char)*a;\n}\n",
        "void f(void) { printf(\"a\" \"b\" PRIu64 \"%zu\\n\", x); p->q.r = (struct s){ 1 }; T *t = malloc(sizeof(T)); }",
    ],
    "rust": [
        "", "//! doc\n#![allow(x)]\nuse a::{b::c, d as e, f::*};\npub(crate) mod m { pub const X: u32 = 1; }\n", "pub struct A<'a, T: B + 'a> where T: C { pub x: &'a [T], y: Option<Box<dyn Fn(u32) -> T>> }\nstruct U;\nstruct V(pub u32, String);\nenum E { A, B(u32), C { x: i64 } }",
        "impl<T> A<T> { pub fn f(&mut self, mut x: u32, (a, b): (u8, u8)) -> Result<(), E> { let v: Vec<u32> = vec![1, 2]; for i in 0..10 { if i > 3 && x < 4 { continue; } } while let Some(y) = v.pop() { } match x { 0 | 1 => {} n @ 2..=5 if n > 3 => return Ok(()), _ => (), } Ok(()) } }",
        "fn g() -> impl Iterator<Item = u32> { let c = |x: u32, y| x + y; let s = r#\"a \" {\"#; let t = 'a: loop { break 'a 5; }; let u = A { x: 1, ..Default::default() }; v.iter().map(|x| x * 2).sum::<u32>() as usize; if let Some(z) = w { z } else { 0 } }", "trait T: A { type X; fn f(&self); fn g() {} }\nmacro_rules! m { ($x:expr) => { $x }; }\nstatic S: &'static str = \"a\\\n b\";\nunsafe fn h() { let q = &mut *p; let x = -1i64; let y = b'\\n'; let c = '{'; }",
    ],
}

INVALID = {
    "python": ["print 'x'\n", "def f():\nx = 1\n", "if a\n    b\n", "x = (1,\n", "x = [1, 2\ny = 3\n", "f(a b)\n", "1 = x\n", "f() = 2\n", "x = 5abc\n", "def f(:\n    pass\n", "  x = 1\n", "if a:\n    b\n  c\n", "try:\n    a\nb\n", "x = 'abc\n", '"""abc\n', "<<<<<<< HEAD\nx\n=======\n", "import\n", "class A\n    pass\n", "x = 012\n", "else:\n    pass\n", "return return\n", "a = {1: 2, 3}}\n", "@d\nx = 1\n", "x = a ? b : c\n", "for x y in z: pass\n", "\ufffd\n", "x = 1 +\n", "let x = 5;\n", "exec \"x\"\n", "f(**k, *)\n"],
    "javascript": ["const x;", "let a = ;", "f((1, 2);", "if (a { }", "function (a) {}", "class A { foo: 1 }", "<<<<<<< x\na\n", "x = [1, 2;", "import os\nimport re\n", "def f():\n    pass\n", "a b c", "for (let i = 0; i < 3) {}", "try { }", "'abc", "}", "return {", "let x = `a ${b", "a = 1 = 2;", "{ a: 1, b: 2 }}", "#include <x.h>"],
    "typescript": ["interface A { x string }", "let a: = 1;", "type X = ;", "function f(a: number { }", "class { ", "const zz = \"open;\n", "enum { A }"],
    "java": ["class A {", "class A { int f( { } }", "class A { void f() { int x = ; } }", "int x = 1;", "class A { void f() { f(1, 2; } }", "class A { void f() { return 1 } }", "import a.b", "def f(): pass", "class A { void f() { String s = \"abc; } }", "class A { } }", "class A { void f() { if (x) else y(); } }", "class A { foo bar baz; }"],
    "go": ["func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f( {\n}\n", "package a\nx := 1\n", "package a\nfunc f() {\n\tx := [1, 2\n}\n", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}\n", "package a\n<<<<<<< x\n", "package a\nfunc f() {\n\treturn 1,\n}\n", "package a\nvar x = \"abc\n"],
    "c": ["int f() {", "int x = ;", "int f() { return 1 }", "int f() { int x = (1 + 2; }", "import os\nimport re\n", "}", "int f() { char *s = \"abc; }", "<<<<<<< x\nint y;\n", "int f() { x = 1 2; }", "package a\n\nfunc f() {\n}\n", "int f(int a b) { }"],
    "rust": ["fn f() {", "fn f() { let x = ; }", "fn f( { }", "struct A { x u32 }", "import os\nimport re\n", "#include <stdio.h>\nint x;\n", "fn f() { let x = (1, 2; }", "}", "fn f() { let s = \"abc; }", "<!doctype html>\n<html>\n", "fn f() { if x { } else }", "let x = 1;"],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid(lang):
    for text in VALID[lang]:
        assert errors(lang, text) == [], (text, errors(lang, text))


@pytest.mark.parametrize("lang", INVALID)
def test_invalid(lang):
    for text in INVALID[lang]:
        assert errors(lang, text), text


def test_python_agrees_with_the_interpreter_on_its_own_library():
    import glob
    import os
    import warnings

    warnings.simplefilter("ignore")
    wrong = []
    for f in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:120]:
        text = open(f, encoding="utf-8").read()
        for t in (text, text[: len(text) * 2 // 3]):
            try:
                ast.parse(t)
                ok = True
            except SyntaxError:
                ok = False
            if ok != (not errors("python", t)):
                wrong.append((f, len(t)))
    assert len(wrong) <= 6, wrong


def test_panic_mode_finds_every_error_with_its_line():
    text = "class A {\n  void f() {\n    int x = ;\n    y();\n    z(1 2);\n  }\n  int g() { return 1 }\n}\n"
    assert [line for line, _ in errors("java", text)] == [3, 5, 7]
    assert [line for line, _ in errors("python", "x = (1\ny)\nz = = 1\nprint 'a'\n")][-2:] == [3, 4]


def test_bytes_and_languages_without_grammar():
    assert syntax_errors("c", b"// caf\xe9\nint x;\n") == []
    assert syntax_errors("python", b"# caf\xe9\n") and syntax_errors("python", b"# -*- coding: latin-1 -*-\n# caf\xe9\n") == []
    assert syntax_errors("cobol", b"x") is None and syntax_errors("python", None) is None and syntax_errors(None, b"x") is None
    assert syntax_errors("python", b"") == [] and syntax_errors("python", b"(" * 30_000 + b")" * 30_000) is not None
    assert syntax_errors("javascript", b"x" * 2_000_000) == []


def test_operator_takes_the_current_version(spark):
    from datetime import datetime

    t = lambda k: datetime(2025, 1, k)
    rows = [
        ("r", "a.py", t(1), b"x = (", "python", 1), ("r", "a.py", t(2), b"x = 1", "python", 1), ("r", "b.py", t(1), b"x = 1", "python", 1), ("r", "b.py", t(3), b"x = (", "python", 1), ("r", "b.py", t(3), b"x = (", "python", 1),
        ("s", "c.c", t(1), None, "c", 1), ("s", "d.md", t(1), b"# (", None, 1), (None, "e.c", t(1), b"}", "c", 1), ("s", "f.c", None, b"}", "c", 1),
    ]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3]) if r[3] is not None else None, *r[4:]) for r in rows], "repo string, path string, modification_time timestamp, content binary, lang string, errors int")
    assert {tuple(r)[:2] for r in invalid_files(df).collect()} == {("r", "b.py"), ("s", "f.c")}
    rates = {(r["repo"], r["lang"]): (r["n_files"], r["n_invalid"], r["rate"]) for r in parse_rates(df).collect()}
    assert rates[("r", "python")] == (2, 1, 0.5) and rates[(None, "c")] == (1, 1, 1.0)
    assert parsed_files(df.limit(0)).count() == 0


BROKEN = ["f(a=1, 2)", "f(**a, *b)", "f(x for x in y, 1)", "class A(m=1, B): pass", "f'{a b}'", "f'{a!z}'", "f'{}'", "f'}'", "f'{a:{b c}}'", "match x:\n  case 1 2: pass", "(" * 201 + ")" * 201]
WHOLE = [
    "match x:\n  case 1: pass", "# c\n\nmatch x:\n  case (\n    1\n    | 2\n  ):\n    pass\nmatch = 1\n", "case = 1", "match(x)", "f(a=1, *b)", "f(**a, b=1)", "f(*a, b)",
    "f'{a!r:>{w}} {b=} {{x}} {d[\"k\"]} {x!r}'", "f'{a!=b}'", "f\'\'\'{\n a\n}\'\'\'", "f'{(lambda x: 1)}'", "f'{x:%H:%M}'", "rf'\\d{x}'", "f'{*a, b}'", "f'{x = }'",
]


@pytest.mark.parametrize("text", BROKEN)
def test_python_that_does_not_parse(text):
    assert errors("python", text)


@pytest.mark.parametrize("text", WHOLE)
def test_python_that_parses(text):
    assert errors("python", text) == []


def test_a_first_match_keeps_its_lines():
    assert errors("python", "match x:\n  case 1:\n    a b\n")[0][0] == 3


@pytest.mark.parametrize("text,broken", [("a ?? b || c", 1), ("a && b ?? c", 1), ("a ?? b && c", 1), ("a ?? (b || c)", 0), ("(a && b) ?? c", 0), ("a ?? b ?? c", 0), ("`${a b}`", 1), ("`${}`", 1), ("`${a + `x${b}`} \\${c d}`", 0), ("x = `a ${f({a: 1})} b`;", 0), ("x =\n a ??\n b", 0)])
def test_script_operators_and_templates(text, broken):
    assert bool(errors("javascript", text)) == bool(broken) and bool(errors("typescript", text)) == bool(broken)


def test_deep_nesting_is_judged(spark):
    from codeweft.llm.parsing import all_errors, parsed_files

    deep = {"deep.js": "x = " + "(" * 5000 + "1" + ")" * 5000 + ";", "open.js": "x = " + "(" * 5000 + "1" + ")" * 4999 + ";", "two.js": "a b;\nlet x = 1;\nc d;\n"}
    rows = [("r", p, None, bytearray(t.encode()), "javascript") for p, t in deep.items()]
    df = spark.createDataFrame(rows, "repo string, path string, modification_time timestamp, content binary, lang string")
    got = {r["path"]: len(r["errors"]) for r in parsed_files(df).collect()}
    assert got["deep.js"] == 0 and got["open.js"] > 0 and got["two.js"] == 2
    assert [(r["place"], r["line"]) for r in all_errors(df).filter("path = 'two.js'").orderBy("place").collect()] == [(0, 1), (1, 3)]
