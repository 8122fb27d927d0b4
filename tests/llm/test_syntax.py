import ast

import pytest

from auditlake.llm import lexers, quick
from auditlake.llm import syntax as S

JAVA = '''
package a.b; import static java.util.Map.*; import java.util.List;
@Deprecated(since = "1", forRemoval = true) public sealed abstract class A<T extends Comparable<? super T> & Runnable> extends B<T> implements C, D.E permits X, Y {
    private static final int[] N = {1, 2_000, 0xFF, 0b11, 'c', '\\n', '\\u0041'}, M[] = {{1}, {2,},};
    static { System.out.println("x\\"y"); } { init(); }
    @Override protected <R> R run(final List<? extends T> xs, int... rest) throws IOException, Foo { return null; }
    public A(int x) { this(x, 0L, 1.5e-3f, .5); } A(int a, long b, float c, double d) { super(); }
    abstract void none(); native int n() ; int arr()[] { return new int[3][]; }
    record P(int x, @Nullable String y) implements Q { P { if (x < 0) throw new IllegalArgumentException(); } static int z = 1; }
    enum Color implements K { RED(1) { int f() { return 1; } }, GREEN, ; private int v; Color() {} Color(int v) { this.v = v; } }
    interface I { default void d() {} static int s() { return 1; } private void p() {} int X = 1; }
    @interface An { String value() default "x"; int[] ns() default {1, 2}; Class<?>[] cs() default {}; }
    non-sealed interface J extends I {}
    void all(Object o) throws Exception {
        label: for (int i = 0, j = 1; i < 10 && j > 2; i++, j--) { if (i == 3) continue label; else break; }
        for (final var x : xs) for (;;) break;
        do { x += y >>> 2 >> 1 << 3; } while (!(x >= 5) || y != ~z);
        try (var r = open(); Foo q = new Foo(1) { int k; }; r) { } catch (IOException | RuntimeException e) { throw e; } finally { ; }
        switch (o.kind()) { case 1: case 2: f(); break; default: g(); }
        int v = switch (k) { case "a", "b" -> 1; case "c" -> { yield 2; } default -> throw new Error(); };
        Runnable r = () -> {}, q = A::run; Function<Integer, int[]> h = int[]::new; BiFunction<A, B, C> g = (a, b) -> a * b; var z = (x) -> x;
        Supplier<List<String>> s = ArrayList<String>::new; IntFunction<T> t = (int a) -> (T) (Object) list.<String>get(a).toString();
        if (o instanceof String str && str.length() > 1 || o instanceof final Integer) return;
        synchronized (this) { assert x > 0 : "no"; } int a = b ? c : d ? e : f; a = b = c; a[i++] += -1 + +2 - --x; (a) = 1;
        new Thread() { public void run() { super.run(); A.this.go(); A.super.go(); } }.start(); String.class.getName(); int[].class.getName();
        String text = """
            a "quoted" \\n text
            """; char c = '\\''; long l = 0x1FL + 017 + 1__0; List<Map<String, int[]>> m = new HashMap<>(); @A final int w = 1; class Local {} record R2() {} var record = 1; record = 2;
    }
}
'''
KOTLIN = '''
@file:JvmName("X")
package a.b
import a.b.*
import c.d as e
@Suppress("x") internal sealed class A<out T : Any>(private val x: Int = 1, vararg ys: String) : B(x), C by d, E<Int>() where T : F {
    companion object { const val K = 1; fun f() = 2 }
    init { println("a ${x + "b"} $y") }
    constructor() : this(1) { go() }
    var p: Int = 1
        get() = field
        private set(value) { field = value }
    val q by lazy { 1 }
    lateinit var z: String
    override suspend fun <R> run(a: (Int) -> R, b: suspend A.(x: Int) -> Unit = {}): List<R>? where R : Any = listOf(a(1)).map { it }
    operator fun plus(o: A<*>): A<T> = this
    abstract fun n(): Int
    inner class I; enum class Color(val v: Int) { RED(1) { override fun f() = 1 }, GREEN(2); abstract fun f(): Int }
    data class P(val a: Int, val b: String?)
    fun interface Fn { fun go() }
}
typealias H<T> = Map<String, List<T>>
object O : C { val x get() = 1 }
fun String.ext(n: Int = 2) { for ((k, v) in m) { if (k in 1..n && v !is String) continue else break } }
val Int.sq: Int get() = this * this
fun soft(value: Int, data: String, open: Boolean = true) { value.let { data }; open = false; val inner = value + 1; data(inner); set(value) }
fun main(args: Array<String>) {
    val (a, _) = pair; var s = "x"; val t: String? = null
    when (val r = f()) { 1, 2 -> a; in 3..4 -> { b }; is String -> c; !in xs -> d
        else -> e }
    when { x > 1 -> y
        else -> z }
    val r = if (x) 1 else if (y) { 2 } else 3
    s = t?.length?.toString() ?: return; s += "q"; a!!.b[1, 2]++
    try { f() } catch (e: Exception) { g(e) } finally { h() }
    val f1 = fun(x: Int): Int { return x }; val g = ::main; val h = String::length; val o = object : A(), B { val q = 1 }
    list.filter { it > 1 }
        .map { x -> x * 2 }
        .forEach(::println)
    outer@ for (i in 0 until 10 step 2) while (true) { break@outer }
    do { x-- } while (x > 0)
    run { return@run }; foo<Int>(1) { a, (b, c) -> a + b }; val big = 1_000L + 0xFF + 1.5f + 2u
    val raw = """a "b" ${c.d("e")} $f
      g"""; val ch = '\\n'; throw IllegalStateException("x $y"); x as? String; `odd name`(); val m = mapOf("a" to 1, "b" to 2)
    buildString { append('a'); append("b") }; val l: List<() -> Unit> = emptyList(); a && b ||
        c; if (a) b else c
}
'''
SCRIPT = '''#!/usr/bin/env node
'use strict'
import d, { a as b, default as c } from './x.js'; import * as n from "y"; import './z'
export const e = 1, f = [1, , ...g]; export default class extends H { #p = 1; static q; static { this.q = 2 } get r() { return this.#p } set r(v) {} static async *s() { yield* t }; [u + 1]() {} async = 1; 'quoted'() {} }
export { a, b as c } from 'd'; export * from 'e'; export function* gen(a, { b, c: [d2 = 1, ...e2] = [] } = {}, ...rest) { const x = yield; return x }
let x = a ? b : c, y = (p, q) => p + q, z = async r => await r, w = () => ({ a, b() {}, get c() { return 1 }, [d]: 1, 'e': 2, ...f })
var re = /[/\\]]+(?:a|b)/gi.test(s) / 2, t = `a ${b + `c ${d}`} e`, big = 10n ** 2n, h = .5e-3 + 0xFF + 1_000
if (a) b(); else if (c) d(); else { e() }
for (var i = 0, j; i < 10; i++, j--) {} for (const k in o) if (k) continue; for (const [k, v] of m) break; for await (const q of r) ; for (;;) break
label: while (a) { do b(); while (c) break label }
switch (a) { case 1: case 2: b(); break; default: c() }
try { a() } catch { b() } finally { c() } try { a } catch ({ message }) { throw new Error(`x: ${message}`) }
a?.b?.[c]?.(d) ?? (e || f); delete a.b, void 0, typeof c === 'x'; a ||= b; c **= 2; new Foo; new (bar())(); new.target
const { a: { b: bb } = {}, ...others } = obj; [x, y] = [y, x]; ({ a, b = 1 } = c)
!function () { return }(); (() => {})(); (async () => { for (const a of await b) await c })()
var async = 1, of = 2, get = 3; async(); let fn = function named() {}; x = y
++z
a = b;
/re/.test(c)
const o2 = { async *gen() {}, async m() {}, if: 1, class: 2, get: 3, set() {} }; if (a) function q() {}
'''
TYPED = '''
import type { A, B as C } from './a'; import { type D, E } from './b'; import F = require('f'); export type { G } from './g'
declare module 'x' { export function f(a: number): string; const y: unique symbol } declare global { interface Window { z?: any } }
export abstract class H<T extends object = {}, K extends keyof T = keyof T> extends I<T> implements J, L<K> {
  private readonly a: Map<string, Array<T[]>> = new Map<string, Array<T[]>>(); static b?: number; c!: string; declare d: any; [key: string]: unknown
  constructor(private readonly e: string, public f?: number, @Inject() g = 1) { super() }
  protected abstract m(): void; async n<U>(this: H<T>, x: U, ...rest: U[]): Promise<U | null> { return x as U } get o(): number { return 1 } set o(v) {} static async *p(): AsyncIterable<number> { yield 1 }
  q(x: string): x is string; q(x: any): asserts x is string; q(x: any) {}
}
interface M<T> extends N, O<T> { readonly a: string; b?(): void; new (x: number): M<T>; (y: string): void; [i: number]: T; get c(): number; method<U>(u: U): u is U; d: typeof import('x') }
type P = { readonly [K in keyof T as `get${Capitalize<K>}`]?: T[K] } & Partial<Q> | 'a' | 1 | -1 | null | undefined | `x${string}`
type R<T> = T extends (infer U)[] ? U : T extends (...args: infer A) => infer B ? [A, B] : never; type S = [a: string, b?: number, ...c: boolean[]]; type V = (a: number, b?: string) => void; type W = new () => object; type X = abstract new (...a: any[]) => any
enum Y { A, B = 'b', C = 1 << 2 } const enum Z { A = 1 } namespace AA.BB { export const x = 1 }
let a = <T,>(x: T): T => x, b = (y as any)!.z!, c = obj satisfies Foo, d: number | undefined, e = f<string>(g), h = new Map<string, number>(), i = <any>j
export const k = async <T extends U>(l: T, { m, n }: { m: string; n?: number }): Promise<void> => {}
function o(this: Window, p?: string, ...q: number[]): void {} function over(a: string): void; function over(a: any) {}
@Component({ selector: 'x' }) export class DD { @Input() a: string; @HostListener('x', ['$event']) on(e: Event) {} }
for (const r of s as T[]) {} if (a < b && c > d) {} const t = a < b, u = (c > d); export default interface EE {} export = FF; let type = 1, as = 2; type = 3; abstract class GG {} let v: (string | number)[] = [], w2: Array<{ a: 1 }>
export async function x2(): Promise<Record<string, (a: number) => Promise<void>>> { return {} } const z2 = cond ? (a) : (b); const y2 = cond ? (a): number => 1 : 2
'''
PYTHON = '''
"""doc"""
from __future__ import annotations
import a.b as c, d
from . import e
from ..f import (g as h, i,)
@dec(1)
@x.y
class A(B, metaclass=M, **kw):
    x: int = 1; y: str
    async def f(self, a, /, b: int = 1, *args: str, c, d=2, **kw) -> dict[str, int]:
        async with a as b, c() as (d, e): pass
        async for i, *j in k: yield i
        else: await z
        return *a, 1
    def g[T: int, *Ts, **P](x: T = lambda *a, b=1, **k: (a, b)) -> None: ...
type Z[T] = list[T]
def h(*, a): global q; nonlocal_ = 1; del a[0], b.c
if (n := len(a)) > 10 and not b or c is not None and d not in e: pass
elif x: pass
else:
    while True:
        try: raise E from None
        except* (A, B) as e: break
        finally: continue
for x in 1, 2, *y: print(x, end="", sep='')
with (open(a) as f, b as g,): pass
with (a): pass
with (yield_()) as f, b: pass
match x:
    case 1 | -2.5 | "a" "b": pass
    case [a, *rest] if a: pass
    case {"k": v, **r}: pass
    case Point(x=0, y=_) as p: pass
    case (a.b): pass
    case _: pass
match = case = type = 1
match[1] = print(match)
x = y = z, *w = [i async for i in j if k if l], {a: b for a, b in c}, {1, *d}, {**e, "f": 1}, (g for g in h), ()
a[1:2, ::3, ...] += b if c else lambda: d
f"{a!r:>{w}} {b['c']} {{}}" ; rb"x" ; r'\\d' ; """a
b"""
x = 0xFF + 0o17 + 0b1 + 1_000 + 1e-3j + .5 + 5. + 00
assert a, b; print(*a, **b, c=1); (yield); x = yield y; a @ b ** -c // d << 1
if x:
\tpass
x = a \\
    + b
lambda: (yield)
'''
GOOD = {"java": JAVA, "kotlin": KOTLIN, "javascript": SCRIPT, "typescript": TYPED, "python": PYTHON}


@pytest.mark.parametrize("language", GOOD)
def test_programs_parse(language):
    text = GOOD[language]
    if language == "python":
        ast.parse(text)
    found = S.failure(text, language)
    assert found is None, (found, text[max(0, found[0] - 60) : found[0]], "@@", text[found[0] : found[0] + 30])
    assert S.failure("", language) is None
    assert S.failure(text.replace("\n", "\r\n"), language) is None


BAD = {
    "java": ["class A { void f() { return } }", "class A { int x = ; }", "class A { void f() { if x > 1 { } } }", "class A {", "class A { String s = \"a; }", "x = 1;", "class A { void f() { a + b; } }", "class A { void f() { f(; } }", "package a", "class A { void f() { int 3x; } }", "class A { char c = ''; }"],
    "kotlin": ["fun f( {", "val x = ", "class A { fun }", "fun f() { when (x) { 1 > 2 } }", "val s = \"a", "int x = 1;", "fun f() { val a b = 1 }", "fun f() { if x { } }", "public void f() {}", "fun f() = 1 2"],
    "javascript": ["let = = 1", "function f( {", "const x = {a: 1,, b}", "if (a { }", "return }", "class A { x y z( }", "a b", "const s = 'abc", "x = `a ${b`", "let x: number = 1", "for (let i = 0; i < 3) {}", "export const inspect: string = 'x';", "var a = [1, 2"],
    "typescript": ["let x: = 1", "interface A { a: }", "type A = ", "function f(a: string { }", "class A { private }; x y", "enum A { B C }", "let x = <T>(", "const a: Array<string = []"],
    "python": ["def f(:\n    pass", "if x\n    pass", "x = (1", "print 'a'", "def f():\npass", "  x = 1", "f(a=1, b)", "x = 'a", "for x in: pass", "a = 1 +", "1abc", "def f(a=1, b): pass", "class A:\n    x\n   y", "try:\n    x\n", "x = 01", "f() = 1", "import a.", "with open(x) as: pass", "else: pass", "x = {a: 1, b}", "if x:\n\ty\n        z"],
}


@pytest.mark.parametrize("language", BAD)
def test_broken_texts_do_not(language):
    for text in BAD[language]:
        if language == "python":
            with pytest.raises(SyntaxError):
                ast.parse(text)
        assert S.failure(text, language) is not None, text


def test_names_like_kinds_of_tokens():
    assert S.failure("class A { int STRING = B.NUMBER, NAME; }", "java") is None
    assert S.failure("STRING = NEWLINE + INDENT\n", "python") is None
    assert S.failure("const REGEX = TEMPLATE / HEAD / 2, x = TAIL;", "javascript") is None


def test_position_and_cause():
    at, what = S.failure("class A {\n  int x = ;\n}", "java")
    assert (at, what) == (20, "unexpected token")
    marked = "def f():\n    a\n<<<<<<< HEAD\n    b\n=======\n    c\n>>>>>>> x\n"
    at, what = S.failure(marked, "python")
    assert S.cause(marked, "python", at, what) == "merge conflict"
    cut = "class A { void f() { x("
    assert S.cause(cut, "java", *S.failure(cut, "java")) == "cut off"
    assert S.cause("def f(x):\n    return x\n", "java", *S.failure("def f(x):\n    return x\n", "java")) == "another language"


def test_long_texts_and_bracket_memory():
    body = "".join(f"void f{i}(int a) {{ int[] x = {{1, 2}}; g(a, (b) -> b + {i}); }}\n" for i in range(3000))
    assert S.failure(f"class A {{ {body} }}", "java") is None
    assert S.failure(f"class A {{ {body} void g() {{ f(; }} }}", "java") is not None
    assert S.failure("x = [" + "1, " * 50_000 + "]", "python") is None
    assert S.failure("var a = " + "(" * 300 + "1" + ")" * 300, "javascript") is None


@pytest.mark.parametrize("text", [
    'f"{1 +}"', 'f"{a!r:>{w}}"', "f'{x[\"a\"]}'", 'f"{x["a"]}"', 'f"{x = !r:^20}"', 'f"{{}}"', 'f"{}"', 'f"}"', 'f"{a"', 'rf"\\{a}"', 'f"""{\na # c\n}"""', 'f"{lambda x: 1}"', 'f"{(lambda x: 1)}"',
    'f"{a != b}"', 'f"{f"{f"{1}"}"}"', 'f"{f"{f"{1 +}"}"}"', 'f"{a:{b}.{c}f}"', 'f"a" "b" f\'{c}\'', 'f"{*a, b}"', 'f"{a!x}"', 'f"{ {1:2}[1] }"', 'f"{a:=5}"', "f'\\''", 'f"{a}}"', "fx = rf = f",
])
def test_python_templates_as_python_itself_sees_them(text):
    try:
        ast.parse(text)
        parses = True
    except SyntaxError:
        parses = False
    assert (S.failure(text + "\n", "python") is None) == parses


@pytest.mark.parametrize("text, parses", [
    ('"${1 + }"', False), ('"${a}"', True), ('"$a $ b"', True), ('"${a.map { it + "x${b}" }}"', True), ("\"\"\"a ${b} \"c\" \"\"\"", True), ('"${}"', False), ('"${"${"${x}"}"}"', True),
    ('"${"${"${x +}"}"}"', False), ('"${if (a) "b" else "c"}"', True), ('"${a"', False), ("\"${a['\\\"']}\"", True),
])
def test_kotlin_templates(text, parses):
    assert (S.failure(f"val s = {text}\n", "kotlin") is None) == parses


@pytest.mark.parametrize("depth", [500, 3_000, 9_000])
def test_nesting_decides_nothing(depth):
    nested = lambda inside: "class A { int a = " + "(" * depth + inside + ")" * depth + "; }"
    assert S.failure(nested("1"), "java") is None
    assert S.failure(nested("1 +"), "java") == (18 + depth + 3, "unexpected token")
    chain = "class A { void f() { " + "if (a) b(); else " * depth
    assert S.failure(chain + "c(); } }", "java") is None and S.failure(chain + "c() } }", "java") is not None


def test_jsx_gets_no_verdict(spark):
    rows = [(1, "R", "a.jsx", "const a = <p className='x'>hi there</p>;"), (2, "R", "b.tsx", "const a: number = ;"), (3, "R", "c.tsx", "const a: number = 1;"), (4, "R", "d.js", "const a = <p>hi there</p>;")]
    df = spark.createDataFrame(rows, "source_id long, repository_id string, file_path string, raw_source string")
    assert {(r.source_id, r.parses, r.cause) for r in S.checked(df).collect()} == {(1, None, "JSX"), (2, False, "unexpected token"), (3, True, None), (4, False, "unterminated literal")}
    assert {r.source_id for r in S.invalid(df).collect()} == {2, 4}
    assert {(r.language, r.files) for r in S.rates(df).where("cause is null").collect()} == {("typescript", 2), ("javascript", 1)}


def test_tables(spark):
    rows = [(1, "R", "a.py", "x = 1"), (2, "R", "B.PY", "x ="), (3, "R", "c.py", None), (4, "R", "d.py", ""), (5, None, "e.java", "class"), (6, "R", "f.txt", "x ="), (7, "R", None, "x ="), (2, "R", "b.py", "x =")]
    df = spark.createDataFrame([(*r, True) for r in rows], "source_id long, repository_id string, file_path string, raw_source string, parses boolean")
    assert sorted(r.source_id for r in S.invalid(df).collect()) == [2, 2, 5]
    rates = {(r.repository_id, r.language, r.cause): (r.files, r.failed, r.rate) for r in S.rates(df).collect()}
    assert rates["R", "python", None] == (4, 2, 0.5) and rates[None, "java", None] == (1, 1, 1.0) and rates["R", "python", "unexpected token"] == (4, 2, 0.5)
    assert S.rates(df.limit(0)).count() == 0


GOOD_JSX = [
    "const a = <p className='x'>don't / stop {name} \u00e9 &gt; // no comment</p>;",
    "export default () => <><A.B c:d='1\n2' {...p} e={f(<G/>)} h=<i/> j /> {/* none */} {...list}{}</>;",
    "function f() { return (\n  <ul>{xs.map(x => <li key={x.id}>{x.a < 3 && x.b > 2 ? <b>{`${x}`}</b> : null}</li>)}</ul>\n); }",
    "if (a < b && c > d) <div/>;\nconst r = /<p>/.test(s) ? y : z / 2;",
    "const x = a <b && c> d; const y = <a-b c-d={1} /* n */ // m\n/>.type;",
]
BAD_JSX = [
    "const a = <p>hi</q>;", "const a = <p>hi;", "const a = <p>{}}</p>;", "const a = <p>a > b</p>;", "const a = <p b={}/>;", "const a = <p b=c/>;", "const a = <p {b}/>;",
    "const a = <p>{x +}</p>;", "const a = <p/> <q/>;", "const a = <p {...b, c}/>;", "const a = <></p>;", "const a = <p>{x</p>;", "return (<div>\n<b></div></b>);", "const a = <p>hi</p>; const b = ;",
]


def test_elements_of_jsx_are_parsed():
    for lang in ("javascript", "typescript"):
        assert [t for t in GOOD_JSX if S.failure_with_elements(t, lang) is not None] == []
        assert [t for t in BAD_JSX if S.failure_with_elements(t, lang) is None] == []
    good = ["const f = <T,>(x: T) => <A<T[]> v={x as any}>{x}</A>;", "const g = <T extends U>(x: T): JSX.Element => <p/>;", "let h: <T>(x: T) => T; const e = <p/>;", "interface I { type: string; <T>(x: T): T }\nconst e = (a as Map<string, () => void>) && <p/>;"]
    assert [t for t in good if S.failure_with_elements(t, "typescript") is not None] == []
    assert S.failure_with_elements("const f = <A<T |> v={1}/>;", "typescript") is not None and S.failure_with_elements("const f = <A<T> v={1}/>;", "javascript") is not None
    deep = "<a b={" * 3000 + "1" + "}/>" * 3000
    assert S.failure_with_elements(f"x = {deep};", "javascript") is None and S.failure_with_elements(f"x = {deep[:-2]};", "javascript") is not None


def test_broken_files_of_jsx_are_found_and_valid_ones_count(spark):
    rows = [(1, "R", "a.jsx", GOOD_JSX[0]), (2, "R", "b.jsx", "const a = 1;\nconst b = <p>hi</q>;"), (3, "R", "c.tsx", "const a = <p>{x +}</p>;"), (4, "R", "d.jsx", "const a = 1;"), (5, "R", "e.tsx", GOOD_JSX[1])]
    df = spark.createDataFrame(rows, "source_id long, repository_id string, file_path string, raw_source string")
    assert {r.source_id for r in S.invalid(df).collect()} == {2, 3}
    assert {r.source_id: r.line_no for r in S.checked(df).where("not parses").collect()} == {2: 2, 3: 1}
    assert {(r.language, r.files, r.failed) for r in S.rates(df, elements=True).where("cause is null").collect()} == {("javascript", 3, 1), ("typescript", 2, 1)}


ODD = {
    "java": ["int a = 1 / 2; // it's\n/* \"*/ x.y(.5f, 1., 0x1p3);", "a = 3x;", "a = 'xy';", "a = \"b", "a /* b", "f(;", "s = \"/*\";", "été = café;", "a = 1 ²;"],
    "kotlin": ["val a = b as? C; a !in c && d !is E; !inner; !in²", "f(\n a,\n b { c\n d }\n)\n[\n1]\n", '"${a}" + "${a b}"', '"a ${b.c(1)} \\${d" + "$e"', '"${"x"}"', "1..2; 1.5.f(); `a b`"],
    "javascript": ["a = b / 2 / c; d = /[/\"]/g; return /x/.test(y) / 2", "a = b\n/re\"/", "x = `a ${b + 'c'}\n${\nd\n} \\${e}`", "x = `${a ? `b` : {}}`", "x = `${(}`)", "x = `a ${b", "#!x\na.#b; 5x", "a = c => /d'/", "(a) /b/ c", "x = y++ /z/ 2"],
    "typescript": ["let a: b<c[]> = d! / e; f = <g>h", "type A = `x${string}`"],
    "python": [
        "if a:\n\tb\n\n  # c\n\td(e,\n f)\ng\n", "if a:\n    b\n  c\n", "a = \\\n  b\n\\\nc\n", "a \\", "f\"{a}{b.c[0]!r}\" f'{d:>3}{{}}' rb'' F\"x\\n\"", "f'{a b}'", "f'{if}'", "print'a'", "a = '''b\\'''c'''\n# '''",
        "1if a else 0x", "x = 1\r\nif y:\r\n  z\r\n", "x\ry", "  # a", "", "if a:\n  b\n        \n", "café² = 1",
    ],
}


@pytest.mark.parametrize("language", ODD)
def test_quick_tokens_are_those_of_the_lexers(language):
    texts = [*ODD[language], *BAD[language], *(t for o in GOOD.values() for t in o.split("\n")), *GOOD.values()]
    told = 0
    for text in texts + [t.replace("\n", "\r\n") for t in texts] + [t[: len(t) * 2 // 3] for t in texts]:
        found, whole = quick.tokens(text, language, S._expressions.get(language)), S.tokens_of(text, language)
        if found is not None:
            assert (found.kinds, found.matches, whole.error) == (whole.kinds, whole.matches, None), text
            assert language == "java" or found.breaks == whole.breaks, text
        told += found is not None
    assert told > len(texts)


def test_texts_that_parse_are_cut_in_one_pass(monkeypatch):
    monkeypatch.setattr(lexers, "brackets", None)
    monkeypatch.setattr(lexers, "indented", None)
    texts = {"java": JAVA, "javascript": "const a = `x ${b} y`, c = d / 2, e = /[/]/.test(f)\n", "kotlin": "fun f(a: Int) {\n  val b = a as? C\n  if (b !in c) d\n}\n", "python": "if a:\n    b = '''c'''  # d\n\ne(\n  f)\n"}
    for language, text in texts.items():
        assert S.failure(text, language) is None
    with pytest.raises(TypeError):
        S.failure("class A { int x = ; }", "java")
