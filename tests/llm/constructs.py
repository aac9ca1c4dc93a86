"""Valid and broken constructs of each language."""

GOOD = {
    "rust": [
        'macro_rules! m { ($($x:expr),* $(,)?) => { $($x)* }; }',
        'fn f() { let y = ..; let z = ..=3; let w = 1..; }',
        'union U { a: u8, b: i8 }',
        'fn f() { let p = &raw const y; let q = &raw mut z; }',
        'fn f() { let x = if a { 1 } else { 2 } + 3; }',
        "fn f() -> impl Fn(u8) -> u8 + 'static { move |x| x }",
        "fn f<'a, T: ?Sized + for<'b> Fn(&'b u8), const N: usize>(x: &'a mut [T; N]) where T: Copy, {}",
        'impl<T> Trait for Vec<T> where T: A {}',
        'fn f() { let Some(x) = y else { return; }; }',
        'fn f() { match x { A::B { c, .. } | D(_, ..) if c > 1 => {} 1..=5 => (), [a, .., b] => {}, x @ 1.. => (), &(ref a, mut b) => {} _ => unreachable!(), } }',
        'pub(in crate::a) struct X(pub u8, pub(crate) u16);',
        'extern "C" { fn f(x: i32, ...); static X: u8; }',
        'async fn f() { g().await?; async move { 1 }.await }',
        "fn f() { 'a: loop { break 'a 1; } }",
        'fn f() { let c = || -> u8 { 1 }; let d = |&x: &u8, (a, b)| x; }',
        "type X<'a> = Box<dyn Fn(&'a str) -> Result<(), Box<dyn Error>> + Send + 'a>;",
        'fn f() { x.0.1.y[2](3)?; <T as A>::B::c(); Vec::<u8>::new(); a::<B>::c { d, e: 1, ..f }; }',
        'use a::{self, b::{c as d, *}, e};',
        'const _: () = { assert!(true); };',
        'fn f() { if let Some(x) = a && x > 1 { } while let Ok(_) = b {} }',
        'fn f() { a < b; (a as usize) < b; a as usize + 1; a << 2 >> 3; a >>= 1; a <<= 2; }',
        "trait A: B + 'static { const X: u8; type Y: C where Self: Sized; fn z(&self) -> u8 { 1 } fn w(self: Box<Self>); }",
        'enum E { A = 1, B(u8), C { x: u8 } }',
        '#![allow(x)]\n//! doc\n/// d\n#[derive(A)]\nstruct S;',
        'fn f() { return; } fn g() -> ! { loop {} }',
        'fn f() { for (i, x) in y.iter().enumerate().rev() { } for x in 0..n {} }',
        'fn f(_: u8, [a, b]: [u8; 2], S { x }: S) {}',
        'fn f() { unsafe { *p = 1 }; *q += 1; -x; !y; &mut z; &&w; }',
        'fn f() { #[cfg(a)] let x = 1; #[cfg(b)] { } }',
        'fn f() { let x: [u8; { 1 + 2 }] = [0; 3]; }',
        'impl fmt::Display for A { fn fmt(&self, f: &mut fmt::Formatter<\'_>) -> fmt::Result { write!(f, "{}", 1) } }',
        'fn f() { m! { a } m!(b); m![c]; let x = m!{d}; }',
        'fn f() { a = b = c; a += 1; (a, b) = (1, 2); _ = x; }',
        'fn f() { x as *const u8; x as fn(u8) -> u8; }',
        "static mut X: Option<&'static str> = None;",
        'fn f() { match x { _ => return, } }',
        'pub trait T { fn f() where Self: Sized; }',
    ],
    "javascript": [
        "throw new Error('x')",
        'const t = tag`a ${`b ${`c ${`d ${1}`}`}`}`;',
        '`${f({a:{b:{c:1}}})}`',
        '`a ${x.map((r) => { return `<td>${r}</td>`; }).join("")} b`',
        'label: while (1) continue label',
        'var {a, b: [c, ...d], ...e} = f;',
        '({a, b} = c);',
        '[a, b] = [b, a];',
        'async function* f() { for await (const x of y) yield* x; }',
        'class A extends (B, C) { static async *#p() {} static { } }',
        'if (a) b\nelse c',
        'do x++\nwhile (x < 5)\ny',
        'a = b\n++c',
        'x = function () {}\n;(function () {})()',
        'export default async () => {}',
        "export * as x from 'y'",
        "import a, * as b from 'c'",
        'new.target',
        'async x => await x',
        'let async = 1; async = 2;',
        'a?.b?.[c]?.(d)',
        'x = a ? b : c ? d : e',
        '(a, b) => ({a, b})',
        'for (var i = 0, n = 3; i < n; i++);',
        'switch (a) { case 1: case 2: { } default: }',
        'try {} catch {} finally {}',
        'var get = 1, set = 2, of = 3, static_ = 4',
        'x = /[/]/.test(y) / 2',
        'return_ = 1',
        "import('x').then(() => {})",
        'import.meta.url',
        'var a = 1, b\nvar c',
        'if (x) /re/.test(y)',
        'a = b / c / d',
        'let x = class { }',
        '0, function () {}',
        'x = y\n/z/g',
        'a ||= b; c ??= d; e **= 2',
        '1_000n',
        'delete a.b, void 0, typeof x',
        "'use strict'\nfoo()",
    ],
    "typescript": [
        'const x = f(m.get(id)!);',
        'const a = [1] as const;',
        '@dec class A {}',
        '@dec() export class B { @x() y = 1; }',
        'type A = { [K in keyof T]?: T[K] };',
        'let x = a ? (b) : c => d;',
        "abstract class A<T extends B = C> extends D<T> implements E, F { private readonly x?: string; static y!: number; abstract z(): void; constructor(private a: string, public b?: number) { super(); } get q(): string { return ''; } [k: string]: any; }",
        'function f(this: Foo, x?: number, ...r: string[]): asserts x is string {}',
        "declare module 'x' { export const y: number; }",
        "enum E { A = 1, B, 'c' }",
        'const f = async <T,>(x: T): Promise<T> => x;',
        "export type { A } from './a'; import type B from 'b'; import { type C } from 'c';",
        'let x = <any>y; let z = y satisfies Z; let n = a!.b!.c![0]!;',
        "type X = A extends B ? C : D; type F = (a: number) => void; type G = new (...a: any[]) => object; type T = [a: string, b?: number, ...rest: any[]]; type U = `a${string}b`; type V = typeof import('x'); type W = A['b'][number];",
        'namespace A.B { export const x = 1 }',
        'let f: (x: number) => x is string;',
        'interface A { (x: number): string; new (x: number): A; readonly [k: string]: any; m?(): void; get x(): number }',
        'export default interface X { a: 1 }',
        'for (const [a, b] of Object.entries(x) as [string, number][]) {}',
        'let v = obj?.a?.[0]?.(1) ?? 2;',
        'class A { declare x: number; override y() {} accessor z = 1; static { f(); } }',
        "import fs = require('fs'); export = fs;",
        'let g = f<string>; let h = new Map<string, Array<number>>();',
        'function isX(x: unknown): x is X { return true }',
        'if (a < b && c > d) {}',
        "const x = { async *[Symbol.iterator]() {}, get a() { return 1 }, 'b': 2, 3: 4, c, ...d };",
        'label: for (;;) { break label }',
        'type A = keyof typeof x; let y: unique symbol;',
        'let a: Foo.Bar<Baz>[] = [];',
        'export abstract class A { protected abstract get x(): string; }',
        'function overload(a: string): void\nfunction overload(a: number): void\nfunction overload(a: any) {}',
        'const x = y as unknown as Z<W>;',
        'let x: string | undefined\nlet y = 1',
    ],
    "go": [
        'package a\ntype N interface { ~int | ~string; M() }\n',
        'package a\nfunc F[T any, K comparable](x T, y ...K) (a, b int) { return }\n',
        'package a\nvar x = map[string][]int{"a": {1, 2}, "b": nil}\n',
        'package a\nfunc f() { for i := 0; i < 3; i++ { } ; for range x { } ; for { break } ; for k, v := range m { } }\n',
        'package a\nfunc f() { switch x := y.(type) { case int, []string: z(); case nil: default: } }\n',
        'package a\nfunc f() { select { case x := <-c: case d <- 1: default: } }\n',
        'package a\nfunc (r *R) M(a, b int, c string) (int, error) { go func() { defer g() }() ; return 1, nil }\n',
        'package a\nfunc f() { if v, ok := m[k]; ok { } else if x { } else { } }\n',
        'package a\ntype (\n\tA struct {\n\t\tB\n\t\t*c.D\n\t\te, f int `x`\n\t}\n\tG = int\n)\n',
        'package a\nfunc f() { x, y = y, x; a[1:2:3] = b; p := &T{a: 1}; L: for { goto L } }\n',
        'package a\nvar f func(int, ...string) (<-chan int, error)\n',
        'package a\nconst (\n\tA = iota\n\tB\n)\n',
        'package a\nfunc f() { for _, x := range []int{1, 2} { } ; if x == (T{}) { } }\n',
    ],
}
BROKEN = {
    "rust": [
        'fn f() -> -> u8 {}',
        'fn f() { b * ; }',
        'fn zz(a) {}',
        'fn f() { for in x {} }',
        'fn f() { else }',
        'enum Z { A; B }',
        'fn zz<T(a: T) {}',
        'impl A for for B {}',
        'struct Z { a: i32; b: i32 }',
        'fn zz {}',
        'where T {}',
        'fn f() { let = 3; }',
        'fn f() { match x { a b => 1 } }',
        'fn f() { if { } }',
        'struct A { pub }',
        'fn f() { x.; }',
        'fn f() { let x = ; }',
        'fn f(a: u8 b: u8) {}',
        'use a::{b;',
        'fn f() { a == b == c; }',
        'pub pub fn f() {}',
        'impl {}',
        'fn f() { (1, 2 }',
        'mod a',
        'fn f() { let x: = 1; }',
        'fn f() { return return; ',
        'trait A { fn }',
        'enum { A }',
        'fn f() { while }',
        'fn f() { 1 2 }',
        'let x = 1;',
        'fn f() { a b; }',
        "fn f() { x = 'ab'; }",
        'struct S(a: u8);',
        'type X = ;',
        'const X = 1;',
        'fn f() { ..= }',
        'fn f() { for x y {} }',
        'fn f() { if a { } else b }',
    ],
    "javascript": [
        'while () {}',
        'a => ;',
        'if { }',
        'let x = ;',
        'function () {}',
        'class { }',
        'a b',
        'x = (1, )',
        'f(a b)',
        '{ a: 1, b: 2 }',
        'import fmt',
        'return 1',
        'var 1x',
        'const x;',
        'for (;;',
        'if (a) else b',
        'a.',
        'a..b',
        '[1, 2',
        'x = {a b}',
        'x = {a: }',
        'try {}',
        'switch (a) { b }',
        'class A { x y }',
        'let a = 1 let b = 2',
        'function f( {}',
        'new',
        "import { a b } from 'c'",
        'export { a',
        '1 = x',
        'do x',
        'a ? b',
        'async function',
        'foo(,)',
        'a +',
        '=> x',
        'case 1:',
        'else {}',
        'catch (e) {}',
        "'abc",
        '`abc',
        'x = y z',
        'enum A { B }',
        'interface A {}',
        'let x: number = 1',
        'a as b',
        'type A = B;',
    ],
    "typescript": [
        'let x: = 1;',
        'interface A { a b }',
        'type A = ;',
        'function f(a: ) {}',
        'enum A { B; C }',
        'while () {}',
        'a => ;',
        'if { }',
        'let x: string number;',
        'interface { }',
        'import fmt',
        'f(a b)',
        'const x: Array<string = 1',
        'return 1',
        'class A extends { }',
        'let y = x as ;',
        'function f(): { return 1 }',
        'type A = { a: string b: number }',
        'x = <T>(y',
    ],
    "go": [
        'package a\nwhile () {}\n',
        'package a\nfunc f() { while () {} }\n',
        'package a\nfunc f() { if { } }\n',
        'package a\nimport fmt\n',
        'package a\nfunc f( { }\n',
        'package a\nfunc f() { x := }\n',
        'package a\nfunc f() { a b }\n',
        'package a\nvar\n',
        'package a\ntype T struct { a, }\n',
        'package a\nfunc f() { for i := 0; i < 3 { } }\n',
        'package a\nfunc f() { return 1 2 }\n',
        'package a\nfunc f() { switch { x } }\n',
        'func f() {}\n',
        'package a\nx := 1\n',
        'package a\nfunc f() { a.b := 1 }\n',
        'package a\nfunc f() { f(a\n) }\n',
        'package a\nfunc f() { var x int y }\n',
        'package a\nfunc f() { else { } }\n',
        'package a\nfunc f() { if x { }\nelse { } }\n',
        'package a\nfunc f() { => }\n',
        'package a\nfunc f() { x++ + 1 }\n',
        'package a\nimport "a" "b"\n',
        'package a\nfunc f()\n{\n}\n',
        'package a\nconst x int = \n',
        'package a\nfunc f() { go }\n',
    ],
}
