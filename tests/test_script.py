"""Tokens, declarations and imports of scripts against expectations made by hand."""

from __future__ import annotations

import pytest

from loomline.functions.script import Script, tokens
from loomline.operators import symbols


def declared(text, tsx=False):
    return [(n, k, line) for n, k, line, *_ in Script(text, tsx).declarations(tsx)]


def imported(text, jsx=False):
    return Script(text, jsx).imports()


def test_templates_in_templates():
    src = "const a = `x ${b ? `y ${c} }` : '`'} z`;\nexport function g() {}\nconst d = `\\` ${ { e: `f` } } function no() {}`\nclass H {}\n"
    assert declared(src) == [("a", "variable", 1), ("g", "function", 2), ("d", "variable", 3), ("H", "class", 4)]


def test_imports_in_strings_and_comments():
    src = "const s = \"import x from 'no'\";\nconst t = `\nimport y from 'no'\n${require('yes')}`\n// import 'no'\n/* import 'no'\n */\nimport z from 'z';\nconst r = /require('no')/;\nfoo.require('no'); new require('no'); foo.import('no');\n"
    assert imported(src) == [("yes", "require"), ("z", "import")]


def test_all_kinds_of_imports():
    src = "import a, { b as c, type D } from \"./a\"\nimport * as e from 'e'\nimport type { F } from './f';\nimport 'side'\nimport {\n  g,\n  h\n} from 'g'\nexport * from './h'\nexport * as i from './i'\nexport { j } from './j'\nexport type { K } from './k'\nexport { l }\nconst m = await import('./m'), n = require('n'), o = import(`no`)\nimport p = require('no')\nimport.meta.url\nexport const from = 'no'\ndeclare module 'q' { import r from 'r' }\nrequire('a b', 1); require(x); require(`no`)\n"
    assert imported(src) == [("./a", "import"), ("e", "import"), ("./f", "import"), ("side", "import"), ("g", "import"), ("./h", "export-from"), ("./i", "export-from"), ("./j", "export-from"), ("./k", "export-from"), ("./m", "dynamic-import"), ("n", "require"), ("r", "import"), ("a b", "require")]


def test_markup():
    src = "import React from 'react'\nexport const App = () => (\n  <div title='import \"no\"' on={() => import('./lazy')}>\n    it's class Foo {'{'} {list.map(x => <li key={x}>{`${x}`} const no = 1</li>)} function no() {\"}\"}\n    <></>\n    <Self.Closing a={<b/>} />\n  </div>\n)\nexport function Other<T,>(x: T) { return <p>don't</p> }\nconst low = <T,>(x: T) => x\nclass Last {}\n"
    assert declared(src, True) == [("App", "component", 2), ("Other", "component", 9), ("low", "variable", 10), ("Last", "class", 11)]
    assert imported(src, True) == [("react", "import"), ("./lazy", "dynamic-import")]


def test_variables():
    src = "export const a: Map<string, number> = new Map<string, number>(), b = 1, { c } = d, [e] = f, g = x < y, h = z > 1\nlet i = function () { const no = 1 }\nvar j: { k: string, l: number } = { k: '', l: 1 },\n  m\nconst n = p\n  .q(r, s)\n  + t\nlet u\nlet v = (w, x) =>\n  w\nconst enum Y { A, B }\nlet z = a / b, aa = c / d; const bb = /[/]'/.test(s), cc = 2\n"
    names = [("a", 1), ("b", 1), ("g", 1), ("h", 1), ("i", 2), ("j", 3), ("m", 4), ("n", 5), ("u", 8), ("v", 9), ("Y", 11), ("z", 12), ("aa", 12), ("bb", 12), ("cc", 12)]
    assert [(n, line) for n, _, line in declared(src)] == names


def test_statements():
    src = "@dec({ a: 1 })\nexport abstract class A<T extends { b: string }> extends B<{ c: number }> implements D, E {\n  x = 1\n}\nexport default async function f(): Promise<{ g: number }> { return h }\nexport default class {}\ndeclare function i(x: string): void\ndeclare function i(x: number): { y: 1 }\nexport type J =\n  | 'k'\n  | { l: string }\ntype M<T> = T\ninterface N { o(): void }\nnamespace P { export const no = 1 }\ndeclare global { interface No {} }\nif (q) { class No {} } else { function no() {} }\nlabel: for (const no of r) { let no = 1 }\nexport = s\nexport { t }\ntype\ninterface\nenum U { V = 'w' }\nasync function* x() {}\nconst y =\n  class Z {}\nfoo(function no() {})\nabstract class AA {}\n"
    assert declared(src) == [("A", "class", 1), ("f", "function", 5), ("i", "function", 7), ("i", "function", 8), ("J", "type", 9), ("M", "type", 12), ("N", "interface", 13), ("U", "enum", 22), ("x", "function", 23), ("y", "variable", 24), ("AA", "class", 27)]
    told = {n: (out, later, p) for n, _, _, out, later, p in Script(src, False).declarations(False)}
    assert told["A"] == (True, False, 7) and told["f"] == (True, True, 7) and told["N"] == (False, False, 5) and told["x"] == (False, True, 3) and told["AA"] == (False, False, 5)


def test_methods():
    src = "class A {\n  static { const no = () => {} }\n  constructor(private a: string) { super() }\n  get b() { return 1 }\n  set b(v) {}\n  static async *c<T>(x: T): AsyncIterable<{ d: T }> { if (x) { e() } }\n  @dec() private f?(): void;\n  'g h'() {}\n  [Symbol.iterator]() { return { no() {} } }\n  #i() {}\n  j = () => { no() }\n  k = (l): l is M => true\n  readonly n: Map<string, () => void> = new Map()\n  async\n  o() {}\n  get() {}\n  static() {}\n  p(): void\n  [key: string]: any\n  5() {}\n  q = `${function no() {}}`; r() {}\n}\n"
    assert [(n, line) for n, k, line in declared(src) if k == "method"] == [("A.c", 6), ("A.f", 7), ("A.'g h'", 8), ("A.[Symbol.iterator]", 9), ("A.#i", 10), ("A.o", 15), ("A.get", 16), ("A.static", 17), ("A.p", 18), ("A.5", 20), ("A.r", 21)]
    assert {n: later for n, k, _, _, later, _ in Script(src, False).declarations(False) if k == "method"}["A.c"]


@pytest.mark.parametrize("text", ["", "`", "`${", "'", "/*", "<div", "<div>{", "class", "class A {", "const", "const a: Map<", "export", "import", "import {", "(((", "}}}", "@", "@a(", "function", "a\\", "#", " ", "<", "export default", "type A<", "let a = <"])
def test_what_is_not_closed(text):
    for jsx in (False, True):
        for more in ("", "\n" + text, " x"):
            own = Script(text + more, jsx)
            own.declarations(jsx), own.imports()


def test_places():
    text = "a\n  'b' /c/ // d\n`e\n${f}`"
    assert [(t.kind, t.line, t.fresh) for t in tokens(text, False)] == [("word", 1, True), ("string", 2, True), ("/", 2, False), ("word", 2, False), ("/", 2, False), ("template", 3, True), ("${", 4, True), ("word", 4, False), ("}", 4, False), ("template", 4, False)]


def test_files(spark, monkeypatch):
    df = spark.createDataFrame([("a.ts", "import x from './x'\nexport const a = 1"), ("b.tsx", None), ("c.js", "const q = require('q')"), ("d.py", "import os"), ("e.ts", "export function g() {}")], "path string, text string")
    assert {(r.path, r.name) for r in symbols.typescript_symbols(df).collect()} == {("a.ts", "a"), ("e.ts", "g")}
    assert {(r.path, r.source, r.kind) for r in symbols.script_imports(df).collect()} == {("a.ts", "./x", "import"), ("c.js", "q", "require")}
    assert symbols.failures(df).count() == 0
    assert symbols.parse(None, ".ts")[2].startswith("TypeError")
