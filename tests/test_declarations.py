"""Declaration scanner: quoted and nested sources, methods, end lines, no line lost, linear time."""

import ast
import random
import time

from canopy.operators import declarations as dc

TS = r'''import { a } from "x"; // function no() {
const text = "function fake() {";
/* class Gone {
} */
export async function first(a = "}", b = `${ {x: 1}.x } {`): { out: number } {
  if (a) { return /[}/]{/.test(b) ? 1 : 2 }
  function inner() { return '{' }
}
function overload(a: number): void;
@Component({ template: `<p>{{ x }}</p>` })
export default abstract class Store<T extends { id: string }> extends Base implements A, B {
  private items: Map<string, T> = new Map();
  handler = () => { this.run(); }
  count = 1
  constructor(private db: Db) { super({ a: 1 }) }
  @Get("/a}")
  async load<K>(id: K): Promise<{ x: T }> {
    for (const x of []) { class Hidden { no() {} } }
    return await call(`a ${ `b ${ 1 } }` } }`)
  }
  static get size() { return 1 / 2 / 3 }
  #secret() {}
  abstract later(): void;
}
if (x) { function notTop() {} }
const f = function () { return 1 };
function last() {}
'''


def _brief(text, language):
    return [(k, n, o, a, b) for k, n, o, a, b, _ in dc.chunks(text, language)]


def test_bracketed():
    lines = TS.split("\n")
    at = lambda s: next(i for i, x in enumerate(lines) if s in x)
    assert _brief(TS, "typescript") == [
        ("function", "first", None, 4, 7), ("function", "overload", None, 8, 8),
        ("class", "Store", None, 9, at("abstract later") + 1),
        ("method", "constructor", "Store", at("constructor"), at("constructor")),
        ("method", "load", "Store", at("@Get"), at("static get") - 1),
        ("method", "size", "Store", at("static get"), at("static get")),
        ("method", "#secret", "Store", at("#secret"), at("#secret")),
        ("method", "later", "Store", at("abstract later"), at("abstract later")),
        ("function", "last", None, at("function last"), at("function last"))]


MEMBERS = """export default function () { return 1 }
export class A { x = 1; y; get() { return 2 } static { init() } async *gen() {} 'quoted'() {} [computed]() {} 0() {}
  z: { a: number } = { a: 1 }
  opt?: () => void
  m?(): void
  w() {}
}
const g = { f() { } }
label: for (;;) { }
function* gen() { yield /}/ }
async function
two(a: { b: string } | null,
) {
}
type T = { a: string }
interface I { m(): void }
enum E { A }
namespace N { function inner() {} }
export { a }
let q = a
function afterNoSemi() {}
const h = { a: 1 } 
function afterObject() {}
declare function lone(): void
function b2() {}
"""


def test_bracketed_members_without_semicolons():
    assert _brief(MEMBERS, "typescript") == [
        ("function", None, None, 0, 0), ("class", "A", None, 1, 6), ("method", "get", "A", 1, 1), ("method", "gen", "A", 1, 1),
        ("method", "'quoted'", "A", 1, 1), ("method", "[computed]", "A", 1, 1), ("method", "0", "A", 1, 1),
        ("method", "m", "A", 4, 4), ("method", "w", "A", 5, 5), ("function", "gen", None, 9, 9), ("function", "two", None, 10, 13),
        ("function", "afterNoSemi", None, 20, 20), ("function", "afterObject", None, 22, 22), ("function", "lone", None, 23, 23),
        ("function", "b2", None, 24, 24)]


def test_bracketed_never_closed():
    assert _brief("function f() {\n  a(\n\n", "typescript") == [("function", "f", None, 0, 3)]
    assert _brief("}}} )] function f() {}", "typescript")[-1:] in ([], [("function", "f", None, 0, 0)])
    assert _brief("", "typescript") == [] and _brief("`${`${", "typescript") == []


PY = '''"""module
def no(): pass
"""
import os

@decorated("""
class No:
""")
async def first(a="#", b=(1,
2)):
    # def no2():
    return """
def no3():
"""


class A(B):
    """text"""

    x = [
1, 2]

    @property
    def m(self): return 1

    if x:
        def hidden(self): pass

    class Inner:
        def no4(self): pass

    def last(self):
        def inner():
            pass
        return (
1)
    # trailing remark

y = 1
def tail(): pass
'''


def _by_ast(text):
    out = []
    first = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1
    for n in ast.parse(text).body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", n.name, None, first(n), n.end_lineno - 1))
        elif isinstance(n, ast.ClassDef):
            out.append(("class", n.name, None, first(n), n.end_lineno - 1))
            out += [("method", x.name, n.name, first(x), x.end_lineno - 1) for x in n.body
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def test_indented_matches_the_syntax_tree():
    assert _brief(PY, "python") == _by_ast(PY)
    r = random.Random(3)
    pieces = ["def f{}(a='(', b=\"#\"):\n    return [\n0]\n", "class C{}:\n    def m(self):\n        '''\ndef x():\n'''\n\n    z = 1\n",
              "@d(\n1)\nclass D{}: pass\n", "x{} = (\n'def g(): ('\n)\n", "# class no{}:\n", "\n\n", "if 1:\n    def h{}(): pass\n"]
    for _ in range(30):
        text = "".join(r.choice(pieces).replace("{}", str(i)) for i in range(r.randrange(1, 25)))
        assert _brief(text, "python") == _by_ast(text)


def test_indented_library_sources():
    for module in (dc, ast, random):
        text = open(module.__file__).read()
        assert _brief(text, "python") == _by_ast(text)


def test_no_line_lost_and_rows(spark):
    rows = [(1, "typescript", TS), (2, "python", PY), (3, "plain", "def f(): pass"), (4, "python", None), (5, "python", ""),
            (None, "python", "def g():\n  pass"), (2, "python", PY)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, language string, text string, pos string")
    got = dc.declarations(df, rest=True).collect()
    for key, text in ((1, TS), (2, PY), (3, "def f(): pass"), (5, "")):
        parts = [r for r in got if r["file_id"] == key and r["kind"] != "method"]
        parts = sorted(set((r["start_line"], r["text"]) for r in parts))
        assert "\n".join(t for _, t in parts) == text
    assert [r["name"] for r in got if r["file_id"] is None] == ["g"] and not [r for r in got if r["file_id"] == 4]
    assert sum(r["file_id"] == 2 and r["kind"] == "class" for r in got) == 2
    assert dc.declarations(df.limit(0)).collect() == []
    assert dc.declarations(df.where("file_id = 3")).collect() == []


def test_time_is_linear():
    def seconds(text, language):
        t = time.process_time()
        list(dc.chunks(text, language))
        return time.process_time() - t

    for language, text in (("typescript", TS), ("python", PY), ("typescript", "class A { m() {} " * 50),
                           ("typescript", "`${" * 300), ("typescript", "/* \n" * 300), ("python", "'''\n" * 301)):
        small = max(min(seconds(text * 20, language) for _ in range(3)), 0.002)
        assert seconds(text * 160, language) < 8 * small * 5
