from strataflow.sources import syntax

PY = '''import os
from a.b import c as d

LIMIT = 5
name = "x"


@deco
class Loader(Base):
    size = -1

    def read(self):
        key = os.getenv("HOME")
        return Parser(key)


def main():
    loader = Loader()
    return loader.read()
'''
TS = "import { x } from './x';\nexport const LIMIT = 7;\nexport class Box {\n  a() {}\n}\nfunction run() {\n  return 1;\n}\n"


def files(spark):
    return spark.createDataFrame([("a.py", "python", PY), ("b.ts", "typescript", TS), ("bad.py", "python", "def f(:\n  x = 1"), ("n.md", "markdown", None), ("t.txt", "unknown", "\n".join(f"line {i}" for i in range(60)))], "path string, language string, text string")


def test_units(spark):
    found = {(r.path, r.symbol): (r.type, r.start_line, r.end_line) for r in syntax.units(files(spark)).collect()}
    assert found[("a.py", "Loader")] == ("class", 8, 14)
    assert found[("a.py", "Loader.read")] == ("method", 12, 14)
    assert found[("a.py", "main")] == ("function", 17, 19)
    assert found[("b.ts", "Box")][0] == "class" and found[("b.ts", "run")][1] == 6
    assert ("bad.py", "f") in found


def test_facts(spark):
    found = {(r.path, r.fact_type, r.symbol, r.value) for r in syntax.facts(files(spark)).collect()}
    assert {("a.py", "constant", "LIMIT", "5"), ("a.py", "string_literal", "name", "x"), ("a.py", "numeric_threshold", "size", "-1"), ("a.py", "environment_variable", "HOME", "os.getenv"), ("a.py", "instantiation", "loader", "Loader"), ("a.py", "implements_interface", "Loader", "Base"), ("a.py", "import", "a.b", "c"), ("a.py", "call_site", "loader.read", "0")} <= found
    assert {("b.ts", "constant", "LIMIT", "7"), ("b.ts", "import", "./x", "import { x } from './x'"), ("b.ts", "exported_symbol", "Box", "export class Box {")} <= found


def test_chunks_fall_back_to_lines(spark):
    rows = syntax.chunks(files(spark)).collect()
    assert {(r.start_line, r.end_line) for r in rows if r.path == "t.txt"} == {(1, 50), (41, 60)}
    assert {(r.start_line, r.end_line) for r in rows if r.path == "a.py"} == {(8, 14), (12, 14), (17, 19)}


RICH_PY = '''import os
PROMPT = "say hi"
names = ["a", "b"]
opts = {"x": 1}
config.timeout = 30
class A(Base):
    def __init__(self, store, *, log):
        self.s = Store(1)
    def run(self, x):
        if not x:
            return None
        try:
            y = x or os.environ["HOME"]
        except E:
            raise
        return self.s.get(y)
__all__ = ["A"]
'''
RICH_TS = """// comment: const no = 5
import { x } from './n'
export const MAX = 5;
const list = [1, "a,b", [2, 3]];
let conf = { timeout: 10, name: 'x' };
const promptText = `be brief`;
export class View extends Base implements Shape {
  constructor(private store: Store, log: Log) {
    this.s = new Store(1);
  }
  run(a: string): void {
    if (!a) { return; }
    const y = a ?? "none";
    try { this.s.get(y) } catch (e) { throw e } finally { done() }
  }
}
const home = process.env.HOME;
"""


def test_all_nineteen_types(spark):
    df = spark.createDataFrame([("a.py", "python", RICH_PY), ("b.ts", "typescript", RICH_TS)], "path string, language string, text string")
    rows = {(r.path, r.fact_type, r.symbol, r.value, r.start_line) for r in syntax.facts(df).collect()}
    assert {x[1] for x in rows} == set(syntax.FACT_TYPES)
    both = {x[1] for x in rows if x[0] == "b.ts"}
    assert set(syntax.FACT_TYPES) - both == {"config_value"}
    assert {
        ("a.py", "list_count", "names", "2", 3), ("a.py", "guard_clause", "not x", "return", 10), ("a.py", "fallback_chain", "try", "try > catch", 12), ("a.py", "environment_variable", "HOME", "os.environ", 13), ("a.py", "dependency_injection", "A", "log", 7),
        ("a.py", "config_value", "config.timeout", "30", 5), ("a.py", "calls_method", "self.s.get", "self.s", 16), ("a.py", "exported_symbol", "A", "__all__", 17),
        ("b.ts", "list_count", "list", "3", 4), ("b.ts", "numeric_threshold", "timeout", "10", 5), ("b.ts", "string_literal", "name", "x", 5), ("b.ts", "fallback_chain", "a", "a > none", 13), ("b.ts", "fallback_chain", "try", "try > catch > finally", 14),
        ("b.ts", "instantiation", "s", "Store", 9), ("b.ts", "implements_interface", "View", "Shape", 7), ("b.ts", "dependency_injection", "View", "store", 8), ("b.ts", "environment_variable", "HOME", "process.env", 17),
    } <= rows
    assert not any(x[2] == "no" for x in rows) and not any(x[1] == "call_site" and x[2] == "run" for x in rows)


def test_units_of_other_languages(spark):
    go = "package x\nfunc (s *T) Run(a int) error {\n  if a { return nil }\n}\ntype T struct {\n a int\n}\n"
    java = "public class A extends B {\n  private int x = 3;\n  public String run(int a) throws E {\n    return foo(a);\n  }\n}\n"
    rust = "pub struct P {\n}\nimpl P {\n  pub fn go(&self) -> u8 {\n    1\n  }\n}\n"
    df = spark.createDataFrame([("a.go", "go", go), ("A.java", "java", java), ("p.rs", "rust", rust), ("v.ts", "typescript", RICH_TS)], "path string, language string, text string")
    found = {(r.path, r.symbol, r.type, r.start_line, r.end_line) for r in syntax.units(df).collect()}
    assert {("a.go", "Run", "function", 2, 4), ("a.go", "T", "class", 5, 7), ("A.java", "A", "class", 1, 6), ("A.java", "A.run", "method", 3, 5), ("p.rs", "P.go", "method", 4, 6), ("v.ts", "View.run", "method", 11, 15), ("v.ts", "View.constructor", "method", 8, 10)} <= found
