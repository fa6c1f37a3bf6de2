"""Symbols, annotations and entry points of small files, by hand."""

from strataflow.operators import comprehension as op

SCRIPT = """export abstract class Queue<T> extends Base implements Shape {
    private items: Map<string, T[]> = new Map();
    constructor(private readonly size: number, name = 'q') {
        super();
        if (size > 0) {
            this.note = (x: number) => x;
        }
    }
    static async *walk<K>(from: K, by: (k: K) => K): AsyncIterator<K> {
        for (const x of [from]) {
            yield x;
        }
    }
    get length(): number { return 1; }
    onDone = async (code: number, why?: 'a' | 'b'): Promise<void> => {
    };
    private load(
        path: string,  // where, and when
        options: { deep: boolean, names: Record<string, number> } = {},
        ...rest: string[]
    ): Record<string, Array<[number, string]>> {
        return {};
    }
}
export const twice = (n: number) => n * 2;
const plain = x => x;
const notOne = (1 + 2);
export default async function boot(a: string): Promise<void> {
}
class Mailer extends Worker {
    async run(): Promise<void> {
        send();
    }
}
"""
PYTHON = """class Jobs:
    def put(self, item: Dict[str, Tuple[int, List[str]]], wait: float = max(1, 2), *rest: int) -> Optional[Dict[str, int]]:
        return None

async def spread(
    a: int,  # the first, of two
    b: Callable[[int, str], None] = None,
    **more: "Any",
) -> None:
    pass

def bare(a, b=(1, 2)):
    x: int = 3
"""


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def files(spark):
    return spark.createDataFrame([("a/q.ts", SCRIPT), ("a/j.py", PYTHON), ("a/empty.ts", ""), ("a/null.py", None), ("a/notes.md", "class X {\n    run() {\n")], "path string, content string")


def test_symbols_of_scripts(spark):
    found = rows(op.symbols(files(spark)).where("path = 'a/q.ts'"), "kind", "name", "container", "line")
    assert found == {
        ("class", "Queue", None, 1), ("method", "constructor", "Queue", 3), ("method", "walk", "Queue", 9), ("method", "length", "Queue", 14), ("method", "onDone", "Queue", 15), ("method", "load", "Queue", 17),
        ("function", "twice", None, 25), ("function", "plain", None, 26), ("function", "boot", None, 28), ("class", "Mailer", None, 30), ("method", "run", "Mailer", 31),
    }
    assert rows(op.symbols(files(spark)).where("path <> 'a/q.ts'"), "kind", "name") == {("class", "Jobs"), ("method", "put"), ("function", "spread"), ("function", "bare")}


def test_annotations_in_brackets_and_over_lines(spark):
    assert rows(op.annotations(files(spark)), "symbol", "parameter", "type") == {
        ("constructor", "size", "number"), ("walk", "from", "K"), ("walk", "by", "(k: K) => K"), ("walk", "return", "AsyncIterator<K>"), ("length", "return", "number"), ("onDone", "code", "number"), ("onDone", "why", "'a' | 'b'"),
        ("onDone", "return", "Promise<void>"), ("load", "path", "string"), ("load", "options", "{ deep: boolean, names: Record<string, number> }"), ("load", "rest", "string[]"), ("load", "return", "Record<string, Array<[number, string]>>"),
        ("twice", "n", "number"), ("boot", "a", "string"), ("boot", "return", "Promise<void>"), ("run", "return", "Promise<void>"),
        ("put", "item", "Dict[str, Tuple[int, List[str]]]"), ("put", "wait", "float"), ("put", "rest", "int"), ("put", "return", "Optional[Dict[str, int]]"),
        ("spread", "a", "int"), ("spread", "b", "Callable[[int, str], None]"), ("spread", "more", '"Any"'), ("spread", "return", "None"),
    }


def test_tasks_of_script_classes_are_entered(spark):
    imports = spark.createDataFrame([], "src string, dst string")
    roles = spark.createDataFrame([("a/j.py", "service")], "path string, role string")
    found = rows(op.entry_points(files(spark), imports, roles), "type", "symbol", "line")
    assert ("background_task", "Mailer.run", 31) in found and not any(t == "background_task" and s != "Mailer.run" for t, s, _ in found)


def test_signatures_of_any_length_are_read(spark):
    # one long line: no signature pattern may run out of stack or time
    parts = ", ".join(f"p{i}: Map<string, [number, Array<{{ a: string }}>]>" for i in range(2000))
    long = spark.createDataFrame([("m.ts", f"function f({parts}): void {{ return g({'(' * 5000}; }}\n" + "function g(" + "<" * 3000)], "path string, content string")
    assert op.annotations(long).where("symbol = 'f'").count() == 2001
