"""What code says of itself, read line by line: symbols, decorators, annotations, inheritance, entry points, imports; and what is built on that.

files: (path, content). A line belongs to the nearest declaration; everything is joins and windows over lines, so a repository of any size is
one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.graph import bfs, reversed_, topological_order

PYTHON, SCRIPT = r"\.py$", r"\.(ts|tsx|js|jsx|mjs|cjs)$"
#: Confidence by what an artifact was made from.
CONFIDENCE = {"AST_DERIVED": 1.0, "GRAPH_RESOLVED": 0.90, "FULL_CODE_WITH_GRAPH": 0.85, "FULL_CODE_ONLY": 0.80, "PARTIAL_CODE_WITH_GRAPH": 0.65, "PARTIAL_CODE_ONLY": 0.60, "METADATA_ONLY": 0.50, "NONE": 0.30, "FALLBACK": 0.20}
#: What users say who were told wrong, and how much is blamed by which rule.
CORRECTIONS = ("that's wrong", "incorrect", "not right", "you're wrong", "wrong file", "that's not", "actually it's", "actually it is", "no, it", "that is not correct")
RETRIEVED, NONEXISTENT, NAVIGATED, CORRECTED, CORRECTED_FLOW, PROPAGATED = 0.60, 0.95, 0.80, 0.70, 0.85, 0.50
#: Base classes of background work.
TASK_BASES = ("Worker", "BaseTask", "Task", "CeleryTask")
#: What each artifact is made from.
ARTIFACTS: dict[str, tuple[str, ...]] = {
    "file-structures.json": (), "call-graph.json": ("file-structures.json",), "lexical_map.json": ("file-structures.json",), "import_graph.json": ("file-structures.json",),
    "type_annotation_map.json": ("lexical_map.json",), "decorator_map.json": ("lexical_map.json",), "inheritance_map.json": ("lexical_map.json", "import_graph.json"),
    "call_graph_v1.json": ("lexical_map.json", "import_graph.json", "inheritance_map.json", "type_annotation_map.json"),
    "files.json": ("file-structures.json", "call-graph.json", "lexical_map.json", "import_graph.json", "call_graph_v1.json", "decorator_map.json", "inheritance_map.json", "type_annotation_map.json"),
    "call_graph_v2.json": ("call_graph_v1.json", "lexical_map.json", "import_graph.json", "files.json"),
    "modules.json": ("files.json", "import_graph.json", "inheritance_map.json", "call_graph_v1.json"), "module_understanding.json": ("files.json", "import_graph.json", "inheritance_map.json", "call_graph_v1.json"),
    "concept_map.json": ("files.json",), "entry_points.json": ("lexical_map.json", "decorator_map.json", "inheritance_map.json", "files.json"),
    "behavioral_paths.json": ("call_graph_v2.json", "entry_points.json", "files.json", "module_understanding.json"), "project.json": ("modules.json", "files.json", "file-structures.json", "behavioral_paths.json"),
    "validation_report.json": (), "artifact_dependencies.json": (),
}
#: The artifacts that are made from each source file.
FROM_FILES = ("file-structures.json", "files.json", "lexical_map.json", "import_graph.json")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text), from line 1."""
    return files.select("path", F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


#: Functions of script files by their first line: declared, or a name that an arrow function or a function expression is bound to.
FUNCTIONS = (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=;]*=>|\w+\s*=>)")
_MODIFIERS = r"(?:public|private|protected|static|readonly|async|override|abstract|get|set)\s+"
#: Members of script classes: with a body, bound to an arrow function, with a modifier or as constructor over several lines.
MEMBERS = (
    rf"^\s+(?:{_MODIFIERS})*[*#]?(\w+)\s*(?:<[^>]*>)?\s*\([^;]*\)\s*(?::[^;=]*)?\{{", rf"^\s+(?:{_MODIFIERS})*#?(\w+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^)]*\)[^=;]*=>|\w+\s*=>)",
    rf"^\s+(?:{_MODIFIERS})+[*#]?(\w+)\s*(?:<[^>]*>)?\s*\([^;)]*$", r"^\s+(constructor)\s*\([^;)]*$",
)
#: Words that stand before parentheses and a brace without being a member.
KEYWORDS = ("if", "for", "while", "switch", "catch", "with", "return", "function", "await", "new", "typeof", "do", "else")
#: How many lines a signature may take.
SIGNATURE_LINES = 16


def _first(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(""))


def declared(files: DataFrame) -> DataFrame:
    """symbols(), with `ahead`: the declaration and the lines after it as one line without their comments."""
    text = F.col("text")
    py, ts = F.col("path").rlike(PYTHON), F.col("path").rlike(SCRIPT)
    cls = F.when(py | ts, F.regexp_extract(text, r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 1))
    fun = F.when(py, F.regexp_extract(text, r"^\s*(?:async\s+)?def\s+(\w+)", 1)).when(ts, _first(text, FUNCTIONS))
    member = F.when(ts & (F.col("cls") == "") & (F.col("fun") == ""), _first(text, MEMBERS)).otherwise("")
    lines = files.select("path", F.split("content", "\r?\n", -1).alias("lines")).select("path", "lines", F.posexplode("lines").alias("line", "text")).withColumn("line", F.col("line") + 1)
    rows = lines.withColumn("cls", cls).withColumn("fun", fun).withColumn("member", member).withColumn("member", F.when(F.col("member").isin(*KEYWORDS), "").otherwise(F.col("member"))).where("cls <> '' OR fun <> '' OR member <> ''").withColumn("indent", F.length(F.regexp_extract(text, r"^(\s*)", 1)))
    ahead = F.array_join(F.transform(F.slice("lines", F.col("line"), SIGNATURE_LINES), lambda x: F.regexp_replace(x, r"(?:^|\s)(?:#|//)\s.*$", "")), " ")
    rows = rows.withColumn("ahead", ahead).drop("lines")
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # the last class that starts further left, if no other declaration at its level came since
    outer = F.last(F.when(F.col("cls") != "", F.struct("cls", "indent", "line")), ignorenulls=True).over(above)
    level = F.last(F.when(F.col("indent") == 0, F.col("line")), ignorenulls=True).over(above)
    rows = rows.withColumn("outer", outer).withColumn("level", level)
    inside = (F.col("indent") > 0) & (F.col("indent") > F.col("outer.indent")) & (F.col("outer.line") >= F.coalesce("level", F.lit(0)))
    rows = rows.withColumn("container", F.when(inside, F.col("outer.cls")))
    # members stand at the least indent of what their class holds: deeper lines are statements in their bodies
    least = F.min("indent").over(Window.partitionBy("path", "outer.line", "container"))
    rows = rows.withColumn("least", least).where("member = '' OR (container IS NOT NULL AND indent = least)")
    kind = F.when(F.col("cls") != "", "class").when(F.col("container").isNotNull(), "method").otherwise("function")
    return rows.select("path", "line", kind.alias("kind"), F.concat("cls", F.when(F.col("cls") == "", F.concat("fun", "member")).otherwise("")).alias("name"), "container", F.trim("text").alias("declaration"), "ahead")


def symbols(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, container, declaration): classes, functions and methods by their declarations; a method's container is the class it is indented under.

    In script files names bound to arrow functions are functions, and members with a body, or bound to one, are methods.
    """
    return declared(files).drop("ahead")


def decorators(files: DataFrame) -> DataFrame:
    """(path, line, symbol, symbol_line, decorator, argument, role): decorators with the declaration they stand before."""
    marks = lines_of(files).withColumn("decorator", F.regexp_extract("text", r"^\s*@([\w.]+)", 1)).where("decorator <> ''").select("path", "line", "decorator", F.regexp_extract("text", r"^\s*@[\w.]+\s*\(\s*['\"]?([^'\",)]*)", 1).alias("argument"))
    both = marks.unionByName(symbols(files).select("path", "line", F.lit(None).cast("string").alias("decorator"), F.lit(None).cast("string").alias("argument"), "name"), allowMissingColumns=True)
    below = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    own = both.withColumn("next", F.first(F.when(F.col("decorator").isNull(), F.struct("name", "line")), ignorenulls=True).over(below)).where("decorator IS NOT NULL AND next IS NOT NULL")
    name = F.col("decorator")
    role = F.when(name.rlike(r"(?i)\.(get|post|put|delete|patch|options|head)$"), "route").when(name.endswith(".command"), "command").when(name.contains("on_event") | name.endswith(".on"), "event_handler").when(name.contains("task"), "task").otherwise("other")
    return own.select("path", "line", F.col("next.name").alias("symbol"), F.col("next.line").alias("symbol_line"), "decorator", "argument", role.alias("role"))


def _nested(levels: int) -> str:
    """Text in brackets of any kind that holds brackets up to so many levels deep."""
    plain, group = r"[^()\[\]{}<>=]*", ""
    for _ in range(levels):
        group = rf"[(\[{{<]{plain}(?:(?:=>|={group and '|' + group}){plain})*[)\]}}>]"
    return group


_GROUP, _ROUND = _nested(3), r"[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*"
_RESULT = rf"[^:{{}}()\[\]<>=;]*(?:{_GROUP}[^:{{}}()\[\]<>=;]*)*?"
#: Signatures: what is in the parentheses, and the result's type.
PYTHON_SIGNATURE = rf"^[^(]*\(({_ROUND})\)\s*(?:->\s*({_RESULT}))?\s*:"
SCRIPT_SIGNATURE = rf"^[^(]*\(({_ROUND})\)\s*(?::\s*({_RESULT}))?\s*(?:=>|\{{|;|$)"
#: One parameter: up to a comma that is in no brackets.
PARAMETER = rf"(?:[^,()\[\]{{}}<>=]|=>|=|{_GROUP})[^,()\[\]{{}}<>=]*(?:(?:=>|=|{_GROUP})[^,()\[\]{{}}<>=]*)*"
ANNOTATED = r"^(?:(?:public|private|protected|readonly|override)\s+)*[.*]*(\w+)\??\s*:\s*((?:[^=]|=>)+)"


def annotations(files: DataFrame) -> DataFrame:
    """(path, line, symbol, parameter, type) of annotated parameters, over several lines too; the result's type is under "return".

    Commas in brackets, three deep, do not part parameters. Signatures of more than SIGNATURE_LINES lines, and results that are object
    literals, are left out.
    """
    own = declared(files).where("kind <> 'class'")
    part = lambda k: F.when(F.col("path").rlike(PYTHON), F.regexp_extract("ahead", PYTHON_SIGNATURE, k)).otherwise(F.regexp_extract("ahead", SCRIPT_SIGNATURE, k))
    parts = F.filter(F.transform(F.regexp_extract_all(part(1), F.lit(PARAMETER), 0), lambda x: F.trim(x)), lambda p: p.rlike(ANNOTATED))
    given = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, ANNOTATED, 1).alias("parameter"), F.trim(F.regexp_extract(p, ANNOTATED, 2)).alias("type")))
    back = F.trim(part(2))
    every = F.when(back != "", F.concat(given, F.array(F.struct(F.lit("return").alias("parameter"), back.alias("type"))))).otherwise(given)
    return own.select("path", "line", F.col("name").alias("symbol"), F.explode(every).alias("a")).select("path", "line", "symbol", "a.parameter", "a.type")


def inheritance(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, class, parent, interface, parent_path): bases of classes, and the file of each: the same file, else one that is imported, else the only one that has such a class.

    imports: (src, dst) between files.
    """
    own = symbols(files).where("kind = 'class'")
    names = lambda pattern: F.filter(F.transform(F.split(F.regexp_extract("declaration", pattern, 1), ","), lambda x: F.element_at(F.split(F.regexp_replace(F.trim(x), r"[<\[].*$", ""), r"\."), -1)), lambda x: x.rlike(r"^\w+$"))
    py = F.col("path").rlike(PYTHON)
    parents = F.when(py, names(r"class\s+\w+\s*\(([^)]*)\)")).otherwise(names(r"\bextends\s+([^{]+?)(?:\s+implements\b|\s*\{|$)"))
    shapes = F.when(py, F.array().cast("array<string>")).otherwise(names(r"\bimplements\s+([^{]+?)(?:\s*\{|$)"))
    tag = lambda a, yes: F.transform(a, lambda x: F.struct(x.alias("parent"), F.lit(yes).alias("interface")))
    rows = own.select("path", F.col("name").alias("class"), F.explode(F.concat(tag(parents, False), tag(shapes, True))).alias("p")).select("path", "class", "p.parent", "p.interface").distinct()
    known = own.select(F.col("name").alias("parent"), F.col("path").alias("home")).distinct()
    near = imports.select(F.col("src").alias("path"), F.col("dst").alias("home")).distinct().withColumn("imported", F.lit(True))
    met = rows.join(known, "parent", "left").join(near, ["path", "home"], "left")
    found = met.groupBy("path", "class", "parent", "interface").agg(F.max(F.when(F.col("home") == F.col("path"), F.col("home"))).alias("same"), F.min(F.when(F.col("imported"), F.col("home"))).alias("imported"), F.count("home").alias("n"), F.min("home").alias("only"))
    return found.select("path", "class", "parent", "interface", F.coalesce("same", "imported", F.when(F.col("n") == 1, F.col("only"))).alias("parent_path"))


def entry_points(files: DataFrame, imports: DataFrame, roles: DataFrame) -> DataFrame:
    """(type, path, symbol, line, source, confidence): where a program is entered, by seven detectors; of the same place, name and type the first detector's.

    roles: (path, role); functions of services and orchestrators that run, execute, process or start something are entered too.
    """
    own, text = symbols(files), F.col("text")
    out = lambda rows, kind, name, line, source, confidence: rows.select(F.lit(kind).alias("type"), "path", name.alias("symbol"), F.col(line).alias("line"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    marks, lines = decorators(files), lines_of(files)
    by_mark = lambda role, kind: out(marks.where(F.col("role") == role), kind, F.col("symbol"), "symbol_line", "decorator", 0.95)
    py, ts = lines.where(F.col("path").rlike(PYTHON)), lines.where(F.col("path").rlike(SCRIPT))
    first = lambda rows: rows.groupBy("path").agg(F.min("line").alias("line"))
    classes = inheritance(files, imports).where(F.col("parent").isin(*TASK_BASES)).select("path", F.col("class").alias("container")).distinct()
    methods = own.where("kind = 'method'").where(F.col("name").isin("run", "execute", "process")).join(classes, ["path", "container"], "left_semi")
    services = own.where("kind <> 'class'").where(F.col("name").rlike("^(run|execute|process|start)")).join(roles.where("role IN ('orchestrator', 'service')"), "path", "left_semi")
    qualified = F.concat_ws(".", "container", "name")
    detectors = [
        by_mark("route", "http_route"), by_mark("task", "background_task"),
        out(ts.where(text.rlike(r"createRoot\(|\bReactDOM\.render\s*\(")), "event_handler", F.lit("react_render"), "line", "pattern", 0.85),
        out(ts.where(text.rlike(r"\b(app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"`][^'\"`]+['\"`]")), "http_route", F.lit("<anonymous_route>"), "line", "pattern", 0.90),
        out(first(py.where(text.rlike(r"if __name__ == ['\"]__main__['\"]:"))), "cli", F.lit("__main__"), "line", "pattern", 0.90),
        out(first(ts.where(text.rlike(r"process\.argv|commander|yargs"))), "cli", F.lit("cli_entry"), "line", "pattern", 0.90),
        by_mark("command", "cli"),
        out(methods, "background_task", qualified, "line", "pattern", 0.90),
        by_mark("event_handler", "event_handler"),
        out(ts.where(text.rlike(r"\b(addEventListener|on)\s*\(")), "event_handler", F.lit("<anonymous_event_handler>"), "line", "pattern", 0.90),
        out(services, "service_method", qualified, "line", "file_understanding", 0.75),
        out(own.where("(kind = 'function' AND name LIKE 'test\\_%') OR (kind = 'class' AND name LIKE 'Test%')"), "test", F.col("name"), "line", "naming", 0.70),
    ]
    every = reduce(DataFrame.unionByName, [d.withColumn("_k", F.lit(k)) for k, d in enumerate(detectors)])
    return every.groupBy("type", "path", "symbol", "line").agg(F.min_by(F.struct("source", "confidence"), "_k").alias("b")).select("type", "path", "symbol", "line", "b.source", "b.confidence")


def import_statements(files: DataFrame) -> DataFrame:
    """(path, line, module, names, level, script): import lines; level is the number of leading dots of a Python import."""
    rows = lines_of(files)
    js = F.regexp_extract("text", r"""(?:^|\s)(?:import|export)\s.*?from\s+['"]([^'"]+)['"]|(?:^|\s)import\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""", 0)
    spec = F.regexp_extract(js, r"""['"]([^'"]+)['"]""", 1)
    script = rows.where(F.col("path").rlike(SCRIPT)).where(js != "").select("path", "line", spec.alias("module"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("level"), F.lit(True).alias("script"))
    frm = r"^\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)$"
    py = rows.where(F.col("path").rlike(PYTHON))
    names = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract("text", frm, 3), r"[()#].*$|[()]", ""), ","), lambda n: F.trim(F.split(F.trim(n), r"\s+as\s+")[0])), lambda n: n.rlike(r"^\w+$"))
    from_ = py.where(F.col("text").rlike(frm)).select("path", "line", F.regexp_extract("text", frm, 2).alias("module"), names.alias("names"), F.length(F.regexp_extract("text", frm, 1)).alias("level"), F.lit(False).alias("script"))
    plain = py.where(F.col("text").rlike(r"^\s*import\s+[\w.]+")).select("path", "line", F.regexp_extract("text", r"^\s*import\s+([\w.]+)", 1).alias("module"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("level"), F.lit(False).alias("script"))
    return script.unionByName(from_).unionByName(plain)


def _ascend(path: Column, levels: Column) -> Column:
    """The folder of a path, so many levels up; null above the root."""
    parts = F.split(path, "/")
    keep = F.size(parts) - 1 - levels
    return F.when(keep < 0, F.lit(None).cast("string")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), "/"))


def resolve_imports(statements: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, module, target, kind): import statements with the files they mean.

    A module is the first of its candidates (the file, then the package's own file) that exists; each name of a Python import may be a
    module of the package. What resolves is internal; a script's bare name and a Python module of no folder here are external, the rest unresolved.
    """
    known = files.select(F.col("path").alias("candidate")).distinct()
    up = F.floor(F.length(F.regexp_extract(F.regexp_replace("module", r"^\./", ""), r"^((?:\.\./)*)", 1)) / 3).cast("int")
    tail = F.regexp_replace(F.regexp_replace("module", r"^\./", ""), r"^(\.\./)+", "")
    join = lambda folder, rest: F.when(folder.isNull(), F.lit(None).cast("string")).when(folder == "", rest).when(rest == "", folder).otherwise(F.concat(folder, F.lit("/"), rest))
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    base = F.when(F.col("script") & F.col("module").startswith("."), join(_ascend(F.col("path"), up), tail)).when(F.col("script"), None).when(F.col("level") > 0, join(_ascend(F.col("path"), F.col("level") - 1), dotted)).otherwise(dotted)
    rows = statements.withColumn("base", base)
    bases = F.concat(F.array(F.struct(F.lit(0).alias("part"), F.col("base").alias("b"))), F.transform("names", lambda n, i: F.struct((i + 1).alias("part"), F.concat_ws("/", "base", n).alias("b"))))
    asked = rows.where("base IS NOT NULL AND base <> ''").select("path", "line", "module", "script", F.explode(bases).alias("x"))
    ends = F.when(F.col("script"), F.array(*[F.lit(e) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")])).otherwise(F.array(F.lit(".py"), F.lit("/__init__.py")))
    tried = asked.select("path", "line", "module", F.col("x.part").alias("part"), F.posexplode(F.transform(ends, lambda e: F.concat(F.col("x.b"), e))).alias("place", "candidate"))
    hit = tried.join(known, "candidate").groupBy("path", "line", "module", "part").agg(F.min_by("candidate", "place").alias("target")).select("path", "line", "module", "target").distinct()
    folders = files.select(F.split("path", "/")[0].alias("top")).distinct()
    missing = rows.join(hit.select("path", "line").distinct(), ["path", "line"], "left_anti").withColumn("top", F.split("module", r"\.")[0]).join(folders.withColumn("here", F.lit(True)), "top", "left")
    outside = (F.col("script") & ~F.col("module").startswith(".")) | (~F.col("script") & (F.col("level") == 0) & F.col("here").isNull())
    rest = missing.select("path", "line", "module", F.lit(None).cast("string").alias("target"), F.when(outside, "external").otherwise("unresolved").alias("kind"))
    return hit.withColumn("kind", F.lit("internal")).unionByName(rest)


def import_graph(resolved: DataFrame) -> DataFrame:
    """(src, dst, kind, n): edges between files, and to the modules that are external or not resolved."""
    return resolved.groupBy(F.col("path").alias("src"), F.coalesce("target", "module").alias("dst"), "kind").agg(F.count("*").alias("n"))


#: Weights of the edges of a program graph, and the facts they come from.
EDGES = {"call_site": ("calls", 0.8), "calls_method": ("calls_method", 0.9), "assignment": ("assigns", 0.7), "config_read": ("reads", 0.8), "dependency_injection": ("reads", 0.8), "implements": ("implements_interface", 1.0), "instantiation": ("instantiates", 0.85), "import": ("imports", 0.7), "fallback_chain": ("fallback_to", 0.75)}


def program_graph(units: DataFrame, facts: DataFrame, most: int = 3, most_fallbacks: int = 2) -> DataFrame:
    """(src, dst, type, weight): files and units (unit_id, file_path, symbol, parent_id) with what contains them and what their facts (unit_id, fact_type, symbol) name.

    A named symbol leads to its first `most` definitions by file and unit (fallbacks to `most_fallbacks`), never to the unit itself.
    """
    node = F.concat(F.lit("file::"), F.col("file_path"))
    edge = lambda rows, src, dst, kind, weight: rows.select(src.alias("src"), dst.alias("dst"), kind.alias("type"), weight.alias("weight"))
    parts = [edge(units, node, F.col("unit_id"), F.lit("contains"), F.lit(1.0)), edge(units.where("parent_id IS NOT NULL"), F.col("parent_id"), F.col("unit_id"), F.lit("contains"), F.lit(1.0))]
    kinds = facts.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("fact_type"), F.lit(t).alias("type"), F.lit(w).alias("weight")) for k, (t, w) in EDGES.items()])))
    used = facts.join(F.broadcast(kinds), "fact_type").select("unit_id", "type", "weight", F.lower(F.element_at(F.split("symbol", r"\."), -1)).alias("name")).distinct()
    homes = units.select(F.col("unit_id").alias("target"), "file_path", F.lower(F.element_at(F.split("symbol", r"\."), -1)).alias("name"))
    met = used.join(homes, "name").where("unit_id <> target")
    rank = F.row_number().over(Window.partitionBy("unit_id", "type", "name").orderBy("file_path", "target"))
    found = met.withColumn("_rn", rank).where(F.col("_rn") <= F.when(F.col("type") == "fallback_to", most_fallbacks).otherwise(most))
    parts.append(edge(found, F.col("unit_id"), F.col("target"), F.col("type"), F.col("weight")))
    return reduce(DataFrame.unionByName, parts).distinct()


def call_chain(edges: DataFrame, seeds: DataFrame, depth: int = 8, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """What a function reaches: (node, depth, place) of the `most` nearest nodes, itself included, in topological order, and the edges (src, dst) among them."""
    reach = seeds.select("node", F.lit(0).alias("depth")).unionByName(bfs(edges, seeds, depth).select("node", "depth"))
    kept = reach.orderBy("depth", "node").limit(most)
    inner = edges.select("src", "dst").distinct().join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    return kept.join(topological_order(inner, kept.select("node")), "node"), inner


def flow_entry(nodes: DataFrame, asked: DataFrame, least: int = 2) -> DataFrame:
    """(query, node, score): the function a question (query, terms) starts from.

    nodes: node, name, path, doc, body, entry (boolean), inbound, importance. A term counts 3 in the name, 2 in path and doc, 1 in the body; an
    entry point has 2 more, and each caller one more up to 5. Best scores over `least` first, then entry points, then callers; without one
    the most important entry point, with score 0.
    """
    base = F.when(F.col("entry"), 2).otherwise(0) + F.least("inbound", F.lit(5))
    rows = nodes.withColumn("base", base.cast("int"))
    hits = lambda c, w: F.size(F.filter("terms", lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(t)))) * w
    met = asked.join(rows, F.exists("terms", lambda t: F.contains(F.lower(F.concat_ws("\n", "path", "name", "doc", "body")), F.lower(t))))
    scored = met.select("query", "node", "entry", "inbound", (hits("name", 3) + hits("path", 2) + hits("doc", 2) + hits("body", 1) + F.col("base")).alias("score"))
    key = F.struct((-F.col("score")).alias("s"), (~F.col("entry")).alias("e"), (-F.col("inbound")).alias("i"), F.col("node"))
    # of functions that no term meets the same one is best for all questions
    other = rows.withColumn("score", F.col("base")).agg(F.min_by(F.struct("node", "entry", "inbound", "score"), key).alias("b")).select("b.*")
    every = scored.unionByName(asked.select("query").join(F.broadcast(other)).select(*scored.columns)).where(F.col("score") > least)
    best = every.groupBy("query").agg(F.min_by(F.struct("node", "score"), key).alias("b")).select("query", "b.node", "b.score")
    first = nodes.where("entry").agg(F.min_by("node", F.struct(-F.col("importance"), "node")).alias("node"))
    rest = asked.select("query").join(best, "query", "left_anti").join(F.broadcast(first)).select("query", "node", F.lit(0).alias("score"))
    return best.unionByName(rest).where("node IS NOT NULL")


def artifact_edges(files: DataFrame) -> DataFrame:
    """(src, dst): dst is made from src: the fixed dependencies of the artifacts, and every file's."""
    spark = files.sparkSession
    fixed = spark.createDataFrame([(a, b) for b, own in ARTIFACTS.items() for a in own], "src string, dst string")
    return fixed.unionByName(files.select(F.col("path").alias("src"), F.explode(F.array(*[F.lit(x) for x in FROM_FILES])).alias("dst")))


def artifact_closure(edges: DataFrame, seeds: DataFrame, dependents: bool = True) -> DataFrame:
    """(seed, node, depth): all artifacts made, at any distance, from the seeds (node); or, with dependents False, all they are made from."""
    return bfs(edges if dependents else reversed_(edges), seeds, None)


def rebuild_queue(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact, place, triggers, superseded): requests (artifact, seq, file) in the order to run them: an artifact after those it is made from.

    A later request for an artifact takes the place of the earlier ones and carries their files along.
    """
    own = requests.groupBy("artifact").agg(F.sort_array(F.collect_set("file")).alias("triggers"), (F.count("*") - 1).alias("superseded"))
    order = topological_order(edges, own.select(F.col("artifact").alias("node")))
    return own.join(order, F.col("artifact") == F.col("node")).select("artifact", "place", "triggers", "superseded")


def confidence(quality: Column) -> Column:
    """How sure an artifact is by what it was made from."""
    found = F.lit(CONFIDENCE["FALLBACK"])
    for name, value in CONFIDENCE.items():
        found = F.when(quality == name, value).otherwise(found)
    return found


def corrections(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """(session, at, answer_id, text): messages (session, at, text) that call the session's latest answer (session, at, answer_id) wrong, cut to 200 characters."""
    said = messages.where(F.exists(F.array(*[F.lit(c) for c in CORRECTIONS]), lambda c: F.contains(F.lower("text"), c))).select("session", "at", F.col("text").alias("said"), F.lit(None).cast("long").alias("answer_id"))
    both = said.unionByName(answers.select("session", "at", F.lit(None).cast("string").alias("said"), "answer_id"))
    before = F.last("answer_id", ignorenulls=True).over(Window.partitionBy("session").orderBy("at", F.col("answer_id").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("of", before).where("said IS NOT NULL AND of IS NOT NULL").select("session", "at", F.col("of").alias("answer_id"), F.substring("said", 1, 200).alias("text"))


def recent(events: DataFrame, at: str, as_of: str, hours: int) -> DataFrame:
    return events.where(F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def blame(events: DataFrame, retrieved: DataFrame, concepts: DataFrame, path_files: DataFrame, modules: DataFrame) -> DataFrame:
    """(event_id, artifact_type, artifact_id, score): what is to blame for a bad answer, by the strongest rule for each artifact.

    events: event_id, event_type, nonexistent_path, navigated_to, flow; retrieved: event_id, artifact_type, artifact_id; concepts:
    concept, path; path_files: path_id, file; modules: path, module.
    """
    out = lambda rows, kind, name, score: rows.select("event_id", kind.alias("artifact_type"), name.alias("artifact_id"), F.lit(score).alias("score"))
    used = retrieved.join(events, "event_id")
    kind, name = F.col("artifact_type"), F.col("artifact_id")
    corrected, gone = F.col("event_type") == "corrective_followup", (F.col("event_type") == "cited_nonexistent_file") & F.col("nonexistent_path").isNotNull()
    moved = (F.col("event_type") == "navigation_divergence") & F.col("navigated_to").isNotNull()
    on_path = path_files.select(F.col("path_id").alias("artifact_id"), F.col("file").alias("navigated_to")).distinct()
    rules = [
        out(used, kind, name, RETRIEVED),
        out(events.where(gone).join(concepts, F.col("path") == F.col("nonexistent_path")), F.lit("concept_map"), F.col("concept"), NONEXISTENT),
        out(used.where(gone & (kind == "file_understanding")), kind, name, NONEXISTENT),
        out(events.where(moved), F.lit("file_understanding"), F.col("navigated_to"), NAVIGATED),
        out(used.where(moved & (kind == "behavioral_path")).join(on_path, ["artifact_id", "navigated_to"], "left_anti"), kind, name, CORRECTED_FLOW),
        out(used.where(corrected & (kind == "file_understanding")), kind, name, CORRECTED),
        out(used.where(corrected & F.col("flow") & (kind == "behavioral_path")), kind, name, CORRECTED_FLOW),
    ]
    best = reduce(DataFrame.unionByName, rules).groupBy("event_id", "artifact_type", "artifact_id").agg(F.max("score").alias("score"))
    spread = best.where((F.col("artifact_type") == "file_understanding") & (F.col("score") >= CORRECTED)).join(modules, F.col("path") == F.col("artifact_id"))
    every = best.unionByName(out(spread, F.lit("module_understanding"), F.col("module"), PROPAGATED))
    return every.groupBy("event_id", "artifact_type", "artifact_id").agg(F.max("score").alias("score"))


def architecture_ranking(evidence: DataFrame, most: int = 5) -> DataFrame:
    """(query, kind, name, n, place): components (symbols of communities) and files (of annotations) by how often all evidence names them; `most` files are a reading order.

    evidence: query, source (community, architecture or dependency), file, symbol.
    """
    named = evidence.select("query", F.explode(F.array_compact(F.array("file", "symbol"))).alias("name")).groupBy("query", "name").agg(F.count("*").alias("n"))
    parts = evidence.where("source = 'community' AND symbol IS NOT NULL").select("query", F.lit("component").alias("kind"), F.col("symbol").alias("name")).union(evidence.where("source = 'architecture' AND file IS NOT NULL").select("query", F.lit("file").alias("kind"), F.col("file").alias("name"))).distinct()
    ranked = parts.join(named, ["query", "name"]).withColumn("place", F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.col("n").desc(), "name")))
    return ranked.where((F.col("kind") == "component") | (F.col("place") <= most)).select("query", "kind", "name", "n", "place")


def daily_brief(changes: DataFrame, communities: DataFrame, annotations: DataFrame, notes: DataFrame, since: str) -> DataFrame:
    """(file, change_type, commits, community, stale, notes) of every file changed since the last session: its newest change, its community (by the end of its path), whether its annotation is older, and how many notes name it.

    changes: file, change_type, sha, at; communities: member, community; annotations: file, annotated_at; notes: note, file.
    """
    new = changes.where(F.col("at") > F.lit(since).cast("timestamp_ntz")).groupBy("file").agg(F.max_by("change_type", F.struct("at", "sha")).alias("change_type"), F.count_distinct("sha").alias("commits"), F.max("at").alias("at"))
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    own = new.select("file", tail(F.col("file")).alias("t")).join(communities.withColumn("t", tail(F.col("member"))), "t").where(F.endswith("file", "member") | F.endswith("member", "file")).groupBy("file").agg(F.min("community").alias("community"))
    old = annotations.groupBy("file").agg(F.max("annotated_at").alias("annotated_at"))
    said = notes.groupBy("file").agg(F.count_distinct("note").alias("notes"))
    rows = new.join(own, "file", "left").join(old, "file", "left").join(said, "file", "left")
    return rows.select("file", "change_type", "commits", "community", F.coalesce(F.col("annotated_at") < F.col("at"), F.lit(False)).alias("stale"), F.coalesce("notes", F.lit(0)).alias("notes"))
