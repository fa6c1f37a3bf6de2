"""Units, chunks and facts of source files: Python by its own parser, other languages by regular expressions.

Files are rows (path, language, text). Parsing is per file, in Arrow batches, without a shuffle; a file that does not
parse falls back to lines and patterns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strataflow.functions.session import ship

UNIT = "path string, unit_id string, type string, symbol string, parent string, start_line int, end_line int, content string"
FACT = "path string, fact_id string, fact_type string, symbol string, value string, start_line int, confidence string, method string"
_UNIT = pa.schema([("path", pa.string()), ("unit_id", pa.string()), ("type", pa.string()), ("symbol", pa.string()), ("parent", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])
_FACT = pa.schema([("path", pa.string()), ("fact_id", pa.string()), ("fact_type", pa.string()), ("symbol", pa.string()), ("value", pa.string()), ("start_line", pa.int32()), ("confidence", pa.string()), ("method", pa.string())])

#: The nineteen types of facts.
FACT_TYPES = ("constant", "numeric_threshold", "list_literal", "list_count", "dict_literal", "string_literal", "prompt_template", "config_value", "environment_variable", "fallback_chain", "guard_clause", "dependency_injection", "instantiation", "import", "exported_symbol", "call_site", "calls_method", "implements_interface", "assignment")
SCRIPTS = ("typescript", "javascript")

_MODIFIERS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|pub(?:\([a-z]+\))?|unsafe|inline|const|open|data|suspend)\s+)*"
_DECLARED = re.compile(rf"^[ \t]*{_MODIFIERS}(class|interface|trait|impl|struct|enum|record|object|module|namespace|function|func|fun|fn|def)\b[ \t]*(?:\([^)\n]*\)[ \t]*)?\*?[ \t]*(?:<[^>\n]*>[ \t]*)?([A-Za-z_$][\w$]*)", re.MULTILINE)
_GO_TYPE = re.compile(r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface)\b", re.MULTILINE)
_ARROW = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)\n]*\)\s*(?::[^=\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)", re.MULTILINE)
_METHOD = re.compile(rf"^[ \t]+{_MODIFIERS}(?:[\w<>\[\],.?]+[ \t]+)?(?:get\s+|set\s+)?([A-Za-z_$#][\w$]*)\s*(?:<[^>\n]*>)?\([^;{{}}]*\)\s*(?::\s*[^{{;=]+|throws\s+[\w., ]+|->\s*[^{{]+)?\{{", re.MULTILINE)
_NO_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "with", "new", "throw", "await", "fn", "func", "synchronized", "using", "lock"}
_KINDS = {"def": "function", "func": "function", "fun": "function", "fn": "function", "struct": "class", "enum": "class", "record": "class", "object": "class", "trait": "interface", "impl": "class"}
_CONSTANT = re.compile(r"^\s*(?:export\s+)?(?:const\s+|let\s+|var\s+|final\s+)?([A-Za-z_]\w*)\s*[:=]=?\s*(\"[^\"\n]*\"|'[^'\n]*'|-?\d+(?:\.\d+)?)\s*;?\s*$", re.MULTILINE)
_IMPORT = re.compile(r"^\s*(?:import\s+.*?from\s+['\"]([^'\"]+)['\"]|import\s+([\w.]+)|from\s+([\w.]+)\s+import|#include\s+[<\"]([^>\"]+)[>\"]|use\s+([\w:]+))", re.MULTILINE)
_PROMPT = re.compile("prompt|template|instruction", re.IGNORECASE)


def _masked(text: str) -> str:
    """The text with comments and the insides of strings blanked, place for place."""
    out, at, n = list(text), 0, len(text)
    while at < n:
        two, sign = text[at : at + 2], text[at]
        if two in ("//", "/*"):
            end = text.find("\n" if two == "//" else "*/", at + 2)
            end = n if end < 0 else end + (0 if two == "//" else 2)
            out[at:end] = ["\n" if c == "\n" else " " for c in text[at:end]]
            at = end
        elif sign in "\"'`":
            end = at + 1
            while end < n and text[end] != sign and (sign == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            out[at + 1 : min(end, n)] = ["\n" if c == "\n" else " " for c in text[at + 1 : min(end, n)]]
            at = end + 1
        else:
            at += 1
    return "".join(out)


def _closing(masked: str, at: int, pair: str = "{}") -> int:
    """The place of the bracket that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for k in range(at, len(masked)):
        if masked[k] == pair[0]:
            depth += 1
        elif masked[k] == pair[1]:
            depth -= 1
            if not depth:
                return k
    return len(masked) - 1


def _tree(language: str | None, text: str) -> ast.Module | None:
    if language != "python":
        return None
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _python_units(path: str, text: str, tree: ast.Module) -> Iterator[dict]:
    lines = text.split("\n")

    def visit(node: ast.AST, parent: str) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{parent}.{child.name}" if parent else child.name
                start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent else "function"
                yield {"path": path, "unit_id": f"{path}:{name}:{start}", "type": kind, "symbol": name, "parent": parent or None, "start_line": start, "end_line": child.end_lineno, "content": "\n".join(lines[start - 1 : child.end_lineno])}
                yield from visit(child, name)
            else:
                yield from visit(child, parent)

    yield from visit(tree, "")


def _plain_units(path: str, text: str) -> Iterator[dict]:
    """Declarations by pattern in text without comments and strings; a body ends with its bracket, or before the next declaration where there is none."""
    masked, lines = _masked(text), text.split("\n")
    found = [(m.start(2), m[1], m[2]) for m in _DECLARED.finditer(masked)] + [(m.start(1), "function", m[1]) for m in _ARROW.finditer(masked)] + [(m.start(1), m[2], m[1]) for m in _GO_TYPE.finditer(masked)]
    found = sorted({at: (at, kind, name) for at, kind, name in found}.values())
    spans = []
    for k, (at, kind, name) in enumerate(found):
        after = found[k + 1][0] if k + 1 < len(found) else len(masked)
        brace, end_of = masked.find("{", at), masked.find(";", at)
        if 0 <= brace < after and not 0 <= end_of < brace:
            last = masked.count("\n", 0, _closing(masked, brace)) + 1
        else:
            last = masked.count("\n", 0, after) if k + 1 < len(found) else len(lines)
        spans.append((at, masked.count("\n", 0, at) + 1, last, _KINDS.get(kind, kind), name))
    classes = [x for x in spans if x[3] in ("class", "interface")]
    for m in _METHOD.finditer(masked):
        line = masked.count("\n", 0, m.start(1)) + 1
        if m[1] not in _NO_METHODS and any(a <= line <= b for _, a, b, _, _ in classes) and all(x[0] != m.start(1) for x in spans):
            spans.append((m.start(1), line, masked.count("\n", 0, _closing(masked, m.end() - 1)) + 1, "method", m[1]))
    for _, start, last, kind, name in sorted(spans):
        last = max(start, last)
        outer = [x for x in classes if x[1] <= start and last <= x[2] and (x[1], x[4]) != (start, name)]
        parent = max(outer)[4] if outer else None
        kind = "method" if parent and kind == "function" else kind
        symbol = f"{parent}.{name}" if parent else name
        yield {"path": path, "unit_id": f"{path}:{symbol}:{start}", "type": kind, "symbol": symbol, "parent": parent, "start_line": start, "end_line": last, "content": "\n".join(lines[start - 1 : last])}


def _values(name: str, kind: str, value: str, count: int | None = None) -> Iterator[tuple[str, str]]:
    """(fact type, value) of an assignment of a literal of some kind to a name; every assignment is a fact of its own too."""
    named = name.rsplit(".", 1)[-1]
    if kind == "number":
        yield "numeric_threshold", value
    elif kind == "string":
        yield "string_literal", value
        if _PROMPT.search(name) or "\n" in value:
            yield "prompt_template", value
    elif kind == "list":
        yield from (("list_literal", value), ("list_count", str(count)))
    elif kind == "dict":
        yield "dict_literal", value
    if kind in ("number", "string", "list", "dict") and named.upper() == named and any(c.isalpha() for c in named):
        yield "constant", value
    if kind in ("number", "string", "boolean") and re.search(r"(?i)(^|[._])(config|settings?|options?)[._]", name):
        yield "config_value", value
    yield "assignment", value


def _literal(node: ast.AST) -> tuple[str, str, int | None]:
    """(kind, text, number of elements) of the value of an assignment."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return "number", f"-{node.operand.value}", None
    if isinstance(node, ast.Constant):
        kind = "boolean" if isinstance(node.value, bool) else "number" if isinstance(node.value, (int, float)) else "string" if isinstance(node.value, str) else "other"
        return kind, str(node.value), None
    if isinstance(node, ast.JoinedStr):
        return "string", ast.unparse(node), None
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return "list", ast.unparse(node), len(node.elts)
    if isinstance(node, ast.Dict):
        return "dict", ast.unparse(node), None
    return "other", ast.unparse(node), None


def _python_facts(path: str, tree: ast.Module) -> Iterator[dict]:
    def fact(kind: str, symbol: str, value: str, node: ast.AST) -> dict:
        return {"path": path, "fact_id": f"{path}:{node.lineno}:{node.col_offset}:{kind}:{symbol}:{value}", "fact_type": kind, "symbol": symbol, "value": value, "start_line": node.lineno, "confidence": "high", "method": "syntax"}

    exported = next((n.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)), None)
    if isinstance(exported, (ast.List, ast.Tuple)):
        for item in exported.elts:
            if isinstance(item, ast.Constant):
                yield fact("exported_symbol", str(item.value), "__all__", item)
    for node in ast.walk(tree):
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, (ast.Name, ast.Attribute, ast.Subscript)):
                    name = ast.unparse(target)
                    for kind, value in _values(name, *_literal(node.value)):
                        yield fact(kind, name, value, node)
                    if isinstance(node.value, ast.Call) and (callee := ast.unparse(node.value.func)).rsplit(".", 1)[-1][:1].isupper():
                        yield fact("instantiation", name, callee, node)
        elif isinstance(node, ast.Call):
            name = ast.unparse(node.func)
            yield fact("call_site", name, str(len(node.args) + len(node.keywords)), node)
            if isinstance(node.func, ast.Attribute):
                yield fact("calls_method", name, ast.unparse(node.func.value), node)
            if name in ("os.getenv", "os.environ.get") and node.args and isinstance(node.args[0], ast.Constant):
                yield fact("environment_variable", str(node.args[0].value), name, node)
        elif isinstance(node, ast.Subscript) and ast.unparse(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            yield fact("environment_variable", str(node.slice.value), "os.environ", node)
        elif isinstance(node, ast.Try):
            yield fact("fallback_chain", "try", " > ".join(["try", *["catch" for _ in node.handlers], *(["finally"] if node.finalbody else [])]), node)
        elif isinstance(node, ast.BoolOp) and isinstance(node.op, ast.Or):
            yield fact("fallback_chain", ast.unparse(node.values[0]), " > ".join(ast.unparse(x) for x in node.values), node)
        elif isinstance(node, ast.If) and any(isinstance(x, (ast.Return, ast.Raise)) for x in node.body):
            yield fact("guard_clause", ast.unparse(node.test), type(node.body[-1]).__name__.lower(), node)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                yield fact("import", alias.name, alias.asname or "", node)
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                yield fact("import", f"{'.' * node.level}{node.module or ''}", alias.name, node)
        elif isinstance(node, ast.ClassDef):
            for base in node.bases:
                yield fact("implements_interface", node.name, ast.unparse(base), node)
            for own in node.body:
                if isinstance(own, ast.FunctionDef) and own.name == "__init__":
                    for arg in [*own.args.args[1:], *own.args.kwonlyargs]:
                        yield fact("dependency_injection", node.name, arg.arg, own)


_SCRIPT_VALUE = re.compile(r"(?:\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?|(\bthis\.[A-Za-z_$][\w$.]*)\s*)\s*=(?![=>])\s*|(?:(?<=[{,])|^)\s*([A-Za-z_$][\w$]*)\s*:\s*", re.MULTILINE)
_SCRIPT_CALL = re.compile(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_SCRIPT_OR = re.compile(r"([\w$.\])]+)\s*(\?\?|\|\|)\s*([\w$.\"'`]+)")


def _script_value(text: str, masked: str, at: int) -> tuple[str, str, int | None]:
    """(kind, text, number of elements) of the value that begins at a place."""
    if m := re.compile(r"-?\d+(?:\.\d+)?(?![\w$.])").match(masked, at):
        return "number", m[0], None
    if m := re.compile(r"true\b|false\b").match(masked, at):
        return "boolean", m[0], None
    sign = masked[at : at + 1]
    if sign and sign in "\"'`":
        end = masked.find(sign, at + 1)
        return ("string", text[at + 1 : end], None) if end > 0 else ("other", "", None)
    if sign in ("[", "{"):
        end = _closing(masked, at, "[]" if sign == "[" else "{}")
        inner, depth, n = masked[at + 1 : end], 0, 0
        for c in inner:
            depth += (c in "[{(") - (c in "]})")
            n += c == "," and not depth
        return ("list" if sign == "[" else "dict"), text[at : end + 1], (n + (not inner.rstrip().endswith(",")) if inner.strip() else 0)
    end = min((x for x in (masked.find(c, at) for c in (";", "\n")) if x > 0), default=len(masked))
    return "other", text[at:end].strip(), None


def _script_facts(path: str, text: str) -> Iterator[dict]:
    """Facts of TypeScript and JavaScript, by patterns in text without comments and the insides of strings."""
    masked = _masked(text)

    def fact(kind: str, symbol: str, value: str, at: int) -> dict:
        line = text.count("\n", 0, at) + 1
        return {"path": path, "fact_id": f"{path}:{line}:{at}:{kind}:{symbol}:{value}", "fact_type": kind, "symbol": symbol, "value": value, "start_line": line, "confidence": "high", "method": "pattern"}

    for m in _SCRIPT_VALUE.finditer(masked):
        kind, value, n = _script_value(text, masked, m.end())
        group = m.lastindex
        name = m[group].removeprefix("this.")
        if group == 3 and kind == "other":
            continue  # a type, not a value
        for fact_type, found in _values(name, kind, value, n):
            yield fact(fact_type, name, found, m.start(group))
        if made := re.compile(r"new\s+([\w$.]+)").match(masked, m.end()):
            yield fact("instantiation", name, made[1], m.start(group))
    for m in _SCRIPT_CALL.finditer(masked):
        name = m[2]
        before = masked[max(0, m.start() - 12) : m.start()]
        end = _closing(masked, m.end() - 1, "()")
        declared = re.compile(r"\s*(?::[^{;=\n]+)?\{").match(masked, end + 1) and "." not in name and not m[1]
        if name in _NO_METHODS or name in ("constructor", "async") or declared or re.search(r"\bfunction\s*\*?\s*$", before):
            continue
        yield fact("call_site", name, "new" if m[1] else "", m.start(2))
        if "." in name and not m[1]:
            yield fact("calls_method", name, name.rsplit(".", 1)[0], m.start(2))
    for m in re.finditer(r"\bprocess\.env\.(\w+)", masked):
        yield fact("environment_variable", m[1], "process.env", m.start())
    for m in _SCRIPT_OR.finditer(masked):
        kind, value, _ = _script_value(text, masked, m.start(3))
        yield fact("fallback_chain", m[1], f"{m[1]} > {value if kind != 'other' else text[m.start(3) : m.end(3)]}", m.start())
    for m in re.finditer(r"\btry\s*\{", masked):
        chain, at = ["try"], _closing(masked, m.end() - 1) + 1
        while part := re.compile(r"\s*(catch|finally)\s*(?:\([^)]*\))?\s*\{").match(masked, at):
            chain.append(part[1])
            at = _closing(masked, part.end() - 1) + 1
        if len(chain) > 1:
            yield fact("fallback_chain", "try", " > ".join(chain), m.start())
    for m in re.finditer(r"^[ \t]*import\b[^;\n]*", masked, re.MULTILINE):
        if source := re.search(r"['\"]([^'\"]+)['\"]\s*;?\s*$", text[m.start() : m.end()].rstrip()):
            yield fact("import", source[1], text[m.start() : m.end()].strip(), m.start() + len(m[0]) - len(m[0].lstrip()))
    for m in re.finditer(r"^[ \t]*export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|interface|function\*?|const|let|var|type|enum)?\s*([A-Za-z_$][\w$]*)", masked, re.MULTILINE):
        yield fact("exported_symbol", m[1], text[m.start() : text.find("\n", m.end()) if "\n" in text[m.end() :] else len(text)].strip(), m.start(1))
    for m in re.finditer(r"\b(?:class|interface)\s+([\w$]+)[^{\n]*?\b(?:extends|implements)\s+([^{\n]+)", masked):
        for base in re.split(r",|\bimplements\b", m[2]):
            if base.strip():
                yield fact("implements_interface", m[1], base.strip(), m.start(1))
    for m in re.finditer(r"\bif\s*\(", masked):
        end = _closing(masked, m.end() - 1, "()")
        body = re.compile(r"\s*(?:\{\s*)?(return|throw)\b").match(masked, end + 1)
        if body:
            yield fact("guard_clause", text[m.end() : end].strip(), body[1], m.start())
    for m in re.finditer(r"\bconstructor\s*\(", masked):
        owner = [x[1] for x in re.finditer(r"\bclass\s+([\w$]+)", masked[: m.start()])]
        for part in masked[m.end() : _closing(masked, m.end() - 1, "()")].split(","):
            if name := re.match(r"\s*(?:(?:public|private|protected|readonly)\s+)*([A-Za-z_$][\w$]*)", part):
                yield fact("dependency_injection", owner[-1] if owner else "constructor", name[1], m.start())


def _plain_facts(path: str, text: str) -> Iterator[dict]:
    for pattern, kind in ((_CONSTANT, "constant"), (_IMPORT, "import")):
        for m in pattern.finditer(text):
            symbol = m[1] if kind == "constant" else next(g for g in m.groups() if g)
            value = m[2].strip("\"'") if kind == "constant" else ""
            line = text.count("\n", 0, m.start(1 if kind == "constant" else m.lastindex)) + 1
            yield {"path": path, "fact_id": f"{path}:{line}:{kind}:{symbol}", "fact_type": kind, "symbol": symbol, "value": value, "start_line": line, "confidence": "medium", "method": "pattern"}


def _mapped(files: DataFrame, each, schema: pa.Schema, kind: str) -> DataFrame:
    def of(batches):
        for batch in batches:
            for path, language, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                rows = list({r[schema.names[1]]: r for r in each(path, language, text or "")}.values())
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ship(files.sparkSession)
    return files.select("path", "language", "text").mapInArrow(of, kind)


def units(files: DataFrame) -> DataFrame:
    """Classes, functions and methods with their lines and content."""
    python, plain, tree_of = _python_units, _plain_units, _tree

    def each(path, language, text):
        tree = tree_of(language, text)
        return python(path, text, tree) if tree is not None else plain(path, text)

    return _mapped(files, each, _UNIT, UNIT)


def facts(files: DataFrame) -> DataFrame:
    """Facts of the nineteen types: Python by its parser, scripts by patterns over masked text, constants and imports of other languages."""
    python, script, plain, tree_of, scripts = _python_facts, _script_facts, _plain_facts, _tree, SCRIPTS

    def each(path, language, text):
        if language in scripts:
            return script(path, text)
        tree = tree_of(language, text)
        return python(path, tree) if tree is not None else plain(path, text)

    return _mapped(files, each, _FACT, FACT)


def chunks(files: DataFrame, least_lines: int = 3) -> DataFrame:
    """Units of `least_lines` lines or more as chunks; files without any are cut into windows of lines."""
    from strataflow.operators.retrieval import line_chunks

    found = units(files).where(f"end_line - start_line + 1 >= {least_lines}").select("path", "start_line", "end_line", "content").withColumnRenamed("content", "text")
    rest = files.join(found.select("path").distinct(), "path", "left_anti")
    return found.unionByName(line_chunks(rest, "path", "text"))
