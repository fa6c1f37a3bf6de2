"""Deterministic text functions as column expressions: classifiers by ordered rules, case and stem variants, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the role classifier: folders, file names and extensions that tell what a file is for.
GENERATED_FOLDERS = ("dist", "out", "build", "coverage", "generated", ".next", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache")
GENERATED_FILES = ("package-lock.json", "yarn.lock", "poetry.lock", "pipfile.lock", "pnpm-lock.yaml", "bun.lockb")
TEST_FOLDERS = ("tests", "test", "__tests__", "e2e", "fixtures", "mocks", "stubs", "fakes", "spec", "specs", "cypress")
CONFIG_FILES = ("package.json", "tsconfig.json", "pyproject.toml", "setup.py", "setup.cfg", "vite.config.ts", "vite.config.js", "webpack.config.js", "webpack.config.ts", "jest.config.js", "jest.config.ts", "jest.config.cjs", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yaml", ".prettierrc", ".prettierrc.json", "docker-compose.yml", "docker-compose.yaml", "dockerfile", ".env.example", ".env.sample", "requirements.txt", "requirements-dev.txt", "makefile")
DOC_FOLDERS, DOC_FILES, DOC_EXTENSIONS = ("docs", "documentation", "wiki"), ("readme.md", "readme.rst", "changelog.md", "contributing.md", "license"), (".md", ".mdx", ".rst", ".txt")
SOURCE_FOLDERS = ("src", "lib", "app", "packages", "pkg")
SCRIPT_FOLDERS, SCRIPT_EXTENSIONS = ("scripts", "tools", "bin", "cli"), (".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd")
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".php", ".cs", ".cpp", ".c", ".h", ".swift", ".kt", ".scala")
TEST_OPENINGS = ("import pytest", "from pytest", "import unittest", "import { describe", "import { it,", "import { test,", "const describe =", "const it =", "describe(", "it(")
#: A source file above this is a bundle.
BUNDLE_CHARS = 500 * 1024

#: Languages by extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "rb": "ruby", "kt": "kotlin", "md": "markdown", "json": "json"}


def file_role(path: Column, content: Column | None = None) -> Column:
    """generated, test, config, docs, script, implementation or unknown, by folders, names, extensions and the first lines."""
    low = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), r"^\./", ""))
    parts, name = F.split(low, "/"), F.element_at(F.split(low, "/"), -1)
    extension = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    under = lambda names: F.exists(parts, lambda x: x.isin(*names))
    generated = under(GENERATED_FOLDERS) | name.isin(*GENERATED_FILES) | name.rlike(r"(\.min\.js|\.min\.css|\.map|-lock\.json|\.lock)$")
    test = under(TEST_FOLDERS) | name.rlike(r"\.(test|spec)\.(ts|js|tsx|jsx)$|^test_.*\.py$|^verify_.*\.py$|_test\.py$")
    if content is not None:
        generated = generated | (extension.isin(*SOURCE_EXTENSIONS) & (F.coalesce(F.length(content), F.lit(0)) > BUNDLE_CHARS))
        opening = F.lower(F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\r?\n", -1), 1, 20), "\n"))
        for words in TEST_OPENINGS:
            test = test | opening.contains(words)
    config = name.isin(*CONFIG_FILES) | (name == ".env") | name.startswith(".env.") | name.rlike(r"^tsconfig\..*\.json$") | low.rlike(r"^\.github/workflows/[^/]+\.ya?ml$")
    docs = under(DOC_FOLDERS) | name.isin(*DOC_FILES) | (extension.isin(*DOC_EXTENSIONS) & ~under(SOURCE_FOLDERS))
    script = under(SCRIPT_FOLDERS) | extension.isin(*SCRIPT_EXTENSIONS)
    return F.when(generated, "generated").when(test, "test").when(config, "config").when(docs, "docs").when(script, "script").when(extension.isin(*SOURCE_EXTENSIONS), "implementation").otherwise("unknown")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, ext), F.lit("unknown"))


def _glob(pattern: str) -> str:
    """What a glob says of a path, without its end: alone it names any component, with a slash the path from the root; ** spans folders."""
    body = pattern.strip("/")
    anchored = "/" in body or pattern.startswith("/")
    out, at = "", 0
    while at < len(body):
        if body.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif body.startswith("**", at):
            out, at = out + ".*", at + 2
        elif body[at] in "*?":
            out, at = out + ("[^/]*" if body[at] == "*" else "[^/]"), at + 1
        else:
            out, at = out + (body[at] if body[at].isalnum() or body[at] in "_/" else "\\" + body[at]), at + 1
    return ("^" if anchored else "(?:^|/)") + out


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path is one of the patterns, lies under one, has one inside or at its end (whole components), or meets a pattern with wildcards."""
    plain = F.regexp_replace(path, r"\\\\", "/")
    found = F.lit(False)
    for pattern in patterns:
        if "*" in pattern or "?" in pattern:
            found = found | plain.rlike(_glob(pattern) + ("/" if pattern.endswith("/") else "(?:/|$)"))
        else:
            found = found | (plain == pattern) | plain.startswith(pattern + "/") | plain.contains("/" + pattern + "/") | plain.endswith("/" + pattern)
    return found


def gitignored(path: Column, lines: Sequence[str]) -> Column:
    """Whether the lines of an ignore file leave a path out.

    The last pattern that meets it decides, and one that begins with ! takes it back; what lies in a folder that is left out stays out.
    """
    folder = file = F.lit(False)
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        out, pattern = F.lit(not line.startswith("!")), line.removeprefix("!")
        folder = F.when(path.rlike(_glob(pattern) + "/"), out).otherwise(folder)
        if not pattern.endswith("/"):
            file = F.when(path.rlike(_glob(pattern) + "$"), out).otherwise(file)
    return folder | file


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(snake(name), "_"), F.initcap), "")


def identifier_words(name: Column) -> Column:
    return F.filter(F.split(snake(name), "_"), lambda x: x != "")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\u001B\\[[0-9;]*[A-Za-z]", "")


def strip_code(text: Column) -> Column:
    """Without block comments, line comments and string literals."""
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"//[^\n]*", " ")
    return F.regexp_replace(text, "\"[^\"\\n]*\"|'[^'\\n]*'", " ")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def redact_dotenv(text: Column) -> Column:
    """KEY=value lines keep the key alone."""
    return F.regexp_replace(text, r"(?m)^(\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=).*$", "$1<redacted>")


def normalized(text: Column) -> Column:
    """Lower case without anything but a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def covered(start: Column, end: Column, lines: Column) -> Column:
    """Whether every line of a range is in the lines."""
    return F.size(F.array_except(F.sequence(start, end), lines)) == 0


def touched(start: Column, end: Column, lines: Column) -> Column:
    return F.exists(lines, lambda x: (x >= start) & (x <= end))


def inflections(word: Column) -> Column:
    """A word with its plain, plural, past and -ing forms, by the common rules of English spelling."""
    y = word.rlike("[^aeiou]y$")
    hiss, e = word.rlike("(s|x|z|ch|sh)$"), word.endswith("e")
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    plural = F.when(y, F.concat(cut(1), F.lit("ies"))).when(hiss, F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    past = F.when(y, F.concat(cut(1), F.lit("ied"))).when(e, F.concat(word, F.lit("d"))).otherwise(F.concat(word, F.lit("ed")))
    doing = F.when(e & ~word.endswith("ee"), F.concat(cut(1), F.lit("ing"))).otherwise(F.concat(word, F.lit("ing")))
    return F.array_distinct(F.array(word, plural, past, doing))


def like_any(text: Column, parts: Sequence[str], where: str = "anywhere") -> Column:
    """Whether a text has one of the parts, taken literally and in any case: anywhere, at the start, at the end, or as the whole."""
    low = F.lower(text)
    test = {"anywhere": low.contains, "start": low.startswith, "end": low.endswith, "whole": lambda p: low == p}[where]
    found = F.lit(False)
    for part in parts:
        found = found | test(F.lit(part.lower()))
    return found
