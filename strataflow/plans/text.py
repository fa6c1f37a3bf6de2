"""Queries of scalar functions, classifiers and fact extraction over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import text as fn
from strataflow.plans.registry import query
from strataflow.sources import readers, roles
from strataflow.sources.adapters import table


_PATH = "lang || CASE doc_id % 6 WHEN 0 THEN '/src/' WHEN 1 THEN '/tests/' WHEN 2 THEN '/docs/' WHEN 3 THEN '/scripts/' WHEN 4 THEN '/dist/' ELSE '/lib/' END || 'f' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.json' ELSE '.bin' END"


def paths(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text", "n_chars", F.expr(_PATH).alias("path"))


@query("p12_file_roles", roles.with_("files") + r""", n AS (SELECT file_id, lower(path) AS p, string_split(lower(path), '/') AS c, string_split(lower(path), '/')[-1] AS f, content, lower(array_to_string(string_split(content, chr(10))[1:20], chr(10))) AS top FROM files),
    e AS (SELECT *, regexp_extract(f, '^.+(\.[^.]*)$', 1) AS x, ['.ts', '.tsx', '.js', '.jsx', '.py', '.go', '.rs', '.java', '.rb', '.php', '.cs', '.cpp', '.c', '.h', '.swift', '.kt', '.scala'] AS src FROM n)
    SELECT file_id, CASE WHEN list_has_any(c, ['dist', 'out', 'build', 'coverage', 'generated', '.next', 'node_modules', '__pycache__', '.mypy_cache', '.pytest_cache']) OR f IN ('package-lock.json', 'yarn.lock', 'poetry.lock', 'pipfile.lock', 'pnpm-lock.yaml', 'bun.lockb')
            OR f LIKE '%.min.js' OR f LIKE '%.min.css' OR f LIKE '%.map' OR f LIKE '%-lock.json' OR f LIKE '%.lock' OR (list_contains(src, x) AND length(content) > 512000) THEN 'generated'
        WHEN list_has_any(c, ['tests', 'test', '__tests__', 'e2e', 'fixtures', 'mocks', 'stubs', 'fakes', 'spec', 'specs', 'cypress']) OR regexp_matches(f, '\.(test|spec)\.(ts|js|tsx|jsx)$') OR (f LIKE 'test\_%.py' ESCAPE '\') OR (f LIKE 'verify\_%.py' ESCAPE '\') OR (f LIKE '%\_test.py' ESCAPE '\')
            OR contains(top, 'import pytest') OR contains(top, 'from pytest') OR contains(top, 'import unittest') OR contains(top, 'import { describe') OR contains(top, 'import { it,') OR contains(top, 'import { test,') OR contains(top, 'const describe =') OR contains(top, 'const it =') OR contains(top, 'describe(') OR contains(top, 'it(') THEN 'test'
        WHEN f IN ('package.json', 'tsconfig.json', 'pyproject.toml', 'setup.py', 'setup.cfg', 'dockerfile', 'makefile', 'requirements.txt', 'docker-compose.yml', '.env.example', '.env.sample', '.env') OR f LIKE '.env.%' OR f LIKE 'tsconfig.%.json' OR regexp_matches(p, '^\.github/workflows/[^/]+\.ya?ml$') THEN 'config'
        WHEN list_has_any(c, ['docs', 'documentation', 'wiki']) OR f IN ('readme.md', 'readme.rst', 'changelog.md', 'contributing.md', 'license') OR (x IN ('.md', '.mdx', '.rst', '.txt') AND NOT list_has_any(c, ['src', 'lib', 'app', 'packages', 'pkg'])) THEN 'docs'
        WHEN list_has_any(c, ['scripts', 'tools', 'bin', 'cli']) OR x IN ('.sh', '.bash', '.zsh', '.ps1', '.bat', '.cmd') THEN 'script' WHEN list_contains(src, x) THEN 'implementation' ELSE 'unknown' END AS role FROM e""")
def p12_file_roles(spark, d):
    return roles.role(spark, d, "files").select("file_id", fn.file_role(F.col("path"), F.col("content")).alias("role"))


@query("s3_ignored_paths", roles.with_("files") + r""" SELECT file_id, path FROM files WHERE NOT (list_contains(string_split(path, '/'), 'node_modules') OR path = 'dist/js' OR path LIKE 'dist/js/%' OR path LIKE '%/dist/js/%' OR path LIKE '%/dist/js'
    OR path LIKE '%.min.js' OR regexp_matches(path, '^src/[^/]*\.java$') OR regexp_matches(path, '^(.*/)?coverage/') OR path LIKE 'tes_s/%' OR path LIKE '%/tes_s/%')""")
def s3_ignored_paths(spark, d):
    patterns = ["node_modules", "dist/js", "*.min.js", "src/*.java", "**/coverage/", "tes?s/"]
    return roles.role(spark, d, "files").where(~fn.ignored(F.col("path"), patterns)).select("file_id", "path")


@query("s1_file_walk", roles.with_("files") + r""" SELECT path, max(size) AS size FROM files WHERE (regexp_matches(path, '\.(py|ts|md|go|java|yml|sh)$') OR regexp_matches(path, '(^|/)[^/]*\.env(\.[a-z]+)?$')) AND path NOT LIKE 'node_modules/%' AND NOT regexp_matches(path, '(^|/)(dist|tests)/') AND (path NOT LIKE '%.py' OR regexp_matches(path, '(^|/)main\.py$')) GROUP BY path""")
def s1_file_walk(spark, d):
    listing = roles.role(spark, d, "files").groupBy("path").agg(F.max("size").alias("size"))
    return readers.walked(listing, ["py", "ts", "md", "go", "java", "yml", "sh"], ["node_modules"], ["# built", "dist/", "tests/", "*.py", "!main.py"])


@query("p13_language", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'markdown' WHEN 3 THEN 'json' ELSE 'unknown' END AS language FROM documents")
def p13_language(spark, d):
    return paths(spark, d).select("doc_id", fn.language(F.col("path")).alias("language"))


@query("s2_budgeted_scan", f"SELECT doc_id, path FROM (SELECT doc_id, n_chars, {_PATH} AS path FROM documents) ORDER BY path LIKE '%.py' DESC, n_chars DESC, len(string_split(path, '/')), doc_id LIMIT 100")
def s2_budgeted_scan(spark, d):
    return paths(spark, d).orderBy(F.col("path").endswith(".py").desc(), F.col("n_chars").desc(), F.size(F.split("path", "/")), "doc_id").limit(100).select("doc_id", "path")


@query("p14_test_penalty", f"SELECT doc_id, CASE WHEN path LIKE '%/tests/%' THEN 0.1 ELSE 1.0 END * n_chars AS score FROM (SELECT doc_id, n_chars, {_PATH} AS path FROM documents)")
def p14_test_penalty(spark, d):
    return paths(spark, d).select("doc_id", (F.when(F.col("path").contains("/tests/"), 0.1).otherwise(1.0).cast("decimal(2,1)") * F.col("n_chars")).alias("score"))


@query("p15_demo_downrank", f"SELECT doc_id, CAST(CASE WHEN regexp_matches(path, '(?i)/(docs|demo|i18n)/') THEN 0.25 ELSE 1.0 END AS DOUBLE) AS factor FROM (SELECT doc_id, {_PATH} AS path FROM documents)")
def p15_demo_downrank(spark, d):
    return paths(spark, d).select("doc_id", F.when(F.col("path").rlike("(?i)/(docs|demo|i18n)/"), 0.25).otherwise(1.0).alias("factor"))


@query("text_snake_case", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')) AS snake FROM part")
def text_snake_case(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.snake(F.col("p_name")).alias("snake"))


@query("text_pascal_case", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal FROM part")
def text_pascal_case(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.pascal(F.col("p_name")).alias("pascal"))


@query("text_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM documents")
def text_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(fn.sentences(F.col("text"))).alias("n"))


@query("text_occurrences", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'th', ''))) / 2 AS INTEGER) AS n FROM documents")
def text_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", ((F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), F.lit("th"), F.lit("")))) / 2).cast("int").alias("n"))


@query("text_strip_code", "SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '\"[^\"\n]*\"|''[^''\n]*''', ' ', 'g')) AS n FROM pages")
def text_strip_code(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(fn.strip_code(F.col("html"))).cast("long").alias("n"))


@query("s17_dotenv_redaction", "SELECT doc_id, 'API_' || doc_id || '=<redacted>' AS line FROM documents")
def s17_dotenv_redaction(spark, d):
    env = F.concat(F.lit("API_"), F.col("doc_id").cast("string"), F.lit("=secret "), F.col("source"))
    return table(spark, d, "documents").select("doc_id", fn.redact_dotenv(env).alias("line"))


@query("p20_changed_content", "SELECT doc_id FROM documents WHERE sha256(text) <> CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE 'old' END")
def p20_changed_content(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    known = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("old").alias("old"))
    return docs.join(known, F.col("doc_id") == F.col("id"), "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("doc_id")


@query("p19_stale_manifest", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0")
def p19_stale_manifest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    manifest = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"))
    return docs.join(manifest, F.col("doc_id") == F.col("id"), "left").where(F.col("id").isNull() | (F.col("size") != F.col("n_chars"))).select("doc_id")


@query("k9_manifest", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, max(sha256(text)) AS last_hash FROM documents GROUP BY source")
def k9_manifest(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.max(F.sha2("text", 256)).alias("last_hash"))


@query("p16_range_overlap", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_quantity <= b.l_quantity + 5 AND a.l_quantity + 5 >= b.l_quantity")
def p16_range_overlap(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")) & (F.col("a.l_quantity") <= F.col("b.l_quantity") + 5) & (F.col("a.l_quantity") + 5 >= F.col("b.l_quantity"))
    return a.join(b, met).select("a.l_orderkey", F.col("a.l_linenumber").alias("a"), F.col("b.l_linenumber").alias("b"))


_LINES = "SELECT user_id, list(DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER)) AS lines FROM events GROUP BY user_id"


@query("p17_range_covered", f"SELECT user_id, len(list_filter(range(10, 13), lambda x: NOT list_contains(lines, CAST(x AS INTEGER)))) = 0 AS covered FROM ({_LINES})")
def p17_range_covered(spark, d):
    lines = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.get_json_object("props", "$.k").cast("int")).alias("lines"))
    return lines.select("user_id", fn.covered(F.lit(10), F.lit(12), F.col("lines")).alias("covered"))


@query("p18_range_touched", f"SELECT user_id, len(list_filter(lines, lambda x: x BETWEEN 10 AND 12)) > 0 AS touched FROM ({_LINES})")
def p18_range_touched(spark, d):
    lines = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.get_json_object("props", "$.k").cast("int")).alias("lines"))
    return lines.select("user_id", fn.touched(F.lit(10), F.lit(12), F.col("lines")).alias("touched"))


@query("fact_emails", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+')) AS value FROM documents")
def fact_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.expr(r"regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+', 0)")).alias("value"))


@query("fact_assignments", "SELECT doc_id, lower(regexp_extract(m, '^(\\w+)', 1)) AS symbol, regexp_extract(m, '\"([^\"]*)\"$', 1) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\w+ ?= ?\"[^\"]*\"')) AS m FROM documents)")
def fact_assignments(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(F.expr(r"""regexp_extract_all(text, '[A-Za-z0-9_]+ ?= ?"[^"]*"', 0)""")).alias("m"))
    return found.select("doc_id", F.lower(F.regexp_extract("m", r"^(\w+)", 1)).alias("symbol"), F.regexp_extract("m", '"([^"]*)"$', 1).alias("value"))


@query("n15_problem_signals", "SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)error|fail') THEN 'failure' END, CASE WHEN regexp_matches(text, '(?i)slow|timeout') THEN 'latency' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)token|secret') THEN 'secret' END], lambda x: x IS NOT NULL) AS signals FROM documents")
def n15_problem_signals(spark, d):
    rules = {"failure": "(?i)error|fail", "latency": "(?i)slow|timeout", "licence": "(?i)licen[cs]e", "secret": "(?i)token|secret"}
    return table(spark, d, "documents").select("doc_id", F.array_compact(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in rules.items()])).alias("signals"))
