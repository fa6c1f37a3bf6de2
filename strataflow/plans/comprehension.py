"""Queries of what code says of itself, of artifacts and their order, of feedback, briefs and investigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import comprehension as op
from strataflow.plans.registry import query
from strataflow.sources.adapters import table
from strataflow.sources.roles import ctes, role, with_


def _r(spark, d, *names):
    return [role(spark, d, n) for n in names]


_LINES = "ln AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS text FROM project_files)"
_FIRST = lambda patterns: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in patterns) + ", '')"
_SYMBOLS = _LINES + r""", d0 AS (SELECT path, line, text, length(regexp_extract(text, '^(\s*)', 1)) AS indent, regexp_extract(text, '^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)', 1) AS cls,
        CASE WHEN path LIKE '%.py' THEN regexp_extract(text, '^\s*(?:async\s+)?def\s+(\w+)', 1) ELSE """ + _FIRST(op.FUNCTIONS) + f""" END AS fun, CASE WHEN path LIKE '%.py' THEN '' ELSE {_FIRST(op.MEMBERS)} END AS member FROM ln),
    d1 AS (SELECT * REPLACE (CASE WHEN cls <> '' OR fun <> '' OR member IN {op.KEYWORDS} THEN '' ELSE member END AS member) FROM d0), d2 AS (SELECT * FROM d1 WHERE cls <> '' OR fun <> '' OR member <> ''),
    top AS (SELECT d2.*, (SELECT max(o.line) FROM d2 o WHERE o.path = d2.path AND o.line < d2.line AND o.indent = 0) AS above FROM d2),
    held AS (SELECT t.*, CASE WHEN t.indent > 0 AND o.cls <> '' THEN o.cls END AS container, min(t.indent) OVER (PARTITION BY t.path, t.above, t.indent > 0 AND o.cls <> '') AS least FROM top t LEFT JOIN d2 o ON o.path = t.path AND o.line = t.above),
    sym AS (SELECT path, line, CASE WHEN cls <> '' THEN 'class' WHEN container IS NOT NULL THEN 'method' ELSE 'function' END AS kind, CASE WHEN cls <> '' THEN cls ELSE fun || member END AS name, container, trim(text) AS declaration FROM held WHERE member = '' OR (container IS NOT NULL AND indent = least))"""
_MARKS = r"""dm AS (SELECT path, line, regexp_extract(text, '^\s*@([\w.]+)', 1) AS decorator, regexp_extract(text, '^\s*@[\w.]+\s*\(\s*[''"]?([^''",)]*)', 1) AS argument FROM ln),
    marks AS (SELECT m.path, m.line, s.name AS symbol, s.line AS symbol_line, decorator, argument, CASE WHEN regexp_matches(decorator, '\.(get|post|put|delete|patch|options|head)$') THEN 'route' WHEN decorator LIKE '%.command' THEN 'command' WHEN decorator LIKE '%on_event%' OR decorator LIKE '%.on' THEN 'event_handler' WHEN decorator LIKE '%task%' THEN 'task' ELSE 'other' END AS role
        FROM dm m JOIN sym s ON s.path = m.path AND s.line = (SELECT min(x.line) FROM sym x WHERE x.path = m.path AND x.line > m.line) WHERE decorator <> '')"""
_NAMES = r"list_filter(list_transform(string_split({}, ','), lambda x: string_split(regexp_replace(trim(x), '[<\[].*$', ''), '.')[-1]), lambda x: regexp_matches(x, '^\w+$'))"
_BASES = f"""par AS (SELECT path, name AS class, unnest(CASE WHEN path LIKE '%.py' THEN {_NAMES.format("regexp_extract(declaration, 'class\\s+\\w+\\s*\\(([^)]*)\\)', 1)")} ELSE {_NAMES.format("regexp_extract(declaration, '\\bextends\\s+([^{]+?)(?:\\s+implements\\b|\\s*\\{|$)', 1)")} END) AS parent, false AS interface FROM sym WHERE kind = 'class'
    UNION ALL SELECT path, name, unnest({_NAMES.format("regexp_extract(declaration, '\\bimplements\\s+([^{]+?)(?:\\s*\\{|$)', 1)")}), true FROM sym WHERE kind = 'class' AND path NOT LIKE '%.py'), pd AS (SELECT DISTINCT * FROM par),
    homes AS (SELECT DISTINCT name, path AS home FROM sym WHERE kind = 'class'), near AS (SELECT DISTINCT src, dst FROM imp),
    inh AS (SELECT pd.path, class, parent, interface, coalesce(max(CASE WHEN home = pd.path THEN home END), min(CASE WHEN dst IS NOT NULL THEN home END), CASE WHEN count(home) = 1 THEN min(home) END) AS parent_path FROM pd LEFT JOIN homes ON name = parent LEFT JOIN near ON src = pd.path AND dst = home GROUP BY ALL)"""
#: Imports of the project, resolved by trying each candidate in order.
_STATEMENTS = _LINES + r""", st AS (SELECT path, line, regexp_extract(regexp_extract(text, '(?:^|\s)(?:import|export)\s.*?from\s+[''"][^''"]+[''"]|(?:^|\s)import\s+[''"][^''"]+[''"]|require\(\s*[''"][^''"]+[''"]\s*\)', 0), '[''"]([^''"]+)[''"]', 1) AS module, CAST([] AS VARCHAR[]) AS names, 0 AS level, true AS script FROM ln WHERE path LIKE '%.ts' AND regexp_matches(text, '(?:^|\s)(?:import|export)\s.*?from\s+[''"]|(?:^|\s)import\s+[''"]|require\(')
    UNION ALL SELECT path, line, regexp_extract(text, '^\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)$', 2), list_transform(string_split(regexp_extract(text, '^\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)$', 3), ','), lambda x: trim(x)), length(regexp_extract(text, '^\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)$', 1)), false FROM ln WHERE path LIKE '%.py' AND regexp_matches(text, '^\s*from\s+(\.*)([\w.]*)\s+import\s+(.+)$')
    UNION ALL SELECT path, line, regexp_extract(text, '^\s*import\s+([\w.]+)', 1), CAST([] AS VARCHAR[]), 0, false FROM ln WHERE path LIKE '%.py' AND regexp_matches(text, '^\s*import\s+[\w.]+')),
    parts AS (SELECT *, string_split(path, '/') AS c FROM st),
    based AS (SELECT *, CASE WHEN script AND module LIKE './%' THEN array_to_string(c[1:len(c) - 1], '/') || '/' || module[3:] WHEN script AND module LIKE '../%' THEN array_to_string(c[1:len(c) - 2], '/') || '/' || module[4:] WHEN script THEN NULL WHEN level = 0 THEN replace(module, '.', '/')
        WHEN len(c) - level < 0 THEN NULL ELSE array_to_string(c[1:len(c) - level], '/') || CASE WHEN module = '' THEN '' ELSE '/' || replace(module, '.', '/') END END AS base FROM parts),
    asked AS (SELECT path, line, module, script, 0 AS part, base AS b FROM based WHERE base <> '' UNION ALL SELECT path, line, module, script, unnest(range(1, len(names) + 1)), base || '/' || unnest(names) FROM based WHERE base <> ''),
    tried AS (SELECT path, line, module, part, place, b || e AS candidate FROM asked, (SELECT unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '.py', '/__init__.py']) AS e, unnest(range(14)) AS place) WHERE script = (place < 12)),
    hit AS (SELECT DISTINCT path, line, module, min_by(candidate, place) AS target FROM tried WHERE candidate IN (SELECT path FROM project_files) GROUP BY path, line, module, part),
    resolved AS (SELECT path, line, module, target, 'internal' AS kind FROM hit UNION ALL SELECT path, line, module, NULL, CASE WHEN (script AND module NOT LIKE '.%') OR (NOT script AND level = 0 AND string_split(module, '.')[1] NOT IN (SELECT string_split(path, '/')[1] FROM project_files)) THEN 'external' ELSE 'unresolved' END FROM based WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.path = based.path AND h.line = based.line))"""
_IMP = "imp AS (SELECT path AS src, target AS dst FROM resolved WHERE target IS NOT NULL)"
_SYMBOLS_AFTER = _SYMBOLS.removeprefix(_LINES)


def _imports(spark, d):
    files = role(spark, d, "project_files")
    return op.resolve_imports(op.import_statements(files), files)


def _edges(spark, d):
    return _imports(spark, d).where("target IS NOT NULL").select(F.col("path").alias("src"), F.col("target").alias("dst"))


@query("g2_import_resolution", f"{with_('project_files')}, {_STATEMENTS} SELECT path, line, module, target, kind FROM resolved")
def g2_import_resolution(spark, d):
    return _imports(spark, d)


@query("g3_import_graph", f"{with_('project_files')}, {_STATEMENTS} SELECT path AS src, coalesce(target, module) AS dst, kind, count(*) AS n FROM resolved GROUP BY ALL")
def g3_import_graph(spark, d):
    return op.import_graph(_imports(spark, d))


@query("n2_symbols", f"{with_('project_files')}, {_SYMBOLS} SELECT path, line, kind, name, container FROM sym")
def n2_symbols(spark, d):
    return op.symbols(role(spark, d, "project_files")).drop("declaration")


@query("n2_decorators", f"{with_('project_files')}, {_SYMBOLS}, {_MARKS} SELECT * FROM marks")
def n2_decorators(spark, d):
    return op.decorators(role(spark, d, "project_files"))


_AHEAD = f"""ahead AS (SELECT sym.path, sym.line, name AS symbol, string_agg(regexp_replace(text, '(?:^|\\s)(?:#|//)\\s.*$', ''), ' ' ORDER BY ln.line) AS t FROM sym JOIN ln ON ln.path = sym.path AND ln.line BETWEEN sym.line AND sym.line + {op.SIGNATURE_LINES - 1} WHERE kind <> 'class' GROUP BY ALL),
    sig AS (SELECT path, line, symbol, CASE WHEN path LIKE '%.py' THEN regexp_extract(t, '{op.PYTHON_SIGNATURE}', ['p', 'r']) ELSE regexp_extract(t, '{op.SCRIPT_SIGNATURE}', ['p', 'r']) END AS s FROM ahead),
    par AS (SELECT path, line, symbol, trim(unnest(regexp_extract_all(s.p, '{op.PARAMETER}'))) AS p FROM sig)"""


@query("n2_annotations", f"""{with_('project_files')}, {_SYMBOLS}, {_AHEAD} SELECT path, line, symbol, regexp_extract(p, '{op.ANNOTATED}', 1) AS parameter, trim(regexp_extract(p, '{op.ANNOTATED}', 2)) AS type FROM par WHERE regexp_matches(p, '{op.ANNOTATED}')
    UNION ALL SELECT path, line, symbol, 'return', trim(s.r) FROM sig WHERE trim(s.r) <> ''""")
def n2_annotations(spark, d):
    return op.annotations(role(spark, d, "project_files"))


@query("n2_inheritance", f"{with_('project_files')}, {_STATEMENTS}{_SYMBOLS_AFTER}, {_IMP}, {_BASES} SELECT * FROM inh")
def n2_inheritance(spark, d):
    return op.inheritance(role(spark, d, "project_files"), _edges(spark, d))


_ENTRIES = f"{with_('project_files', 'project_roles')}, {_STATEMENTS}{_SYMBOLS_AFTER}, {_MARKS}, {_IMP}, {_BASES}" + r""", ep AS (SELECT 'http_route' AS type, path, symbol, symbol_line AS line, 'decorator' AS source, 0.95 AS confidence FROM marks WHERE role = 'route' UNION ALL SELECT 'background_task', path, symbol, symbol_line, 'decorator', 0.95 FROM marks WHERE role = 'task'
    UNION ALL SELECT 'event_handler', path, symbol, symbol_line, 'decorator', 0.95 FROM marks WHERE role = 'event_handler' UNION ALL SELECT 'cli', path, symbol, symbol_line, 'decorator', 0.95 FROM marks WHERE role = 'command'
    UNION ALL SELECT 'event_handler', path, 'react_render', line, 'pattern', 0.85 FROM ln WHERE path LIKE '%.ts' AND (contains(text, 'createRoot(') OR regexp_matches(text, '\bReactDOM\.render\s*\('))
    UNION ALL SELECT 'http_route', path, '<anonymous_route>', line, 'pattern', 0.90 FROM ln WHERE path LIKE '%.ts' AND regexp_matches(text, '\b(app|router)\.(get|post|put|delete|patch)\s*\(\s*[''"`][^''"`]+[''"`]')
    UNION ALL SELECT 'cli', path, '__main__', min(line), 'pattern', 0.90 FROM ln WHERE path LIKE '%.py' AND regexp_matches(text, 'if __name__ == [''"]__main__[''"]:') GROUP BY path UNION ALL SELECT 'cli', path, 'cli_entry', min(line), 'pattern', 0.90 FROM ln WHERE path LIKE '%.ts' AND regexp_matches(text, 'process\.argv|commander|yargs') GROUP BY path
    UNION ALL SELECT 'background_task', s.path, container || '.' || name, line, 'pattern', 0.90 FROM sym s WHERE kind = 'method' AND name IN ('run', 'execute', 'process') AND EXISTS (SELECT 1 FROM inh WHERE inh.path = s.path AND class = container AND parent IN ('Worker', 'BaseTask', 'Task', 'CeleryTask'))
    UNION ALL SELECT 'event_handler', path, '<anonymous_event_handler>', line, 'pattern', 0.90 FROM ln WHERE path LIKE '%.ts' AND regexp_matches(text, '\b(addEventListener|on)\s*\(')
    UNION ALL SELECT 'service_method', s.path, concat_ws('.', container, name), line, 'file_understanding', 0.75 FROM sym s JOIN project_roles r ON r.path = s.path AND r.role IN ('orchestrator', 'service') WHERE kind <> 'class' AND regexp_matches(name, '^(run|execute|process|start)')
    UNION ALL SELECT 'test', path, name, line, 'naming', 0.70 FROM sym WHERE (kind = 'function' AND starts_with(name, 'test_')) OR (kind = 'class' AND starts_with(name, 'Test')))"""


def _entries(spark, d):
    return op.entry_points(role(spark, d, "project_files"), _edges(spark, d), role(spark, d, "project_roles"))


@query("n3_entry_points", f"{_ENTRIES} SELECT type, path, symbol, line, source, confidence FROM ep")
def n3_entry_points(spark, d):
    return _entries(spark, d).withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))


@query("n3_entry_point_types", f"{_ENTRIES} SELECT type, count(*) AS n FROM ep GROUP BY type")
def n3_entry_point_types(spark, d):
    return _entries(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("g1_program_graph", with_("graph_units", "graph_facts") + """, k(fact_type, type, weight) AS (VALUES ('call_site', 'calls', 0.8), ('calls_method', 'calls_method', 0.9), ('assignment', 'assigns', 0.7), ('config_read', 'reads', 0.8), ('dependency_injection', 'reads', 0.8), ('implements', 'implements_interface', 1.0), ('instantiation', 'instantiates', 0.85), ('import', 'imports', 0.7), ('fallback_chain', 'fallback_to', 0.75)),
    u AS (SELECT DISTINCT unit_id, k.type, weight, lower(string_split(symbol, '.')[-1]) AS name FROM graph_facts f JOIN k ON k.fact_type = f.fact_type), h AS (SELECT unit_id AS target, file_path, lower(string_split(symbol, '.')[-1]) AS name FROM graph_units),
    m AS (SELECT u.unit_id, target, type, weight, row_number() OVER (PARTITION BY u.unit_id, type, u.name ORDER BY file_path, target) AS rn FROM u JOIN h ON h.name = u.name WHERE u.unit_id <> target)
    SELECT 'file::' || file_path AS src, unit_id AS dst, 'contains' AS type, 1.0::DOUBLE AS weight FROM graph_units UNION SELECT parent_id, unit_id, 'contains', 1.0 FROM graph_units WHERE parent_id IS NOT NULL UNION SELECT unit_id, target, type, weight FROM m WHERE rn <= CASE WHEN type = 'fallback_to' THEN 2 ELSE 3 END""")
def g1_program_graph(spark, d):
    return op.program_graph(*_r(spark, d, "graph_units", "graph_facts"))


_CALLS = "calls AS (SELECT DISTINCT 'f' || (l_orderkey % 500) AS src, 'f' || (l_partkey % 500 + 1 + l_orderkey % 500) AS dst FROM lineitem WHERE l_linenumber < 3)"


def _calls(spark, d):
    node = lambda c: F.concat(F.lit("f"), c.cast("string"))
    return table(spark, d, "lineitem").where("l_linenumber < 3").select(node(F.col("l_orderkey") % 500).alias("src"), node(F.col("l_partkey") % 500 + 1 + F.col("l_orderkey") % 500).alias("dst")).distinct()


_CHAIN = f"WITH RECURSIVE {_CALLS}, near(node, depth) USING KEY (node) AS (SELECT 'f3', 0 UNION SELECT c.dst, min(near.depth) + 1 FROM near JOIN calls c ON c.src = near.node WHERE near.depth < 8 AND NOT EXISTS (SELECT 1 FROM recurring.near x WHERE x.node = c.dst) GROUP BY c.dst), kept AS (SELECT * FROM near ORDER BY depth, node LIMIT 20), e AS (SELECT src, dst FROM calls WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept))"


@query("g20_bounded_traversal", f"{_CHAIN}, r AS (SELECT node, 0 AS level FROM kept WHERE node NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM r JOIN e ON src = node), lv AS (SELECT node, max(level) AS level FROM r GROUP BY node) SELECT node, depth, row_number() OVER (ORDER BY coalesce(level, 1073741824), node) AS place FROM kept LEFT JOIN lv USING (node)")
def g20_bounded_traversal(spark, d):
    return op.call_chain(_calls(spark, d), spark.range(1).select(F.lit("f3").alias("node")))[0]


@query("g20_induced_edges", f"{_CHAIN} SELECT src, dst FROM e")
def g20_induced_edges(spark, d):
    return op.call_chain(_calls(spark, d), spark.range(1).select(F.lit("f3").alias("node")))[1]


@query("g21_flow_entry", with_("functions") + """, a(query, terms) AS (VALUES (1, ['load_7', 'store']), (2, ['planner', 'cache']), (3, ['nothing']), (4, ['return'])), s AS (SELECT query, node, entry, inbound, list_sum(list_transform(terms, lambda t: 3 * CAST(contains(lower(name), t) AS INT) + 2 * CAST(contains(lower(path), t) AS INT) + 2 * CAST(contains(lower(doc), t) AS INT) + CAST(contains(lower(body), t) AS INT))) + CASE WHEN entry THEN 2 ELSE 0 END + least(inbound, 5) AS score FROM functions, a)
    SELECT query, node, CAST(score AS INT) AS score FROM s WHERE score > 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, entry DESC, inbound DESC, node) = 1""")
def g21_flow_entry(spark, d):
    asked = spark.createDataFrame([(1, ["load_7", "store"]), (2, ["planner", "cache"]), (3, ["nothing"]), (4, ["return"])], "query int, terms array<string>")
    return op.flow_entry(role(spark, d, "functions"), asked)


_ARTIFACTS = """fixed(dst, own) AS (VALUES ('call-graph.json', ['file-structures.json']), ('lexical_map.json', ['file-structures.json']), ('import_graph.json', ['file-structures.json']), ('type_annotation_map.json', ['lexical_map.json']), ('decorator_map.json', ['lexical_map.json']), ('inheritance_map.json', ['lexical_map.json', 'import_graph.json']),
    ('call_graph_v1.json', ['lexical_map.json', 'import_graph.json', 'inheritance_map.json', 'type_annotation_map.json']), ('files.json', ['file-structures.json', 'call-graph.json', 'lexical_map.json', 'import_graph.json', 'call_graph_v1.json', 'decorator_map.json', 'inheritance_map.json', 'type_annotation_map.json']), ('call_graph_v2.json', ['call_graph_v1.json', 'lexical_map.json', 'import_graph.json', 'files.json']),
    ('modules.json', ['files.json', 'import_graph.json', 'inheritance_map.json', 'call_graph_v1.json']), ('module_understanding.json', ['files.json', 'import_graph.json', 'inheritance_map.json', 'call_graph_v1.json']), ('concept_map.json', ['files.json']), ('entry_points.json', ['lexical_map.json', 'decorator_map.json', 'inheritance_map.json', 'files.json']),
    ('behavioral_paths.json', ['call_graph_v2.json', 'entry_points.json', 'files.json', 'module_understanding.json']), ('project.json', ['modules.json', 'files.json', 'file-structures.json', 'behavioral_paths.json'])),
    ae AS (SELECT unnest(own) AS src, dst FROM fixed UNION ALL SELECT path, unnest(['file-structures.json', 'files.json', 'lexical_map.json', 'import_graph.json']) FROM project_files)"""


@query("n4_artifact_edges", f"{with_('project_files')}, {_ARTIFACTS} SELECT src, dst FROM ae")
def n4_artifact_edges(spark, d):
    return op.artifact_edges(role(spark, d, "project_files"))


def _closure(start: str, a: str, b: str) -> str:
    return f"WITH RECURSIVE {ctes('project_files')}, {_ARTIFACTS}, near(node, depth) USING KEY (node) AS (SELECT '{start}', 0 UNION SELECT e.{b}, min(near.depth) + 1 FROM near JOIN ae e ON e.{a} = near.node WHERE NOT EXISTS (SELECT 1 FROM recurring.near x WHERE x.node = e.{b}) GROUP BY e.{b}) SELECT '{start}' AS seed, node, depth FROM near WHERE depth > 0"


@query("g23_artifact_dependents", _closure("lexical_map.json", "src", "dst"))
def g23_artifact_dependents(spark, d):
    return op.artifact_closure(op.artifact_edges(role(spark, d, "project_files")), spark.range(1).select(F.lit("lexical_map.json").alias("node")))


@query("g23_artifact_dependencies", _closure("modules.json", "dst", "src"))
def g23_artifact_dependencies(spark, d):
    return op.artifact_closure(op.artifact_edges(role(spark, d, "project_files")), spark.range(1).select(F.lit("modules.json").alias("node")), dependents=False)


@query("x4_rebuild_queue", "WITH RECURSIVE " + ctes("project_files", "rebuild_requests") + f""", {_ARTIFACTS}, q AS (SELECT artifact, list_sort(list(DISTINCT file)) AS triggers, count(*) - 1 AS superseded FROM rebuild_requests GROUP BY artifact), ie AS (SELECT DISTINCT src, dst FROM ae WHERE src IN (SELECT artifact FROM q) AND dst IN (SELECT artifact FROM q)),
    r AS (SELECT artifact AS node, 0 AS level FROM q WHERE artifact NOT IN (SELECT dst FROM ie) UNION SELECT dst, level + 1 FROM r JOIN ie ON src = node), lv AS (SELECT node, max(level) AS level FROM r GROUP BY node)
    SELECT artifact, row_number() OVER (ORDER BY level, artifact) AS place, triggers, superseded FROM q JOIN lv ON node = artifact""")
def x4_rebuild_queue(spark, d):
    return op.rebuild_queue(role(spark, d, "rebuild_requests"), op.artifact_edges(role(spark, d, "project_files")))


@query("n6_confidence_ladder", "SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 WHEN 3 THEN 0.8 WHEN 4 THEN 0.65 WHEN 5 THEN 0.6 WHEN 6 THEN 0.5 WHEN 7 THEN 0.3 ELSE 0.2 END AS confidence FROM part")
def n6_confidence_ladder(spark, d):
    names = F.array(*[F.lit(x) for x in ("AST_DERIVED", "GRAPH_RESOLVED", "FULL_CODE_WITH_GRAPH", "FULL_CODE_ONLY", "PARTIAL_CODE_WITH_GRAPH", "PARTIAL_CODE_ONLY", "METADATA_ONLY", "NONE", "FALLBACK", "other", "")])
    return table(spark, d, "part").select("p_partkey", op.confidence(F.get(names, (F.col("p_partkey") % 11).cast("int"))).cast("decimal(3,2)").alias("confidence"))


@query("n8_corrections", with_("chat_messages", "chat_answers") + """, m AS (SELECT * FROM chat_messages WHERE len(list_filter(['that''s wrong', 'incorrect', 'not right', 'you''re wrong', 'wrong file', 'that''s not', 'actually it''s', 'actually it is', 'no, it', 'that is not correct'], lambda c: contains(lower(text), c))) > 0)
    SELECT m.session, m.at, (SELECT max_by(a.answer_id, a.at) FROM chat_answers a WHERE a.session = m.session AND a.at < m.at) AS answer_id, substr(text, 1, 200) AS text FROM m WHERE EXISTS (SELECT 1 FROM chat_answers a WHERE a.session = m.session AND a.at < m.at)""".replace("m.at,", 'm."at",').replace("a.at)", 'a."at")').replace("a.at < m.at", 'a."at" < m."at"'))
def n8_corrections(spark, d):
    return op.corrections(*_r(spark, d, "chat_messages", "chat_answers"))


@query("n8_recent_feedback", "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOURS")
def n8_recent_feedback(spark, d):
    return op.recent(table(spark, d, "events").where("event_type = 'error'"), "ts", "2024-01-31 00:00:00", 72).select("event_id")


@query("n9_blame", with_("feedback_events", "retrieved_artifacts", "concept_places", "path_files", "module_files") + """, u AS (SELECT r.artifact_type, r.artifact_id, e.* FROM retrieved_artifacts r JOIN feedback_events e USING (event_id)),
    x AS (SELECT event_id, artifact_type, artifact_id, 0.6 AS score FROM u UNION ALL SELECT event_id, 'concept_map', concept, 0.95 FROM feedback_events JOIN concept_places ON path = nonexistent_path WHERE event_type = 'cited_nonexistent_file'
        UNION ALL SELECT event_id, artifact_type, artifact_id, 0.95 FROM u WHERE event_type = 'cited_nonexistent_file' AND nonexistent_path IS NOT NULL AND artifact_type = 'file_understanding' UNION ALL SELECT event_id, 'file_understanding', navigated_to, 0.8 FROM feedback_events WHERE event_type = 'navigation_divergence' AND navigated_to IS NOT NULL
        UNION ALL SELECT event_id, artifact_type, artifact_id, 0.85 FROM u WHERE event_type = 'navigation_divergence' AND navigated_to IS NOT NULL AND artifact_type = 'behavioral_path' AND NOT EXISTS (SELECT 1 FROM path_files p WHERE p.path_id = artifact_id AND p.file = navigated_to)
        UNION ALL SELECT event_id, artifact_type, artifact_id, 0.7 FROM u WHERE event_type = 'corrective_followup' AND artifact_type = 'file_understanding' UNION ALL SELECT event_id, artifact_type, artifact_id, 0.85 FROM u WHERE event_type = 'corrective_followup' AND flow AND artifact_type = 'behavioral_path'),
    b AS (SELECT event_id, artifact_type, artifact_id, max(score) AS score FROM x GROUP BY ALL), s AS (SELECT * FROM b UNION ALL SELECT event_id, 'module_understanding', module, 0.5 FROM b JOIN module_files ON path = artifact_id WHERE artifact_type = 'file_understanding' AND score >= 0.7)
    SELECT event_id, artifact_type, artifact_id, max(score) AS score FROM s GROUP BY ALL""")
def n9_blame(spark, d):
    return op.blame(*_r(spark, d, "feedback_events", "retrieved_artifacts", "concept_places", "path_files", "module_files")).withColumn("score", F.col("score").cast("decimal(3,2)"))


@query("n11_architecture_ranking", with_("architecture_evidence") + """, m AS (SELECT query, name, count(*) AS n FROM (SELECT query, file AS name FROM architecture_evidence WHERE file IS NOT NULL UNION ALL SELECT query, symbol FROM architecture_evidence WHERE symbol IS NOT NULL) GROUP BY ALL),
    p AS (SELECT DISTINCT query, 'component' AS kind, symbol AS name FROM architecture_evidence WHERE source = 'community' AND symbol IS NOT NULL UNION ALL SELECT DISTINCT query, 'file', file FROM architecture_evidence WHERE source = 'architecture' AND file IS NOT NULL)
    SELECT query, kind, name, n, row_number() OVER (PARTITION BY query, kind ORDER BY n DESC, name) AS place FROM p JOIN m USING (query, name) QUALIFY kind = 'component' OR place <= 5""")
def n11_architecture_ranking(spark, d):
    return op.architecture_ranking(role(spark, d, "architecture_evidence"))


@query("n13_daily_brief", with_("brief_changes", "community_members", "file_annotations", "file_notes") + """, n AS (SELECT file, max_by(change_type, (at_, sha)) AS change_type, count(DISTINCT sha) AS commits, max(at_) AS at_ FROM (SELECT file, change_type, sha, "at" AS at_ FROM brief_changes) WHERE at_ > TIMESTAMP '2001-07-25 00:00:00' GROUP BY file),
    c AS (SELECT file, min(community) AS community FROM n JOIN community_members ON suffix(file, member) GROUP BY file), t AS (SELECT file, count(DISTINCT note) AS notes FROM file_notes GROUP BY file)
    SELECT n.file, change_type, commits, community, coalesce(annotated_at < at_, false) AS stale, coalesce(notes, 0) AS notes FROM n LEFT JOIN c USING (file) LEFT JOIN (SELECT file, max(annotated_at) AS annotated_at FROM file_annotations GROUP BY file) a USING (file) LEFT JOIN t USING (file)""")
def n13_daily_brief(spark, d):
    return op.daily_brief(*_r(spark, d, "brief_changes", "community_members", "file_annotations", "file_notes"), "2001-07-25 00:00:00")
