"""More roles of the engine on the star-schema tables, each one statement that Spark and a reference database read alike.

A statement names its tables in braces: here they are filled with DataFrames, in `with_` with the tables' names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strataflow.sources.adapters import table

_DAY = "SELECT 'ADR-' || (user_id % 30) AS entity_id, CAST(ts AS DATE) AS snapshot_date"
_TYPES = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END"

ROLES: dict[str, str] = {
    # reviews of decisions, some of them of decisions that do not exist
    "review_outcomes": "SELECT o_orderkey AS review_id, 'ADR' AS entity_type, 'ADR-' || (o_orderkey % 33) AS entity_id, CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END AS post_merge_incidents, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS defects_found FROM {orders} WHERE o_orderkey % 211 = 0",
    "previous_validity": "SELECT 'ADR-' || n_nationkey AS adr_id, CAST(n_nationkey * 4 AS DOUBLE) AS validity_score FROM {nation}",
    "runtime_mappings": "SELECT 'ADR-' || n_nationkey AS entity_id, 'ADR' AS entity_type, 'svc' || (n_nationkey % 10) AS component_id FROM {nation} UNION ALL SELECT 'm0/p' || r_regionkey, 'FILE', 'svc' || r_regionkey FROM {region}",
    "runtime_health_history": "SELECT 'svc' || (user_id % 10) AS component_id, CAST(ts AS DATE) AS computed_at, CAST(greatest(0, 100 - floor(max(value) / 4)) AS DOUBLE) AS health_score FROM {events} GROUP BY 1, 2",
    "evolution_snapshots": f"{_DAY}, CAST(least(100, floor(max(value))) AS DOUBLE) AS health_score, CAST(greatest(0, 100 - floor(max(value) / 3)) AS DOUBLE) AS validity_score, CAST(count(DISTINCT {_TYPES}) - 1 AS INT) AS bus_factor, CAST(count(*) * 6 AS INT) AS node_count FROM {{events}} GROUP BY 1, 2",
    "hotspot_history": f"{_DAY}, CAST(count(DISTINCT {_TYPES}) AS INT) AS bus_factor, CAST(least(100, floor(max(value))) AS DOUBLE) AS hotspot_score, CAST(least(100, count(*) * 20) AS DOUBLE) AS blast_radius_score, CAST(least(100, floor(max(value) / 2)) AS DOUBLE) AS coupling_score FROM {{events}} GROUP BY 1, 2",
    "validity_history": f"{_DAY}, CAST(greatest(0, 100 - floor(max(value) / 2)) AS DOUBLE) AS validity_score FROM {{events}} GROUP BY 1, 2",
    "decision_outcomes": "SELECT 'ADR-' || n_nationkey AS entity_id, 'ADR' AS entity_type, CASE n_nationkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'SUCCESSFUL' ELSE 'STABLE' END AS outcome_type FROM {nation}",
    "knowledge_hotspots": "SELECT 'ADR-' || (p_partkey % 30) AS entity_id, 'ADR' AS entity_type, CAST(count(DISTINCT p_size % 7) AS INT) AS expert_count, CAST(max(p_size % 9) AS INT) AS bus_factor, CASE WHEN max(p_partkey) % 5 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CAST(max(p_size) * 2 AS DOUBLE) AS hotspot_score FROM {part} GROUP BY 1",
    "author_expertise": "SELECT 'dev' || (l_suppkey % 6) AS author_email, 'FILE' AS entity_type, 'm' || (l_partkey % 20) || '/p' || l_partkey AS entity_id, CAST(sum(l_linenumber) AS DOUBLE) AS expertise_score, CAST(min(l_linenumber) * 40 AS DOUBLE) AS knowledge_age_days FROM {lineitem} WHERE l_partkey % 11 <> 0 GROUP BY 1, 3",
    "architectural_health": "SELECT 'ADR-' || n_nationkey AS entity_id, CAST(100 - (n_nationkey % 5) * 9 AS DOUBLE) AS health_score FROM {nation}",
    "drift_findings": "SELECT 'F' || p_partkey AS id, 'ADR-' || (p_partkey % 13) AS entity_id, CASE WHEN p_size % 4 = 0 THEN 'RESOLVED' ELSE 'ACTIVE' END AS resolution_state FROM {part} WHERE p_size > 40",
    "knowledge_validity": "SELECT 'VAL-ADR-' || n_nationkey AS id, 'ADR-' || n_nationkey AS entity_id, CAST(100 - (n_nationkey % 6) * 11 AS DOUBLE) AS validity_score FROM {nation}",
    "validity_evidence": "SELECT 'VAL-ADR-' || s_nationkey AS validity_id, s_suppkey AS evidence_id FROM {supplier} WHERE s_nationkey % 4 <> 1",
    "evolution_entities": "SELECT 'EVO-ADR-' || n_nationkey AS id, 'ADR-' || n_nationkey AS entity_id FROM {nation} WHERE n_nationkey % 9 <> 3",
    "review_recommendations": "SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 10 = 1",
    "review_scope": "SELECT l_orderkey AS recommendation_id, l_partkey AS node_id FROM {lineitem} WHERE l_linenumber = 2",
    "coverage_entities": "SELECT 'ADR' AS entity_type, 'ADR-' || (p_partkey % 40) AS entity_id, CAST(min(p_size) * 12 AS DOUBLE) AS coverage_percent FROM {part} GROUP BY 2",
    "outcome_evidence": "SELECT 'ADR' AS entity_type, 'ADR-' || n_nationkey AS entity_id, CASE WHEN n_nationkey % 3 = 0 THEN 'COVERAGE' ELSE 'HEALTH' END AS evidence_type FROM {nation}",
    "causal_explanations": "SELECT 'X' || n_nationkey AS id, 'ADR' AS target_entity_type, 'ADR-' || (n_nationkey + 5) AS target_entity_id FROM {nation}",
    "causal_factors": "SELECT 'C' || s_suppkey AS factor_id, 'X' || (s_nationkey % 20) AS explanation_id, CASE WHEN s_suppkey % 3 = 0 THEN 'COVERAGE_DEGRADATION' ELSE 'HEALTH_DROP' END AS factor_type FROM {supplier}",
    "causal_chains": "SELECT 'X' || s_nationkey AS explanation_id, 'C' || s_suppkey AS prev_factor_id, 'C' || (s_suppkey + 1) AS next_factor_id FROM {supplier} WHERE s_suppkey % 2 = 0",
    "causal_evidence": "SELECT 'C' || s_suppkey AS factor_id, s_name AS evidence FROM {supplier} WHERE s_suppkey % 8 <> 5",
    "outcome_history": f"{_DAY} FROM {{events}} WHERE user_id % 30 < 20 GROUP BY 1, 2",
    "drift_history": f"{_DAY} FROM {{events}} WHERE event_type = 'error' GROUP BY 1, 2",
    "architectural_health_history": f"{_DAY}, CAST(least(100, floor(max(value))) AS DOUBLE) AS health_score FROM {{events}} GROUP BY 1, 2",
    "coverage_snapshots": f"{_DAY}, CAST(least(100, floor(max(value) / 2)) AS DOUBLE) AS coverage_percent FROM {{events}} GROUP BY 1, 2",
    "change_sets": "SELECT l_orderkey AS change_id, 'm' || (l_partkey % 20) || '/p' || l_partkey AS path FROM {lineitem} WHERE l_orderkey % 50 = 1 GROUP BY 1, 2",
    "impacts": "SELECT 'm' || (ps % 20) || '/p' || ps AS root, 'm' || (pt % 20) || '/p' || pt AS node, CAST(g AS DOUBLE) AS governance_score FROM (SELECT p_partkey AS ps, p_partkey + 20 AS pt, p_size * 2 AS g FROM {part} UNION ALL SELECT p_partkey, p_partkey + 40, p_size * 2 FROM {part} WHERE p_size % 3 = 0)",
    "couplings": "SELECT 'm' || (p_partkey % 20) || '/p' || p_partkey AS source_path, 'm' || ((p_partkey + 7) % 20) || '/p' || (p_partkey + 7) AS target_path, CAST(p_size AS DOUBLE) / 50 AS confidence, CAST(p_size % 12 AS INT) AS co_change_count FROM {part}",
    # questions of all kinds about the benchmark's texts
    "questions": "SELECT item_id AS id, CASE item_id % 30 WHEN 0 THEN 'What is the max retry threshold of' WHEN 1 THEN 'How many files does it count in' WHEN 2 THEN 'Explain the fallback of' WHEN 3 THEN 'Where should I start as a new developer with' WHEN 4 THEN 'Where is the token cache module defined in' WHEN 5 THEN 'Which constructor takes' WHEN 6 THEN 'Show me the prompt for' WHEN 7 THEN 'Which env variable sets' WHEN 8 THEN 'What is the value of' WHEN 9 THEN 'Give an overview of the architecture and design of' WHEN 10 THEN 'How risky is changing' WHEN 11 THEN 'Refactor hotspots near' WHEN 12 THEN 'What depends on QueryPlanner in' WHEN 13 THEN 'How does the pipeline work end to end for' WHEN 14 THEN 'Which test covers' WHEN 15 THEN 'Can we trust the brier score of' WHEN 16 THEN 'Show unhealthy components near' WHEN 17 THEN 'Why is load_index failing, and why does it crash on' WHEN 18 THEN 'What breaks if i change' WHEN 19 THEN 'Find \"run_mission\" in' WHEN 20 THEN 'Trace what happens when the store and the planner connect to' WHEN 21 THEN 'Is it safe to rename or delete' WHEN 22 THEN 'Administrator minimum of' WHEN 23 THEN 'describe the components and how they communicate, while ranking' WHEN 24 THEN 'Which class is located in' WHEN 25 THEN 'tell me about' ELSE 'The' END || ' item ' || item_id AS text FROM {benchmark}",
    # changes, requests and decisions as texts
    "intent_sources": "SELECT 'COMMIT' AS source_type, 'c' || o_orderkey AS source_id, CASE o_orderkey % 12 WHEN 0 THEN 'Add JWT login and token refresh' WHEN 1 THEN 'cache results in redis' WHEN 2 THEN 'retry with backoff' WHEN 3 THEN 'refactor and cleanup' WHEN 4 THEN 'logging and metrics' WHEN 5 THEN 'migrate tables' WHEN 6 THEN 'fix typo' WHEN 7 THEN 'circuit-breaker for failover' WHEN 8 THEN 'shard and scale horizontally' WHEN 9 THEN 'encrypt with AES' ELSE 'update docs' END || ' ' || o_orderkey AS text, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {orders} UNION ALL SELECT 'PR', 'p' || c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'RBAC permissions' WHEN 1 THEN 'Reduce latency and response time' WHEN 2 THEN 'event-driven message bus' WHEN 3 THEN 'deprecate old API' WHEN 4 THEN 'GDPR compliance' ELSE 'misc' END || ' and Caching', CAST('2000-01-02 00:00:00' AS TIMESTAMP) FROM {customer} UNION ALL SELECT 'ADR', 'ADR-' || n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'We use microservices, oauth2 and caching' WHEN 1 THEN 'Monitoring by prometheus' WHEN 2 THEN 'Optimize throughput' ELSE 'Nothing here' END, CAST('1999-03-04 00:00:00' AS TIMESTAMP) FROM {nation}",
    # a listing of files with their first lines
    "files": "SELECT 'f' || doc_id AS file_id, CASE doc_id % 24 WHEN 0 THEN 'src/app' WHEN 1 THEN 'tests/unit' WHEN 2 THEN 'docs' WHEN 3 THEN 'scripts' WHEN 4 THEN 'dist/js' WHEN 5 THEN 'lib/core' WHEN 6 THEN 'node_modules/x' WHEN 7 THEN 'pkg/E2E' WHEN 8 THEN '.github/workflows' WHEN 9 THEN 'vendor/lib' WHEN 10 THEN 'tools' WHEN 11 THEN 'a/b/coverage' ELSE 'src' END || '/' || CASE doc_id % 17 WHEN 0 THEN 'main.py' WHEN 1 THEN 'index.test.ts' WHEN 2 THEN 'README.md' WHEN 3 THEN 'package-lock.json' WHEN 4 THEN 'app.min.js' WHEN 5 THEN 'test_x.py' WHEN 6 THEN 'tsconfig.base.json' WHEN 7 THEN '.env.local' WHEN 8 THEN 'ci.yml' WHEN 9 THEN 'run.sh' WHEN 10 THEN 'notes.txt' WHEN 11 THEN 'Dockerfile' WHEN 12 THEN 'util.go' WHEN 13 THEN 'data.bin' WHEN 14 THEN 'verify_all.py' WHEN 15 THEN 'x.map' ELSE 'Service.java' END AS path, CASE WHEN doc_id % 7 = 0 THEN 'import pytest' ELSE '' END || text AS content, n_chars * 40 AS size FROM {documents}",
    "links": "SELECT DISTINCT 'ADR-' || (p_partkey % 25) AS adr_id, 'm' || (p_partkey % 20) || '/p' || p_partkey AS node_id FROM {part} WHERE p_size % 2 = 0",
    "decisions": "SELECT 'ADR-' || n_nationkey AS id FROM {nation} UNION ALL SELECT 'ADR-' || (25 + r_regionkey) FROM {region}",
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", ROLES[name]))}
    return spark.sql(ROLES[name], **tables)


def ctes(*names: str) -> str:
    """The named roles as common table expressions."""
    plain = lambda text: re.sub(r"[{](\w+)[}]", r"\1", text).replace("{{", "{").replace("}}", "}")
    return ", ".join(f"{n} AS ({plain(ROLES[n])})" for n in names)


def with_(*names: str) -> str:
    return "WITH " + ctes(*names)

_NL = "chr(10)"
ROLES |= {
    # modules with their code, answers that speak of them, and what the answers were given as evidence
    "code_files": f"SELECT 'src/a/m' || s_suppkey || '.py' AS path, CASE WHEN s_suppkey % 7 = 3 THEN 'router = APIRouter()' || {_NL} WHEN s_suppkey % 7 = 5 THEN 'if __name__ == \"__main__\":' || {_NL} ELSE '' END || 'import m' || (s_suppkey % 5) || {_NL} || 'def run_' || (s_suppkey % 10) || '(x):' || {_NL} || '    value = call_' || (s_suppkey % 4) || '(x)' || {_NL} || '    return value + ' || (s_suppkey % 3) AS content FROM {{supplier}} UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'src/a/main.py' WHEN 1 THEN 'src/a/__init__.py' WHEN 2 THEN 'src/b/index.ts' ELSE 'src/b/left' || r_regionkey || '.py' END, 'x = 1' FROM {{region}}",
    "answers": f"SELECT p_partkey AS answer_id, CASE p_partkey % 13 WHEN 0 THEN '1. The retry_limit is ' || (p_size % 4) || ' here.' WHEN 1 THEN 'The project uses Redis for caching. It does not use Kafka. We have ' || p_size || ' steps.' WHEN 2 THEN 'In src/a/m' || (p_partkey % 11) || '.py it calls `run_' || (p_partkey % 10) || '` today. Later src/a/m2.py never uses `run_9`.' WHEN 3 THEN 'Both src/a/m' || (p_partkey % 9) || '.py and src/a/m' || (p_partkey % 21) || '.py are identical. See m1.py.' WHEN 4 THEN 'Code:' || {_NL} || '```py' || {_NL} || 'def run_' || (p_partkey % 10) || '(x):' || {_NL} || '    return value + ' || (p_size % 3) || {_NL} || '```' || {_NL} || 'done' WHEN 5 THEN 'It asks client_b first, then client_a and at last cache_c.' WHEN 6 THEN 'It asks client_a, client_b and cache_c.' WHEN 7 THEN 'I cannot determine the value of max_size, it may be 12.' WHEN 8 THEN 'The ratio is 0.55 and max_size equals ' || (p_size * 10) || '.' WHEN 9 THEN 'See src/a/m' || p_partkey || '.py and docs/x.md for the rest.' WHEN 10 THEN 'It depends on GraphQL and on call_1.' ELSE 'Nothing to say about ' || p_name END AS text FROM {{part}}",
    "evidence": f"SELECT p_partkey AS answer_id, 'src/a/m' || (p_partkey % 11) || '.py' AS file, 'retry_limit = 3' || {_NL} || 'def run_' || (p_partkey % 10) || '(x):' || {_NL} || '    value = call_1(x)' || {_NL} || '    return value + ' || (p_partkey % 3) || {_NL} || 'see docs/x.md' AS content FROM {{part}}",
    "answer_gaps": "SELECT p_partkey AS answer_id, CASE WHEN p_size % 2 = 0 THEN 'no source span' ELSE 'no definition' END AS gap FROM {part} WHERE p_size % 5 < 2",
    "numeric_facts": "SELECT * FROM (SELECT 'retry_limit' AS symbol, CAST(3 AS DOUBLE) AS value, 7 AS line UNION ALL SELECT 'cfg.max_size', CAST(100 AS DOUBLE), 20 UNION ALL SELECT 'ratio', CAST(0.55 AS DOUBLE), 9) AS f WHERE (SELECT count(*) FROM {region}) > 0",
    "fallback_facts": "SELECT * FROM (SELECT 'u1' AS unit, 1 AS place, 'client_a' AS symbol UNION ALL SELECT 'u1', 2, 'client_b' UNION ALL SELECT 'u1', 3, 'cache_c' UNION ALL SELECT 'u2', 1, 'other' UNION ALL SELECT 'u2', 2, 'client_a') AS f WHERE (SELECT count(*) FROM {region}) > 0",
    "import_edges": "SELECT 'src/a/m' || s_suppkey || '.py' AS src, 'src/a/m' || (s_suppkey % 5) || '.py' AS dst, 'imports' AS type FROM {supplier}",
}

ROLES |= {
    # symbols, annotations, facts and cached answers
    "symbols": "SELECT p_partkey AS symbol_id, CASE p_partkey % 5 WHEN 0 THEN 'QueryPlanner' WHEN 1 THEN 'run_mission' WHEN 2 THEN 'load_index' WHEN 3 THEN 'Planner' ELSE 'helper_' || (p_partkey % 9) END AS name, CASE WHEN p_partkey % 5 IN (0, 3) THEN 'class' ELSE 'function' END AS kind, p_partkey % 200 AS doc FROM {part} WHERE p_partkey < 2000",
    "annotations": "SELECT 'src/a/m' || s_suppkey || '.py' AS file, s_name || ' item ' || (s_suppkey % 30) AS what, CASE s_suppkey % 4 WHEN 0 THEN 'QueryPlanner' ELSE 'helper' END AS symbol, CASE s_suppkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'route' ELSE 'model' END AS signal, CASE s_suppkey % 2 WHEN 0 THEN 'entry' ELSE 'store' END AS signal2 FROM {supplier}",
    "file_chunks": "SELECT 'src/a/m' || ps AS file0, 'src/a/m' || ps || '.py' AS file, ps * 10 + n AS chunk, n * 40 AS start FROM (SELECT s_suppkey AS ps, 0 AS n FROM {supplier} UNION ALL SELECT s_suppkey, 1 FROM {supplier} UNION ALL SELECT s_suppkey, 2 FROM {supplier}) AS x",
    "channel_errors": "SELECT o_orderkey AS query, CASE o_orderkey % 3 WHEN 0 THEN 'symbol_lookup' WHEN 1 THEN 'flow_tracing' ELSE 'architecture_analysis' END AS strategy, CASE o_custkey % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'vector' ELSE 'pagerank' END AS channel, CASE o_custkey % 4 WHEN 0 THEN 'StoreError(IO): External error: Not found: x.part' ELSE 'timeout' END AS error FROM {orders} WHERE o_orderkey % 9 = 0",
    "channel_weights": "SELECT * FROM (SELECT 'symbol_lookup' AS strategy, 'bm25' AS channel, CAST(0.6 AS DOUBLE) AS weight UNION ALL SELECT 'symbol_lookup', 'vector', CAST(0.3 AS DOUBLE) UNION ALL SELECT 'symbol_lookup', 'pagerank', CAST(0.1 AS DOUBLE) UNION ALL SELECT 'flow_tracing', 'bm25', CAST(0.4 AS DOUBLE) UNION ALL SELECT 'flow_tracing', 'vector', CAST(0.4 AS DOUBLE) UNION ALL SELECT 'flow_tracing', 'pagerank', CAST(0.2 AS DOUBLE) UNION ALL SELECT 'architecture_analysis', 'bm25', CAST(0.2 AS DOUBLE) UNION ALL SELECT 'architecture_analysis', 'vector', CAST(0.3 AS DOUBLE) UNION ALL SELECT 'architecture_analysis', 'pagerank', CAST(0.5 AS DOUBLE)) AS w WHERE (SELECT count(*) FROM {region}) > 0",
    "unit_facts": "SELECT l_orderkey * 10 + l_linenumber AS fact_id, 'src/M' || (l_partkey % 12) || '.py' AS file_path, CASE WHEN l_partkey % 5 = 0 THEN 'MAX_' || (l_suppkey % 7) ELSE 'plan_limit' END AS symbol, CASE l_linenumber WHEN 1 THEN 'numeric_threshold' WHEN 2 THEN 'constant' WHEN 3 THEN 'call_site' ELSE 'import' END AS fact_type, 'number' AS value_kind, 'plan_limit = plan_' || l_suppkey AS source_text, CAST(l_partkey % 50 AS VARCHAR(9)) AS value, l_linenumber * 3 AS start_line, l_linenumber * 3 + 1 AS end_line FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} WHERE l_orderkey % 40 = 0 GROUP BY 1, 2) AS x",
    "cache_pairs": "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 10 AS DOUBLE) / 10 END AS quality, c_custkey % 3 AS hits FROM {customer}",
    "cache_events": "SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END AS delta, CAST(o_orderdate AS TIMESTAMP) AS seen_at FROM {orders}",
    # knowledge: proposals, notes with vectors, validation requests
    "proposals": "SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'ext' || (event_id % 27) ELSE NULL END AS external_id, CASE event_id % 6 WHEN 0 THEN 'Use retries for ' WHEN 1 THEN 'use RETRIES, for ' WHEN 2 THEN 'Never use retries for ' WHEN 3 THEN '' ELSE 'Cache results of ' END || 'svc' || (user_id % 12) AS content, 'svc' || (user_id % 12) AS subject, CASE WHEN event_id % 11 = 0 THEN 'user' WHEN event_id % 7 = 0 THEN 'system' WHEN event_id % 2 = 0 THEN 'mentor' ELSE 'agent' END AS author, event_type AS tag FROM {events} WHERE event_id % 3 <> 1",
    "notes": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'r1' ELSE 'r2' END AS repository_id, CASE WHEN vec_id % 2 = 0 THEN 'repo' ELSE 'file' END AS scope, vec_id % 10 = 0 AS stale, CASE vec_id % 4 WHEN 0 THEN 'db' WHEN 1 THEN 'api' ELSE 'ui' END AS tag, CASE WHEN vec_id % 5 = 0 THEN 'dormant' WHEN vec_id % 5 = 1 THEN NULL ELSE 'active' END AS status, CASE WHEN vec_id % 11 = 0 THEN 'user' WHEN vec_id % 7 = 0 THEN 'system' ELSE 'agent' END AS author, vec_id % 40 AS age_days, CAST(vec_id % 10 AS DOUBLE) / 10 AS confidence, embedding FROM {embeddings}",
    "knowledge_records": "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'validated' WHEN 2 THEN 'promoted' ELSE 'invalidated' END AS state, value AS confidence, CASE user_id % 5 WHEN 0 THEN 'validate' WHEN 1 THEN 'promote' WHEN 2 THEN 'contradict' WHEN 3 THEN 'expire' ELSE 'retire' END AS request, event_id % 60 AS idle_days FROM {events}",
}

_K = "CAST(k AS VARCHAR(9))"
_PY = {
    0: ["from fastapi import APIRouter", "router = APIRouter()", "@router.get(''/items'')", "async def list_items(limit: int, q: str) -> list:", "    return load(limit)"],
    1: ["import celery", "@app.task", "def send_mail(to: str) -> None:", "    pass", "if __name__ == ''__main__'':", "    send_mail(1)"],
    2: ["from src.a.p3 import Base3", "from . import p5, p6", "class Child{k}(Base3, Worker):", "    def run(self):", "        self.x = helper()", "    def other(self, n: int):", "        pass", "def run_child():", "    pass"],
    3: ["import os", "class Base{k}:", "    def helper(self):", "        return 1", "def typed(a: Dict«str, int», b: Callable««int, str», None» = None,  # more", "          *rest: int) -> Dict«str, List«int»»:", "    pass"],
    4: ["from ..b import q", "def test_one():", "    assert True", "class TestAll:", "    pass"],
    5: ["@click.command()", "def cli():", "    run_all()", "@bus.on_event(''start'')", "def started(evt):", "    pass"],
}
_TS = ["import [ x ] from ''./v{m}''", "import react from ''react''", "export class View{k} extends Base3 implements Shape, Other [", "]", "app.post(''/save'', handler)", "element.addEventListener(''x'', f)", "function boot(a: string): void [", "]", "const y = require(''../a/p1'')", "process.argv", "export class Job{k} extends Worker [", "    constructor(private readonly a: Map<string, number>, b = 1) [", "        if (a) [", "        ]", "    ]", "    async run(n: number): Promise<void> [", "        this.go()", "    ]", "    process = async (x: string) => [", "    ]", "    private multi(", "        a: string,", "        b?: number", "    ): Record<string, number> [", "    ]", "]", "export const arrow = (a: string, cb: (x: number) => void): void => [", "]"]


def _code(lines: list[str]) -> str:
    text = f" || {_NL} || ".join("'" + x.replace("[", "{{").replace("]", "}}").replace("«", "[").replace("»", "]") + "'" for x in lines)
    return text.replace("{k}", f"' || {_K} || '").replace("{m}", "' || CAST(k % 13 AS VARCHAR(9)) || '")


_PROJECT = "(SELECT s_suppkey AS k FROM {supplier}) AS s"
ROLES |= {
    # a repository of both languages
    "project_files": "SELECT CASE WHEN k % 7 = 6 THEN 'src/b/v' || k || '.ts' ELSE 'src/a/p' || k || '.py' END AS path, CASE k % 7 " + " ".join(f"WHEN {n} THEN {_code(lines)}" for n, lines in _PY.items()) + f" ELSE {_code(_TS)} END AS content FROM {_PROJECT}",
    "project_roles": f"SELECT 'src/a/p' || k || '.py' AS path, CASE WHEN k % 2 = 0 THEN 'service' ELSE 'model' END AS role FROM {_PROJECT}",
    # units and their facts, functions, chat and feedback
    "graph_units": "SELECT 'u' || p_partkey AS unit_id, 'src/f' || (p_partkey % 40) || '.py' AS file_path, 'Mod.name' || (p_partkey % 60) AS symbol, CASE WHEN p_partkey % 4 = 0 THEN 'u' || (p_partkey - 1) ELSE NULL END AS parent_id FROM {part} WHERE p_partkey <= 400",
    "graph_facts": "SELECT 'u' || (l_partkey % 400) AS unit_id, CASE l_linenumber % 10 WHEN 1 THEN 'call_site' WHEN 2 THEN 'calls_method' WHEN 3 THEN 'assignment' WHEN 4 THEN 'import' WHEN 5 THEN 'instantiation' WHEN 6 THEN 'implements' WHEN 7 THEN 'fallback_chain' WHEN 0 THEN 'config_read' ELSE 'dict_literal' END AS fact_type, 'x.Name' || (l_suppkey % 60) AS symbol FROM {lineitem} WHERE l_orderkey % 3 = 0",
    "functions": "SELECT 'n' || p_partkey AS node, 'load_' || (p_partkey % 30) AS name, 'src/' || CASE p_partkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'planner' ELSE 'cache' END || '.py' AS path, p_name AS doc, 'return ' || p_size AS body, p_partkey % 17 = 0 AS entry, CAST(p_size % 8 AS INT) AS inbound, CAST(p_size AS DOUBLE) / 10 AS importance FROM {part} WHERE p_partkey <= 500",
    "rebuild_requests": "SELECT CASE s_suppkey % 6 WHEN 0 THEN 'files.json' WHEN 1 THEN 'project.json' WHEN 2 THEN 'modules.json' WHEN 3 THEN 'lexical_map.json' WHEN 4 THEN 'call_graph_v2.json' ELSE 'validation_report.json' END AS artifact, s_suppkey AS seq, 'src/a/p' || (s_suppkey % 5) || '.py' AS file FROM {supplier}",
    "chat_messages": "SELECT c_nationkey AS session, c_custkey * 2 + 1 AS at, CASE c_custkey % 5 WHEN 0 THEN 'Sorry, that''s wrong: see ' || c_name WHEN 1 THEN 'No, it is in the other module' WHEN 2 THEN 'You used the WRONG FILE' ELSE 'thanks ' || c_name END AS text FROM {customer}",
    "chat_answers": "SELECT c_nationkey AS session, c_custkey * 2 AS at, c_custkey AS answer_id FROM {customer} WHERE c_custkey % 3 = 0",
    "feedback_events": "SELECT o_orderkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'corrective_followup' WHEN 1 THEN 'cited_nonexistent_file' ELSE 'navigation_divergence' END AS event_type, CASE WHEN o_orderkey % 3 = 1 THEN 'src/gone' || (o_custkey % 9) || '.py' ELSE NULL END AS nonexistent_path, CASE WHEN o_orderkey % 3 = 2 THEN 'src/a/p' || (o_custkey % 20) || '.py' ELSE NULL END AS navigated_to, o_custkey % 2 = 0 AS flow FROM {orders} WHERE o_orderkey % 20 < 3",
    "retrieved_artifacts": "SELECT l_orderkey AS event_id, CASE l_linenumber % 3 WHEN 0 THEN 'behavioral_path' WHEN 1 THEN 'file_understanding' ELSE 'concept_map' END AS artifact_type, CASE l_linenumber % 3 WHEN 0 THEN 'bp' || (l_partkey % 6) WHEN 1 THEN 'src/a/p' || (l_partkey % 20) || '.py' ELSE 'concept' || (l_partkey % 5) END AS artifact_id FROM {lineitem}",
    "concept_places": "SELECT 'concept' || (p_partkey % 5) AS concept, 'src/gone' || (p_partkey % 12) || '.py' AS path FROM {part} WHERE p_partkey < 40",
    "path_files": "SELECT 'bp' || (p_partkey % 6) AS path_id, 'src/a/p' || (p_partkey % 20) || '.py' AS file FROM {part} WHERE p_partkey < 30",
    "module_files": "SELECT DISTINCT 'src/a/p' || (p_partkey % 20) || '.py' AS path, 'src/a' || (p_partkey % 4) AS module FROM {part} WHERE p_partkey % 20 < 15 AND p_partkey < 20",
    "architecture_evidence": "SELECT l_suppkey % 12 AS query, CASE l_linenumber % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'architecture' ELSE 'dependency' END AS source, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'src/f' || (l_partkey % 9) || '.py' END AS file, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'Comp' || (l_partkey % 8) END AS symbol FROM {lineitem}",
    "brief_changes": "SELECT 'src/m' || (l_partkey % 20) || '/p' || l_partkey AS file, CASE WHEN l_returnflag = 'R' THEN 'D' WHEN l_linenumber = 1 THEN 'A' ELSE 'M' END AS change_type, l_orderkey AS sha, CAST(o_orderdate AS TIMESTAMP) AS at FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey",
    "community_members": "SELECT 'm' || (p_partkey % 20) || '/p' || p_partkey AS member, 'C' || (p_partkey % 6) AS community FROM {part} WHERE p_partkey % 3 <> 0",
    "file_annotations": "SELECT 'src/m' || (p_partkey % 20) || '/p' || p_partkey AS file, CAST(CASE WHEN p_size % 2 = 0 THEN '2001-07-20 00:00:00' ELSE '2001-08-30 00:00:00' END AS TIMESTAMP) AS annotated_at FROM {part} WHERE p_partkey % 4 <> 0",
    "file_notes": "SELECT ps AS note, 'src/m' || (f % 20) || '/p' || f AS file FROM (SELECT p_partkey AS ps, p_partkey % 50 AS f FROM {part}) AS x",
}

_J = {"{": "{{", "}": "}}"}


def _json(text: str) -> str:
    return "".join(_J.get(c, c) for c in text)


ROLES |= {
    # exports and traces as files
    "manual_traces": "SELECT 'f' || s_suppkey AS file, CASE WHEN s_suppkey % 9 = 4 THEN 'no json' ELSE '" + _json('{"calls": [{"caller": "src/a.py:run_') + "' || (s_suppkey % 5) || '" + _json('", "callee": "./src/b.py:load"}, {"caller": "main", "callee": "src/a.py:go"}]}') + "' END AS content FROM {supplier}",
    "test_reports": "SELECT 'r' || s_suppkey AS file, CASE WHEN s_suppkey % 7 = 3 THEN 'broken' ELSE '" + _json('{"tests": [{"nodeid": "tests/t') + "' || (s_suppkey % 4) || '" + _json('.py::test_x", "outcome": "failed", "call": {"traceback": [{"path": "src/a.py", "name": "go"}, {"file": "src/b.py", "function": "load"}], "crash": {"path": "src/b.py", "message": "ValueError: bad"}}}, {"nodeid": "tests/u.py::test_y", "outcome": "passed"}]}') + "' END AS content FROM {supplier}",
    "test_outputs": f"SELECT 'o' || s_suppkey AS file, '  File \"tests/t' || (s_suppkey % 3) || '.py\", line 3, in test_a' || {_NL} || '  File \"src/a.py\", line 9, in go' || {_NL} || '  File \"src/b.py\", line 2, in load' || {_NL} || 'KeyError: x' AS content FROM {{supplier}}",
    "coverage_reports": "SELECT 'c' || s_suppkey AS file, '" + _json('{"files": {"./src/m') + "' || (s_suppkey % 6) || '" + _json('.py": {"executed_lines": [1, 2, ') + "' || (s_suppkey % 40 + 3) || '" + _json(']}, "src/none.py": {"executed_lines": []}}}') + "' AS content FROM {supplier}",
    "span_exports": "SELECT 's' || s_suppkey AS file, '" + _json('{"spans": [{"traceId": "t", "spanId": "1", "name": "root"}, {"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "n') + "' || (s_suppkey % 4) || '" + _json('", "attributes": [{"key": "code.filepath", "value": {"stringValue": "src/s.py"}}, {"key": "code.function", "value": {"stringValue": "serve"}}]}, {"traceId": "t", "spanId": "3", "parentSpanId": "2", "name": "db"}, {"traceId": "t", "spanId": "4", "parentSpanId": "9", "name": "lost"}]}') + "' AS content FROM {supplier}",
    "app_logs": "SELECT 'l' || p_partkey AS file, 'INFO load_index took ' || p_size || ' ms in helper_' || (p_partkey % 9) AS content FROM {part} WHERE p_partkey < 300",
    "pull_exports": "SELECT 'p' || o_orderkey AS file, '" + _json('{"id": "pr') + "' || (o_orderkey % 500) || '" + _json('", "title": "T') + "' || o_orderkey || '" + _json('", "author": "dev') + "' || (o_custkey % 9) || '" + _json('", "state": "merged", "updated_at": "') + "' || substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) || '" + _json('T00:00:00Z", "comments": [{"author": "a", "body": "b"}], "files": ["src/x.py", "src/y.py"], "commits": ["c') + "' || (o_orderkey % 3) || '" + _json('"]}') + "' AS content FROM {orders} WHERE o_orderkey % 3 = 0",
    "terminal_errors": "SELECT 'ws' || (user_id % 7) AS cwd, ts AS at, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'cmd' || event_id END AS command, CAST(user_id % 3 AS INT) AS exit_code, chr(27) || '[31mfailed ' || event_id || chr(27) || '[0m' AS output FROM {events} WHERE event_type = 'error'",
    "decision_files": f"SELECT 'docs/adr-' || n_nationkey || '.md' AS file, '# Use ' || n_name || {_NL} || {_NL} || '## Status' || {_NL} || CASE WHEN n_nationkey % 2 = 0 THEN 'Accepted' ELSE 'proposed' END || {_NL} || {_NL} || '## Context' || {_NL} || 'We need ' || n_name || {_NL} || '## Decision' || {_NL} || 'Take it' || {_NL} || '## Consequences' || {_NL} || 'None' AS content FROM {{nation}}",
    "decision_files_before": f"SELECT 'docs/adr-' || n_nationkey || '.md' AS file, '# Use ' || n_name || {_NL} || {_NL} || '## Status' || {_NL} || CASE WHEN n_nationkey % 2 = 0 THEN 'Accepted' ELSE 'draft' END || {_NL} || {_NL} || '## Context' || {_NL} || 'We need ' || n_name || {_NL} || '## Decision' || {_NL} || 'Take it' || {_NL} || '## Consequences' || {_NL} || 'None' AS content FROM {{nation}} WHERE n_nationkey < 20 UNION ALL SELECT 'docs/adr-' || (90 + r_regionkey) || '.md', 'gone' FROM {{region}}",
    "runtime_log_lines": "SELECT 'log' || (user_id % 9) AS file, CAST(row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id) + 1 AS INT) AS line, CASE event_id % 6 WHEN 0 THEN 'not json' ELSE '" + _json('{"event_id": "e') + "' || event_id || '" + _json('", "component_id": "svc') + "' || (user_id % 5) || '" + _json('", "event_type": "x", "severity": "') + "' || CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'INFO' WHEN 2 THEN 'LOUD' ELSE 'CRITICAL' END || '" + _json('"}') + "' END AS value FROM {events} UNION ALL SELECT 'log' || r_regionkey, 1, CASE WHEN r_regionkey = 3 THEN '" + _json('{"other": 1}') + "' ELSE '" + _json('{"repository_commit_hash": "h') + "' || r_regionkey || '" + _json('"}') + "' END FROM {region}",
    "sync_state": "SELECT 'commits' AS stream, CAST('2000-06-01 00:00:00' AS TIMESTAMP) AS mark FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'pulls', CAST('1999-01-01 00:00:00' AS TIMESTAMP) FROM {region} WHERE r_regionkey = 0",
    "commit_times": "SELECT o_orderkey AS sha, CAST(o_orderdate AS TIMESTAMP) AS at FROM {orders}",
    "segment_docs": "SELECT CAST(p_partkey % 700 AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS seq FROM {part}",
    "segment_deletes": "SELECT CAST(s_suppkey * 5 AS BIGINT) AS id, CAST(s_suppkey * 9 AS BIGINT) AS seq FROM {supplier}",
    "file_events": "SELECT 'f' || (user_id % 6) AS file, CAST(ts AS TIMESTAMP) AS at, event_id AS seq, event_type AS kind FROM {events}",
}

ROLES |= {
    "provider_hits": "SELECT item_id AS query, CASE n WHEN 0 THEN 'text' WHEN 1 THEN 'facts' WHEN 2 THEN 'graph' ELSE 'symbols' END AS provider, CAST(r AS INT) AS rank, (item_id * 7 + r * (n + 1)) % 90 AS id FROM {benchmark} CROSS JOIN (SELECT r_regionkey AS n FROM {region} WHERE r_regionkey < 4) AS a CROSS JOIN (SELECT n_nationkey + 1 AS r FROM {nation} WHERE n_nationkey < 20) AS b",
    "evidence_texts": "SELECT doc_id AS id, text, n_chars AS chars FROM {documents} WHERE doc_id < 90",
    "question_gaps": "SELECT item_id AS query, 'no test' AS gap FROM {benchmark} WHERE item_id % 4 = 1",
    "plan_documents": f"SELECT p_partkey AS doc, '# Plan' || {_NL} || '- [x] add ' || p_name || ' to `src/f' || (p_partkey % 30) || '.py`' || {_NL} || '- [ ] test ' || p_name || {_NL} || '2. write docs for `docs/a.md` and `src/x.py`' || {_NL} || 'no task' AS text FROM {{part}} WHERE p_partkey <= 150",
    "plan_units": "SELECT p_partkey AS unit, 'add ' || p_name || ' to the store' AS text, 'src/f' || (p_partkey % 45) || '.py' AS file FROM {part} WHERE p_partkey <= 400",
}

ROLES |= {
    "call_units": "SELECT 'u' || p_partkey AS unit_id, 'src/f' || (p_partkey % 40) || '.py' AS file_path, 'Mod.name' || ((p_partkey * 3) % 170) AS symbol, 'c' || (p_partkey % 70) AS parent_id FROM {part} WHERE p_partkey <= 400",
    "call_sites": "SELECT 'u' || (l_partkey % 400) AS unit_id, 'x.Name' || ((l_suppkey * 7 + l_linenumber) % 170) AS symbol FROM {lineitem} WHERE l_orderkey % 3 = 0 AND l_linenumber < 3",
    "unit_imports": "SELECT DISTINCT 'src/f' || (p_partkey % 40) || '.py' AS src, 'src/f' || ((p_partkey * 7 + 3) % 40) || '.py' AS dst FROM {part} WHERE p_partkey <= 60",
}
