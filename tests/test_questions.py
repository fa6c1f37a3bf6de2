"""What questions ask for: tables written by hand from what each question says, not from the rules."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions import questions as fn

TYPES = [
    ("What is the max upload size?", "threshold"), ("How many workers are started?", "list_count"), ("Which fallback is tried when the model is down?", "fallback_chain"), ("I am a new developer, what first?", "onboarding_analysis"),
    ("Where is the parser?", "symbol_location"), ("What does the constructor take?", "dependency_injection"), ("Show the prompt for summaries", "prompt_template"), ("Which env switches it on?", "config_surface"), ("Tell me the value of ALPHA", "exact_constant"),
    ("Give me an overview of the code", "architecture_analysis"), ("How risky is changing the store?", "change_impact_prediction"), ("Is there technical debt here?", "refactoring_analysis"), ("What depends on the cache?", "impact_analysis"), ("Explain the scheduler", "behavior_explanation"),
    ("Is there a mock for it?", "test_query"), ("Can we trust these numbers?", "prediction_accountability"), ("Any runtime failures today?", "runtime_intelligence"), ("Show me maxRetries please", "threshold"), ("administrator rights", "unknown"), ("", "unknown"), ("hello", "unknown"),
]
INTENTS = [
    ("Walk me through a request", "flow"), ("what happens when a file is saved", "flow"), ("How does login work?", "flow"), ("What is the entry point?", "orientation"), ("how does it support plugins", "orientation"), ("Where are the settings kept?", "location"), ("which class parses dates", "location"),
    ("Why is the build slow?", "debugging"), ("there is a bug in search", "debugging"), ("describe the design", "architecture"), ("how are the parts connected", "architecture"), ("tell me more", "explanation"), ("", "explanation"),
]
STRATEGIES = [
    ("locate the parser", "symbol_lookup", 5, 20, 0.7), ("trace a request", "flow_tracing", 20, 50, 0.7), ("show me the query", "targeted_extraction", 3, 8, 0.7), ("the server may crash", "error_investigation", 15, 40, 0.7), ("which port is it", "configuration_lookup", 5, 10, 0.7),
    ("system overview please", "architecture_analysis", 100, 300, 0.7), ("describe the cache", "behavior_explanation", 50, 150, 0.7), ("which class is it", "symbol_lookup", 5, 20, 0.6), ("an issue with it", "error_investigation", 15, 40, 0.6), ("tell me more", "behavior_explanation", 50, 150, 0.6),
]
ROUTES = [
    ("where is the lexer", "LOCATION", 0.8, None), ("tell me about tokens", "EXPLANATION", 0.8, None), ("the lifecycle of a job, step by step", "FLOW", 1.0, None), ("what breaks if i change this", "IMPACT_ANALYSIS", 1.0, None), ("should we rename it", "REFACTOR_RISK", 0.8, None),
    ("any runtime risks", "RUNTIME_INTELLIGENCE", 1.0, None), ("what is broken", "DEBUGGING", 0.8, None), ("explain the design", "EXPLANATION", 0.7, "ARCHITECTURE"), ("hm", "EXPLANATION", 0.5, None),
]
ENTITIES = [
    ("where is 'the big parser' used", "the big parser", 1.0), ("what does TokenStream do", "TokenStream", 1.0), ("why is max_retries three", "max_retries", 0.8), ("where is the main parsing logic", "parsing", 0.85), ("show retries quickly", "retries_quickly", 0.6), ("how is it", "", 0.0),
]
PURPOSES = [
    ("add jwt login", {("SECURITY", "Authentication")}), ("Encryption of tokens at rest", {("SECURITY", "Encryption")}), ("use redis to cut response time", {("PERFORMANCE", "Caching"), ("PERFORMANCE", "Latency Reduction")}), ("retry with backoff", {("RELIABILITY", "Retry Logic")}), ("circuit-breaker around payments", {("RELIABILITY", "Circuit Breaker")}),
    ("sharding by user", {("SCALABILITY", "Data Partitioning")}), ("migrate off the monolith", {("MIGRATION", "Migration"), ("ARCHITECTURE", "System Architecture")}), ("fix a typo", set()), ("", set()),
]


def asked(spark, rows, columns):
    return spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "id int, text string").select("id", columns.alias("r")).orderBy("id").collect()


@pytest.mark.parametrize(("rows", "of"), [(TYPES, lambda: fn.question_type(F.col("text"))), (INTENTS, lambda: fn.intent(F.lower("text")))])
def test_types_and_intents(spark, rows, of):
    assert [(rows[r.id][0], r.r) for r in asked(spark, rows, of())] == rows


def test_strategies(spark):
    assert [(STRATEGIES[r.id][0], *r.r) for r in asked(spark, STRATEGIES, fn.strategy(F.lower("text")))] == STRATEGIES


def test_routes(spark):
    assert [(ROUTES[r.id][0], r.r.primary, r.r.score, r.r.secondary) for r in asked(spark, ROUTES, fn.route(F.col("text")))] == ROUTES


def test_entities(spark):
    assert [(ENTITIES[r.id][0], *r.r) for r in asked(spark, ENTITIES, fn.primary_entity(F.col("text")))] == ENTITIES


def test_purposes(spark):
    assert [(PURPOSES[r.id][0], {(x.type, x.topic) for x in r.r}) for r in asked(spark, PURPOSES, fn.purposes(F.col("text")))] == PURPOSES


def test_complexity(spark):
    rows = [("rename it", 0), ("why does the planner fail", 2 + 1 + 1), ("how does the store depend on memory and routing of tokens", 2 + 1 + 1 + 3 + 1), ("", 0)]
    assert [(rows[r.id][0], r.r) for r in asked(spark, rows, fn.complexity(F.col("text")))] == rows
