"""What a question asks for, by rules alone: type, complexity, intent, retrieval strategy, weighted routing, the entity it is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered patterns of question types; the first that matches names the type.
QUESTION_TYPES: list[tuple[str, str]] = [
    ("threshold", r"\b(threshold|limit|max|min)\b"),
    ("list_count", r"\b(how many|count|length|size)\b"),
    ("fallback_chain", r"\b(fallback|failover|default|retry)\b"),
    ("onboarding_analysis", r"\b(onboard|new developer|getting started|learning path|where should i start|read first)\b"),
    ("symbol_location", r"\bwhere\b"),
    ("dependency_injection", r"\b(inject|constructor|init|initializ|parameter)\b"),
    ("prompt_template", r"\b(prompt|template|instruction)\b"),
    ("config_surface", r"\b(config|env|variable)\b"),
    ("exact_constant", r"\b(constant|value of)\b"),
    ("architecture_analysis", r"\b(structure|architecture|overview|folder|purpose|major components|important components)\b"),
    ("change_impact_prediction", r"\b(what happens if i modify|what happens if i change|how risky is changing|risk of changing|predict impact)\b"),
    ("refactoring_analysis", r"\b(refactor|refactoring|hotspots?|technical debt|architectural debt|cleanup|risky modules?|risky)\b"),
    ("impact_analysis", r"\b(what depends on|what uses|what calls|what imports|who uses|what breaks if|impact of changing|impact of modifying|where is this used|instantiates|blast radius|blast)\b"),
    ("behavior_explanation", r"\b(how does|explain|what does|what is|what are|what's|behavior)\b"),
    ("test_query", r"\b(test|mock|spec)\b"),
    ("prediction_accountability", r"\b(accurate|trust|brier score|prediction quality|false positive rate|false negative rate|prediction drift)\b"),
    ("runtime_intelligence", r"\b(runtime components|runtime failures|runtime risks|runtime health|unhealthy components|degraded runtime)\b"),
]
#: Words of complex questions, with what each adds.
RELATION_WORDS = ("interact", "depend", "call", "use", "connect", "communicate")
SYSTEM_WORDS = ("architecture", "system", "ingestion", "retrieval", "memory", "planner", "explorer", "store", "packet", "builder", "pipeline", "routing", "token", "budget", "synthesizer", "dispatcher", "ranking", "model", "flow", "rationale", "design", "module", "component", "codebase", "logic", "process", "subsystem")
TROUBLE_WORDS = ("error", "fail", "bug", "crash", "why did", "issue", "wrong", "broken", "not working", "trace", "exception", "new developer", "get started", "start looking", "understand")
CONJUNCTIONS = ("and", "but", "or", "while", "although")
REASON_WORDS = ("how does", "why", "explain", "what is the purpose", "how do we", "what is the overall", "rationale behind")
FOLLOW_UP = r"\b(it|that|this one|the other one|why did (it|that) fail|what about (it|that|them))\b"
#: Patterns of intents, in the order they are tried.
INTENTS: list[tuple[str, str]] = [
    ("flow", r"\bhow\s+does\b.{0,30}\bwork\b|\bend\s+to\s+end\b|\btrace\b|\bwalk\s+me\s+through\b|\bstep\s+by\s+step\b|\bwhat\s+happens\s+when\b|\bsequence\b|\bpipeline\b|\blifecycle\b|\bfrom\s+start\b|\bend-to-end\b"),
    ("orientation", r"\bprimary\b|\bhow\s+(does|do)\b.{0,30}\bsupport\b|\bwhat\s+is\b.{0,30}\bpattern\b|\bentry\s+point\b|\bwhere\s+are\s+the\s+default\b|\boverview\b"),
    ("location", r"\bwhere\s+is\b|\bwhere\s+are\b|\bwhich\s+file\b|\bfind\b.{0,20}\bfunction\b|\bdefined\b|\blocated\b|\bwhich\s+class\b|\bwhere\s+can\s+i\s+find\b"),
    ("debugging", r"\bwhy\s+would\b|\bwhy\s+is\b|\bwhy\s+does\b|\bcause\b|\bfail\b|\berror\b|\bbug\b|\bnot\s+working\b|\bbroken\b|\bissue\b|\bproblem\b"),
    ("architecture", r"\bhow\s+are\b.{0,20}\bconnected\b|\boverall\s+structure\b|\barchitecture\b|\bdesign\b|\bhigh\s+level\b|\bsystem\s+overview\b|\bhow\s+does\s+the\s+system\b|\bcomponents\b|\bmodules\b"),
]
#: Strategies in the order they are tried, with their patterns.
STRATEGIES: list[tuple[str, str]] = [
    ("symbol_lookup", r"\bwhere\s+is\b|\bwhere\s+are\b|\bwhich\s+file\b|\bfind\b|\blocated\b|\blocate\b"),
    ("flow_tracing", r"\btrace\b|\bwalk\s+me\s+through\b|\bstep\s+by\s+step\b|\bwhat\s+happens\b|\bsequence\b|\blifecycle\b|\bend\s+to\s+end\b|\bflow\b|\bhow\s+does\b.*?\bhandle\b|\binitialized\b"),
    ("targeted_extraction", r"\bextract\b|\bexact\b|\bshow\s+me\s+the\b|\bget\s+the\b|\bschema\b|prompt|\bregex\b|\bsql\b|\bstring\b"),
    ("error_investigation", r"\bwhy\b|\berror\b|\bcause\b|\bfail\b|\bbug\b|\bcrash\b|\bnot\s+found\b"),
    ("configuration_lookup", r"\bconfiguration\b|\bconfig\b|\bproperties\b|threshold|\bweights\b|\bdefault\b|\bvalue\b|timeout|\bport\b|\bhow\s+many\b|\blist\s+all\b"),
    ("architecture_analysis", r"\bconnected\b|\bstructure\b|\bdesign\b|\bcomponents\b|\bdatabase\s+transactions\b|\bmodules\b|\bsystem\s+overview\b"),
    ("behavior_explanation", r"\bwhat\s+does\b|\bexplain\b|\bhow\s+is\b|\bdescribe\b|\bpurpose\b|\brole\b|\baccomplish\b"),
]
#: Least and most chunks of each strategy, and the strategy of an intent where no pattern matches.
CHUNKS = {"symbol_lookup": (5, 20), "configuration_lookup": (5, 10), "targeted_extraction": (3, 8), "flow_tracing": (20, 50), "behavior_explanation": (50, 150), "architecture_analysis": (100, 300), "error_investigation": (15, 40)}
OF_INTENT = {"location": "symbol_lookup", "explanation": "behavior_explanation", "flow": "flow_tracing", "architecture": "architecture_analysis", "debugging": "error_investigation", "orientation": "architecture_analysis"}
#: Weighted phrases of the router.
ROUTES: dict[str, dict[str, float]] = {
    "LOCATION": {"where is": 0.8, "what file": 0.8, "which file": 0.8, "where does": 0.8, "show me": 0.7, "find": 0.6, "locate": 0.6},
    "EXPLANATION": {"how does": 0.8, "what does": 0.8, "tell me about": 0.8, "explain": 0.7, "describe": 0.7, "what is": 0.6},
    "FLOW": {"end to end": 0.9, "step by step": 0.9, "walkthrough": 0.8, "lifecycle": 0.8, "flow": 0.7, "pipeline": 0.7, "sequence": 0.7, "trace": 0.7},
    "ARCHITECTURE": {"how is it organized": 0.9, "architecture": 0.8, "structure": 0.8, "design": 0.7, "overview": 0.7, "components": 0.7, "system": 0.6},
    "DEBUGGING": {"why is": 0.8, "why does": 0.8, "failing": 0.8, "broken": 0.8, "crash": 0.8, "exception": 0.8, "error": 0.7, "bug": 0.7, "wrong": 0.7},
    "IMPACT_ANALYSIS": {"what breaks": 0.9, "what changes": 0.9, "impact of": 0.9, "if i change": 0.9, "what depends on": 0.8, "what uses": 0.8},
    "REFACTOR_RISK": {"safe to change": 0.9, "can i change": 0.9, "refactor": 0.8, "rename": 0.8, "delete": 0.8, "remove": 0.8, "move": 0.7},
    "PREDICTION_ACCOUNTABILITY": {"how accurate are": 0.9, "can we trust": 0.9, "brier score": 0.9, "prediction quality": 0.9, "false positive rate": 0.9, "prediction drift": 0.8, "false negative rate": 0.9},
    "RUNTIME_INTELLIGENCE": {"runtime components": 0.9, "runtime failures": 0.9, "runtime risks": 0.9, "runtime health": 0.9, "unhealthy components": 0.8, "degraded runtime": 0.8, "runtime": 0.7},
}
#: Words that name nothing.
STOP_WORDS = ("is are was were does do did where how what why when which who find show tell explain the a an in on at by for of to from with and or but not defined located handled implemented called used function class method file module code feature functionality system component logic executed project codebase").split()
QUALIFIERS = "main primary core entire whole full actual new old".split()


def _first(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    found = otherwise
    for name, pattern in reversed(rules):
        found = F.when(text.rlike("(?i)" + pattern), F.lit(name)).otherwise(found)
    return found


def question_type(text: Column) -> Column:
    """The type of the first rule that matches; as a last resort a threshold word inside another word."""
    text = F.lower(text)
    inside = F.when(text.rlike("threshold|limit|max|min") & ~text.rlike("admin"), "threshold").otherwise("unknown")
    return _first(text, QUESTION_TYPES, inside)


def complexity(text: Column, follows: Column | None = None) -> Column:
    """Points for length, relations, system and trouble words, conjunctions and asking for reasons; a question with two is complex.

    follows: whether the question follows others; short ones, and those that point back, then count double.
    """
    low = F.lower(text)
    tokens = F.split(text, r"\s+", -1)
    has = lambda words: sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))
    word = lambda words: sum((low.rlike(rf"\b{w}\b").cast("int") for w in words[1:]), low.rlike(rf"\b{words[0]}\b").cast("int"))
    joined = F.size(F.filter(tokens, lambda t: F.lower(t).isin(*CONJUNCTIONS)))
    score = (F.size(tokens) > 7).cast("int") + has(RELATION_WORDS) + word(SYSTEM_WORDS) + has(TROUBLE_WORDS) + joined + 2 * has(REASON_WORDS)
    if follows is not None:
        score = score + F.when(follows & ((F.size(tokens) <= 6) | low.rlike(FOLLOW_UP)), 2).otherwise(0)
    return score


def intent(text: Column) -> Column:
    return _first(text, INTENTS, F.lit("explanation"))


def strategy(text: Column) -> Column:
    """(strategy, least, most, confidence): the first strategy whose pattern matches, else that of the intent."""
    fallback = F.lit("behavior_explanation")
    for name, own in OF_INTENT.items():
        fallback = F.when(intent(text) == name, own).otherwise(fallback)
    named, matched = _first(text, STRATEGIES, fallback), _first(text, STRATEGIES, F.lit(None).cast("string")).isNotNull()
    table = F.create_map(*[x for k, (a, b) in CHUNKS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("least"), F.lit(b).alias("most")))])
    budget = F.element_at(table, named)
    return F.struct(named.alias("strategy"), budget["least"].alias("least"), budget["most"].alias("most"), F.when(matched, 0.7).otherwise(0.6).alias("confidence"))


def route(text: Column, least: float = 0.6, close: float = 0.1) -> Column:
    """(primary, score, secondary): the route with most weight, at most 1 each; a second one if nearly as good; EXPLANATION with .5 if none has `least`."""
    low = F.lower(text)
    scored = []
    for k, (name, phrases) in enumerate(ROUTES.items()):
        total = F.lit(0.0)
        for phrase, weight in phrases.items():
            total = total + F.when(low.rlike(rf"\b{phrase}\b"), weight).otherwise(0.0)
        scored.append(F.struct((-F.least(F.round(total, 6), F.lit(1.0))).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name")))
    ranked = F.array_sort(F.array(*scored))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = -first["s"] >= least
    also = sure & (-second["s"] >= least) & (F.round(second["s"] - first["s"], 6) <= close)
    return F.struct(F.when(sure, first["name"]).otherwise("EXPLANATION").alias("primary"), F.when(sure, -first["s"]).otherwise(0.5).alias("score"), F.when(also, second["name"]).alias("secondary"))


def primary_entity(text: Column) -> Column:
    """(entity, confidence): what is quoted, a CamelCase or snake_case name, the noun of a "where is" question, or the first two telling words."""
    quoted = F.trim(F.regexp_extract(text, r"""["']([^"']{2,60})["']""", 1))
    symbol = F.regexp_extract(text, r"\b([A-Z][a-zA-Z0-9]{2,})\b", 1)
    snake = F.regexp_extract(text, r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", 1)
    noun = F.regexp_extract(text, r"(?i)\bwhere\s+(?:is|are|can\s+I\s+find)\s+(?:the\s+)?(.+?)(?:\s+(?:feature|functionality|module|system|component|logic|code|executed|implemented|defined|located|handled|used|called|in\s+the\s+project))", 1)
    terms = F.array_join(F.filter(F.split(F.lower(F.trim(noun)), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*QUALIFIERS)), "_")
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    phrase = F.array_join(F.slice(words, 1, 2), "_")
    pair = lambda e, c: F.struct(e.alias("entity"), F.lit(c).alias("confidence"))
    return F.when(quoted != "", pair(quoted, 1.0)).when(symbol != "", pair(symbol, 1.0)).when(snake != "", pair(snake, 0.8)).when(terms != "", pair(terms, 0.85)).when(phrase != "", pair(phrase, 0.6)).otherwise(pair(F.lit(""), 0.0))


#: Patterns of what a change is meant for, with its kind and topic.
PURPOSES: list[tuple[str, str, str]] = [
    ("SECURITY", "Authentication", r"\b(oauth2?|jwt|auth(enticat(e|ion))?|login|token)\b"),
    ("SECURITY", "Authorization", r"\b(authoriz(e|ation)|rbac|permissions?|acls?)\b"),
    ("SECURITY", "PCI Compliance", r"\b(pci|compliance|gdpr|hipaa)\b"),
    ("SECURITY", "Encryption", r"\b(encrypt(ion)?|cryptography|aes|rsa|cipher)\b"),
    ("SECURITY", "Vulnerability Management", r"\b(vulnerabilit(y|ies)|cve|xss|csrf|sqli|injection)\b"),
    ("PERFORMANCE", "Caching", r"\b(cach(e|ing)|redis|memcached)\b"),
    ("PERFORMANCE", "Latency Reduction", r"\b(latenc(y|ies)|response time)\b"),
    ("PERFORMANCE", "Throughput Optimization", r"\b(throughput|qps|rps)\b"),
    ("PERFORMANCE", "Performance Optimization", r"\b(optimiz(e|ation)|bottleneck|profiling)\b"),
    ("RELIABILITY", "Retry Logic", r"\b(retry|retries|backoff)\b"),
    ("RELIABILITY", "Fault Tolerance", r"\b(fault(\s|-)toleran(ce|t)|resilien(ce|t)|failover)\b"),
    ("RELIABILITY", "Circuit Breaker", r"\b(circuit(\s|-)breaker)\b"),
    ("SCALABILITY", "Scaling Strategy", r"\b(scal(e|ing)|horizontally?|vertically?)\b"),
    ("SCALABILITY", "Data Partitioning", r"\b(partition(ing)?|shard(ing)?)\b"),
    ("ARCHITECTURE", "System Architecture", r"\b(microservices?|monolith(ic)?|service(\s|-)oriented)\b"),
    ("ARCHITECTURE", "Event-Driven Architecture", r"\b(event(\s|-)driven|pub(/|-)sub|message(\s|-)bus)\b"),
    ("MIGRATION", "Migration", r"\b(migrat(e|ion))\b"),
    ("MIGRATION", "Deprecation", r"\b(deprecat(e|ion|ed)|sunsetting)\b"),
    ("TECHNICAL_DEBT", "Refactoring", r"\b(refactor(ing)?|cleanup|technical(\s|-)debt)\b"),
    ("OBSERVABILITY", "Observability", r"\b(log(ging)?|trace|tracing|metric(s)?|monitor(ing)?|datadog|prometheus|grafana|telemetry)\b"),
]
#: How much a source is trusted.
SOURCE_CONFIDENCE = {"ADR": 1.0, "PR": 0.8, "COMMIT": 0.6}


def purposes(text: Column) -> Column:
    """Array of (type, topic, snippet): what a text says a change is for, each topic once, with the words that say it."""
    hit = lambda p: F.regexp_extract(text, "(?i)" + p, 0)
    return F.array_compact(F.array(*[F.when(hit(p) != "", F.struct(F.lit(kind).alias("type"), F.lit(topic).alias("topic"), hit(p).alias("snippet"))) for kind, topic, p in PURPOSES]))
