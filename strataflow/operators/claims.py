"""Deterministic checks of answers (answer_id, text) against what they were given: numbers, code, paths, orders, relations, technologies.

An answer is cut into pieces (words, numbers, single signs) with their places, so "near" is a join on the distance of places. Code
and evidence are compared as text with white space collapsed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Technologies a claim of use is checked for.
TECHNOLOGIES = ("Celery", "GraphQL", "Redis", "Kafka", "RabbitMQ", "Memcached", "Elasticsearch", "MongoDB", "Cassandra", "DynamoDB", "Kubernetes", "Docker Swarm", "Terraform", "WebSocket", "gRPC", "Django", "Flask", "Tornado", "Sanic", "Express", "NestJS", "Angular", "Vue", "Svelte", "Redux", "MobX", "GraphQL Federation", "Airflow", "Luigi", "Dagster", "Spark", "Hadoop", "Flink", "RabbitMQ Streams", "NATS", "ZeroMQ", "Sidekiq", "Resque", "Prometheus", "Grafana", "Datadog", "Sentry", "OpenTelemetry", "Stripe", "Twilio", "SendGrid", "Auth0", "Okta", "Keycloak")
#: Words of use, of denial, of doing without an answer, of sameness, and of relations between code.
USE = r"(?i)(uses?|using|used|leverages?|relies\s+on|is\s+built\s+(on|with)|is\s+handled\s+by|is\s+managed\s+by|runs?\s+on|integrates?\s+with|powered\s+by|via|through|with)"
DENIAL = r"(?i)\b(not|no|never|n't|without|absent|does\s+not|doesn't|isn't|aren't|lacks?|there\s+is\s+no|nowhere|instead\s+of|rather\s+than|unlike)\b"
HEDGE = r"(?i)\b(cannot|can't|could not|unable to) (determine|tell|find|confirm|verify)\b|\bdoes not (specify|determine|state|contain|show)\b|\bnot (explicitly )?(stated|specified|shown|available)\b|\bno evidence\b"
SAME = r"(?i)\b(identical|same code|no functional difference|no difference|equivalent|duplicate of|exactly the same)\b"
RELATION = r"(?:calls?|uses?|depends?\s+on|invokes?|instantiates?|references?|imports?|consumes?)"
CODE_PATH = r"(?:[\w.-]+/)+[\w.-]+\.(?:py|ts|tsx|js|jsx|java|go|rs|cs|rb)"
MENTIONED_PATH = r"\b[\w-]+\.(?:ts|js|py|json|md|tsx|jsx)\b"
#: Files that are run or loaded without being imported, and code that is mounted elsewhere.
ENTRY_FILES = ("main.py", "app.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "index.ts", "index.js", "server.ts", "server.js", "__init__.py", "index.tsx", "index.jsx", "mod.rs")
WIRED = r"\bAPIRouter\s*\(|\bclass\s+\w*Middleware\b|\bBlueprint\s*\(|\brouter\s*=\s*Router\s*\(|if\s+__name__\s*==\s*['\"]__main__['\"]"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """A text cut after sentence ends that white space follows."""
    return F.split(text, r"(?<=[.!?])\s+", -1)


def pieces(answers: DataFrame) -> DataFrame:
    """(answer_id, place, at, piece): words with their dots, numbers and single other signs, with the place of their first character."""
    rows = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)\d+(?:\.\d+)?|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|."), F.lit(0))).alias("place", "piece"))
    w = Window.partitionBy("answer_id").orderBy("place")
    return rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("before", F.lag("piece").over(w)).withColumn("after", F.lead("piece").over(w)).withColumn("then", F.lead("piece", 2).over(w))


def numeric_claims(answers: DataFrame, evidence: DataFrame, facts: DataFrame, near: int = 150) -> DataFrame:
    """(answer_id, number, verdict) of each different number of an answer: contradicted, supported or unsupported.

    facts (symbol, value, line): a number is contradicted if the facts named within `near` characters have one value, another one,
    unless it is the fact's line or a whole number beside a fraction. It is supported if the evidence (answer_id, content) has it
    or it is a fact's value. Markers of lists are no claims, nor are numbers in a sentence that hedges.
    """
    all_ = pieces(answers)
    marker = (F.col("before").isNull() | (F.col("before") == "\n")) & F.col("after").isin(".", ")") & (F.col("then") == " ")
    hedged = answers.select("answer_id", F.explode(sentences(F.col("text"))).alias("s")).where(F.col("s").rlike(HEDGE)).select("answer_id", F.explode(F.regexp_extract_all("s", F.lit(r"\b\d+(?:\.\d+)?"), F.lit(0))).alias("piece")).distinct()
    numbers = all_.where(F.col("piece").rlike(r"^\d") & ~F.coalesce(marker, F.lit(False))).join(hedged, ["answer_id", "piece"], "left_anti").select("answer_id", F.col("piece").alias("number"), "at", F.col("piece").cast("double").alias("v"))
    names = facts.select(F.lower(F.element_at(F.split("symbol", r"\."), -1)).alias("last"), "symbol", "value", "line")
    said = all_.where(F.col("piece").rlike("^[A-Za-z_]")).select("answer_id", F.col("at").alias("said_at"), F.lower(F.element_at(F.split("piece", r"\."), -1)).alias("last"))
    met = numbers.join(said.join(names, "last"), "answer_id").where(F.abs(F.col("at") - F.col("said_at")) <= near)
    judged = met.groupBy("answer_id", "number", "at", "v").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"), F.max((F.col("line") == F.col("v")).cast("int")).alias("own_line"))
    fraction = (F.abs("value") > 0) & (F.abs("value") < 1) & (F.col("v") >= 1) & (F.col("v") == F.floor("v"))
    wrong = judged.where((F.col("values") == 1) & (F.col("value") != F.col("v")) & (F.col("own_line") == 0) & ~fraction).select("answer_id", "number").distinct().withColumn("wrong", F.lit(True))
    given = evidence.groupBy("answer_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("content"))).alias("content"))
    own = numbers.select("answer_id", "number", "v").distinct().join(given, "answer_id", "left").join(facts.select(F.col("value").alias("v")).distinct().withColumn("is_fact", F.lit(True)), "v", "left").join(wrong, ["answer_id", "number"], "left")
    verdict = F.when(F.col("wrong"), "contradicted").when(F.col("is_fact") | F.coalesce(F.contains("content", "number"), F.lit(False)), "supported").otherwise("unsupported")
    return own.select("answer_id", "number", verdict.alias("verdict"))


def gap_check(answers: DataFrame, gaps: DataFrame) -> DataFrame:
    """(answer_id, gaps, outcome, text): an answer whose evidence has gaps (answer_id, gap) says so, or gets a sentence before it that does."""
    listed = gaps.groupBy("answer_id").agg(F.sort_array(F.collect_set("gap")).alias("gaps"))
    rows = answers.join(listed, "answer_id")
    says = F.col("text").rlike(HEDGE)
    return rows.select("answer_id", "gaps", F.when(says, "pass").otherwise("revise").alias("outcome"), F.when(says, F.col("text")).otherwise(F.concat(F.lit("The evidence does not determine the full answer due to missing facts. "), F.col("text"))).alias("text"))


def _in_order(lines: Column, content: Column) -> Column:
    """Whether all lines stand in the content, each after the one before."""
    step = lambda at, line: F.when(at == 0, F.lit(0)).otherwise(F.when(F.call_function("locate", line, content, at) > 0, F.call_function("locate", line, content, at) + F.length(line)).otherwise(0))
    return F.aggregate(lines, F.lit(1), step) > 0


def fenced_code(answers: DataFrame, evidence: DataFrame, least: int = 20) -> DataFrame:
    """(answer_id, block, code, supported) of code in fences of `least` characters and more: in one piece of evidence as it is, or line by line in order."""
    blocks = answers.select("answer_id", F.posexplode(F.expr(r"regexp_extract_all(text, '(?s)```[a-zA-Z0-9_+-]*\\n(.*?)```', 1)")).alias("block", "code"))
    lines = F.filter(F.transform(F.split("code", "\n", -1), squeezed), lambda x: x != "")
    blocks = blocks.withColumn("flat", squeezed(F.col("code"))).withColumn("lines", lines).where(F.length("flat") >= least)
    given = evidence.select("answer_id", squeezed(F.col("content")).alias("content"))
    found = blocks.join(given, "answer_id", "left").withColumn("ok", F.coalesce(F.contains("content", "flat") | _in_order(F.col("lines"), F.col("content")), F.lit(False)))
    return found.groupBy("answer_id", "block", F.col("flat").alias("code")).agg(F.bool_or("ok").alias("supported"))


def mentioned_paths(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, path, supported): file names of an answer that a file of its evidence ends with, or that its content has."""
    said = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MENTIONED_PATH), F.lit(0)))).alias("path"))
    given = evidence.select("answer_id", "file", "content")
    found = said.join(given, "answer_id", "left").withColumn("ok", F.coalesce(F.endswith("file", "path") | F.contains("content", "path"), F.lit(False)))
    return found.groupBy("answer_id", "path").agg(F.bool_or("ok").alias("supported"))


def fallback_order(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer_id, unit, out_of_order): names of a chain (unit, place, symbol) that an answer has, but only before the names ahead of them in the chain."""
    chains = facts.groupBy("unit", "symbol").agg(F.min("place").alias("place")).groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]).alias("chain"))
    rows = answers.join(chains, F.exists("chain", lambda s: F.contains(F.col("text"), s)))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("bad"))

    def step(state, name):
        ahead = F.call_function("locate", name, F.col("text"), state["at"])
        behind = (ahead == 0) & (F.call_function("locate", name, F.col("text"), F.lit(1)) > 0)
        return F.struct(F.when(ahead > 0, ahead).otherwise(state["at"]).alias("at"), F.when(behind, F.concat(state["bad"], F.array(name))).otherwise(state["bad"]).alias("bad"))

    return rows.select("answer_id", "unit", F.aggregate("chain", start, step, lambda s: s["bad"]).alias("out_of_order"))


def equivalence_claims(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(answer_id, files, true): sentences that call two or more files (path, content) the same, and whether they are, but for trailing space."""
    said = answers.select("answer_id", F.posexplode(sentences(F.col("text"))).alias("n", "s")).where(F.col("s").rlike(SAME))
    paths = said.select("answer_id", "n", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(CODE_PATH), F.lit(0)))).alias("path"))
    content = files.select("path", F.sha2(F.rtrim(F.regexp_replace("content", "\r\n", "\n")), 256).alias("h"))
    return paths.join(content, "path").groupBy("answer_id", "n").agg(F.sort_array(F.collect_set("path")).alias("files"), F.count_distinct("h").alias("versions")).where(F.size("files") >= 2).select("answer_id", "files", (F.col("versions") == 1).alias("true"))


def technology_claims(answers: DataFrame, present: DataFrame, near: int = 120, technologies: Sequence[str] = TECHNOLOGIES) -> DataFrame:
    """(answer_id, technology): technologies an answer says are used, by a word of use within `near` characters and no denial in the sentence, that are not present (technology)."""
    names = F.array(*[F.lit(t) for t in technologies])
    said = answers.select("answer_id", "text", F.explode(F.filter(names, lambda t: F.contains(F.lower("text"), F.lower(t)))).alias("technology"))
    mention = lambda before, after: F.concat(F.lit(f"(?is){before}\\b\\Q"), F.col("technology"), F.lit(f"\\E\\b{after}"))
    around = F.regexp_extract_all("text", mention(f".{{0,{near}}}", f".{{0,{near}}}"), F.lit(0))
    affirmed = F.exists(sentences(F.col("text")), lambda s: F.regexp_like(s, mention("", "")) & ~s.rlike(DENIAL))
    claimed = said.where(affirmed & F.exists(around, lambda x: x.rlike(USE)))
    known = present.select(F.lower("technology").alias("k")).distinct()
    return claimed.join(known, F.lower("technology") == F.col("k"), "left_anti").select("answer_id", "technology").distinct()


def relation_claims(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(answer_id, path, symbol, verdict) of clauses that say a file calls, uses, imports ... a `symbol`: holds, absent, or defines (the file has it as its own definition only).

    Clauses that deny are no claims; files that are not known are not judged.
    """
    pattern = rf"`?({CODE_PATH})`?([^.\n]{{0,80}}?\b{RELATION}\b[^.\n]{{0,60}}?)`([A-Za-z_]\w*)`"
    clause = answers.select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("clause"))
    claims = clause.where(~F.col("clause").rlike(r"(?i)\b(not|never|no|nowhere|without)\b|n't\b")).select("answer_id", F.regexp_extract("clause", pattern, 1).alias("path"), F.regexp_extract("clause", pattern, 3).alias("symbol")).distinct()
    met = claims.join(files.select("path", "content"), "path")
    word = F.concat(F.lit(r"\b\Q"), F.col("symbol"), F.lit(r"\E\b"))
    own = F.concat(F.lit(r"(?:def|class|function|func|fn|const|let|var)\s+\Q"), F.col("symbol"), F.lit(r"\E\b"))
    rest = F.regexp_replace("content", own, F.lit(" "))
    return met.select("answer_id", "path", "symbol", F.when(~F.regexp_like("content", word), "absent").when(~F.regexp_like(rest, word), "defines").otherwise("holds").alias("verdict"))


def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (path, content) that nothing imports, that are no entry points and define nothing that is mounted elsewhere."""
    name = F.element_at(F.split("path", "/"), -1)
    imported = edges.where("type = 'imports'").where("src <> dst").select(F.col("dst").alias("path")).distinct()
    return files.where(~name.isin(*ENTRY_FILES) & ~F.col("content").rlike(WIRED)).join(imported, "path", "left_anti").select("path")


def quoted_strings(answers: DataFrame, evidence: DataFrame, least: int = 4) -> DataFrame:
    """(answer_id, quote, found): quotes of an answer, of `least` characters and more, and whether its own evidence (answer_id, content) has them."""
    quotes = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf'"([^"\n]{{{least},}})"'), F.lit(1)))).alias("quote"))
    met = quotes.join(evidence.select("answer_id", "content"), "answer_id", "left")
    return met.groupBy("answer_id", "quote").agg(F.coalesce(F.bool_or(F.contains("content", "quote")), F.lit(False)).alias("found"))


def cited_symbols(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(answer_id, path, symbol, found): symbols in backticks that share a sentence with a file (path, content) that is cited, and whether the file has them."""
    said = answers.select("answer_id", F.explode(sentences(F.col("text"))).alias("s"))
    paths = F.array_distinct(F.regexp_extract_all("s", F.lit(CODE_PATH), F.lit(0)))
    names = F.array_distinct(F.regexp_extract_all("s", F.lit(r"`([A-Za-z_]\w*)`"), F.lit(1)))
    pairs = said.select("answer_id", F.explode(paths).alias("path"), names.alias("names")).select("answer_id", "path", F.explode("names").alias("symbol")).distinct()
    return pairs.join(files.select("path", "content"), "path").select("answer_id", "path", "symbol", F.regexp_like("content", F.concat(F.lit(r"\b\Q"), F.col("symbol"), F.lit(r"\E\b"))).alias("found"))
