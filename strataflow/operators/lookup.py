"""Structured lookups over facts and units: dynamic filters, ordered limits, fuzzy names, coverage measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.text import pascal, snake
from strataflow.operators.skew import salted_join


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 1).when(c == "medium", 2).when(c == "low", 3).otherwise(4)


def query_facts(facts: DataFrame, fact_type: str | None = None, symbol: str | None = None, file: str | None = None, value: str | None = None, confidence: str | None = None, role: str | None = None, exclude_roles: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Facts that meet all given conditions, the surest first, then by file and line."""
    for column, wanted in (("fact_type", fact_type), ("value", value), ("confidence", confidence), ("role", role)):
        if wanted is not None:
            facts = facts.where(F.col(column) == wanted)
    if file is not None:
        facts = facts.where(F.lower("file_path") == file.lower())
    if symbol is not None:
        facts = facts.where(symbol_matches(F.col("symbol"), symbol))
    if exclude_roles:
        facts = facts.where(~F.col("role").isin(*exclude_roles))
    facts = facts.orderBy(confidence_rank(F.col("confidence")), "file_path", "start_line", "fact_id")
    return facts if limit is None else facts.limit(limit)


def symbol_matches(column: Column, symbol: str) -> Column:
    """The symbol itself or any that ends in a dot and it, whatever the case of the ending."""
    return (column == symbol) | F.lower(column).endswith("." + symbol.lower())


def find_by_symbols(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Facts whose symbol, or its last dotted part, is among the symbols (symbol): one join for all of them."""
    keys = F.array_distinct(F.array(F.col("symbol"), F.element_at(F.split("symbol", "\\."), -1)))
    wanted = symbols.select(F.col("symbol").alias("_key")).distinct()
    return facts.withColumn("_key", F.explode(keys)).join(wanted, "_key", "left_semi").drop("_key").distinct()


def fuzzy(symbols: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Symbols (name, id) that are the name, its snake or Pascal case, or equal it without case; if none is, those that contain it and are no more than 2.5 times as long."""
    asked = symbols.select("id", "name", F.lit(name).alias("_q"))
    variants = asked.where((F.col("name") == F.col("_q")) | (F.col("name") == snake(F.col("_q"))) | (F.col("name") == pascal(F.col("_q"))) | (F.lower("name") == F.lower("_q")))
    parts = asked.where((F.length("_q") > 5) & F.lower("name").contains(F.lower("_q")) & (F.length("_q") / F.length("name") >= 0.4))
    both = variants.withColumn("tier", F.lit(0)).unionByName(parts.withColumn("tier", F.lit(1)))
    first = F.min("tier").over(Window.partitionBy("_q"))
    return both.withColumn("_t", first).where("tier = _t").orderBy("name", "id").limit(most).select("id", "name", "tier")


def concept_lookup(symbols: DataFrame, words: Sequence[str]) -> DataFrame:
    """Symbols by the share of the words that their names contain, 0.9 at most."""
    hits = F.size(F.array_compact(F.array(*[F.when(F.lower("name").contains(w.lower()), F.lit(1)) for w in words])))
    return symbols.withColumn("hits", hits).where("hits > 0").withColumn("confidence", F.least(F.lit(0.9), F.col("hits") / len(words)))


def concept_search(concepts: DataFrame, word: str) -> DataFrame:
    """Concepts (concept, synonyms, related, location): exact 1, synonym .9, part .7 (four characters and more), related .5; best of each location."""
    w = word.lower()
    score = F.when(F.lower("concept") == w, 1.0).when(F.array_contains("synonyms", w), 0.9).when((F.lit(len(w)) >= 4) & F.lower("concept").contains(w), 0.7).when(F.array_contains("related", w), 0.5)
    return concepts.withColumn("score", score).where("score IS NOT NULL").groupBy("location").agg(F.max("score").alias("score"), F.min_by("concept", F.struct(-F.col("score"), "concept")).alias("concept"))


def term_score(rows: DataFrame, columns: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Rows with the summed occurrences of the terms over the columns; rows without any are dropped before scoring."""
    text = F.lower(F.concat_ws("\n", *columns))
    any_term = text.contains(terms[0].lower())
    for t in terms[1:]:
        any_term = any_term | text.contains(t.lower())
    score = sum((((F.length(text) - F.length(F.replace(text, F.lit(t.lower()), F.lit("")))) / len(t)).cast("int") for t in terms[1:]), ((F.length(text) - F.length(F.replace(text, F.lit(terms[0].lower()), F.lit("")))) / len(terms[0])).cast("int"))
    return rows.where(any_term).withColumn("score", score)


def coverage_status(percent: Column) -> Column:
    return F.when(percent >= 90, "EXCELLENT").when(percent >= 75, "GOOD").when(percent >= 50, "WEAK").otherwise("CRITICAL")


def coverage_risk(coverage: Column, hotspot: Column, blast: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.5 * (100 - coverage) + 0.25 * hotspot + 0.25 * blast))


def expert_extremes(links: DataFrame, expertise: DataFrame) -> DataFrame:
    """Strongest and weakest expert of each decision's files, their number, and the strongest's share."""
    files = expertise.where("entity_type = 'FILE'").select(F.col("entity_id").alias("node_id"), "author_email", "expertise_score")
    own = links.join(files, "node_id").groupBy("adr_id", "author_email").agg(F.sum("expertise_score").alias("total"))
    return own.groupBy("adr_id").agg(F.max("total").alias("best"), F.min("total").alias("worst"), F.count("*").alias("experts"), (F.max("total") / F.sum("total")).alias("concentration"))


def outcomes_by_version(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions (id, version, p) that have an outcome (id, resolved): how many, how many resolved, their mean probability."""
    return predictions.join(outcomes, "id").groupBy("version").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"), F.avg("p").alias("mean_p"))


def runtime_state(mappings: DataFrame, health: DataFrame, patterns: DataFrame) -> DataFrame:
    """Entities by the components they run in: the worst newest health, components, and patterns seen there."""
    newest = health.groupBy("component_id").agg(F.max_by("health_score", "computed_at").alias("health"))
    return mappings.join(newest, "component_id").join(patterns, "component_id", "left").groupBy("entity_id").agg(F.min("health").alias("health"), F.count_distinct("component_id").alias("components"), F.count("pattern").alias("patterns"))


def token_links(decisions: DataFrame, nodes: DataFrame, each: int = 5, least: int = 5) -> DataFrame:
    """(adr, node, score, confidence): decisions (adr, token) and nodes (node, token) by the tokens they share, `each` a token; full confidence from 20 on.

    A token that stands in every text is dealt over many tasks; no pair is lost by it. Repeated rows count once, null tokens meet nothing.
    """
    met = salted_join(nodes.select("node", "token").distinct(), decisions.select("adr", "token").distinct(), "token")
    found = met.groupBy("adr", "node").agg((F.count("*") * each).alias("score")).where(F.col("score") >= least)
    return found.withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 20))
