"""Diagnostics across the knowledge tables: each check is an anti-join or a filter that leaves what contradicts itself."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables whose snapshot_date has to be a date, by the name they are reported under.
DATED = ("validity_history", "hotspot_history", "architectural_health_history", "drift_history", "evolution_snapshots", "outcome_history", "coverage_snapshots")


def without(rows: DataFrame, other: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows that have no partner: left column by right column."""
    right = other.select(*[F.col(b).alias(f"_{b}") for b in on.values()]).distinct()
    return rows.join(right, [F.col(a) == F.col(f"_{b}") for a, b in on.items()], "left_anti")


def bad_dates(tables: Mapping[str, DataFrame], date: str = "snapshot_date") -> DataFrame:
    """(source, bad, n) of each table: how many dates are missing or no ISO dates, and how many rows there are."""
    text = F.col(date).cast("string")
    wrong = F.count_if(text.isNull() | ~text.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return reduce(DataFrame.unionByName, [t.agg(wrong.alias("bad"), F.count("*").alias("n")).select(F.lit(k).alias("source"), "bad", "n") for k, t in tables.items()])


def expert_mismatch(hotspots: DataFrame, links: DataFrame, expertise: DataFrame) -> DataFrame:
    """Hotspots whose number of experts is not that of the files they govern."""
    files = expertise.where("entity_type = 'FILE'").select(F.col("entity_id").alias("node_id"), "author_email")
    real = links.join(files, "node_id").groupBy(F.col("adr_id").alias("entity_id")).agg(F.count_distinct("author_email").alias("real"))
    return hotspots.where("entity_type = 'ADR'").join(real, "entity_id", "left").where(F.col("expert_count") != F.coalesce("real", F.lit(0)))


def diagnostics(t: Mapping[str, DataFrame]) -> DataFrame:
    """(check_no, check_name, entity): every row of the fourteen checks that contradicts another table.

    t: tables by name, as the roles of the engine name them.
    """
    adr_only = "entity_type = 'ADR'"
    degraded = t["causal_factors"].where("factor_type = 'COVERAGE_DEGRADATION'").join(t["causal_explanations"], F.col("explanation_id") == F.col("id"))
    weak = t["coverage_entities"].where(adr_only).where("coverage_percent < 50")
    isolated = without(without(weak, t["outcome_evidence"].where("evidence_type = 'COVERAGE'"), {"entity_type": "entity_type", "entity_id": "entity_id"}), degraded, {"entity_type": "target_entity_type", "entity_id": "target_entity_id"})
    chains = t["causal_chains"]
    broken = without(chains, t["causal_factors"], {"prev_factor_id": "factor_id"}).unionByName(without(chains, t["causal_factors"], {"next_factor_id": "factor_id"})).distinct()
    dates = bad_dates({k: t[k] for k in DATED}).where("bad > 0")
    checks = [
        ("expert_count", expert_mismatch(t["knowledge_hotspots"], t["links"], t["author_expertise"]), "entity_id"),
        ("health_without_drift", without(t["architectural_health"].where("health_score < 100"), t["drift_findings"].where("resolution_state = 'ACTIVE'"), {"entity_id": "entity_id"}), "entity_id"),
        ("validity_without_evidence", without(t["knowledge_validity"].where("validity_score < 100"), t["validity_evidence"], {"id": "validity_id"}), "id"),
        ("evolution_missing", without(t["knowledge_validity"], t["evolution_entities"], {"entity_id": "entity_id"}), "entity_id"),
        ("review_without_scope", without(t["review_recommendations"], t["review_scope"], {"id": "recommendation_id"}), "id"),
        ("bus_factor", t["knowledge_hotspots"].where("bus_factor > expert_count OR bus_factor < 0"), "entity_id"),
        ("review_of_missing_decision", without(t["review_outcomes"].where(adr_only), t["decisions"], {"entity_id": "id"}), "review_id"),
        ("bad_dates", dates, "source"),
        ("orphaned_history", without(t["validity_history"].select("entity_id").distinct(), t["knowledge_validity"], {"entity_id": "entity_id"}), "entity_id"),
        ("isolated_coverage", isolated, "entity_id"),
        ("outcome_without_history", without(t["decision_outcomes"], t["outcome_history"], {"entity_id": "entity_id"}), "entity_id"),
        ("empty_explanation", without(t["causal_explanations"], t["causal_factors"], {"id": "explanation_id"}), "id"),
        ("broken_chain", broken, "explanation_id"),
        ("factor_without_evidence", without(t["causal_factors"], t["causal_evidence"], {"factor_id": "factor_id"}), "factor_id"),
    ]
    return reduce(DataFrame.unionByName, [rows.select(F.lit(k).alias("check_no"), F.lit(name).alias("check_name"), F.col(c).cast("string").alias("entity")) for k, (name, rows, c) in enumerate(checks, 1)])
