"""Change-history analytics: coupling, expertise, drift, hotspots, reviewers, change risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.questions import SOURCE_CONFIDENCE, purposes

#: Paths that are no source: lock files and vendored or built trees.
NOISE = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock)$|(^|/)(node_modules|vendor|dist|build)/"
BOT = r"(?i)\[bot\]|dependabot|renovate"


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86400e6


def source_changes(commit_files: DataFrame) -> DataFrame:
    """Distinct (sha, path) that are neither deletions nor noise."""
    return commit_files.where((F.col("change_type") != "DELETE") & ~F.col("path").rlike(NOISE)).select("sha", "path").distinct()


def small_groups(changes: DataFrame, most: int, key: str = "sha") -> DataFrame:
    """Rows of groups with at most `most` rows."""
    return changes.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") <= most).drop("_n")


def file_change_stats(changes: DataFrame, commits: DataFrame) -> DataFrame:
    return changes.join(commits.select("sha", "ts"), "sha").groupBy("path").agg(F.count("*").alias("change_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))


def co_changes(changes: DataFrame, commits: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of files changed together in `least` commits or more. Commits are bounded before the self-join, so it grows linearly."""
    dated = changes.join(commits.select("sha", "ts"), "sha")
    a, b = dated.alias("a"), changes.alias("b")
    pairs = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path")))
    return pairs.groupBy(F.col("a.path").alias("source_path"), F.col("b.path").alias("target_path")).agg(F.count("*").alias("co_change_count"), F.min("a.ts").alias("first_seen_at"), F.max("a.ts").alias("last_seen_at")).where(F.col("co_change_count") >= least)


def logical_coupling(commit_files: DataFrame, commits: DataFrame, most_files: int = 50, least: int = 2) -> DataFrame:
    """Coupled files with the Jaccard coefficient of their commits as confidence."""
    changes = small_groups(source_changes(commit_files), most_files)
    counts = changes.groupBy("path").agg(F.count("*").alias("n"))
    edges = co_changes(changes, commits, least)
    joined = edges.join(counts.select(F.col("path").alias("source_path"), F.col("n").alias("n_source")), "source_path").join(counts.select(F.col("path").alias("target_path"), F.col("n").alias("n_target")), "target_path")
    union = F.col("n_source") + F.col("n_target") - F.col("co_change_count")
    return joined.withColumn("confidence", F.when(union > 0, F.col("co_change_count") / union).otherwise(0.0))


def coupling_evidence(commit_files: DataFrame, commits: DataFrame, most_files: int = 50, least: int = 2, most: int = 20) -> DataFrame:
    """The latest `most` commits of each coupled pair."""
    changes = small_groups(source_changes(commit_files), most_files)
    edges = co_changes(changes, commits, least).select("source_path", "target_path")
    a, b = changes.select("sha", F.col("path").alias("source_path")), changes.select("sha", F.col("path").alias("target_path"))
    met = edges.join(a, "source_path").join(b, ["target_path", "sha"]).join(commits.select("sha", "ts"), "sha")
    rank = F.row_number().over(Window.partitionBy("source_path", "target_path").orderBy(F.col("ts").desc(), F.col("sha")))
    return met.withColumn("rn", rank).where(F.col("rn") <= most).select("source_path", "target_path", "sha", "rn")


def recency(days: Column) -> Column:
    return F.when(days <= 30, 1.0).when(days <= 90, 0.8).when(days <= 365, 0.5).otherwise(0.25)


def authored(commit_files: DataFrame, commits: DataFrame, as_of: str, most_files: int = 50) -> DataFrame:
    """(author, path, sha, ts, days_ago, weight): people's changes in commits that are no merges and touch at most `most_files` files.

    Group sizes count all of a commit's rows, before exclusions.
    """
    sized = small_groups(commit_files, most_files)
    people = commits.where((F.col("n_parents") <= 1) & ~F.col("author_email").rlike(BOT))
    days = days_between(F.lit(as_of).cast("timestamp"), F.col("ts"))
    return source_changes(sized).join(people, "sha").select(F.lower("author_email").alias("author_email"), "path", "sha", "ts", days.alias("days_ago"), recency(days).alias("weight"))


def file_expertise(changes: DataFrame) -> DataFrame:
    return changes.groupBy("author_email", F.col("path").alias("entity_id")).agg(F.sum("weight").alias("expertise_score"), F.count("*").alias("contribution_count"), F.min("days_ago").alias("knowledge_age_days"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")).withColumn("coverage", F.lit(1.0))


def directory_expertise(files: DataFrame, cap: float = 10.0) -> DataFrame:
    """Sums of file scores by directory; one file counts `cap` at most."""
    folder = F.when(F.col("entity_id").contains("/"), F.regexp_extract("entity_id", r"^(.*)/[^/]*$", 1)).otherwise(".")
    return files.groupBy("author_email", folder.alias("directory")).agg(F.sum(F.least("expertise_score", F.lit(cap))).alias("expertise_score"), F.sum("contribution_count").alias("contribution_count"), F.min("knowledge_age_days").alias("knowledge_age_days"))


def adr_expertise(files: DataFrame, links: DataFrame, cap: float = 10.0) -> DataFrame:
    """Sums of file scores by decision, and the share of its files an author knows."""
    totals = links.groupBy("adr_id").agg(F.count_distinct("node_id").alias("n_files"))
    joined = files.join(links.select("adr_id", F.col("node_id").alias("entity_id")).distinct(), "entity_id")
    return joined.groupBy("adr_id", "author_email").agg(F.sum(F.least("expertise_score", F.lit(cap))).alias("expertise_score"), F.count_distinct("entity_id").alias("own_files"), F.min("knowledge_age_days").alias("knowledge_age_days")).join(totals, "adr_id").withColumn("coverage", F.col("own_files") / F.col("n_files"))


def expertise_evidence(changes: DataFrame, most: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("author_email", "path").orderBy(F.col("ts").desc(), "sha"))
    return changes.withColumn("rn", rank).where(F.col("rn") <= most).select("author_email", "path", "sha", "rn")


def knowledge_risk(files: DataFrame, days: float = 90) -> DataFrame:
    """Active and stale experts of each file."""
    return files.groupBy("entity_id").agg(F.count("*").alias("experts"), F.count_if(F.col("knowledge_age_days") <= days).alias("active_experts"), F.count_if(F.col("knowledge_age_days") > days).alias("stale_experts"))


def reviewers(files: DataFrame, scope: DataFrame, most: int = 3) -> DataFrame:
    """Experts of the files in scope (path), their summed score over the best one's, weighed by recency."""
    own = files.join(scope.select(F.col("path").alias("entity_id")).distinct(), "entity_id", "left_semi").groupBy("author_email").agg(F.sum("expertise_score").alias("total"), F.min("knowledge_age_days").alias("age"))
    best = own.agg(F.max("total").alias("best"))
    weight = F.when(F.col("age") <= 90, 1.0).when(F.col("age") <= 365, 0.8).otherwise(0.5)
    return own.join(F.broadcast(best)).withColumn("reviewer_score", F.col("total") / F.col("best") * weight).orderBy(F.round("reviewer_score", 9).desc(), "author_email").limit(most).select("author_email", "total", "age", "reviewer_score")


def drift_findings(adrs: DataFrame, links: DataFrame, stats: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Five structural drift rules over decisions, their files and their coupling: drift_type, adr_id, entity_id, severity, confidence."""
    none, no_text = F.lit(None).cast("string"), F.lit(None).cast("string")
    governed = links.select(F.col("node_id").alias("path")).distinct()
    missing = adrs.join(links, adrs["id"] == links["adr_id"], "left_anti").select(F.lit("MISSING_IMPLEMENTATION").alias("drift_type"), F.col("id").alias("adr_id"), none.alias("entity_id"), F.lit("LOW").alias("severity"), F.lit(1.0).alias("confidence"))
    orphaned = stats.where("change_count > 50").join(governed, "path", "left_anti").select(F.lit("ORPHANED").alias("drift_type"), none.alias("adr_id"), F.col("path").alias("entity_id"), F.when(F.col("change_count") > 100, "CRITICAL").otherwise("HIGH").alias("severity"), F.lit(1.0).alias("confidence"))
    a, b = links.select(F.col("node_id").alias("source_path"), F.col("adr_id").alias("adr_a")).distinct(), links.select(F.col("node_id").alias("target_path"), F.col("adr_id").alias("adr_b")).distinct()
    crossed = edges.join(a, "source_path").join(b, "target_path").where("adr_a <> adr_b")
    violated = crossed.where("confidence > 0.5 AND co_change_count > 5").select(F.lit("GOVERNANCE_VIOLATION").alias("drift_type"), F.col("adr_a").alias("adr_id"), F.concat("source_path", F.lit("|"), "target_path").alias("entity_id"), F.lit("HIGH").alias("severity"), "confidence")
    excess = crossed.groupBy("adr_a").agg(F.count_distinct("adr_b").alias("others")).where("others >= 3").select(F.lit("EXCESSIVE_COUPLING").alias("drift_type"), F.col("adr_a").alias("adr_id"), no_text.alias("entity_id"), F.lit("MEDIUM").alias("severity"), F.lit(0.8).alias("confidence"))
    churn = links.join(stats, links["node_id"] == stats["path"]).groupBy("adr_id").agg(F.sum("change_count").alias("churn"))
    stale = adrs.where(days_between(F.lit(as_of), F.col("created_at")) > 365).join(churn.where("churn > 100"), adrs["id"] == churn["adr_id"]).select(F.lit("STALE_DECISION").alias("drift_type"), F.col("id").alias("adr_id"), no_text.alias("entity_id"), F.lit("MEDIUM").alias("severity"), F.lit(0.7).alias("confidence"))
    return missing.unionByName(orphaned).unionByName(violated).unionByName(excess).unionByName(stale)


def drift_health(findings: DataFrame) -> DataFrame:
    """Score sum(confidence) * count of each decision, and health 100 minus it, not under 0."""
    scored = findings.where("adr_id IS NOT NULL").groupBy("adr_id").agg((F.sum("confidence") * F.count("*")).alias("drift_score"), F.count("*").alias("active_findings"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_findings"))
    return scored.withColumn("health_score", F.greatest(F.lit(0.0), 100 - F.col("drift_score")))


def hotspots(links: DataFrame, experts: DataFrame, edges: DataFrame, health: DataFrame, blast: DataFrame) -> DataFrame:
    """Knowledge hotspots of decisions from health, blast radius, outside coupling and bus factor.

    experts: adr_expertise(); health (adr_id, health_score); blast (adr_id, blast_score).
    """
    of = links.select("adr_id", F.col("node_id").alias("path")).distinct()
    ends = edges.select(F.col("source_path").alias("path"), F.col("target_path").alias("other"), F.col("co_change_count")).unionByName(edges.select(F.col("target_path").alias("path"), F.col("source_path").alias("other"), F.col("co_change_count")))
    owner = of.select(F.col("path").alias("other"), F.col("adr_id").alias("other_adr"))
    outside = of.join(ends, "path").join(owner, "other", "left").where(F.col("other_adr").isNull() | (F.col("other_adr") != F.col("adr_id")))
    coupling = outside.groupBy("adr_id").agg(F.least(F.lit(100.0), F.count_distinct(F.concat("path", F.lit("|"), "other")) * 5.0).alias("coupling_score"))
    people = experts.groupBy("adr_id").agg(F.count("*").alias("expert_count"), F.count_if((F.col("coverage") >= 0.2) & (F.col("knowledge_age_days") < 365)).alias("bus_factor"), (F.max("expertise_score") / F.sum("expertise_score")).alias("concentration"))
    base = links.select("adr_id").distinct().join(people, "adr_id", "left").join(coupling, "adr_id", "left").join(health.select("adr_id", "health_score"), "adr_id", "left").join(blast.select("adr_id", "blast_score"), "adr_id", "left")
    factor = F.when(F.coalesce("bus_factor", F.lit(0)) == 0, 2.0).when(F.col("bus_factor") == 1, 1.5).otherwise(1.0)
    raw = 0.4 * F.greatest(F.lit(0.0), 100 - F.coalesce("health_score", F.lit(100.0))) + 0.3 * F.coalesce("blast_score", F.lit(0.0)) + 0.3 * F.coalesce("coupling_score", F.lit(0.0))
    score = F.least(F.lit(100.0), raw * factor)
    return base.select("adr_id", F.coalesce("expert_count", F.lit(0)).alias("expert_count"), F.coalesce("bus_factor", F.lit(0)).alias("bus_factor"), F.coalesce("concentration", F.lit(0.0)).alias("concentration"), F.coalesce("coupling_score", F.lit(0.0)).alias("coupling_score"), F.coalesce("blast_score", F.lit(0.0)).alias("blast_score"), score.alias("hotspot_score")).withColumn("severity", F.when(F.col("hotspot_score") >= 76, "CRITICAL").when(F.col("hotspot_score") >= 51, "HIGH").when(F.col("hotspot_score") >= 26, "MEDIUM").otherwise("LOW"))


def intent_graph(evidence: DataFrame, least: int = 2) -> DataFrame:
    """Intents (intent_id) found in the same source (source_type, source_id): support, weight min(1, n / 10), support by type of source."""
    a, b = evidence.distinct().alias("a"), evidence.distinct().alias("b")
    met = a.join(b, (F.col("a.source_type") == F.col("b.source_type")) & (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.intent_id") < F.col("b.intent_id")))
    kinds = [F.count_if(F.col("a.source_type") == k).alias(f"{k.lower()}_support") for k in ("ADR", "PR", "COMMIT")]
    return met.groupBy(F.col("a.intent_id").alias("source_intent"), F.col("b.intent_id").alias("target_intent")).agg(F.count("*").alias("evidence_count"), F.least(F.lit(1.0), F.count("*") / 10.0).alias("weight"), *kinds).where(F.col("evidence_count") >= least)


def centrality(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """Summed edge weights of each node, over both ends."""
    ends = edges.select(F.col(source).alias("node"), F.col(weight).alias("w")).unionByName(edges.select(F.col(target).alias("node"), F.col(weight).alias("w")))
    return ends.groupBy("node").agg(F.sum("w").alias("centrality"), F.count("*").alias("degree"))


def change_risk(incident_count: Column, total: Column) -> Column:
    """Laplace-smoothed frequency of incidents."""
    return (incident_count + 1) / (total + 20)


def noisy_or(risk: Column) -> Column:
    """1 - prod(1 - r) over a group."""
    return 1 - F.product(1 - risk)


def intent_evidence(sources: DataFrame) -> DataFrame:
    """(intent_id, type, topic, source_type, source_id, snippet, created_at) of texts (source_type, source_id, text, created_at); a topic's id is the hash of type:topic."""
    found = sources.select("source_type", "source_id", "created_at", F.explode(purposes(F.col("text"))).alias("p"))
    return found.select(F.sha2(F.concat_ws(":", "p.type", "p.topic"), 256).alias("intent_id"), "p.type", "p.topic", "source_type", "source_id", "p.snippet", "created_at")


def intents(evidence: DataFrame) -> DataFrame:
    """Topics with their evidence: confidence of the best source, counts by source, first and last time."""
    trust = F.lit(0.0)
    for kind, value in SOURCE_CONFIDENCE.items():
        trust = F.when(F.col("source_type") == kind, value).otherwise(trust)
    count = lambda kind: F.count_if(F.col("source_type") == kind)
    return evidence.groupBy("intent_id", "type", "topic").agg(F.max(trust).alias("confidence"), F.count("*").alias("evidence_count"), count("ADR").alias("adr_count"), count("PR").alias("pr_count"), count("COMMIT").alias("commit_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
