"""Knowledge lifecycle: deduplication, conflicts, promotion, reinforcement, reranking, budgets, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.text import normalized
from strataflow.operators.folds import sorted_fold

#: Fixed precedence of author types, the strongest first.
PRECEDENCE = ("user", "system", "mentor", "agent")
#: Fixed transitions of the knowledge lifecycle.
TRANSITIONS = [("observed", "validated"), ("observed", "retired"), ("validated", "promoted"), ("validated", "invalidated"), ("promoted", "invalidated"), ("promoted", "retired"), ("invalidated", "validated"), ("invalidated", "retired")]


def precedence(author: Column) -> Column:
    found = F.lit(len(PRECEDENCE))
    for k in reversed(range(len(PRECEDENCE))):
        found = F.when(author == PRECEDENCE[k], k).otherwise(found)
    return found


def dedupe(notes: DataFrame) -> DataFrame:
    """Notes (id, content, tags) that say the same once letters and digits alone are compared: the first id, all tags, the number."""
    return notes.withColumn("_k", normalized(F.col("content"))).groupBy("_k").agg(F.min("id").alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count("*").alias("n")).drop("_k")


def conflicts(notes: DataFrame) -> DataFrame:
    """Of notes (subject, id, author, claim) that contradict each other the strongest author's stays; two mentors escalate."""
    first = F.row_number().over(Window.partitionBy("subject").orderBy(precedence(F.col("author")), "id"))
    w = Window.partitionBy("subject")
    rows = notes.withColumn("rn", first).withColumn("claims", F.size(F.collect_set("claim").over(w))).withColumn("best", F.min(precedence(F.col("author"))).over(w))
    mentors = F.sum((F.col("author") == "mentor").cast("int")).over(w)
    rows = rows.withColumn("mentors", mentors)
    escalated = (F.col("best") == PRECEDENCE.index("mentor")) & (F.col("mentors") > 1)
    return rows.select("subject", "id", F.when(F.col("claims") == 1, "agreed").when(escalated, "escalated").when(F.col("rn") == 1, "kept").otherwise("overruled").alias("verdict"))


def promoted(observations: DataFrame, least: int = 3) -> DataFrame:
    """Content by user or system is promoted at once, others after `least` observations: (k, n, promoted)."""
    strong = F.max(F.col("author").isin("user", "system").cast("int")) == 1
    return observations.groupBy("k").agg(F.count("*").alias("n"), strong.alias("strong")).select("k", "n", (F.col("strong") | (F.col("n") >= least)).alias("promoted"))


def reinforced(observations: DataFrame) -> DataFrame:
    """Confidence of a claim from its observations in order: a new source adds a fifth of what is missing, a contradiction leaves three tenths.

    observations: (subject, seq, source, agrees boolean). A source is new where it agrees for the first time; a row without a source
    adds nothing unless it contradicts. An ordered fold that holds one number.
    """
    agrees = F.coalesce("agrees", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("subject", "source", agrees).orderBy("seq"))
    own = observations.select("subject", "seq", F.col("source").alias("by"), agrees.alias("agrees"), (F.col("source").isNotNull() & (nth == 1)).alias("new"))

    def step(c, agrees, new):
        c = 30.0 if c is None else c
        return (c + (100 - c) * 0.2 if new else c) if agrees else c * 0.3, None

    found = sorted_fold(own, ["subject"], ["seq", "by", "agrees"], ["agrees", "new"], step, "confidence double", lambda c: (c,))
    return found.withColumn("state", F.when(F.col("confidence") >= 60, "promoted").when(F.col("confidence") >= 30, "validated").otherwise("observed"))


def value_score(confidence: Column, usage: Column, impact: Column, recency: Column, helpful: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 * confidence + 0.3 * usage + 0.2 * impact + 0.1 * recency + 0.5 * helpful))


def rerank(rows: DataFrame, limit: int) -> DataFrame:
    """Notes of each query by score plus bonuses for author, age and confidence, less .02 for each of the same author type beyond two."""
    bonus = F.when(F.col("author") == "user", 0.05).when(F.col("author") == "system", 0.03).otherwise(0.0)
    base = rows.withColumn("s", F.col("score") + bonus + 0.03 * F.exp(-F.col("age_days") / 30) + 0.02 * F.col("confidence"))
    nth = F.row_number().over(Window.partitionBy("query", "author").orderBy(F.round("s", 9).desc(), "id"))
    final = base.withColumn("nth", nth).withColumn("final", F.col("s") - F.greatest(F.lit(0.0), (F.col("nth") - 2) * 0.02))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("final", 9).desc(), "id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= limit)


def over_budget(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """Rows beyond the `budget` most valuable of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("value").desc(), "id"))
    return rows.withColumn("rn", rank).where(F.col("rn") > budget).drop("rn")


def allowed(rows: DataFrame) -> DataFrame:
    """Whether each wanted change (state, wanted) is a transition of the lifecycle."""
    table = rows.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("state"), F.lit(b).alias("wanted")) for a, b in TRANSITIONS]))).withColumn("ok", F.lit(True))
    return rows.join(F.broadcast(table), ["state", "wanted"], "left").fillna({"ok": False})


def resolve_identity(rows: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """Signatures to ids: the registry's, else through an alias, else a new id from the signature itself."""
    direct = rows.join(registry.select("signature", F.col("uuid").alias("u1")), "signature", "left")
    by_alias = aliases.join(registry.select(F.col("signature").alias("target"), F.col("uuid").alias("u2")), "target").select("signature", "u2")
    return direct.join(by_alias, "signature", "left").select("signature", F.coalesce("u1", "u2", F.sha2("signature", 256)).alias("uuid"), F.when(F.col("u1").isNotNull(), "known").when(F.col("u2").isNotNull(), "alias").otherwise("new").alias("origin"))


#: Confidence from which a record can be validated and promoted, and what a contradiction or staleness leaves of it.
VALIDATED, PROMOTED, CONTRADICTED, STALE, RETENTION_DAYS = 30.0, 60.0, 0.3, 0.7, 30


def lifecycle_requests(records: DataFrame) -> DataFrame:
    """Records (id, state, confidence, request, idle_days) after a request: (id, ok, state, confidence).

    validate needs 30 and promote 60; contradict and expire invalidate and leave .3 and .7 of the confidence; retire takes what has
    been idle for 30 days. A change also has to be a transition of the lifecycle, else nothing changes.
    """
    request, c = F.col("request"), F.col("confidence")
    wanted = F.when(request == "validate", "validated").when(request == "promote", "promoted").when(request.isin("contradict", "expire"), "invalidated").when(request == "retire", "retired")
    enough = F.when(request == "validate", c >= VALIDATED).when(request == "promote", c >= PROMOTED).when(request == "retire", F.col("idle_days") >= RETENTION_DAYS).otherwise(True)
    rows = allowed(records.withColumn("wanted", wanted)).withColumn("ok", F.col("ok") & enough)
    left = F.when(~F.col("ok"), c).when(request == "contradict", F.greatest(F.lit(0.0), c * CONTRADICTED)).when(request == "expire", F.greatest(F.lit(0.0), c * STALE)).otherwise(c)
    return rows.select("id", "ok", F.when(F.col("ok"), F.col("wanted")).otherwise(F.col("state")).alias("state"), left.alias("confidence"))


def ingest(proposals: DataFrame, least: int = 12, observations: int = 3) -> DataFrame:
    """(id, state, affected_id): proposals (id, external_id, content, subject, author, tag) through validation, deduplication, conflict and promotion.

    Too short content is rejected. Of one external id, or one normalised content, the first is kept and the others merge into it. Claims on a
    subject that contradict each other (one denies) go by author; what loses is stale, two mentors escalate and stay ephemeral. What is
    left is persistent if its author is trusted or it has been observed often enough, else ephemeral.
    """
    key = F.coalesce(F.concat(F.lit("ext:"), F.col("external_id")), F.concat(F.lit("text:"), normalized(F.col("content"))))
    valid = F.length(F.trim("content")) >= least
    rows = proposals.withColumn("k", key).withColumn("valid", valid)
    own = rows.where("valid")
    first = own.groupBy("k").agg(F.min("id").alias("head"))
    heads = own.join(first.withColumnRenamed("head", "id"), ["k", "id"]).select("k", "id", "subject", "author", F.col("content").rlike(r"(?i)\b(never|not|no|avoid|don't)\b").alias("claim"))
    verdicts = conflicts(heads.select("subject", "id", "author", F.col("claim").cast("string").alias("claim"))).select("id", "verdict")
    trusted = promoted(own.select("k", "author"), observations).select("k", "promoted")
    judged = heads.join(verdicts, "id").join(trusted, "k").select(F.col("k").alias("_k"), F.col("id").alias("head"), F.when(F.col("verdict") == "overruled", "stale").when(F.col("verdict") == "escalated", "ephemeral").when(F.col("promoted"), "persistent").otherwise("ephemeral").alias("head_state"))
    out = rows.join(judged, (F.col("k") == F.col("_k")) & F.col("valid"), "left")
    state = F.when(~F.col("valid"), "rejected").when(F.col("id") != F.col("head"), "merged").otherwise(F.col("head_state"))
    return out.select("id", state.alias("state"), F.when(F.col("valid"), F.col("head")).alias("affected_id"))


def search(notes: DataFrame, queries: DataFrame, vector: str, repositories: list[str] | None = None, scope: str | None = None, include_stale: bool = False, scope_keys: list[str] | None = None, tags: list[str] | None = None, limit: int = 10, fetch: int = 100) -> DataFrame:
    """(query, id, similarity, rank): the nearest notes of each query among those of the repositories and scope, stale ones only if asked for.

    `fetch` neighbours are looked at; of those the ones with any of the scope keys and tags stay (notes: scope_keys, tags arrays), `limit` in all.
    """
    from strataflow.operators.retrieval import knn

    own = notes
    if repositories:
        own = own.where(F.col("repository_id").isin(*repositories))
    if scope:
        own = own.where(F.col("scope") == scope)
    if not include_stale:
        own = own.where("NOT stale")
    found = knn(own, queries, "id", vector, fetch).drop("rank")
    for column, wanted in (("scope_keys", scope_keys), ("tags", tags)):
        if wanted:
            found = found.join(own.where(F.arrays_overlap(column, F.array(*[F.lit(x) for x in wanted]))).select("id"), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("similarity", 9).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def lifecycle_search(found: DataFrame, metadata: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a search over-fetched (query, id, similarity; three times the limit) without dormant notes, reranked; and the yield of each query.

    metadata (id, status, author, age_days, confidence): a note without a status is active. The yield is (query, retrieved, active, yield, low),
    low under a half.
    """
    rows = found.join(metadata, "id", "left").withColumn("active", F.coalesce(F.col("status"), F.lit("active")) == "active")
    telemetry = rows.groupBy("query").agg(F.count("*").alias("retrieved"), F.count_if("active").alias("active")).withColumn("yield", F.col("active") / F.col("retrieved")).withColumn("low", F.col("yield") < 0.5)
    live = rows.where("active").select("query", "id", "author", F.col("similarity").alias("score"), F.coalesce("age_days", F.lit(0)).alias("age_days"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return rerank(live, limit), telemetry
