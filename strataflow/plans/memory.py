"""Queries of the knowledge lifecycle over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import memory as op
from strataflow.plans.registry import query
from strataflow.sources import roles
from strataflow.sources.adapters import table

_AUTHOR = "CASE WHEN event_id % 11 = 0 THEN 'user' WHEN event_id % 7 = 0 THEN 'system' WHEN event_id % 2 = 0 THEN 'mentor' ELSE 'agent' END"


@query("m2_note_dedup", "SELECT min(doc_id) AS id, list_sort(list(DISTINCT lang)) AS tags, count(*) AS n FROM documents GROUP BY regexp_replace(lower(text), '[^a-z0-9]', '', 'g')")
def m2_note_dedup(spark, d):
    return op.dedupe(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang").alias("tags")))


@query("j24_external_id_merge", "SELECT source, min(doc_id) AS id, list_sort(list(DISTINCT lang)) AS tags, count(*) AS n FROM documents GROUP BY source")
def j24_external_id_merge(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("id"), F.array_sort(F.collect_set("lang")).alias("tags"), F.count("*").alias("n"))


_PREC = "CASE author WHEN 'user' THEN 0 WHEN 'system' THEN 1 WHEN 'mentor' THEN 2 WHEN 'agent' THEN 3 ELSE 4 END"


@query("m3_conflicts", f"WITH e AS (SELECT user_id AS subject, event_id AS id, {_AUTHOR} AS author, event_type AS claim FROM events), k AS (SELECT subject, count(DISTINCT claim) AS claims, min({_PREC}) AS best, count(*) FILTER (author = 'mentor') AS mentors FROM e GROUP BY subject) SELECT subject, id, CASE WHEN claims = 1 THEN 'agreed' WHEN best = 2 AND mentors > 1 THEN 'escalated' WHEN row_number() OVER (PARTITION BY subject ORDER BY {_PREC}, id) = 1 THEN 'kept' ELSE 'overruled' END AS verdict FROM e JOIN k USING (subject)")
def m3_conflicts(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), F.expr(_AUTHOR).alias("author"), F.col("event_type").alias("claim"))
    return op.conflicts(rows)


@query("m4_promotion", f"SELECT user_id AS k, count(*) AS n, bool_or(author IN ('user', 'system')) OR count(*) >= 3 AS promoted FROM (SELECT user_id, {_AUTHOR} AS author FROM events) GROUP BY user_id")
def m4_promotion(spark, d):
    return op.promoted(table(spark, d, "events").select(F.col("user_id").alias("k"), F.expr(_AUTHOR).alias("author")))


@query("m8_value_score", "SELECT event_id, round(greatest(0.0, least(1.0, 0.2 * least(1, value / 100) + 0.3 * (user_id % 10) / 10 + 0.2 * 0.5 + 0.1 * (event_id % 5) / 5 + 0.5 * (event_id % 3) / 3)), 6) AS score FROM events")
def m8_value_score(spark, d):
    score = op.value_score(F.least(F.lit(1.0), F.col("value") / 100), (F.col("user_id") % 10) / 10, F.lit(0.5), (F.col("event_id") % 5) / 5, (F.col("event_id") % 3) / 3)
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("score"))


_RR = f"""b AS (SELECT user_id AS query, event_id AS id, author, score + CASE author WHEN 'user' THEN 0.05 WHEN 'system' THEN 0.03 ELSE 0.0 END + 0.03 * exp(-age / 30) + 0.02 * conf AS s FROM (SELECT user_id, event_id, {_AUTHOR} AS author, least(1.0, value / 200) AS score, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age, (event_id % 10) / 10 AS conf FROM events)),
    f AS (SELECT *, s - greatest(0.0, (row_number() OVER (PARTITION BY query, author ORDER BY round(s, 9) DESC, id) - 2) * 0.02) AS final FROM b)"""


@query("m7_memory_rerank", f"WITH {_RR} SELECT query, id, round(final, 6) AS final FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(final, 9) DESC, id) <= 5")
def m7_memory_rerank(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.expr(_AUTHOR).alias("author"), F.least(F.lit(1.0), F.col("value") / 200).alias("score"), F.datediff(F.lit("2024-01-31"), F.col("ts").cast("date")).alias("age_days"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return op.rerank(rows, 5).select("query", "id", F.round("final", 6).alias("final"))


@query("w14_diversity_penalty", f"WITH {_RR} SELECT id, round(s - final, 6) AS penalty FROM f")
def w14_diversity_penalty(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.expr(_AUTHOR).alias("author"), F.least(F.lit(1.0), F.col("value") / 200).alias("score"), F.datediff(F.lit("2024-01-31"), F.col("ts").cast("date")).alias("age_days"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return op.rerank(rows, 1 << 30).select("id", F.round(F.col("s") - F.col("final"), 6).alias("penalty"))


@query("m9_over_budget", "SELECT event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) > 50")
def m9_over_budget(spark, d):
    return op.over_budget(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "value"), "user_id", 50).select("id")


_STATES = "['observed', 'validated', 'promoted', 'invalidated', 'retired']"


@query("m10_lifecycle", f"WITH e AS (SELECT event_id, {_STATES}[event_id % 5 + 1] AS state, {_STATES}[event_id // 5 % 5 + 1] AS wanted FROM events) SELECT event_id, (state, wanted) IN (('observed', 'validated'), ('observed', 'retired'), ('validated', 'promoted'), ('validated', 'invalidated'), ('promoted', 'invalidated'), ('promoted', 'retired'), ('invalidated', 'validated'), ('invalidated', 'retired')) AS ok FROM e")
def m10_lifecycle(spark, d):
    states = F.array(*[F.lit(x) for x in ("observed", "validated", "promoted", "invalidated", "retired")])
    rows = table(spark, d, "events").select("event_id", F.get(states, (F.col("event_id") % 5).cast("int")).alias("state"), F.get(states, (F.floor(F.col("event_id") / 5) % 5).cast("int")).alias("wanted"))
    return op.allowed(rows).select("event_id", "ok")


@query("m11_reinforcement", """WITH o AS (SELECT user_id AS subject, event_type AS source, value < 120 AS agrees, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (WITH RECURSIVE g AS (SELECT subject, n, CASE WHEN agrees THEN 30.0::DOUBLE + 70.0 * 0.2 ELSE 30.0::DOUBLE * 0.3 END AS c, CASE WHEN agrees THEN [source] ELSE []::VARCHAR[] END AS seen FROM o WHERE n = 1
        UNION ALL SELECT o.subject, o.n, CASE WHEN NOT agrees THEN c * 0.3 WHEN NOT list_contains(seen, source) THEN c + (100 - c) * 0.2 ELSE c END, CASE WHEN agrees AND NOT list_contains(seen, source) THEN list_append(seen, source) ELSE seen END FROM g JOIN o ON o.subject = g.subject AND o.n = g.n + 1) SELECT subject, max_by(c, n) AS c FROM g GROUP BY subject)
    SELECT subject, round(c, 6) AS confidence, CASE WHEN c >= 60 THEN 'promoted' WHEN c >= 30 THEN 'validated' ELSE 'observed' END AS state FROM r""")
def m11_reinforcement(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), F.col("event_type").alias("source"), (F.col("value") < 120).alias("agrees"))
    return op.reinforced(rows).withColumn("confidence", F.round("confidence", 6))


@query("m13_knowledge_query", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value >= 100 ORDER BY value DESC, event_id LIMIT 20")
def m13_knowledge_query(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' AND value >= 100").orderBy(F.col("value").desc(), "event_id").limit(20).select("event_id")


@query("m14_identity_registry", "WITH reg AS (SELECT 'sig' || p_partkey AS signature, 'id' || p_partkey AS uuid FROM part WHERE p_partkey % 3 = 0), al AS (SELECT 'sig' || p_partkey AS signature, 'sig' || (p_partkey - 1) AS target FROM part WHERE p_partkey % 3 = 1) SELECT s.signature, coalesce(r.uuid, t.uuid, sha256(s.signature)) AS uuid, CASE WHEN r.uuid IS NOT NULL THEN 'known' WHEN t.uuid IS NOT NULL THEN 'alias' ELSE 'new' END AS origin FROM (SELECT 'sig' || p_partkey AS signature FROM part) s LEFT JOIN reg r USING (signature) LEFT JOIN al USING (signature) LEFT JOIN reg t ON t.signature = target")
def m14_identity_registry(spark, d):
    sig = lambda c: F.concat(F.lit("sig"), c.cast("string"))
    part = table(spark, d, "part")
    registry = part.where("p_partkey % 3 = 0").select(sig(F.col("p_partkey")).alias("signature"), F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("uuid"))
    aliases = part.where("p_partkey % 3 = 1").select(sig(F.col("p_partkey")).alias("signature"), sig(F.col("p_partkey") - 1).alias("target"))
    return op.resolve_identity(part.select(sig(F.col("p_partkey")).alias("signature")), registry, aliases)


@query("n16_subquestion_check", "WITH q AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3) AS w FROM conversations WHERE role = 'user'), m AS (SELECT conv_id, w AS master FROM q WHERE turn = 0) SELECT conv_id, turn FROM q JOIN m USING (conv_id) WHERE turn > 0 AND length(text) >= 12 AND list_has_any(q.w, master)")
def n16_subquestion_check(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 3)
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", words.alias("w"))
    m = q.where("turn = 0").select("conv_id", F.col("w").alias("master"))
    return q.where("turn > 0").join(m, "conv_id").where((F.length("text") >= 12) & F.arrays_overlap("w", "master")).select("conv_id", "turn")


@query("m12_validation", roles.with_("knowledge_records") + """, t AS (SELECT *, CASE request WHEN 'validate' THEN 'validated' WHEN 'promote' THEN 'promoted' WHEN 'retire' THEN 'retired' ELSE 'invalidated' END AS wanted FROM knowledge_records),
    j AS (SELECT *, (state, wanted) IN (('observed', 'validated'), ('observed', 'retired'), ('validated', 'promoted'), ('validated', 'invalidated'), ('promoted', 'invalidated'), ('promoted', 'retired'), ('invalidated', 'validated'), ('invalidated', 'retired'))
        AND CASE request WHEN 'validate' THEN confidence >= 30 WHEN 'promote' THEN confidence >= 60 WHEN 'retire' THEN idle_days >= 30 ELSE true END AS ok FROM t)
    SELECT id, ok, CASE WHEN ok THEN wanted ELSE state END AS state, round(CASE WHEN ok AND request = 'contradict' THEN confidence * 0.3 WHEN ok AND request = 'expire' THEN confidence * 0.7 ELSE confidence END, 6) AS confidence FROM j""")
def m12_validation(spark, d):
    return op.lifecycle_requests(roles.role(spark, d, "knowledge_records")).withColumn("confidence", F.round("confidence", 6))


@query("m1_proposal_pipeline", roles.with_("proposals") + r""", p AS (SELECT *, coalesce('ext:' || external_id, 'text:' || regexp_replace(lower(content), '[^a-z0-9]', '', 'g')) AS k, length(trim(content)) >= 12 AS valid FROM proposals),
    f AS (SELECT k, min(id) AS head, count(*) AS n, bool_or(author IN ('user', 'system')) AS strong FROM p WHERE valid GROUP BY k), h AS (SELECT p.*, regexp_matches(content, '(?i)\b(never|not|no|avoid|don''t)\b') AS claim, n, strong FROM p JOIN f ON f.k = p.k AND head = p.id),
    c AS (SELECT id, k, n, strong, count(DISTINCT claim) OVER s AS claims, min(CASE author WHEN 'user' THEN 0 WHEN 'system' THEN 1 WHEN 'mentor' THEN 2 ELSE 3 END) OVER s AS best, count(*) FILTER (author = 'mentor') OVER s AS mentors, row_number() OVER (PARTITION BY subject ORDER BY CASE author WHEN 'user' THEN 0 WHEN 'system' THEN 1 WHEN 'mentor' THEN 2 ELSE 3 END, id) AS rn FROM h WINDOW s AS (PARTITION BY subject)),
    v AS (SELECT k, id AS head, CASE WHEN claims > 1 AND best = 2 AND mentors > 1 THEN 'ephemeral' WHEN claims > 1 AND rn > 1 THEN 'stale' WHEN strong OR n >= 3 THEN 'persistent' ELSE 'ephemeral' END AS state FROM c)
    SELECT id, CASE WHEN NOT valid THEN 'rejected' WHEN id <> head THEN 'merged' ELSE state END AS state, CASE WHEN valid THEN head END AS affected_id FROM p LEFT JOIN v ON v.k = p.k AND valid""")
def m1_proposal_pipeline(spark, d):
    return op.ingest(roles.role(spark, d, "proposals"))


_NOTE_SEARCH = roles.with_("notes") + """, s AS (SELECT q.id AS query, v.id, v.tag, v.scope, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM notes q JOIN notes v ON q.id <> v.id WHERE q.id % 20 = 0 AND v.repository_id = 'r2' AND NOT v.stale),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) <= 100), t AS (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) AS rank FROM f WHERE tag IN ('db', 'api') QUALIFY rank <= 30)"""


def _notes(spark, d):
    return roles.role(spark, d, "notes").withColumns({"tags": F.array("tag"), "scope_keys": F.array("scope")})


@query("m5_note_search", f"{_NOTE_SEARCH} SELECT query, id, round(similarity, 6) AS similarity, rank FROM t")
def m5_note_search(spark, d):
    notes = _notes(spark, d)
    return op.search(notes, notes.where("id % 20 = 0"), "embedding", ["r2"], tags=["db", "api"], limit=30).withColumn("similarity", F.round("similarity", 6))


def _lifecycle(spark, d):
    notes = _notes(spark, d)
    found = op.search(notes, notes.where("id % 20 = 0"), "embedding", ["r2"], tags=["db", "api"], limit=30)
    return op.lifecycle_search(found.select("query", "id", "similarity"), notes.select("id", "status", "author", "age_days", "confidence"), 10)


@query("m6_lifecycle_search", f"""{_NOTE_SEARCH}, b AS (SELECT query, id, author, similarity + CASE author WHEN 'user' THEN 0.05 WHEN 'system' THEN 0.03 ELSE 0.0 END + 0.03 * exp(-age_days / 30) + 0.02 * confidence AS s FROM t JOIN notes USING (id) WHERE coalesce(status, 'active') = 'active'),
    f2 AS (SELECT *, s - greatest(0.0, (row_number() OVER (PARTITION BY query, author ORDER BY round(s, 9) DESC, id) - 2) * 0.02) AS final FROM b) SELECT query, id, round(final, 6) AS final, row_number() OVER (PARTITION BY query ORDER BY round(final, 9) DESC, id) AS rank FROM f2 QUALIFY rank <= 10""")
def m6_lifecycle_search(spark, d):
    return _lifecycle(spark, d)[0].select("query", "id", F.round("final", 6).alias("final"), "rank")


@query("m6_retrieval_yield", f"{_NOTE_SEARCH} SELECT query, count(*) AS retrieved, count(*) FILTER (coalesce(status, 'active') = 'active') AS active, count(*) FILTER (coalesce(status, 'active') = 'active') / count(*) AS \"yield\", count(*) FILTER (coalesce(status, 'active') = 'active') / count(*) < 0.5 AS low FROM t JOIN notes USING (id) GROUP BY query")
def m6_retrieval_yield(spark, d):
    return _lifecycle(spark, d)[1]
