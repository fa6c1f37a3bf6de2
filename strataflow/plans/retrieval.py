"""Queries of text and vector retrieval over documents, benchmark texts (as questions) and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.operators import blockmax
from strataflow.operators import retrieval as op
from strataflow.plans.registry import query
from strataflow.sources.adapters import table

_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_LISTS = f"""dt AS (SELECT doc_id AS doc, {_TOK} AS t FROM documents), post AS (SELECT doc, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS token FROM dt) GROUP BY ALL),
    st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM dt), ask AS (SELECT DISTINCT item_id AS query, unnest({_TOK}) AS term FROM benchmark),
    dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
    sc AS (SELECT query, doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN ask ON term = token JOIN dfs USING (token), st GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc)"""


def _bm25(spark, d, top=10, **more):
    return op.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", top, **more)


@query("v1_line_chunks", "SELECT doc_id, s + 1 AS start_line, least(s + 50, len(l)) AS end_line, substr(array_to_string(l[s + 1:s + 50], chr(10)), 1, 6000) AS text FROM (SELECT doc_id, l, unnest(range(0, len(l), 40)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(substr(array_to_string(l[s + 1:s + 50], chr(10)), 1, 6000))) >= 8")
def v1_line_chunks(spark, d):
    return op.line_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("v3_chunk_ids", "SELECT doc_id, sha256(source || ':' || '1' || ':' || sha256(text)) AS chunk_id FROM documents")
def v3_chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", op.chunk_id(F.col("source"), F.lit(1), F.col("text")).alias("chunk_id"))


@query("v4_chunk_tokens", f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def v4_chunk_tokens(spark, d):
    t = op.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("v5_unit_tokens", "SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 1)) AS n_tokens FROM documents")
def v5_unit_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(op.unit_tokens(F.col("text"))).alias("n_tokens"))


@query("v6_bm25_search", f"WITH {_LISTS} SELECT query, doc, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def v6_bm25_search(spark, d):
    return _bm25(spark, d).withColumn("score", F.round("score", 6))


@query("v6_bm25_prefix_search", """WITH dt AS (SELECT doc_id AS doc, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), post AS (SELECT doc, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS token FROM dt) GROUP BY ALL),
    st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM dt), ask(query, term) AS (VALUES (1, 'licens'), (1, 'mit'), (2, 'apa'), (3, 'publi')),
    hit AS (SELECT query, doc, dl, token, tf FROM post JOIN ask ON starts_with(token, term)), dfs AS (SELECT token, count(DISTINCT doc) AS df FROM post GROUP BY token),
    sc AS (SELECT query, doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit JOIN dfs USING (token), st GROUP BY ALL)
    SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc QUALIFY rank <= 5""")
def v6_bm25_prefix_search(spark, d):
    asked = spark.range(1, 4).select(F.col("id").cast("int").alias("q"), F.element_at(F.array(F.lit("licens mit"), F.lit("apa"), F.lit("publi")), F.col("id").cast("int")).alias("text"))
    return op.bm25(table(spark, d, "documents"), asked, "doc_id", "text", "q", "text", 5, prefix=True).withColumn("score", F.round("score", 6))


_SIM = "sims AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), nn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) AS rank FROM sims)"


def _knn(spark, d, k=10):
    vectors = table(spark, d, "embeddings")
    return op.knn(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k)


@query("v9_cosine_topk", f"WITH {_SIM} SELECT query, id, round(similarity, 6) AS similarity, rank FROM nn WHERE rank <= 10")
def v9_cosine_topk(spark, d):
    return _knn(spark, d).withColumn("similarity", F.round("similarity", 6))


@query("v10_cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v10_cosine_pairs(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(op.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("v11_cache_lookup", f"WITH {_SIM} SELECT query, id, round(similarity, 6) AS similarity FROM nn WHERE rank = 1 AND similarity >= 0.3")
def v11_cache_lookup(spark, d):
    return _knn(spark, d, 1).where("similarity >= 0.3").select("query", "id", F.round("similarity", 6).alias("similarity"))


_FUSED = f"{_LISTS}, b20 AS (SELECT query, doc, rank FROM bm WHERE rank <= 20), len20 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc) AS rank FROM b20 JOIN documents ON doc_id = doc), fused AS (SELECT query, doc, sum(part) AS score FROM (SELECT query, doc, 0.6 / (60 + rank) AS part FROM b20 UNION ALL SELECT query, doc, 0.4 / (60 + rank) FROM len20) GROUP BY ALL)"


def _fused(spark, d):
    b20 = _bm25(spark, d, 20).select("query", "doc", "rank")
    sized = b20.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars"), "doc")
    other = sized.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy(F.col("n_chars").desc(), "doc")).alias("rank"))
    return op.rrf([(b20, 0.6), (other, 0.4)])


@query("v14_rank_fusion", f"WITH {_FUSED} SELECT query, doc, round(score, 9) AS score FROM fused")
def v14_rank_fusion(spark, d):
    return _fused(spark, d).withColumn("score", F.round("score", 9))


@query("v17_vector_channel", f"WITH {_SIM} SELECT query, id, rank FROM nn WHERE rank <= 15")
def v17_vector_channel(spark, d):
    return _knn(spark, d, 15).select("query", "id", "rank")


@query("v22_budget_packing", f"""WITH RECURSIVE {_LISTS}, c AS (SELECT query, doc, least(CAST(ceil(n_chars / 4) AS INTEGER), 1200) AS n, row_number() OVER (PARTITION BY query ORDER BY round(score, 4) DESC, doc) AS i FROM bm JOIN documents ON doc_id = doc WHERE rank <= 20 AND ceil(n_chars / 4) <= 3600),
    f AS (SELECT query, doc, i, CASE WHEN n <= 2500 THEN n ELSE 0 END AS used, n <= 2500 AS took FROM c WHERE i = 1 UNION ALL SELECT c.query, c.doc, c.i, CASE WHEN used + n <= 2500 THEN used + n ELSE used END, used + n <= 2500 FROM f JOIN c ON c.query = f.query AND c.i = f.i + 1)
    SELECT query, doc AS id FROM f WHERE took""")
def v22_budget_packing(spark, d):
    rows = _bm25(spark, d, 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("chars")), "doc").select("query", F.col("doc").alias("id"), "score", "chars")
    return op.packed(rows, "query", 2500).select("query", "id")


@query("v23_score_buckets", f"WITH {_LISTS} SELECT CASE WHEN score > 10 THEN 0.9 WHEN score > 0 THEN 0.7 ELSE 0.5 END AS bucket, count(*) AS n FROM bm WHERE rank <= 10 GROUP BY 1")
def v23_score_buckets(spark, d):
    return _bm25(spark, d).groupBy(F.when(F.col("score") > 10, 0.9).when(F.col("score") > 0, 0.7).otherwise(0.5).cast("decimal(2,1)").alias("bucket")).agg(F.count("*").alias("n"))


@query("v31_evidence_coverage", "WITH g AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY user_id) SELECT user_id, len(list_intersect(have, ['click', 'error', 'refund'])) / 3 AS coverage, list_sort(list_filter(['click', 'error', 'refund'], lambda x: NOT list_contains(have, x))) AS gaps FROM g")
def v31_evidence_coverage(spark, d):
    need = F.array(F.lit("click"), F.lit("error"), F.lit("refund"))
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have")).select("user_id", (F.size(F.array_intersect("have", need)) / 3).alias("coverage"), F.array_sort(F.array_except(need, F.col("have"))).alias("gaps"))


@query("v32_confidence_level", f"WITH {_LISTS}, t AS (SELECT query, avg(score) AS s, count(DISTINCT source) AS files FROM bm JOIN documents ON doc_id = doc WHERE rank <= 10 GROUP BY query) SELECT query, CASE WHEN s > 60 AND files >= 3 THEN 'high' WHEN s > 30 THEN 'medium' ELSE 'low' END AS level FROM t")
def v32_confidence_level(spark, d):
    rows = _bm25(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc").groupBy("query").agg(F.avg("score").alias("s"), F.count_distinct("source").alias("files"))
    return rows.select("query", F.when((F.col("s") > 60) & (F.col("files") >= 3), "high").when(F.col("s") > 30, "medium").otherwise("low").alias("level"))


@query("v35_session_recency", "SELECT user_id, event_id, CASE WHEN gap <= 2 THEN 0.3 WHEN gap <= 5 THEN 0.2 WHEN gap <= 10 THEN 0.1 ELSE 0.0 END AS boost FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS gap FROM events) WHERE gap < 20")
def v35_session_recency(spark, d):
    gap = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())) - 1
    rows = table(spark, d, "events").withColumn("gap", gap).where("gap < 20")
    return rows.select("user_id", "event_id", F.when(F.col("gap") <= 2, 0.3).when(F.col("gap") <= 5, 0.2).when(F.col("gap") <= 10, 0.1).otherwise(0.0).cast("decimal(2,1)").alias("boost"))


_STEM = "list_distinct(list_transform({}, lambda w: regexp_replace(w, '(ing|edly|ed|ly|es|s)$', '')))"


@query("v36_token_set_similarity", f"WITH x AS (SELECT item_id, {_STEM.format(_TOK)} AS t FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS similarity FROM x a JOIN x b ON b.item_id = a.item_id + 1")
def v36_token_set_similarity(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", op.stemmed(op.tokens(F.col("text"))).alias("t"))
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return rows.join(other, "item_id").select("item_id", F.round(op.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query("t7_interleave", "WITH r AS (SELECT doc_id % 200 AS id, doc_id % 3 AS provider_no, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY n_chars DESC, doc_id) AS pos FROM documents), f AS (SELECT id, min((pos, provider_no)) AS a FROM r GROUP BY id) SELECT id, a[1] AS pos, a[2] AS provider_no FROM f ORDER BY a, id LIMIT 50")
def t7_interleave(spark, d):
    pos = F.row_number().over(Window.partitionBy("provider_no").orderBy(F.col("n_chars").desc(), "doc_id"))
    rows = table(spark, d, "documents").withColumn("provider_no", F.col("doc_id") % 3).withColumn("pos", pos).select((F.col("doc_id") % 200).alias("id"), "provider_no", "pos")
    return op.interleaved(rows, 50)


@query("t8_per_group_cap", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def t8_per_group_cap(spark, d):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    return table(spark, d, "documents").withColumn("rn", rank).where("rn <= 5").select("source", "doc_id")


@query("u5_dedupe_keep_best", "SELECT doc_id % 100 AS id, max(n_chars) AS score FROM documents GROUP BY 1")
def u5_dedupe_keep_best(spark, d):
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 100).alias("id")).agg(F.max("n_chars").alias("score"))


@query("w15_score_normalization", f"WITH {_LISTS}, t AS (SELECT query, doc, score FROM bm WHERE rank <= 40), m AS (SELECT query, min(score) AS lo, max(score) AS hi FROM t GROUP BY query) SELECT query, doc, round(CASE WHEN hi = lo THEN 1.0 ELSE 0.3 + (score - lo) / (hi - lo) * 0.7 END, 6) AS normalized FROM t JOIN m USING (query)")
def w15_score_normalization(spark, d):
    return op.min_max(_bm25(spark, d, 40), "query", "score").select("query", "doc", F.round("normalized", 6).alias("normalized"))


@query("v6_indexed_search", f"WITH {_LISTS} SELECT query, doc, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def v6_indexed_search(spark, d):
    return op.index(table(spark, d, "documents"), "doc_id", "text").search(table(spark, d, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))


@query("v6_block_search", f"WITH {_LISTS} SELECT query, doc, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def v6_block_search(spark, d):
    """The search of v6_bm25_search by lists in blocks with bounds."""
    index = blockmax.block_index(table(spark, d, "documents"), "doc_id", "text")
    return index.search(table(spark, d, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))
