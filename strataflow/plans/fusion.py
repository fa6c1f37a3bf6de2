"""Queries of retrieval fusion, the approximate index, relevance of facts, and the answer cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions.session import cut
from strataflow.operators import fusion as op
from strataflow.operators import ivf, rerank
from strataflow.operators import retrieval as rop
from strataflow.plans import retrieval
from strataflow.plans.registry import query
from strataflow.sources.adapters import table
from strataflow.sources.roles import ctes, role, with_


@query("v7_filtered_search", f"WITH {retrieval._LISTS}, f AS (SELECT sc.* FROM sc JOIN documents ON doc_id = doc WHERE lang = 'en') SELECT query, doc, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 5")
def v7_filtered_search(spark, d):
    keep = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return retrieval._bm25(spark, d, 5, keep=keep).select("query", "doc", F.round("score", 6).alias("score"))


@query("a26_best_chunk_per_file", f"WITH {retrieval._LISTS} SELECT query, source, doc, round(score, 6) AS score FROM sc JOIN documents ON doc_id = doc QUALIFY row_number() OVER (PARTITION BY query, source ORDER BY round(score, 9) DESC, doc) = 1")
def a26_best_chunk_per_file(spark, d):
    best = rop.best_in_groups(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", "source")
    return best.select("query", F.col("group").alias("source"), "doc", F.round("score", 6).alias("score"))


@query("v8_segment_merge", """WITH tok AS (SELECT doc_id % 3 AS seg, doc_id AS doc, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), st AS (SELECT seg, count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok GROUP BY seg),
    ask AS (SELECT DISTINCT item_id AS query, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM benchmark), p AS (SELECT seg, doc, len(t) AS dl, unnest(t) AS token FROM tok), li AS (SELECT seg, doc, dl, token, count(*) AS tf FROM p SEMI JOIN ask USING (token) GROUP BY ALL),
    df AS (SELECT seg, token, count(*) AS df FROM li GROUP BY ALL), sc AS (SELECT query, li.seg, doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM li JOIN df ON df.seg = li.seg AND df.token = li.token JOIN st ON st.seg = li.seg JOIN ask ON ask.token = li.token WHERE doc NOT IN (SELECT doc_id FROM documents WHERE lang = 'es') GROUP BY ALL),
    m AS (SELECT query, doc, max(score) AS score FROM sc GROUP BY ALL) SELECT query, doc, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 10""")
def v8_segment_merge(spark, d):
    docs = table(spark, d, "documents")
    dead = docs.where("lang = 'es'").select(F.col("doc_id").alias("doc"))
    found = op.segmented_bm25(docs.withColumn("seg", F.col("doc_id") % 3), "seg", dead, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select("query", "doc", F.round("score", 6).alias("score"))


@query("v9_ivf_search")
def v9_ivf_search(spark, d):
    """Approximate neighbours; the tests hold its recall against the exact ones."""
    vectors = table(spark, d, "embeddings")
    return ivf.build(vectors, "vec_id", "embedding").search(vectors.where("vec_id % 20 = 0")).withColumn("similarity", F.round("similarity", 6))


@query("v9_index_upkeep", "WITH v AS (SELECT * FROM embeddings WHERE vec_id % 7 <> 3), s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity FROM v q JOIN v e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT query, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10")
def v9_index_upkeep(spark, d):
    """Built on four fifths of the rows; the others come, one in seven goes, long lists are split. A search through all lists then finds what is there, and nothing else."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = ivf.build(vectors.where("vec_id % 5 <> 0"), "vec_id", "embedding")
    index = index.with_rows(vectors.where("vec_id % 5 = 0")).without(vectors.where("vec_id % 7 = 3").select("vec_id")).split(1.5).compacted()
    asked = vectors.where("vec_id % 7 <> 3 AND vec_id % 20 = 0")
    return index.search(asked, probes=len(index.centres), candidates=index.n).withColumn("similarity", F.round("similarity", 6))


@query("v12_cache_lookup_weighted", f"WITH {retrieval._SIM}, m AS (SELECT query, id, similarity * CASE WHEN e.label = q.label THEN 1.1 ELSE 1.0 END * (0.85 + 0.15 * (e.vec_id % 11) / 10) AS s FROM sims JOIN embeddings e ON e.vec_id = id JOIN embeddings q ON q.vec_id = query) SELECT query, id, round(s, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) = 1")
def v12_cache_lookup_weighted(spark, d):
    vectors = table(spark, d, "embeddings").withColumn("quality", (F.col("vec_id") % 11) / 10)
    found = rop.knn(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 1, label="label", quality="quality")
    return found.select("query", "id", F.round("similarity", 6).alias("score"))


@query("v13_cache_quality", "WITH RECURSIVE " + ctes("cache_pairs", "cache_events") + """, o AS (SELECT id, delta, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM cache_events WHERE delta IS NOT NULL),
    q AS (SELECT id, 0 AS n, coalesce(quality, 0.5) AS q FROM cache_pairs UNION ALL SELECT q.id, o.n, greatest(0.0, least(1.0, q.q + delta)) FROM q JOIN o ON o.id = q.id AND o.n = q.n + 1), l AS (SELECT id, max_by(q, n) AS quality FROM q GROUP BY id),
    h AS (SELECT id, count(*) AS n, max(seen_at) AS last_accessed FROM cache_events WHERE delta IS NULL GROUP BY id)
    SELECT p.id, l.quality, coalesce(p.hits, 0) + coalesce(h.n, 0) AS hits, CAST(h.last_accessed AS DATE) AS last_accessed, l.quality <= 0.25 AS stale FROM cache_pairs p JOIN l USING (id) LEFT JOIN h USING (id)""")
def v13_cache_quality(spark, d):
    return op.cache_state(role(spark, d, "cache_pairs"), role(spark, d, "cache_events")).withColumn("last_accessed", F.col("last_accessed").cast("date"))


@query("v15_additive_boosts", f"WITH {retrieval._FUSED}, {ctes('questions', 'symbols')}, e AS (SELECT id AS query, lower(replace(CASE id % 30 WHEN 12 THEN 'QueryPlanner' WHEN 17 THEN 'load_index' WHEN 19 THEN 'run_mission' ELSE '' END, '_', '')) AS entity FROM questions), "
    """b AS (SELECT query, doc, CASE WHEN entity <> '' AND contains(lower(name), entity) THEN 2.5 WHEN entity <> '' AND contains(entity, lower(name)) THEN 2.0 ELSE 0.6 END + CASE WHEN kind = 'class' THEN 0.5 ELSE 0 END AS boost FROM e, symbols WHERE symbol_id % 40 = query % 40
        UNION ALL SELECT query, doc_id, 5.0 FROM e JOIN documents ON doc_id = query * 3 UNION ALL SELECT query, doc_id, 4.0 FROM e JOIN documents ON doc_id = query * 5 UNION ALL SELECT query, doc_id, 0.02 FROM e JOIN documents ON doc_id = query * 7),
    bb AS (SELECT query, doc, sum(boost) AS boost FROM b GROUP BY ALL)
    SELECT query, doc, round(coalesce(score, 0) + CASE WHEN boost IS NULL THEN 0 ELSE greatest(boost, 0.1) END, 9) AS score FROM fused FULL JOIN bb USING (query, doc)""")
def v15_additive_boosts(spark, d):
    entity = F.when(F.col("query") % 30 == 12, "QueryPlanner").when(F.col("query") % 30 == 17, "load_index").when(F.col("query") % 30 == 19, "run_mission").otherwise("")
    asked = role(spark, d, "questions").select(F.col("id").alias("query")).withColumn("entity", entity)
    symbols = role(spark, d, "symbols").join(asked, F.col("symbol_id") % 40 == F.col("query") % 40)
    hits = symbols.select("query", "doc", op.symbol_boost(F.col("name"), F.col("entity"), F.col("kind")).alias("boost"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    at = lambda factor, boost: asked.withColumn("doc", F.col("query") * factor).join(docs, "doc").select("query", "doc", F.lit(boost).alias("boost"))
    found = op.boosted(retrieval._fused(spark, d), [hits, at(3, op.EXPLICIT_PATH), at(5, op.SEED_FILE), at(7, 0.02)])
    return found.withColumn("score", F.round("score", 9))


_TOKENS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_STOP = "string_split('is are was were does do did where how what why when which who find show tell explain the a an in on at by for of to from with and or but not defined located handled implemented called used function class method file module code feature functionality system component logic executed project codebase', ' ')"
_KEYWORDS = f"list_filter({_TOKENS}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"


@query("v16_appended_channel", f"WITH {retrieval._LISTS}, r AS (SELECT query, doc, rank FROM bm WHERE rank <= 50), ask2 AS (SELECT DISTINCT item_id AS query, unnest({_KEYWORDS.format('text')}) AS token FROM benchmark), "
    "sc2 AS (SELECT query, doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN ask2 USING (token) JOIN dfs USING (token), st GROUP BY ALL), k AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc2 QUALIFY rank <= 50), "
    "n AS (SELECT query, max(rank) AS last FROM r GROUP BY query) SELECT query, doc, rank FROM r UNION ALL SELECT k.query, k.doc, row_number() OVER (PARTITION BY k.query ORDER BY k.rank) + coalesce(last, 0) FROM k ANTI JOIN r USING (query, doc) LEFT JOIN n USING (query)")
def v16_appended_channel(spark, d):
    return op.raw_and_keywords(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("v19_signal_prefilter", with_("questions", "annotations", "file_chunks") + f""", a AS (SELECT file, what, [symbol] AS key_symbols, list_distinct([signal, signal2]) AS signals FROM annotations), q AS (SELECT id AS query, text || ' m' || id || '.py' AS text, list_distinct({_KEYWORDS.format('text')}) AS terms, CASE WHEN id % 2 = 0 THEN ['store', 'entry'] ELSE ['model'] END AS preferred FROM questions),
    s AS (SELECT query, file, 2 * len(list_intersect(signals, preferred)) + len(list_filter(terms, lambda t: contains(lower(file || ' ' || what || ' ' || array_to_string(key_symbols, ' ')), t))) + CASE WHEN contains(lower(text), lower(string_split(file, '/')[-1])) THEN 2 ELSE 0 END AS score FROM q, a WHERE list_has_any(signals, preferred)),
    b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, file) <= 8) SELECT query, file, chunk, score FROM b JOIN (SELECT * FROM file_chunks QUALIFY row_number() OVER (PARTITION BY file ORDER BY start, chunk) <= 2) USING (file)""")
def v19_signal_prefilter(spark, d):
    notes = role(spark, d, "annotations").select("file", "what", F.array("symbol").alias("key_symbols"), F.array_distinct(F.array("signal", "signal2")).alias("signals"))
    preferred = F.when(F.col("id") % 2 == 0, F.array(F.lit("store"), F.lit("entry"))).otherwise(F.array(F.lit("model")))
    asked = role(spark, d, "questions").select(F.col("id").alias("query"), F.concat("text", F.lit(" m"), F.col("id").cast("string"), F.lit(".py")).alias("text"), op.keywords(F.col("text")).alias("terms"), preferred.alias("preferred"))
    return op.signal_prefilter(notes, asked, role(spark, d, "file_chunks").select("file", "chunk", "start"))


@query("v20_degraded_channels", with_("channel_errors", "channel_weights") + " SELECT query, channel, weight, error, contains(error, '(IO)') AND contains(lower(error), 'not found') AS corrupt FROM channel_errors JOIN channel_weights USING (strategy, channel) WHERE weight >= 0.4")
def v20_degraded_channels(spark, d):
    return op.degraded_channels(role(spark, d, "channel_errors"), role(spark, d, "channel_weights"))


@query("v21_rerank_normalization", f"""WITH {retrieval._LISTS}, t AS (SELECT query, doc, score, rank, b.text AS question, source || chr(10) || substr(d.text, 1, 1200) AS passage FROM bm JOIN documents d ON doc_id = doc JOIN benchmark b ON b.item_id = query WHERE rank <= 60),
    s AS (SELECT *, CASE WHEN rank <= 40 THEN CASE WHEN len(list_distinct({_KEYWORDS.format('question')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_KEYWORDS.format('question')}), {_TOKENS.format('passage')})) / len(list_distinct({_KEYWORDS.format('question')})) END END AS x FROM t),
    m AS (SELECT query, min(x) AS lo, max(x) AS hi, greatest(1e-9, max(CASE WHEN rank > 40 THEN score END)) AS tail FROM s GROUP BY query), f AS (SELECT query, doc, CASE WHEN x IS NULL THEN score / tail * 0.3 * 0.95 ELSE 0.3 + CASE WHEN hi - lo > 1e-9 THEN (x - lo) / (hi - lo) ELSE 1.0 END * 0.7 END AS score FROM s JOIN m USING (query))
    SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM f""")
def v21_rerank_normalization(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("file"), F.col("text").alias("content"))
    rows = retrieval._bm25(spark, d, 60).drop("rank").join(docs, "doc").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question")), "query")
    return op.reranked(rows).withColumn("score", F.round("score", 6))


@query("v24_fact_relevance", with_("unit_facts") + """, a(query, words) AS (VALUES (1, ['plan', 'limit']), (2, ['max_3', 'm4']), (3, ['import', '7'])), h AS (SELECT *, lower(concat_ws(chr(10), file_path, coalesce(symbol, ''), fact_type, value_kind, source_text, value)) AS hay FROM unit_facts),
    s AS (SELECT query, fact_id, file_path, start_line, end_line, fact_type, sum((length(hay) - length(replace(hay, w, ''))) // length(w)) AS score FROM h, (SELECT query, unnest(words) AS w FROM a) WHERE contains(hay, w) GROUP BY ALL)
    SELECT query, fact_id, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, file_path, start_line, end_line, fact_type, fact_id) AS rank FROM s QUALIFY rank <= 20""")
def v24_fact_relevance(spark, d):
    asked = spark.createDataFrame([(1, ["plan", "limit"]), (2, ["max_3", "m4"]), (3, ["import", "7"])], "query int, words array<string>")
    return op.fact_relevance(role(spark, d, "unit_facts"), asked)


@query("v25_threshold_relevance", with_("unit_facts") + """, h(query, hint) AS (VALUES (1, 'max'), (1, 'm4'), (2, 'plan'), (2, 'limit'), (3, 'nowhere')),
    s AS (SELECT query, fact_id, sum(3 * CAST(contains(lower(symbol), hint) AS INT) + 2 * CAST(contains(lower(file_path), hint) AS INT) + CAST(contains(lower(source_text), hint) AS INT)) AS score FROM unit_facts, h WHERE fact_type IN ('numeric_threshold', 'constant') GROUP BY ALL)
    SELECT query, fact_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, fact_id) <= 5""")
def v25_threshold_relevance(spark, d):
    hints = spark.createDataFrame([(1, "max"), (1, "m4"), (2, "plan"), (2, "limit"), (3, "nowhere")], "query int, hint string")
    return op.threshold_relevance(role(spark, d, "unit_facts"), hints)


@query("t5_epsilon_tie_sort", "WITH g AS (SELECT s_suppkey, s_name, s_acctbal, CASE WHEN lag(s_acctbal) OVER (ORDER BY s_acctbal DESC) - s_acctbal > 20 THEN 1 ELSE 0 END AS gap FROM supplier), r AS (SELECT *, sum(gap) OVER (ORDER BY s_acctbal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step FROM g) SELECT s_suppkey, row_number() OVER (ORDER BY step, s_name, s_suppkey) AS place FROM r QUALIFY place <= 50")
def t5_epsilon_tie_sort(spark, d):
    return op.near_tie_order(table(spark, d, "supplier"), "s_acctbal", ["s_name", "s_suppkey"], 20).where("place <= 50").select("s_suppkey", "place")


#: Questions that the reranker is trained on, made of documents chosen by a hash.
TRAINING_QUESTIONS = 500


@query("v21_trained_rerank")
def v21_trained_rerank(spark, d):
    """A reranker trained on about TRAINING_QUESTIONS questions made of the documents ranks what the search finds for every benchmark item."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    passages = cut(rerank.judged_passages(docs, "doc", "content", max(1, docs.count() // TRAINING_QUESTIONS)))
    rarity = cut(rerank.rarity_of(docs, "content"))
    # both kinds of questions are searched and meet the texts in one pass; an item has no passage, so its candidates are not judged
    key = lambda kind: F.concat(F.lit(kind), F.col("query").cast("string")).alias("query")
    asked = passages.select(key("p"), "question", "passage").unionByName(items.select(key("i"), "question", F.lit(None).cast("string").alias("passage")))
    found = cut(rop.bm25(docs, asked, "doc", "content", "query", "question", 40))
    featured = cut(rerank.placed(found, docs, rerank.questions(asked, "query", "question", rarity), asked))
    model = rerank.train_on(featured)
    rows = featured.where(F.col("query").startswith("i")).withColumn("query", F.expr("substring(query, 2)").cast(items.schema["query"].dataType))
    ranked = rerank.ranked(rows, model)
    return ranked.join(rows.select("query", "doc", F.col("rank").alias("rank_before")), ["query", "doc"]).select("query", "doc", F.round("score", 6).alias("score"), "rank", "rank_before")
