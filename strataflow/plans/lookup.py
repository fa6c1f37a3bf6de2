"""Lookups over facts (line items), units (parts) and files; coverage and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflow.operators import lookup as op
from strataflow.plans.registry import query
from strataflow.sources import adapters as role
from strataflow.sources.adapters import table

_FACTS = """facts AS (SELECT l_orderkey * 100 + l_linenumber AS fact_id, 'M' || (l_suppkey % 10) || '/f' || l_suppkey AS file_path, 'cls' || (l_partkey % 5) || '.fn' || (l_partkey % 200) AS symbol,
    CASE l_linestatus WHEN 'F' THEN 'call' ELSE 'constant' END AS fact_type, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN l_suppkey % 4 = 0 THEN 'test' ELSE 'implementation' END AS role,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value, l_linenumber AS start_line FROM lineitem)"""


def facts(spark, d):
    t = lambda c: F.col(c).cast("string")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("fact_id"), F.concat(F.lit("M"), (F.col("l_suppkey") % 10).cast("string"), F.lit("/f"), t("l_suppkey")).alias("file_path"), F.concat(F.lit("cls"), (F.col("l_partkey") % 5).cast("string"), F.lit(".fn"), (F.col("l_partkey") % 200).cast("string")).alias("symbol"), F.when(F.col("l_linestatus") == "F", "call").otherwise("constant").alias("fact_type"), F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence"), F.when(F.col("l_suppkey") % 4 == 0, "test").otherwise("implementation").alias("role"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.col("l_linenumber").alias("start_line"))


@query("p1_query_facts", f"WITH {_FACTS} SELECT fact_id, symbol, confidence FROM facts WHERE fact_type = 'call' AND role <> 'test' AND value = '7' ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, file_path, start_line, fact_id LIMIT 50")
def p1_query_facts(spark, d):
    return op.query_facts(facts(spark, d), fact_type="call", value="7", exclude_roles=["test"], limit=50).select("fact_id", "symbol", "confidence")


@query("p2_symbol_predicate", f"WITH {_FACTS} SELECT symbol, count(*) AS n FROM facts WHERE symbol = 'FN7' OR lower(symbol) LIKE '%.fn7' GROUP BY symbol")
def p2_symbol_predicate(spark, d):
    return facts(spark, d).where(op.symbol_matches(F.col("symbol"), "FN7")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("p3_find_by_symbols", f"WITH {_FACTS} SELECT DISTINCT fact_id, symbol FROM facts WHERE symbol IN ('cls1.fn1', 'fn12', 'cls3.fn8') OR string_split(symbol, '.')[-1] IN ('cls1.fn1', 'fn12', 'cls3.fn8')")
def p3_find_by_symbols(spark, d):
    wanted = spark.range(1).select(F.explode(F.array(F.lit("cls1.fn1"), F.lit("fn12"), F.lit("cls3.fn8"))).alias("symbol"))
    return op.find_by_symbols(facts(spark, d), wanted).select("fact_id", "symbol").distinct()


@query("p4_search_by_symbol", f"WITH {_FACTS} SELECT fact_id FROM facts WHERE lower(symbol) = 'cls2.fn7' AND fact_type IN ('call', 'constant') ORDER BY file_path, start_line, fact_id LIMIT 20")
def p4_search_by_symbol(spark, d):
    return facts(spark, d).where(F.lower("symbol") == "CLS2.fn7".lower()).where(F.col("fact_type").isin("call", "constant")).orderBy("file_path", "start_line", "fact_id").limit(20).select("fact_id")


@query("p5_fragment_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY p_size DESC, p_partkey LIMIT 5")
def p5_fragment_search(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").contains("ring")).orderBy(F.col("p_size").desc(), "p_partkey").limit(5).select("p_partkey", "p_name")


@query("p6_units_by_type", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2' ORDER BY p_size, p_partkey LIMIT 25")
def p6_units_by_type(spark, d):
    return table(spark, d, "part").where((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#2")).orderBy("p_size", "p_partkey").limit(25).select("p_partkey")


_OCC = "CAST((length(t) - length(replace(t, '{0}', ''))) / {1} AS INTEGER)"


@query("p7_content_term_score", f"SELECT doc_id, {_OCC.format('tion', 4)} + {_OCC.format('the', 3)} AS score FROM (SELECT doc_id, lower(source || chr(10) || text) AS t FROM documents) WHERE contains(t, 'tion') OR contains(t, 'the') ORDER BY score DESC, doc_id LIMIT 20")
def p7_content_term_score(spark, d):
    return op.term_score(table(spark, d, "documents"), ["source", "text"], ["tion", "the"]).orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", "score")


@query("p8_list_indexes", "SELECT doc_id, source, lang, n_chars FROM documents")
def p8_list_indexes(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")


@query("p9_keyword_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache') OR contains(lower(text), 'gnu') OR contains(lower(source), 'src19') ORDER BY doc_id LIMIT 50")
def p9_keyword_search(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains("apache") | F.lower("text").contains("gnu") | F.lower("source").contains("src19")).orderBy("doc_id").limit(50).select("doc_id")


@query("s14_point_scan", "SELECT doc_id, n_chars FROM documents WHERE source = 'src7'")
def s14_point_scan(spark, d):
    return table(spark, d, "documents").where(F.col("source") == "src7").select("doc_id", "n_chars")


@query("s13_full_scan", "SELECT vec_id, label, len(embedding) AS width FROM embeddings")
def s13_full_scan(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("width"))


@query("t3_two_key_sort", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def t3_two_key_sort(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(25).select("c_custkey")


@query("t4_semantic_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 30")
def t4_semantic_sort(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return table(spark, d, "orders").orderBy(rank, F.col("o_totalprice").desc(), "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority")


@query("t6_two_phase_ranking", "WITH c AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, p LIMIT 50) SELECT p, n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM c JOIN lineitem ON l_partkey = p GROUP BY p, n ORDER BY qty DESC, p LIMIT 10")
def t6_two_phase_ranking(spark, d):
    items = table(spark, d, "lineitem")
    first = items.groupBy(F.col("l_partkey").alias("p")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p").limit(50)
    return items.join(F.broadcast(first), F.col("l_partkey") == F.col("p")).groupBy("p", "n").agg(F.sum("l_quantity").cast("long").alias("qty")).orderBy(F.col("qty").desc(), "p").limit(10)


@query("t9_mentioned_first", "SELECT doc_id, contains(lower(text), 'licens') AS mentioned FROM documents ORDER BY contains(lower(text), 'licens') DESC, doc_id LIMIT 25")
def t9_mentioned_first(spark, d):
    said = F.lower("text").contains("licens")
    return table(spark, d, "documents").select("doc_id", said.alias("mentioned")).orderBy(F.col("mentioned").desc(), "doc_id").limit(25)


@query("t2_top_reviewers", "SELECT o_custkey, round(avg(o_totalprice), 4) AS score FROM orders WHERE o_custkey <> 7 GROUP BY o_custkey ORDER BY round(avg(o_totalprice), 4) DESC, o_custkey LIMIT 3")
def t2_top_reviewers(spark, d):
    return table(spark, d, "orders").where("o_custkey <> 7").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("score")).orderBy(F.col("score").desc(), "o_custkey").limit(3)


@query("v26_fuzzy_symbols", "SELECT p_partkey AS id, p_name AS name, 0 AS tier FROM part WHERE lower(p_name) = 'red widget' ORDER BY p_name, p_partkey LIMIT 10")
def v26_fuzzy_symbols(spark, d):
    return op.fuzzy(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "Red Widget")


@query("v27_exact_lookup", "SELECT p_partkey, CASE WHEN p_name = 'Red widget' THEN 1.0 ELSE 0.95 END AS confidence FROM part WHERE lower(p_name) = 'red widget'")
def v27_exact_lookup(spark, d):
    return table(spark, d, "part").where(F.lower("p_name") == "red widget").select("p_partkey", F.when(F.col("p_name") == "Red widget", 1.0).otherwise(0.95).cast("decimal(3,2)").alias("confidence"))


@query("v28_concept_tokens", "SELECT p_partkey, least(0.9, (CAST(contains(p_name, 'red') AS INT) + CAST(contains(p_name, 'ring') AS INT)) / 2) AS confidence FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'ring')")
def v28_concept_tokens(spark, d):
    return op.concept_lookup(table(spark, d, "part").withColumnRenamed("p_name", "name"), ["red", "ring"]).select("p_partkey", "confidence")


@query("v29_concept_search", "WITH c AS (SELECT p_brand AS location, string_split(p_name, ' ')[2] AS concept, [string_split(p_name, ' ')[1]] AS synonyms, [lower(p_type)] AS related FROM part), s AS (SELECT location, concept, CASE WHEN lower(concept) = 'widget' THEN 1.0 WHEN list_contains(synonyms, 'widget') THEN 0.9 WHEN contains(lower(concept), 'widget') THEN 0.7 WHEN list_contains(related, 'widget') THEN 0.5 END AS score FROM c) SELECT location, max(score) AS score, first(concept ORDER BY score DESC, concept) AS concept FROM s WHERE score IS NOT NULL GROUP BY location")
def v29_concept_search(spark, d):
    words = F.split("p_name", " ")
    concepts = table(spark, d, "part").select(F.col("p_brand").alias("location"), words[1].alias("concept"), F.array(words[0]).alias("synonyms"), F.array(F.lower("p_type")).alias("related"))
    return op.concept_search(concepts, "widget").withColumn("score", F.col("score").cast("decimal(2,1)"))


@query("a32_count_by_type", f"WITH {_FACTS} SELECT fact_type, role, count(*) AS n FROM facts GROUP BY ALL")
def a32_count_by_type(spark, d):
    return facts(spark, d).groupBy("fact_type", "role").agg(F.count("*").alias("n"))


@query("a35_index_statistics", f"WITH {_FACTS} SELECT count(*) AS total, count(DISTINCT file_path) AS files, count(DISTINCT symbol) AS symbols FROM facts")
def a35_index_statistics(spark, d):
    return facts(spark, d).agg(F.count("*").alias("total"), F.count_distinct("file_path").alias("files"), F.count_distinct("symbol").alias("symbols"))


_STATUS = "CASE WHEN pct >= 90 THEN 'EXCELLENT' WHEN pct >= 75 THEN 'GOOD' WHEN pct >= 50 THEN 'WEAK' ELSE 'CRITICAL' END"
_COV = "cov AS (SELECT l_partkey AS file, count(*) FILTER (l_quantity >= 20) AS covered, count(*) AS total FROM lineitem GROUP BY 1)"


def _cov(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count_if(F.col("l_quantity") >= 20).alias("covered"), F.count("*").alias("total"))


@query("a19_statement_coverage", f"WITH {_COV}, p AS (SELECT file, covered * 100.0 / total AS pct FROM cov) SELECT file, round(pct, 6) AS pct, {_STATUS} AS status FROM p")
def a19_statement_coverage(spark, d):
    pct = F.col("covered") * 100.0 / F.col("total")
    return _cov(spark, d).select("file", F.round(pct, 6).alias("pct"), op.coverage_status(pct).alias("status"))


@query("a20_coverage_rollup", f"WITH {_COV}, p AS (SELECT p_brand AS subsystem, sum(covered) * 100.0 / sum(total) AS pct FROM cov JOIN part ON p_partkey = file GROUP BY 1) SELECT subsystem, round(pct, 6) AS pct, {_STATUS} AS status FROM p")
def a20_coverage_rollup(spark, d):
    rows = _cov(spark, d).join(table(spark, d, "part"), F.col("p_partkey") == F.col("file")).groupBy(F.col("p_brand").alias("subsystem")).agg((F.sum("covered") * 100.0 / F.sum("total")).alias("p"))
    return rows.select("subsystem", F.round("p", 6).alias("pct"), op.coverage_status(F.col("p")).alias("status"))


@query("r8_coverage_risk", f"WITH {_COV}, r AS (SELECT file, greatest(0.0, least(100.0, 0.5 * (100 - covered * 100.0 / total) + 0.25 * p_size + 0.25 * (p_size * 2))) AS risk FROM cov JOIN part ON p_partkey = file) SELECT file, round(risk, 6) AS risk, CASE WHEN risk >= 80 THEN 'CRITICAL' WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM r")
def r8_coverage_risk(spark, d):
    rows = _cov(spark, d).join(table(spark, d, "part"), F.col("p_partkey") == F.col("file")).withColumn("r", op.coverage_risk(F.col("covered") * 100.0 / F.col("total"), F.col("p_size"), F.col("p_size") * 2))
    return rows.select("file", F.round("r", 6).alias("risk"), F.when(F.col("r") >= 80, "CRITICAL").when(F.col("r") >= 60, "HIGH").when(F.col("r") >= 30, "MEDIUM").otherwise("LOW").alias("band"))


@query("j17_min_timestamp_update", "SELECT c_custkey, coalesce(CAST(min(o_orderdate) AS DATE), DATE '1970-01-01') AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j17_min_timestamp_update(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("f"))
    return table(spark, d, "customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("f", F.lit("1970-01-01").cast("date")).alias("first_order"))


@query("j21_reconcile", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'add' WHEN a.k IS NULL THEN 'remove' ELSE 'check' END AS action FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40) b ON a.k = b.k")
def j21_reconcile(spark, d):
    items = table(spark, d, "lineitem")
    a, b = items.where("l_returnflag = 'A' AND l_quantity > 40").select(F.col("l_partkey").alias("a")).distinct(), items.where("l_returnflag = 'N' AND l_quantity > 40").select(F.col("l_partkey").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("k"), F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "remove").otherwise("check").alias("action"))


@query("j7_external_edges", role.with_("adr_links") + ", e AS (SELECT DISTINCT l_orderkey, 'm' || (l_partkey % 20) || '/p' || l_partkey AS path FROM lineitem) SELECT count(*) FILTER (adr_id IS NULL) AS ungoverned, count(*) FILTER (adr_id IS NOT NULL AND adr_id <> 'ADR-3') AS foreign_files FROM e LEFT JOIN adr_links ON node_id = path")
def j7_external_edges(spark, d):
    path = F.concat(F.lit("m"), (F.col("l_partkey") % 20).cast("string"), F.lit("/p"), F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", path.alias("path")).distinct().join(role.adr_links(spark, d), F.col("node_id") == F.col("path"), "left")
    return rows.agg(F.count_if(F.col("adr_id").isNull()).alias("ungoverned"), F.count_if(F.col("adr_id") != "ADR-3").alias("foreign_files"))


@query("n10_advisory_risk", "WITH f AS (SELECT l_suppkey AS unit, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT unit, sum(n) AS dependents, max(n) AS top, count(*) AS files FROM f GROUP BY unit) SELECT unit, CAST(dependents * top * files AS BIGINT) AS score, CASE WHEN dependents * top * files >= 200 THEN 'CRITICAL' WHEN dependents * top * files >= 50 THEN 'HIGH' WHEN dependents * top * files >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s")
def n10_advisory_risk(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), "l_partkey").agg(F.count("*").alias("n")).groupBy("unit").agg((F.sum("n") * F.max("n") * F.count("*")).alias("score"))
    return rows.withColumn("band", F.when(F.col("score") >= 200, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 10, "MEDIUM").otherwise("LOW"))


@query("n1_lexical_map", "SELECT lower(string_split(p_name, ' ')[1]) AS name, count(*) AS n, list_sort(list(p_partkey)) AS ids FROM part GROUP BY 1")
def n1_lexical_map(spark, d):
    return table(spark, d, "part").groupBy(F.lower(F.split("p_name", " ")[0]).alias("name")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p_partkey")).alias("ids"))


@query("n7_confidence_report", "SELECT o_orderpriority AS artifact, o_orderstatus AS field, round(avg(o_totalprice / 500000), 6) AS mean, round(min(o_totalprice / 500000), 6) AS low, round(max(o_totalprice / 500000), 6) AS high, count(*) FILTER (o_totalprice < 250000) AS weak FROM orders GROUP BY ALL")
def n7_confidence_report(spark, d):
    c = F.col("o_totalprice") / 500000
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("artifact"), F.col("o_orderstatus").alias("field")).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.min(c), 6).alias("low"), F.round(F.max(c), 6).alias("high"), F.count_if(F.col("o_totalprice") < 250000).alias("weak"))


@query("n18_governing_decisions", role.with_("adr_links") + " SELECT adr_id, node_id, score FROM adr_links QUALIFY row_number() OVER (PARTITION BY adr_id ORDER BY score DESC, node_id) <= 5")
def n18_governing_decisions(spark, d):
    rank = F.row_number().over(Window.partitionBy("adr_id").orderBy(F.col("score").desc(), "node_id"))
    return role.adr_links(spark, d).withColumn("rn", rank).where("rn <= 5").select("adr_id", "node_id", "score")


@query("n19_commits_for_file", role.with_("commits", "commit_files") + " SELECT DISTINCT path, sha, CAST(ts AS DATE) AS day FROM commit_files JOIN commits USING (sha) WHERE path IN ('m1/p1', 'm7/p27')")
def n19_commits_for_file(spark, d):
    return role.commit_files(spark, d).where(F.col("path").isin("m1/p1", "m7/p27")).join(role.commits(spark, d), "sha").select("path", "sha", F.col("ts").cast("date").alias("day")).distinct()


@query("j18_token_links", "WITH a AS (SELECT p_brand AS adr, lower(w) AS token FROM (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)), n AS (SELECT p_partkey AS node, lower(unnest(string_split(p_name, ' '))) AS token FROM part), s AS (SELECT adr, node, count(DISTINCT a.token) * 5 AS score FROM a JOIN n ON a.token = n.token GROUP BY ALL) SELECT adr, node, score, least(1.0, score / 20) AS confidence FROM s WHERE score >= 5")
def j18_token_links(spark, d):
    part = table(spark, d, "part")
    tokens = lambda c, name: part.select(F.col(c).alias(name), F.explode(F.split("p_name", " ")).alias("w")).select(name, F.lower("w").alias("token"))
    return op.token_links(tokens("p_brand", "adr"), tokens("p_partkey", "node"))
