"""The queries of the operators and their DuckDB SQL, for the driver's entry file."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm._shared import shared_dir, table
from strataflow.llm.batch_views import batch_views, join_lifetimes
from strataflow.llm.chat_format import TOKENIZER, format_chats, read_back
from strataflow.llm.decontaminate import decontaminate
from strataflow.llm.filter_audit import audit_filters
from strataflow.llm.license_scan import scan_licenses
from strataflow.llm.line_dedup import dedup_lines
from strataflow.llm.mixing import mix_sources
from strataflow.llm.ngram_quality import perplexity_filter
from strataflow.llm.quality_rules import quality_rules
from strataflow.llm.simhash_dedup import near_duplicates
from strataflow.llm.substring_dedup import substring_dedup
from strataflow.llm.toxicity import learn, toxicity, training_rows
from strataflow.llm.warc import originals, read_archives, write_archives


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the conversation -1 that the contract adds: control strings inside texts
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    tokenizer = spark.conf.get("spark.strataflow.tokenizer", TOKENIZER)
    found = read_back(format_chats(turns.unionByName(added), tokenizer), tokenizer)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity_filter(table(spark, sf_dir, "documents"), trusted)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict", "ratio", "least_chunk_ratio", "largest_chunk_ratio")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "text", "n_lines", "n_removed")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, training_rows(table(spark, sf_dir, "labels")))
    # a null id has no label to hold out
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted", "hits")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = originals(read_archives(spark, path, payloads=False))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("original_id").alias("refers_to"))


def _lived(rows: DataFrame, kind: str, *key: str) -> DataFrame:
    """Rows with the batches [lo, hi) in which they are in their table."""
    h = F.crc32(F.concat_ws("", F.lit(kind), F.concat_ws(":", *[F.col(c).cast("string") for c in key])).cast("binary"))
    a, d = F.pmod(h, F.lit(3)).cast("int"), F.pmod(F.floor(h / 3), F.lit(3)).cast("int")
    return rows.withColumn("lo", F.when(a < d, a).otherwise(0)).withColumn("hi", F.when(a < d, d).otherwise(3))


def op13_batch_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region")).dropna()
    revenue = F.floor(100 * F.col("amount") + 0.5) * (100 - F.floor(100 * F.col("discount") + 0.5))
    lines = _lived(table(spark, sf_dir, "sale_lines"), "l", "sale_id", "line_no").where("amount is not null")
    lines = lines.select("sale_id", "item_id", "vendor_id", revenue.alias("revenue"), "lo", "hi").dropna(subset=["sale_id", "vendor_id"])
    sales = _lived(table(spark, sf_dir, "sales"), "s", "sale_id").select("sale_id", "client_id", F.unix_date(F.to_date("sold_at")).cast("long").alias("part"), "lo", "hi").dropna(subset=["sale_id", "part"])
    clients = _lived(table(spark, sf_dir, "clients"), "c", "client_id").select("client_id", "nation_id", "lo", "hi").join(regions, "nation_id").drop("nation_id")
    vendors = table(spark, sf_dir, "vendors").select("vendor_id", "nation_id", F.lit(0).alias("lo"), F.lit(3).alias("hi")).join(regions, "nation_id").drop("nation_id")
    sold = join_lifetimes(sales, clients, ["client_id"], counted=table(spark, sf_dir, "sales").select("client_id"))
    offered = join_lifetimes(lines, vendors, ["vendor_id"], counted=table(spark, sf_dir, "sale_lines").select("vendor_id")).drop("vendor_id")
    joined = join_lifetimes(offered, sold, ["sale_id", "region"], counted=table(spark, sf_dir, "sale_lines").select("sale_id"))
    found = batch_views(joined, ["region", "part"], 3, sums=["revenue"], mins=["revenue"], distinct=["client_id", "item_id"])
    return found.select("batch", "region", "part", F.col("n_rows").alias("n_lines"), F.col("sum_revenue").alias("revenue"), "min_revenue", F.col("distinct_client_id").alias("n_clients"), F.col("distinct_item_id").alias("n_items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_ngram_quality": op4_ngram_quality,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc_revisits": op12_warc_revisits,
    "op13_batch_views": op13_batch_views,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
        hw AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM win),
        least AS (SELECT h, min(doc_id) AS first_doc FROM hw GROUP BY h),
        hit AS (SELECT doc_id, p FROM hw JOIN least USING (h) WHERE first_doc < doc_id),
        gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM hit)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n
                 FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
                  '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'),
                  '[ROLE]', '[\ROLE]'), '[/ROLE]', '[\/ROLE]')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 24 + length(role) END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op3_decontaminate": r"""
        WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM iw),
        sizes AS (SELECT DISTINCT k FROM win),
        dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
        found AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM found)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        k AS (SELECT doc_id, i, trim(ln) AS x, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE trim(ln) <> ''),
        near AS (SELECT *, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3, lead(n) OVER o AS n2
                 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
        w AS (SELECT doc_id, s, s AS e, i AS a, i AS b, md5(x) AS r FROM near WHERE n >= 50
              UNION ALL SELECT doc_id, s, s + 1, i, i2, md5(x || chr(10) || x2) FROM near WHERE n + n2 >= 50
              UNION ALL SELECT doc_id, s, s + 2, i, i3, md5(x || chr(10) || x2 || chr(10) || x3) FROM near WHERE x3 IS NOT NULL),
        heads AS (SELECT r, min((doc_id, s)) AS head FROM w GROUP BY r),
        later AS (SELECT doc_id, s, e, a, b FROM w JOIN heads USING (r) WHERE (doc_id, s) > head),
        reached AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM later),
        marked AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM reached),
        gone AS (SELECT doc_id, min(a) AS first, max(b) AS last FROM marked GROUP BY doc_id, g),
        kept AS (SELECT l.doc_id, l.i, l.ln FROM l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND l.i BETWEEN first AND last)),
        rebuilt AS (SELECT doc_id, string_agg(ln, chr(10) ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id)
        SELECT d.doc_id, lang, source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
               CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(len(string_split(d.text, chr(10))) - coalesce(n, 0) AS BIGINT) AS n_removed
        FROM documents d LEFT JOIN rebuilt USING (doc_id)""",
    "op9_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols FROM documents),
        s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
        c AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM r),
        lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
               FROM c WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, rank, CAST(source_size AS BIGINT) AS source_size, least(cap, w * max(level) OVER ()) AS target FROM lv),
        k AS (SELECT d.doc_id, d.size, t.*, -ln((CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 1) / 4503599627370497.0)
                     / ((size + 1) / (size + symbols + 1.0)) AS key,
                     CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        b AS (SELECT *, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size) - size AS before FROM k),
        n AS (SELECT *, CASE WHEN source_size > 0 THEN epochs + CASE WHEN size > 0 AND epochs < 3 AND before * 2 + size <= rest * 2 THEN 1 ELSE 0 END ELSE 0 END AS copies FROM b)
        SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM n""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
        g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                      regexp_matches(text, '[#$%&*|]'), coalesce(first_id < w.doc_id, false)] AS fails FROM w LEFT JOIN g USING (doc_id)),
        k AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT o, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
        r AS (SELECT part, filter_order, step, o[step] AS f,
                     sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda x: fails[x]))) AS kept,
                     sum(CASE WHEN fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false) THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN fails[o[step]] AND coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false) THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN fails[o[step]] AND list_sum(list_transform(fails, lambda x: CAST(x AS INT))) = 1 THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false) THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])), false) THEN toxic ELSE 0 END) AS toxic_lost
              FROM k, s GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
    "op12_warc_revisits": r"""
        WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d),
        v AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT)) AS v FROM f)
        SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> s) & 31) + 1]), '')), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM v""",
    "op13_batch_views": r"""
        WITH k AS (SELECT 'l' AS t, concat('l', sale_id, ':', line_no) AS k FROM sale_lines UNION SELECT 's', concat('s', sale_id) FROM sales UNION SELECT 'c', concat('c', client_id) FROM clients),
        h AS (SELECT k, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                  lambda c, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT))) AS h FROM k),
        b AS (SELECT unnest([0, 1, 2]) AS batch),
        alive AS (SELECT k, batch FROM h, b WHERE CASE WHEN h % 3 < (h // 3) % 3 THEN h % 3 <= batch AND batch < (h // 3) % 3 ELSE true END),
        l AS (SELECT a.batch, x.*, CAST(floor(100 * amount + 0.5) AS BIGINT) * (100 - CAST(floor(100 * discount + 0.5) AS BIGINT)) AS r
              FROM sale_lines x JOIN alive a ON a.k = concat('l', sale_id, ':', line_no) WHERE amount IS NOT NULL),
        s AS (SELECT a.batch, x.*, CAST(date_diff('day', DATE '1970-01-01', CAST(sold_at AS DATE)) AS BIGINT) AS part FROM sales x JOIN alive a ON a.k = concat('s', sale_id) WHERE sold_at IS NOT NULL),
        c AS (SELECT a.batch, client_id, n_regionkey FROM clients x JOIN alive a ON a.k = concat('c', client_id) JOIN nation ON nation_id = n_nationkey),
        v AS (SELECT vendor_id, n_regionkey FROM vendors JOIN nation ON nation_id = n_nationkey)
        SELECT CAST(l.batch AS INTEGER) AS batch, CAST(c.n_regionkey AS INTEGER) AS region, part, count(*) AS n_lines, CAST(sum(r) AS BIGINT) AS revenue, CAST(min(r) AS BIGINT) AS min_revenue,
               count(DISTINCT c.client_id) AS n_clients, count(DISTINCT item_id) AS n_items
        FROM l JOIN s ON l.batch = s.batch AND l.sale_id = s.sale_id JOIN c ON c.batch = s.batch AND c.client_id = s.client_id
        JOIN v ON v.vendor_id = l.vendor_id AND v.n_regionkey = c.n_regionkey GROUP BY ALL""",
}
