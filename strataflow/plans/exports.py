"""Queries of traces, exports and change capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import runtime as rt
from strataflow.plans.registry import query
from strataflow.sources import traces as op
from strataflow.sources.roles import role, with_

_OUT = "source_path, source_symbol, target_path, target_symbol, format, confidence"


def _shown(df):
    return df.withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))


@query("s9_manual_calls", with_("manual_traces") + r""", c AS (SELECT unnest(CAST(json_extract(content, '$.calls[*]') AS JSON[])) AS c FROM manual_traces WHERE json_valid(content)), e AS (SELECT json_extract_string(c, '$.caller') AS a, json_extract_string(c, '$.callee') AS b FROM c)
    SELECT CASE WHEN contains(a, ':') THEN regexp_replace(string_split(a, ':')[1], '^\./', '') END AS source_path, string_split(a, ':')[-1] AS source_symbol, CASE WHEN contains(b, ':') THEN regexp_replace(string_split(b, ':')[1], '^\./', '') END AS target_path, string_split(b, ':')[-1] AS target_symbol, 'manual' AS format, 0.95 AS confidence FROM e""")
def s9_manual_calls(spark, d):
    return _shown(op.manual_calls(role(spark, d, "manual_traces")))


@query("s9_test_reports", with_("test_reports") + r""", t AS (SELECT file, unnest(CAST(json_extract(content, '$.tests[*]') AS JSON[])) AS t FROM test_reports WHERE json_valid(content)), o AS (SELECT file, string_split(json_extract_string(t, '$.nodeid'), '::')[1] AS p, string_split(json_extract_string(t, '$.nodeid'), '::')[-1] AS s, json_extract_string(t, '$.outcome') AS outcome, json_extract(t, '$.call') AS call FROM t),
    f AS (SELECT file, p, s, unnest(CAST(json_extract(call, '$.traceback[*]') AS JSON[])) AS f, unnest(range(len(CAST(json_extract(call, '$.traceback[*]') AS JSON[])))) AS k FROM o WHERE call IS NOT NULL), g AS (SELECT file, p, s, k, coalesce(json_extract_string(f, '$.path'), json_extract_string(f, '$.file')) AS tp, coalesce(json_extract_string(f, '$.name'), json_extract_string(f, '$.function')) AS ts FROM f)
    SELECT CASE WHEN k = 0 THEN p ELSE lag(tp) OVER w END AS source_path, CASE WHEN k = 0 THEN s ELSE lag(ts) OVER w END AS source_symbol, tp AS target_path, ts AS target_symbol, 'pytest' AS format, 0.80 AS confidence FROM g WINDOW w AS (PARTITION BY file, p, s ORDER BY k)
    UNION ALL SELECT p, s, json_extract_string(call, '$.crash.path'), string_split(json_extract_string(call, '$.crash.message'), ':')[1], 'pytest', 0.70 FROM o WHERE outcome = 'failed'""")
def s9_test_reports(spark, d):
    return _shown(op.pytest_reports(role(spark, d, "test_reports")))


@query("s9_test_outputs", with_("test_outputs") + r""", m AS (SELECT file, unnest(regexp_extract_all(content, 'File "([^"]+)", line (\d+), in ([A-Za-z_][\w.]*)', 1)) AS p, unnest(regexp_extract_all(content, 'File "([^"]+)", line (\d+), in ([A-Za-z_][\w.]*)', 3)) AS s, unnest(range(3)) AS k FROM test_outputs),
    c AS (SELECT *, lag(p) OVER (PARTITION BY file ORDER BY k) AS a, lag(s) OVER (PARTITION BY file ORDER BY k) AS b FROM m), l AS (SELECT file, max_by(p, k) AS p, max_by(s, k) AS s FROM m GROUP BY file)
    SELECT a AS source_path, b AS source_symbol, p AS target_path, s AS target_symbol, 'pytest' AS format, 0.75 AS confidence FROM c WHERE NOT starts_with(s, 'test_') UNION ALL SELECT p, s, NULL, regexp_extract(content, '(?m)^\s*([A-Za-z_][\w.]*(?:Error|Exception))\b', 1), 'pytest', 0.65 FROM test_outputs JOIN l USING (file)""")
def s9_test_outputs(spark, d):
    return _shown(op.pytest_text(role(spark, d, "test_outputs")))


@query("s9_coverage_lines", with_("coverage_reports") + r""", k AS (SELECT content, unnest(json_keys(content, '$.files')) AS p FROM coverage_reports), l AS (SELECT p, unnest(CAST(json_extract(content, '$.files."' || p || '".executed_lines') AS INT[])) AS line FROM k) SELECT regexp_replace(p, '^\./', '') AS path, list_sort(list(DISTINCT line)) AS lines FROM l GROUP BY 1""")
def s9_coverage_lines(spark, d):
    return op.coverage_lines(role(spark, d, "coverage_reports"))


@query("s9_spans", with_("span_exports") + r""", s AS (SELECT file, unnest(CAST(json_extract(content, '$.spans[*]') AS JSON[])) AS s FROM span_exports), o AS (SELECT file, json_extract_string(s, '$.spanId') AS id, json_extract_string(s, '$.parentSpanId') AS up, json_extract_string(s, '$.attributes[0].value.stringValue') AS p, coalesce(json_extract_string(s, '$.attributes[1].value.stringValue'), json_extract_string(s, '$.name')) AS n FROM s)
    SELECT a.p AS source_path, a.n AS source_symbol, b.p AS target_path, b.n AS target_symbol, 'otel' AS format, 0.85 AS confidence FROM o b JOIN o a ON a.file = b.file AND a.id = b.up""")
def s9_spans(spark, d):
    return _shown(op.spans(role(spark, d, "span_exports")))


_KNOWN = "known AS (SELECT DISTINCT 'src/' || (doc % 5) || '.py' AS path, name FROM symbols)"


def _known(spark, d):
    return role(spark, d, "symbols").select(F.concat(F.lit("src/"), (F.col("doc") % 5).cast("string"), F.lit(".py")).alias("path"), "name")


@query("s9_log_lines", with_("app_logs", "symbols") + f", {_KNOWN} SELECT NULL::VARCHAR AS source_path, 'log_entry' AS source_symbol, path AS target_path, name AS target_symbol, 'log' AS format, 0.55 AS confidence FROM known WHERE length(name) >= 4 AND EXISTS (SELECT 1 FROM app_logs WHERE regexp_matches(content, '\\b' || name || '\\b'))")
def s9_log_lines(spark, d):
    return _shown(op.log_lines(role(spark, d, "app_logs"), _known(spark, d)))


@query("s6_pull_requests", with_("pull_exports") + """, p AS (SELECT json_extract_string(content, '$.id') AS id, json_extract_string(content, '$.title') AS title, json_extract_string(content, '$.author') AS author, CAST(replace(replace(json_extract_string(content, '$.updated_at'), 'T', ' '), 'Z', '') AS TIMESTAMP) AS at_, len(CAST(json_extract(content, '$.files[*]') AS JSON[])) AS n_files FROM pull_exports)
    SELECT id, title, author, CAST(at_ AS DATE) AS updated, n_files FROM p WHERE at_ > TIMESTAMP '1997-01-01 00:00:00' QUALIFY row_number() OVER (PARTITION BY id ORDER BY at_ DESC, title) = 1""")
def s6_pull_requests(spark, d):
    found = op.pull_requests(role(spark, d, "pull_exports"), "1997-01-01 00:00:00")
    return found.select("id", "title", "author", F.col("updated_at").cast("date").alias("updated"), F.size("files").alias("n_files"))


@query("s16_terminal_errors", with_("terminal_errors") + """, t AS (SELECT cwd, "at" AS at_, command, exit_code, output FROM terminal_errors) SELECT cwd, CASE WHEN command = '' THEN '(unknown command)' ELSE command END AS command, exit_code, regexp_replace(output, chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') AS output FROM t QUALIFY row_number() OVER (PARTITION BY cwd ORDER BY at_ DESC, command) <= 10""")
def s16_terminal_errors(spark, d):
    return op.terminal_ring(role(spark, d, "terminal_errors")).drop("at")


@query("s7_decision_records", with_("decision_files") + r" SELECT upper(regexp_extract(file, '(adr-\d+)', 1)) AS id, regexp_extract(content, '(?m)^# (.+)$', 1) AS title, upper(regexp_extract(content, '## Status\n(\w+)', 1)) AS status, regexp_extract(content, '## Context\n([^\n]*)', 1) AS context, 'Take it' AS decision, 'None' AS consequences, sha256(content) AS hash FROM decision_files")
def s7_decision_records(spark, d):
    return op.decision_sections(role(spark, d, "decision_files"))


@query("s7_changed_decisions", with_("decision_files", "decision_files_before") + r", a AS (SELECT upper(regexp_extract(file, '(adr-\d+)', 1)) AS id, content FROM decision_files), b AS (SELECT upper(regexp_extract(file, '(adr-\d+)', 1)) AS id, content FROM decision_files_before) SELECT id, CASE WHEN b.content IS NULL THEN 'new' WHEN a.content IS NULL THEN 'removed' WHEN a.content = b.content THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (id)")
def s7_changed_decisions(spark, d):
    return op.compared(op.decision_sections(role(spark, d, "decision_files")), op.decision_sections(role(spark, d, "decision_files_before")))


@query("s8_runtime_log", with_("runtime_log_lines") + """, m AS (SELECT file, json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.repository_commit_hash') AS h FROM runtime_log_lines WHERE line = 1), e AS (SELECT file, CASE WHEN json_valid(value) THEN value END AS value FROM runtime_log_lines WHERE line > 1)
    SELECT file, json_extract_string(value, '$.event_id') AS event_id, json_extract_string(value, '$.component_id') AS component_id, json_extract_string(value, '$.event_type') AS event_type, upper(json_extract_string(value, '$.severity')) AS severity, h AS repository_commit_hash FROM e JOIN m USING (file) WHERE h IS NOT NULL AND upper(json_extract_string(value, '$.severity')) IN ('INFO', 'WARNING', 'ERROR', 'CRITICAL')""")
def s8_runtime_log(spark, d):
    return op.runtime_lines(role(spark, d, "runtime_log_lines"))


@query("s5_incremental_sync", with_("sync_state", "commit_times") + """, c AS (SELECT sha, "at" AS at_ FROM commit_times) SELECT sha FROM c WHERE at_ > (SELECT mark FROM sync_state WHERE stream = 'commits')""")
def s5_incremental_sync(spark, d):
    return op.synced(role(spark, d, "commit_times"), role(spark, d, "sync_state"), "commits", "at")[0].select("sha")


@query("s5_sync_state", with_("sync_state", "commit_times") + """, c AS (SELECT sha, "at" AS at_ FROM commit_times) SELECT stream, CAST(max(mark) AS DATE) AS mark FROM (SELECT * FROM sync_state UNION ALL SELECT 'commits', max(at_) FROM c) GROUP BY stream""")
def s5_sync_state(spark, d):
    return op.synced(role(spark, d, "commit_times"), role(spark, d, "sync_state"), "commits", "at")[1].withColumn("mark", F.col("mark").cast("date"))


@query("k4_sealed_segments", with_("segment_docs", "segment_deletes") + """, p AS (SELECT *, (row_number() OVER (ORDER BY seq, id) - 1) // 500 AS segment, seq = max(seq) OVER (PARTITION BY id) AS newest FROM segment_docs), x AS (SELECT id, max(seq) AS dead FROM segment_deletes GROUP BY id)
    SELECT segment, count(*) = 500 AS sealed, count(*) AS docs, count(*) FILTER (newest AND (dead IS NULL OR seq > dead)) AS live FROM p LEFT JOIN x USING (id) GROUP BY segment""")
def k4_sealed_segments(spark, d):
    return op.segments(role(spark, d, "segment_docs"), role(spark, d, "segment_deletes"))


_BURSTS = """, e AS (SELECT file, "at" AS at_, seq, kind FROM file_events), b AS (SELECT *, CASE WHEN at_ - lag(at_) OVER w < INTERVAL {0} SECONDS THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY file ORDER BY at_, seq)), g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY at_, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM b)"""


@query("x1_debounced_changes", with_("file_events") + _BURSTS.format(7200) + " SELECT file, max_by(kind, (at_, seq)) AS kind, epoch_us(max(at_)) AS at_us, count(*) AS n FROM g GROUP BY file, burst")
def x1_debounced_changes(spark, d):
    # events of the tables lie minutes apart, so a burst here is two hours
    found = rt.debounced_changes(role(spark, d, "file_events"), 7200)
    return found.select("file", "kind", F.unix_micros("at").alias("at_us"), "n")


@query("x2_reconcile_runs", "WITH RECURSIVE " + (with_("file_events") + _BURSTS.format(3600)).removeprefix("WITH ") + """, d AS (SELECT file AS repository, epoch_us(max(at_)) + 3600000000 AS due, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY max(at_)) AS k FROM g GROUP BY file, burst),
    r AS (SELECT repository, k, due AS start, n, 1 AS run FROM d WHERE k = 1 UNION ALL SELECT d.repository, d.k, CASE WHEN r.start > d.due THEN r.start ELSE greatest(d.due, r.start + 18000000000) END, d.n, CASE WHEN r.start > d.due THEN r.run ELSE r.run + 1 END FROM r JOIN d ON d.repository = r.repository AND d.k = r.k + 1)
    SELECT repository, start AS start_us, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY repository, run, start""")
def x2_reconcile_runs(spark, d):
    found = rt.reconcile_runs(role(spark, d, "file_events").select(F.col("file").alias("repository"), "at"), 3600, 18000)
    return found.select("repository", F.unix_micros("start").alias("start_us"), "n")
