"""Operators on hand-checked fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataflow.functions import text as fn
from strataflow.operators import graph, history, memory, retrieval, runtime, snapshots
from strataflow.sources import readers


def at(day):
    return dt.datetime(2023, 1, day)


def test_coupling_of_small_history(spark):
    files = [("c1", "A.ts"), ("c1", "B.ts"), ("c2", "A.ts"), ("c2", "B.ts"), ("c2", "C.ts"), ("c3", "A.ts"), ("c3", "package-lock.json"), *[("big", f"f{i}") for i in range(51)]]
    commit_files = spark.createDataFrame([(s, p, "MODIFY") for s, p in files], "sha string, path string, change_type string")
    commits = spark.createDataFrame([("c1", at(1)), ("c2", at(2)), ("c3", at(3)), ("big", at(1))], "sha string, ts timestamp")
    edges = history.logical_coupling(commit_files, commits).collect()
    assert [(e.source_path, e.target_path, e.co_change_count) for e in edges] == [("A.ts", "B.ts", 2)]
    assert edges[0].confidence == pytest.approx(2 / 3)
    changes = history.small_groups(history.source_changes(commit_files), 50)
    assert {r.path: r.change_count for r in history.file_change_stats(changes, commits).collect()} == {"A.ts": 3, "B.ts": 2, "C.ts": 1}
    assert {r.sha for r in history.coupling_evidence(commit_files, commits).collect()} == {"c1", "c2"}


def test_expertise_caps_a_file(spark):
    files = spark.createDataFrame([("alice", "auth/a", 500.0, 500, 0.0)] + [("bob", f"auth/{x}", 20.0, 20, 0.0) for x in "abcd"], "author_email string, entity_id string, expertise_score double, contribution_count long, knowledge_age_days double")
    links = spark.createDataFrame([("ADR-12", f"auth/{x}") for x in "abcd"], "adr_id string, node_id string")
    found = {r.author_email: (r.expertise_score, r.coverage) for r in history.adr_expertise(files, links).collect()}
    assert found == {"alice": (10.0, 0.25), "bob": (40.0, 1.0)}


def test_baseline_pads_thirty_days(spark):
    events = spark.createDataFrame([(i, "svc", "TIMEOUT", dt.datetime(2024, 1, 20, 1)) for i in range(5)], "event_id long, component_id string, event_type string, ts timestamp_ntz")
    row = runtime.baselines(events, "2024-01-31 00:00:00").first()
    assert row["mean"] == pytest.approx(5 / 30) and row["variance"] == pytest.approx(25 / 30 - (5 / 30) ** 2)


def test_calibration_modes(spark):
    of = lambda rows: {r.event_type: r for r in runtime.calibration(spark.createDataFrame(rows, "event_type string, n long")).collect()}
    assert of([("OOM", 30)])["OOM"].mode == "CALIBRATED" and of([("OOM", 30)])["OOM"].confidence == pytest.approx(0.6)
    assert 0.5 < of([("OOM", 30)])["OOM"].weight < 1 and 0 < of([("OOM", 30)])["TIMEOUT"].weight < 0.2
    assert of([("OOM", 9), ("CRASH", 9), ("TIMEOUT", 9), ("DEADLOCK", 8)])["OOM"].confidence == pytest.approx(1.0)
    assert of([("OOM", 8), ("CRASH", 7)])["OOM"].mode == "WARM"
    assert of([("OOM", 1)])["OOM"].mode == "COLD"


def test_temporal_dependency_and_macro_event(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, f"c{i}", base + dt.timedelta(seconds=i)) for i in range(5)]
    for k in range(3):
        rows += [(10 + 2 * k, "gateway", base + dt.timedelta(hours=1, seconds=100 * k)), (11 + 2 * k, "service", base + dt.timedelta(hours=1, seconds=100 * k + 5))]
    events = spark.createDataFrame(rows, "event_id long, component_id string, ts timestamp_ntz")
    found = runtime.temporal_pairs(runtime.debounced(events)).collect()
    assert [(r.source, r.target, r.observations, r.confidence) for r in found] == [("service", "gateway", 3, 0.6)]


def test_blast_radius_unions_sources(spark):
    edges = spark.createDataFrame([("x", "a", 1.0, 1.0), ("x", "b", 1.0, 1.0), ("y", "x", 1.0, 1.0)], "source string, target string, confidence double, factor double")
    failing = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "component_id string, risk double")
    found = {r.component_id: r.blast_risk for r in runtime.blast_radius(edges, failing).collect()}
    assert found["x"] == pytest.approx(0.75) and found["y"] == pytest.approx(1 - (1 - 0.425) ** 2, abs=1e-3)


def test_coverage_bitmap(spark):
    df = spark.createDataFrame([(bytearray([0b00000101, 0b10000000]),), (bytearray(),)], "b binary")
    assert [r[0] for r in df.select(runtime.covered_lines(F.col("b"))).collect()] == [[1, 3, 16], []]


def test_dependents_by_depth(spark):
    edges = spark.createDataFrame([("B", "A", "calls"), ("C", "B", "calls")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("A",)], "node string")
    assert {(r.node, r.depth) for r in graph.bfs(graph.reversed_(edges), seeds).collect()} == {("B", 1), ("C", 2)}
    assert graph.shortest_path(edges, "C", "A").first()["path"] == ["C", "B", "A"]
    assert graph.shortest_path(edges, "A", "C").count() == 0


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "d", 3.0)], "src string, dst string, weight double")
    ranks = {r.node: r.score for r in graph.pagerank(edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0, abs=1e-6)


def test_cycle_stays_out_of_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {(r.node, r.level) for r in graph.topological_levels(edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_interleave_takes_an_id_once(spark):
    rows = spark.createDataFrame([(0, 1, 10), (1, 1, 20), (1, 2, 10), (1, 3, 21)], "provider_no int, pos int, id long")
    assert [r.id for r in retrieval.interleaved(rows, 10).orderBy("pos", "provider_no").collect()] == [10, 20, 21]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 3.0, 400), (1, 2, 2.0, 4000), (1, 3, 1.0, 400)], "query int, id long, score double, chars long")
    assert [r.id for r in retrieval.packed(rows, "query", 250).collect()] == [1, 3]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_first_wins_last_wins_and_tombstones(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(snapshots.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(snapshots.insert_or_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    written, dead = spark.createDataFrame([(1, 1), (2, 5)], "k int, seq int"), spark.createDataFrame([(1, 3), (2, 3)], "k int, seq int")
    assert rows(snapshots.without_tombstones(written, dead, ["k"])) == [(2, 5)]


def test_range_join_needs_no_cartesian_product(spark):
    rows = spark.range(50).select(F.col("id"), F.timestamp_seconds(F.col("id") * 40000).alias("t"))
    joined = snapshots.range_pairs(rows, rows.select(F.col("id").alias("other"), F.col("t").alias("u")), "t", "u", 2)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    expected = sum(1 for a in range(50) for b in range(50) if 0 <= (b - a) * 40000 <= 2 * 86400)
    assert joined.count() == expected


def test_range_counts_make_no_pairs(spark):
    """Days at the edge count, several rows of a key and of a time count each, null times do not; 4,000 rows of one time meet 300 windows without 1,200,000 pairs."""
    left = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-05 00:00:01"), (3, None), (4, "2020-01-01 00:00:00")], "id long, s string").withColumn("t", F.col("s").cast("timestamp"))
    right = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-03 00:00:00",), ("2024-01-03 00:00:00",), ("2024-01-04 00:00:00",), ("2024-01-05 00:00:00",), (None,)], "s string").select(F.col("s").cast("timestamp").alias("u"))
    assert {(r.id, r.n) for r in snapshots.range_counts(left, right, "id", "t", "u", 2).collect()} == {(1, 3 + 3)}
    many = spark.range(4000).select(F.timestamp_seconds(F.lit(10**9)).alias("u"))
    asked = spark.range(300).select("id", F.timestamp_seconds(F.lit(10**9) - F.col("id")).alias("t"))
    found = snapshots.range_counts(asked, many, "id", "t", "u", 2)
    assert {(r.id, r.n) for r in found.collect()} == {(i, 4000) for i in range(300)}


def test_notes_that_say_the_same(spark):
    notes = spark.createDataFrame([(2, "Use Retries!", ["a"]), (1, "use-retries", ["b"]), (3, "other", [])], "id int, content string, tags array<string>")
    assert sorted((r.id, r.tags, r.n) for r in memory.dedupe(notes).collect()) == [(1, ["a", "b"], 2), (3, [], 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("getUserName", "a/tests/x.py", "\x1b[31mred\x1b[0m", "A=1\nexport B = 2 3\nplain")], "n string, p string, a string, e string")
    row = df.select(fn.snake(F.col("n")).alias("s"), fn.pascal(F.col("n")).alias("p"), fn.file_role(F.col("p")).alias("r"), fn.language(F.col("p")).alias("l"), fn.strip_ansi(F.col("a")).alias("a"), fn.redact_dotenv(F.col("e")).alias("e")).first()
    assert (row.s, row.p, row.r, row.l, row.a) == ("get_user_name", "GetUserName", "test", "python", "red")
    assert row.e == "A=<redacted>\nexport B =<redacted>\nplain"


def test_sources(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/node_modules").mkdir()
    (tmp_path / "repo/src/a.py").write_text("x = 1")
    (tmp_path / "repo/app.env").write_text("KEY=secret")
    (tmp_path / "repo/node_modules/b.py").write_text("y")
    found = {r.path: (r.language, r.text) for r in readers.walk(spark, str(tmp_path / "repo"), ["py"]).collect()}
    assert found == {"src/a.py": ("python", "x = 1"), "app.env": ("unknown", "KEY=<redacted>")}

    # as git prints it with GIT_FORMAT, --raw, --numstat and --no-abbrev
    log = "\x1ec2\x1fbob@x\x1f2023-01-02T10:00:00+00:00\x1fp1 p2\x1fsecond\n\n:100644 100644 aaa bbb M\tsrc/a.py\n:100644 100644 aaa bbb R090\told/n.py\tsrc/n.py\n5\t1\tsrc/a.py\n0\t0\t{old => src}/n.py\n"
    log += "\x1ec1\x1fann@x\x1f2023-01-01T10:00:00+00:00\x1fp0\x1ffirst\n\n:000000 100644 000 bbb A\tsrc/a.py\n:100644 000000 aaa 000 D\told.py\n3\t0\tsrc/a.py\n-\t-\told.py\n"
    (tmp_path / "log.txt").write_text(log)
    commits, files = readers.change_log(spark, str(tmp_path / "log.txt"))
    assert sorted((r.sha, r.n_parents) for r in commits.collect()) == [("c1", 1), ("c2", 2)]
    assert sorted((r.sha, r.path, r.change_type, r.added, r.deleted) for r in files.collect()) == [("c1", "old.py", "DELETE", None, None), ("c1", "src/a.py", "ADD", 3, 0), ("c2", "src/a.py", "MODIFY", 5, 1), ("c2", "src/n.py", "MODIFY", 0, 0)]
    assert commits.where("sha = 'c1'").first().subject == "first"
    assert [r.sha for r in readers.change_log(spark, str(tmp_path / "log.txt"), since="2023-01-01 12:00:00")[0].collect()] == ["c2"]

    (tmp_path / "adr-007.md").write_text("# Use queues\nStatus: Accepted\nDate: 2023-04-05\nSee `src/a.py`.")
    adr = readers.decision_records(spark, str(tmp_path / "adr-007.md")).first()
    assert (adr.id, adr.title, adr.status, str(adr.created_at), adr.files) == ("ADR-007", "Use queues", "ACCEPTED", "2023-04-05", ["src/a.py"])

    (tmp_path / "rt.jsonl").write_text('{"manifest": {"repository_commit_hash": "h1"}}\n{"event_id": "1", "component_id": "a", "event_type": "OOM", "severity": "error", "timestamp": "2024-01-01T00:00:00Z"}\n{"event_id": "2", "severity": "LOUD"}\nnot json\n')
    assert [(r.event_id, r.repository_commit_hash) for r in readers.runtime_log(spark, str(tmp_path / "rt.jsonl")).collect()] == [("1", "h1")]
    (tmp_path / "none.jsonl").write_text('{"event_id": "1", "severity": "ERROR"}\n')
    assert readers.runtime_log(spark, str(tmp_path / "none.jsonl")).count() == 0

    (tmp_path / "cov.json").write_text('{"a.ts": {"s": {"0": 1, "1": 0}}, "b.ts": {"s": {"0": 2}}}')
    assert sorted((r.path, r.covered, r.total) for r in readers.coverage_report(spark, str(tmp_path / "cov.json")).collect()) == [("a.ts", 1, 2), ("b.ts", 1, 1)]

    (tmp_path / "spans.json").write_text('{"traceId": "t", "spanId": "1", "service": "web"}\n{"traceId": "t", "spanId": "2", "parentSpanId": "1", "service": "db"}\n')
    assert [(r.source, r.target, r.observed) for r in readers.trace_edges(spark, str(tmp_path / "spans.json")).collect()] == [("web", "db", 1)]


def test_question_types_of_typical_questions(spark):
    from strataflow.functions import questions

    asked = {
        "What is the confidence threshold?": "threshold", "How many providers are there?": "list_count", "What is the fallback when the model fails?": "fallback_chain", "Where should I start as a new developer?": "onboarding_analysis", "Where is the parser defined?": "symbol_location",
        "Which services does the constructor take?": "dependency_injection", "Show the system prompt": "prompt_template", "Which env is read?": "config_surface", "Give the value of TIMEOUT": "exact_constant", "Describe the folder layout": "architecture_analysis", "How risky is changing the store?": "change_impact_prediction",
        "Any technical debt?": "refactoring_analysis", "What depends on the index?": "impact_analysis", "What is the blast radius of Store?": "impact_analysis", "Explain the router": "behavior_explanation", "Which mock covers it": "test_query", "Can I trust the scores": "prediction_accountability", "List degraded runtime parts": "runtime_intelligence", "Hello": "unknown",
    }
    df = spark.createDataFrame(list(asked.items()), "q string, t string")
    assert [(r.q, r.k) for r in df.select("q", "t", questions.question_type(F.col("q")).alias("k")).collect() if r.k != r.t] == []
    scores = {r.q: r.s for r in spark.createDataFrame([("where is main",), ("How does the retrieval pipeline interact with the memory store and why?",)], "q string").select("q", questions.complexity(F.col("q")).alias("s")).collect()}
    assert scores["where is main"] < 2 <= scores["How does the retrieval pipeline interact with the memory store and why?"]


def test_ignore_patterns(spark):
    paths = ["a/node_modules/x.js", "node_modules", "src/x.min.js", "src/gen/a.py", "keep/gen.py", "build/keep.txt", "logs/a.log", "logs/keep.log", "docs/a/b/c.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p for r in df.where(fn.ignored(F.col("p"), ["node_modules", "*.min.js", "src/gen/**"])).collect()}
    assert got == {"a/node_modules/x.js", "node_modules", "src/x.min.js", "src/gen/a.py"}
    lines = ["# comment", "", "build/", "!build/keep.txt", "*.log", "!keep.log", "/docs/**/c.md"]
    got = {r.p for r in df.where(fn.gitignored(F.col("p"), lines)).collect()}
    assert got == {"build/keep.txt", "logs/a.log", "docs/a/b/c.md"}


def test_diagnostics_name_every_contradiction(spark):
    from strataflow.operators import audit

    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    t = {
        "knowledge_hotspots": rows("entity_id string, entity_type string, expert_count int, bus_factor int", ("A", "ADR", 2, 1), ("B", "ADR", 0, 1)),
        "links": rows("adr_id string, node_id string", ("A", "f1"), ("A", "f2")), "author_expertise": rows("author_email string, entity_type string, entity_id string", ("x", "FILE", "f1"), ("y", "FILE", "f2")),
        "architectural_health": rows("entity_id string, health_score double", ("A", 90.0), ("B", 50.0), ("C", 100.0)), "drift_findings": rows("id string, entity_id string, resolution_state string", ("1", "A", "ACTIVE"), ("2", "B", "RESOLVED")),
        "knowledge_validity": rows("id string, entity_id string, validity_score double", ("V1", "A", 80.0), ("V2", "B", 100.0)), "validity_evidence": rows("validity_id string", ("V9",)), "evolution_entities": rows("id string, entity_id string", ("E", "A")),
        "review_recommendations": rows("id long", (1,), (2,)), "review_scope": rows("recommendation_id long", (1,)), "review_outcomes": rows("review_id long, entity_type string, entity_id string", (7, "ADR", "Z"), (8, "ADR", "A"), (9, "PR", "Z")), "decisions": rows("id string", ("A",)),
        "coverage_entities": rows("entity_type string, entity_id string, coverage_percent double", ("ADR", "A", 10.0), ("ADR", "B", 10.0), ("ADR", "C", 10.0), ("FILE", "D", 1.0)), "outcome_evidence": rows("entity_type string, entity_id string, evidence_type string", ("ADR", "A", "COVERAGE")),
        "causal_explanations": rows("id string, target_entity_type string, target_entity_id string", ("X", "ADR", "B"), ("Y", "ADR", "Q")), "causal_factors": rows("factor_id string, explanation_id string, factor_type string", ("F1", "X", "COVERAGE_DEGRADATION"), ("F2", "X", "OTHER")),
        "causal_chains": rows("explanation_id string, prev_factor_id string, next_factor_id string", ("X", "F1", "F2"), ("W", "F1", "F9")), "causal_evidence": rows("factor_id string", ("F1",)), "decision_outcomes": rows("entity_id string", ("A",), ("N",)),
        **{k: rows("entity_id string, snapshot_date string", ("A", "2024-01-01"), *([("A", "soon")] if k == "drift_history" else [])) for k in audit.DATED},
    }
    got = {(r.check_no, r.entity) for r in audit.diagnostics(t).collect()}
    assert got == {(2, "B"), (3, "V1"), (4, "B"), (5, "2"), (6, "B"), (7, "7"), (8, "drift_history"), (10, "C"), (11, "N"), (12, "Y"), (13, "W"), (14, "F2")}


def test_index_finds_what_exact_search_finds(spark):
    from strataflow.operators import ivf

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    exact = {(r.query, r.id) for r in retrieval.knn(rows, asked, "vec_id", "embedding", 10).collect()}
    index = ivf.build(rows, "vec_id", "embedding", tile_rows=50)
    found = index.search(asked).collect()
    assert len(exact & {(r.query, r.id) for r in found}) >= 0.9 * len(exact)
    assert all(r.rank <= 10 and r.query != r.id for r in found)
    assert index.lists.count() == rows.count() and index.stale(2500) and not index.stale(2100)


def test_index_of_few_and_no_rows(spark):
    from strataflow.operators import ivf

    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0])], "id long, v array<double>")
    got = [(r.query, r.id) for r in ivf.build(few, "id", "v").search(few.where("id = 1"), k=1).collect()]
    assert got == [(1, 2)]
    assert ivf.build(few.limit(0), "id", "v").search(few).count() == 0


def test_weighted_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", 1.0), (2, [0.9, 0.1], "b", 0.0), (3, [0.8, 0.2], "a", 1.0)], "id long, v array<double>, l string, q double")
    (plain,) = retrieval.knn(rows, rows.where("id = 1"), "id", "v", 1).collect()
    (best,) = retrieval.knn(rows, rows.where("id = 1"), "id", "v", 1, label="l", quality="q").collect()
    assert plain.id == 2 and best.id == 3


def test_walk_heeds_the_ignore_file(spark, tmp_path):
    for name in ("src/a.py", "src/gen/b.py", "build/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("# built\nbuild/\nsrc/gen/**\n")
    assert {r.path for r in readers.walk(spark, str(tmp_path), ["py"], names=[]).collect()} == {"src/a.py"}
    assert len(readers.walk(spark, str(tmp_path), ["py"], names=[], use_ignore_file=False).collect()) == 3


def test_traces_of_databases_and_small_saves(spark, tmp_path):
    import sqlite3

    from strataflow.sources import traces

    base = sqlite3.connect(tmp_path / "cov.db")
    base.execute("CREATE TABLE file (id INTEGER, path TEXT)")
    base.execute("CREATE TABLE line_bits (file_id INTEGER, numbits BLOB)")
    base.execute("INSERT INTO file VALUES (1, '/work/src/a.py'), (2, 'src/b.py')")
    base.execute("INSERT INTO line_bits VALUES (1, x'0a01'), (2, x'02')")
    base.commit()
    base.close()
    got = {r.path: r.lines for r in traces.coverage_database(spark, str(tmp_path / "cov.db"), "/work").collect()}
    assert got == {"src/a.py": [1, 3, 8], "src/b.py": [1]}
    (tmp_path / "broken.db").write_bytes(b"no database")
    assert traces.coverage_database(spark, str(tmp_path / "broken.db")).count() == 0

    for text in ("one", "two: é"):
        traces.atomic_save(spark, str(tmp_path / "state.json"), text)
        assert (tmp_path / "state.json").read_text() == text
    assert not (tmp_path / "state.json.part").exists()


def test_annotations_and_communities(spark):
    files = spark.createDataFrame([('{"file": "a.py", "what": "w", "signals": ["x"]}',), ('[{"file": "b.py", "signals": []}, {"what": "no file"}]',), ("broken",), ('{"communities": [{"id": "c", "summary": "s", "members": ["m", "n"]}]}',)], "content string")
    assert {(r.file, tuple(r.signals)) for r in readers.annotations(files).collect()} == {("a.py", ("x",)), ("b.py", ())}
    assert {(r.community, r.member) for r in readers.communities(files).collect()} == {("c", "m"), ("c", "n")}


def test_streamed_bursts_are_those_of_a_table(spark, tmp_path):
    from strataflow.streaming import streams

    rows = [("a", at(1), 1, "x"), ("a", at(1) + dt.timedelta(seconds=1), 2, "y"), ("a", at(1) + dt.timedelta(seconds=9), 3, "z"), ("b", at(1), 4, "x"), ("b", at(20), 5, "end")]
    spark.createDataFrame(rows, "file string, at timestamp, seq long, kind string").repartition(3).write.parquet(str(tmp_path / "e"))
    whole = {(r.file, r.kind, r.n) for r in runtime.debounced_changes(spark.read.parquet(str(tmp_path / "e")), 2).collect()}
    assert whole == {("a", "y", 2), ("a", "z", 1), ("b", "x", 1), ("b", "end", 1)}
    got = {(r.file, r.kind, r.n) for r in streams.drained(streams.debounced(streams.event_stream(spark, str(tmp_path / "e"), 9), "2 seconds", "1 day")).collect()}
    # the last bursts are still open: no event has come after them
    assert {("a", "y", 2), ("a", "z", 1), ("b", "x", 1)} <= got <= whole


def test_reconciliation_waits_for_its_own_run(spark):
    t = lambda s: at(1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("r", t(0)), ("r", t(0.5)), ("r", t(3)), ("r", t(4.5)), ("r", t(30))], "repository string, at timestamp")
    got = [((r.start - at(1)).total_seconds(), r.n) for r in runtime.reconcile_runs(df, 1, 5).orderBy("start").collect()]
    assert got == [(1.5, 2), (6.5, 2), (31.0, 1)]


def test_rebuild_goes_on_after_a_failure(spark):
    from strataflow.operators import advisory

    def broken(_):
        raise RuntimeError("not here")

    rows = advisory.rebuild(spark, [("a", lambda s: s.range(2)), ("b", broken), ("c", broken), ("d", lambda s: s.range(1))], optional=["c"]).collect()
    assert [(r.step, r.status, r.n_rows) for r in rows] == [("a", "OK", 2), ("b", "FAILED", None), ("c", "SKIPPED", None), ("d", "OK", 1)]
