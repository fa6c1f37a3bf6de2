"""Graph queries over a typed dependency graph between events (each depends on the one at half its number and on a later one), and over page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import graph as op
from strataflow.plans import history as plans
from strataflow.plans.registry import query
from strataflow.sources import adapters as role
from strataflow.sources import roles
from strataflow.sources.adapters import table

_EDGES = """edges AS (SELECT 'e' || event_id AS src, 'e' || (event_id // 2) AS dst, CASE event_type WHEN 'view' THEN 'calls' WHEN 'click' THEN 'reads' WHEN 'signup' THEN 'imports' WHEN 'purchase' THEN 'instantiates' ELSE 'fallback_to' END AS type FROM events WHERE event_id > 0
    UNION SELECT 'e' || event_id, 'e' || (event_id + 1 + user_id % 5), 'assigns' FROM events)"""
_WALK = "walk AS (SELECT DISTINCT src, dst FROM edges WHERE type <> 'fallback_to')"
_DEG = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY node)"


def edges_of(spark, d):
    kind = F.when(F.col("event_type") == "view", "calls").when(F.col("event_type") == "click", "reads").when(F.col("event_type") == "signup", "imports").when(F.col("event_type") == "purchase", "instantiates").otherwise("fallback_to")
    node = lambda c: F.concat(F.lit("e"), c.cast("string"))
    events, own = table(spark, d, "events"), node(F.col("event_id")).alias("src")
    back = events.where("event_id > 0").select(own, node(F.floor(F.col("event_id") / 2)).alias("dst"), kind.alias("type"))
    return back.union(events.select(own, node(F.col("event_id") + 1 + F.col("user_id") % 5), F.lit("assigns"))).distinct()


def _seeds(spark, *ids):
    return spark.range(1).select(F.explode(F.array(*[F.lit(f"e{i}") for i in ids])).alias("node"))


def _reach(name: str, start: str, edges: str, a: str, b: str, depth: int) -> str:
    """A recursive CTE of least distances."""
    return f"{name} AS (WITH RECURSIVE r AS (SELECT node AS seed, node, 0 AS depth FROM {start} UNION SELECT r.seed, e.{b}, r.depth + 1 FROM r JOIN {edges} e ON e.{a} = r.node WHERE r.depth < {depth}) SELECT seed, node, min(depth) AS depth FROM r GROUP BY ALL)"


_S = "seeds(node) AS (VALUES ('e1'), ('e2'), ('e5'), ('e8'))"


@query("g4_neighbours", f"WITH {_EDGES} SELECT src, type, list_sort(list(DISTINCT dst)) AS targets FROM edges GROUP BY ALL")
def g4_neighbours(spark, d):
    return edges_of(spark, d).groupBy("src", "type").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


_BUCKET = "coalesce(list_sort(list(DISTINCT src) FILTER (type = '{}')), []) AS {}"


@query("g5_dependents", f"WITH {_EDGES} SELECT dst AS node, {', '.join(_BUCKET.format(t, n) for t, n in (('calls', 'callers'), ('imports', 'importers'), ('reads', 'readers'), ('instantiates', 'instantiators'), ('fallback_to', 'fallbacks')))}, count(DISTINCT src) AS total, CASE WHEN count(DISTINCT src) >= 10 THEN 'HIGH' WHEN count(DISTINCT src) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM edges GROUP BY dst")
def g5_dependents(spark, d):
    return op.dependents(edges_of(spark, d))


@query("g6_transitive_dependents", f"WITH {_EDGES}, {_WALK}, {_S}, {_reach('r', 'seeds', 'walk', 'dst', 'src', 10)} SELECT seed, node, depth FROM r WHERE depth > 0")
def g6_transitive_dependents(spark, d):
    return op.bfs(op.reversed_(op.of_types(edges_of(spark, d), op.WALKED)), _seeds(spark, 1, 2, 5, 8))


@query("g6_transitive_dependencies", f"WITH {_EDGES}, {_WALK}, {_S}, {_reach('r', 'seeds', 'walk', 'src', 'dst', 10)} SELECT seed, node, depth FROM r WHERE depth > 0")
def g6_transitive_dependencies(spark, d):
    return op.bfs(op.of_types(edges_of(spark, d), op.WALKED), _seeds(spark, 1, 2, 5, 8))


#: Every twentieth event is asked for.
_ASKED = "asked(node) AS (SELECT 'e' || event_id FROM events WHERE event_id % 20 = 0)"


@query("g6_reach_of_many", f"WITH {_EDGES}, {_WALK}, {_ASKED}, {_reach('r', 'asked', 'walk', 'dst', 'src', 10)} SELECT seed, depth, count(*) AS nodes FROM r WHERE depth > 0 GROUP BY ALL")
def g6_reach_of_many(spark, d):
    asked = table(spark, d, "events").where("event_id % 20 = 0").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("node"))
    return op.reach_sizes(op.reversed_(op.of_types(edges_of(spark, d), op.WALKED)), asked)


@query("g7_shortest_path", f"WITH {_EDGES}, s(node) AS (VALUES ('e900')), {_reach('r', 's', 'edges', 'src', 'dst', 15)} SELECT depth AS hops FROM r WHERE node = 'e1' AND depth > 0")
def g7_shortest_path(spark, d):
    return op.shortest_path(edges_of(spark, d), "e900", "e1").select("hops")


@query("g8_simple_paths", f"WITH RECURSIVE {_EDGES}, step AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT 'e100' AS source, 'e100' AS target, ['e100'] AS path UNION ALL SELECT source, dst, list_append(path, dst) FROM r JOIN step ON src = target WHERE len(path) <= 10 AND NOT list_contains(path, dst)) SELECT source, target, CAST(len(path) - 1 AS INTEGER) AS hops, path FROM r WHERE len(path) > 1 QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) <= 100")
def g8_simple_paths(spark, d):
    return op.simple_paths(edges_of(spark, d), _seeds(spark, 100), 10, 100).select("source", "target", "hops", "path")


_BLAST = f"""WITH {_EDGES}, {_WALK}, {_DEG}, {_S}, {_reach('r', 'seeds', 'walk', 'dst', 'src', 10)},
    x AS (SELECT seed, node, depth, substr(node, 2)::INT % 6 AS subsystem, depth + 2 * coalesce(n_in, 0) + coalesce(n_out, 0) AS criticality FROM r LEFT JOIN deg USING (node) WHERE depth > 0),
    t AS (SELECT seed, count(*) AS impacted, max(depth) AS max_depth, count(DISTINCT subsystem) AS subsystems, least(20, count(*) FILTER (criticality >= 10)) AS critical FROM x GROUP BY seed),
    b AS (SELECT seeds.node AS seed, coalesce(impacted, 0) AS impacted, coalesce(max_depth, 0) AS max_depth, coalesce(subsystems, 0) AS subsystems, coalesce(critical, 0) AS critical, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM seeds LEFT JOIN t ON t.seed = seeds.node LEFT JOIN deg ON deg.node = seeds.node),
    blast AS (SELECT *, least(100, 2 * impacted + 4 * max_depth + 5 * critical + 5 * subsystems + 2 * n_in + n_out) AS score FROM b)"""


@query("g10_blast_radius", f"{_BLAST} SELECT seed, impacted, max_depth, subsystems, critical, score, CASE WHEN score <= 20 THEN 'LOW' WHEN score <= 50 THEN 'MEDIUM' WHEN score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM blast")
def g10_blast_radius(spark, d):
    rows = edges_of(spark, d)
    subsystem = rows.select(F.col("src").alias("node")).union(rows.select("dst")).distinct().withColumn("subsystem", F.substring("node", 2, 9).cast("int") % 6)
    return op.blast_radius(rows, _seeds(spark, 1, 2, 5, 8), subsystem).select("seed", "impacted", "max_depth", "subsystems", "critical", "score", "band")


@query("g12_degree_ranking", f"WITH {_EDGES}, {_DEG} SELECT node, n_in, n_out, 3 * n_in + n_out AS heat FROM deg ORDER BY 3 * n_in + n_out DESC, node LIMIT 10")
def g12_degree_ranking(spark, d):
    heat = 3 * F.col("n_in") + F.col("n_out")
    return op.degrees(edges_of(spark, d)).withColumn("heat", heat).orderBy(F.col("heat").desc(), "node").limit(10)


#: PageRank until scores move by less than 1e-6 in all, 100 rounds at most; ranks(node, score).
_RANKS = """w AS (SELECT src, dst, count(*) * 1.0::DOUBLE AS weight FROM edges GROUP BY ALL), sh AS (SELECT w.src, dst, weight / total AS share FROM w JOIN (SELECT src, sum(weight) AS total FROM w GROUP BY src) USING (src)),
    nd AS (SELECT src AS node FROM sh UNION SELECT dst FROM sh), nn AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS p, node IN (SELECT src FROM sh) AS follows FROM nd),
    pr AS (SELECT 0 AS i, node, p AS score, 1.0::DOUBLE AS moved FROM nn UNION ALL
        SELECT i + 1, node, fresh, abs(fresh - score) FROM (SELECT o.i, nn.node, o.score, 0.15 * nn.p + 0.85 * (coalesce(gain, 0) + held.x * nn.p) AS fresh, total.x AS total
            FROM nn JOIN pr o ON o.node = nn.node LEFT JOIN (SELECT dst, sum(score * share) AS gain FROM pr JOIN sh ON src = node GROUP BY dst) g ON g.dst = nn.node,
                (SELECT coalesce(sum(score), 0) AS x FROM pr JOIN nn y ON y.node = pr.node WHERE NOT y.follows) held, (SELECT sum(moved) AS x FROM pr) total) WHERE total >= 1e-6 AND i < 100),
    ranks AS (SELECT node, score FROM pr WHERE i = (SELECT max(i) FROM pr))"""


@query("g14_pagerank", f"WITH RECURSIVE {_EDGES}, {_RANKS} SELECT node, round(score, 9) AS score FROM ranks")
def g14_pagerank(spark, d):
    return op.pagerank(edges_of(spark, d).withColumn("weight", F.lit(1.0))).withColumn("score", F.round("score", 9))


@query("g18_entry_distance", f"""WITH RECURSIVE {_EDGES}, {_DEG}, near(node, distance) USING KEY (node) AS (SELECT node, 0 FROM deg WHERE n_in = 0
        UNION SELECT e.dst, min(near.distance) + 1 FROM near JOIN edges e ON e.src = near.node WHERE NOT EXISTS (SELECT 1 FROM recurring.near x WHERE x.node = e.dst) GROUP BY e.dst)
    SELECT node, n_in, coalesce(distance, 999) AS distance, round(0.6 * n_in + 0.4 / (coalesce(distance, 999) + 1), 6) AS importance FROM deg LEFT JOIN near USING (node)""")
def g18_entry_distance(spark, d):
    return op.entry_distance(edges_of(spark, d)).withColumn("importance", F.round("importance", 6))


@query("g11_structural_risk", f"WITH {_EDGES}, {_DEG} SELECT node, least(100, 2 * n_in + 4 + 5 * (CASE WHEN n_in >= 3 THEN 1 ELSE 0 END) + 5 + 2 * n_in + n_out) AS score FROM deg")
def g11_structural_risk(spark, d):
    return op.degrees(edges_of(spark, d)).select("node", op.structural_risk(F.col("n_in"), F.lit(1), F.when(F.col("n_in") >= 3, 1).otherwise(0), F.lit(1), F.col("n_in"), F.col("n_out")).alias("score"))


_PAGES = "links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def _links(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("href"))


@query("g22_importers", f"WITH {_PAGES} SELECT href, count(DISTINCT page_id) AS importers, list_sort(list(DISTINCT page_id)) AS pages FROM links GROUP BY href")
def g22_importers(spark, d):
    return _links(spark, d).groupBy("href").agg(F.count_distinct("page_id").alias("importers"), F.sort_array(F.collect_set("page_id")).alias("pages"))


@query("g27_dangling_edges", f"WITH {_EDGES}, nodes AS (SELECT 'e' || event_id AS node FROM events) SELECT src, dst, 'src' AS missing FROM edges WHERE src NOT IN (SELECT node FROM nodes) UNION ALL SELECT src, dst, 'dst' FROM edges WHERE dst NOT IN (SELECT node FROM nodes)")
def g27_dangling_edges(spark, d):
    return op.dangling_edges(edges_of(spark, d), table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("node")))


@query("g27_valid_edges", f"WITH {_EDGES} SELECT src, dst, type FROM edges WHERE substr(dst, 2)::INT <= (SELECT max(event_id) FROM events)")
def g27_valid_edges(spark, d):
    return op.valid_edges(edges_of(spark, d), table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("node"))).select("src", "dst", "type")


@query("g25_governance_score", role.with_("adr_links") + ", s AS (SELECT adr_id, count(DISTINCT node_id) % 7 AS a, count(*) % 9 AS i, count(*) % 13 AS n FROM adr_links GROUP BY adr_id), t AS (SELECT adr_id, least(10 * a, 60) + least(5 * i, 40) + least(2 * n, 20) AS score FROM s) SELECT adr_id, score, CASE WHEN score <= 10 THEN 'LOW' WHEN score <= 30 THEN 'MEDIUM' WHEN score <= 60 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM t")
def g25_governance_score(spark, d):
    s = role.adr_links(spark, d).groupBy("adr_id").agg((F.count_distinct("node_id") % 7).alias("a"), (F.count("*") % 9).alias("i"), (F.count("*") % 13).alias("n"))
    return s.select("adr_id", op.governance_score(F.col("a"), F.col("i"), F.col("n")).alias("score")).withColumn("band", op.governance_band(F.col("score")))


@query("g26_intent_aware_impact", plans._COUPLING + f", {role.CTE['adr_links']}, walk AS (SELECT source_path AS src, target_path AS dst FROM coupled UNION SELECT target_path, source_path FROM coupled), seeds AS (SELECT node FROM (SELECT DISTINCT source_path AS node FROM coupled) ORDER BY node LIMIT 5), {_reach('zone', 'seeds', 'walk', 'src', 'dst', 2)}, s AS (SELECT seed, count(DISTINCT z.node) AS zone_size, count(DISTINCT adr_id) AS adrs FROM zone z LEFT JOIN adr_links ON node_id = z.node GROUP BY seed) SELECT seed, zone_size, adrs, least(10 * adrs, 60) + least(2 * zone_size, 20) AS score FROM s")
def g26_intent_aware_impact(spark, d):
    coupled = plans._coupled(spark, d).select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"))
    seeds = coupled.select(F.col("src").alias("node")).distinct().orderBy("node").limit(5)
    zone = op.bfs(coupled.unionByName(op.reversed_(coupled).select("src", "dst")), seeds, 2).select("seed", "node").unionByName(seeds.select(F.col("node").alias("seed"), "node"))
    found = zone.join(role.adr_links(spark, d).select(F.col("node_id").alias("node"), "adr_id"), "node", "left").groupBy("seed").agg(F.count_distinct("node").alias("zone_size"), F.count_distinct("adr_id").alias("adrs"))
    return found.withColumn("score", op.governance_score(F.col("adrs"), F.lit(0), F.col("zone_size")))


@query("g30_intent_neighbourhood", f"WITH {plans._INTENTS}, e AS (SELECT DISTINCT * FROM evidence), g AS (SELECT a.intent_id AS x, b.intent_id AS y, least(1.0, count(*) / 10.0) AS weight FROM e a JOIN e b ON a.source_type = b.source_type AND a.source_id = b.source_id AND a.intent_id < b.intent_id GROUP BY ALL HAVING count(*) >= 2) SELECT CASE WHEN x = 'T3' THEN y ELSE x END AS neighbour, weight FROM g WHERE x = 'T3' OR y = 'T3'")
def g30_intent_neighbourhood(spark, d):
    rows = plans.r28_intent_graph(spark, d).where("source_intent = 'T3' OR target_intent = 'T3'")
    return rows.select(F.when(F.col("source_intent") == "T3", F.col("target_intent")).otherwise(F.col("source_intent")).alias("neighbour"), "weight")


@query("t10_topological_levels", f"WITH RECURSIVE {_EDGES}, step AS (SELECT DISTINCT src, dst FROM edges WHERE type <> 'assigns'), nodes AS (SELECT src AS node FROM step UNION SELECT dst FROM step), r AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT dst FROM step) UNION SELECT dst, level + 1 FROM r JOIN step ON src = node) SELECT node, max(level) AS level FROM r GROUP BY node")
def t10_topological_levels(spark, d):
    return op.topological_levels(edges_of(spark, d).where("type <> 'assigns'"))


@query("j19_symbol_resolution", roles.with_("graph_units", "graph_facts") + """, uses AS (SELECT DISTINCT unit_id AS unit, lower(string_split(symbol, '.')[-1]) AS k FROM graph_facts WHERE fact_type = 'call_site'), defs AS (SELECT lower(string_split(symbol, '.')[-1]) AS k, unit_id AS target, file_path AS file, CAST(substr(unit_id, 2) AS BIGINT) AS line FROM graph_units)
    SELECT unit, uses.k AS name, target, row_number() OVER (PARTITION BY unit, uses.k ORDER BY file, line, target) AS rn FROM uses JOIN defs ON defs.k = uses.k WHERE unit <> target QUALIFY rn <= 3""")
def j19_symbol_resolution(spark, d):
    last = F.element_at(F.split("symbol", r"\."), -1)
    uses = roles.role(spark, d, "graph_facts").where("fact_type = 'call_site'").select(F.col("unit_id").alias("unit"), last.alias("name"))
    defs = roles.role(spark, d, "graph_units").select(last.alias("name"), F.col("unit_id").alias("unit"), F.col("file_path").alias("file"), F.substring("unit_id", 2, 20).cast("long").alias("line"))
    return op.resolve_symbols(uses, defs)


@query("g19_call_resolution", roles.with_("call_units", "call_sites", "unit_imports") + """, u AS (SELECT unit_id, file_path, parent_id, lower(string_split(symbol, '.')[-1]) AS name FROM call_units), c AS (SELECT DISTINCT unit_id AS caller, lower(string_split(symbol, '.')[-1]) AS name FROM call_sites),
    m AS (SELECT caller, c.name, t.unit_id AS target, CASE WHEN t.parent_id = o.parent_id THEN 0 END AS t0, CASE WHEN t.file_path = o.file_path THEN 1 END AS t1, CASE WHEN EXISTS (SELECT 1 FROM unit_imports i WHERE i.src = o.file_path AND i.dst = t.file_path) THEN 2 END AS t2 FROM c JOIN u o ON o.unit_id = caller JOIN u t ON t.name = c.name AND t.unit_id <> caller),
    x AS (SELECT caller, name, target, t0 AS tier FROM m WHERE t0 IS NOT NULL UNION ALL SELECT caller, name, target, 1 FROM m WHERE t1 IS NOT NULL UNION ALL SELECT caller, name, target, 2 FROM m WHERE t2 IS NOT NULL UNION ALL SELECT caller, name, target, 3 FROM m),
    one AS (SELECT caller, name, tier, min(target) AS target FROM x GROUP BY ALL HAVING count(DISTINCT target) = 1) SELECT caller, name, target, tier FROM one QUALIFY row_number() OVER (PARTITION BY caller, name ORDER BY tier) = 1""")
def g19_call_resolution(spark, d):
    units, facts, imports = (roles.role(spark, d, n) for n in ("call_units", "call_sites", "unit_imports"))
    last = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    calls = facts.select(F.col("unit_id").alias("caller"), last("symbol").alias("name"))
    return op.resolve_calls(calls, units.select("unit_id", "file_path", "parent_id", last("symbol").alias("name")), imports)



@query("a31_document_frequency", "WITH t AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents), f AS (SELECT w, count(*) AS df FROM t WHERE length(w) >= 4 GROUP BY w) SELECT w, df FROM f WHERE df >= 5 AND df <= 0.3 * (SELECT count(*) FROM documents)")
def a31_document_frequency(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).where(F.length("w") >= 4)
    total = docs.agg(F.count("*").alias("total"))
    return words.groupBy("w").agg(F.count("*").alias("df")).join(F.broadcast(total)).where("df >= 5 AND df <= 0.3 * total").select("w", "df")
