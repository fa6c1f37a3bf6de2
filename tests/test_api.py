import pytest

from strataflow.plans.api import Engine
from strataflow.operators import advisory
from strataflow.sources.generations import Generations


@pytest.fixture()
def engine(spark):
    chunks = spark.createDataFrame([(1, "a.py", "parse the config file"), (2, "b.py", "open a socket"), (3, "c.py", "config config parser")], "id long, path string, text string")
    facts = spark.createDataFrame([(7, "a.py", "Loader.parseFile", "call", "1", "high", "implementation", 3)], "fact_id long, file_path string, symbol string, fact_type string, value string, confidence string, role string, start_line int")
    edges = spark.createDataFrame([("b", "a", "calls"), ("c", "b", "imports"), ("d", "a", "fallback_to")], "src string, dst string, type string")
    return Engine(chunks, facts, edges)


def test_plan(engine):
    plan = engine.plan("What depends on parseFile and uses my_loader?")
    assert plan.type == "impact_analysis" and plan.identifiers == ["parseFile", "my_loader"] and plan.providers == ["text", "facts", "graph"]


def test_lookups(engine):
    assert [r.doc for r in engine.search("config").orderBy("rank").collect()] == [3, 1]
    assert {(r.node, r.depth) for r in engine.dependents("a").collect()} == {("b", 1), ("c", 2)}
    assert {r.node for r in engine.dependencies("c").collect()} == {"a", "b"}
    assert [r.fact_id for r in engine.get_facts(symbol="parsefile").collect()] == [7]
    assert [r.id for r in engine.gather_evidence("Where does parseFile read the config?").orderBy("pos", "provider_no").collect()][:2] == ["1", "fact:7"]


def test_generations(spark, tmp_path):
    table, rows = Generations(spark, str(tmp_path / "t")), spark.range(3)
    assert table.live() is None
    table.begin(rows)
    assert table.commit() and table.live().count() == 3
    reader = table.live()
    table.begin(rows.limit(0))
    assert not table.commit() and table.live().count() == 3
    table.begin(spark.range(5))
    table.abort()
    assert table.live().count() == 3
    table.begin(spark.range(5))
    assert table.commit() and table.live().count() == 5 and reader.count() == 3


def test_communities_merge_and_attach_hubs(spark):
    edges = [(f"a/{i}", f"b/{j}") for i in range(4) for j in range(4) if (i + j) % 2] + [("c/0", "c/1"), ("c/1", "c/2")]
    hub = [("hub/x", f"a/{i}") for i in range(4)] + [("hub/x", f"b/{i}") for i in range(4)]
    found = {r.node: r.community for r in advisory.communities(spark.createDataFrame(edges + hub, "src string, dst string"), lambda c: c.substr(1, 1)).collect()}
    assert found["a/0"] == found["b/0"] == found["hub/x"] and found["c/0"] == found["c/2"] != found["a/0"]
