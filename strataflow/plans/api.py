"""What a caller can ask of an indexed corpus: one object over role-typed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import questions as fn
from strataflow.operators import graph, lookup, retrieval


@dataclass
class Plan:
    """What a question asks for: its type, whether it is complex, the identifiers in it, the providers to use, and how many chunks its strategy reads at most."""

    question: str
    type: str
    complex: bool
    identifiers: list[str]
    providers: list[str]
    strategy: str = "behavior_explanation"
    most_chunks: int = 150


@dataclass
class Engine:
    """Lookups and evidence over chunks (id, path, text), facts, and a typed edge table (src, dst, type)."""

    chunks: DataFrame
    facts: DataFrame | None = None
    edges: DataFrame | None = None

    def plan(self, question: str) -> Plan:
        """Plans a question by rules alone."""
        row = self.chunks.sparkSession.range(1).select(fn.question_type(F.lit(question)).alias("t"), fn.complexity(F.lit(question)).alias("c"), fn.strategy(F.lit(question)).alias("s"), F.regexp_extract_all(F.lit(question), F.lit("[A-Za-z]+[_.][A-Za-z_.]+|[a-z]+[A-Z][A-Za-z]+|[A-Z][a-z]+[A-Z][A-Za-z]+"), F.lit(0)).alias("i")).first()
        providers = ["text"] + (["facts"] if self.facts is not None and row["i"] else []) + (["graph"] if self.edges is not None and row["t"] in ("impact_analysis", "change_impact_prediction", "dependency_injection") else [])
        return Plan(question, row["t"], row["c"] >= 2, list(row["i"]), providers, row["s"]["strategy"], row["s"]["most"])

    def search(self, question: str, top: int = 10) -> DataFrame:
        asked = self.chunks.sparkSession.range(1).select(F.lit(0).alias("q"), F.lit(question).alias("text"))
        return retrieval.bm25(self.chunks, asked, "id", "text", "q", "text", top).select("doc", "score", "rank")

    def dependents(self, node: str, depth: int = 10) -> DataFrame:
        return self._walk(node, depth, graph.reversed_)

    def dependencies(self, node: str, depth: int = 10) -> DataFrame:
        return self._walk(node, depth, lambda e: e)

    def _walk(self, node: str, depth: int, turn) -> DataFrame:
        if self.edges is None:
            raise ValueError("this engine has no edges")
        seeds = self.chunks.sparkSession.range(1).select(F.lit(node).alias("node"))
        return graph.bfs(turn(graph.of_types(self.edges, graph.WALKED)), seeds, depth).select("node", "depth")

    def get_facts(self, **conditions) -> DataFrame:
        if self.facts is None:
            raise ValueError("this engine has no facts")
        return lookup.query_facts(self.facts, **conditions)

    def gather_evidence(self, question: str, cap: int = 50, identifiers: Sequence[str] | None = None) -> DataFrame:
        """Evidence of all providers of the plan, in turn, each item once: id, provider_no, pos."""
        plan = self.plan(question)
        found = self.search(question, cap).select(F.lit(0).alias("provider_no"), F.col("rank").alias("pos"), F.col("doc").cast("string").alias("id"))
        for number, provider in enumerate(plan.providers[1:], 1):
            for name in identifiers or plan.identifiers:
                if provider == "facts":
                    rows = self.get_facts(symbol=name, limit=cap).select(F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("id"))
                else:
                    rows = self.dependents(name, 3).orderBy("depth", "node").limit(cap).select(F.concat(F.lit("node:"), F.col("node")).alias("id"))
                placed = rows.withColumn("pos", F.monotonically_increasing_id().cast("int") + 1)
                found = found.unionByName(placed.select(F.lit(number).alias("provider_no"), "pos", "id"))
        return retrieval.interleaved(found, cap)
