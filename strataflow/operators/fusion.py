"""What joins retrieval channels: boosts, keyword passes, signals, reranking, degraded channels, relevance of facts, the answer cache."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.questions import STOP_WORDS
from strataflow.functions.session import cut
from strataflow.operators.ranks import running
from strataflow.operators.retrieval import appended, bm25, occurrences, tokens, top_k
from strataflow.operators.scan import scanned

#: What a channel adds before fusion.
EXPLICIT_PATH, SEED_FILE, CONCEPT, DEPENDENT = 5.0, 4.0, 2.0, 1.5


def symbol_boost(name: Column, entity: Column, kind: Column) -> Column:
    """2.5 if a symbol's name has the entity asked for, 2 if the entity has the name, else .6; half a point more for a class."""
    n, e = F.lower(name), F.regexp_replace(F.lower(entity), "_", "")
    base = F.when((e != "") & F.contains(n, e), 2.5).when((e != "") & F.contains(e, n), 2.0).otherwise(0.6)
    return base + F.when(kind == "class", 0.5).otherwise(0.0)


def boosted(scores: DataFrame, boosts: Sequence[DataFrame], least: float = 0.1) -> DataFrame:
    """Scores (query, doc, score) with the boosts (query, doc, boost) of all channels added, .1 at least where a channel has something; chunks that only channels know come in with their boosts."""
    parts = reduce(DataFrame.unionByName, [b.select("query", "doc", "boost") for b in boosts]).groupBy("query", "doc").agg(F.sum("boost").alias("boost"))
    both = scores.select("query", "doc", "score").join(parts, ["query", "doc"], "full")
    return both.select("query", "doc", (F.coalesce("score", F.lit(0.0)) + F.when(F.col("boost").isNotNull(), F.greatest(F.col("boost"), F.lit(least))).otherwise(0.0)).alias("score"))


def keywords(text: Column) -> Column:
    """The words of a question that tell something."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def raw_and_keywords(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, top: int = 50) -> DataFrame:
    """(query, doc, rank): the best for the question as it is, then, behind them, what its keywords alone find."""
    # both are questions of one search: the texts are read for them once
    name = F.col(query_key).cast("string")
    both = queries.select(F.concat(F.lit("r"), name).alias("query"), F.col(query_text).alias("text")).unionByName(queries.select(F.concat(F.lit("k"), name).alias("query"), F.array_join(keywords(F.col(query_text)), " ").alias("text")))
    found = cut(bm25(docs, both, key, text, "query", "text", top).select(F.left("query", F.lit(1)).alias("channel"), F.substr("query", F.lit(2)).cast(queries.schema[query_key].dataType).alias("query"), "doc", "rank"))
    raw, short = (found.where(F.col("channel") == c).drop("channel") for c in "rk")
    return appended(raw, short)


def segmented_bm25(docs: DataFrame, segment: str, tombstones: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, top: int = 10) -> DataFrame:
    """(query, doc, score, rank) over segments that are searched each with its own statistics, deleted documents (doc) left out, the best score of each document.

    One pass for all segments: a document is scored where it stands, by the statistics of its segment (`scan`).
    """
    asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokens(F.coalesce(F.col(query_text), F.lit(""))))).alias("term"))
    cut_up = lambda df: df.where(F.col(segment).isNotNull()).select(F.col(key).alias("doc"), F.col(segment).alias("seg"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    alive = docs.join(tombstones.select(F.col("doc").alias(key)).distinct(), key, "left_anti")
    # a document that has moved to another segment is found once, by its better score
    scored = scanned(cut_up(docs), asked.distinct(), top, cut_up(alive)).groupBy("query", "doc").agg(F.max("score").alias("score"))
    return top_k(scored, "query", F.round("score", 9), "doc", top)


def signal_prefilter(annotations: DataFrame, asked: DataFrame, chunks: DataFrame, files: int = 8, per_file: int = 2) -> DataFrame:
    """(query, file, chunk, score): chunks of the files whose annotations have the signals a question prefers, best files first.

    annotations (file, what, key_symbols, signals), asked (query, text, terms, preferred), chunks (file, chunk, start). A preferred
    signal counts 2, a term found in the annotation 1, the file's name in the question 2.
    """
    rows = asked.join(annotations, F.arrays_overlap("signals", "preferred"))
    hay = F.lower(F.concat_ws(" ", "file", "what", F.array_join("key_symbols", " ")))
    hits = F.size(F.filter("terms", lambda t: F.contains(hay, F.lower(t))))
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    score = 2 * F.size(F.array_intersect("signals", "preferred")) + hits + F.when(F.contains(F.lower("text"), name), 2).otherwise(0)
    best = top_k(rows.select("query", "file", score.alias("score")).where("score > 0"), "query", F.col("score"), "file", files).drop("rank")
    first = F.row_number().over(Window.partitionBy("file").orderBy("start", "chunk"))
    return best.join(chunks.withColumn("_n", first).where(F.col("_n") <= per_file).select("file", "chunk"), "file").select("query", "file", "chunk", "score")


def degraded_channels(errors: DataFrame, weights: DataFrame, least: float = 0.4) -> DataFrame:
    """Errors (query, strategy, channel, error) of channels whose weight in the strategy (strategy, channel, weight) is `least` or more, and whether the store is corrupt."""
    corrupt = F.col("error").rlike(r"(?i)\(IO\)") & F.col("error").rlike("(?i)not found")
    return errors.join(weights, ["strategy", "channel"]).where(F.col("weight") >= least).select("query", "channel", "weight", "error", corrupt.alias("corrupt"))


def overlap_score(question: Column, passage: Column) -> Column:
    """The share of a question's keywords that a passage has: what scores passages where no model does."""
    words = keywords(question)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, tokens(passage))) / F.size(words))


def reranked(rows: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, most: int = 40, chars: int = 1200, floor: float = 0.3) -> DataFrame:
    """(query, doc, score, rank) after a second look at the `most` best of each query (query, doc, score, question, file, content).

    The scorer (a column function, so a pandas UDF over a model does as well) sees the file's name and `chars` characters. Its scores are
    spread over [floor, 1]; what it did not see stays in its order below .95 * floor.
    """
    w = Window.partitionBy("query")
    ranked = rows.withColumn("_n", F.row_number().over(w.orderBy(F.round("score", 9).desc(), "doc")))
    passage = F.concat("file", F.lit("\n"), F.substring("content", 1, chars))
    seen = ranked.withColumn("_s", F.when(F.col("_n") <= most, scorer(F.col("question"), passage)))
    low, high = F.min("_s").over(w), F.max("_s").over(w)
    spread = F.when(high - low > 1e-9, (F.col("_s") - low) / (high - low)).otherwise(1.0)
    tail = F.greatest(F.lit(1e-9), F.max(F.when(F.col("_n") > most, F.col("score"))).over(w))
    final = F.when(F.col("_s").isNotNull(), floor + spread * (1 - floor)).otherwise(F.col("score") / tail * floor * 0.95)
    return top_k(seen.select("query", "doc", final.alias("score")), "query", F.round("score", 9), "doc", 1 << 30)


def fact_relevance(facts: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """(query, fact_id, score, rank): facts by how often the words of a question (query, words) occur in their six fields; ties by place, type and id.

    facts: fact_id, file_path, symbol, fact_type, value_kind, source_text, value, start_line, end_line. A word first has to occur at all.
    """
    hay = F.lower(F.concat_ws("\n", "file_path", F.coalesce("symbol", F.lit("")), "fact_type", "value_kind", "source_text", "value"))
    rows = facts.withColumn("_h", hay).join(asked.select("query", F.explode(F.array_distinct("words")).alias("word")), F.contains("_h", F.lower("word")))
    scored = rows.groupBy("query", "fact_id", "file_path", "start_line", "end_line", "fact_type").agg(F.sum(occurrences(F.col("_h"), F.lower("word"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "file_path", "start_line", "end_line", "fact_type", "fact_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "fact_id", "score", "rank")


def threshold_relevance(facts: DataFrame, hints: DataFrame, types: Sequence[str] = ("numeric_threshold", "constant"), weights: Mapping[str, int] = {"symbol": 3, "file_path": 2, "source_text": 1}, most: int = 5) -> DataFrame:  # noqa: B006
    """(query, fact_id, score): of the facts of these types the `most` whose symbol, file or text has a question's hints (query, hint)."""
    own = facts.where(F.col("fact_type").isin(*types)).dropDuplicates(["fact_id"])
    rows = own.join(hints, F.contains(F.lower(F.concat_ws("\n", *weights)), F.lower("hint")))
    score = reduce(Column.__add__, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower("hint")).cast("int") * w for c, w in weights.items()])
    scored = rows.groupBy("query", "fact_id").agg(F.sum(score).alias("score")).where("score > 0")
    return top_k(scored, "query", F.col("score"), "fact_id", most).select("query", "fact_id", "score")


def cache_state(pairs: DataFrame, events: DataFrame, stale: float = 0.25) -> DataFrame:
    """(id, quality, hits, last_accessed, stale) of cached answers (id, quality, hits) after their events (id, seq, delta, seen_at).

    A delta moves the quality (.5 where none is known) and is clamped to [0, 1] each time, in order; a null delta is a hit.
    """
    listed = events.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta")))).alias("ds"), F.count_if(F.col("delta").isNull()).alias("n"), F.max(F.when(F.col("delta").isNull(), F.col("seen_at"))).alias("last_accessed"))
    rows = pairs.join(listed, "id", "left")
    quality = F.aggregate(F.coalesce("ds", F.array().cast("array<struct<seq:bigint,delta:double>>")), F.coalesce("quality", F.lit(0.5)), lambda q, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), q + d["delta"])))
    return rows.select("id", quality.alias("quality"), (F.coalesce("hits", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("hits"), "last_accessed").withColumn("stale", F.col("quality") <= stale)


def near_tie_order(rows: DataFrame, score: str, ties: Sequence[str], epsilon: float = 1e-4) -> DataFrame:
    """Rows with `place`: by falling score, where scores that follow each other within `epsilon` are one step, ordered by the tie columns.

    Steps are runs of scores: a score starts one if it is more than `epsilon` under the one before.
    """
    by_score = running(rows, [F.col(score).desc(), *[F.col(t) for t in ties]])
    above = by_score.select((F.col("rank") + 1).alias("rank"), F.col(score).alias("_above"))
    gaps = by_score.join(above, "rank", "left").withColumn("_gap", F.coalesce((F.col("_above") - F.col(score) > epsilon).cast("int"), F.lit(0))).withColumnRenamed("rank", "_rank")
    steps = running(gaps, [F.col("_rank")], ["_gap"]).withColumn("_step", F.col("before__gap") + F.col("_gap")).drop("rank")
    placed = running(steps, [F.col("_step"), *[F.col(t) for t in ties]])
    return placed.select(*rows.columns, F.col("rank").alias("place"))
