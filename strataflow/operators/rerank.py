"""A trained reranker: a logistic model over what a question and a candidate have in common, learned from judged pairs in Spark.

Features are column expressions over the tokens of both texts: shares of the question's words, of their rarity, and of its word pairs and
triples that the candidate has, its retrieval score and rank, and its length. Training is Spark's logistic regression over the
judged pairs; what comes out is a handful of weights, so scoring is a column expression as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.operators.retrieval import tokens, top_k

FEATURES = ("words", "rarity", "pairs", "triples", "score", "rank", "length")


def rarity_of(docs: DataFrame, text: str) -> DataFrame:
    """(token, idf) over a corpus."""
    own = docs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.count()
    return own.select("token", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def questions(asked: DataFrame, query_key: str, text: str, rarity: DataFrame) -> DataFrame:
    """(query, asked): a question's tokens in order with their rarity; tokens that the corpus lacks weigh as its rarest."""
    most = rarity.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("most"))
    own = asked.select(F.col(query_key).alias("query"), F.posexplode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("place", "token"))
    # a question is what someone typed, so its tokens fit in a row
    listed = own.join(rarity, "token", "left").join(F.broadcast(most)).groupBy("query").agg(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("place", "token", F.coalesce("idf", "most").alias("idf"))))).alias("asked"))
    return listed


def _share(hay: Column, asked: Column, n: int) -> Column:
    """The share of a question's runs of n tokens that stand in the candidate."""
    places = F.when(F.size(asked) >= n, F.sequence(F.lit(0), F.size(asked) - n)).otherwise(F.array().cast("array<int>"))
    runs = F.array_distinct(F.transform(places, lambda p: F.concat(F.lit(" "), F.array_join(F.transform(F.slice(asked, p + 1, n), lambda x: x["token"]), " "), F.lit(" "))))
    return F.when(F.size(runs) == 0, 0.0).otherwise(F.size(F.filter(runs, lambda r: F.contains(hay, r))) / F.size(runs))


def features(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates (query, doc, score, rank, content, ..) with one column for each of FEATURES, without the content; null content is empty.

    best, a question's highest score, is taken from a column of that name if there is one (`placed`): else candidates are shuffled to find it.
    """
    rows = (candidates if "best" in candidates.columns else candidates.withColumn("best", F.max("score").over(Window.partitionBy("query")))).join(asked, "query")
    own = tokens(F.coalesce(F.col("content"), F.lit("")))
    rows = rows.withColumn("rerank_hay", F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")))
    hay, q = F.col("rerank_hay"), F.col("asked")
    total = F.aggregate(q, F.lit(0.0), lambda s, x: s + x["idf"])
    met = F.aggregate(F.filter(q, lambda x: F.contains(hay, F.concat(F.lit(" "), x["token"], F.lit(" ")))), F.lit(0.0), lambda s, x: s + x["idf"])
    best = F.col("best")
    of = {"words": _share(hay, q, 1), "rarity": F.when(total == 0, 0.0).otherwise(met / total), "pairs": _share(hay, q, 2), "triples": _share(hay, q, 3), "score": F.when(best > 0, F.col("score") / best).otherwise(0.0), "rank": 1.0 / F.col("rank"), "length": F.log1p(F.length(hay)) / 10}
    found = rows.select("*", *[c.cast("double").alias(f"rerank_{k}") for k, c in of.items()])
    return found.drop("rerank_hay", "asked", "best", "content")


def placed(found: DataFrame, docs: DataFrame, asked: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """Features of a search's results (query, doc, score, rank) over docs (doc, content); with passages also `relevant`.

    Results meet the texts once and leave with numbers in their place, so a text is never shuffled or written for each question it was found by.
    """
    short = found.withColumn("best", F.max("score").over(Window.partitionBy("query")))
    if passages is not None:
        short = short.join(passages.select("query", "passage"), "query")
    rows = short.join(docs.select("doc", "content"), "doc")
    return features(_judged(rows).drop("passage") if passages is not None else rows, asked)


@dataclass
class Reranker:
    """Weights of the features and the intercept."""

    weights: dict[str, float]
    intercept: float

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for name, w in self.weights.items():
            z = z + F.col(f"rerank_{name}") * w
        return 1 / (1 + F.exp(-z))


def train(judged: DataFrame, asked: DataFrame, ridge: float = 1e-3, rounds: int = 60) -> Reranker:
    """Learns from judged candidates (query, doc, score, rank, content, relevant 0/1); both kinds count alike, however many there are of each.

    The pairs stay in Spark; the driver gets the weights. Without pairs of both kinds the reranker is the share of words.
    """
    return train_on(features(judged.where("relevant is not null"), asked), ridge, rounds)


def train_on(featured: DataFrame, ridge: float = 1e-3, rounds: int = 60) -> Reranker:
    """train from rows that have their features already."""
    rows = featured.where("relevant is not null").select("relevant", *[f"rerank_{k}" for k in FEATURES])
    counts = {r["relevant"]: r["count"] for r in rows.groupBy("relevant").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Reranker({"words": 4.0}, -2.0)
    weight = F.when(F.col("relevant") == 1, 0.5 / counts[1]).otherwise(0.5 / counts[0]) * (counts[0] + counts[1])
    data = rows.select(F.col("relevant").cast("double").alias("label"), weight.alias("weight"), array_to_vector(F.array(*[f"rerank_{k}" for k in FEATURES])).alias("features"))
    model = LogisticRegression(regParam=ridge, maxIter=rounds, weightCol="weight").fit(data)
    return Reranker(dict(zip(FEATURES, (float(x) for x in model.coefficients), strict=True)), float(model.intercept))


def rerank(candidates: DataFrame, asked: DataFrame, model: Reranker, top: int = 40) -> DataFrame:
    """(query, doc, score, rank): each question's `top` candidates by the model's probability; ties by document."""
    return ranked(features(candidates.where(F.col("rank") <= top), asked), model, top)


def ranked(featured: DataFrame, model: Reranker, top: int = 40) -> DataFrame:
    """rerank from rows that have their features already."""
    scored = featured.select("query", "doc", model.probability().alias("score"))
    return top_k(scored, "query", F.round("score", 9), "doc", top)


def judged_passages(docs: DataFrame, key: str, text: str, every: int, length: int = 12, drop: float = 0.4, seed: str = "judge") -> DataFrame:
    """Questions made of a corpus: (query, passage, question): of one document in `every`, chosen by a hash, a passage of `length` tokens, and what is left of it.

    A share `drop` of the question's tokens is left out, and the rest stands in another order in pairs, as people put things.
    """
    own = docs.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(every)) == 0).select(F.col(key).alias("query"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).where(F.size("t") >= 2 * length)
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("at"), "query"), F.size("t") - length).cast("int")
    taken = own.withColumn("p", F.slice("t", start + 1, length))
    kept = F.filter(F.transform("p", lambda w, i: F.struct(F.pmod(F.xxhash64(F.lit(seed), F.col("query"), F.floor(i / 2)), F.lit(1000)).alias("o"), i.alias("i"), w.alias("w"))), lambda x: F.pmod(F.xxhash64(F.lit(seed), F.lit("keep"), F.col("query"), x["i"]), F.lit(1000)) >= int(drop * 1000))
    return taken.select("query", F.concat(F.lit(" "), F.array_join("p", " "), F.lit(" ")).alias("passage"), F.array_join(F.transform(F.array_sort(kept), lambda x: x["w"]), " ").alias("question"))


def judged_candidates(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """Candidates with relevant: 1 if the candidate has the whole passage that the question was made of."""
    return _judged(candidates.join(passages.select("query", "passage"), "query")).drop("passage")


def _judged(rows: DataFrame) -> DataFrame:
    hay = F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col("content"), F.lit(""))), " "), F.lit(" "))
    return rows.withColumn("relevant", F.contains(hay, F.col("passage")).cast("int"))


def mean_reciprocal_rank(ranked: DataFrame, judged: DataFrame) -> float:
    """Of rankings (query, doc, rank): the mean of 1 / the first relevant document's rank, over questions that have one among the judged."""
    relevant = judged.where("relevant = 1").select("query", "doc")
    first = relevant.join(ranked.select("query", "doc", "rank"), ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    return float(first.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).first()[0] or 0.0)
