"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a DataFrame with
the columns of docs; the last adds `copies`. run() writes each stage's result as Parquet and reads it again
as the next one's input; what a stage wrote on its way is deleted when its result is there.

Defined results: null and empty texts are no reason to reject a document (of those whose fingerprint is 0 one stays, as of
any group of near copies); a null id keeps its row; rows that repeat stay until the third stage, which keeps one of a
group; other columns of docs are carried along whatever their names, only a column named `copies` is replaced by
the last stage; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm._shared import discard, materialize, table, written
from strataflow.llm.decontaminate import decontaminate
from strataflow.llm.line_dedup import dedup_lines
from strataflow.llm.mixing import mix_documents
from strataflow.llm.simhash_dedup import near_duplicates
from strataflow.llm.toxicity import learn, toxicity, training_rows

#: A document that benchmark passages cover to more than this share goes as a whole; of others the passages go.
MOST_COVERED = 0.5
#: Repeated passages of fewer than three lines go too if they have this many words.
LONG_WORDS = 50


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str, list[str]]:
    """Docs under names that clash with nothing; the names of id and text, and of the other columns."""
    names = [f"doc_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    return docs.toDF(*names), of["doc_id"], of["text"], [n for n in names if n not in (of["doc_id"], of["text"])]


def _renamed(found: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of docs again; `text` names the new text, and n_chars follows it."""
    columns = []
    for i, c in enumerate(docs.columns):
        column = F.col(text if text and c == "text" else f"doc_{i}")
        if text and c == "n_chars":
            column = F.length(text).cast(docs.schema[c].dataType)
        columns.append(column.alias(c))
    return found.select(*columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores as toxic go."""
    lexicon = learn(docs, training_rows(table(spark, sf_dir, "labels")))
    own, id_col, text, others = _plain(docs)
    return _renamed(toxicity(own, lexicon, id_col=id_col, text_col=text, carry=[text, *others]).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three or more lines, or of LONG_WORDS words, that an earlier document has, or that come earlier in the document, go."""
    own, id_col, text, _ = _plain(docs)
    return _renamed(dedup_lines(own, id_col=id_col, text_col=text, long_words=LONG_WORDS), docs, text)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays (ids before null); of its rows that share the id, one."""
    own, id_col, text, _ = _plain(docs)
    # the text's hash tells rows that share an id apart; rows that share both are copies
    own = own.withColumn("near_id", F.col(id_col).cast("long")).withColumn("near_text", F.xxhash64(text))
    key = F.struct(F.col("near_id").isNull().alias("none"), F.col("near_id").alias("id"), F.col("near_text").alias("h"))
    found = materialize(near_duplicates(own.select(key.alias("doc_id"), F.col(text).alias("text"))), "near-duplicates", compact=True)
    n, keys = found.select(F.count("*"), F.count_distinct("doc_id")).first()
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.id").alias("kept_id"), F.col("doc_id.h").alias("kept_text")).distinct()
    left = own.join(kept, F.col("near_id").eqNullSafe(F.col("kept_id")) & (F.col("near_text") == F.col("kept_text")), "left_semi")
    if n != keys:
        # of rows with one id and one text that with the greatest hash of all columns stays, so that reruns agree
        row = F.struct(*[c for c in own.columns if not c.startswith("near_")])
        left = left.groupBy("near_id", "near_text").agg(F.max_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias("near_row")).select("near_row.*")
    return _renamed(left, docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut; documents that they cover to more than MOST_COVERED go."""
    own, id_col, text, others = _plain(docs)
    found = decontaminate(own, table(spark, sf_dir, "benchmark"), id_col=id_col, text_col=text, carry=others)
    return _renamed(found.where(F.col("n_hit") <= F.col("n_words") * MOST_COVERED), docs, "clean_text")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the number of copies it takes of each; rows that share an id are taken alike."""
    return mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("mixing", mix_to_targets),
]

#: The first and third stage can't be expressed in SQL; tests/llm/test_pipeline.py holds every stage and run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, before, keep=1)
    return docs
