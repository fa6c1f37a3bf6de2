"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines (trimmed, blank ones skipped) are hashed; grams of `gram` neighbouring line hashes are hashed again, and of
every `window` neighbouring grams the least is kept as a fingerprint. Any two runs of
gram + window - 1 equal lines then share a fingerprint at the same place (the winnowing guarantee), so
fingerprints that occur once rule out most of the corpus with a fraction of its positions. Shorter runs that are long passages
all the same (`long_words` words) are fingerprints as they are.

Positions of fingerprints that occur elsewhere are joined: each window of lines around one meets the first
occurrence of the same lines in (id, line) order. Windows that follow each other in both texts are one match, extended both
ways as far as the lines agree (`line_matches`). Every occurrence but the first is deleted; since a window
has its own first occurrence, what is deleted is exactly what any earlier passage covers, wherever that passage ends.

Joins meet at the first occurrence only, never all pairs of occurrences, and counts are combined before the shuffle, so a
passage that a third of the corpus shares costs one row for each document that has it. All joins sort and spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm._shared import materialize

_RUN = "struct<f:bigint,p:int,runs:array<struct<s:int,e:int,r:bigint,first:int,last:int>>>"


def _starts(width: int) -> Column:
    """Where a run of `width` of n lines can start."""
    return F.when(F.col("n") >= width, F.sequence(F.lit(0), F.col("n") - width)).otherwise(F.array().cast("array<int>"))


def _run(s: Column, width: int, salt: int | None = None) -> Column:
    """The run of `width` lines from s: its ends, hash, and the text's line numbers."""
    h = F.xxhash64(*([F.lit(salt)] if salt else []), *[F.get("h", s + k) for k in range(width)])
    return F.struct(s.alias("s"), (s + (width - 1)).alias("e"), h.alias("r"), F.get("at", s).alias("first"), F.get("at", s + (width - 1)).alias("last"))


def _marks(lines: DataFrame, gram: int, window: int, long_words: int | None) -> DataFrame:
    """(id, f, p, runs): the fingerprints of each text, where they are, and the runs of lines that contain them."""
    run = gram + window - 1
    grams = F.transform(_starts(gram), lambda p: F.xxhash64(*[F.get("h", p + k) for k in range(gram)]))
    places = F.when(F.col("n") >= run, F.sequence(F.lit(0), F.size("g") - window)).otherwise(F.array().cast("array<int>"))
    least = F.transform(places, lambda j: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.struct(F.get("g", j + k).alias("f"), (-(j + k)).alias("p")))))
    # a run whose lines are all long passages themselves adds nothing to what those delete
    needed = lambda s, width: F.greatest(*[(F.get("words", s + k) < long_words).cast("int") for k in range(width)], F.lit(0)) == 1 if long_words else F.lit(True)
    # the runs that contain the gram at place p start at p - (window - 1) .. p
    around = lambda p: F.transform(F.filter(F.sequence(p - (window - 1), p), lambda s: (s >= 0) & (s + run <= F.col("n")) & needed(s, run)), lambda s: _run(s, run))
    found = [F.filter(F.transform(F.array_distinct(least), lambda c: F.struct(c["f"].alias("f"), (-c["p"]).alias("p"), around(-c["p"]).alias("runs"))), lambda m: F.size(m["runs"]) > 0)]
    for width in range(1, run) if long_words else ():
        words = lambda s: sum((F.get("words", s + k) for k in range(1, width)), F.get("words", s))  # noqa: B023, E731
        long = F.transform(F.filter(_starts(width), lambda s: (words(s) >= long_words) & (needed(s, width) if width > 1 else F.lit(True))), lambda s: _run(s, width, width))  # noqa: B023
        found.append(F.transform(long, lambda x: F.struct(x["r"].alias("f"), x["s"].alias("p"), F.array(x).alias("runs"))))
    return lines.withColumn("g", grams).select("id", F.explode(F.concat(*[x.cast(f"array<{_RUN}>") for x in found])).alias("m")).select("id", "m.f", "m.p", "m.runs")


def line_matches(docs: DataFrame, gram: int = 2, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = 50) -> DataFrame:
    """Maximal matches with earlier passages: (id, s, e, first, last, source_id, source_s).

    s to e are places among the lines that are not blank, first to last the text's line numbers, both ends included; the
    same lines stand in source_id from place source_s on, the earliest occurrence of each window. Null ids are sources only.
    """
    number = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), number.alias("lines"))
    columns = [F.col("lines.i").alias("at"), F.transform("lines", lambda s: F.xxhash64(s["x"])).alias("h"), F.size("lines").alias("n")]
    if long_words:
        columns.append(F.transform("lines", lambda s: F.size(F.regexp_extract_all(s["x"], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("words"))
    marks = materialize(_marks(texts.select("id", *columns), gram, window, long_words), "line-marks")
    shared = marks.groupBy("f").agg(F.min(F.struct("id", "p")).alias("a"), F.max(F.struct("id", "p")).alias("b")).where("a <> b").select("f")
    runs = materialize(marks.join(shared, "f").select("id", F.explode("runs").alias("r")).select("id", "r.*"), "line-runs", compact=True)
    heads = runs.groupBy("r").agg(F.min(F.struct("id", "s")).alias("head"), F.max(F.struct("id", "s")).alias("tail")).where("head <> tail").select("r", "head")
    later = runs.join(heads, "r").where(F.col("id").isNotNull() & (F.struct("id", "s") > F.col("head"))).select("id", "s", "e", "first", "last", F.col("head.id").alias("source_id"), F.col("head.s").alias("source_s"))
    # windows on one diagonal that overlap or follow each other are one match
    diagonal = F.col("source_s") - F.col("s")
    along = Window.partitionBy("id").orderBy("source_id", diagonal, "s", "e")
    begins = F.lag("s").over(along).isNull() | ~F.lag("source_id").over(along).eqNullSafe(F.col("source_id")) | (F.lag(diagonal).over(along) != diagonal) | (F.col("s") > F.lag("e").over(along) + 1)
    numbered = later.withColumn("new", begins.cast("int")).withColumn("g", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("source_id").alias("source_id"), F.min("source_s").alias("source_s")).drop("g")


def repeated_lines(docs: DataFrame, gram: int = 2, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = 50) -> DataFrame:
    """(id, gone): the ranges of line numbers that matches with earlier passages cover; ranges that overlap or touch are one."""
    found = line_matches(docs, gram, window, id_col, text_col, long_words)
    order = Window.partitionBy("id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    split = found.withColumn("new", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = split.groupBy("id", "g").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return ranges.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("gone"))


def dedup_lines(docs: DataFrame, gram: int = 2, window: int = 2, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = 50) -> DataFrame:
    """The documents with repeated passages of lines deleted: every column of docs, text_col changed, and n_lines, n_removed, gone.

    A passage is gram + window - 1 or more neighbouring lines, or fewer that have `long_words` words together (None: no such).
    Lines are trimmed of spaces; blank lines do not count and go with the lines around them. A passage is deleted
    wherever it is not its first occurrence in the order of id and line. gone holds the deleted
    ranges of line numbers, from 0, both ends included.

    Defined results: a null text stays null with null counts; an empty text has one line; texts with fewer lines than a
    passage stay as they are unless they are long passages; rows that share an id are neither's earlier copy and lose the same
    lines; a null id sorts first and loses nothing; columns of docs named n_lines, n_removed or gone are replaced; an empty
    table gives no rows.
    """
    found = repeated_lines(docs, gram, window, id_col, text_col, long_words)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "gone")]
    # the columns of docs under names that clash with nothing
    own = docs.select(*[F.col(f"`{c}`").alias(f"doc_{i}") for i, c in enumerate(keep)])
    joined = own.join(found, F.col(f"doc_{keep.index(id_col)}") == F.col("id"), "left")
    text, gone = F.col(f"doc_{keep.index(text_col)}"), F.col("gone")
    lines = F.split(text, "\n", -1)
    # what is kept lies between the deleted ranges
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x["last"] + 1))
    stops = F.concat(F.transform(gone, lambda x: x["first"]), F.array(F.size(lines)))
    parts = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a)))
    removed = F.aggregate(gone, F.lit(0), lambda total, x: total + x["last"] - x["first"] + 1)
    columns = [F.when(gone.isNull(), text).otherwise(F.array_join(parts, "\n")).alias(c) if c == text_col else F.col(f"doc_{i}").alias(c) for i, c in enumerate(keep)]
    return joined.select(*columns, F.when(text.isNotNull(), F.size(lines).cast("long")).alias("n_lines"), F.when(text.isNotNull(), F.coalesce(removed, F.lit(0)).cast("long")).alias("n_removed"), F.coalesce(gone, F.array().cast("array<struct<first:int,last:int>>")).alias("gone"))
