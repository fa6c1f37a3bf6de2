"""What is gathered for a question: which providers are asked, what they give in turn, the packet that fits, why each item is in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.questions import question_type
from strataflow.operators.retrieval import packed

#: Providers by type of question, the first to be asked first; others ask the text alone.
PROVIDERS: dict[str, tuple[str, ...]] = {
    "threshold": ("facts", "text"), "list_count": ("facts", "text"), "exact_constant": ("facts", "text"), "fallback_chain": ("facts", "text", "graph"), "config_surface": ("facts", "text"), "prompt_template": ("facts", "text"),
    "dependency_injection": ("facts", "graph", "text"), "symbol_location": ("symbols", "text"), "impact_analysis": ("graph", "text", "symbols"), "change_impact_prediction": ("graph", "text"), "refactoring_analysis": ("graph", "text"),
    "architecture_analysis": ("text", "graph"), "onboarding_analysis": ("text", "symbols"), "behavior_explanation": ("text", "symbols", "graph"), "test_query": ("text", "symbols"),
}


def planned(questions: DataFrame) -> DataFrame:
    """(query, type, provider, place): the providers to ask for questions (query, text), in order."""
    kind = question_type(F.col("text"))
    providers = F.array(F.lit("text"))
    for name, own in PROVIDERS.items():
        providers = F.when(F.col("type") == name, F.array(*[F.lit(p) for p in own])).otherwise(providers)
    return questions.withColumn("type", kind).select("query", "type", F.posexplode(providers).alias("place", "provider"))


def raw_evidence(plan: DataFrame, found: DataFrame, cap: int = 50) -> DataFrame:
    """(query, place, provider, id): what the planned providers found (query, provider, rank, id), in turn, each id once, `cap` a question."""
    own = found.join(plan.select("query", "provider", F.col("place").alias("turn")), ["query", "provider"])
    first = own.groupBy("query", "id").agg(F.min_by(F.struct("rank", "turn", "provider"), F.struct("rank", "turn")).alias("b")).select("query", "id", "b.*")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "turn", "id"))
    return first.withColumn("place", place).where(F.col("place") <= cap).select("query", "place", "provider", "id")


def evidence_packet(raw: DataFrame, contents: DataFrame, budget: int = 7000) -> DataFrame:
    """(query, place, id): raw evidence whose contents (id, chars) fit a token budget, first come first, what is too long skipped."""
    rows = raw.join(contents, "id").select("query", F.col("id"), (-F.col("place")).cast("double").alias("score"), "chars")
    return packed(rows, "query", budget).select("query", (F.col("place") + 1).alias("place"), "id")


def selection(plan: DataFrame, found: DataFrame, raw: DataFrame, packet: DataFrame) -> DataFrame:
    """(query, provider, id, rank, reason) of everything found: selected, duplicate (another provider's find was taken), over cap, over budget, or not planned."""
    rows = found.join(plan.select("query", "provider", F.lit(True).alias("asked")), ["query", "provider"], "left")
    rows = rows.join(raw.select("query", "id", F.col("provider").alias("by")), ["query", "id"], "left").join(packet.select("query", "id", F.lit(True).alias("kept")), ["query", "id"], "left")
    reason = F.when(F.col("asked").isNull(), "not planned").when(F.col("by").isNull(), "over cap").when(F.col("by") != F.col("provider"), "duplicate").when(F.col("kept").isNull(), "over budget").otherwise("selected")
    return rows.select("query", "provider", "id", "rank", reason.alias("reason"))


def last_evidence(packets: DataFrame) -> DataFrame:
    """The evidence (session, at, query, id) of each session's latest question."""
    newest = packets.groupBy("session").agg(F.max(F.struct("at", "query")).alias("n"))
    return packets.join(newest, "session").where((F.col("at") == F.col("n.at")) & (F.col("query") == F.col("n.query"))).select("session", "query", "id")


def answer_outline(packet: DataFrame, contents: DataFrame, questions: DataFrame, gaps: DataFrame, sentences_each: int = 1) -> DataFrame:
    """(query, outcome, text): what can be answered without a model: the first sentences of each piece of evidence with its id, or that there is none.

    Fewer than three pieces, or gaps (query, gap), are thin: revise. A model's text takes the place of `text` where one is at hand.
    """
    first = F.array_join(F.slice(F.split("text", r"(?<=[.!?])\s+"), 1, sentences_each), " ")
    lines = packet.join(contents.select("id", first.alias("s")), "id").groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "s"))), lambda x: F.concat(F.lit("["), x["id"].cast("string"), F.lit("] "), x["s"])).alias("lines"))
    missing = gaps.groupBy("query").agg(F.count("*").alias("gaps"))
    rows = questions.select("query").join(lines, "query", "left").join(missing, "query", "left")
    thin = (F.size(F.coalesce("lines", F.array().cast("array<string>"))) < 3) | (F.coalesce("gaps", F.lit(0)) > 0)
    return rows.select("query", F.when(F.col("lines").isNull(), "abstain").when(thin, "revise").otherwise("pass").alias("outcome"), F.when(F.col("lines").isNull(), "The evidence does not answer this.").otherwise(F.array_join("lines", "\n")).alias("text"))


def plan_tasks(documents: DataFrame) -> DataFrame:
    """(doc, line, text, done, files): tasks of plan documents (doc, text): list items with a box or a number, and the files they name in backticks."""
    rows = documents.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    item = r"^\s*(?:[-*]\s+\[([ xX])\]|\d+[.)])\s+(.+?)\s*$"
    own = rows.where(F.col("t").rlike(item))
    files = F.array_distinct(F.regexp_extract_all("t", F.lit(r"`([\w./-]+\.\w+)`"), F.lit(1)))
    return own.select("doc", (F.col("line") + 1).alias("line"), F.regexp_extract("t", item, 2).alias("text"), (F.lower(F.regexp_extract("t", item, 1)) == "x").alias("done"), files.alias("files"))


def plan_analysis(tasks: DataFrame, units: DataFrame, low: float = 0.15, high: float = 0.4) -> DataFrame:
    """(task, similarity, status): tasks (task, words, files) against units (unit, words, file): .55 the Jaccard of words and .45 whether the unit's file is named.

    Only pairs that can reach `low` meet: pairs of one file, or that share one of the rarest words that a Jaccard of low / .55 needs. Below
    `low` a task is missing, with similarity 0; from `high` on it is done, else partial.
    """
    least = low / 0.55
    df = units.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame, key: str) -> DataFrame:
        ordered = rows.select(key, F.size("words").alias("n"), F.explode("words").alias("w")).join(df, "w", "left").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "w")))
        return ordered.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(key, "w")

    by_word = rare(tasks, "task").join(rare(units, "unit"), "w").select("task", "unit")
    by_file = tasks.select("task", F.explode("files").alias("file")).join(units.select("unit", "file"), "file").select("task", "unit")
    pairs = by_word.unionByName(by_file).distinct().join(tasks.select("task", "words", "files"), "task").join(units.select("unit", F.col("words").alias("own"), "file"), "unit")
    both, either = F.size(F.array_intersect("words", "own")), F.size(F.array_union("words", "own"))
    score = 0.55 * F.when(either == 0, 0.0).otherwise(both / either) + 0.45 * F.array_contains("files", F.col("file")).cast("int")
    best = pairs.withColumn("s", score).where(F.col("s") >= low).groupBy("task").agg(F.max("s").alias("similarity"))
    rows = tasks.select("task").join(best, "task", "left").fillna({"similarity": 0.0})
    return rows.withColumn("status", F.when(F.col("similarity") >= high, "done").when(F.col("similarity") >= low, "partial").otherwise("missing"))


def investigations(paths: dict[str, DataFrame], most: int = 10) -> DataFrame:
    """(query, id, paths, best): evidence (query, id, rank) of several ways to look into a question, each cut to `most`: which ways found it, and its best rank."""
    rows = reduce(DataFrame.unionByName, [t.where(F.col("rank") <= most).select("query", "id", "rank", F.lit(name).alias("path")) for name, t in paths.items()])
    return rows.groupBy("query", "id").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.min("rank").alias("best"))


def hypotheses(found: DataFrame, most: int = 3) -> DataFrame:
    """The `most` likeliest causes of each question: what most ways found, then by rank: (query, id, support, place)."""
    ranked = found.withColumn("support", F.size("paths")).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.size("paths").desc(), "best", "id")))
    return ranked.where(F.col("place") <= most).select("query", "id", "support", "place")


def error_anchors(text: Column) -> Column:
    """(kind, file, line): what an error's output points to: its kind by words, and the last frame of a traceback or the first place named."""
    kind = F.when(text.rlike(r"(?i)ModuleNotFoundError|ImportError|cannot find module"), "import").when(text.rlike(r"(?i)SyntaxError|unexpected token|IndentationError"), "syntax").when(text.rlike(r"(?i)TypeError|type mismatch"), "type").when(text.rlike(r"(?i)assert|expected .* (to|but)"), "assertion").when(text.rlike(r"(?i)timeout|timed out"), "timeout").when(text.rlike(r"(?i)ECONNREFUSED|connection refused"), "connection").when(text.rlike(r"(?i)permission denied|EACCES"), "permission").when(text.rlike(r"(?i)error|exception|failed"), "runtime").otherwise("unknown")
    frames = F.regexp_extract_all(text, F.lit(r'File "([^"]+)", line \d+'), F.lit(1))
    at = F.regexp_extract_all(text, F.lit(r'File "[^"]+", line (\d+)'), F.lit(1))
    plain = r"([\w./-]+\.\w+):(\d+)"
    has = F.size(frames) > 0
    return F.struct(kind.alias("kind"), F.when(has, F.element_at(frames, -1)).otherwise(F.nullif(F.regexp_extract(text, plain, 1), F.lit(""))).alias("file"), F.when(has, F.element_at(at, -1)).otherwise(F.nullif(F.regexp_extract(text, plain, 2), F.lit(""))).cast("int").alias("line"))
