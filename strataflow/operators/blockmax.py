"""Top-k search over postings in blocks, each with the most that it can add to a score: blocks that can't reach the top are not scored.

Documents are sorted by their most frequent tokens, then by length, and cut into blocks of neighbours: documents of one language
or subject stand together, so most lists have few blocks, and those have tight bounds. A block is one row: its documents, and its part
of each list with the part's bound. A search moves no posting and no bound: a task adds up the bounds of its blocks and gives each
query's few best; these are scored, and the k-th score found is the least that counts; then each task scores those of its blocks whose
bound reaches it and gives each query's best documents. No block that is left out can hold a document of the result, so the rows are
those of a search through everything. What travels with the tasks is a shard of the queries (`scan.PAIRS`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataflow.functions.session import cut, ship
from strataflow.operators import scan
from strataflow.operators.retrieval import K1, B, tokens, top_k

#: Scores are compared after rounding to nine digits; a bound must not lose a document to that.
_SLACK = 1e-8
#: Postings in a range of documents, on average.
RANGE = 500_000


def _weight(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """A posting's score but for the token's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@contextmanager
def _few_at_a_time(spark: SparkSession) -> Iterator[None]:
    """For what is run within: texts' tokens and blocks are long rows, of which Spark would hold thousands in each task, in Arrow as in Parquet."""
    conf = {"spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from starts[i] on, counts[i] of them, for one i after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _ends(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Where each row's values begin among all of the batch, and where the last ends."""
    return np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _terms(batch: pa.RecordBatch, terms: list[str]) -> np.ndarray:
    """The number of each list's token among terms, or -1."""
    flat = batch.column("token").flatten()
    return pc.fill_null(pc.index_in(flat, pa.array(terms, flat.type)), -1).to_numpy(zero_copy_only=False)


def _bounds(sent, probe: int):
    """Of the blocks (block, token, most) of a task each query's best: (q, block, bound), q its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, starts, queries, names = sent.value
        best, fan = scan.Best(probe, len(names)), np.diff(starts)
        for batch in batches:
            term, ends = _terms(batch, terms), _ends(batch, "token")
            known = np.flatnonzero(term >= 0)
            row, term = np.searchsorted(ends, known, "right") - 1, term[known]
            scan.add_scores(best, batch.column("block"), row, idf[term] * _flat(batch, "most")[known], starts[term], fan[term], queries)
        found = best.settle()
        if found is not None:
            yield from found.select(["query", "doc", "score"]).rename_columns(["q", "block", "bound"]).combine_chunks().to_batches()

    return run


def _scores(sent, least, names_type: pa.DataType, doc_type: pa.DataType, top: int, avgdl: float):
    """Scores a task's blocks for the queries whose least score a block's bound reaches, or those of them in its row (asked, numbers).

    The best documents of each query (q, query, doc, score), and a row without document for each query: the postings of its lists and how many were read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, starts, queries, names = sent.value
        best, fan, out = scan.Best(top, len(names)), np.diff(starts), pa.array(names, names_type)
        best.edge = least.value.copy()
        seen, read = np.zeros(len(names)), np.zeros(len(names))

        def add(batch: pa.RecordBatch, hits: list[tuple[np.ndarray, ...]]) -> None:
            # many blocks' documents at once: a table for each would take more than they do
            if hits:
                query, doc, score = (np.concatenate(c) for c in zip(*hits, strict=True))
                best.add(query, batch.column("doc").flatten().take(pa.array(doc)), score)

        for batch in batches:
            term, most, n, tf, at, dl = _terms(batch, terms), *(_flat(batch, c) for c in ("most", "n", "tf", "at", "dl"))
            lists, runs, first = _ends(batch, "token"), _ends(batch, "dl"), np.cumsum(n, dtype=np.int64) - n
            hits, pending = [], 0
            for b in range(batch.num_rows):
                h = lists[b] + np.flatnonzero(term[lists[b] : lists[b + 1]] >= 0)
                t, size = term[h], runs[b + 1] - runs[b]
                of, asked = np.repeat(h, fan[t]), queries[_spans(starts[t], fan[t])]
                bound = np.bincount(asked, weights=np.repeat(idf[t] * most[h], fan[t]), minlength=len(names))
                seen += np.bincount(asked, weights=n[of], minlength=len(names))
                reach = (bound > 0) & (bound >= best.edge - _SLACK)
                if "asked" in batch.schema.names:
                    reach &= np.isin(np.arange(len(names)), batch.column("asked")[b].values.to_numpy())
                keep = reach[asked]
                of, asked, own = of[keep], asked[keep], n[of[keep]].astype(np.int64)
                if not len(of):
                    continue
                read += np.bincount(asked, weights=own, minlength=len(names))
                wanted = np.flatnonzero(reach)
                number, total, sums, lo = np.cumsum(reach) - 1, np.cumsum(own), np.zeros(len(wanted) * size), 0
                while lo < len(of):  # a few million partial scores at a time
                    hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + scan.AT_ONCE, "right")))
                    part, many = of[lo:hi], own[lo:hi]
                    post = _spans(first[part], many)
                    weight = np.repeat(idf[term[part]], many) * _weight(tf[post].astype(np.float64), dl[runs[b] + at[post]], avgdl)
                    sums += np.bincount(np.repeat(number[asked[lo:hi]], many) * size + at[post], weights=weight, minlength=len(sums))
                    lo = hi
                hit = np.flatnonzero(sums)
                hit = hit[sums[hit] >= best.edge[wanted[hit // size]] - 2e-9]
                hits.append((wanted[hit // size], runs[b] + hit % size, sums[hit]))
                pending += len(hit)
                if pending > scan.AT_ONCE // 8:
                    add(batch, hits)
                    hits, pending = [], 0
            add(batch, hits)
        met, found = np.flatnonzero(seen), best.settle()
        shape = pa.schema([("q", pa.int64()), ("query", names_type), ("doc", doc_type), ("score", pa.float64()), ("postings", pa.int64()), ("read", pa.int64())])
        none = lambda k, kind: pa.nulls(k, kind)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met), out.take(pa.array(met)), none(len(met), doc_type), none(len(met), pa.float64()), pa.array(seen[met].astype(np.int64)), pa.array(read[met].astype(np.int64))], schema=shape)
        if found is not None and found.num_rows:
            q, doc, score = (found.column(c).combine_chunks() for c in ("query", "doc", "score"))
            yield pa.RecordBatch.from_arrays([q, out.take(q), doc, score, none(len(q), pa.int64()), none(len(q), pa.int64())], schema=shape)

    return run


@dataclass
class BlockIndex:
    """Blocks of documents: (block, doc, dl) and by token the part of its list (token, most, n), whose postings (at: the document's place, tf) follow each other."""

    blocks: DataFrame
    n_docs: int
    avgdl: float

    def search(self, queries: DataFrame, query_key: str, query_text: str, top: int = 10, probe: int | None = None, tokenize=tokens) -> DataFrame:
        """The rows of bm25: (query, doc, score, rank)."""
        return self.searched(queries, query_key, query_text, top, probe, tokenize)[0]

    def searched(self, queries: DataFrame, query_key: str, query_text: str, top: int = 10, probe: int | None = None, tokenize=tokens) -> tuple[DataFrame, DataFrame]:
        """The result, and for each query how many postings its lists have and how many were read: (query, postings, read)."""
        spark = self.blocks.sparkSession
        ship(spark)
        asked = cut(queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokenize(F.coalesce(F.col(query_text), F.lit(""))))).alias("term")).distinct())
        n_shards = max(1, -(-asked.count() // scan.PAIRS))
        name, doc = asked.schema["query"].dataType, self.blocks.schema["doc"].dataType.elementType
        shape = f"q long, query {name.simpleString()}, doc {doc.simpleString()}, score double, postings long, read long"
        found = spark.createDataFrame([], shape)
        with _few_at_a_time(spark):
            for k in range(n_shards):
                rows = self._shard(asked.where(F.pmod(F.xxhash64("query"), F.lit(n_shards)) == k), shape, (to_arrow_type(name), to_arrow_type(doc)), top, probe or max(4, top // 2))
                found = found if rows is None else found.unionByName(rows)
            found = cut(found)
        cost = found.where(F.col("postings").isNotNull()).groupBy("query").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))
        return top_k(found.where(F.col("score").isNotNull()).select("query", "doc", "score"), "query", F.round("score", 9), "doc", top), cost

    def _shard(self, part: DataFrame, shape: str, kinds: tuple[pa.DataType, pa.DataType], top: int, probe: int) -> DataFrame | None:
        """Each task's best documents for the queries of a shard, and a row for each query with its postings and how many were read."""
        spark = part.sparkSession
        terms, names, starts, numbers = scan.numbered(part)
        if not terms:
            return None
        # lists that no query asks for go before anything is shuffled
        heads = self.blocks.select(F.explode(F.arrays_zip("token", "n")).alias("l")).select(F.col("l.token").alias("term"), F.col("l.n").alias("n"))
        found = {r["term"]: r["df"] for r in heads.join(F.broadcast(part.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).collect()}
        df = np.array([found.get(t, 0) for t in terms], dtype=np.float64)
        sent = spark.sparkContext.broadcast((terms, np.log(1 + (self.n_docs - df + 0.5) / (df + 0.5)), starts, numbers, names))
        bounds = self.blocks.select("block", "token", "most").mapInArrow(_bounds(sent, probe), "q long, block long, bound double")
        first = cut(top_k(bounds, "q", F.col("bound"), "block", probe).groupBy("block").agg(F.collect_list("q").alias("asked")))
        scored = lambda rows, least: rows.mapInArrow(_scores(sent, spark.sparkContext.broadcast(least), *kinds, top, self.avgdl), shape)
        # at most `probe` blocks for each query of the shard
        begun = cut(scored(self.blocks.join(F.broadcast(first), "block"), np.full(len(names), -np.inf)))
        # the k-th score of the blocks looked at so far; fewer documents than k set no limit
        least = np.full(len(names), -np.inf)
        for r in top_k(begun.where(F.col("score").isNotNull()), "q", F.round("score", 9), "doc", top).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("k")).where(F.col("k") >= top).collect():
            least[r["q"]] = r["least"]
        # what was read for the limit counts as read too; its postings are among those of the whole
        return scored(self.blocks, least).unionByName(begun.where(F.col("postings").isNotNull()).withColumn("postings", F.lit(0).cast("long")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc, t) with each token once: (doc, dl, first, second, token, tf). first: the most frequent, second: that with the most characters in all."""
    for batch in batches:
        runs = batch.column("t")
        flat, dl = runs.flatten().dictionary_encode(), pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
        words, place = flat.dictionary.take(pc.sort_indices(flat.dictionary)), pc.rank(flat.dictionary).to_numpy().astype(np.int64) - 1
        n = max(1, len(words))
        pairs, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * n + place[flat.indices.to_numpy()], return_counts=True)
        row, word = pairs // n, pairs % n
        begins = np.searchsorted(row, np.arange(len(dl) + 1))
        some = np.flatnonzero(np.diff(begins))
        length = pc.utf8_length(words).to_numpy()

        def most(weight: np.ndarray, word=word, begins=begins, some=some, n=n, words=words, rows=len(dl)) -> pa.Array:
            best = np.full(rows, -1)
            best[some] = np.maximum.reduceat(weight * n + word, begins[some]) % n if len(some) else 0
            return words.take(pa.array(best, mask=best < 0))

        offsets = pa.array(begins, pa.int32())
        columns = [batch.column("doc"), pa.array(dl, pa.int32()), most(tf), most(tf * length[word]), pa.ListArray.from_arrays(offsets, words.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "dl", "first", "second", "token", "tf"])


def _inverted(avgdl: float):
    """Blocks of the documents (block, doc, dl, token, tf) of a partition, whose rows stand together: nothing has to be shuffled for them."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        block, doc, dl = (rows.column(c).combine_chunks() for c in ("block", "doc", "dl"))
        runs = rows.column("token").combine_chunks()
        number, d = block.to_numpy(), dl.to_numpy().astype(np.float64)
        begins = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1))
        of = np.repeat(np.arange(len(begins)), np.diff(np.concatenate((begins, [len(number)]))))
        flat = runs.flatten().dictionary_encode()
        code = pc.rank(flat.dictionary).to_numpy().astype(np.int64)[flat.indices.to_numpy()] - 1
        row = np.repeat(np.arange(len(number)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
        key = of[row] * len(flat.dictionary) + code
        order = np.argsort(key, kind="stable")
        key, row, tf = key[order], row[order], rows.column("tf").combine_chunks().flatten().to_numpy()[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        most = np.maximum.reduceat(_weight(tf.astype(np.float64), d[row], avgdl), starts)
        lists = np.searchsorted(of[row[starts]], np.arange(len(begins) + 1))
        posts = np.concatenate((starts, [len(key)]))[lists]
        n = np.diff(np.concatenate((starts, [len(key)])))
        token = flat.take(pa.array(order[starts])).cast(pa.string())
        listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        docs = np.concatenate((begins, [len(number)]))
        columns = [block.take(pa.array(begins)), listed(docs, doc), listed(docs, dl), listed(lists, token), listed(lists, pa.array(most)), listed(lists, pa.array(n, pa.int32())), listed(posts, pa.array(row - begins[of[row]], pa.int32())), listed(posts, pa.array(tf, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc", "dl", "token", "most", "n", "at", "tf"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            rows = own if held is None else pa.concat_tables([held, own])
            last = pc.equal(rows.column("block"), batch.column("block")[-1])  # more of this block may follow
            done, held = rows.filter(pc.invert(last)), rows.filter(last)
            if done.num_rows:
                yield out(done)
        if held is not None and held.num_rows:
            yield out(held)

    return of


def block_index(docs: DataFrame, key: str, text: str, block_docs: int = 32, tokenize=tokens) -> BlockIndex:
    """The blocks of a corpus in the shared folder. A block has at most block_docs documents, so no row grows with the corpus.

    Null and empty texts are documents without postings; a row is a document of its own, so keys should not repeat.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(key).alias("doc"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    kind = own.schema["doc"].dataType.simpleString()
    with _few_at_a_time(docs.sparkSession):
        # texts are cut once; the ranges are drawn from what was counted
        counts = cut(own.mapInArrow(_counted, f"doc {kind}, dl int, first string, second string, token array<string>, tf array<int>"))
        n, avg, postings = counts.agg(F.count("*"), F.avg("dl"), F.sum(F.size("token"))).first()
        avgdl = float(avg or 0) or 1.0
        order = ["first", "second", "dl", "doc"]
        # long documents stand together, so ranges of as many rows differ in size: their number follows the postings
        ranges = max(1, -(-(postings or 0) // RANGE))
        ranged = counts.where("dl > 0").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        # numbers run on within a partition, so a block ends with its partition at the latest
        placed = ranged.select(F.floor(F.monotonically_increasing_id() / block_docs).alias("block"), "doc", "dl", "token", "tf")
        return BlockIndex(cut(placed.mapInArrow(_inverted(avgdl), f"block long, doc array<{kind}>, dl array<int>, token array<string>, most array<double>, n array<int>, at array<int>, tf array<int>")), n, avgdl)
