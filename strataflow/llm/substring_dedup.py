"""Substring dedup: every fixed-length token window is hashed (Rabin-Karp) and counted across the corpus.

Plan
----
1. Documents are dealt into blocks by a hash of id and text. A block hashes all its windows and keeps each hash
   once, with the smallest document id that has it (the map-side combine: a window that a third of
   the corpus shares is one entry per block).
2. The entries are dealt by hash into buckets; a bucket counts each hash over all
   blocks and answers every entry with one bit: does a smaller document have it?
3. The blocks read their documents again, apply the bits, merge repeated windows into
   maximal intervals, and cut the words in them.

Two windows are equal if two independent hashes of them are: a polynomial modulo 2**64 over the words' 64-bit hashes, and one
modulo a prime over the words' hashes modulo that prime, 95 bits together. At 10**13 windows one false match is expected in some
hundred corpora of that size; bytes that are made to collide modulo 2**64 differ in the other.

Shuffled: the texts once, compressed; twelve bytes per different window of a block, one bit back. Blocks grow with the square root
of the corpus and partitions with the number of blocks. Nothing is broadcast or collected, and no pair of documents is ever made.

A pass over blocks is deterministic (rows are ordered by id and text), so a lost
executor's work can be redone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._lots import block_count, by_block, packed, unpacked
from strataflow.llm._shared import bounded, text_bytes
from strataflow.llm._text import Words, chunks, covered, rolling, rolling_mod, runs, window_heads

_ENTRIES = "bucket int, block int, hashes binary, docs binary"
_ANSWERS = "block int, bucket int, bits binary"
_SPANS = "array<struct<start:int,end:int>>"
_NO_ID = np.iinfo(np.int64).max
_ROW = pa.schema([("id", pa.int64()), ("text", pa.string())])


def _windows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of a block's windows, their ids (null: largest) and word positions, and all rows' first words."""
    hashes, checks, ids, heads, first, base = [], [], [], [], [np.zeros(1, dtype=np.int64)], 0
    for part in chunks(table, "text"):
        words = Words(part.column("text"))
        at = window_heads(words.first, width)
        row = np.repeat(np.arange(part.num_rows), np.maximum(words.counts() - width + 1, 0))
        own = part.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        residues = words.residues()
        hashes.append(rolling(words.hashes(residues), width)[at])
        checks.append(rolling_mod(residues, width)[at])
        ids.append(own[row])
        heads.append(at + base)
        first.append(words.first[1:] + base)
        base += len(words)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return join(hashes, np.uint64), join(checks, np.uint32), join(ids, np.int64), join(heads, np.int64), np.concatenate(first)


def _groups(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where in it each group begins."""
    order = np.argsort(hashes)
    ranked, second = hashes[order], checks[order]
    same = ranked[1:] == ranked[:-1]
    if (same & (second[1:] != second[:-1])).any():
        order = np.lexsort((checks, hashes))
        ranked, second = hashes[order], checks[order]
        same = (ranked[1:] == ranked[:-1]) & (second[1:] == second[:-1])
    return order, np.flatnonzero(np.concatenate((np.ones(min(len(order), 1), dtype=bool), ~same)))


def _distinct(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first occurrence of each window, and for every window the rank of its first among them.

    First occurrences come in window order, so their ids ascend.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order, heads = _groups(hashes, checks)
    firsts = np.minimum.reduceat(order, heads)
    is_first = np.zeros(len(hashes), dtype=bool)
    is_first[firsts] = True
    rank = np.empty(len(hashes), dtype=np.int64)
    rank[order] = np.repeat((np.cumsum(is_first) - 1)[firsts], np.diff(np.append(heads, len(hashes))))
    return np.flatnonzero(is_first), rank


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as compressed runs."""
    new = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    values = ids[new]
    body = np.concatenate(([len(values)], values[:1], np.diff(values), np.diff(np.concatenate((new, [len(ids)])))))
    return zstandard.ZstdCompressor(level=1).compress(body.astype(np.int64).tobytes())


def _unpack_ids(packed: bytes) -> np.ndarray:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.int64)
    n = int(body[0])
    return np.repeat(np.cumsum(body[1 : n + 1]), body[n + 1 :])


def _entries(width: int, buckets: int):
    def of_block(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        hashes, checks, ids, _, _ = _windows(unpacked(table, _ROW), width)
        kept, _ = _distinct(hashes, checks)
        hashes, checks, ids = hashes[kept], checks[kept], ids[kept]
        bucket = _dealt(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        found = [(b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b + 1] > bounds[b]]
        return pa.table({
            "bucket": pa.array([b for b, _ in found], pa.int32()),
            "block": pa.array([block] * len(found), pa.int32()),
            "hashes": pa.array([hashes[x].tobytes() + checks[x].tobytes() for _, x in found], pa.binary()),
            "docs": pa.array([_pack_ids(ids[x]) for _, x in found], pa.binary()),
        })

    return of_block


def _answers(table: pa.Table) -> pa.Table:
    """Counts the hashes of a bucket; a bit per entry: a smaller document has this window."""
    blobs = table.column("hashes").to_pylist()
    sizes = [len(x) // 12 for x in blobs]
    hashes = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=n) for x, n in zip(blobs, sizes, strict=True)])
    checks = np.concatenate([np.frombuffer(x, dtype=np.uint32, count=n, offset=8 * n) for x, n in zip(blobs, sizes, strict=True)])
    ids = np.concatenate([_unpack_ids(x) for x in table.column("docs").to_pylist()])
    order, heads = _groups(hashes, checks)
    least = np.minimum.reduceat(ids[order], heads)
    flags = np.empty(len(hashes), dtype=bool)
    flags[order] = ids[order] > np.repeat(least, np.diff(np.append(heads, len(hashes))))
    ends = np.cumsum(sizes)
    bits = [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _cut(width: int, buckets: int):
    def of_block(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string()))})
        table = unpacked(table, _ROW)
        hashes, checks, ids, heads, first = _windows(table, width)
        kept, rank = _distinct(hashes, checks)
        bucket = _dealt(hashes[kept], buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        packed = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        flags = np.zeros(len(kept), dtype=bool)
        flags[order] = np.concatenate([np.unpackbits(np.frombuffer(packed[b], dtype=np.uint8), count=int(sizes[b])) for b in range(buckets) if sizes[b]] or [np.zeros(0)]).astype(bool)
        # an earlier block has it, or an earlier document of this one
        repeated = flags[rank] | (ids > ids[kept][rank]) if len(hashes) else np.zeros(0, dtype=bool)
        gone = covered(heads[repeated], width, int(first[-1]))
        totals = np.concatenate(([0], np.cumsum(gone)))
        removed = totals[first[1:]] - totals[first[:-1]]
        texts, spans = [], []
        for row, text in enumerate(table.column("text").to_pylist()):
            words = text.encode().split() if text else []
            if removed[row]:
                own = gone[first[row] : first[row + 1]]
                starts, ends = runs(own)
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
                pieces, at = [], 0
                for a, b in zip(starts, ends, strict=True):
                    pieces += words[at:a]
                    at = b
                words = pieces + words[at:]
            else:
                spans.append([])
            texts.append(b" ".join(words).decode())
        return pa.table({
            "id": table.column("id"),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept_text": pa.array(texts, pa.string()),
        })

    return of_block


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Cuts every word covered by a window of `width` words that also starts in a document with a smaller id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Windows are judged on the input, so a copy loses a
    passage even where an earlier copy loses it too. Returns id_col, n_words, n_removed, spans (maximal
    intervals of removed words, end exclusive) and kept_text (kept words joined by one space).

    Defined results: a null or empty text has no words and an empty kept_text; a text shorter than a
    window is kept whole; rows that share an id never remove each other's words; a null id counts as
    the largest id; other columns are ignored, whatever their names; an empty table gives no rows.

    `block_bytes` bounds the memory of a task (about twelve times as much); by default it grows with the square root of the
    corpus, from 8 MB to 256 MB at 100 TB, so that the number of block-to-bucket messages stays that of an ordinary shuffle.
    Rows with a null id are dealt by their texts like all others.
    """
    bounded(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = block_count(text_bytes(own), block_bytes)
    lots = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).select("block", "id", "text").mapInArrow(packed(_ROW), "block int, blob binary")
    blocked = by_block(lots, n, "block")
    entries = by_block(blocked.groupBy("block").applyInArrow(_entries(width, n), _ENTRIES), n, "bucket")
    answers = by_block(entries.groupBy("bucket").applyInArrow(_answers, _ANSWERS), n, "block")
    result = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut(width, n), f"id long, n_words long, n_removed long, spans {_SPANS}, kept_text string")
    return result.withColumnRenamed("id", id_col)
