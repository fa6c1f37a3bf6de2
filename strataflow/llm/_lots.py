"""Blocks of a corpus: rows dealt by a hash travel as compressed lots, so that texts cross the network small and once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

#: A message between two blocks should not be smaller than what a shuffle of that size moves anyway: blocks grow with the square
#: root of the corpus, from 8 MB (up to 100 GB) to 256 MB (at 100 TB).
LEAST_BLOCK, LARGEST_BLOCK, GROWTH = 8 << 20, 256 << 20, 25
#: Partitions of a shuffle by block at most; each then handles its blocks one after the other.
MOST_PARTITIONS = 1 << 15


def block_count(total_bytes: int, block_bytes: int | None = None) -> int:
    """How many blocks a corpus of so many bytes has."""
    size = block_bytes or min(max(GROWTH * math.isqrt(total_bytes), LEAST_BLOCK), LARGEST_BLOCK)
    return max(1, math.ceil(total_bytes / size))


def by_block(df: DataFrame, n: int, key: str) -> DataFrame:
    """Dealt by the number of a block, so that a task has a block or two however large the corpus is."""
    return df.repartition(min(n, MOST_PARTITIONS), key)


def packed(schema: pa.Schema, lot_bytes: int = 32 << 20, level: int = 3):
    """For mapInArrow over (block, columns of schema): (block, blob), the rows of each block of a task compressed together."""

    def of(batches):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(table.column("block").to_numpy(), kind="stable")
            blocks = table.column("block").to_numpy()[order]
            at = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
            keys, blobs = [], []
            for a, b in zip(at, [*at[1:], len(blocks)], strict=True):
                part = table.take(pa.array(order[a:b])).select(schema.names).cast(schema)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema) as writer:
                    writer.write_table(part.combine_chunks())
                keys.append(int(blocks[a]))
                blobs.append(zstandard.ZstdCompressor(level=level).compress(sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["block", "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= lot_bytes:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return of


def unpacked(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of a block ordered by all columns, null last: the same each time the block is read."""
    parts = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all() for x in table.column("blob").to_pylist()]
    rows = (pa.concat_tables(parts) if parts else schema.empty_table()).combine_chunks()
    return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in schema.names], null_placement="at_end"))
