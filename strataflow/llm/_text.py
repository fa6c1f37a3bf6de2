"""Vectorised word segmentation and hashing over Arrow string buffers.

Everything here works on the UTF-8 bytes of a whole column at once, so that
hashing the words of a document costs a few nanoseconds a byte and no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1

#: Separators of `[^\x20\x09-\x0D]+`: a byte is one if its entry is True.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
NOT_WORDLIKE = np.zeros(256, dtype=bool)
NOT_WORDLIKE[0x00:0x30] = True
NOT_WORDLIKE[0x3A:0x61] = True
NOT_WORDLIKE[0x7B:0x80] = True

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER_BYTES = LOWER.tobytes()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64((np.arange(1, 257, dtype=np.uint64)) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, factor & _MASK, dtype=np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        return self.up, self.down


_OF_BYTES, _OF_WORDS = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xD1342543DE82EF95)


def rolling(values: np.ndarray, width: int, powers: Powers = _OF_WORDS) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * down[:n])


#: A prime for the second hash: equal modulo 2**64 and modulo this by chance only, whatever the bytes.
PRIME = U64((1 << 31) - 1)


class Residues:
    """Powers of a base and of its inverse modulo PRIME, grown on demand."""

    def __init__(self, base: int) -> None:
        self.factors = base, pow(base, -1, int(PRIME))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            rows = []
            for factor in self.factors:
                row = np.ones(1, dtype=np.uint64)
                while len(row) < max(n, 1 << 16):
                    row = np.concatenate((row, row * U64(pow(factor, len(row), int(PRIME))) % PRIME))
                rows.append(row)
            self.up, self.down = rows
        return self.up, self.down


_BYTES_MOD, _WORDS_MOD = Residues(1_483_651_777), Residues(918_273_645)
_BYTE_MOD = _BYTE % PRIME


def _residues(values: np.ndarray, powers: Residues) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values * base**place, and the inverse powers."""
    up, down = powers.to(len(values) + 1)
    terms = values * up[: len(values)]
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((terms & PRIME) + (terms >> U64(31)), out=sums[1:])
    return sums, down


def rolling_mod(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes modulo PRIME (uint32) of all runs of `width` neighbouring values under PRIME."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    sums, down = _residues(values, _WORDS_MOD)
    return ((sums[width:] - sums[:n]) % PRIME * down[:n] % PRIME).astype(np.uint32)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    size = 8 if large else 4
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32, count=len(column) + 1, offset=column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch | pa.Table, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about `most` bytes of text, one row at least."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        if not part.num_rows:
            continue
        _, at = buffers(part.column(column))
        row = 0
        while row < part.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield part.slice(row, stop - row)
            row = stop


class Words:
    """Words of a string column: byte spans, hashes and the words of each row."""

    def __init__(self, column: pa.Array, separators: np.ndarray = WHITESPACE, lower: bool = False) -> None:
        data, self.at = buffers(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        else:
            inside = ~separators[self.data]
            heads = self.at[:-1][self.at[:-1] < n]
            before = np.empty(n, dtype=bool)
            before[0], before[1:] = False, inside[:-1]
            before[heads] = False
            after = np.empty(n, dtype=bool)
            after[-1], after[:-1] = False, inside[1:]
            after[heads[heads > 0] - 1] = False
            self.starts = np.flatnonzero(inside & ~before)
            self.ends = np.flatnonzero(inside & ~after) + 1
        #: Row r has words first[r] to first[r + 1].
        self.first = np.searchsorted(self.starts, self.at)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())

    def residues(self) -> np.ndarray:
        """Hashes of the words modulo PRIME, as uint64."""
        sums, down = _residues(_BYTE_MOD[self.data], _BYTES_MOD)
        return (sums[self.ends] - sums[self.starts]) % PRIME * down[self.starts] % PRIME

    def hashes(self, residues: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words: a polynomial modulo 2**64, one modulo PRIME and the length, mixed."""
        n = len(self.data)
        up, down = _OF_BYTES.to(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=sums[1:])
        second = self.residues() if residues is None else residues
        return mix64((sums[self.ends] - sums[self.starts]) * down[self.starts] + mix64((second << U64(32)) + (self.ends - self.starts).astype(np.uint64)))


def window_heads(first: np.ndarray, width: int) -> np.ndarray:
    """Word indexes at which a whole window of `width` words of one row starts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)


def covered(heads: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a window that starts at one of `heads`."""
    edge = np.bincount(heads, minlength=total + 1) - np.bincount(heads + width, minlength=total + 1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.concatenate(([False], flags, [False]))
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]
