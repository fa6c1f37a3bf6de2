"""Quality rules: compression bands. Texts that compress too well repeat themselves, texts that hardly compress are noise.

The whole text and its fixed chunks are compressed with Zstandard; each ratio (compressed over raw bytes)
has to lie in the band of the text's length. Short texts compress badly whatever they say, so bands are
by length, and a language may have its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded
from strataflow.llm._text import WHITESPACE, Words, chunks, mix64, rolling, window_heads

#: (bytes up to which a band holds, least ratio, largest ratio) in ascending order; the last holds for all longer texts. A frame
#: of Zstandard has some ten bytes of its own, so under 64 bytes the ratio says nothing.
#: Upper limits lie between prose and the base64 of random bytes (0.91 at 328 bytes, 0.81 at 812, 0.77 at 2,560, 0.76 beyond).
DOCUMENT_BANDS: tuple[tuple[int, float, float], ...] = ((64, 0.0, 1e9), (128, 0.42, 1.25), (256, 0.42, 1.10), (400, 0.36, 0.86), (1024, 0.36, 0.79), (4096, 0.33, 0.74), (16384, 0.30, 0.72), (1 << 62, 0.25, 0.70))
CHUNK_BANDS: tuple[tuple[int, float, float], ...] = ((64, 0.0, 1e9), (256, 0.0, 2.0), (400, 0.30, 0.86), (1024, 0.30, 0.79), (1 << 62, 0.27, 0.74))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, least_chunk_ratio double, largest_chunk_ratio double, base_failed boolean, verdict string, kept boolean"


def _band(bands: Sequence[tuple[int, float, float]], size: int) -> tuple[float, float]:
    return next((low, high) for upto, low, high in bands if size <= upto)


def _repeated(words: Words, width: int) -> np.ndarray:
    """Words of each row that lie in a window of `width` words found twice or more in the row."""
    heads = window_heads(words.first, width)
    if not len(heads):
        return np.zeros(len(words.first) - 1, dtype=np.int64)
    row = np.searchsorted(words.first, heads, "right") - 1
    keys = mix64(rolling(words.hashes(), width)[heads] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.bincount(heads[twice], minlength=len(words) + 1) - np.bincount(heads[twice] + width, minlength=len(words) + 1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return total[words.first[1:]] - total[words.first[:-1]]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[at[1:]] - total[at[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def quality_rules(
    docs: DataFrame, chunk_bytes: int = 4096, least_tail: int = 256, level: int = 3, document_bands: Sequence[tuple[int, float, float]] = DOCUMENT_BANDS, chunk_bands: Sequence[tuple[int, float, float]] = CHUNK_BANDS, by_lang: Mapping[str, tuple[Sequence[tuple[int, float, float]], Sequence[tuple[int, float, float]]]] | None = None, least_words: int = 20, repeat_width: int = 8, most_repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", carry: Sequence[str] = (),
) -> DataFrame:
    """Base measures and the compression verdict of every text.

    A text fails the base rules with fewer than `least_words` words (`[^\\x20\\x09-\\x0D]+`), or if more than
    `most_repeat_percent` of its words lie in windows of `repeat_width` words that the text has twice or more. Of
    the rest, `verdict` is "repetitive" if the ratio of the text or of any chunk is under its band,
    "incompressible" if one is above, else "ok"; kept means base passed and verdict ok. Every byte is in a chunk: what is left
    after the chunks of `chunk_bytes` is one by itself, or, under `least_tail` bytes, part of the chunk before it. `by_lang` gives a
    language its own (document bands, chunk bands).

    Returns id_col, the columns in `carry`, and the measures. Defined results: a null or empty text has
    no words, zero measures and ratio null, and fails the base rules; a null language takes the common
    bands; rows that repeat are judged alike, each on its own; texts of any length are read whole, chunk
    by chunk; an empty table gives no rows.
    """
    bounded(docs.sparkSession)
    special = dict(by_lang or {})
    n_carry = len(carry)

    def judge(text: bytes, bands, packer) -> tuple[float | None, float | None, float | None, str]:
        if not text:
            return None, None, None, "ok"
        whole = len(packer.compress(text)) / len(text)
        parts = [text[i : i + chunk_bytes] for i in range(0, len(text), chunk_bytes)] if len(text) > chunk_bytes else [text]
        if len(parts) > 1 and len(parts[-1]) < least_tail:
            tail = parts.pop()  # too short to judge by itself
            parts[-1] += tail
        ratios = [whole] if len(parts) == 1 and len(parts[0]) == len(text) else [len(packer.compress(x)) / len(x) for x in parts]
        low, high = _band(bands[0], len(text))
        limits = [_band(bands[1], len(x)) for x in parts]
        if whole < low or any(r < a for r, (a, _) in zip(ratios, limits, strict=True)):
            verdict = "repetitive"
        elif whole > high or any(r > b for r, (_, b) in zip(ratios, limits, strict=True)):
            verdict = "incompressible"
        else:
            verdict = "ok"
        return whole, min(ratios), max(ratios), verdict

    def of(batches):
        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), WHITESPACE)
                n_words = words.counts()
                in_word = np.zeros(len(words.data) + 1, dtype=np.int8)
                in_word[words.starts] += 1
                in_word[words.ends] -= 1
                points = _STARTS_POINT[words.data] & (np.cumsum(in_word[:-1], dtype=np.int8) > 0)
                repeat = _repeated(words, repeat_width)
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                judged = [judge(x, special.get(lang, (document_bands, chunk_bands)), packer) for x, lang in zip(texts, part.column("lang").to_pylist(), strict=True)]
                failed = (n_words < least_words) | (100 * repeat > most_repeat_percent * n_words)
                kept = [not f and j[3] == "ok" for f, j in zip(failed, judged, strict=True)]
                out = [
                    *[part.column(i) for i in range(n_carry + 1)],
                    pa.array(n_words, pa.int64()), pa.array(_sums(points, words.at), pa.int64()), pa.array(_sums(_SYMBOL[words.data], words.at), pa.int64()), pa.array([_dup_lines(x) for x in texts], pa.int64()), pa.array(repeat, pa.int64()),
                    pa.array(np.diff(words.at), pa.int64()), *[pa.array([j[k] for j in judged], pa.float64()) for k in range(3)], pa.array(failed), pa.array([j[3] for j in judged], pa.string()), pa.array(kept),
                ]
                yield pa.RecordBatch.from_arrays(out, names)

    own = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("text"), (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang"))
    kinds = [f.dataType.simpleString() for f in own.schema.fields[: n_carry + 1]]
    names = ["id", *[f"carry_{i}" for i in range(n_carry)], *[x.split()[0] for x in SCHEMA.split(", ")]]
    found = own.mapInArrow(of, ", ".join([f"{c} {k}" for c, k in zip(names, kinds, strict=False)]) + ", " + SCHEMA)
    return found.toDF(id_col, *carry, *names[n_carry + 1 :])
