"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Texts are lower-cased, look-alike letters of other scripts become Latin ones, digits and signs
that stand for letters become those letters, invisible characters go. Lexicon entries are words or
beginnings of words; each has a weight. Matches inside an exception phrase do not count. The weighted
hits and their share of the words go through a logistic curve.

Entries, weights and curve are learned from a bounded sample of labelled rows (`train_rows`): the beginnings
of words are counted by label in Spark, each near copy once, and the entries that set toxic texts
apart are taken, of each family of beginnings the one that does it best. The seed entries are the start, and all there is where no
labels are.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded, materialize

#: Words that are insults in running text, with their weights, where no labels say more.
SEED: Mapping[str, float] = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "stupid": 3.0, "worthless": 3.0, "pathetic": 3.0, "disgusting": 3.0}
#: Phrases whose words are meant literally.
EXCEPTIONS: Sequence[str] = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "pond scum", "stupid mistake", "disgusting smell", "worthless check")

_LOOKALIKES = dict(zip("аеорсухіѕјкмтнвԁɡαοειντυρκ", "aeopcyxisjkmthbdgaoeivtupk", strict=True))
_DIGITS = dict(zip("013457@$", "oieastas", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"


def _folds() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in (_LOOKALIKES | _DIGITS).items()}
    table |= {ord(c): None for c in _INVISIBLE}
    for code in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D6A4)]:  # full-width and mathematical forms
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        if plain != chr(code):
            table[code] = _DIGITS.get(plain, plain)
    return table


_FOLDS = _folds()


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutes as letters, no invisible characters."""
    return text.lower().translate(_FOLDS)


def _words(folded: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in folded).split() if not folded.isascii() else folded.translate(_ASCII_WORDS).split()


_ASCII_WORDS = {c: " " for c in range(128) if not chr(c).isalnum()}


@dataclass
class Lexicon:
    """Weighted beginnings of words (a whole word ends in "$"), exceptions, and the logistic curve."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    #: intercept, and factors of log(1 + weighted hits), weighted hits by word, log(1 + words)
    curve: Sequence[float] = (-4.0, 2.0, 4.0, -0.2)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": list(self.exceptions), "curve": list(self.curve)}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None)

    def automaton(self):
        if self._automaton is None:
            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                word = entry.rstrip("$")
                had = built.get(word, (len(word), 0.0, 0.0, False))
                built.add_word(word, (len(word), had[1] + (0.0 if entry.endswith("$") else weight), had[2] + (weight if entry.endswith("$") else 0.0), had[3]))
            for phrase in self.exceptions:
                phrase = fold(phrase)
                had = built.get(phrase, (len(phrase), 0.0, 0.0, False))
                built.add_word(phrase, (had[0], had[1], had[2], True))
            if len(built):
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries in the folded text that count."""
        built = self.automaton()
        if not len(built) or not text:
            return []
        found, spared, n = [], [], len(text)
        for last, (size, begins, whole, phrase) in built.iter(text):
            start, end = last - size + 1, last + 1
            if start and text[start - 1].isalnum():
                continue
            ends_here = end == n or not text[end].isalnum()
            if phrase and ends_here:
                spared.append((start, end))
            weight = begins + (whole if ends_here else 0.0)
            if weight:
                found.append((start, end, weight))
        if spared:
            # the farthest end of the phrases that begin up to each place decides, so one pass over both will do
            spared.sort()
            starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            at = [bisect_right(starts, x[0]) for x in found]
            found = [x for x, k in zip(found, at, strict=True) if not k or ends[k - 1] < x[1]]
        # of entries that begin at the same place the longest counts
        longest = {start: (start, end, weight) for start, end, weight in sorted(found)}
        return list(longest.values())

    def judge(self, text: str | None) -> tuple[tuple[float, float, float], float, int]:
        """The features of a text, its score, and how many entries count."""
        folded = fold(text or "")
        found = self.hits(folded)
        total, words = sum(w for _, _, w in found), len(folded.split())
        features = math.log1p(total), total / max(words, 1), math.log1p(words)
        z = self.curve[0] + self.curve[1] * features[0] + self.curve[2] * features[1] + self.curve[3] * features[2]
        return features, 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z)))), len(found)

    def score(self, text: str | None) -> float:
        return self.judge(text)[1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression, by Newton's method."""
    full = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(full.shape[1]), np.full(full.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -40, 40)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty) + 1e-9 * np.eye(len(beta)), full.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _beginnings(words: Sequence[str], lengths: Sequence[int]) -> Counter:
    """How often each beginning of a word, and each whole word, occurs."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        found[word + "$"] += n
        for k in lengths:
            if len(word) >= k:
                found[word[:k]] += n
    return found


def _families(worth: Mapping[str, float]) -> list[str]:
    """Of each family of beginnings of the same words the entry that does best."""
    left, chosen = dict(worth), []
    for entry in sorted(worth, key=lambda e: (worth[e], len(e), e), reverse=True):
        if entry not in left:
            continue
        # of beginnings of the same words the longest that is worth as much says most
        near = [e for e, x in left.items() if e.startswith(entry.rstrip("$")) and x >= 0.85 * worth[entry]]
        best = max(near, key=lambda e: (not e.endswith("$"), len(e), e))
        word = best.rstrip("$")
        chosen.append(best)
        for e in [e for e in left if e.rstrip("$").startswith(word) or word.startswith(e.rstrip("$"))]:
            del left[e]
    return chosen


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, lengths: Sequence[int] = (3, 4, 5, 6, 7, 8), least_support: int = 5, least_share: float = 0.015, exceptions: Sequence[str] = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns a lexicon from about `train_rows` labelled rows, chosen by a hash of their id; texts that are equal after folding count once for each label.

    Entries are all whole words and all beginnings of `lengths` letters that enough of those rows bear out (`least_support`,
    `least_share`); their number is bounded by the rows learned from and by nothing else. Of entries of equal
    worth the longer comes first, then the greater in code points, so reruns agree. An id with several labels counts as toxic if one
    says so; null ids and null labels are not learned from; null texts are texts without words.
    """
    bounded(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    n = marked.count()
    if n == 0:
        return Lexicon(dict(SEED), exceptions)
    share = min(1.0, train_rows / n)
    chosen = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    # about train_rows rows of 12 bytes, so the side is bounded
    def signed(batches):
        for batch in batches:
            keys = [xxhash.xxh64_intdigest(fold(text or "")) >> 1 for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), batch.column(1)], ["h", "text", "y"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
    once = rows.mapInArrow(signed, "h long, text string, y int").groupBy("h", "y").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(once.select("text", "y"), "toxicity-sample")

    def count(batches):
        df, tok = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _beginnings(_words(fold(text or "")), lengths)
                df[y].update(found.keys())
                tok[y].update(found)
                df[y][""] += 1
                tok[y][""] += sum(v for k, v in found.items() if k.endswith("$"))
        # a beginning that no toxic text of this part has can only lower another part's count, so it is needed too
        keys = sorted(set(df[0]) | set(df[1]))
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[k] for k in part], pa.int64()) for c in (df[0], df[1], tok[0], tok[1])]], ["entry", "df0", "df1", "tok0", "tok1"])

    counted = sample.mapInArrow(count, "entry string, df0 long, df1 long, tok0 long, tok1 long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("df0", "df1", "tok0", "tok1")])
    counted = materialize(counted.where(F.col("df1") >= least_support), "toxicity-counts")
    whole = counted.where("entry = ''").first()
    if whole is None or not whole["df0"]:
        return Lexicon(dict(SEED), exceptions)
    price = 0.5 * whole["df1"] / whole["df0"]
    worth = F.col("df1") - price * F.col("df0")
    odds = F.log(((F.col("tok1") + 0.5) / whole["tok1"]) / ((F.col("tok0") + 0.5) / whole["tok0"]))
    least = max(least_support, least_share * whole["df1"])
    top = counted.where((F.col("entry") != "") & (odds > 2) & (worth >= least)).select("entry", odds.alias("w"), worth.alias("worth")).collect()
    weights = {r["entry"]: float(r["w"]) for r in top}
    lexicon = Lexicon({e: weights[e] for e in _families({r["entry"]: float(r["worth"]) for r in top})} or dict(SEED), exceptions)
    parts = lexicon

    def measure(batches):
        for batch in batches:
            found = [parts.judge(x)[0] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array([f[k] for f in found], pa.float64()) for k in range(3)]], ["y", "a", "b", "c"])

    rows = sample.mapInArrow(measure, "y int, a double, b double, c double").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in rows])
    lexicon.curve = [float(v) for v in _logistic(x, np.array([r["y"] for r in rows], dtype=float))]
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Scores every whole text: id_col, the columns in `carry`, score (0 to 1), predicted (1 from `threshold`), hits (entries that count).

    Defined results: null and empty texts score as texts without hits; repeated rows score alike; a null id keeps its row;
    other columns are ignored; an empty table gives no rows. A text is folded and scanned as a whole, however long, one at a
    time: memory is a few times the longest text. The lexicon travels with the tasks; it is bounded by the rows it was learned from.
    """
    bounded(docs.sparkSession)
    n = len(carry) + 1

    def of(batches):
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(n).to_pylist():
                _, score, n_hits = lexicon.judge(text)
                scores.append(score)
                hits.append(n_hits)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, pa.int64())], names)

    own = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:n]]
    names = [*own.columns[:n], "score", "predicted", "hits"]
    return own.mapInArrow(of, ", ".join([*kinds, "score double, predicted int, hits long"])).toDF(id_col, *carry, "score", "predicted", "hits")


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Label rows that may be learned from: those whose crc32(id as text) mod 3 is not 1."""
    return labels.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)
