"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The items' words become one automaton;
the words of a document stream through it, and the state after each word gives the length of the longest
match that ends there and, by the suffix links, the items it is in. A document word that no item has sends the automaton
back to its root, so only runs of words known to the items are walked word by word; finding those
runs is vectorised.

The items are the small side: they are split into shards of bounded size, one automaton each, and only a shard's texts
travel with the tasks. Documents pass one shard after the other, without a shuffle; a benchmark of one shard
(the usual case) takes one scan.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded, materialize
from strataflow.llm._text import NOT_WORDLIKE, Words, chunks, runs

_SPAN = "array<struct<start:int,end:int>>"
_WORD_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class SuffixAutomaton:
    """A generalised suffix automaton over tokens (integers from 0), with the windows of each item at its states.

    States and transitions are rows of arrays: a state's transitions are a chain of edges, only states with more than `_CHAIN` of them have a
    dictionary. So an item's word takes two states and three edges of some fifty bytes together at most.
    """

    _CHAIN = 8

    def __init__(self, items: Sequence[Sequence[int]], width: int) -> None:
        self.width = width
        self.link, self.len, self.head = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.edge_token, self.edge_to, self.edge_next = array("i"), array("i"), array("i")
        #: transitions of states whose head is -2
        self.wide: dict[int, dict[int, int]] = {}
        for tokens in items:
            last = 0
            for token in tokens:
                last = self._extend(last, token)
        self._mark(items)

    def _step(self, state: int, token: int) -> int:
        """The state after a token, or -1."""
        edge = self.head[state]
        if edge == -2:
            return self.wide[state].get(token, -1)
        while edge >= 0:
            if self.edge_token[edge] == token:
                return self.edge_to[edge]
            edge = self.edge_next[edge]
        return -1

    def _set(self, state: int, token: int, target: int) -> None:
        edge, n = self.head[state], 0
        if edge == -2:
            self.wide[state][token] = target
            return
        while edge >= 0:
            if self.edge_token[edge] == token:
                self.edge_to[edge] = target
                return
            edge, n = self.edge_next[edge], n + 1
        if n >= self._CHAIN:
            self.wide[state] = {**dict(self._edges(state)), token: target}
            self.head[state] = -2
            return
        self.edge_token.append(token)
        self.edge_to.append(target)
        self.edge_next.append(self.head[state])
        self.head[state] = len(self.edge_to) - 1

    def _edges(self, state: int) -> list[tuple[int, int]]:
        """(token, state) of all transitions of a state."""
        edge, found = self.head[state], []
        if edge == -2:
            return list(self.wide[state].items())
        while edge >= 0:
            found.append((self.edge_token[edge], self.edge_to[edge]))
            edge = self.edge_next[edge]
        return found

    def _new(self, length: int, link: int) -> int:
        self.link.append(link)
        self.len.append(length)
        self.head.append(-1)
        return len(self.len) - 1

    def _clone(self, state: int, token: int, parent: int) -> int:
        copy = self._new(self.len[parent] + 1, self.link[state])
        for own, target in self._edges(state):
            self._set(copy, own, target)
        while parent != -1 and self._step(parent, token) == state:
            self._set(parent, token, copy)
            parent = self.link[parent]
        self.link[state] = copy
        return copy

    def _extend(self, last: int, token: int) -> int:
        state = self._step(last, token)
        if state >= 0:
            return state if self.len[state] == self.len[last] + 1 else self._clone(state, token, last)
        new = self._new(self.len[last] + 1, 0)
        parent = last
        while parent != -1 and self._step(parent, token) < 0:
            self._set(parent, token, new)
            parent = self.link[parent]
        if parent != -1:
            state = self._step(parent, token)
            self.link[new] = state if self.len[state] == self.len[parent] + 1 else self._clone(state, token, parent)
        return new

    def _mark(self, items: Sequence[Sequence[int]]) -> None:
        """Finds by state: the state of its suffix of `width` words, and the next one, by suffix links, that a short item is."""
        n, width = len(self.len), self.width
        places: list[np.ndarray] = []
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, tokens in enumerate(items):
            state, path = 0, []
            for token in tokens:
                state = self._step(state, token)
                path.append(state)
            if 0 < len(tokens) < width:
                self.short.setdefault(state, []).append((len(tokens), number))
            elif len(tokens) >= width:
                places.append(np.array([path[width - 1 :], [number] * (len(tokens) - width + 1)], dtype=np.int32))
        lens, links = np.frombuffer(self.len, dtype=np.int32), np.frombuffer(self.link, dtype=np.int32)
        self.top, self.near = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        self.top[0] = self.near[0] = -1
        for state in np.argsort(lens, kind="stable")[1:].tolist():
            link = int(links[state])
            self.top[state] = -1 if lens[state] < width else state if lens[link] < width else self.top[link]
            self.near[state] = state if state in self.short else self.near[link]
        # the items of each window: those of state s are own[first[s] : first[s + 1]]
        pairs = np.concatenate(places, axis=1) if places else np.zeros((2, 0), dtype=np.int32)
        pairs = np.unique(np.stack((np.frombuffer(self.top, dtype=np.int32)[pairs[0]], pairs[1])), axis=1) if pairs.size else pairs
        self.own, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(n + 1)).astype(np.int32)

    def scan(self, tokens: Sequence[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """(end, length) of every window of an item that occurs in the tokens, and the items; a token under 0 is in no item."""
        link, length, step_of = self.link, self.len, self._step
        state = matched = 0
        found, states, items = [], set(), set()
        for at, token in enumerate(tokens):
            step = -1 if token < 0 else step_of(state, token)
            while step < 0 and state:
                state = link[state]
                matched = length[state]
                step = -1 if token < 0 else step_of(state, token)
            if step < 0:
                continue
            state, matched = step, matched + 1
            if matched >= self.width:
                found.append((at + 1, self.width))
                states.add(self.top[state])
            short = self.near[state]
            while short > 0:
                for size, number in self.short[short]:
                    if size <= matched:
                        found.append((at + 1, size))
                        items.add(number)
                short = self.near[link[short]]
        for x in states:
            items.update(self.own[self.first[x] : self.first[x + 1]].tolist())
        return found, items


class Matcher:
    """The automaton of a shard of items, and what is needed to find it in a column of texts."""

    def __init__(self, ids: Sequence, texts: Sequence[str | None], width: int) -> None:
        words = Words(pa.array([x or "" for x in texts], pa.string()), NOT_WORDLIKE, lower=True)
        raw = words.data.tobytes()
        self.ids = list(ids)
        self.tokens: dict[bytes, int] = {}
        flat = array("i", (self.tokens.setdefault(raw[a:b], len(self.tokens)) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)))
        items = [flat[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        # different words only: hashing takes tables as long as the text it is given
        self.hashes = np.unique(Words(pa.array([x.decode() for x in self.tokens], pa.string()), NOT_WORDLIKE).hashes())
        self.shortest = min((min(len(x), width) for x in items if len(x)), default=width)
        self.automaton = SuffixAutomaton(items, width)

    def find(self, words: Words) -> tuple[np.ndarray, list[set]]:
        """Which words are hit, and the items found in each row.

        Hashes find the runs of words that may be in items; whether a word is one is decided by its bytes.
        """
        hit, items = np.zeros(len(words) + 1, dtype=np.int64), [set() for _ in range(len(words.first) - 1)]
        if not len(self.hashes) or not len(words):
            return hit[:-1] > 0, items
        hashes = words.hashes()
        known = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes
        starts, ends = runs(known)
        # a run ends with its row
        cuts = words.first[1:-1]
        starts = np.unique(np.concatenate((starts, cuts[(cuts < len(words)) & known[np.minimum(cuts, len(words) - 1)]])))
        ends = np.unique(np.concatenate((ends, cuts[(cuts > 0) & known[np.maximum(cuts - 1, 0)]])))
        long = ends - starts >= self.shortest
        raw, token = words.data.tobytes(), self.tokens.get
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            found, numbers = self.automaton.scan([token(raw[x:y], -1) for x, y in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)])
            for end, size in found:
                hit[a + end - size] += 1
                hit[a + end] -= 1
            if numbers:
                items[int(np.searchsorted(words.first, a, "right")) - 1] |= {self.ids[x] for x in numbers}
        return np.cumsum(hit[:-1]) > 0, items


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, shard, width: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()  # a worker serves one shard at a time
        ids, texts = shard.value
        _MATCHERS[key] = Matcher(ids, texts, width)
    return _MATCHERS[key]


def _shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> tuple[DataFrame, int]:
    """The different items, dealt into shards of about `shard_bytes`; the number of shards, not their size, grows with the benchmark."""
    own = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct().withColumn("size", F.octet_length("text") + 8)
    total = own.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    return own.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Finds the windows of benchmark items in documents and cuts them out.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window.
    Returns id_col, the columns in `carry`, n_words, n_hit (words inside an occurrence of a window), items (ids of the
    items found, as sorted strings), spans (hit words as intervals, end exclusive), longest (longest
    hit interval), and clean_text: the text without the bytes of the hit words and what stands between them.

    Defined results: null and empty texts have no words and stay as they are; an empty benchmark or items
    without words hit nothing; items with the same words are all reported, a null item id as "null"; repeated documents are judged
    each on its own; other columns are ignored; an empty table gives no rows.

    Memory: a shard's texts (`shard_bytes`) at a time are on the driver and travel with the tasks, and a worker holds one
    automaton (measured for 4 MB of items: 290 MB while it is built, 190 MB after). Each shard but the last is a pass of its own, written to the shared folder.
    """
    spark = bounded(docs.sparkSession)
    shards, n_shards = _shards(benchmark, item_col, item_text_col, shard_bytes)
    n_carry, tag = len(carry), uuid.uuid4().hex

    def seek(k: int, last: bool, lot):
        key = f"{tag}-{k}"

        def of(batches):
            for batch in batches:
                for part in chunks(batch, "text"):
                    words = Words(part.column("text"), NOT_WORDLIKE, lower=True)
                    hit, items = _matcher(key, lot, width).find(words)
                    first, rows = words.first, range(part.num_rows)
                    if k:
                        for row, (spans, names) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                            items[row] |= set(names)
                            for x in spans:
                                hit[first[row] + x["start"] : first[row] + x["end"]] = True
                    total = np.concatenate(([0], np.cumsum(hit)))
                    n_hit = total[first[1:]] - total[first[:-1]]
                    spans: list[list[dict]] = [[] for _ in rows]
                    clean = part.column("text").to_pylist() if last else None
                    longest = np.zeros(part.num_rows, dtype=np.int64)
                    for row in np.flatnonzero(n_hit).tolist():
                        a, b = runs(hit[first[row] : first[row + 1]])
                        spans[row] = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
                        longest[row] = (b - a).max()
                        if last:
                            raw, base = clean[row].encode(), words.at[row]
                            pieces, at = [], 0
                            for x, y in zip(a + first[row], b + first[row], strict=True):
                                pieces.append(raw[at : words.starts[x] - base])
                                at = words.ends[y - 1] - base
                            clean[row] = b"".join([*pieces, raw[at:]]).decode()
                    out = [*[part.column(i) for i in range(n_carry + 2)], pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _WORD_SPAN), pa.array(longest, pa.int64())]
                    if last:
                        out[n_carry + 1] = pa.array(clean, pa.string())
                    yield pa.RecordBatch.from_arrays(out, names_out)

        return of

    own = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields]
    names_out = [*own.columns, "n_words", "n_hit", "items", "spans", "longest"]
    for k in range(n_shards):
        part = shards.where(F.col("shard") == k).orderBy("item", "text").collect()
        lot = spark.sparkContext.broadcast(([r["item"] or "null" for r in part], [r["text"] for r in part]))
        last = k == n_shards - 1
        own = own.mapInArrow(seek(k, last, lot), ", ".join([*kinds, "n_words long", "n_hit long", "items array<string>", f"spans {_SPAN}", "longest long"]))
        if not last:
            own = materialize(own, "decontaminated")
            lot.destroy()
    return own.toDF(id_col, *carry, "clean_text", "n_words", "n_hit", "items", "spans", "longest")


def digest(items: Sequence[str]) -> str:
    """The digest of found items, as the query reports it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
