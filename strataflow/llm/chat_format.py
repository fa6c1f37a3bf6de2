"""Chat formatting: conversations that share their first turns become one prefix tree, and shared tokens are emitted once.

Conversations are sorted by the hashes of their turns, so conversations that share turns are neighbours and the order is
depth-first. A partition of the sorted rows is cut into packs of about `pack_tokens` tokens. In a pack each
node (turn) is emitted once: its position ids go on from its parent's, and its tokens may attend to themselves,
causally, and to the token ranges of its ancestors, which are given as intervals; ranges that touch are one, so
there are as many as branchings above the node. A node whose branches are in two
packs is emitted in both.

The template: <s>, then for each turn "[INST] text [/INST]" (user), " text </s>" (assistant), "<<SYS>> text <</SYS>>"
(system) or "[ROLE] role [ROLE] text [/ROLE]". Inside texts and roles a backslash becomes two, and one is put behind the first
character of each control string, so that no control string is left; both are undone by dropping each backslash that
precedes a character.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import bounded

#: Fixed control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BEGIN = "<s>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

PACK = "pack string, tokens array<int>, position_ids array<int>, loss_mask binary, nodes array<struct<start:int,end:int,parent:int,ancestors:array<struct<start:int,end:int>>>>, conversations array<struct<conv_id:bigint,leaf:int>>"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """(string, under the loss mask) of one turn."""
    inner = escape(text)
    if role == "user":
        return [("[INST] ", False), (inner, False), (" [/INST]", False)]
    if role == "assistant":
        return [(" ", False), (inner, True), (" </s>", False)]
    if role == "system":
        return [("<<SYS>> ", False), (inner, False), (" <</SYS>>", False)]
    return [("[ROLE] " + escape(role) + " [ROLE] ", False), (inner, False), (" [/ROLE]", False)]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("a formatted conversation begins with " + BEGIN)
    turns, at = [], len(BEGIN)

    def upto(mark: str) -> str:
        nonlocal at
        end = formatted.index(mark, at)
        inner, at = formatted[at:end], end + len(mark)
        return unescape(inner)

    while at < len(formatted):
        for head, tail, role in (("[INST] ", " [/INST]", "user"), ("<<SYS>> ", " <</SYS>>", "system"), ("[ROLE] ", " [/ROLE]", ""), (" ", " </s>", "assistant")):
            if formatted.startswith(head, at):
                at += len(head)
                role = role or upto(" [ROLE] ")
                turns.append((role, upto(tail)))
                break
        else:
            raise ValueError(f"no turn begins at {at}")
    return turns


class _Codec:
    """Tokens of strings, by a tokenizer file's content, or UTF-8 bytes without one."""

    def __init__(self, content: str | None) -> None:
        self.tokenizer, self.fixed = None, {}
        if content is not None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(content)
            self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Tokens of each text; short ones, control strings above all, are kept."""
        if self.tokenizer is None:
            return [list(x.encode()) for x in texts]
        if len(self.fixed) > 10_000:
            self.fixed.clear()
        fresh = [x for x in dict.fromkeys(texts) if x not in self.fixed]
        own = dict(zip(fresh, (x.ids for x in self.tokenizer.encode_batch(fresh, add_special_tokens=False)), strict=True))
        self.fixed |= {x: ids for x, ids in own.items() if len(x) <= 24}
        return [self.fixed[x] if x in self.fixed else own[x] for x in texts]

    def decode(self, tokens: list[int]) -> str:
        return bytes(tokens).decode() if self.tokenizer is None else self.tokenizer.decode(tokens, skip_special_tokens=False)


def _content(tokenizer: str | None) -> str | None:
    if tokenizer is None:
        return None
    with open(tokenizer, encoding="utf-8") as file:
        return file.read()


def conversations_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, path): the turns of each conversation in order, and the hashes of its turns."""
    # rows without a conversation are not gathered: each different one stands alone
    alone = F.when(F.col(conv_col).isNull(), F.xxhash64(turn_col, role_col, text_col)).alias("alone")
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), alone, F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    listed = own.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")
    return listed.withColumn("path", F.transform("turns", lambda t: F.md5(F.concat_ws("\n", t["role"], t["text"]))))


def format_chats(turns: DataFrame, tokenizer: str | None = TOKENIZER, pack_tokens: int = 4096, partitions: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Packs of prefix trees over conversations given by turn: one row for each pack.

    tokens, position_ids and loss_mask (a byte for each token, 1 inside assistant texts) run depth-first over the
    nodes; a node is start, end (token range), parent (node, -1 for a root) and ancestors (token ranges its
    tokens also attend to, from the root on). conversations gives each conversation's last node.

    The tokenizer's file is read once on the driver and travels with the tasks (2 MB). Equal
    conversations are told apart by their id in the sort, so that a group of any size is spread over partitions.

    Defined results: a null text or role is empty; turns sort by number, then role and text; repeated
    turns are turns of their own; rows with a null conversation id are conversations of their own, one for each different row; other columns are ignored; an empty table gives no
    packs; a conversation longer than a pack is a pack of its own. All turns of one conversation, and of one pack, are held in one task: a
conversation is bounded by what its speakers wrote, and a pack by one conversation more than pack_tokens.
    """
    spark = bounded(turns.sparkSession)
    content = spark.sparkContext.broadcast(_content(tokenizer))
    convs = conversations_of(turns, conv_col, turn_col, role_col, text_col)
    order = ["path", "conv_id"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = convs.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def of(batches) -> Iterator[pa.RecordBatch]:
        codec = _Codec(content.value)
        part = hashlib.sha256()
        pack = _Pack(codec)
        done = 0

        def out() -> pa.RecordBatch:
            nonlocal done
            done += 1
            return pack.batch(f"{part.hexdigest()[:16]}-{done}")

        for rows in _slices(batches, 64):
            if not done and not pack.convs and rows:
                part.update(f"{rows[0]['conv_id']}:{rows[0]['path']}".encode())
            # all turns that are not known from the row before, tokenized at once
            fresh, last = [], pack.path
            for row in rows:
                same = _shared(last, row["path"])
                fresh += row["turns"][same:]
                last = row["path"]
            strings = [[s for s, _ in segments(t["role"], t["text"])] for t in fresh]
            tokens = iter(codec.encode([s for x in strings for s in x]))
            known = {}
            for t, x in zip(fresh, strings, strict=True):
                known[t["role"], t["text"]] = [next(tokens) for _ in x]
            for row in rows:
                if pack.convs and len(pack.tokens) >= pack_tokens:
                    yield out()
                    pack = _Pack(codec)
                pack.add(row, known)
        if pack.convs:
            yield out()

    return spread.mapInArrow(of, PACK)


def _slices(batches, rows: int) -> Iterator[list[dict]]:
    """Rows as Python objects, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pylist()


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _one(values: array) -> pa.Array:
    """A column with one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(np.frombuffer(values, dtype=np.int32)))


class _Pack:
    def __init__(self, codec: _Codec) -> None:
        self.codec, self.path, self.stack = codec, [], []
        self.tokens, self.positions, self.mask = array("i"), array("i"), bytearray()
        self.nodes, self.convs = [], []

    def _node(self, parent: int, pieces: list[tuple[list[int], bool]]) -> int:
        start, ancestors = len(self.tokens), []
        if parent >= 0:
            above, ancestors = self.nodes[parent], self.nodes[parent]["ancestors"]
            # a parent that follows its own last ancestor is one range with it, so a chain has one range, however long
            if ancestors and ancestors[-1]["end"] == above["start"]:
                ancestors = [*ancestors[:-1], {"start": ancestors[-1]["start"], "end": above["end"]}]
            else:
                ancestors = [*ancestors, {"start": above["start"], "end": above["end"]}]
        depth = sum(x["end"] - x["start"] for x in ancestors)
        for ids, loss in pieces:
            self.tokens.extend(ids)
            self.mask += bytes([loss]) * len(ids)
        self.positions.extend(range(depth, depth + len(self.tokens) - start))
        self.nodes.append({"start": start, "end": len(self.tokens), "parent": parent, "ancestors": ancestors})
        return len(self.nodes) - 1

    def add(self, row: dict, known: dict) -> None:
        if not self.nodes:
            self.root = self._node(-1, [(self.codec.encode([BEGIN])[0], False)])
        same = _shared(self.path, row["path"])
        self.stack = self.stack[:same]
        for t in row["turns"][same:]:
            key = (t["role"], t["text"])
            own = segments(*key)
            ids = known.get(key) or self.codec.encode([s for s, _ in own])
            self.stack.append(self._node(self.stack[-1] if self.stack else self.root, [(x, loss) for x, (_, loss) in zip(ids, own, strict=True)]))
        self.path = row["path"]
        self.convs.append({"conv_id": row["conv_id"], "leaf": self.stack[-1] if self.stack else self.root})

    def batch(self, name: str) -> pa.RecordBatch:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        node = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("ancestors", pa.list_(span))])
        return pa.RecordBatch.from_arrays([
            pa.array([name]), _one(self.tokens), _one(self.positions), pa.array([bytes(self.mask)], pa.binary()),
            pa.array([self.nodes], pa.list_(node)), pa.array([self.convs], pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))),
        ], ["pack", "tokens", "position_ids", "loss_mask", "nodes", "conversations"])


def read_back(packs: DataFrame, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """Each conversation again, from the packs alone: conv_id, turns, loss_text (unescaped), formatted."""
    content = packs.sparkSession.sparkContext.broadcast(_content(tokenizer))

    def of(batches):
        codec = _Codec(content.value)
        for batch in batches:
            for at in range(batch.num_rows):
                rows, texts = [], {}
                tokens = batch.column("tokens").slice(at, 1).flatten().to_numpy(zero_copy_only=False)
                mask = np.frombuffer(batch.column("loss_mask")[at].as_py(), dtype=np.uint8)
                pack = batch.select(["nodes", "conversations"]).slice(at, 1).to_pylist()[0]
                nodes = pack["nodes"]

                def text_of(k: int) -> tuple[str, str]:
                    """The text of a node and what of it is under the loss mask; pieces were encoded one by one."""
                    if k not in texts:
                        a, b = nodes[k]["start"], nodes[k]["end"]
                        cuts = [a, *(np.flatnonzero(np.diff(mask[a:b])) + a + 1).tolist(), b]
                        pieces = [(codec.decode(tokens[x:y].tolist()), mask[x]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
                        texts[k] = "".join(p for p, _ in pieces), unescape("".join(p for p, loss in pieces if loss))
                    return texts[k]

                for conv in pack["conversations"]:
                    k, own = conv["leaf"], []
                    while k >= 0:
                        own.append(k)
                        k = nodes[k]["parent"]
                    formatted = "".join(text_of(k)[0] for k in own[::-1])
                    rows.append({"conv_id": conv["conv_id"], "turns": [{"role": r, "text": t} for r, t in parse(formatted)], "loss_text": "".join(text_of(k)[1] for k in own[::-1]), "formatted": formatted})
                yield pa.RecordBatch.from_pylist(rows, schema)

    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(turn)), ("loss_text", pa.string()), ("formatted", pa.string())])
    return packs.mapInArrow(of, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
