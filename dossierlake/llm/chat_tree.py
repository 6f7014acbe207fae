"""Chat formatting as prefix trees: turns that conversations share are emitted once.

A turn becomes ``<|turn|>`` role ``<|text|>`` text ``<|end|>``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so that no text can spell a mark and
every text comes back.  The marks are tokens of their own, above the vocabulary; role
and text are encoded between them, so that the tokens of a turn do not depend on its
neighbours and the loss mask begins and ends where the text of an assistant does.

Each conversation has a path: the chained digests of its turns, 16 bytes each, so
that two conversations share as many turns as their paths share blocks.  Sorted by
path over ranges, a conversation adds to the tree the turns that it doesn't share with
the one before it, which is the tree depth first.  A task reads its range as a stream and holds one
sequence.  A tree ends where the first turn changes; it is cut, and the shared turns
are emitted again, only where the range ends or a sequence would pass
``max_tokens``: a first turn that a third of all conversations share does not
become one sequence, one group or one task.

The result has two kinds of rows.  A *node* is a turn of the tree: its tokens, their place
in the sequence (``offset``), the position id of the first one (the tokens of its
ancestors), the stretches of the sequence that its tokens may attend to besides
their own node up to themselves (``attends``), and the tokens under the loss mask (``loss_from``
to ``loss_to`` within the node).  A *member* tells at which node of which sequence a conversation ends.

Defined results
  * null text or role: empty.  Turns are ordered by turn (null first), role and text.
  * repeated rows: each is a turn.  Equal conversations: nodes once a sequence, a member each.
  * null conversation id: each row is a conversation of its own, with a null id.
  * very long texts and conversations: whole; a conversation longer than ``max_tokens`` is a sequence that passes it.
  * empty table: an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _encoder
from .store import small_batches

TURN, TEXT, END = 50257, 50258, 50259
MARKS = {TURN: b"<|turn|>", TEXT: b"<|text|>", END: b"<|end|>"}
MAX_TOKENS = 65_536
LOSS_ROLE = "assistant"
#: Bytes of the digest of a turn and all before it.
BLOCK = 16
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def _paths(turns: DataFrame) -> DataFrame:
    """``conv, path, roles, texts``: one row for each conversation, its turns in order."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, None, []

        def pack() -> pa.RecordBatch:
            ids, paths, roles, texts = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, turns_kind), pa.array(paths, pa.binary()), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], ["conv", "path", "roles", "texts"])

        for batch in batches:
            turns_kind = batch.schema.field("conv").type
            for conv, lone, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "lone", "role", "text")), strict=True):
                if held is None or (conv, lone) != key:
                    if held is not None:
                        done.append(held)
                    key, held = (conv, lone), (conv, bytearray(), [], [])
                one = hashlib.blake2b(bytes(held[1][-BLOCK:]) + len(role).to_bytes(8, "little") + role.encode() + text.encode(), digest_size=BLOCK)
                held[1].extend(one.digest())
                held[2].append(role)
                held[3].append(text)
            if len(done) > 500:
                yield pack()
                done = []
        if held is not None:
            done.append(held)
            yield pack()

    return turns.mapInArrow(run, f"conv {kind}, path binary, roles array<string>, texts array<string>")


TREE = "sequence_id bigint, node int, parent int, offset bigint, length bigint, position bigint, attends array<struct<from:bigint,to:bigint>>, loss_from bigint, loss_to bigint, ids array<int>"


class _Node:
    """A turn in the sequence that is being built."""

    __slots__ = ("number", "offset", "length", "position", "attends")

    def __init__(self, number: int, offset: int, length: int, above: _Node | None):
        self.number, self.offset, self.length = number, offset, length
        self.position = above.position + above.length if above else 0
        spans = list(above.attends) if above else []
        if above:
            if spans and spans[-1][1] == above.offset:
                spans[-1] = (spans[-1][0], above.offset + above.length)
            else:
                spans.append((above.offset, above.offset + above.length))
        self.attends = spans


def chat_trees(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_tokens: int = MAX_TOKENS, vocabulary: str = VOCABULARY, ranks: str = RANKS
) -> DataFrame:
    """The trees of all conversations: ``sequence_id, node, parent, offset, length, position, attends, loss_from, loss_to, ids`` of the
    nodes, and ``conv_id, sequence_id, node`` of the members, whose other columns are null.

    Rows of one sequence follow each other, a member after the node where it ends.
    """
    small_batches(conversations.sparkSession)
    c = conversations
    lone = F.when(c[id_col].isNull(), F.monotonically_increasing_id())
    turns = c.select(c[id_col].alias("conv"), lone.alias("lone"), c[turn_col].alias("turn"), F.coalesce(c[role_col], F.lit("")).alias("role"), F.coalesce(c[text_col], F.lit("")).alias("text"))
    turns = turns.repartition("conv", "lone").sortWithinPartitions("conv", "lone", "turn", "role", "text")
    kind = c.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(vocabulary, ranks), TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        before, path, nodes, size = b"", [], 0, 0
        rows: list[tuple] = []
        weight = 0

        def tokens(role: str, text: str) -> tuple[np.ndarray, int, int]:
            head, body = encode(escape(role)), encode(escape(text))
            ids = np.concatenate(([TURN], head, [TEXT], body, [END])).astype(np.int32)
            start = len(head) + 2
            return ids, start, start + len(body) if role == LOSS_ROLE else start

        def pack() -> pa.RecordBatch:
            spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            kinds = [ids_kind, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), spans, pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["conv_id", "sequence_id", "node", "parent", "offset", "length", "position", "attends", "loss_from", "loss_to", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids_kind = batch.schema.field("conv").type
            for conv, now, roles, texts in zip(*(batch.column(k) for k in ("conv", "path", "roles", "texts")), strict=True):
                now, roles, texts = now.as_py(), roles.as_py(), texts.as_py()
                shared = 0
                while shared < len(path) and before[shared * BLOCK : (shared + 1) * BLOCK] == now[shared * BLOCK : (shared + 1) * BLOCK]:
                    shared += 1
                fresh = [tokens(r, t) for r, t in zip(roles[shared:], texts[shared:], strict=True)]
                if not shared or (fresh and size + sum(len(x[0]) for x in fresh) > max_tokens):
                    # A new sequence has all turns of its first conversation.
                    fresh = [tokens(r, t) for r, t in zip(roles[:shared], texts[:shared], strict=True)] + fresh
                    sequence, path, nodes, size, shared = sequence + 1, [], 0, 0, 0
                del path[shared:]
                for ids, a, b in fresh:
                    above = path[-1] if path else None
                    one = _Node(nodes, size, len(ids), above)
                    rows.append((None, sequence, nodes, above.number if above else None, size, len(ids), one.position, [{"from": x, "to": y} for x, y in one.attends], a, b, ids))
                    path.append(one)
                    nodes, size, weight = nodes + 1, size + len(ids), weight + len(ids)
                rows.append((conv.as_py(), sequence, path[-1].number, *[None] * 8))
                before = now
                if weight > 1_000_000 or len(rows) > 20_000:
                    yield pack()
                    rows, weight = [], 0
        if rows:
            yield pack()

    found = _paths(turns).repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    return found.mapInArrow(run, f"conv_id {kind}, {TREE}")


def read_back(trees: DataFrame, in_order: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """The conversations of ``trees``, from their tokens alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    ``in_order`` tells that the rows of a sequence still follow each other; otherwise they are brought together.
    """
    kind = trees.schema["conv_id"].dataType.simpleString()
    rows = trees.select("conv_id", "sequence_id", "node", "parent", "loss_from", "loss_to", "ids")
    if not in_order:
        rows = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "node", F.col("ids").isNull())
    turn = re.compile(r"<\|turn\|>((?:(?!<\|).)*)<\|text\|>((?:(?!<\|).)*)<\|end\|>", re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(ranks)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        # The nodes from the root to the last one: number, text, text under the loss mask.
        sequence, path = None, []
        for batch in batches:
            out = []
            for conv, seq, node, parent, a, b, ids in zip(*(batch.column(c) for c in range(7)), strict=True):
                if seq.as_py() != sequence:
                    sequence, path = seq.as_py(), []
                if ids.is_valid:
                    tokens = ids.values.to_numpy(zero_copy_only=False)
                    while path and path[-1][0] != parent.as_py():
                        path.pop()
                    path.append((node.as_py(), decode(tokens), unescape(decode(tokens[a.as_py() : b.as_py()]))))
                    continue
                while path[-1][0] != node.as_py():
                    path.pop()
                text, loss = "".join(x[1] for x in path), "".join(x[2] for x in path)
                found = [(unescape(m[1]), unescape(m[2])) for m in turn.finditer(text)]
                said = "".join(f"{role}\n{words}\n" for role, words in found)
                out.append((conv.as_py(), len(found), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _decoder(ranks: str):
    """A function from token ids to the text they stand for."""
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)} | MARKS
    return lambda ids: b"".join(map(table.__getitem__, ids.tolist())).decode()
