"""Best-two-fit packing of tokenised documents into fixed-length sequences.

The rule: fill a sequence greedily with the longest piece that still fits; then
take out its smallest piece if two unpacked pieces fit the widened gap more
tightly.  The rule looks only at *lengths*, and a length is an integer from 1 to
the capacity, so it is run on the histogram of lengths: identical sequences are
formed in one step, as long as the supply allows.  Each step uses up a length or
comes close to it, so the plan stays small however many pieces there are.  Then
every piece finds its place from its rank among the pieces of its length.

Ranks need no global sort and no task per length: pieces are dealt to blocks by
a hash, ranked inside (block, length), and the counts of (block, length) give
the offsets.  A length that holds a third of all pieces is spread over all blocks.

With ``in_order`` the order of the rows in their files carries on: blocks are runs
of rows, so that ranks follow the files, and sequences are numbered by the first
row that they hold.

Defined results
  * null text: an empty document, whose only token is the end token.
  * very long text: cut into pieces of the capacity; only the first may be shorter.
  * repeated rows: each is packed.  Empty table: an empty result.
  * extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small_batches

CAPACITY = 1024
END_TOKEN = 2
#: Pieces that one ranking block holds on average.
BLOCK_PIECES = 50_000
MIN_BLOCKS = 64
#: Rows of a file that one ranking block holds when packing in order.
ORDER_ROWS = 16_384
SPECIAL = "<|endoftext|>"

_ENCODERS: dict[tuple[str, str], tuple] = {}


def _encoder(vocabulary: str, ranks: str):
    """A function text -> uint32 ids, equal to those of the tokenizers library.

    tiktoken merges the same vocabulary several times faster.  Texts that spell
    the special token go through tokenizers itself, which maps it to its id, and
    so do texts with a run too long for the pattern of tiktoken, some 900,000 blanks.
    """
    key = (vocabulary, ranks)
    if key not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        slow: list = []

        def encode(text: str) -> np.ndarray:
            if SPECIAL not in text:
                try:
                    return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
                except ValueError:  # its pattern gave up
                    pass
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(vocabulary)))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, and the columns ``carry``."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, ranks)
        end = np.array([END_TOKEN], np.uint32)
        for batch in batches:
            at: list[int] = []
            out: tuple[list, ...] = ([], [], [], [])
            for i, value in enumerate(batch.column(1)):
                ids = np.concatenate((encode(value.as_py() or ""), end)).astype("<u4")
                lead = len(ids) % capacity or capacity
                starts = [0, *range(lead, len(ids), capacity)]
                for k, a in enumerate(starts):
                    b = a + capacity if k else lead
                    at.append(i)
                    for column, x in zip(out, (k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(x)
            more = [batch.column(2 + k).take(pa.array(at, pa.int64())) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:]), *more], ["doc_id", "piece", "start", "length", "ids_crc32", *carry])

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(id_col, text_col, *carry).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{rest}")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: how often}) for each pattern, in order; all counts are used up."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"no piece of length {size} fits a sequence of {capacity}")
        left[size] = n
    plan: list[tuple[int, dict[int, int]]] = []
    sizes = np.arange(capacity + 1)
    while left.any():
        free, gap, filled = left.copy(), capacity, {}
        while gap:
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            s = int(fits[-1]) + 1
            n = min(int(free[s]), gap // s)
            filled[s] = filled.get(s, 0) + n
            free[s] -= n
            gap -= n * s
        pattern, need = dict(filled), dict(filled)
        if gap and sum(filled.values()) > 1:
            smallest = min(filled)
            room = gap + smallest
            # The largest unpacked partner y <= x that fits beside each unpacked x.
            best = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            x = np.flatnonzero(free[: room] > 0)
            cap = np.minimum(room - x, np.where(free[x] > 1, x, x - 1))
            y = best[np.maximum(cap, 0)]
            both = np.where(y > 0, x + y, 0)
            if len(x) and both.max() > smallest:
                k = int(both.argmax())
                pattern[smallest] -= 1
                for z in (int(x[k]), int(y[k])):
                    pattern[z] = pattern.get(z, 0) + 1
                    need[z] = need.get(z, 0) + 1
                pattern = {s: n for s, n in pattern.items() if n}
        times = 1 + min(int(left[s] - max(need.get(s, 0), n)) // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
        plan.append((times, pattern))
    return plan


def _places(plan: list[tuple[int, dict[int, int]]], counts: dict[int, int]) -> tuple[np.ndarray, ...]:
    """The plan by (length, first rank): key, first rank, pieces a sequence, first sequence, first place."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, pattern in plan:
        place = 0
        for size in sorted(pattern, reverse=True):
            n = pattern[size]
            rows.append((size, used[size], n, sequence, place))
            used[size] += n * times
            place += n * size
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return tuple(table.T)


def in_file_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the place of each row: ``_file``, which sorts as written, and ``_at``, the row in it.

    Spark numbers the files that it writes by task.  What is no plain scan of
    files has its rows in the order of its partitions.
    """
    try:
        name = F.col("_metadata.file_name")
        number = F.coalesce(F.lpad(F.nullif(F.regexp_extract(name, r"^part-(\d+)", 1), F.lit("")), 10, "0"), F.lit(""))
        return docs.select(id_col, text_col, F.concat(number, name).alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        row = F.monotonically_increasing_id()
        return docs.select(id_col, text_col, row.alias("_at")).withColumn("_file", F.lit(""))


def _numbered(placed: DataFrame) -> DataFrame:
    """Number the sequences by the first place they hold, without a global sort."""
    placed = materialize(placed, "placed")
    first = placed.groupBy(F.col("sequence_id").alias("_s")).agg(F.min(F.struct("_file", "_at", "piece")).alias("_first"))
    first = materialize(first.withColumn("_block", F.struct(F.col("_first._file"), F.floor(F.col("_first._at") / ORDER_ROWS))), "firsts")
    # One row for each block.
    per = first.groupBy(F.col("_block").alias("_b")).agg(F.count("*").alias("_c"))
    before = materialize(per.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before")), "before")
    own = F.row_number().over(Window.partitionBy("_block").orderBy("_first")) - 1
    numbers = first.withColumn("_own", own).join(before, F.col("_block") == F.col("_b")).select("_s", (F.col("_before") + F.col("_own")).alias("_new"))
    out = placed.join(numbers.hint("merge"), F.col("sequence_id") == F.col("_s"))
    return out.select(*(F.col("_new").alias(c) if c == "sequence_id" else c for c in placed.columns if c not in ("_file", "_at")))


def pack(pieces: DataFrame, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """Give every row of ``pieces`` (with a ``length``) a ``sequence_id`` and an ``offset``.

    ``in_order`` expects ``_file`` and ``_at``, which go, and ``piece``.
    """
    spark = pieces.sparkSession
    stored = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` rows reach the driver.
    counts = {r[0]: r[1] for r in stored.groupBy("length").count().collect()}
    blocks = max(MIN_BLOCKS, sum(counts.values()) // BLOCK_PIECES)
    if in_order:
        stored, within = stored.withColumn("_block", F.struct("_file", F.floor(F.col("_at") / ORDER_ROWS))), ["_at", "piece"]
    else:
        stored, within = stored.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks))), ["_row"]
    per = stored.groupBy(F.col("length").alias("_l"), F.col("_block").alias("_b")).agg(F.count("*").alias("_c"))
    before = materialize(per.select("_l", "_b", (F.sum("_c").over(Window.partitionBy("_l").orderBy("_b")) - F.col("_c")).alias("_before")), "ranks")
    ranked = (
        stored.withColumn("_rank", F.row_number().over(Window.partitionBy("_block", "length").orderBy(*within)) - 1)
        .join(before, (F.col("length") == F.col("_l")) & (F.col("_block") == F.col("_b")))
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_row", "_block", "_l", "_b", "_before")
    )
    table = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity), counts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, each, sequence, start = table.value
        # Ranks are below 2**50, so (length, rank) is one sortable integer.
        keys = (size << 50) + first
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (length << 50) + rank, side="right") - 1
            turn, slot = np.divmod(rank - first[k], each[k])
            rest = [c for n, c in zip(names, batch.columns, strict=True) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sequence[k] + turn), pa.array(start[k] + slot * length)], [*(n for n in names if n != "_rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")
    return _numbered(placed) if in_order else placed


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """Tokenise, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    if in_order:
        return pack(token_pieces(in_file_order(docs, id_col, text_col), id_col, text_col, capacity, carry=("_file", "_at")), capacity, True)
    return pack(token_pieces(docs, id_col, text_col, capacity), capacity)
