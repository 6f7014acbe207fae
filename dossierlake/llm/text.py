"""Vectorised text kernels on Arrow buffers.

Words, shingles and lines of a whole batch are found with numpy on the UTF-8
bytes of the batch; no Python object is made for a word.  All hashes are
64-bit, deterministic, and the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes handled by one vectorised step; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``limit`` bytes, one document at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per document) of the maximal runs without white space."""
    return runs(~SPACE[data], offsets)


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, runs per document) of the maximal solid runs; none reaches over the edge of a document."""
    n = len(solid)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = edge[edge > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte values, mixed."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[data] * up[:-1], dtype=U64, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct k-word shingles of each document, end to end.

    A document with fewer than k words, but some, has its whole sequence as its
    only shingle; one without words has none.
    """
    sizes = np.zeros(len(counts), np.int64)
    if not len(words):
        return np.zeros(0, U64), sizes
    factors = mix(np.arange(11, 11 + k, dtype=U64) * _BASE) | U64(1)
    ends = np.cumsum(counts)
    out = np.empty(len(words), U64)
    with np.errstate(over="ignore"):
        wide = np.zeros(len(words), U64)
        for j in range(min(k, len(words))):
            wide[: len(words) - j] += words[j:] * factors[j]
        wide = mix(wide)
        at = 0
        for i in np.flatnonzero(counts).tolist():
            a, c = int(ends[i] - counts[i]), int(counts[i])
            if c >= k:
                one = np.sort(wide[a : a + c - k + 1])
                if len(one) > 1:
                    one = one[np.concatenate(([True], one[1:] != one[:-1]))]
            else:
                one = mix((words[a : a + c] * factors[:c]).sum(dtype=U64, keepdims=True) + U64(c))
            sizes[i] = len(one)
            out[at : at + len(one)] = one
            at += len(one)
    return out[:at], sizes


def lowered_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each step of documents: (first, last, bytes, starts, ends, word hashes, counts), A-Z lower-cased."""
    data, offsets = buffer_of(column)
    for a, b in steps(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, counts = word_spans(part, offsets[a : b + 1] - offsets[a])
        yield a, b, part, starts, ends, span_hashes(part, starts, ends), counts


@dataclass
class CodedWords:
    """The words of a step of documents, as places in the list of its distinct words."""

    first: int  #: The first document of the step,
    last: int  #: and the one after its last.
    counts: np.ndarray  #: Words of each document.
    doc: np.ndarray  #: The document of each word, from 0 at ``first``.
    piece: np.ndarray  #: Equal for the words of one piece of one document.
    codes: np.ndarray  #: The place of each word among the distinct ones.
    distinct: pa.Array  #: The distinct words, as bytes.

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        _, at, data = self.distinct.buffers()
        offsets = np.frombuffer(at, np.int64)[: len(self.distinct) + 1]
        own = span_hashes(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], offsets[1:])
        return own[self.codes]

    def spelled(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that begin at the words ``at``, joined by spaces."""
        parts = [self.distinct.take(pa.array(self.codes[at + j])) for j in range(n)]
        out = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return pa.Array.from_buffers(pa.large_string(), len(out), out.buffers()).cast(pa.string())

    def distinct_phrases(self, at: np.ndarray, n: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a first place, which of them each place has, count) of the distinct phrases of n words at ``at``, by group; no hash decides."""
        size = max(1, len(self.distinct))
        key = self.codes[at].astype(np.int64)
        if group is not None:
            key += group[at].astype(np.int64) * size
        for j in range(1, n):
            key = np.unique(key, return_inverse=True)[1] * size + self.codes[at + j]
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return at[first], which, count


def coded_words(column: pa.Array, kind: np.ndarray) -> Iterator[CodedWords]:
    """The words of each step of documents, A-Z lower-cased; ``kind`` of a byte is 0 in a word, 1 between words, 2 between pieces."""
    data, offsets = buffer_of(column)
    for a, b in steps(offsets):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        sorts = kind[part]
        solid = sorts == 0
        starts, ends, counts = runs(solid, at)
        doc = np.repeat(np.arange(b - a), counts)
        stops = np.cumsum(sorts == 2, dtype=np.int64)
        edges = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=edges[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(part[solid])])
        coded = words.dictionary_encode()
        yield CodedWords(a, b, counts, doc, doc + (stops[starts] if len(starts) else 0), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)
