"""Near-duplicate join: n-gram Jaccard by size-banded tiles and hashed bitmaps.

Two documents link when the Jaccard similarity of their sets of k-word shingles
reaches the threshold.  The join is exact on 64-bit shingle hashes:

1.  Documents with the same set are one class; only its first row goes on.
2.  Tiles.  Shingles have one global order, rare before frequent.  Two linked
    sets share a shingle among the first ``n - ceil(t*n) + 1`` of each, so every
    such shingle is a tile, and candidates are pairs of a tile in compatible
    *size bands*.  A shingle of very many documents becomes a grid of tiles, in
    each of which two bounded blocks of documents meet.
3.  Signatures.  A candidate passes if the *bit counts* of two hashed bitmaps
    allow enough overlap: every bit that only one side has stands for at least
    one shingle that only this side has.
4.  What passes is intersected exactly, as sorted arrays.

Groups of thousands of near copies would give pairs with the square of their
size.  So a first round groups documents by equal min-hashes and links them along
a maximum spanning tree of the similarities that their bitmaps allow: one
candidate a document, verified by 4.  A tile of the second round then only tries
pairs whose documents are not connected yet, and yields those that pass 3.  No
link between two components can be lost by that, as the second round tries every
candidate across components.

Defined results
  * null or wordless text: empty set, linked with nothing, its own component.
  * fewer than k words: the whole sequence is the only shingle.
  * very long texts: whole; the bitmap grows with the set, up to ``MAX_BITS``.
  * repeated rows: equal sets, hence one component; each row is returned.
  * null id: a row of its own, linked by its text; in a component it counts only
    if there is no other id.
  * empty table: an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .components import components
from .store import discard, materialize, small_batches

#: The global order knows at most so many frequent shingles; the order decides speed, not results.
#: Tiles of frequent shingles that it does not know are split by their true sizes.
MAX_FREQUENT = 1 << 19
#: A task reports shingles that it meets so often.
FREQUENT_IN_TASK = 2
MIN_HASHES = 4
MAX_BITS = 1 << 17
#: Documents of one side of a tile, and entries of one tile group.
TILE_SIDE = 4096
GROUP_ENTRIES = 1_000_000
MIN_GROUPS = 6
#: Rows of one spanning tree.
TREE_ROWS = 64
_FLUSH = 2_000_000


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of shingles met often, sorted by hash; at most MAX_FREQUENT of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            h, at = np.unique(np.concatenate((known[0], h)), return_inverse=True)
            return h, np.bincount(at, np.concatenate((known[1], c)), len(h)).astype(np.int64)

        for batch in batches:
            for *_, words, counts in X.lowered_words(batch.column(0)):
                sets = X.shingle_sets(words, counts, k)[0]
                held.append(sets)
                size += len(sets)
                if size >= _FLUSH:
                    known = fold()
                    held, size = [], 0
        h, c = fold()
        keep = c >= FREQUENT_IN_TASK
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["h", "c"])

    total = materialize(docs.select("_text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    # Counts by eighths of a power of two, at most 504 rows, tell from where on the list is short enough.
    level = F.floor(F.log2("c") * 8)
    by = {r[0]: r[1] for r in total.groupBy(level.alias("p")).count().collect()}
    p, rows = max(by, default=0), 0
    while p >= 0 and rows + by.get(p, 0) <= MAX_FREQUENT:
        rows += by.get(p, 0)
        p -= 1
    found = total.where(level > p).toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    discard(total)
    return h[order], c[order]


def _bitmap(hashes: np.ndarray) -> bytes:
    size = min(MAX_BITS, max(64, 1 << int(8 * len(hashes) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(7)) & np.uint64(size - 1)] = 1
    return np.packbits(bits).tobytes()


def _features(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """Per row: n, set digest, bitmap, prefix shingles (rare first) and min-hashes."""
    seeds = X.mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = frequent.value
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "d1", "d2", "bits", "prefix", "keys")}
            for *_, words, counts in X.lowered_words(batch.column(1)):
                sets, sizes = X.shingle_sets(words, counts, k)
                if len(often):
                    at = np.minimum(np.searchsorted(often, sets), len(often) - 1)
                    rank = np.where(often[at] == sets, count[at], 0)
                else:
                    rank = np.zeros(len(sets), np.int64)
                ends = np.cumsum(sizes)
                some = np.flatnonzero(sizes)
                first = (ends - sizes)[some]
                d1, d2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                keys = np.zeros((MIN_HASHES, len(sizes)), np.uint64)
                if len(some):
                    with np.errstate(over="ignore"):
                        d1[some] = np.add.reduceat(X.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), first)
                        d2[some] = np.bitwise_xor.reduceat(X.mix(sets + np.uint64(0x14057B7EF767814F)), first)
                        for j, seed in enumerate(seeds):
                            keys[j, some] = np.minimum.reduceat(X.mix(sets ^ seed), first) ^ seed
                for i, n in enumerate(sizes.tolist()):
                    one, r = sets[ends[i] - n : ends[i]], rank[ends[i] - n : ends[i]]
                    length = n - (percent * n + 99) // 100 + 1 if n else 0
                    rare = one[r == 0]
                    if len(rare) < length:
                        # Frequent shingles follow, by count and then by hash.
                        rest = np.flatnonzero(r)
                        rare = np.concatenate((rare, one[rest[np.lexsort((one[rest], r[rest]))]]))
                    out["bits"].append(_bitmap(one) if n else b"")
                    out["prefix"].append(rare[:length].tobytes())
                out["n"].append(sizes)
                out["d1"].append(d1.view(np.int64))
                out["d2"].append(d2.view(np.int64))
                out["keys"].append(keys.view(np.int64).T)
            flat = np.concatenate(out["keys"]).ravel() if out["keys"] else np.zeros(0, np.int64)
            at = pa.array(np.arange(0, len(flat) + 1, MIN_HASHES, dtype=np.int32))
            join = lambda c: pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), join("n"), join("d1"), join("d2"), pa.array(out["bits"], pa.binary()), pa.array(out["prefix"], pa.binary()), pa.ListArray.from_arrays(at, pa.array(flat))],
                ["_id", "_tag", "n", "d1", "d2", "bits", "prefix", "keys"],
            )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text", "_tag").mapInArrow(make, f"_id {kind}, _tag long, n long, d1 long, d2 long, bits binary, prefix binary, keys array<long>").withColumn("row", F.monotonically_increasing_id())


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def _common_bits(x: np.ndarray) -> np.ndarray:
    """How many bits each pair of rows of a bitmap matrix shares."""
    wide = np.unpackbits(x, axis=1).astype(np.float32)
    return wide @ wide.T


def _tree(rows: np.ndarray, n: np.ndarray, bits: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning tree of the allowed similarity, as far as it reaches the threshold."""
    order = np.argsort(-n, kind="stable")
    edges, at = [], 0
    while at < len(order) - 1:
        # Sizes that can link with the largest that is left, and half as many more below.
        block = order[at:][n[order[at:]] * 2 >= n[order[at]]]
        # The tree only proposes, so its bitmaps are folded to fit in memory.
        size = min(min(len(bits[i]) for i in block), max(64, 1 << ((1 << 20) // len(block)).bit_length() - 1))
        x = np.stack([_fold(bits[i], size) for i in block])
        own, common, m = np.bitwise_count(x).sum(1).astype(np.float32), _common_bits(x), n[block].astype(np.float32)
        most = np.minimum(m[:, None] - own[:, None] + common, m[None, :] - own[None, :] + common)
        similar = most / (m[:, None] + m[None, :] - most)
        best, link, todo = similar[0].copy(), np.zeros(len(block), np.int64), np.ones(len(block), bool)
        todo[0] = False
        for _ in range(len(block) - 1):
            j = int(np.where(todo, best, -1.0).argmax())
            todo[j] = False
            if best[j] * 100 >= percent - 0.01:
                edges.append((int(rows[block[link[j]]]), int(rows[block[j]])))
            nearer = similar[j] > best
            best[nearer], link[nearer] = similar[j][nearer], j
        # The next block starts below what the largest can link with.
        at += max(1, int((n[order[at:]] * 4 >= n[order[at]] * 3).sum()))
    return edges


def _tree_pairs(keyed: DataFrame, percent: int, groups: int) -> DataFrame:
    """Candidate pairs (a, b), about one a document; keyed: j, key, part, row, n, bits."""

    def grow(table):
        rows, n = table.column("row").to_numpy(), table.column("n").to_numpy()
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("j", "key", "part")])
        order = np.lexsort((rows, *key))
        key = key[:, order]
        cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0), [True]))) if len(rows) else np.zeros(1, np.int64)
        bits = table.column("bits")
        pairs: set[tuple[int, int]] = set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[a:b]
            if b - a == 2:
                pairs.add((int(rows[at[0]]), int(rows[at[1]])))
            elif b - a > 2:
                own = [np.frombuffer(bits[int(i)].as_buffer(), np.uint8) for i in at]
                pairs.update((min(e), max(e)) for e in _tree(rows[at], n[at], own, percent))
        out = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    spread = keyed.withColumn("g", F.pmod(F.xxhash64("j", "key", "part"), F.lit(groups)))
    return spread.groupBy("g").applyInArrow(grow, "a long, b long").distinct()


def _test_bits(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of indices may reach the threshold, by sizes and bit counts."""
    keep = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
    sizes = np.array([len(x) for x in bits], np.int64)
    for size in np.unique(sizes).tolist():
        here = np.flatnonzero(keep & (np.minimum(sizes[a], sizes[b]) == size))
        if not len(here):
            continue
        used, local = np.unique(np.concatenate((a[here], b[here])), return_inverse=True)
        x = np.stack([_fold(bits[i], size) for i in used])
        own, half = np.bitwise_count(x).sum(1, dtype=np.int64), len(here)
        step = max(1, (8 << 20) // size)
        for c in range(0, half, step):
            i, j = local[:half][c : c + step], local[half:][c : c + step]
            common = np.bitwise_count(x[i] & x[j]).sum(1, dtype=np.int64)
            na, nb = n[used[i]], n[used[j]]
            most = np.minimum(na - own[i] + common, nb - own[j] + common)
            keep[here[c : c + step]] = 100 * most >= percent * (na + nb - most)
    return keep


def _linked(pairs: DataFrame, features: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold, written; ``pairs`` goes."""
    spark = docs.sparkSession
    rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = materialize(features.select("row", F.col("_id").alias("_nid"), F.col("_tag").alias("_ntag")).join(rows, "row", "left_semi"), "needed")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *_, words, counts in X.lowered_words(batch.column(0)):
                sets, sizes = X.shingle_sets(words, counts, k)
                out += [one.tobytes() for one in np.split(sets, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["row", "elements"])

    # The same plan at every size: texts meet their rows by id and hash.
    met = docs.join(needed.hint("merge"), docs["_id"].eqNullSafe(needed["_nid"]) & (docs["_tag"] == needed["_ntag"]))
    sets = materialize(met.select("_text", "row").mapInArrow(collect, "row long, elements binary"), "sets")
    both = pairs.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    small_batches(spark)
    out = materialize(both.select("a", "b", "xa", "xb").mapInArrow(intersect, "a long, b long").distinct(), "links")
    for table in (needed, sets, pairs):
        discard(table)
    return out


def _band(n: np.ndarray) -> np.ndarray:
    """Size bands 10 % wide, as bytes below 128 up to sizes of 10**5, 255 at most."""
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / np.log(1.1)), 250).astype(np.uint8)


def _split(part: np.ndarray, row: np.ndarray, cluster: np.ndarray, leader: np.ndarray, wide: set[int]) -> tuple[np.ndarray, ...]:
    """The entries of tiles, the ``wide`` ones replaced by grids: block i meets block j in a tile of its own."""
    out = [tuple(x[~np.isin(part, list(wide))] for x in (part, row, cluster, leader))]
    for tile in sorted(wide):
        at = np.flatnonzero(part == tile)
        grid = -(-len(at) // TILE_SIDE)
        block = (X.mix(row[at].astype(np.uint64)) % np.uint64(grid)).astype(np.int64)
        for i in range(grid):
            for j in range(i, grid):
                here = at[(block == i) | (block == j)]
                # Below zero, so apart from every row and every other tile.
                own = np.full(len(here), -1 - int(X.mix(np.array([(tile * grid * grid + i * grid + j) % (1 << 64)], np.uint64))[0] >> np.uint64(2)))
                out.append((own, row[here], cluster[here], own))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _candidates(entries: DataFrame, features: DataFrame, percent: int, groups: int, frequent) -> DataFrame:
    """Pairs (a, b) of unconnected documents that share a tile, written; entries: row, n, prefix, cluster (null: alone)."""
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.1))) + 1

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = frequent.value
        often_grid = (count + TILE_SIDE - 1) // TILE_SIDE
        often, often_grid = often[often_grid > 1], often_grid[often_grid > 1]
        held: list[tuple] = []
        size = 0

        def flush():
            tile, doc = np.concatenate([t for t, *_ in held]), np.repeat(np.arange(len(held)), [len(t) for t, *_ in held])
            row, band, cluster = (np.array([h[j] for h in held], kind) for j, kind in ((1, np.int64), (2, np.uint8), (3, np.int64)))
            group = (tile >> np.uint64(40)) % np.uint64(groups)
            low = (tile & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((low, group))
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            out: tuple[list, ...] = ([], [], [], [], [])
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[g] : cuts[g + 1]]
                docs = doc[at]
                out[0].append(g)
                for column, x in zip(out[1:], (low[at], row[docs], band[docs], cluster[docs][cluster[docs] >= 0]), strict=True):
                    column.append(x.tobytes())
            # A document in a cluster has the high bit of its band byte set.
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["g", "tile", "row", "band", "cluster"])

        for batch in batches:
            rows, ns = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            bands, clusters = _band(ns), batch.column(3).to_pylist()
            for i, row in enumerate(rows):
                tile = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, tile), len(often) - 1)
                    hot = often[at] == tile
                    if hot.any():
                        # A grid over blocks of documents: block i meets block j in tile (i, j).
                        more = [tile[~hot]]
                        for h, grid in zip(tile[hot], often_grid[at[hot]].tolist(), strict=True):
                            own = int(X.mix(np.array([row], np.uint64))[0]) % grid
                            other = np.arange(grid, dtype=np.uint64)
                            low, high = np.minimum(other, np.uint64(own)), np.maximum(other, np.uint64(own))
                            with np.errstate(over="ignore"):
                                more.append(X.mix(h + low * np.uint64(grid) + high + np.uint64(1)))
                        tile = np.concatenate(more)
                cluster = clusters[i]
                held.append((X.mix(tile), row, int(min(bands[i], 127)) | (128 if cluster is not None else 0), -1 if cluster is None else cluster))
                size += len(tile)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def mixed(table):
        """Tiles whose documents are not all connected: rows with their tiles, by the tile's first row."""
        read = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)])
        tile, row, band = read("tile", np.uint32), read("row", np.int64), read("band", np.uint8)
        cluster = -1 - row
        cluster[band >= 128] = read("cluster", np.int64)
        order = np.lexsort((band & 127, tile))
        tile, row, cluster, band = tile[order], row[order], cluster[order], (band[order] & 127).astype(np.int64)
        # A tile is cut between size bands that cannot link; the last band is open to above.
        new = np.concatenate(([True], (tile[1:] != tile[:-1]) | ((band[1:] - band[:-1] > reach) & (band[1:] < 127)))) if len(tile) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        keep, leader = np.zeros(0, bool), np.zeros(0, np.int64)
        part = np.cumsum(new) - 1
        if len(starts):
            keep = (np.minimum.reduceat(cluster, starts) != np.maximum.reduceat(cluster, starts))[part]
            leader = np.minimum.reduceat(row, starts)[part]
        part, row, cluster, leader = (x[keep] for x in (part, row, cluster, leader)) if len(keep) else (np.zeros(0, np.int64),) * 4
        wide = np.flatnonzero(np.bincount(part, minlength=1) > TILE_SIDE)
        part = part + (table.column("g")[0].as_py() << 32 if len(part) else 0)
        if len(wide):
            part, row, cluster, leader = _split(part, row, cluster, leader, set((wide + (table.column("g")[0].as_py() << 32)).tolist()))
        order = np.lexsort((row, leader))
        row, cluster, leader, part = row[order], cluster[order], leader[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (leader[1:] != leader[:-1])))) if len(row) else np.zeros(0, np.int64)
        cuts = np.concatenate((first, [len(row)])).tolist()
        tiles = [part[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"leader": pa.array(leader[first]), "row": pa.array(row[first]), "cluster": pa.array(cluster[first]), "tiles": pa.array(tiles, pa.binary())})

    def meet(table):
        leaders = table.column("leader").to_numpy()
        order = np.lexsort((table.column("n").to_numpy(), leaders))
        table = table.take(pa.array(order))
        row, cluster, n = (table.column(c).to_numpy() for c in ("row", "cluster", "n"))
        leaders = leaders[order]
        bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
        tiles = [np.concatenate([np.frombuffer(x, np.int64) for x in some]) for some in table.column("tiles").to_pylist()]
        cuts = np.flatnonzero(np.concatenate(([True], leaders[1:] != leaders[:-1], [True]))) if len(row) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for i, j in _met(tiles[a:b], n[a:b], cluster[a:b], percent):
                keep = _test_bits(a + i, a + j, n, bits, percent)
                out.append(np.stack((row[a + i[keep]], row[a + j[keep]]), 1))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    scattered = entries.select("row", "n", "prefix", "cluster").mapInArrow(scatter, "g int, tile binary, row binary, band binary, cluster binary")
    found = scattered.groupBy("g").applyInArrow(mixed, "leader long, row long, cluster long, tiles binary")
    rows = materialize(found.groupBy("leader", "row").agg(F.first("cluster").alias("cluster"), F.collect_list("tiles").alias("tiles")), "mixed")
    signed = rows.join(features.select("row", "n", "bits"), "row").withColumn("h", F.pmod(F.xxhash64("leader"), F.lit(4 * groups)))
    out = materialize(signed.groupBy("h").applyInArrow(meet, "a long, b long").distinct(), "candidates")
    discard(rows)
    return out


def _met(tiles: list[np.ndarray], n: np.ndarray, cluster: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, each once, that share a tile, are in different clusters and of fitting size; n ascends.

    Documents are taken a block at a time against those after them, in a matrix
    of bounded size that every shared tile marks.
    """
    doc = np.repeat(np.arange(len(tiles)), [len(t) for t in tiles])
    tile = np.unique(np.concatenate(tiles), return_inverse=True)[1]
    order = np.lexsort((doc, tile))
    doc, cuts = doc[order], np.concatenate(([0], np.cumsum(np.bincount(tile))))
    # Partners of i end before the first document that is too large for it.
    end = np.searchsorted(n * percent, n * 100, side="right")
    step = max(1, (16 << 20) // len(tiles))
    for a in range(0, len(tiles), step):
        b = min(len(tiles), a + step)
        marks = np.zeros((b - a, len(tiles)), bool)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = doc[s:e]
            lo, hi = np.searchsorted(own, (a, b))
            if lo < hi:
                marks[np.ix_(own[lo:hi] - a, own[lo:])] = True
        i, j = np.nonzero(marks)
        i += a
        keep = (j > i) & (j < end[i]) & (cluster[i] != cluster[j])
        if keep.any():
            yield i[keep], j[keep]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_links``.

    ``component_id`` is the smallest id reachable by links, the own included;
    ``n_links`` counts the verified links of the row's set that were needed to
    connect its component (it is 0 just if the set is linked with no other set).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_tag"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, k))
    features = materialize(_features(docs, k, percent, frequent), "features")

    # Classes of equal sets.
    classes = materialize(features.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    members = materialize(features.select("row", "_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("row", "_id", "n", F.coalesce("rep", "row").alias("rep")), "members")
    reps = members.where("row = rep and n > 0").select("row")

    # First round: along trees, among rows of equal min-hash.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = materialize(features.select("row", "keys").join(reps, "row", "left_semi").select("row", F.posexplode("keys").alias("j", "key")), "keyed")
    shared = materialize(keyed.groupBy(F.col("j").alias("pj"), F.col("key").alias("pkey")).agg(F.count("*").alias("c")).where("c > 1"), "shared")
    part = F.pmod(F.xxhash64("row", "j"), F.ceil(F.col("c") / TREE_ROWS))
    some = keyed.join(shared, (F.col("key") == F.col("pkey")) & (F.col("j") == F.col("pj"))).select("j", "key", "row", part.alias("part"))
    first = _linked(materialize(_tree_pairs(some.join(features.select("row", "n", "bits"), "row"), percent, 2 * partitions), "pairs"), features, docs, k, percent)
    for table in (classes, keyed, shared):
        discard(table)
    clusters = materialize(components(first), "clusters")

    # Second round: all tiles, across what is not connected yet.
    entries = features.select("row", "n", "prefix").join(reps, "row", "left_semi").join(clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster")), "row", "left")
    total = features.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    groups = max(MIN_GROUPS, int(total / GROUP_ENTRIES))
    second = _linked(_candidates(entries, features, percent, groups, frequent), features, docs, k, percent)
    discard(features)

    links = first.unionByName(second)
    roots = materialize(components(links), "roots")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = materialize(roots.join(degrees, "node", "left"), "known")
    for table in (first, second, clusters, roots):
        discard(table)
    placed = materialize(members.join(known, F.col("rep") == F.col("node"), "left").select("_id", "n", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "placed")
    for table in (members, known):
        discard(table)
    # Rows alone in their component need no join.
    least = materialize(placed.groupBy(F.col("root").alias("r")).agg(F.min("_id").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c"), "least")
    return placed.join(least, F.col("root") == F.col("r"), "left").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), "n_links")
