"""Similarity join of texts by their sets of three-word grams, without comparing all pairs.

A text's set is ordered by one global order, rarest gram first; the sets in this order are
the paths of a prefix tree, and a pair of similar texts meets in the node of its first common
gram. The tree is never held in one place: a node is a key of a shuffle.

Stages (each row-parallel; what is shuffled is said in brackets):

1. ``gram_counts``: one count array of fixed size (2**22 buckets) over the grams of all
   texts; it defines the global order [counts, folded in two levels].
2. ``posted``: of n grams only those are nodes behind which enough grams remain for any
   partner; a gram whose bucket was counted once has none. Exact copies of a text share one
   key, so they are one member. A node of very many texts is dealt to cells, one a pair of
   blocks of texts. The prefixes are written once, packed (``prefixes``) [nothing]; then
   members leave a task as packed blocks of columns [blocks].
3. ``met``: in a node, members are met in order of set size as far as the remaining length
   behind the node can give the threshold; a 384-bit parity of the whole sets then drops
   chance meetings [pairs]. Nodes are dealt to ``PASSES`` passes, so that a pass needs the
   disk of that share of the blocks only; a pass's shuffle files go when it has ended.
4. ``verified``: exact resemblance (or containment) of the remaining pairs [their texts].

No stage estimates: a pair that reaches the threshold passes each of them. Its first common
gram has, in both sets, at least as many grams from there on as must be common, so it lies in
both prefixes; and two parities differ in no more bits than the sets do in grams.

Keys: ``key`` and ``check`` are two hashes of a side and a text. Texts whose ``key`` collides
meet under it and are told apart at the end by ``check`` and the texts themselves.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pauta.cluster import bounded_rows, cut_lineage
from pauta.llm.wordhash import ROW_BITS, distinct_per_row, mix, ngrams, word_hashes

STAGE_WORDS = 3
BUCKET_BITS = 22
BLOCK_BITS = 16
PASSES = 8
GRAM_BITS = 44  # of a gram's hash; what falls together only meets once more
ROWS = 256  # texts sorted at a time: their number takes 8 bits of a sort key
SIG_WORDS = 6  # 64-bit words of a set's parity
HOT = 16_384  # a gram of more texts, by its count above the mean, is dealt to cells
MAX_BLOCKS = 32  # blocks of texts a gram at most: a row is written that many times
HELD = 1_000_000  # members that a task collects before it writes blocks
PART = 100_000  # members a part, on the average
CELL = 4_096  # pairs checked together, on the average
BROADCAST_IDS = 500_000  # 8 bytes an id: a few MB at most
U64 = np.uint64
BLOCK = "part int, node binary, key binary, size binary, place binary, sig binary"


def keyed(records: DataFrame) -> DataFrame:
    """``records (id, side, text)`` with ``key`` and ``check``, equal for copies on one side."""
    return records.withColumns({"key": F.xxhash64("side", "text"), "check": F.xxhash64(F.lit(7), F.length("text"), "text")})


def _batches(it: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches and their texts (column ``text``), cut so that a piece stays near ``most`` bytes."""
    for b in it:
        if not b.num_rows:
            continue
        pieces = max(1, min(b.num_rows, b.nbytes // most))
        step = -(-b.num_rows // pieces)
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            yield part, part.column("text").to_pylist()


def _stage_grams(texts: list, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams (of ``GRAM_BITS``) of the texts of at least ``min_words`` words, and the row of each; not yet distinct."""
    h, o = word_hashes(texts)
    g, row, _ = ngrams(h, o, STAGE_WORDS)
    keep = (np.diff(o) >= min_words)[row]
    return g[keep] >> U64(64 - GRAM_BITS), row[keep]


def _bucket(g: np.ndarray) -> np.ndarray:
    return (mix(g) >> U64(64 - BUCKET_BITS)).astype(np.int64)


class Counts:
    """Bucket counts of both sides, and in which buckets each side has grams."""

    def __init__(self, by_side: list[np.ndarray]):
        self.total = sum(by_side[1:], by_side[0])
        self.seen = [x > 0 for x in by_side]
        self.grams = int(self.total.sum(dtype=np.uint64))
        self.mean = self.grams / len(self.total)


def gram_counts(texts: DataFrame, min_words: int, sides: bool) -> Counts:
    """Counts of the grams of all texts (column ``side`` is 0 or 1); the arrays' size doesn't depend on the data."""
    blocks = 1 << (BUCKET_BITS - BLOCK_BITS)
    n_sides = 2 if sides else 1

    def count(it):
        total = np.zeros((n_sides, 1 << BUCKET_BITS), np.uint32)
        held: list[list[np.ndarray]] = [[] for _ in range(n_sides)]

        def flush() -> None:
            for s in range(n_sides):
                if held[s]:
                    total[s] += np.bincount(_bucket(np.concatenate(held[s])), minlength=1 << BUCKET_BITS).astype(np.uint32)
                    held[s].clear()

        for b, t in _batches(it):
            g, row = _stage_grams(t, min_words)
            side = b.column("side").to_numpy(zero_copy_only=False)
            for s in range(n_sides):
                held[s].append(g[side[row] == s] if sides else g)
            if sum(map(len, held[0])) + (sum(map(len, held[1])) if sides else 0) > 4_000_000:
                flush()
        flush()
        yield _block_rows(total.reshape(n_sides * blocks, -1), range(n_sides * blocks), TaskContext.get().partitionId() % 32)

    def add(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for k, v in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(v), np.uint32)
                total[k] = np.minimum(total[k].astype(np.uint64) + x, U64(0xFFFFFFFF)).astype(np.uint32) if k in total else x
        if total:
            yield _block_rows(list(total.values()), total.keys(), 0)

    schema = "block int, salt int, counts binary"
    folded = texts.mapInArrow(count, schema).repartition("block", "salt").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)
    result = np.zeros((n_sides * blocks, 1 << BLOCK_BITS), np.uint32)
    for r in folded.toLocalIterator():
        result[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return Counts(list(result.reshape(n_sides, -1)))


def _block_rows(arrays, keys, salt: int) -> pa.RecordBatch:
    keys = list(keys)
    return pa.RecordBatch.from_pydict(
        {"block": pa.array(keys, pa.int32()), "salt": pa.array([salt] * len(keys), pa.int32()), "counts": pa.array([zlib.compress(np.ascontiguousarray(a, np.uint32).tobytes(), 1) for a in arrays], pa.binary())}
    )


def _ordered_sets(g: np.ndarray, row: np.ndarray, rows: int, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each row in the global order: by count (on a fine logarithmic scale), then by hash."""
    rank = np.floor(127 * np.log2(np.maximum(counts.total[_bucket(g)], 1))).astype(np.uint64)  # below 2**12
    first = np.searchsorted(row, np.arange(0, rows + ROWS, ROWS))
    out_g, out_row = [], []
    for k in range(len(first) - 1):
        part = slice(first[k], first[k + 1])
        if first[k] == first[k + 1]:
            continue
        key = ((row[part] - k * ROWS).astype(np.uint64) << U64(56)) | (rank[part] << U64(GRAM_BITS)) | g[part]
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        out_g.append(key & U64((1 << GRAM_BITS) - 1))
        out_row.append((key >> U64(56)).astype(np.int64) + k * ROWS)
    return (np.concatenate(out_g), np.concatenate(out_row)) if out_g else (g[:0], row[:0])


def _parity(g: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each row's set: for each of 384 classes of grams, whether it holds an odd number of them."""
    width = SIG_WORDS * 64
    at = ((mix(g ^ U64(0x5BD1E995)) >> U64(20)) % U64(width)).astype(np.int64)
    odd = (np.bincount(row * width + at, minlength=rows * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, width), axis=1).view(np.uint64)


class Wanted:
    """What makes two texts a pair: ``least`` of resemblance, or of containment of the side-1 text."""

    def __init__(self, least: float, contained: bool = False):
        self.least, self.contained = least, contained

    def prefix(self, n: np.ndarray, side: np.ndarray) -> np.ndarray:
        """How many of the rarest grams are nodes."""
        own = n - np.ceil(n * self.least - 1e-9).astype(np.int64) + 1
        return np.where(side == 1, own, n) if self.contained else own

    def common(self, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """How many grams two sets (the second of side 1) must have in common."""
        return n1 * self.least if self.contained else (n0 + n1) * (self.least / (1 + self.least))

    def sizes(self, n: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest set size of a partner of a (side 1) set with ``rest`` grams from the node on."""
        if self.contained:
            return np.ceil(n * self.least - 1e-6), np.where(rest >= n * self.least - 1e-6, np.inf, -1.0)
        return np.ceil(n * self.least - 1e-6), np.floor(np.minimum(n / self.least, rest * ((1 + self.least) / self.least) - n) + 1e-6)

    def holds(self, n0: np.ndarray, n1: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Whether two sets with ``common`` grams in common are a pair."""
        return (n0 + n1 > 0) & (common >= (self.least * n1 if self.contained else self.least * (n0 + n1 - common)) - 1e-9)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, all lowest bytes first: what is constant compresses away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _cells(node: np.ndarray, row: np.ndarray, place: np.ndarray, key: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, with those of very large nodes in cells (own block, any block): every two texts share one."""
    k = np.where(above > HOT, np.clip(np.ceil(above / HOT), 2, MAX_BLOCKS), 1).astype(np.int64)
    if not (k > 1).any():
        return node, row, place
    one = np.repeat(np.arange(len(node)), k)
    other = np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k)
    own = (mix(key[row[one]]) % k[one].astype(U64)).astype(np.int64)
    cell = np.minimum(own, other) * MAX_BLOCKS + np.maximum(own, other)
    split = mix((node[one] << U64(64 - GRAM_BITS)) + cell.astype(U64) + U64(1)) >> U64(64 - GRAM_BITS)
    return np.where(k[one] > 1, split, node[one]), row[one], place[one]


def prefixes(texts: DataFrame, shared, min_words: int, wanted: Wanted, sides: bool) -> DataFrame:
    """Packed rows of whole batches of texts: keys, sizes, parities, and the nodes of each text with their places."""

    def emit(it):
        counts: Counts = shared.value
        for b, t in _batches(it):
            g, row = _stage_grams(t, min_words)
            if not len(g):
                continue
            g, row = _ordered_sets(g, row, len(t), counts)
            side = b.column("side").to_numpy(zero_copy_only=False).astype(np.int64)
            key = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.bincount(row, minlength=len(t))
            sig = _parity(g, row, len(t))
            place = np.arange(len(g)) - (np.cumsum(n) - n)[row]
            keep = np.flatnonzero(place < wanted.prefix(n, side)[row])
            node, row, place = g[keep], row[keep], place[keep]
            at = _bucket(node)
            if sides:  # a text meets only grams that the other side has
                partner = np.where(side[row] == 0, counts.seen[1][at], counts.seen[0][at])
            else:
                partner = counts.total[at] > 1
            node, row, place, at = node[partner], row[partner], place[partner], at[partner]
            if not len(node):
                continue
            above = counts.total[at] - counts.mean - 3 * np.sqrt(counts.mean)
            node, row, place = _cells(node, row, place, key, above)
            kept = np.bincount(row, minlength=len(t))
            some = kept > 0
            order = np.argsort(row, kind="stable")
            packed = [key[some].tobytes(), (n[some] * 2 + side[some]).astype(np.uint32).tobytes(), sig[some].tobytes(), kept[some].astype(np.uint32).tobytes()]
            packed += [_planes(node[order])[: 6 * len(node)], zlib.compress(_planes(place[order].astype(np.uint32)), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["key", "size", "sig", "kept", "node", "place"])

    return texts.mapInArrow(emit, "key binary, size binary, sig binary, kept binary, node binary, place binary")


def posted(packed: DataFrame, turn: int, parts: int) -> DataFrame:
    """Blocks of the members of the nodes of pass ``turn``, by the part that a node falls to."""

    def emit(it):
        held: list[tuple[np.ndarray, ...]] = []

        def blocks():
            node, key, size, place, sig = (np.concatenate(x) for x in zip(*held))
            held.clear()
            part = (mix(node) // U64(PASSES) % U64(parts)).astype(np.int64)
            order = np.argsort((part.astype(np.uint64) << U64(GRAM_BITS)) | node)  # parts stay below 2**20
            node, key, size, place, sig, part = (x[order] for x in (node, key, size, place, sig, part))
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            rows = []
            for low, high in zip(edge[:-1], edge[1:]):
                one = slice(low, high)
                rows.append([int(part[low]), _planes(np.diff(node[one], prepend=U64(0))), _planes(key[one]), _planes(size[one]), _planes(place[one]), sig[one].tobytes()])
            for k in range(0, len(rows), 64):
                columns = list(zip(*rows[k : k + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "node", "key", "size", "place", "sig"])

        for b in it:
            for r in b.to_pylist():
                n = len(r["node"]) // 6
                node = _from_planes(r["node"] + bytes(2 * n), np.uint64)
                at = np.flatnonzero(mix(node) % U64(PASSES) == turn)
                if not len(at):
                    continue
                row = np.repeat(np.arange(len(r["kept"]) // 4), np.frombuffer(r["kept"], np.uint32))[at]
                key, size = np.frombuffer(r["key"], np.uint64)[row], np.frombuffer(r["size"], np.uint32)[row]
                place = _from_planes(zlib.decompress(r["place"]), np.uint32)[at]
                held.append((node[at], key, size, place, np.frombuffer(r["sig"], np.uint64).reshape(-1, SIG_WORDS)[row]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from blocks()
        if held:
            yield from blocks()

    return packed.mapInArrow(emit, BLOCK)


def _first(node: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where an ordered (node, key) differs from the one before."""
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (key[1:] != key[:-1])
    return new


def _spans(node: np.ndarray, size: np.ndarray, place: np.ndarray, side: np.ndarray, wanted: Wanted, sides: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, first, width, other): member i meets ``other[first : first + width]``; the arrays are ordered by node and size.

    A member takes no part where even the smallest set of its node asks for more grams in
    common than it has from the node on.
    """
    group = np.cumsum(np.concatenate(([0], node[1:] != node[:-1])))
    low, high = (np.clip(x, -1, 2**32 - 1).astype(np.int64) for x in wanted.sizes(size, size - place))
    smallest = size[np.searchsorted(group, group)]
    able = np.flatnonzero((high >= smallest) | ((side == 0) & wanted.contained))
    group, low, high, size, side = group[able], low[able], high[able], size[able], side[able]
    edge = group << 32
    key = edge + size
    if sides:
        other, i = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        first = np.searchsorted(key[other], edge[i] + low[i], side="left")
        last = np.searchsorted(key[other], edge[i] + high[i], side="right")
    else:
        other = i = np.arange(len(able))
        first = i + 1
        last = np.searchsorted(key, edge + high, side="right")
    return able[i], first, np.maximum(last - first, 0), able[other]


def _pairs_of(node, key, size2, place, sig, wanted: Wanted, sides: bool, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (a, b) of the plausible pairs of a part's members, in pieces."""
    order = np.lexsort((key, size2, node))
    order = order[_first(node[order], key[order])]
    node, key, size2, place, sig = node[order], key[order], size2[order], place[order].astype(np.int64), sig[order]
    if not len(node):
        return
    size, side = (size2 >> np.uint32(1)).astype(np.int64), (size2 & np.uint32(1)).astype(np.int8)
    i, first, width, other = _spans(node, size, place, side, wanted, sides)
    some = width > 0
    i, first, width = i[some], first[some], width[some]
    bits = [np.ascontiguousarray(sig[:, k]) for k in range(SIG_WORDS)]
    total = np.cumsum(width)
    low, skipped = 0, 0  # members before ``low`` are done, and ``skipped`` partners of member ``low``
    while low < len(i):
        high = max(low + 1, int(np.searchsorted(total, total[low] - width[low] + skipped + most, side="right")))
        w, f = width[low:high].copy(), first[low:high].copy()
        w[0] -= skipped
        f[0] += skipped
        if w[0] > most:  # one member with very many partners: in pieces
            w, f, high, skipped = np.array([most]), f[:1], low, skipped + most
        else:
            skipped = 0
        one = i[low : max(high, low + 1)]
        y = other[np.repeat(f - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))]
        n0, n1 = size[y], np.repeat(size[one], w)
        spare = n0 + n1 - 2 * wanted.common(n0, n1) + 1e-6
        x = np.repeat(one, w)
        for words in (range(SIG_WORDS // 2), range(SIG_WORDS // 2, SIG_WORDS)):
            differ = np.zeros(len(x), np.int16) if not words.start else differ
            for k in words:
                differ += np.bitwise_count(bits[k][x] ^ bits[k][y])
            ok = differ <= spare
            x, y, spare, differ = x[ok], y[ok], spare[ok], differ[ok]
        a, b = key[y].view(np.int64), key[x].view(np.int64)
        yield (a, b) if sides else (np.minimum(a, b), np.maximum(a, b))
        low = high


def met(blocks: DataFrame, wanted: Wanted, sides: bool) -> DataFrame:
    """Distinct pairs of keys (a, b), a < b, or with sides a of side 0 and b of side 1, that meet in a node."""

    def part_pairs(held: list[dict]) -> Iterator[pa.RecordBatch]:
        node = np.concatenate([np.cumsum(_from_planes(r["node"], np.uint64), dtype=np.uint64) for r in held])
        key, size, place = (np.concatenate([_from_planes(r[c], kind) for r in held]) for c, kind in (("key", np.uint64), ("size", np.uint32), ("place", np.uint32)))
        sig = np.concatenate([np.frombuffer(r["sig"], np.uint64).reshape(-1, SIG_WORDS) for r in held])
        found, n = [], 0
        for a, b in _pairs_of(node, key, size, place, sig, wanted, sides):
            found.append(np.stack([a, b], axis=1)[a != b])
            n += len(found[-1])
            if n > 1_000_000:
                yield _pair_rows(found)
                found, n = [], 0
        yield _pair_rows(found)

    def meet(it):
        held: list[dict] = []
        for b in it:
            for r in b.to_pylist():
                if held and held[0]["part"] != r["part"]:
                    yield from part_pairs(held)
                    held = []
                held.append(r)
        if held:
            yield from part_pairs(held)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "a bigint, b bigint").distinct()


def _pair_rows(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0]), pa.int64()), pa.array(np.ascontiguousarray(p[:, 1]), pa.int64())], ["a", "b"])


def common_grams(g: np.ndarray, offsets: np.ndarray, ia: np.ndarray, ib: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """Of each pair of rows (ia, ib): how many grams both hold; row i has the distinct ``g[offsets[i]:offsets[i + 1]]``."""
    n = np.diff(offsets)
    out = np.zeros(len(ia), np.int64)
    total = np.cumsum(n[ia] + n[ib])
    low = 0
    while low < len(ia):
        high = int(np.searchsorted(total, (total[low - 1] if low else 0) + most, side="right"))
        high = min(max(high, low + 1), low + (1 << ROW_BITS) - 1)
        rows = np.concatenate([ia[low:high], ib[low:high]])
        w = n[rows]
        at = np.repeat(offsets[rows] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        pair = np.repeat(np.tile(np.arange(high - low), 2), w)
        key = (pair.astype(U64) << U64(64 - ROW_BITS)) | (g[at] >> U64(ROW_BITS))
        key.sort()
        both = (key[1:][key[1:] == key[:-1]] >> U64(64 - ROW_BITS)).astype(np.int64)
        out[low:high] = np.bincount(both, minlength=high - low)
        low = high
    return out


def only(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``keys`` (one column); broadcast up to a checked number."""
    keys = keys.toDF(column)
    return df.join(F.broadcast(keys) if bounded_rows(keys, BROADCAST_IDS) else keys, column, "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, wanted: Wanted) -> DataFrame:
    """Pairs that reach the threshold: (a, a_check, b, b_check, size_a, size_b, common); one row a pair of texts.

    Texts are dealt to blocks, and a pair is checked in the cell of its two blocks, to which
    each text goes once, however many partners it has there. The number of blocks grows with
    the root of the pairs, so a cell stays near ``CELL`` pairs.
    """
    blocks = max(1, math.ceil((2 * pairs.count() / CELL) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(blocks))
    placed = pairs.select((block("a") * blocks + block("b")).alias("cell"), "a", "b")
    ends = placed.select("cell", F.col("a").alias("key")).union(placed.select("cell", "b")).distinct()
    mine = only(texts.select("key", "check", "text"), "key", ends.select("key").distinct()).groupBy("key", "check").agg(F.first("text").alias("text"))
    none = F.lit(None).cast("bigint")
    rows = ends.join(mine, "key").select("cell", "key", "check", "text", none.alias("b")).union(placed.select("cell", "a", none, F.lit(None).cast("string"), "b"))

    def cell_pairs(keys: list, checks: list, held: list, a: list, b: list) -> Iterator[pa.RecordBatch]:
        g, r, _ = ngrams(*word_hashes(held), STAGE_WORDS)
        g, r = distinct_per_row(g, r)
        n = np.bincount(r, minlength=len(held))
        offsets = np.concatenate(([0], np.cumsum(n)))
        rows_of: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            rows_of.setdefault(k, []).append(i)
        each = [(i, j) for x, y in zip(a, b) for i in rows_of.get(x, ()) for j in rows_of.get(y, ())]
        ia, ib = np.array(each, np.int64).reshape(-1, 2).T
        common = common_grams(g, offsets, ia, ib)
        ok = wanted.holds(n[ia], n[ib], common)
        ia, ib, common = ia[ok], ib[ok], common[ok]
        k, c = np.array(keys, np.int64), np.array(checks, np.int64)
        columns = [k[ia], c[ia], k[ib], c[ib], n[ia].astype(np.int32), n[ib].astype(np.int32), common.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "a_check", "b", "b_check", "size_a", "size_b", "common"])

    def check(it):
        now, state = None, ([], [], [], [], [])
        for rb in it:
            cell = rb.column("cell").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else []
            for low, high in zip(edge[:-1], edge[1:]):
                if cell[low] != now:
                    if state[3]:
                        yield from cell_pairs(*state)
                    now, state = cell[low], ([], [], [], [], [])
                part = rb.slice(low, high - low)
                pair = part.column("b").is_valid()
                own = part.filter(pa.compute.invert(pair))
                for k, name in enumerate(("key", "check", "text")):
                    state[k].extend(own.column(name).to_pylist())
                links = part.filter(pair)
                state[3].extend(links.column("key").to_pylist())
                state[4].extend(links.column("b").to_pylist())
        if state[3]:
            yield from cell_pairs(*state)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(check, "a bigint, a_check bigint, b bigint, b_check bigint, size_a int, size_b int, common int")


def similar_texts(texts: DataFrame, wanted: Wanted, *, min_words: int, sides: bool = False) -> DataFrame:
    """Verified pairs among ``texts (key, check, side, text)``; see :func:`keyed`. Written to the checkpoint folder."""
    counts = gram_counts(texts, min_words, sides)
    parts = min(max(8, -(-counts.grams // (2 * PASSES * PART))), (1 << 20) - 1)
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    packed = cut_lineage(prefixes(texts, shared, min_words, wanted, sides))
    turns = [cut_lineage(met(posted(packed, turn, parts), wanted, sides)) for turn in range(PASSES)]
    found = turns[0]
    for x in turns[1:]:
        found = found.union(x)
    out = cut_lineage(verified(cut_lineage(found.distinct()), texts, wanted))
    shared.unpersist()
    return out


def long_copies(texts: DataFrame, members: DataFrame, min_words: int) -> DataFrame:
    """(key, check) of the texts that several ids share and that have at least ``min_words`` words."""
    several = members.groupBy("key", "check").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least <> last").select("key")
    heads = only(texts.select("key", "check", "text"), "key", several).groupBy("key", "check").agg(F.first("text").alias("text"))

    def count(it):
        for b in it:
            ok = np.diff(word_hashes(b.column("text").to_pylist())[1]) >= min_words
            yield b.select(["key", "check"]).filter(pa.array(ok))

    return heads.mapInArrow(count, "key bigint, check bigint")
