"""SimHash near-duplicates by pivot distance tables.

A fingerprint's table is its Hamming distances to many reference fingerprints. By the triangle inequality two fingerprints at
distance d differ by at most d in every coordinate, so a pair whose largest coordinate difference is above the limit is
discarded, and only survivors are compared bit by bit.

The table also says where to look. Pivots come in two kinds. Local pivots live on one of six segments of the 64 bits:
distances within a segment add up to the whole distance, so with 3 differing bits at most, at least three segments
are without a difference, and there all local coordinates agree. A fingerprint is looked up under each choice of three
segments, by the local coordinates of these: 20 keys of 31 to 33 bits, none of which a linked pair can miss. Global
pivots then discard by coordinate difference. Under one key, fingerprints are compared in blocks sorted by their first
global coordinate, each with those within the limit of it, and a spanning forest of the links is given, not all pairs.

Equal fingerprints are one node, so copies cost nothing beyond their fingerprint.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a null id takes part and has a
class, but names it only if no id in the class is known (then null); repeated rows each get a row; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import batched, checkpoint, rows, texts
from rowloom.llm.components import components

SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, bits
LOCAL_PIVOTS = 12
GLOBAL_PIVOTS = 16
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_BLOCKS = pa.schema([("key", pa.int64()), ("members", pa.binary())])
_GROUPS = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])
_COMPARED = 3  # words of a wide fingerprint that are compared


def fingerprint(raw: bytes | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of the shingles, repeats included."""
    found = (raw or b"").lower().split()
    if not found:
        return 0
    shingles = [b" ".join(s) for s in zip(*(found[i:] for i in range(words)), strict=False)] if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def pivots(seed: int = 20) -> tuple[list[list[int]], list[int]]:
    """(for each segment its local pivots, the global pivots): hashes of their numbers."""
    take = lambda k, i: xxhash.xxh64_intdigest(f"{seed} {k} {i}")
    local = [[take(s, i) % (1 << bits) << first for i in range(LOCAL_PIVOTS)] for s, (first, bits) in enumerate(SEGMENTS)]
    return local, [take("global", i) for i in range(GLOBAL_PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(prints: DataFrame, limit: int = 3) -> DataFrame:
    """(key, fp): each distinct fingerprint under its local coordinates on each choice of three segments."""
    if limit > 3:
        raise ValueError("six segments leave three without a difference up to 3 differing bits only")
    local, _ = pivots()
    segment = [F.xxhash64(*[F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(((1 << bits) - 1) << first))).bitwiseXOR(F.lit(_signed(p)))) for p in local[s]]) for s, (first, bits) in enumerate(SEGMENTS)]
    coordinates = prints.select("fp", *[c.alias(f"s{s}") for s, c in enumerate(segment)])
    keys = [F.xxhash64(F.lit(n), *(F.col(f"s{s}") for s in chosen)) for n, chosen in enumerate(combinations(range(6), 3))]
    return coordinates.select("fp", F.explode(F.array(*keys)).alias("key"))


def _coordinates(fps: np.ndarray) -> np.ndarray:
    _, wide = pivots()
    return np.stack([np.bitwise_count(fps ^ np.uint64(p)) for p in wide], 1).astype(np.int8)


def forest(fps: np.ndarray, limit: int = 3, block: int = 512) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs of `fps` (unsigned) that differ in at most `limit` bits."""
    table = _coordinates(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    root = np.arange(len(fps))
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(fps), block):
        end = min(at + block, len(fps))
        reach = int(np.searchsorted(table[:, 0], table[end - 1, 0] + limit, side="right"))
        for other in range(at, reach, block):
            stop = min(other + block, reach)
            near = np.ones((end - at, stop - other), bool)
            for c in range(table.shape[1]):  # maximum coordinate difference
                near &= np.abs(table[at:end, c, None] - table[None, other:stop, c]) <= limit
            a, b = np.nonzero(near)
            a, b = a + at, b + other
            keep = a < b
            a, b = a[keep], b[keep]
            close = np.bitwise_count(fps[a] ^ fps[b]) <= limit
            for i, j in zip(a[close].tolist(), b[close].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(fps[i]), int(fps[j])))
    return links


def _linking(limit: int):
    """Walks rows sorted by key; a key's fingerprints are complete when the next key begins."""

    def run(batches):
        def found():
            key, held = None, []
            for batch in batches:
                keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                edges = np.flatnonzero(np.diff(keys)) + 1
                starts = [0, *edges.tolist()] if len(keys) else []
                ends = [*edges.tolist(), len(keys)] if len(keys) else []
                for a, b in zip(starts, ends, strict=True):
                    if keys[a] != key:
                        yield from linked(held)
                        key, held = keys[a], []
                    held.append(fps[a:b])
            yield from linked(held)

        def linked(held):
            if sum(map(len, held)) > 1:
                for u, v in forest(np.concatenate(held).view(np.uint64), limit):
                    yield _signed(u), _signed(v)

        yield from batched(found(), _LINKS, size=20000)

    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) for each row."""
    run = lambda batches: batched(((i, fingerprint(t, words)) for i, t in rows(batches)), _PRINTS)
    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame, limit: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints with the same components as all pairs within the limit."""
    keyed = tables(prints.select("fp").distinct(), limit).select("key", "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linking(limit), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id that links reach) for each row."""
    prints = checkpoint(fingerprints(docs, words, id_col, text_col))
    roots = components(links(prints, limit)).select(F.col("node").alias("fp"), "root")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    membership = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(membership, "fp").select("doc_id", "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value by another, all of whose bits depend on all of its bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=2)
def _segment_names(bits: int) -> np.ndarray:
    """For each value of a segment, a name of its distances to the local pivots: equal distances, equal names."""
    local = np.array([xxhash.xxh64_intdigest(f"wide {i}") % (1 << bits) for i in range(LOCAL_PIVOTS)], np.uint64)
    table = np.bitwise_count(np.arange(1 << bits, dtype=np.uint64)[:, None] ^ local)
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in table], np.uint64)


@dataclass(frozen=True)
class Wide:
    """Fingerprints of as many words as a similarity far from 1 asks for, looked up by pivot distances on `segments` segments of `bits` bits.

    Of two sets of Jaccard similarity J a bit differs with a probability of at most acos(2 J / (1 + J)) / pi (0.15 at 0.8; 0.19 for
    sets of four and five). Segments are as long as leaves a key about 4,096 of the unrelated fingerprints, and as many as leave a
    pair of just this similarity without a common key with a probability of 3 in a million. Under a key, pairs whose
    coordinates at the global pivots differ by more than `limit` are discarded, then those that differ in more bits of three words
    (a linked pair does with a probability of about one in a billion, sets of four and five one in 400,000).
    """

    bits: int
    segments: int
    limit: int

    @classmethod
    def of(cls, share: tuple[int, int], n: int, each: int = 4096, miss: float = 3e-6) -> Wide:
        p, q = share
        differs = math.acos(2 * p / (p + q)) / math.pi
        bits = max(4, math.ceil(math.log2(max(n, 1) / each))) if n > each else 4
        segments = math.ceil(math.log(miss) / math.log1p(-((1 - differs) ** bits)))
        compared = 64 * _COMPARED
        return cls(bits, segments, math.ceil(compared * differs + 6.6 * math.sqrt(compared * differs * (1 - differs))))

    @property
    def words(self) -> int:
        return max(_COMPARED, -(-self.bits * self.segments // 64))

    def fingerprint(self, hashes: np.ndarray) -> np.ndarray:
        """The words of a set's fingerprint: a bit is 1 if it is set in over half of the hashes, which are mixed anew for each word."""
        counts = np.zeros(64 * self.words, np.int64)
        steps = np.arange(self.words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, len(hashes), 255):  # so many bits fit a byte
            part = _mixed(hashes[at : at + 255, None] + steps)
            counts += np.unpackbits(part.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
        return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """(row, segment): a name of the segment's number and its distances to the local pivots, for rows of words."""
        unpacked = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8), axis=1, count=self.bits * self.segments, bitorder="little")
        values = unpacked.reshape(len(prints), self.segments, self.bits) @ (1 << np.arange(self.bits))
        return _mixed(_segment_names(self.bits)[values] + np.arange(1, self.segments + 1, dtype=np.uint64))

    def labels(self, prints: np.ndarray, block: int = 512) -> np.ndarray:
        """For each row of the words that are compared, the number of its group; rows that differ in at most `limit` bits are in one group."""
        wide = [np.array([xxhash.xxh64_intdigest(f"global {i} {w}") for w in range(_COMPARED)], np.uint64) for i in range(4)]
        table = np.stack([np.bitwise_count(prints ^ p).sum(1, dtype=np.int16) for p in wide], 1)
        order = np.argsort(table[:, 0], kind="stable")
        prints, table = prints[order], table[order]
        root = np.arange(len(prints))
        for at in range(0, len(prints), block):
            end = min(at + block, len(prints))
            reach = int(np.searchsorted(table[:, 0], table[end - 1, 0] + self.limit, side="right"))
            for other in range(at, reach, block):
                stop = min(other + block, reach)
                near = np.ones((end - at, stop - other), bool)
                for c in range(1, table.shape[1]):  # maximum coordinate difference; the first one is the order
                    if np.ptp(table[at:stop, c]) > self.limit:
                        near &= np.abs(table[at:end, c, None] - table[None, other:stop, c]) <= self.limit
                apart = np.bitwise_count(prints[at:end, None, 0] ^ prints[None, other:stop, 0])
                for w in range(1, _COMPARED):
                    apart += np.bitwise_count(prints[at:end, None, w] ^ prints[None, other:stop, w])
                near &= apart <= self.limit
                a, b = np.nonzero(near)
                a, b = a + at, b + other
                while len(a):
                    x, y = root[a], root[b]
                    open_ = x != y
                    a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                    root[np.maximum(x, y)] = np.minimum(x, y)
                    while (root[root] != root).any():
                        root = root[root]
        out = np.empty(len(root), np.int64)
        out[order] = root
        return out

    def near(self, prints: DataFrame) -> DataFrame:
        """(bucket, node): groups that hold each pair of (node, print) that has a common key and differs in at most `limit` bits."""

        def looked_up(batches):
            for batch in batches:
                if not len(batch):
                    continue
                words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(len(batch), self.words)
                members = np.column_stack([words[:, :_COMPARED], batch.column(0).to_numpy().view(np.uint64)])
                keys = self.keys(words).view(np.int64).ravel()
                order = np.argsort(keys, kind="stable")
                begins = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
                packed = memoryview(members[order // self.segments].tobytes())
                edges = [*(begins * members.itemsize * members.shape[1]).tolist(), len(packed)]
                yield from batched(((k, bytes(packed[a:b])) for k, a, b in zip(keys[order[begins]].tolist(), edges, edges[1:], strict=False)), _BLOCKS)

        def grouped(held):
            members = np.unique(np.frombuffer(b"".join(held), "<u8").reshape(-1, _COMPARED + 1), axis=0)
            if len(members) < 2:
                return
            found = self.labels(members[:, :_COMPARED])
            order = np.argsort(found, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(found[order])) + 1):
                if len(part) > 1:
                    nodes = np.sort(members[part, _COMPARED])
                    bucket = _signed(xxhash.xxh64_intdigest(nodes.tobytes()))
                    yield from ((bucket, n) for n in nodes.view(np.int64).tolist())

        def together(batches):
            key, held = None, []
            for k, members in rows(batches):
                if k != key:
                    if held:
                        yield from grouped(held)
                    key, held = k, []
                held.append(members)
            if held:
                yield from grouped(held)

        blocks = prints.mapInArrow(looked_up, "key long, members binary").repartition("key").sortWithinPartitions("key")
        return blocks.mapInArrow(lambda batches: batched(together(batches), _GROUPS, size=20000), "bucket long, node long")
