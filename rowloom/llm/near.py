"""Near-duplicates by the Jaccard similarity of word shingles: SimHash pivot tables find candidates, exact sets decide.

Fingerprints, pivots, lookup and discarding by distances are those of `simhash.Wide`: two texts that share 0.8 of their shingles
differ in about 0.15 of their SimHash bits, too many for 64 bits and a limit that is complete, so fingerprints are as wide as the
similarity and the number of rows ask for. Sets of texts that are near under one key are compared by their whole sets of shingle
hashes, and a spanning forest of the links is given.

Equal sets are one node, so copies cost nothing beyond their signature. Groups with the same nodes are one bucket. Sets are made
again for the texts that are near another, not kept for all.

Defined results: null, empty and blank texts have the empty set, and are copies of each other; a text of fewer words than a
shingle has one shingle, all of its words; repeated shingles count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import batched, checkpoint, rows
from rowloom.llm.components import components
from rowloom.llm.simhash import Wide

_PRINTS = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("content", pa.int64()), ("node", pa.int64()), ("print", pa.binary())])
_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    found = (raw or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(s) for s in zip(*(found[i:] for i in range(words)), strict=False)] if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes())) if len(found) else 0


def forest(sets: list[np.ndarray], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of all pairs whose Jaccard similarity is at least share[0] / share[1]."""
    p, q = share
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    values, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    group = np.arange(len(sets))
    mask = np.zeros(len(values), bool)
    links = []
    for i in range(len(sets) - 1):
        reach = int(np.searchsorted(sizes * p, sizes[i] * q, side="right"))  # a larger set can't be alike
        own = flat[starts[i] : starts[i] + sizes[i]]
        mask[own] = True
        for at in range(i + 1, reach, 256):
            others = np.arange(at, min(at + 256, reach))
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            both = np.array([np.count_nonzero(mask[flat[starts[j] : starts[j] + sizes[j]]]) for j in others.tolist()])
            for j in others[(p + q) * both >= p * (sizes[i] + sizes[others])].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    links.append((order[i], order[j]))
        mask[own] = False
    return links


def _linking(share: tuple[int, int]):
    """Walks rows (bucket, node, shingles) sorted by bucket; a bucket is complete when the next begins."""

    def linked(held):
        if len(held) > 1:
            for i, j in forest([np.frombuffer(s, np.uint64) for _, s in held], share):
                yield held[i][0], held[j][0]

    def found(batches):
        bucket, held = None, []
        for key, n, s in rows(batches):
            if key != bucket:
                yield from linked(held)
                bucket, held = key, []
            held.append((n, s))
        yield from linked(held)

    return lambda batches: batched(found(batches), _LINKS, size=20000)


def first_of_each(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class that links of similarity share[0] / share[1] or more make, the row with the smallest id, once; rows without an id all stay.

    Rows that share an id are told apart by a hash of their other columns, which also breaks the tie if both are in one class.
    """
    wide = Wide.of(share, docs.count())
    content = F.xxhash64(docs[text_col])
    rest = [c for c in docs.columns if c != id_col]
    own = F.xxhash64(content, *(docs[c].isNull() for c in rest), *(docs[c] for c in rest))
    whole = docs.select("*", own.alias("_own"))

    def printing(batches):
        for doc_id, own, content, raw in rows(batches):
            found = shingles(raw, words)
            yield doc_id, own, content, node(found), wide.fingerprint(found).tobytes() if len(found) else None

    def setting(batches):
        for (raw,) in rows(batches):
            found = shingles(raw, words)
            yield node(found), found.tobytes()

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), own.alias("own"), content.alias("content"), docs[text_col].cast("binary").alias("text"))
    prints = checkpoint(read.mapInArrow(lambda batches: batched(printing(batches), _PRINTS), "doc_id long, own long, content long, node long, print binary"))
    nodes = prints.select("node", "content", "print").dropDuplicates(["node"])
    near = wide.near(nodes.where("print IS NOT NULL").select("node", "print")).distinct()
    shared = checkpoint(near.join(nodes.select("node", "content"), "node"))
    wanted = read.select("content", "text").join(shared.select("content").distinct(), "content", "left_semi").select("text")
    sets = wanted.mapInArrow(lambda batches: batched(setting(batches), _SETS), "node long, shingles binary").dropDuplicates(["node"])
    placed = shared.select("bucket", "node").join(sets, "node").select("bucket", "node", "shingles")
    links = placed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_linking(share), "u long, v long")
    roots = components(links).withColumnRenamed("root", "_root")
    least = prints.where("doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "own")).alias("least"))
    rooted = least.join(roots, "node", "left").groupBy(F.coalesce("_root", "node").alias("_root")).agg(F.min("least").alias("least"))
    chosen = rooted.select(F.col("least.doc_id").alias("_id"), F.col("least.own").alias("_chosen"))
    kept = whole.join(chosen, (whole[id_col] == chosen["_id"]) & (whole["_own"] == chosen["_chosen"]), "left_semi").dropDuplicates([id_col, "_own"])
    return kept.drop("_own").unionByName(docs.where(docs[id_col].isNull()))
