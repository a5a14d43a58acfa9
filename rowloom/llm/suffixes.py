"""Byte-level removal of repeated strings, by hashes of whole windows behind a difference-cover filter.

Positions whose number in the document is in a difference cover modulo v are the cover sample: for any two places there is a
shift below v that brings both to sample positions. A sample position's rank is a name of the `length - v + 1` bytes that
follow it. Two equal strings of `length` bytes have, at the shared shift, sample positions of equal rank, so a place without a
sample position of a repeated rank among its first v positions ties with no other for `length` bytes. The places that
may tie are cut into buckets by the leading bits of the XXH3 of their `length` bytes, each bucket is sorted by these, and a
place is told whether a neighbour has the same. Memory is bounded by a bucket, or a chunk of text, whatever the size of the corpus.

This is not a suffix array: no suffixes are ordered by their letters, and sample ranks choose what is compared instead of
resolving ties. Sorting suffixes by text would send hundreds of bytes for each of them through the shuffle. Equal hashes count as
equal strings: with n places that may tie, two different strings are taken for equal with a probability of about n^2 / 2^65.

Defined results: a null text counts as empty; matches stay within documents; null ids take part; every place of a repeated
string goes, repeated rows included; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import batched, checkpoint, input_bytes, texts
from rowloom.llm.exchange import BLOCK_SCHEMA, COARSE, TEXT_SCHEMA, answer_repeated, answered, ask, bucket_bits, chunks, distinct, meet, text_blocks, unpack_block
from rowloom.llm.substrings import _SPANS, _by_level, spans_of

DEDUPED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:bigint,end:bigint>>"
_DEDUPED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", _SPANS)])
_B = 0x9E3779B97F4A7C15
_SPAN = 1 << 18  # positions hashed at a time


def difference_cover(r: int) -> tuple[int, list[int]]:
    """(v, cover): 6 r + 4 residues whose differences are all residues modulo v = 24 r^2 + 36 r + 13 (Colbourn and Ling, 2000)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    cover = np.cumsum([0, *steps]).tolist()
    return 24 * r * r + 36 * r + 13, cover


def cover_below(length: int) -> tuple[int, list[int]]:
    """The largest of these covers with v at most half the length; v = 1 if there is none."""
    best, r = (1, [0]), 0
    while (found := difference_cover(r))[0] <= length // 2:
        best, r = found, r + 1
    return best


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one, inverse = np.uint64(_B), np.uint64(pow(_B, -1, 2**64))
    return np.cumprod(np.append(np.uint64(1), np.full(n, one))), np.cumprod(np.append(np.uint64(1), np.full(n, inverse)))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return x * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the `length` bytes from each of the sorted positions, all from one running sum; they only choose what to look at more closely."""
    out = np.empty(len(at), np.uint64)
    up, down = _powers(_SPAN + length)
    lo = 0
    while lo < len(at):
        begin = at[lo]
        hi = int(np.searchsorted(at, begin + _SPAN))
        part = data[begin : at[hi - 1] + length]
        sums = np.cumsum(np.append(np.uint64(0), _letters()[part] * up[: len(part)]), dtype=np.uint64)
        p = at[lo:hi] - begin
        h = (sums[p + length] - sums[p]) * down[p]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[lo:hi] = h ^ h >> np.uint64(32)
        lo = hi
    return out


def whole_names(raw: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """XXH3 of the `length` bytes from each position: these decide, so no algebra of the text may make two of them equal."""
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[i : i + length]) for i in at.tolist()), np.uint64, len(at))


class Chunk:
    def __init__(self, ids: list[int | None], held: list[bytes | None], length: int):
        self.ids, self.held, self.length = ids, [t or b"" for t in held], length
        self.raw = b"".join(self.held)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array([len(t) for t in self.held], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.v, self.cover = cover_below(length)

    def _inside(self, n: int, residues: list[int] | None = None) -> np.ndarray:
        """Sorted positions from which n bytes of one document follow, in a document only those of the residues."""
        parts = []
        for begin, size in zip(self.begins.tolist(), self.sizes.tolist(), strict=True):
            room = size - n + 1
            if room > 0:
                if residues is None:
                    parts.append(np.arange(begin, begin + room))
                else:
                    places = (np.arange(0, room, self.v)[:, None] + np.array(residues)).ravel()
                    parts.append(begin + places[places < room])
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def sample(self):
        """(positions, ranks, distinct ranks, recurrence) of the cover sample."""
        n = self.length - self.v + 1
        at = self._inside(n, self.cover)
        ranks = names(self.data, at, n) & COARSE
        unique, _, again = distinct(ranks)
        return at, ranks, unique, again

    def suffixes(self, replies: list[tuple[int, bytes]]):
        """(positions, names, distinct names, recurrence) of the suffixes that may tie with another for the whole length."""
        at, ranks, unique, _ = self.sample()
        hit = answered(replies, len(unique))
        repeated = np.zeros(len(self.data) + 1, np.int32)
        repeated[at + 1] = hit[np.searchsorted(unique, ranks)]
        before = np.cumsum(repeated, dtype=np.int32)
        starts = self._inside(self.length)
        starts = starts[before[starts + self.v] > before[starts]]
        found = whole_names(self.raw, starts, self.length)
        unique, _, again = distinct(found)
        return starts, found, unique, again


def _ask_sample(length: int, bits: int, limit: int):
    def run(batches):
        for chunk_id, ids, held in chunks(batches, limit):
            _, _, unique, again = Chunk(ids, held, length).sample()
            yield ask(chunk_id, unique, again, bits)

    return run


def _ask_suffixes(length: int, bits: int):
    def run(key, states: pa.Table, replies: pa.Table) -> pa.Table:
        payloads = states.column("payload").to_pylist()
        _, _, unique, again = Chunk(*unpack_block(payloads[0])[:2], length).suffixes(_by_level(replies).get(0, []))
        return pa.Table.from_batches([ask(key[0].as_py(), unique, again | (len(payloads) > 1), bits)])

    return run


def _finish(length: int):
    def run(_, states: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        got = _by_level(replies)
        for payload in states.column("payload").to_pylist():
            chunk = Chunk(*unpack_block(payload)[:2], length)
            starts, found, unique, _ = chunk.suffixes(got.get(0, []))
            ties = starts[answered(got.get(1, []), len(unique))[np.searchsorted(unique, found)]]
            cover = np.zeros(len(chunk.data) + 1, np.int8)  # a start and an end at a position cancel, so a value stays in -1 .. 1
            cover[ties] += 1
            cover[ties + length] -= 1
            removed = np.cumsum(cover[:-1], dtype=np.int32) > 0
            for doc_id, begin, raw in zip(chunk.ids, chunk.begins.tolist(), chunk.held, strict=True):
                part = removed[begin : begin + len(raw)]
                spans = spans_of(part)
                kept, last = [], 0
                for span in spans:
                    kept.append(raw[last : span["start"]])
                    last = span["end"]
                out.append((doc_id, len(raw), sum(s["end"] - s["start"] for s in spans), len(spans), b"".join([*kept, raw[last:]]), spans))
        return pa.Table.from_batches([*batched(iter(out), _DEDUPED)], _DEDUPED)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), spans (removed runs of byte numbers)."""
    bits = bucket_bits(input_bytes(docs, text_col))
    read = texts(docs, id_col, text_col)
    states = read.mapInArrow(text_blocks(chunk_bytes), TEXT_SCHEMA)
    sample = read.mapInArrow(_ask_sample(length, bits, chunk_bytes), BLOCK_SCHEMA)
    ranks = checkpoint(sample.groupBy("bucket").applyInArrow(answer_repeated, BLOCK_SCHEMA).withColumn("level", F.lit(0)))
    asked = meet(states, ranks, _ask_suffixes(length, bits), BLOCK_SCHEMA)
    ties = checkpoint(asked.groupBy("bucket").applyInArrow(answer_repeated, BLOCK_SCHEMA).withColumn("level", F.lit(1)))
    return meet(states, ranks.unionByName(ties), _finish(length), DEDUPED)
