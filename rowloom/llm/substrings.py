"""Substring deduplication by level-wise doubling.

Levels are the lengths `base`, twice that, and so on up to `window` words. At a level, windows of that length are looked up across
the corpus (rowloom.llm.exchange), and only those that are repeated are extended to the next length; a level without
candidates ends the search. At the last level a window is told whether it also starts earlier (smaller id, or the same
document further left), and the words that such windows cover go.

A long window holds many short ones, and each would be repeated with it. Of those, the leftmost with the least hash stands
for all: it is the same one wherever the long window occurs. So about 2 in window - length + 2 positions are asked.

Short windows have 48-bit keys, which only tell what to extend. Windows of the last level are equal if 128 bits of their
names are, made of 128-bit hashes of their words: over 10^13 windows the chance that any two differ and yet agree is about 10^-13.

Defined results: a null text counts as empty; words are maximal runs of bytes that aren't ASCII white space, unchanged; a null
id comes after all others; documents with equal ids come in a fixed order; repeated rows are copies of each other;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import NULL_ID, batched, checkpoint, input_bytes, texts
from rowloom.llm.exchange import (
    BLOCK_SCHEMA,
    COARSE,
    TEXT_SCHEMA,
    answer_earlier,
    answer_repeated,
    answered,
    ask,
    bucket_bits,
    chunks,
    distinct,
    distinct_pairs,
    meet,
    text_blocks,
    unpack_block,
)

DEDUPED = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_DEDUPED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", _SPANS)])
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the index of the first of its least ones."""
    at, span = np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


class Chunk:
    """The words of a chunk's documents, as places in one byte string, and the hashes of windows of them."""

    def __init__(self, ids: list[int | None], held: list[bytes | None]):
        self.ids, self.held = ids, held
        order = sorted(range(len(ids)), key=lambda i: (NULL_ID if ids[i] is None else ids[i], held[i] or b"", i))
        self.order = order  # documents in the order of the corpus
        self.raw = b" ".join(held[i] or b"" for i in order) + b" " * 9
        inside = ~_SPACE[np.frombuffer(self.raw, np.uint8)]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.begin, self.end = edges[0::2], edges[1::2]
        lengths = np.array([len(held[i] or b"") + 1 for i in order], np.int64)
        firsts = np.searchsorted(self.begin, np.append(np.cumsum(lengths) - lengths, len(self.raw)))
        self.sizes = np.diff(firsts)
        self.ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.owner = np.array([NULL_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.hashes = dict(zip([(1, 0), (1, 1)], self._words(), strict=True))

    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each word: of up to eight bytes from the bytes themselves, so without collisions; else 128 bits of XXH3."""
        size = self.end - self.begin
        bytes_ = np.ndarray(len(self.raw) - 7, "<u8", self.raw, 0, (1,))[self.begin] & _FIRST[np.minimum(size, 8)]
        both = [_mixed(_mixed((bytes_ + size.astype(np.uint64)) * odd)) for odd in _ODD]
        if len(long := np.flatnonzero(size > 8)):
            spans = zip(self.begin[long].tolist(), self.end[long].tolist(), strict=True)
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(self.raw[a:b]) for a, b in spans]), "<u8").reshape(-1, 2)
            for lane in (0, 1):
                both[lane][long] = digest[:, lane]
        return tuple(both)

    def window(self, n: int, lane: int = 0) -> np.ndarray:
        """The hash of the n words from each position; positions too near the end of the chunk have none."""
        if (n, lane) not in self.hashes:
            a, b = self.window(n - n // 2, lane), self.window(n // 2, lane)
            size = max(0, len(self.ends) - n + 1)
            h = a[:size] * (_ODD[lane] + np.uint64(2 * n)) + b[n - n // 2 : n - n // 2 + size]
            self.hashes[n, lane] = _mixed(h)
        return self.hashes[n, lane]

    def starts(self, n: int) -> np.ndarray:
        """Positions at which n words of one document begin."""
        size = max(0, len(self.ends) - n + 1)
        return np.flatnonzero(np.arange(size) + n <= self.ends[:size])

    def candidates(self, levels: list[int], replies: dict[int, list[tuple[int, bytes]]]) -> np.ndarray:
        """Starts of the long windows whose short ones are repeated at each level that has been answered."""
        at = self.starts(levels[-1])
        for level in levels[:-1]:
            if level not in replies:
                break
            chosen, places, keys, unique, _ = self.short(levels, level, at)
            repeated = np.zeros(len(self.ends) + 1, bool)
            repeated[places] = answered(replies[level], len(unique))[np.searchsorted(unique, keys)]
            at = at[repeated[chosen]]
        return at

    def short(self, levels: list[int], level: int, at: np.ndarray):
        """(for each long window the short one that stands for it, places of these, keys, distinct keys, recurrence)."""
        h = self.window(level)
        chosen = leftmost_least(h, levels[-1] - level + 1)[at]  # ascends with the long window
        places = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
        keys = h[places] & COARSE
        unique, _, again = distinct(keys)
        return chosen, places, keys, unique, again

    def whole(self, levels: list[int], at: np.ndarray):
        """(keys, checks, first places, recurrence) of the distinct long windows at the given places."""
        return distinct_pairs(self.window(levels[-1])[at], self.window(levels[-1], 1)[at])

    def asks(self, chunk_id: int, levels: list[int], level: int, replies: dict[int, list[tuple[int, bytes]]], bits: int, copied: bool) -> pa.RecordBatch:
        at = self.candidates(levels, replies)
        if level == levels[-1]:
            keys, checks, first, again = self.whole(levels, at)
            owners = np.repeat(self.owner, self.sizes)[at[first]]
            return ask(chunk_id, keys, again | copied, bits, owners, checks)
        _, _, _, unique, again = self.short(levels, level, at)
        return ask(chunk_id, unique, again | copied, bits)


def levels_of(window: int, base: int) -> list[int]:
    """`base`, twice that, and so on while it is below `window`, then `window`."""
    found = [min(max(1, base), window)]
    while found[-1] < window:
        found.append(min(2 * found[-1], window))
    return found


def _by_level(replies: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {}
    for level, bucket, payload in zip(*(replies.column(c).to_pylist() for c in ("level", "bucket", "payload")), strict=True):
        out.setdefault(level, []).append((bucket, payload))
    return out


def _before(replies: pa.Table, levels: list[int]) -> dict[int, list[tuple[int, bytes]]]:
    """Replies of all these levels; a chunk that asked nothing at a level has an empty list there."""
    got = _by_level(replies)
    return {level: got.get(level, []) for level in levels}


def _first_level(levels: list[int], bits: int, limit: int):
    def run(batches):
        for chunk_id, ids, held in chunks(batches, limit):
            yield Chunk(ids, held).asks(chunk_id, levels, levels[0], {}, bits, False)

    return run


def _next_level(levels: list[int], level: int, bits: int):
    def run(key, states: pa.Table, replies: pa.Table) -> pa.Table:
        payloads = states.column("payload").to_pylist()  # chunks of equal content have the same id, and ask the same
        chunk = Chunk(*unpack_block(payloads[0])[:2])
        known = _before(replies, levels[: levels.index(level)])
        return pa.Table.from_batches([chunk.asks(key[0].as_py(), levels, level, known, bits, len(payloads) > 1)])

    return run


def spans_of(removed: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def _finish(levels: list[int], survive: bool, layout: bool):
    """survive: the last level was asked; otherwise nothing is repeated."""
    window = levels[-1]

    def removed_words(chunk: Chunk, replies: pa.Table, copy: int) -> np.ndarray:
        if not survive:
            return np.zeros(len(chunk.ends), bool)
        got = _before(replies, levels)
        at = chunk.candidates(levels, got)
        keys, _, first, _ = chunk.whole(levels, at)
        later = np.ones(len(at), bool)
        later[first] = answered(got[window], len(keys)) | (copy > 0)
        cover = np.zeros(len(chunk.ends) + 1, np.int8)  # a start and an end at a position cancel, so a value stays in -1 .. 1
        cover[at[later]] += 1
        cover[at[later] + window] -= 1
        return np.cumsum(cover[:-1], dtype=np.int32) > 0

    def documents(chunk: Chunk, removed: np.ndarray):
        lo = 0
        for i, n in zip(chunk.order, chunk.sizes.tolist(), strict=True):
            part = removed[lo : lo + n]
            gone = int(np.count_nonzero(part))
            whole = chunk.held[i] or b""
            if gone:
                places = lo + np.flatnonzero(~part)
                kept = b" ".join([chunk.raw[a:b] for a, b in zip(chunk.begin[places].tolist(), chunk.end[places].tolist(), strict=True)])
            else:
                kept = whole if layout else b" ".join(whole.split())
            yield chunk.ids[i], n, gone, kept, spans_of(part) if gone else []
            lo += n

    def run(_, states: pa.Table, replies: pa.Table) -> pa.Table:
        parts = []
        for copy, payload in enumerate(states.column("payload").to_pylist()):
            ids, held, others = unpack_block(payload)
            chunk = Chunk(ids, held)
            made = pa.Table.from_batches([*batched(documents(chunk, removed_words(chunk, replies, copy)), _DEDUPED)], _DEDUPED)
            if others is not None:
                for name, column in zip(others.column_names, others.take(pa.array(chunk.order)).columns, strict=True):
                    made = made.append_column(name, column)
            parts.append(made)
        return pa.concat_tables(parts)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, base: int = 5, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, layout: bool = False, carry: Sequence[Column] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), spans (removed runs of word numbers), carried0, carried1, ...

    With `layout` a text that loses nothing stays as it is. `carry` are columns of docs that each row's result takes along.
    """
    levels, bits = levels_of(window, base), bucket_bits(input_bytes(docs, text_col))
    read = texts(docs, id_col, text_col)
    whole = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"), *(c.alias(f"carried{k}") for k, c in enumerate(carry)))
    states = whole.mapInArrow(text_blocks(chunk_bytes), TEXT_SCHEMA)
    known, survive = None, True
    for level in levels:
        last = level == levels[-1]
        if known is None:
            asked = read.mapInArrow(_first_level(levels, bits, chunk_bytes), BLOCK_SCHEMA)
        else:
            asked = meet(states, known, _next_level(levels, level, bits), BLOCK_SCHEMA)
        replies = asked.groupBy("bucket").applyInArrow(answer_earlier if last else answer_repeated, BLOCK_SCHEMA)
        replies = checkpoint(replies.select(F.lit(level).alias("level"), "chunk", "bucket", "payload"))
        known = replies if known is None else known.unionByName(replies)
        if not last and replies.isEmpty():
            survive = False
            break
    schema = T.StructType([*T._parse_datatype_string(DEDUPED).fields, *whole.schema.fields[2:]])
    return meet(states, known, _finish(levels, survive, layout), schema)
