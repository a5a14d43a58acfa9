"""Blocked key exchange: which 64-bit keys occur more than once in the corpus, asked by chunks of documents.

A row for each window of the corpus would be shuffled at 40 bytes or more. Here the documents of a task are taken in chunks
of a few megabytes. A chunk sorts its distinct keys, cuts them into buckets by their leading bits, and sends each bucket as
one delta-coded block: 3 to 6 bytes a key. A bucket sees every chunk's keys of its range, sorts them, and answers each
chunk with one bit a key. A key that a third of all windows share still reaches its bucket once a chunk, so no group
grows with the frequency of a key. The answers meet the chunk's own text again by the chunk's id, which is a hash of the
chunk's content: a chunk that was computed anew after a loss has the same id, and one that was cut differently finds
no answers and raises an error instead of giving a wrong result.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import NULL_ID, rows

#: Leading 48 bits of a key: enough where a key only tells what to look at more closely, and two bytes a key less to send.
COARSE = np.uint64(0xFFFFFFFFFFFF0000)
BLOCK_SCHEMA = "chunk long, bucket int, payload binary"
BLOCK_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
TEXT_SCHEMA = "chunk long, payload binary"
TEXT_ARROW = pa.schema([("chunk", pa.int64()), ("payload", pa.binary())])


def bucket_bits(n_bytes: int, each: int = 4 << 20, least: int = 8) -> int:
    """Leading bits of a key that name its bucket: about a bucket for every `each` input bytes, 2 ** least at least."""
    return max(least, min(24, (max(1, n_bytes) // each).bit_length()))


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[int | None], list[bytes | None]]]:
    """(chunk id, doc ids, texts) of at least `limit` text bytes; a document is never divided."""
    ids: list[int | None] = []
    held: list[bytes | None] = []
    size = 0
    for doc_id, text in rows(batches):
        ids.append(doc_id)
        held.append(text)
        size += len(text or b"") + 8
        if size >= limit:
            yield chunk_id(ids, held), ids, held
            ids, held, size = [], [], 0
    if ids:
        yield chunk_id(ids, held), ids, held


def chunk_id(ids: list[int | None], held: list[bytes | None]) -> int:
    h = xxhash.xxh3_64()
    for doc_id, text in zip(ids, held, strict=True):
        h.update(struct.pack("<qi", NULL_ID if doc_id is None else doc_id, -1 if text is None else len(text)))
        h.update(text or b"")
    return h.intdigest() - 2**63


def pack_texts(ids: list[int | None], held: list[bytes | None]) -> bytes:
    head = np.array([[0 if i is None else i, i is None, -1 if t is None else len(t)] for i, t in zip(ids, held, strict=True)], dtype="<i8")
    return zstandard.compress(struct.pack("<q", len(ids)) + head.tobytes() + b"".join(t or b"" for t in held), 3)


def unpack_texts(payload: bytes) -> tuple[list[int | None], list[bytes | None]]:
    raw = zstandard.decompress(payload)
    (n,) = struct.unpack_from("<q", raw)
    head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    at, held = 8 + 24 * n, []
    for _, _, size in head:
        held.append(None if size < 0 else raw[at : at + size])
        at += max(size, 0)
    return [None if null else i for i, null, _ in head], held


def text_blocks(limit: int):
    """mapInArrow function: (doc_id, text, any other columns) to one compressed row a chunk; the other columns travel as Arrow data."""

    def run(batches):
        others: deque[pa.RecordBatch] = deque()

        def first_two():
            for batch in batches:
                if batch.num_columns > 2:
                    others.append(batch.select(list(range(2, batch.num_columns))))
                yield batch.select([0, 1])

        for chunk, ids, held in chunks(first_two(), limit):
            packed = pack_texts(ids, held)
            payload = struct.pack("<q", len(packed)) + packed + pack_columns(others, len(ids))
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())], schema=TEXT_ARROW)

    return run


def pack_columns(batches: deque[pa.RecordBatch], n: int) -> bytes:
    """The next n rows of the batches, which are taken from the queue; nothing if there are no batches."""
    parts = []
    while n and batches:
        batch = batches.popleft()
        parts.append(batch.slice(0, n))
        if len(batch) > n:
            batches.appendleft(batch.slice(n))
        n -= len(parts[-1])
    if not parts:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as writer:
        for part in parts:
            writer.write_batch(part)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def unpack_block(payload: bytes) -> tuple[list[int | None], list[bytes | None], pa.Table | None]:
    """(doc ids, texts, the other columns) of a row of `text_blocks`."""
    (n,) = struct.unpack_from("<q", payload)
    others = payload[8 + n :]
    return *unpack_texts(payload[8 : 8 + n]), pa.ipc.open_stream(zstandard.decompress(others)).read_all() if others else None


def meet(states: DataFrame, replies: DataFrame, run, schema) -> DataFrame:
    """Brings a chunk's text block and its replies (level, chunk, bucket, payload) together: run(key, states, replies) -> pa.Table."""
    both = states.select(F.lit(-1).alias("level"), "chunk", F.lit(0).alias("bucket"), "payload").unionByName(replies.select("level", "chunk", "bucket", "payload"))

    def meeting(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        own = pc.equal(held.column("level"), -1)
        return run(key, held.filter(own), held.filter(pc.invert(own)))

    return both.groupBy("chunk").applyInArrow(meeting, schema)


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, the bytes of equal weight together, then zstandard."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    return struct.pack("<qb", len(values), used) + zstandard.compress(np.ascontiguousarray(planes[:used]).tobytes(), 1)


def unpack_planes(blob: bytes) -> np.ndarray:
    n, used = struct.unpack_from("<qb", blob)
    out = np.zeros((n, 8), np.uint8)
    if n and used:
        out[:, :used] = np.frombuffer(zstandard.decompress(blob[9:]), np.uint8).reshape(used, n).T
    return out.reshape(-1).view("<u8")


def _framed(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def _unframed(blob: bytes, n: int) -> list[bytes]:
    sizes, at, out = struct.unpack_from(f"<{n}q", blob), 8 * n, []
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, index of the first occurrence of each, whether it occurs again)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(ordered)))
    return ordered[starts], order[starts], counts > 1


def distinct_pairs(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, checks, index of the first occurrence, whether it occurs again) of the distinct pairs (key, check)."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    return k[starts], c[starts], order[starts], np.diff(np.append(starts, len(order))) > 1


def ask(chunk: int, keys: np.ndarray, again: np.ndarray, bits: int, owners: np.ndarray | None = None, checks: np.ndarray | None = None) -> pa.RecordBatch:
    """The blocks of a chunk: sorted distinct keys, whether each recurs in the chunk, the document of its first place, and the second half of its name."""
    named = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.diff(named, prepend=-1))
    buckets, payloads = named[begins].tolist(), []
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=False):
        part = keys[lo:hi]
        delta = np.diff(part, prepend=part[:1])
        delta[0] = part[0]
        owned = b"" if owners is None else pack_planes(owners[lo:hi].astype("<i8").view("<u8"))
        checked = b"" if checks is None else pack_planes(checks[lo:hi])
        payloads.append(_framed(pack_planes(delta), np.packbits(again[lo:hi]).tobytes(), owned, checked))
    return pa.record_batch([pa.array([chunk] * len(buckets), pa.int64()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], schema=BLOCK_ARROW)


def _gather(blocks: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, int, np.ndarray | None, np.ndarray | None]:
    """Blocks of one bucket in the order of chunk ids. Of chunks with equal content, hence equal ids, one is kept, and all its keys recur."""
    found, copied = {}, set()
    for chunk, bucket, payload in zip(*(blocks.column(c).to_pylist() for c in ("chunk", "bucket", "payload")), strict=True):
        if chunk in found:
            copied.add(chunk)
        found[chunk] = (bucket, payload)
    chunk_ids, sizes, keys, again, owners, checks = sorted(found), [], [], [], [], []
    for chunk in chunk_ids:
        packed, flags, owned, checked = _unframed(found[chunk][1], 4)
        part = np.cumsum(unpack_planes(packed), dtype=np.uint64)
        keys.append(part)
        sizes.append(len(part))
        again.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=len(part)).astype(bool) | (chunk in copied))
        if owned:
            owners.append(unpack_planes(owned).view("<i8"))
        if checked:
            checks.append(unpack_planes(checked))
    bucket = next(iter(found.values()))[0]
    return chunk_ids, sizes, np.concatenate(keys), np.concatenate(again), bucket, np.concatenate(owners) if owners else None, np.concatenate(checks) if checks else None


def _answer(chunk_ids: list[int], sizes: list[int], bucket: int, bits: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    payloads = [struct.pack("<q", n) + np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pa.table([pa.array(chunk_ids, pa.int64()), pa.array([bucket] * len(chunk_ids), pa.int32()), pa.array(payloads, pa.binary())], schema=BLOCK_ARROW)


def answer_repeated(blocks: pa.Table) -> pa.Table:
    """applyInArrow function of a bucket: one bit a key, set if the key occurs anywhere else."""
    chunk_ids, sizes, keys, again, bucket, _, _ = _gather(blocks)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    hit = np.zeros(len(keys), bool)
    hit[1:] |= same
    hit[:-1] |= same
    bits = again.copy()
    bits[order] |= hit
    return _answer(chunk_ids, sizes, bucket, bits)


def answer_earlier(blocks: pa.Table) -> pa.Table:
    """applyInArrow function of a bucket: one bit a key, set if another chunk has the key, and the second half of its name, in an earlier document.

    Equal document ids in two chunks (repeated rows) come in the order of the chunks' ids.
    """
    chunk_ids, sizes, keys, _, bucket, owners, checks = _gather(blocks)
    order = np.lexsort((owners, checks, keys))
    keys, checks = keys[order], checks[order]
    bits = np.zeros(len(keys), bool)
    bits[order[1:]] = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
    return _answer(chunk_ids, sizes, bucket, bits)


def answered(replies: list[tuple[int, bytes]], n_keys: int) -> np.ndarray:
    """The bits of a chunk's sorted keys, from its replies of all buckets."""
    parts = []
    for _, payload in sorted(dict(replies).items()):
        (n,) = struct.unpack_from("<q", payload)
        parts.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=8), count=n))
    bits = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(bits) != n_keys:
        raise RuntimeError(f"a chunk asked about {n_keys} keys and was told of {len(bits)}: its documents were read in another order; write the input to a table first")
    return bits
