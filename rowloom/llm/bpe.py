"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Chunks of documents explode their texts into pre-tokens with positions. The distinct pre-tokens of a chunk go, block by
block, to the bucket of their hash; a bucket encodes each distinct pre-token once, however many chunks have it, and sends
the ids back; the chunk puts them in place by position. Positions stay with the chunk as packed indexes, so a
frequent word costs one entry a chunk and bucket. Decoding looks token ids up in the token-byte table (as long as the
vocabulary, which bounds it).

Defined results: a null text counts as empty (no ids, empty bytes); a null id stays null; repeated rows each get their own
row; bytes that aren't UTF-8 are replaced by U+FFFD before encoding; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import give_back, input_bytes, texts
from rowloom.llm.exchange import BLOCK_ARROW, BLOCK_SCHEMA, TEXT_ARROW, TEXT_SCHEMA, bucket_bits, chunks, meet, pack_planes, unpack_planes
from rowloom.llm.segments import pattern, pieces, rank_encoding, rank_table

IDS_SCHEMA = "doc_id long, ids array<int>"
DECODED_SCHEMA = "doc_id long, ids array<int>, decoded binary"
#: Tokens that are decoded at a time.
_DECODED_AT_ONCE = 1 << 18
#: Marks that form a pre-token of their own at the end of a word.
_MARKS = frozenset(".,;:!?")


def words_of(piece: str, find) -> list[str]:
    """The pre-tokens of a space and a piece of text, for patterns like the public byte-level one; a word with at most one mark after it needs no search."""
    if piece.isalpha():
        return [" " + piece]
    if piece[-1:] in _MARKS and piece[:-1].isalpha():
        return [" " + piece[:-1], piece[-1]]
    return find(" " + piece)


class _Explode:
    """Pre-tokens of a chunk's texts, as indexes into the chunk's distinct pre-tokens in order of first appearance."""

    def __init__(self, source: str):
        self.find = pattern(source)
        self.words: dict[str, int] = {}
        self.known: dict[str, bytes] = {}

    def _indexes(self, found: list[str]) -> bytes:
        words = self.words
        return b"".join([words.setdefault(w, len(words)).to_bytes(4, "little") for w in found])

    def text(self, raw: bytes | None) -> bytes:
        first, *rest = pieces((raw or b"").decode("utf-8", "replace"))
        known, find = self.known, self.find
        for piece in dict.fromkeys(rest):
            if piece not in known:
                known[piece] = self._indexes(words_of(piece, find))
        return self._indexes(find(first)) + b"".join([known[p] for p in rest])


def _distinct_words(held: list[bytes | None], source: str) -> list[bytes]:
    """The distinct pre-tokens of a chunk's texts, without positions."""
    find = pattern(source)
    seen: set[str] = set()
    words: set[str] = set()
    for raw in held:
        first, *rest = pieces((raw or b"").decode("utf-8", "replace"))
        words.update(find(first))
        new = set(rest) - seen
        seen |= new
        for piece in new:
            words.update(words_of(piece, find))
    return sorted(w.encode() for w in words)


def _in_buckets(keyed: list[bytes], bits: int) -> list[tuple[int, list[bytes], list[int]]]:
    """(bucket, its words in order, their indexes); a bucket is the leading bits of a word's hash."""
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in keyed), np.uint64, len(keyed)) >> np.uint64(64 - bits)
    rank = np.empty(len(keyed), np.int64)
    rank[sorted(range(len(keyed)), key=keyed.__getitem__)] = np.arange(len(keyed))
    order = np.lexsort((rank, bucket))
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
    return [(int(bucket[part[0]]), [keyed[i] for i in part], part.tolist()) for part in np.split(order, edges[1:])] if len(order) else []


def _word_blocks(source: str, bits: int, limit: int):
    def run(batches):
        for chunk, _, held in chunks(batches, limit):
            found = _in_buckets(_distinct_words(held, source), bits)
            payloads = [zstandard.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words), 1) for _, words, _ in found]
            payloads = [struct.pack("<q", len(words)) + p for (_, words, _), p in zip(found, payloads, strict=True)]
            yield pa.record_batch([pa.array([chunk] * len(found), pa.int64()), pa.array([b for b, _, _ in found], pa.int32()), pa.array(payloads, pa.binary())], schema=BLOCK_ARROW)
            del held, found, payloads
            give_back(cycles=False)  # an executor has more workers than tasks, and each would keep what a chunk took

    return run


def _unpack_words(payload: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", payload)
    raw = zstandard.decompress(payload[8:])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def _encode_bucket(ranks_path: str, source: str):
    def run(blocks: pa.Table) -> pa.Table:
        encode = rank_encoding(ranks_path, source)._core_bpe.encode_single_piece
        once: dict[bytes, list[int]] = {}
        out: dict[int, tuple[int, bytes]] = {}
        for chunk, bucket, payload in zip(*(blocks.column(c).to_pylist() for c in ("chunk", "bucket", "payload")), strict=True):
            sizes, ids = [], []
            for word in _unpack_words(payload):
                if (got := once.get(word)) is None:
                    got = once[word] = encode(word)
                sizes.append(len(got))
                ids.extend(got)
            a, b = pack_planes(np.array(sizes, np.uint64)), pack_planes(np.array(ids, np.uint64))
            out[chunk] = bucket, struct.pack("<q", len(a)) + a + b
        return pa.table([pa.array(list(out), pa.int64()), pa.array([b for b, _ in out.values()], pa.int32()), pa.array([p for _, p in out.values()], pa.binary())], schema=BLOCK_ARROW)

    return run


def _position_blocks(source: str, limit: int):
    """A row a chunk: ids, the number of pre-tokens of each text, the index of each, and the distinct words in order."""

    def run(batches):
        for chunk, ids, held in chunks(batches, limit):
            explode = _Explode(source)
            placed = [explode.text(raw) for raw in held]
            head = np.array([[0 if i is None else i, i is None, len(p) // 4] for i, p in zip(ids, placed, strict=True)], "<i8").tobytes()
            index = pack_planes(np.frombuffer(b"".join(placed), "<u4").astype(np.uint64))
            words = [w.encode() for w in explode.words]
            table = zstandard.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words), 1)
            payload = struct.pack("<4q", len(ids), len(index), len(words), len(table)) + head + index + table
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())], schema=TEXT_ARROW)
            del held, explode, placed, index, words, table, payload
            give_back(cycles=False)

    return run


def _reassemble(bits: int):
    def run(_, states: pa.Table, replies: pa.Table) -> pa.Table:
        give_back(cycles=False)
        answers = dict(zip(*(replies.column(c).to_pylist() for c in ("bucket", "payload")), strict=True))
        out_ids, offsets, flat = [], [0], []
        for payload in states.column("payload").to_pylist():
            n, n_index, n_words, n_table = struct.unpack_from("<4q", payload)
            head = np.frombuffer(payload, "<i8", 3 * n, 32).reshape(n, 3)
            at = 32 + 24 * n
            index = unpack_planes(payload[at : at + n_index]).astype(np.int64)
            words = _unpack_words(struct.pack("<q", n_words) + payload[at + n_index : at + n_index + n_table])
            sizes = np.zeros(n_words, np.int64)
            starts = np.zeros(n_words, np.int64)
            tokens, used = [], 0
            for bucket, _, places in _in_buckets(words, bits):
                if bucket not in answers:
                    raise RuntimeError("a chunk's words were not answered: its documents were read in another order; write the input to a table first")
                (n_sizes,) = struct.unpack_from("<q", answers[bucket])
                each = unpack_planes(answers[bucket][8 : 8 + n_sizes]).astype(np.int64)
                got = unpack_planes(answers[bucket][8 + n_sizes :]).astype(np.int32)
                sizes[places] = each
                starts[places] = used + np.cumsum(each) - each
                tokens.append(got)
                used += len(got)
            pool = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            count = sizes[index]
            ends = np.cumsum(count)
            flat.append(pool[np.repeat(starts[index] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)])
            totals = np.concatenate([[0], ends])[np.cumsum(head[:, 2])]
            out_ids += [None if null else i for i, null, _ in head.tolist()]
            offsets += (offsets[-1] + totals).tolist()
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        return pa.table({"doc_id": pa.array(out_ids, pa.int64()), "ids": lists.cast(pa.list_(pa.int32()))})

    return run


def encode(docs: DataFrame, ranks_path: str, source: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text, each match of the pattern `source` encoded separately."""
    bits = bucket_bits(input_bytes(docs, text_col))
    read = texts(docs, id_col, text_col)
    words = read.mapInArrow(_word_blocks(source, bits, chunk_bytes), BLOCK_SCHEMA)
    replies = words.groupBy("bucket").applyInArrow(_encode_bucket(ranks_path, source), BLOCK_SCHEMA)
    states = read.mapInArrow(_position_blocks(source, chunk_bytes), TEXT_SCHEMA)
    return meet(states, replies.withColumn("level", F.lit(0)), _reassemble(bits), IDS_SCHEMA)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch of (doc_id, ids) in order, in parts of at most `most` ids, or of a single row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded, the bytes of (doc_id, ids): each id is looked up in the token-byte table. Null ids arrays give null; an id outside the table is an error."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        ranks = rank_table(ranks_path)
        tokens = [b""] * (1 + max(ranks.values(), default=-1))
        for token, rank in ranks.items():
            tokens[rank] = token
        table = pa.array(tokens, pa.large_binary())
        for whole_batch in batches:
            for batch in _parts(whole_batch, _DECODED_AT_ONCE):
                lists = batch.column(1).cast(pa.list_(pa.int32()))
                flat = table.take(lists.flatten())  # the bytes of all tokens, end to end
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
                places = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset) if len(flat) else np.zeros(1, np.int64)
                whole = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(places[ends].tobytes()), flat.buffers()[2] or pa.py_buffer(b"")])
                decoded = pc.if_else(lists.is_null(), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())
                yield pa.record_batch([batch.column(0), lists, decoded], schema=schema)
                del lists, flat, places, whole, decoded
            whole_batch = batch = None
            give_back(cycles=False)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED_SCHEMA)

