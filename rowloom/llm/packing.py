"""Best-fit packing of token sequences by exact-complement hashing.

A plan needs the number of pieces of each length only, so it is made on a histogram of at most `capacity` counts, whatever
the corpus' size. Long to short, the gap that a length leaves is looked up among single lengths, then sums of pairs, then of
triples, and combinations that fill it exactly are consumed as often as the counts allow. What is left is packed best-fit
decreasing. Pieces then find their places by their rank among the pieces of their length. Ranks are counted in salted
groups whose number grows with the count, so a length that a third of all pieces share is ranked by many tasks.

Defined results: a null text counts as empty (it has the end token alone); a null id stays null; repeated rows each get
places of their own; ties are broken by id, piece and checksum; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import batched, checkpoint, give_back, rows, texts
from rowloom.llm.segments import Memory, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def _byte_encoder(path: str):
    """text -> little-endian 32-bit ids, as the `tokenizers` file says; its byte-level vocabulary is merged in the order of ids."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path) as f:
        model = json.load(f)
    shown = sorted(ByteLevel.alphabet())
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    assert sorted(byte_of) == shown
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    source = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the byte-level pre-tokenizer's pattern
    core = tiktoken.Encoding("file", pat_str=source, mergeable_ranks=ranks, special_tokens={})._core_bpe
    encode, single = core.encode_ordinary, core.encode_single_piece
    pack = lambda text: struct.pack(f"<{len(ids := encode(text))}I", *ids)
    mark_ids = {mark: pack(mark) for mark in ".,;:!?"}

    def pack_piece(piece: str) -> bytes:
        """The ids of a space and a piece. ASCII letters, and one mark after them, are what the pattern would find, so they need no search."""
        if piece.isascii():
            if piece.isalpha():
                ids = single(b" " + piece.encode())
                return struct.pack(f"<{len(ids)}I", *ids)
            if piece[-1:] in mark_ids and piece[:-1].isalpha():
                return known[piece[:-1]] + mark_ids[piece[-1]]
        return pack(" " + piece)

    known = Memory(pack_piece)
    del model, ranks, special
    give_back()  # an executor has more workers than tasks, and each reads the file
    return pack, known


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """(a pattern of the file's added tokens, the id of each); where one begins another, the longer one counts."""
    with open(path) as f:
        found = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that take more than their own letters: {odd}")
    ids = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in found}
    return (re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


def ids_of(raw: bytes | None, path: str) -> bytes:
    """The ids of a whole text, in which the added tokens of the file have their own ids, as little-endian 32-bit values."""
    pattern, ids = _added(path)
    text = (raw or b"").decode("utf-8", "replace")
    if not pattern or not pattern.search(text):
        return _tokens(text, path)
    between, found = pattern.split(text), [*map(ids.__getitem__, pattern.findall(text)), b""]
    return b"".join((_tokens(part, path) if part else b"") + own for part, own in zip(between, found, strict=True))


def tokens(raw: bytes | None, path: str) -> bytes:
    """The ids of a text without added tokens as little-endian 32-bit values; `ids_of` looks for those first."""
    return _tokens((raw or b"").decode("utf-8", "replace"), path)


def _tokens(text: str, path: str) -> bytes:
    pack, known = _byte_encoder(path)
    first, *rest = pieces(text)
    return pack(first) + b"".join(map(known.__getitem__, rest))


def cut(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: pieces of at most `capacity` ids; all of a document's pieces but the first are full."""
    end = int(end_id).to_bytes(4, "little")

    def cutting(batches):
        for doc_id, raw in rows(batches):
            ids = ids_of(raw, path) + end
            n = len(ids) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                part = ids[4 * a : 4 * b]
                yield doc_id, piece, a, b - a, zlib.crc32(part), part if with_ids else None

    return texts(docs, id_col, text_col).mapInArrow(lambda batches: batched(cutting(batches), _PIECES), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), for counts[length] pieces of each length.

    Short pieces are worth more as fillers than combined with each other, so exact combinations are looked for down to
    several lengths, and the plan with the fewest sequences counts.
    """
    down_to = (1, capacity // 2 + 1, 3 * capacity // 4 + 1, 7 * capacity // 8 + 1, 15 * capacity // 16 + 1)
    return min((_plan(counts, capacity, least) for least in down_to), key=lambda made: sum(times for _, times in made))


def _plan(counts: dict[int, int], capacity: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []

    def consume(*lengths: int) -> bool:
        wanted = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // k for x, k in wanted.items())
        if times > 0:
            for x, k in wanted.items():
                left[x] -= k * times
            made.append((lengths, times))
        return times > 0

    for length in range(capacity, least - 1, -1):
        gap = capacity - length
        if gap == 0:
            consume(length)
        if left[length] and gap:
            consume(length, gap)
        if left[length]:
            for a in range(gap - 1, (gap - 1) // 2, -1):
                if left[a] and left[gap - a] and consume(length, a, gap - a) and not left[length]:
                    break
        if left[length]:
            for a in range(gap - 2, (gap - 1) // 3, -1):
                if not left[a]:
                    continue
                rest = gap - a
                b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
                for x in b[(left[b] > 0) & (left[rest - b] > 0)].tolist():
                    consume(length, a, x, rest - x)
                if not left[length]:
                    break
    open_bins: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        for gap in sorted(g for g in open_bins if g >= length):
            while n and open_bins.get(gap):
                lengths, times = open_bins[gap].pop()
                fit, used = min(gap // length, n), 0
                used = min(times, n // fit)
                open_bins.setdefault(gap - fit * length, []).append([lengths + (length,) * fit, used])
                n -= used * fit
                if used < times:
                    open_bins[gap].append([lengths, times - used])
        if n:
            per = capacity // length
            for fit, times in ((per, n // per), (n % per, 1)):
                if fit and times:
                    open_bins.setdefault(capacity - fit * length, []).append([(length,) * fit, times])
    return made + [(lengths, times) for _, group in sorted(open_bins.items()) for lengths, times in group]


def place(cut_pieces: DataFrame, capacity: int = 1024, each: int = 1 << 20) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32 and any other columns).

    Pieces of a length are ranked in parts of about `each` pieces, so no task grows with the corpus.
    """
    spark = cut_pieces.sparkSession
    by_length = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).collect()  # at most capacity rows
    parts = spark.createDataFrame([(length, 1 + n // each) for length, n in by_length], "length long, _parts long")
    salted = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts")).cast("int")
    held = cut_pieces.join(F.broadcast(parts), "length").withColumn("_salt", salted).drop("_parts")
    counted = held.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).collect()  # at most capacity rows and one for `each` pieces
    counts: dict[int, int] = {}
    bases = []
    for length, salt, n in sorted(map(tuple, counted)):
        bases.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    slots, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    base = spark.createDataFrame(bases, "length long, _salt int, _base long")
    slot = spark.createDataFrame(slots, "length long, _from long, _to long, _sequence long, offset long")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = held.withColumn("_row", F.row_number().over(within)).join(F.broadcast(base), ["length", "_salt"])  # as many rows as were counted
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    # Each combination of the plan uses a length or a kind of open sequence up: a few thousand slots at a capacity of 1024.
    placed = ranked.join(F.broadcast(slot), (ranked["length"] == slot["length"]) & (ranked["_rank"] >= slot["_from"]) & (ranked["_rank"] < slot["_to"]))
    placed = placed.drop(slot["length"]).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))
    return placed.select(*cut_pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset."""
    return place(checkpoint(cut(docs, path, end_id, capacity, id_col, text_col, with_ids)), capacity)
