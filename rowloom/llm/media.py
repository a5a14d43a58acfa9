"""Media columns: bytes stored as MPEG audio in a binary column, and described from the stored bytes.

`store` keeps a text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, in an audio stream; `describe` parses any
binary column of MPEG audio.

Defined results: a null text counts as empty and stores 64 zero bytes; null media describe as an empty stream; null ids stay
null; repeated rows each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.llm import mpeg
from rowloom.llm.common import batched, rows, texts

STORED = "doc_id long, n_bytes long, media binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
DESCRIBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "seconds double, sample_rate int, frames int, frame_offsets array<long>, bitrates array<int>, checked int, wrong int, lost_bytes long, table string"
)
_DESCRIBED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    + [("seconds", pa.float64()), ("sample_rate", pa.int32()), ("frames", pa.int32()), ("frame_offsets", pa.list_(pa.int64())), ("bitrates", pa.list_(pa.int32())), ("checked", pa.int32()), ("wrong", pa.int32()), ("lost_bytes", pa.int64()), ("table", pa.string())]
)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media: the stream that holds the padded bytes."""

    def storing(batches):
        for doc_id, raw in rows(batches):
            raw = raw or b""
            yield doc_id, len(raw), mpeg.write(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))

    return texts(docs, id_col, text_col).mapInArrow(lambda batches: batched(storing(batches), _STORED), STORED)


def _row(doc_id: int | None, n_bytes: int | None, media: bytes | None) -> tuple:
    s = mpeg.read(media)
    payload = mpeg.carried(s)
    table = s.table["kind"] if s.table else None
    feature = f"duration={s.seconds:.6f}s;rate={s.rate};frames={len(s.offsets)};kbps={','.join(map(str, sorted(s.bitrates)))};crc={s.checked - s.wrong}/{s.checked};table={table};seek={zlib.crc32(repr(s.offsets).encode()):08x}"
    own = (doc_id, n_bytes, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media or b""), sha256(media or b"").hexdigest(), feature)
    return *own, s.seconds, s.rate, len(s.offsets), s.offsets, sorted(s.bitrates), s.checked, s.wrong, s.lost, table


def describe(stored: DataFrame) -> DataFrame:
    """What the media column's bytes say: payload digests, exact duration, frame offsets to seek to, checksums, tables."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: batched((_row(*r) for r in rows(batches)), _DESCRIBED), DESCRIBED)
