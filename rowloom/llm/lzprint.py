"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into the phrases of an LZ78 dictionary: each phrase is the longest one seen before, and one byte. A
phrase is known by a hash of its content, so the set of phrases is a set of numbers; it is summarised by the smallest
number in each of `BINS` classes (one-permutation minimum hashes, empty classes borrow from the next). The share of
classes on which two fingerprints agree estimates how much of their dictionaries the texts share, as compressing one
with the other's dictionary would.

Successors in the order of ids are found without one global sort task: ids are cut into ranges at approximate quantiles,
each range is sorted by itself, and the first document of a range is also sent to the range before it.

Defined results: a null text counts as empty; an empty text has a fingerprint of its own, alike only to that of empty texts;
documents with equal ids follow each other in the order of their texts; null ids come last; the only document is its
own successor; an empty table gives an empty table.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import NULL_ID, batched, input_bytes, rows, texts

BINS = 64
RANGE_BYTES = 8 << 20
_MASK = (1 << 45) - 1
_FACTOR = 16807  # below 2 ** 15, so that a product stays below 2 ** 60
FINGERPRINTED = "doc_id long, fingerprint string"
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def parse(data: bytes, phrases: set[int], phrase: int = 0) -> tuple[int, list[int]]:
    """Continues a parse: adds new phrases to the set; gives the unfinished phrase and the phrases that were new."""
    new = []
    for byte in data:
        phrase = (phrase * _FACTOR + byte + 1) & _MASK
        if phrase not in phrases:
            phrases.add(phrase)
            new.append(phrase)
            phrase = 0
    return phrase, new


def _mixed(phrases: list[int]) -> np.ndarray:
    h = np.array(phrases, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each class, 16 bits of it; all zero only for no hashes."""
    if not len(hashes):
        return np.zeros(BINS, np.uint16)
    ordered = np.sort(hashes)
    at = np.searchsorted(ordered, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    filled = np.append(at[1:], len(ordered)) > at
    where = np.flatnonzero(filled)
    take = where[np.searchsorted(where, np.arange(BINS)) % len(where)]
    return (((ordered[at[take]] >> np.uint64(20)) % np.uint64(65535)) + np.uint64(1) + (np.arange(BINS) != take).astype(np.uint64) * ((np.arange(BINS) - take) % BINS).astype(np.uint64)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(data: bytes) -> np.ndarray:
    phrase, new = parse(data, set())
    return signature(_mixed(new + [phrase] if phrase else new))


def shown(signature_: np.ndarray) -> str:
    return signature_.astype(">u2").tobytes().hex()


def _both(text: str, other: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, and the edited text; what they share is parsed once."""
    cut = len(text) - len(text) // 4
    edited = text[:cut] + other[: len(text) - cut]
    head, tail, swapped = (x.encode() for x in (text[:cut], text[cut:], edited[cut:]))
    phrases: set[int] = set()
    open_phrase, common = parse(head, phrases)
    last, new = parse(tail, phrases, open_phrase)
    first = signature(_mixed(common + new + [last] if last else common + new))
    phrases.difference_update(new)
    last, new = parse(swapped, phrases, open_phrase)
    return first, signature(_mixed(common + new + [last] if last else common + new)), edited


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
    run = lambda batches: batched(((i, shown(fingerprint(t or b""))) for i, t in rows(batches)), schema)
    return texts(docs, id_col, text_col).mapInArrow(run, FINGERPRINTED)


def in_ranges(docs: DataFrame, ranges: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, key, guard, doc_id, text): rows sorted by (range, guard, key, text) in their partitions; a guard is the first row of the next range."""
    spark = docs.sparkSession
    read = texts(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    splits = sorted(set(read.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], min(100 * ranges, 200_000))).first()[0] or [])) if ranges > 1 else []
    bounds = np.array(splits, np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    ranged = read.withColumn("range", place("key"))
    first = dict(ranged.groupBy("range").agg(F.min("key")).collect())  # a row a range
    held = sorted(first)
    before = [(first[r], r, held[i - 1]) for i, r in enumerate(held)]
    guards = spark.createDataFrame(before, "key long, of int, range int")
    # A guard's text is the least among the texts of the smallest id of its range.
    extra = ranged.withColumnRenamed("range", "of").join(F.broadcast(guards), ["key", "of"])
    extra = extra.groupBy("of", "range", "key").agg(F.min_by("doc_id", F.coalesce("text", F.lit(b""))).alias("doc_id"), F.min(F.coalesce("text", F.lit(b""))).alias("text"))
    both = ranged.select("range", "key", F.lit(0).alias("guard"), "doc_id", "text").unionByName(extra.select("range", "key", F.lit(1).alias("guard"), "doc_id", "text"))
    # More partitions than ranges, so that few tasks get several.
    return both.repartition(max(1, 3 * len(held)), "range").sortWithinPartitions("range", "guard", "key", F.coalesce("text", F.lit(b"")))


def _compare(batches):
    """Walks sorted ranges with one row in hand; a row is finished when its successor is known."""
    held = None
    for range_, _, guard, doc_id, raw in rows(batches):
        text = (raw or b"").decode("utf-8", "replace")
        if held and held[0] == range_:
            _, before, old = held
            first, second, edited = _both(old, text)
            following = fingerprint(text.encode()) if guard else None
            yield before, old, edited, first, second, following
        held = None if guard else (range_, doc_id, text)


def _compared(batches):
    waiting = None
    for doc_id, text, edited, first, second, following in _compare(batches):
        if waiting:
            yield (*waiting, likeness(waiting_signature, first))
        row = (doc_id, len(text), sha256(edited.encode()).hexdigest(), shown(first), shown(second), likeness(first, second))
        if following is not None:
            yield (*row, likeness(first, following))
            waiting = None
        else:
            waiting, waiting_signature = row, first


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document against its edited text (the last quarter replaced by the beginning of the next document) and the next document."""
    n = ranges or max(4, min(4_000, input_bytes(docs, text_col) // RANGE_BYTES))  # how finely the work is cut, not what comes out
    return in_ranges(docs, n, id_col, text_col).mapInArrow(lambda batches: batched(_compared(batches), _COMPARED), COMPARED)
