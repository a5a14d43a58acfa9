"""Toxicity by subword-bag embeddings averaged into a linear softmax, both trained together in numpy.

A word, which is what stands between white space, its punctuation left out, has a vector for itself and one for each of its
character n-grams (3 to 5, with word ends marked, over its whole length, so that text without spaces is read to its end), all in one
hashed table; a text's vector is the average over all of its words' entries, and a softmax over two classes reads it.
A misspelling that was never seen shares most n-grams with the word it is made from. Since everything after the table is
linear, a trained model scores a word once: its entries' sum along the difference of the two classes.

The model is fitted on a bounded sample: `most_rows` labels whose ids have the smallest hashes, of texts of at most `longest` bytes.
Scoring covers whole texts.

Defined results: null and empty texts and texts without a word get the score that the bias alone gives; without two
classes among the labels every score is the share of label 1 (0 if there are no labels); rows with a null id are
scored and never learned from; documents with several labels count once for each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import batched, give_back, remainder, rows, texts
from rowloom.llm.segments import Memory

SCORED = "doc_id long, score double, predicted int"
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
_EDGES = re.compile(r"[\W_]+")


def entries(word: str, buckets: int) -> list[int]:
    """Table entries of a word and its n-grams; none for a word of punctuation alone."""
    bare = _EDGES.sub("", word.lower())
    if not bare:
        return []
    marked = f"<{bare}>"
    grams = [bare, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))]
    return [xxhash.xxh3_64_intdigest(g) % buckets for g in grams]


def grams(word: str) -> list[str]:
    """The letters of a word and its n-grams, as often as they occur; none for a word of punctuation alone."""
    bare = word.lower()
    if not bare.isalnum():
        bare = _EDGES.sub("", bare)
    if not bare:
        return []
    marked = f"<{bare}>"
    return [bare, *[marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]]


def entries(word: str, buckets: int) -> list[int]:
    """Table entries of a word and its n-grams."""
    return [xxhash.xxh3_64_intdigest(g) % buckets for g in grams(word)]


@dataclass
class ToxicityModel:
    weights: np.ndarray | None  # for each table entry, its part of the log-odds
    bias: float
    _known: Memory | None = field(default=None, repr=False, compare=False)
    _grams: Memory | None = field(default=None, repr=False, compare=False)
    _list: array | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": None, "_grams": None, "_list": None}

    def _word(self, word: str) -> complex:
        """The sum of a word's weights, and their number as the imaginary part. The word itself is rarely met again, its n-grams are."""
        found = grams(word)
        return complex(sum(map(self._grams.__getitem__, found[1:]), self._gram(found[0])), len(found)) if found else 0j

    def _gram(self, gram: str) -> float:
        return self._list[xxhash.xxh3_64_intdigest(gram) % len(self._list)]

    def score(self, raw: bytes | None) -> float:
        if self.weights is None:
            return self.bias
        if self._known is None:
            self._known, self._grams, self._list = Memory(self._word, 150_000), Memory(self._gram), array("d", self.weights)
        total = sum(map(self._known.__getitem__, (raw or b"").decode("utf-8", "replace").split()), 0j)
        return 1 / (1 + exp(-max(-50.0, min(50.0, self.bias + total.real / max(total.imag, 1)))))


def train(sample: list[tuple[bytes, int]], buckets: int = 1 << 18, dims: int = 4, epochs: int = 10, rate: float = 1.0, rare: int = 600, floor: float = 1e-4, doubt: float = 0.05, seed: int = 7) -> ToxicityModel:
    """Joint training of the table and the softmax by AdaGrad on whole texts, one batch of 64 texts at a time.

    Squared gradients start at `floor`, so that an entry whose gradient is weak moves less than one that toxic texts share, and
    labels are taken as right with probability 1 - `doubt`.

    Entries of fewer than 2 + n // `rare` of n texts keep a zero vector: they could only learn the noise of single labels.
    """
    ones = sum(y for _, y in sample)
    if not sample or not 0 < ones < len(sample):
        return ToxicityModel(None, ones / len(sample) if sample else 0.0)
    known = Memory(lambda w: np.array(entries(w, buckets), np.int64))
    bags = []
    for raw, y in sample:
        words = (raw or b"").decode("utf-8", "replace").split()
        found = np.concatenate([known[w] for w in words]) if words else np.zeros(0, np.int64)
        index, times = np.unique(found, return_counts=True)
        bags.append((index.astype(np.int32), (times / max(1, times.sum())).astype(np.float32), y))
    common = np.bincount(np.concatenate([b[0] for b in bags]), minlength=buckets) >= 2 + len(sample) // rare
    dense = np.cumsum(common) - 1  # entries that are learned, numbered without gaps
    bags = [(dense[index[common[index]]], share[common[index]], y) for index, share, y in bags]
    rng = np.random.default_rng(seed)
    learned = int(common.sum())
    table = rng.normal(0, 0.1, (learned, dims)).astype(np.float32)
    table_sq = np.full(learned, floor, np.float32)
    soft, bias = rng.normal(0, 0.1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    soft_sq, bias_sq = np.full((dims, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            part = [bags[i] for i in order[at : at + 64] if len(bags[i][0])]
            if not part:
                continue
            index, share = np.concatenate([b[0] for b in part]), np.concatenate([b[1] for b in part])
            starts = np.cumsum([0, *(len(b[0]) for b in part[:-1])])
            y = np.array([b[2] for b in part])
            hidden = np.add.reduceat(table[index] * share[:, None], starts)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p -= doubt / 2
            p[np.arange(len(y)), y] -= 1 - doubt
            g_soft, g_bias, g_hidden = hidden.T @ p, p.sum(0), p @ soft.T
            each = np.repeat(g_hidden, [len(b[0]) for b in part], axis=0) * share[:, None]
            grad = np.stack([np.bincount(index, each[:, d], learned) for d in range(dims)], 1).astype(np.float32)
            table_sq += (grad**2).mean(1)
            table -= rate * grad / np.sqrt(table_sq)[:, None]  # entries that the batch lacks have no gradient
            soft_sq += g_soft**2
            soft -= rate * g_soft / np.sqrt(soft_sq)
            bias_sq += g_bias**2
            bias -= rate * g_bias / np.sqrt(bias_sq)
    weights = np.zeros(buckets)
    weights[common] = table @ (soft[:, 1] - soft[:, 0])
    return ToxicityModel(weights, float(bias[1] - bias[0]))


def calibrated(sample: list[tuple[bytes, int]], clean_kept: float = 0.985, toxic_found: float = 0.83, **options) -> ToxicityModel:
    """Trains on all but every sixth text, and shifts the bias by those: as high a part of label 0 as `clean_kept` scores below 0.5, unless fewer of label 1 than `toxic_found` would be above.

    The shift is shrunk by n / (n + 1) for the n kept-back texts of the rarer label: none where there are none, all but a hundredth of it for a hundred.
    """
    model = train([x for i, x in enumerate(sample) if i % 6], **options)
    kept_back = [(model.score(raw), y) for raw, y in sample[::6]]
    logit = {label: [np.log(s / (1 - s)) for s, y in kept_back if y == label and 0 < s < 1] for label in (0, 1)}
    least = min(map(len, logit.values()))
    if model.weights is not None and least:
        model.bias -= max(0.0, min(np.quantile(logit[0], clean_kept), np.quantile(logit[1], 1 - toxic_found))) * least / (least + 1)
    model._known = model._grams = model._list = None  # what was remembered of the sample's words
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 4000, longest: int = 1 << 15, **options) -> ToxicityModel:
    """Learns from labelled documents that aren't held out: `most_rows` labels at most, those whose ids have the smallest hashes, of texts of at most `longest` bytes.

    The sample is chosen by ids alone, so no text is shuffled; of an id with several texts the one with the smallest hash is learned from.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1))
    own = texts(docs, id_col, text_col).where((F.octet_length("text") <= longest) & F.col("doc_id").isNotNull())
    keyed = known.groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("times")).join(own.select("doc_id"), "doc_id", "left_semi")
    chosen = keyed.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    ids = [tuple(r) for r in chosen.collect()]  # most_rows rows of three numbers
    small = docs.sparkSession.createDataFrame(sorted({(i,) for i, _, _ in ids}), "doc_id long")
    one = own.join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    text_of = {i: bytes(t) for i, t in one.select("doc_id", "least.text").collect()}  # most_rows * longest bytes at most
    sample = [(text_of[i], y) for i, y, times in ids for _ in range(min(times, most_rows)) if i in text_of]
    model = calibrated(sample[:most_rows], **options)
    del sample, text_of
    give_back()  # a driver has other stages to run
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each table entry
    run = lambda batches: batched(((i, s, int(s >= 0.5)) for i, s in ((i, float(shared.value.score(t))) for i, t in rows(batches))), _SCORED)
    return texts(docs, id_col, text_col).mapInArrow(run, SCORED)


def rejected(model: ToxicityModel, spark: SparkSession):
    """A function of a text column: whether the model finds each text toxic (score >= 0.5)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def judge(column: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(None if t is None else bytes(t)) >= 0.5 for t in column], dtype=bool)

    return lambda text: judge(text.cast("binary"))


def held_out(id_column: F.Column) -> F.Column:
    """Documents that no label is learned from: crc32 of the id modulo 5 is 0, or no id."""
    return F.coalesce(remainder(id_column, 5) == 0, F.lit(True))
