"""A corpus pipeline of the text operators: language, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
run() writes each stage's rows as Parquet and reads them for the next. No SQL expresses these stages, so ORACLE_SQL is
None; tests compare them with brute-force versions.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import langid, near, packing, substrings, toxicity
from rowloom.llm.common import shared_folder, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or with a narrow margin go."""
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    return docs.where(~langid.rejected(model, spark)(docs["text"]))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. Learned from the labels of documents that got this far; null texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.rejected(model, spark)(docs["text"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (0.8 of the five-word shingles, found by SimHash pivot tables, decided by exact sets) the row with the smallest id, once.

    Rows that share an id are told apart by their other columns; rows without an id all stay.
    """
    return near.first_of_each(docs, words=5, share=(4, 5))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start earlier in the corpus; a text that loses nothing stays as it is, a null text null.

    Every row keeps its own other columns, which travel with its text, so repeated and null ids lose or swap nothing.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = substrings.remove_repeats(docs, layout=True, carry=[*(docs[c] for c in others), docs["text"].isNull()])
    new = {c: F.col(f"carried{k}") for k, c in enumerate(others)}
    new["text"] = F.when(~F.col(f"carried{len(others)}"), F.col("kept").cast("string"))
    new["n_chars"] = F.length(new["text"]).cast("long")
    return found.select(*(new[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of at most 1024 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
