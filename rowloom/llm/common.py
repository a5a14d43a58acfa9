"""What the text operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are ordered: a document without an id comes last.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one of our own if all runs in this process (tests), else an error: executors share no local folder."""
    context = spark.sparkContext
    if configured := context.getConf().get("spark.checkpoint.dir"):
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="rowloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def give_back(cycles: bool = True) -> None:
    """Gives memory that is no longer used back to the system: the C library and Arrow would keep it for a process that may never need it again."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's shared checkpoint folder and read it from there, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, the text as UTF-8 bytes: other columns, whatever their names, stay out of the operators."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batched(records: Iterator[tuple], schema: pa.Schema, size: int = 2000, heavy: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows, cut early once their byte strings pass `heavy` bytes."""
    held: list[tuple] = []
    weight = 0
    for record in records:
        held.append(record)
        weight += sum(len(x) for x in record if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= heavy:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, type=field.type) for values, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """About how large the input is: the optimizer's estimate, or the texts' sizes where it has none. It decides numbers of partitions only, never results."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate if estimate < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def remainder(column: F.Column, n: int) -> F.Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n
