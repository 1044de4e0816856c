"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of the class [\x20\x09-\x0D]; ``bytes.split()`` without arguments cuts at the same six.
SPACES = b" \t\n\x0b\x0c\r"


def share_code(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, wherever the driver was started.

    On a cluster the package is installed or passed with --py-files, and the path isn't there.
    """
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if top not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [top, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker, so that long texts take no more memory than short ones.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session batches for Python workers are bounded by bytes as well as by rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    known = conf.get(name).removesuffix("b")
    if not known.isdigit() or int(known) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator on texts reads, under fixed names; a null text is empty.

    Selecting by position in a fresh frame keeps any further columns, whatever their
    names, out of the way.
    """
    return bounded_batches(df).select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


_STORE: dict = {}


def worker_store(name, make):
    """What a Python worker keeps from task to task under ``name``; a store of another operator gives way to it."""
    if name not in _STORE:
        _STORE.clear()
        _STORE[name] = make()
    return _STORE[name]


def utf8(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one value at a time and without decoding."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def rows_out(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows, so that a task holds little at a time."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)
