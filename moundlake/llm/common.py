"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moundlake.runtime import cut_lineage

__all__ = ["clean_texts", "crc_bucket", "cut_lineage", "in_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id long, text string)``: the two columns an operator works on, a null text as empty.

    Further columns are left behind here, so their names can't clash with an operator's own.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def crc_bucket(id_col: str | Column, buckets: int) -> Column:
    """``crc32`` of the id as text, modulo ``buckets``; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")


def give_back() -> None:
    """Return freed memory of Arrow and, where the C library can, of everything else to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType, max_bytes: int = 16 << 20
) -> DataFrame:
    """Run ``work`` over Arrow slices of at most about ``max_bytes`` and build batches from the columns it yields.

    ``work`` gets one slice and yields dicts of column name to array or list. A slice holds
    whole rows, so one very long text makes a slice of its own.
    """
    types = df.sparkSession.createDataFrame([], schema).schema
    names = types.names
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # workers live on; what the task before took goes back
        for batch in batches:
            rows, at = max(1, batch.num_rows), 0
            step = max(1, int(rows * max_bytes / max(batch.nbytes, 1)))
            while at < batch.num_rows:
                for out in work(batch.slice(at, step)):
                    arrays = [pa.array(out[n], type=arrow.field(n).type) if not isinstance(out[n], pa.Array) else out[n] for n in names]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                at += step
            give_back()

    return df.mapInArrow(run, schema)


def label_sample(labels: DataFrame, label_col: str, id_col: str, train, most: int) -> DataFrame:
    """``(doc_id, label)`` of about ``most`` labelled rows at most, chosen by a hash of the id among those ``train`` admits.

    One row a document; of contradicting labels 1 counts. Null ids and labels are left out.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)").where(train(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total <= most:
        return known
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(most / total * (1 << 30))))
