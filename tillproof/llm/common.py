"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows whose identifier has this remainder are held out of every training step.
HELD_OUT_PARTS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows that training must not see; a row without an identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS == HELD_OUT, F.lit(False))


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str,
) -> DataFrame:
    """Apply ``make()``, called once per task, to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null gives no bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
