"""Pieces of the reference for kernels: contigs cut into overlapping chunks, met by an equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a chunk, its overlap with the next aside.
CHUNK = 1 << 16


def chunks(contigs: DataFrame, size: int, overlap: int) -> DataFrame:
    """contig_id, chunk, piece: every ``size`` bases and the ``overlap`` bases that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, seq in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                for first in range(0, len(seq or ""), 256 * size):
                    at = range(first, min(first + 256 * size, len(seq)), size)
                    columns = [[contig] * len(at), [x // size for x in at], [seq[x : x + size + overlap] for x in at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["contig_id", "chunk", "piece"])

    return contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "contig_id long, chunk long, piece string")


def with_window(rows: DataFrame, contigs: DataFrame, longest: int) -> DataFrame:
    """Adds ``window``: the bases from ``low`` to ``high`` (exclusive) of the row's contig, cut at its end.
    No row may ask for more than ``longest`` bases; rows beyond their contig's end are dropped."""
    size = max(CHUNK, longest)
    placed = rows.withColumn("low", F.greatest(F.col("low"), F.lit(0)).cast("long")).withColumn("chunk", F.floor(F.col("low") / size).cast("long"))
    met = placed.join(chunks(contigs, size, longest), ["contig_id", "chunk"])
    at = (F.col("low") - F.col("chunk") * size + 1).cast("int")
    return met.withColumn("window", F.substring("piece", at, F.greatest(F.col("high") - F.col("low"), F.lit(0)).cast("int"))).drop("piece", "chunk")
