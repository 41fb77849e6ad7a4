"""Streams: seeds of arriving reads against a static index, and running statistics over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import kmers


def seed_hits(reads: DataFrame, index: DataFrame, k: int, dna: bool = True) -> DataFrame:
    """Stream-static join: each arriving read's k-mers with the index (code, contig_id, rpos). Stateless."""
    probe = kmers(reads, "read_id", "seq", k, dna).withColumnRenamed("pos", "qpos")
    return probe.join(index.select("code", "contig_id", "rpos"), "code").select("read_id", "contig_id", "qpos", "rpos")


def running_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their mean value by window and type; rows later than the watermark are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
