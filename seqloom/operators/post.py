"""Ranking, mapping quality and SAM rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import mapq


def top_k(scored: DataFrame, k: int, order: list, by: str = "read_id") -> DataFrame:
    """The first k rows of each read by score (descending), then by a total order."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def with_mapq(scored: DataFrame, length: str, mismatch: int, order: list, by: str = "read_id") -> DataFrame:
    """Adds rank, mapq and secondary: best rows share the quality, all others are secondary with 0."""
    w = Window.partitionBy(by)
    place = Window.partitionBy(by).orderBy(F.desc("score"), *order)
    rows = scored.withColumn("rank", F.row_number().over(place).cast("long")).withColumn("__best", F.max("score").over(w))
    rows = rows.withColumn("__second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(w))
    quality = mapq(F.col("__best"), F.col("__second"), F.col(length) * mismatch)
    top = F.col("score") == F.col("__best")
    return rows.withColumn("mapq", F.when(top, quality).otherwise(F.lit(0)).cast("long")).withColumn("secondary", ~top).drop("__best", "__second")


def with_unmapped(reads: DataFrame, best: DataFrame, by: str = "read_id") -> DataFrame:
    """Every read; those without a row in ``best`` have flag 4."""
    return reads.join(best, by, "left").withColumn("flag", F.coalesce("flag", F.lit(4).cast("long")))


#: The mandatory columns of a SAM row in order, and the tags that follow.
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
TAGS = [("AS", "i", "as"), ("NM", "i", "nm"), ("X0", "Z", "x0")]


def sam_line(df: DataFrame) -> DataFrame:
    """One column ``line``: SAM text; null optional values are left out."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c in ("flag", "pos", "mapq", "pnext", "tlen") else "*")) for c in SAM]
    tags = [F.concat(F.lit(f"{t}:{k}:"), F.col(c).cast("string")) for t, k, c in TAGS if c in df.columns]
    return df.select(F.concat_ws("\t", *fields, *tags).alias("line"))
