"""Statistics and accuracy of alignment tables. Inputs need no order: grouping and joins are by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PER_READ = 101


def summary(sam: DataFrame, qualities: list[int], reads: int | None = None) -> DataFrame:
    """level, mapped, paired, paired_correct, secondary, reads (and their percents): one row for all
    alignments, one for reads with one alignment, one for each least quality."""
    rows = sam.where("flag <> 4").withColumn("__n", F.count("*").over(Window.partitionBy("qname")))
    levels = [F.struct(F.lit("all").alias("level"), F.lit(True).alias("in")), F.struct(F.lit("unique").alias("level"), (F.col("__n") == 1).alias("in"))]
    levels += [F.struct(F.lit(f"mapq>={q}").alias("level"), (F.col("mapq") >= q).alias("in")) for q in qualities]
    rows = rows.withColumn("__l", F.explode(F.array(*levels))).where("__l.in")
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    out = rows.groupBy(F.col("__l.level").alias("level")).agg(
        F.count_if(~bit(4)).alias("mapped"),
        F.count_if(F.col("rnext") != "*").alias("paired"),
        F.count_if(bit(2)).alias("paired_correct"),
        F.count_if(bit(256)).alias("secondary"),
        F.countDistinct("qname").alias("reads"),
    )
    total = sam.agg(F.countDistinct("qname").alias("total")) if reads is None else sam.sparkSession.range(1).select(F.lit(reads).cast("long").alias("total"))
    out = out.join(F.broadcast(total), F.lit(True))  # one row
    return out.withColumn("pct_reads", F.expr("coalesce(100 * reads div nullif(total, 0), 0)")).drop("total")


def histogram(sam: DataFrame) -> DataFrame:
    """alignments (at most 101), reads: how many reads have so many alignments."""
    rows = sam.where("flag <> 4").groupBy("qname").agg(F.least(F.count("*"), F.lit(MOST_PER_READ)).alias("alignments"))
    return rows.groupBy("alignments").agg(F.count("*").alias("reads"))


def _tally(rows: DataFrame, by: list[str]) -> DataFrame:
    """Alignments and reads (by their best alignment) that are good (2), ok (1) or bad (0)."""
    reads = rows.groupBy(*by, "qname").agg(F.max("verdict").alias("best"), F.count_if(F.col("verdict") == 2).alias("g"), F.count_if(F.col("verdict") == 1).alias("o"), F.count("*").alias("n"))
    out = reads.groupBy(*by).agg(
        F.sum("g").alias("correct"), F.sum("o").alias("ok"), (F.sum("n") - F.sum("g") - F.sum("o")).alias("incorrect"), F.sum("n").alias("__n"),
        F.count_if(F.col("best") == 2).alias("reads_correct"), F.count_if(F.col("best") == 1).alias("reads_ok"), F.count_if(F.col("best") == 0).alias("reads_incorrect"),
    )
    return out.withColumn("pct_correct", F.expr("100 * correct div __n")).drop("__n")


def _levels(rows: DataFrame, qualities: list[int], unique_most: int = 1, unique_least: int = 1) -> DataFrame:
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("qname")))
    levels = [F.struct(F.lit("all").alias("level"), F.lit(True).alias("in")), F.struct(F.lit("unique").alias("level"), F.col("__n").between(unique_least, unique_most).alias("in"))]
    levels += [F.struct(F.lit(f"mapq>={q}").alias("level"), (F.col("mapq") >= q).alias("in")) for q in qualities]
    return rows.withColumn("__l", F.explode(F.array(*levels))).where("__l.in").withColumn("level", F.col("__l.level")).drop("__l", "__n")


def _against_truth(truth: DataFrame, sam: DataFrame, windows: list[int], paired: bool) -> DataFrame:
    """Mapped rows of ``sam`` and windows, each with its verdict."""
    mate = F.when(F.col("flag").bitwiseAND(64) != 0, 1).otherwise(2) if paired else F.lit(0)
    t = truth.select("qname", mate.alias("__mate"), *(F.col(c).alias(f"t_{c}") for c in ("flag", "rname", "pos", "edits", *(["rnext"] if paired else []))))
    rows = sam.where(F.col("flag").bitwiseAND(4) == 0).withColumn("__mate", mate).join(t, ["qname", "__mate"]).drop("__mate")
    rows = rows.withColumn("window", F.explode(F.array(*(F.lit(w) for w in windows))))
    bits = 127 if paired else 16
    near = (F.col("rname") == F.col("t_rname")) & (F.col("flag").bitwiseAND(bits) == F.col("t_flag").bitwiseAND(bits)) & (F.abs(F.col("pos") - F.col("t_pos")) <= F.col("window"))
    if paired:
        near = near & (F.col("rnext") == F.col("t_rnext"))
    few = (F.col("edits") >= 0) & (F.col("edits") <= F.col("t_edits"))
    return rows.withColumn("verdict", F.when(near, 2).when(few, 1).otherwise(0))


def against_truth(truth: DataFrame, sam: DataFrame, windows: list[int], qualities: list[int], paired: bool = False) -> DataFrame:
    """Per window and level: alignments near the true place are good, others of few enough edits ok.
    truth: qname, flag, rname, pos, edits; sam: qname, flag, rname, pos, mapq, edits (-1: unknown). ``paired``: truth
    has a row for each mate, both tables have rnext, all flags of a pair must agree, and a pair is unique if
    it has two alignments."""
    levels = _levels(sam.where(F.col("flag").bitwiseAND(4) == 0), qualities, 2 if paired else 1, 2 if paired else 1)
    return _tally(_against_truth(truth, levels, windows, paired), ["window", "level"])


def per_read(truth: DataFrame, sam: DataFrame, windows: list[int], paired: bool = False) -> DataFrame:
    """qname, window, found (0 or 1): whether any alignment of the read is good or ok. Reads of ``truth`` without a
    mapped row are listed with 0."""
    best = _against_truth(truth, sam, windows, paired).groupBy("qname", "window").agg(F.max(F.least("verdict", F.lit(1))).alias("found"))
    every = truth.select("qname").distinct().withColumn("window", F.explode(F.array(*(F.lit(w) for w in windows))))
    return every.join(best, ["qname", "window"], "left").select("qname", "window", F.coalesce("found", F.lit(0)).alias("found"))


def against_names(sam: DataFrame, windows: list[int], qualities: list[int]) -> DataFrame:
    """As against_truth, for simulated reads whose origin was parsed from their names: contig, fwd_pos,
    rev_pos, fwd_edits, rev_edits beside qname, flag, rname, mapq, edits and the places left, right, left0, right0
    (``clipped_places``), the nearer of which counts."""
    rows = _levels(sam.where(F.col("flag").bitwiseAND(4) == 0), qualities, 2)
    rows = rows.withColumn("window", F.explode(F.array(*(F.lit(w) for w in windows))))
    reverse = F.col("flag").bitwiseAND(16) != 0
    nearer = lambda at, a, b: F.least(F.abs(F.col(a) - F.col(at)), F.abs(F.col(b) - F.col(at)))
    off = F.when(reverse, nearer("rev_pos", "right", "right0")).otherwise(nearer("fwd_pos", "left", "left0"))
    few = (F.col("edits") >= 0) & (F.col("edits") <= F.when(reverse, F.col("rev_edits")).otherwise(F.col("fwd_edits")))
    near = (F.col("rname") == F.col("contig")) & (off <= F.col("window"))
    return _tally(rows.withColumn("verdict", F.when(near, 2).when(few, 1).otherwise(0)), ["window", "level"])


def run_statistics(sam: DataFrame) -> DataFrame:
    """sequences, mapped sequences and alignments."""
    mapped = F.col("flag").bitwiseAND(4) == 0
    return sam.agg(F.countDistinct("qname").alias("sequences"), F.countDistinct(F.when(mapped, F.col("qname"))).alias("mapped"), F.count_if(mapped).alias("alignments"))
