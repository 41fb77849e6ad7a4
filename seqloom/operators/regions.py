"""Candidate regions: seeds of one read that lie together on the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def triage(seeds: DataFrame, max_seeds: int, max_mems: int, min_mem_length: int) -> DataFrame:
    """Adds ``chosen``: seeds whose end reaches beyond that of the group before while not too many share
    the stretch, and long seeds of small stretches; the others only fill regions."""
    group = Window.partitionBy("read_id", "qpos", "len")
    rows = seeds.withColumn("__end", F.col("qpos") + F.col("len")).withColumn("__n", F.count("*").over(group))
    groups = rows.groupBy("read_id", "qpos", "len", "__end", "__n").count().drop("count")
    order = Window.partitionBy("read_id").orderBy("qpos", F.desc("len"))
    groups = groups.withColumn("__before", F.lag("__end").over(order)).withColumn("__new", F.coalesce(F.col("__end") > F.col("__before"), F.lit(True)))
    groups = groups.withColumn("__block", F.sum(F.col("__new").cast("int")).over(order))
    running = Window.partitionBy("read_id", "__block").orderBy("qpos", F.desc("len"))
    groups = groups.withColumn("__running", F.sum("__n").over(running))
    chosen = (F.col("__new") & (F.col("__running") <= max_seeds)) | ((F.col("__running") <= max_mems) & (F.col("len") >= min_mem_length))
    groups = groups.select("read_id", "qpos", "len", chosen.alias("chosen"))
    return rows.drop("__end", "__n").join(groups, ["read_id", "qpos", "len"])


def sessions(seeds: DataFrame, slack: int) -> DataFrame:
    """Adds region (1, 2, ... in a read and contig): seeds by diagonal, a new region where the diagonal
    jumps by more than ``slack``."""
    w = Window.partitionBy("read_id", "contig_id").orderBy("diagonal", "qpos")
    rows = seeds.withColumn("diagonal", F.col("rpos") - F.col("qpos"))
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w)) > slack, F.lit(True))
    rows = rows.withColumn("__jump", jump.cast("int"))
    return rows.withColumn("region", F.sum("__jump").over(w)).drop("__jump", "diagonal")


def covered(seeds: DataFrame, by: list[str]) -> DataFrame:
    """by, covered (read bases under seeds), ref_begin, ref_end, q_begin, q_end, seeds."""
    before = Window.partitionBy(*by).orderBy("qpos", F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    rows = seeds.withColumn("__end", F.col("qpos") + F.col("len")).withColumn("__top", F.coalesce(F.max("__end").over(before), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("__end") - F.greatest("qpos", "__top"))
    return rows.groupBy(*by).agg(
        F.sum(new).cast("long").alias("covered"),
        F.min("rpos").cast("long").alias("ref_begin"),
        F.max(F.col("rpos") + F.col("len")).cast("long").alias("ref_end"),
        F.min("qpos").cast("long").alias("q_begin"),
        F.max("__end").cast("long").alias("q_end"),
        F.count("*").alias("seeds"),
    )


def ranked(regions: DataFrame) -> DataFrame:
    """Adds rank in the read: most covered bases first, then contig and place."""
    order = Window.partitionBy("read_id").orderBy(F.desc("covered"), "contig_id", "ref_begin", "region")
    return regions.withColumn("rank", F.row_number().over(order).cast("long"))


def apart_from_best(regions: DataFrame) -> DataFrame:
    """Lower-ranked regions whose read interval doesn't overlap the best region's."""
    best = regions.where("rank = 1").select("read_id", F.col("q_begin").alias("b0"), F.col("q_end").alias("b1"))
    return regions.where("rank > 1").join(best, "read_id").where("q_end <= b0 or q_begin >= b1").drop("b0", "b1")


def apart_from(regions: DataFrame, alignments: DataFrame) -> DataFrame:
    """Regions (read_id, contig, reverse, begin, until) that no alignment (start, end, inclusive) of their read
    overlaps on the same contig and strand. The join is by read, contig and strand, so it is as wide as one read's."""
    a = alignments.select("read_id", "contig", "reverse", F.col("start").alias("__s"), F.col("end").alias("__e"))
    same = [regions[c] == a[c] for c in ("read_id", "contig", "reverse")]
    return regions.join(a, [*same, a["__e"] >= regions["begin"], a["__s"] <= regions["until"]], "left_anti")
