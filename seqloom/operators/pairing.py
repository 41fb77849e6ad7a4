"""Pairing of mates: concordance as an equi-join with range conditions, mate windows, discordant pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import PairParams


def concordant(pairs: DataFrame, p: PairParams) -> Column:
    """Whether rows with contig, start, end (inclusive) and reverse of both mates (a_, b_) fit together."""
    c = F.col
    same, opposite = c("a_reverse") == c("b_reverse"), c("a_reverse") != c("b_reverse")
    strands = same if p.orientation.value == "ff" else opposite
    a_left = c("a_reverse") if p.orientation.value == "rf" else ~c("a_reverse")
    left_start = F.when(a_left, c("a_start")).otherwise(c("b_start"))
    right_start = F.when(a_left, c("b_start")).otherwise(c("a_start"))
    right_end = F.when(a_left, c("b_end")).otherwise(c("a_end"))
    span = F.greatest("a_end", "b_end") - F.least("a_start", "b_start") + 1
    inside = ((c("a_start") >= c("b_start")) & (c("a_end") <= c("b_end"))) | ((c("b_start") >= c("a_start")) & (c("b_end") <= c("a_end")))
    overlap = inside | c("b_start").between(c("a_start"), c("a_end")) | c("b_end").between(c("a_start"), c("a_end"))
    ok = (c("a_contig") == c("b_contig")) & strands & (right_end > left_start) & span.between(p.min_insert, p.max_insert)
    if not p.contain:
        ok = ok & ~inside
    if not p.overlap:
        ok = ok & ~overlap
    dovetail = left_start > right_start
    return ok & (~dovetail | (overlap if p.dovetail else F.lit(False)))


def joined_mates(mates1: DataFrame, mates2: DataFrame, by: str = "read_id") -> DataFrame:
    """All candidate pairs of a read; columns other than the key get a_ and b_ in front."""
    rename = lambda df, x: df.select(by, *(F.col(c).alias(x + c) for c in df.columns if c != by))
    return rename(mates1, "a_").join(rename(mates2, "b_"), by)


def concordant_pairs(mates1: DataFrame, mates2: DataFrame, p: PairParams, by: str = "read_id") -> DataFrame:
    return joined_mates(mates1, mates2, by).where(concordant(None, p))


def discordant_pairs(mates1: DataFrame, mates2: DataFrame, paired: DataFrame, by: str = "read_id") -> DataFrame:
    """The best-scoring alignments of reads without any concordant pair, crossed."""
    top = Window.partitionBy(by)
    best = lambda df: df.withColumn("__m", F.max("score").over(top)).where("score = __m").drop("__m")
    free = lambda df: df.join(paired.select(by).distinct(), by, "left_anti")
    return joined_mates(best(free(mates1)), best(free(mates2)), by)


def mate_window(start: Column, end: Column, reverse: Column, length: Column, second: Column, p: PairParams) -> tuple[Column, Column, Column]:
    """(wanted reverse, low, high): where the mate of an alignment should lie."""
    at = F.when(reverse, end).otherwise(start)
    if p.orientation.value == "ff":
        right, wanted = (~reverse) != second, reverse
    else:
        right, wanted = (reverse if p.orientation.value == "rf" else ~reverse), ~reverse
    low = F.when(right, at + p.min_insert).otherwise(at - p.max_insert) - F.when(wanted, length).otherwise(0)
    high = F.when(right, at + p.max_insert).otherwise(at - p.min_insert) + F.when(wanted, 0).otherwise(length)
    if not p.overlap:
        low, high = F.when(right, F.greatest(low, end)).otherwise(low), F.when(right, high).otherwise(F.least(high, start))
    elif not p.dovetail:
        low, high = F.when(right, F.greatest(low, start)).otherwise(low), F.when(right, high).otherwise(F.least(high, end))
    return wanted, F.greatest(low, F.lit(0)).cast("long"), high.cast("long")


def best_in_window(windows: DataFrame, mates: DataFrame, by: str = "read_id") -> DataFrame:
    """For each window row (by, window_id, contig, wanted, low, high) its best mate alignment inside."""
    m = mates.select(by, *(F.col(c).alias(f"m_{c}") for c in ("contig", "start", "end", "reverse", "score")))
    inside = windows.join(m, by).where("m_contig = contig and m_reverse = wanted and m_start >= low and m_end <= high")
    place = Window.partitionBy(by, "window_id").orderBy(F.desc("m_score"), "m_start", "m_end")
    return inside.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def zipped(mates1: DataFrame, mates2: DataFrame) -> DataFrame:
    """Pairs by position in two inputs that carry an ordinal; ends with the shorter one."""
    return mates1.toDF(*(f"a_{c}" if c != "ordinal" else c for c in mates1.columns)).join(
        mates2.toDF(*(f"b_{c}" if c != "ordinal" else c for c in mates2.columns)), "ordinal"
    )


def concordant_regions(p: PairParams) -> Column:
    """Whether two regions (a_ and b_ contig, begin, until (inclusive), reverse and edits) may hold a concordant
    pair: the rules of ``concordant`` with the mates' edits as slack."""
    c = F.col
    slack = c("a_edits") + c("b_edits")
    strands = c("a_reverse") == c("b_reverse") if p.orientation.value == "ff" else c("a_reverse") != c("b_reverse")
    a_left = c("a_reverse") if p.orientation.value == "rf" else ~c("a_reverse")
    left, right = F.when(a_left, c("a_begin")).otherwise(c("b_begin")), F.when(a_left, c("b_begin")).otherwise(c("a_begin"))
    right_until = F.when(a_left, c("b_until")).otherwise(c("a_until"))
    span = F.greatest("a_until", "b_until") - F.least("a_begin", "b_begin") + 1
    in_b = (c("a_begin") - slack >= c("b_begin")) & (c("a_until") + slack <= c("b_until"))
    in_a = (c("b_begin") - slack >= c("a_begin")) & (c("b_until") + slack <= c("a_until"))
    inside = in_a | in_b
    overlap = inside | ((c("b_until") - slack >= c("a_begin")) & (c("b_begin") + slack <= c("a_until")))
    ok = (c("a_contig") == c("b_contig")) & strands & (right_until > left) & (span + slack >= p.min_insert) & (span - slack <= p.max_insert)
    if not p.contain:
        ok = ok & ~inside
    if not p.overlap:
        ok = ok & ~overlap
    dovetail = left > right + slack
    return ok & (~dovetail | (overlap if p.dovetail else F.lit(False)))
