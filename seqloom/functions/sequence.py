"""Scalar functions on sequences, CIGAR strings, names and positions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC codes; any other letter becomes n.
BASES, COMPLEMENTS = "acgturykmbvdhswn", "tgcaayrmkvbhdswn"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FOLDED = "acgt" * 6 + "ac"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_to_bases(text: Column | str) -> Column:
    """Any text as bases: letters only, the alphabet folded onto acgt."""
    return F.translate(F.regexp_replace(F.lower(col(text)), "[^a-z]", ""), LETTERS, FOLDED)


def reverse_complement(seq: Column | str) -> Column:
    known = F.regexp_replace(F.lower(col(seq)), f"[^{BASES}]", "n")
    return F.reverse(F.translate(known, BASES, COMPLEMENTS))


def base_codes(seq: Column | str) -> Column:
    """Digits 0 to 3 for acgt, 4 for all else."""
    return F.translate(F.regexp_replace(F.lower(col(seq)), "[^acgt]", "4"), "acgt", "0123")


def strip_mate(qname: Column | str) -> Column:
    """A name without its last two characters if the first of them is a slash."""
    q = col(qname)
    return F.when((F.length(q) > 2) & (F.substring(q, -2, 1) == "/"), F.regexp_replace(q, "/.$", "")).otherwise(q)


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<n long, op string>>"""
    c = col(cigar)
    return F.zip_with(
        F.regexp_extract_all(c, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)),
        lambda n, op: F.struct(n.cast("long").alias("n"), op.alias("op")),
    )


def collapse_cigar(cigar: Column | str) -> Column:
    """Runs of = and X (and M) become one M."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("n"), F.lit("").alias("op"))
    flush = lambda a: F.when(a["n"] > 0, F.concat(a["out"], a["n"].cast("string"), a["op"])).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        op = F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"])
        same = a["op"] == op
        return F.struct(
            F.when(same, a["out"]).otherwise(flush(a)).alias("out"), F.when(same, a["n"] + x["n"]).otherwise(x["n"]).alias("n"), op.alias("op")
        )

    return F.aggregate(cigar_ops(cigar), empty, step, flush)


def cigar_length(cigar: Column | str, ops: str) -> Column:
    """Total length of some operations."""
    picked = F.filter(cigar_ops(cigar), lambda x: F.lit(ops).contains(x["op"]))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def reference_span(cigar: Column | str) -> Column:
    return cigar_length(cigar, "MDN=X")


def clip(cigar: Column | str, right: bool) -> Column:
    """Clipped bases (soft or hard) at one end."""
    found = F.regexp_extract(col(cigar), r"[^0-9](\d+)[SH]$" if right else r"^(\d+)[SH]", 1)
    return F.when(found == "", F.lit(0)).otherwise(found.try_cast("long")).cast("long")


def clipped_places(pos: Column, cigar: Column | str) -> dict[str, Column]:
    """Where a read would begin and end if its clipped bases lay on the reference (left, right), and the same with
    the clips of the ends swapped (left0, right0), for reads of the other strand."""
    end, left, right = pos + reference_span(cigar) - 1, clip(cigar, False), clip(cigar, True)
    return {"left": pos - left, "right": end + right, "left0": pos - right, "right0": end + left}


def max_edits(length: Column, error_rate: float) -> Column:
    return (F.floor(length * F.lit(error_rate)) + 1).cast("long")


def min_score(length: Column, edits: Column, match: int, mismatch: int) -> Column:
    return (length * match + edits * (mismatch - match)).cast("long")


def seed_length(length: Column, edits: Column, error_rate: float, fixed: int | None = None) -> Column:
    """The least length of a read's seeds: 40, more for a read of 1,000 bases and on; or, where it is fixed, that,
    or what a read of so many edits must have if it is more."""
    if fixed is not None:
        return F.greatest(F.lit(fixed), F.floor(length / edits)).cast("long")
    long = F.floor(F.floor(length / 500) * 20 / (100 * error_rate))
    return (F.lit(40) + F.when(length >= 1000, long).otherwise(0)).cast("long")


def band(edits: Column, length: Column, match: int, gap_open: int, gap_extend: int, fixed: int, least: int = 3) -> Column:
    """Diagonals that an alignment may leave: by edits, by score and by the fixed bound."""
    by_score = F.floor((length * match + gap_open) / -gap_extend)
    return F.greatest(F.lit(least), F.least(F.lit(fixed), F.least(edits, by_score))).cast("long")


def mapq(best: Column, second: Column, sentinel: Column) -> Column:
    """60 scaled by how far the second best score falls behind; ``sentinel`` stands for a missing one."""
    other = F.coalesce(second, sentinel)
    raw = F.floor((best - other) * 250.0 / F.when(best == 0, F.lit(None)).otherwise(best) + 0.499)
    return F.when(best <= other, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(60), F.coalesce(raw, F.lit(0))))).cast("long")


def template_length(start: Column, end: Column, mate_start: Column, mate_end: Column, reverse: Column, mate_reverse: Column) -> Column:
    """Span of a pair; negative if the own 5' end lies right of the mate's."""
    span = F.greatest(end, mate_end) - F.least(start, mate_start) + 1
    own, other = F.when(reverse, end).otherwise(start), F.when(mate_reverse, mate_end).otherwise(mate_start)
    return F.when(own > other, -span).otherwise(span).cast("long")


SIMULATED = r"^(.*)_(\d+)_(\d+)_(\d+):(\d+):(\d+)_(\d+):(\d+):(\d+)_([^_]*)$"


def simulated_origin(qname: Column | str) -> Column:
    """struct of contig, both positions, the edit counts of both ends and the counter, from a simulated
    read's name; null where the name has another form."""
    q = col(qname)
    part = lambda i: F.regexp_extract(q, SIMULATED, i)
    number = lambda i: part(i).try_cast("long")
    return F.when(
        q.rlike(SIMULATED),
        F.struct(
            part(1).alias("contig"), number(2).alias("fwd_pos"), number(3).alias("rev_pos"),
            (number(4) + number(5) + number(6)).alias("fwd_edits"), (number(7) + number(8) + number(9)).alias("rev_edits"), part(10).alias("counter"),
        ),
    )


def local_position(position: Column, offset: Column) -> Column:
    """Global 0-based to local 1-based."""
    return (position - offset + 1).cast("long")
