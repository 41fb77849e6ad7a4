"""Seeds: exact matches between reads and a reference, as joins, islands and window filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .kmers import kmers
from .reference import with_window

#: Reference k-mers up to which the table is broadcast; larger ones are joined by a shuffle on the code.
BROADCAST_KMERS = 2_000_000
#: Codes of too many places that are broadcast to be left out; more are left out by a shuffle.
BROADCAST_CODES = 1_000_000


def strands(reads: DataFrame, seq: str = "seq", forward: bool = True, reverse: bool = True) -> DataFrame:
    """A row for each strand: strand (+ or -) and its sequence."""
    own = F.struct(F.lit("+").alias("strand"), F.col(seq).alias("s"))
    other = F.struct(F.lit("-").alias("strand"), reverse_complement(seq).alias("s"))
    picked = [x for x, on in ((own, forward), (other, reverse)) if on]
    out = reads.withColumn("__s", F.explode(F.array(*picked)))
    return out.withColumn("strand", F.col("__s.strand")).withColumn(seq, F.col("__s.s")).drop("__s")


def index_of(reference: DataFrame, k: int, dna: bool = False, stride: int = 1) -> DataFrame:
    """(contig_id, rpos, code) of the reference's k-mers, every ``stride``-th place."""
    return kmers(reference, "contig_id", "seq", k, dna, stride).withColumnRenamed("pos", "rpos")


def frequent(index: DataFrame, most: int) -> DataFrame:
    """The codes of more than ``most`` places: counted before anything is joined, partially aggregated."""
    return index.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > most).select("code")


def rare(index: DataFrame, most: int | None, places: int) -> DataFrame:
    """An index (of about ``places`` rows) without the codes of more than ``most`` places, of which there are
    fewer than places / most. An index with a column n (places of the code) is filtered by it as it is read."""
    if most is None:
        return index
    if "n" in index.columns:
        return index.where(F.col("n") <= most)
    out = frequent(index, most)
    return index.join(F.broadcast(out) if places // max(most, 1) <= BROADCAST_CODES else out, "code", "left_anti")


def hits(
    reads: DataFrame, reference: DataFrame, k: int, dna: bool = False, stride: int = 1, most: int | None = None, index: DataFrame | None = None, places: int | None = None,
    skip: int = 1,
) -> DataFrame:
    """(read_id, contig_id, qpos, rpos): equal k-mers of reads (read_id, seq) and contigs (contig_id, seq).
    The reference may be sampled by ``stride`` and the reads by ``skip``; codes of more than ``most`` places are left out before the join,
    so that a repeat costs nothing there. ``index`` is a stored one in place of the contigs' k-mers, ``places``
    its number of rows, where that is known; else both cost a query when the plan is made."""
    if places is None:
        places = index.count() if index is not None else (reference.select(F.sum(F.length("seq")).alias("n")).first()["n"] or 0) // stride
    table = rare(index_of(reference, k, dna, stride) if index is None else index, most, places)
    table = table.select("contig_id", "rpos", "code")
    wanted = None
    if places <= BROADCAST_KMERS:  # 8 bytes a code: the reads' other k-mers needn't leave the worker that makes them
        codes = np.sort(table.select("code").distinct().toArrow().column("code").to_numpy())
        wanted = reads.sparkSession.sparkContext.broadcast(codes.tobytes())
        table = F.broadcast(table)
    probe = kmers(reads, "read_id", "seq", k, dna, skip, wanted).withColumnRenamed("pos", "qpos")
    return probe.join(table, "code").select("read_id", "contig_id", "qpos", "rpos")


def mems(found: DataFrame, k: int, min_len: int | None = None, stride: int = 1) -> DataFrame:
    """Maximal exact matches: islands of consecutive hits on one diagonal. On a reference sampled by ``stride`` the
    hits of an island are that far apart, and its ends fall short of the match's by less than that (``whole``); with
    sampled reads too, ``stride`` is the least common multiple of both steps. Hits are dealt out by read alone, once:
    islands, and what is done by read with the seeds afterwards, need no other shuffle."""
    by = [c for c in found.columns if c not in ("qpos", "rpos")] + ["diagonal"]
    found = found.repartition("read_id") if "read_id" in found.columns else found
    rows = found.withColumn("diagonal", F.col("rpos") - F.col("qpos"))
    rows = rows.withColumn("__i", F.col("qpos") - F.lit(stride) * F.row_number().over(Window.partitionBy(*by).orderBy("qpos")))
    length = ((F.count("*") - 1) * stride + k).cast("int")
    rows = rows.groupBy(*by, "__i").agg(F.min("qpos").alias("qpos"), F.min("rpos").alias("rpos"), length.alias("len"))
    rows = rows.drop("__i", "diagonal")
    return rows if min_len is None else rows.where(F.col("len") >= min_len)


def _agree(a: str, b: str, dna: bool, back: bool) -> int:
    """How many letters two strings have in common from their start, or from their end."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4")[:: -1 if back else 1] for t in (a, b))
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    if dna:
        same &= np.isin(x[:n], [ord(c) for c in "acgt"])
    return n if same.all() else int(same.argmin())


def whole(seeds: DataFrame, reads: DataFrame, contigs: DataFrame, longest: int, dna: bool = False, reach: int | None = None) -> DataFrame:
    """The matches that seeds are parts of: each is extended letter by letter at both ends, at most by ``reach``
    letters a side (None: as far as they agree), and what then is one match is one row. Letters that are no
    base don't match where ``dna``. ``longest`` is the length of the longest read."""
    far = F.lit(longest if reach is None else reach).cast("long")
    rows = seeds.join(reads.select("read_id", F.lower("seq").alias("__s")), "read_id")
    back = F.least(far, F.col("qpos"), F.col("rpos"))
    rows = rows.withColumn("__back", back.cast("long")).withColumn("low", F.col("rpos") - F.col("__back")).withColumn("high", F.col("rpos") + F.col("len") + far)
    rows = rows.withColumn("__s", F.expr(f"substring(__s, cast(qpos - __back as int) + 1, cast(__back + len + {longest if reach is None else reach} as int))"))
    rows = with_window(rows, contigs, 4 * longest + 4)
    names = seeds.columns
    rows = rows.select(*names, "__back", "__s", F.lower("window").alias("__w"))
    schema = seeds.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("qpos", "rpos", "len", "__back", "__s", "__w")}
            new: dict[str, list[int]] = {"qpos": [], "rpos": [], "len": []}
            for q, r, n, back, a, b in zip(*columns.values()):
                left, right = _agree(a[:back], b[:back], dna, True), _agree(a[back + n :], b[back + n :], dna, False)
                new["qpos"].append(q - left)
                new["rpos"].append(r - left)
                new["len"].append(n + left + right)
            arrays = [pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema).distinct()


def _read(df: DataFrame) -> list[str]:
    return ["read_id", "strand"] if "strand" in df.columns else ["read_id"]


def longest_only(seeds: DataFrame) -> DataFrame:
    """Seeds that no seed with an earlier start reaches past: super-maximal matches."""
    so_far = Window.partitionBy(*_read(seeds)).orderBy("qpos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = seeds.withColumn("__end", F.col("qpos") + F.col("len"))
    return rows.withColumn("__top", F.max("__end").over(so_far)).where("__end >= __top").drop("__end", "__top")


def partly_longest(seeds: DataFrame, max_smems: int, min_len: int, most: int = 10_000) -> DataFrame:
    """Of all matches of ``min_len`` letters and more, the longest ones from each start, and shorter ones where ends
    aren't frequent.

    Each start of the read has a longest match; starts with one such end are neighbours, the end's reign. An end is
    frequent if the places of the longest matches of its starts, added up from the left, reach ``max_smems``; the start
    where they do is its limit. Ends of ``most`` places and more are skipped. From the right: starts beyond the least
    limit of the ends so far (its own among them) are left out, whole ends too if their first start is (by the limits of
    those before). A frequent end has only longest matches. Another one also has shorter ones, down to the next frequent
    end on its left, which counts up to that one's limit. Starts one beyond a limit still count as in it."""
    key = _read(seeds)
    by = lambda *c: Window.partitionBy(*key, *c)
    earlier = (Window.unboundedPreceding, -1)
    so_far = by().orderBy("qpos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = seeds.withColumn("__end", F.col("qpos") + F.col("len")).withColumn("__top", F.max("__end").over(so_far))
    starts = rows.where("__end = __top").groupBy(*key, "qpos", "__top").agg(F.count("*").alias("__n"))
    reigns = starts.groupBy(*key, "__top").agg(F.min("qpos").alias("__first"))
    last = F.col("__top") - min_len + 1
    reigns = reigns.withColumn("__until", F.least(F.lead("__first").over(by().orderBy("__first")), last))
    parts = starts.join(reigns, [*key, "__top"]).withColumn("__c", F.sum("__n").over(by("__top").orderBy("qpos")))
    order = by("__top").orderBy("qpos")
    parts = parts.withColumn("__next", F.least(F.lead("qpos").over(order), F.col("__until"))).withColumn("__w", F.greatest(F.col("__next") - F.col("qpos"), F.lit(0)) * F.col("__c"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__w").over(order.rowsBetween(*earlier)), F.lit(0))).withColumn("__then", F.lead("__c").over(order))
    reach = F.col("qpos") + F.ceil((F.lit(max_smems) - F.col("__before")) / F.col("__c")) - 1
    parts = parts.withColumn("__b", F.when((F.col("__before") < max_smems) & (F.col("__before") + F.col("__w") >= max_smems), reach))
    one_more = F.when(F.col("__b") + 1 < F.col("__next"), F.col("__c")).when(F.col("__b") + 1 < F.col("__until"), F.col("__then")).otherwise(0)
    held = F.col("__before") + (F.col("__b") - F.col("qpos") + 1) * F.col("__c") + one_more
    ends = parts.groupBy(*key, "__top", "__first").agg(F.min("__b").alias("__limit"), F.coalesce(F.max(held), F.sum("__w")).alias("__size"))
    frequent, skipped = F.col("__limit").isNotNull(), F.col("__size") >= most
    ends = ends.withColumn("__own", F.when(frequent & ~skipped, F.col("__limit")))
    ends = ends.withColumn("__right", F.min("__own").over(by().orderBy(F.desc("__top")).rowsBetween(*earlier)))
    ends = ends.withColumn("__stop", F.max(F.when(frequent, F.struct("__top", "__limit"))).over(by().orderBy("__top").rowsBetween(*earlier)))
    ends = ends.where(~skipped & F.coalesce(F.col("__first") <= F.col("__right") + 1, F.lit(True)))
    met = rows.join(ends, [*key, "__top"])
    within = F.coalesce(F.col("qpos") <= F.least("__right", "__own") + 1, F.lit(True))
    stop, limit = F.col("__stop.__top"), F.col("__stop.__limit")
    shorter = F.coalesce((F.col("__end") > stop) | ((F.col("__end") == stop) & (F.col("qpos") <= limit + 1)), F.lit(True))
    longest = F.col("__end") == F.col("__top")
    picked = F.when(frequent, longest & (F.col("qpos") <= F.col("__limit") + 1)).otherwise(longest | shorter)
    return met.where(within & picked).select(*seeds.columns)


def unique_in_reference(seeds: DataFrame) -> DataFrame:
    """Matches of a piece of the read that occurs once in the reference."""
    w = Window.partitionBy(*_read(seeds), "qpos", "len")
    return seeds.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n")


def unique_in_both(seeds: DataFrame) -> DataFrame:
    """Those whose piece of the reference also occurs once in the read."""
    rows = unique_in_reference(seeds)
    w = Window.partitionBy(*_read(rows), "contig_id", "rpos", "len")
    return rows.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n")


def strictest_tier(seeds: DataFrame, tiers: list[int]) -> DataFrame:
    """Seeds of the strictest length tier in which their read has any: tier, then the seeds."""
    tier = F.coalesce(*(F.when(F.col("len") >= t, F.lit(i)) for i, t in enumerate(tiers)))
    rows = seeds.withColumn("tier", tier.cast("int")).where("tier is not null")
    best = F.min("tier").over(Window.partitionBy(*_read(rows)))
    return rows.withColumn("__best", best).where("tier <= __best").drop("__best")


def frequency_cap(seeds: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy(*_read(seeds), "qpos", "len")
    return seeds.withColumn("__n", F.count("*").over(w)).where(F.col("__n") <= most).drop("__n")
