"""Mapping of reads: seeds by joins, regions by windows, then chains and extension in a kernel, one read
at a time. Ranking and SAM rows are relational again."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.sequence import cigar_length, collapse_cigar, max_edits, reference_span, reverse_complement, seed_length
from ..params import AlignParams, SeedType
from ..sources.tables import written
from . import kernels as K
from . import seeds as S
from .post import top_k, with_mapq, with_unmapped
from .reference import with_window

ALIGNED = "read_id long, strand string, contig_id long, start long, end long, q_start long, q_end long, score long, nm long, x0 string"


def chain(seeds: list[tuple[int, int, int]], anchor: int, error_rate: float, length: int) -> tuple[list[int], int, int]:
    """(seed numbers in order, skew, covered bases): greedily right, then left of an anchor. Seeds (q, r, len)
    are sorted; a neighbour joins if it overlaps by at most ten bases and its diagonal moves little enough.
    The skew bounds the edits from below: those between seeds, and one at each end of the read not reached."""
    q, r, n = seeds[anchor]
    picked, skew, covered = [anchor], 0, n
    for step in (1, -1):
        last, i = anchor, anchor + step
        while 0 <= i < len(seeds):
            a, b = (seeds[last], seeds[i]) if step > 0 else (seeds[i], seeds[last])
            dq, dr = b[0] - a[0] - a[2], b[1] - a[1] - a[2]
            span = max(b[0] + b[2] - a[0], b[1] + b[2] - a[1])
            if dq >= -10 and dr >= -10 and abs(dq - dr) <= int(error_rate * span):
                skew += max(1, abs(dq - dr))
                covered += seeds[i][2] + min(0, dq, dr)
                picked.append(i)
                last = i
            i += step
        reached = seeds[last][0] + seeds[last][2] == length if step > 0 else seeds[last][0] == 0
        skew += not reached
    return sorted(picked), skew, covered


class Piece(NamedTuple):
    """A stretch of an alignment whose CIGAR is worked out only if it is reported."""

    q0: int
    q1: int
    r0: int
    r1: int
    band: int
    exact: bool = False
    back: bool = False


def gap(query: str, reference: str, p: AlignParams, band: int) -> int:
    """Score between two seeds: formulas where they suffice, else banded alignment."""
    a, b = len(query), len(reference)
    if not a and not b:
        return 0
    if not a or not b:
        return p.gap_open + p.gap_extend * (a + b)
    if a == b == 1:
        return p.match if query == reference else p.mismatch
    return K.score_global(query, reference, p.match, p.mismatch, -p.gap_open, -p.gap_extend, band)


def extend_chain(read: str, ref: str, seeds: list[tuple[int, int, int]], picked: list[int], p: AlignParams, spare: int):
    """(score, q_start, q_end, r_start, r_end, pieces) of a chain with its gaps and both ends, without a CIGAR.
    ``spare`` is how many edits the read may have beyond those that the chain's skew proves."""
    pieces: list[Piece] = []
    q0, r0, _ = seeds[picked[0]]
    q, r, score = q0, r0, 0
    for i in picked:
        sq, sr, n = seeds[i]
        over = max(q - sq, r - sr, 0)
        if over >= n:
            continue
        sq, sr, n = sq + over, sr + over, n - over
        moved = abs((sq - q) - (sr - r))
        band = max(min(p.bandwidth, spare + moved + 3), moved + int(moved * p.error_rate))
        score += gap(read[q:sq], ref[r:sr], p, band) + n * p.match
        pieces += [Piece(q, sq, r, sr, band), Piece(sq, sq + n, sr, sr + n, 0, True)]
        q, r = sq + n, sr + n
    cost = dict(match=p.match, mismatch=p.mismatch, opening=-p.gap_open, extend=-p.gap_extend)
    edits = p.max_edits(len(read))
    for left in sorted((True, False), key=lambda x: q0 if x else len(read) - q):
        rest = read[:q0][::-1] if left else read[q:]
        if not rest:
            continue
        slack = spare + 1 if left else edits
        window = ref[max(0, r0 - len(rest) - slack) : r0][::-1] if left else ref[r : r + len(rest) + slack]
        band = min(p.bandwidth, spare + 1, len(rest))
        best, bq, br, whole, wr = K.extend_from(rest, window, max(score, 1), band=band, zdrop=p.zdrop, **cost)
        if whole >= 0 and (not p.local or whole >= best + 3 * (p.mismatch - p.match)):
            taken, used, gain = len(rest), wr, whole
        elif p.local:
            taken, used, gain = bq, br, best
        else:
            # forced to the end of the read, over what reference there is
            band = edits + 1
            taken, used = len(rest), min(len(rest), len(window))
            gain = score + K.score_global(rest, window[:used], band=band, **cost)
        score = gain
        if left:
            pieces.insert(0, Piece(q0 - taken, q0, r0 - used, r0, band, back=True))
            q0, r0 = q0 - taken, r0 - used
        else:
            pieces.append(Piece(q, q + taken, r, r + used, band))
            q, r = q + taken, r + used
    return score, q0, q, r0, r, pieces


def traced(read: str, ref: str, pieces: list[Piece], p: AlignParams) -> str:
    """The CIGAR of an alignment's pieces."""
    out = []
    for x in pieces:
        a, b = read[x.q0 : x.q1], ref[x.r0 : x.r1]
        if x.exact:
            out.append(f"{len(a)}=")
        elif x.back:
            out.append(reverse_cigar(K.align_global(a[::-1], b[::-1], p.match, p.mismatch, -p.gap_open, -p.gap_extend, x.band)[1]))
        else:
            out.append(K.align_global(a, b, p.match, p.mismatch, -p.gap_open, -p.gap_extend, x.band)[1])
    return merge_cigar("".join(out))


def out_of_reach(seed: tuple[int, int, int], bounds: tuple[int, int, int, int], p: AlignParams) -> bool:
    """Whether an anchor inside an earlier alignment (q, q end, r, r end) lies so near one of its corners that no
    other alignment could start from it."""
    q, r, n = seed
    q0, q1, r0, r1 = bounds
    if q < q0 or q + n > q1 or r < r0 or r + n > r1:
        return False
    for dq, dr in ((q - q0, r - r0), (q1 - q - n, r1 - r - n)):
        if max(dq, dr) < min(p.bandwidth, int((min(dq, dr) * p.match + p.gap_open) / p.gap_extend + 1)):
            return True
    return False


def reverse_cigar(cigar: str) -> str:
    import re

    return "".join(reversed(re.findall(r"\d+[=XID]", cigar)))


def merge_cigar(cigar: str) -> str:
    import re

    out: list[list] = []
    for n, op in re.findall(r"(\d+)([=XIDS])", cigar):
        if out and out[-1][1] == op:
            out[-1][0] += int(n)
        elif int(n):
            out.append([int(n), op])
    return "".join(f"{n}{op}" for n, op in out)


class Claims:
    """Read intervals that seeds of earlier regions hold; a region is fresh if a seed of it reaches further."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: dict[int, int] = {}

    def add(self, seeds: list[dict]) -> bool:
        fresh = False
        for q, end in ((s["qpos"], s["qpos"] + s["len"]) for s in seeds):
            at = bisect_right(self.starts, q)
            if not at or self.ends[self.starts[at - 1]] < end:
                if q not in self.ends:
                    self.starts.insert(at, q)
                self.ends[q] = end
                fresh = True
        return fresh


class Mate:
    """One read of a kernel row: both strands, its limits and the alignments (Found) so far."""

    def __init__(self, plus: str, minus: str, p: AlignParams) -> None:
        self.text, self.p, self.length = {"+": plus, "-": minus}, p, len(plus)
        self.edits, self.found = p.max_edits(len(plus)), []
        self.least = int(self.length * p.min_coverage) * p.match if p.local else p.min_score(self.length)
        self.coverage = 0 if p.local else int(self.length * p.min_coverage)

    def least_with(self, edits: float) -> int:
        """The score of a read with so many mismatches, never below 0."""
        return max(0, int(self.length * self.p.match + (self.p.mismatch - self.p.match) * edits))

    def extend(self, region: dict, least: int, coverage: int) -> int:
        """Alignments out of one region's seeds, anchors by length; the best new score, or -1."""
        read, shift, p, best = self.text[region["strand"]], region["low"], self.p, -1
        seeds = sorted((s["qpos"], s["rpos"] - shift, s["len"]) for s in region["seeds"])
        used: set[int] = set()
        bounds: list[tuple[int, int, int, int]] = []
        for anchor in sorted(range(len(seeds)), key=lambda i: (-seeds[i][2], i)):
            if anchor in used or any(out_of_reach(seeds[anchor], x, p) for x in bounds):
                continue
            picked, skew, _ = chain(seeds, anchor, p.error_rate, self.length)
            used.update(picked)
            if not p.local and (skew > self.edits or (len(picked) == 1 and seeds[anchor][2] < coverage)):
                continue
            score, q0, q1, r0, r1, pieces = extend_chain(read, region["window"], seeds, picked, p, max(self.edits - skew, 0))
            bounds.append((q0, q1, r0, r1))
            got = Found(region["strand"], region["contig_id"], r0 + shift, r1 + shift, q0, q1, score, region["window"], pieces)
            near = any((x.strand, x.contig) == (got.strand, got.contig) and abs(x.start - got.start) < self.edits and x.score >= score for x in self.found)
            if score >= least and not near:
                self.found.append(got)
                best = max(best, score)
        return best


class Found(NamedTuple):
    strand: str
    contig: int
    start: int
    end: int
    q_start: int
    q_end: int
    score: int
    window: str
    pieces: list[Piece]


def walk(mates: dict[int, Mate], regions: list[dict], p: AlignParams, least: dict[int, int], coverage: dict[int, int], limit: int, done: set[str] | None = None, then=None) -> None:
    """Extends the regions of one or both mates in their order until there are ``limit`` alignments. A region
    is passed over once too many of its strand failed in a row, unless it is fresh, or if it is a single
    seed that covers too little. ``done`` holds keys of regions that were extended; ``then`` is called with
    the mate's number and its new alignments."""
    failures, claims, top = {"+": 0, "-": 0}, {"+": Claims(), "-": Claims()}, 0
    for region in regions:
        if sum(len(m.found) for m in mates.values()) >= limit:
            break
        strand, number = region["strand"], region["mate"]
        fresh = claims[strand].add(region["seeds"])
        if done is not None and region["key"] in done:
            continue
        if (failures[strand] >= p.max_failures and not fresh) or (len(region["seeds"]) == 1 and region["covered"] < coverage[number]):
            continue
        had = len(mates[number].found)
        best = mates[number].extend(region, least[number], coverage[number])
        if done is not None:
            done.add(region["key"])
        failures[strand] = 0 if best >= 0 and (p.reset_failures or best > top) else failures[strand] + 1
        top = max(top, best)
        if then is not None:
            then(number, mates[number].found[had:])


#: Alignments that a second, laxer walk over a read's regions may give.
RESCUED = 20


def walk_alone(mates: dict[int, Mate], regions: list[dict], number: int, p: AlignParams) -> None:
    """One mate's regions; if nothing came of them, once more with a fifth of the bases allowed to differ."""
    own, mate = [r for r in regions if r["mate"] == number], mates[number]
    walk({number: mate}, own, p, {number: mate.least}, {number: mate.coverage}, max(p.report, p.max_alignments))
    if not mate.found and p.rescue and not p.local:
        walk_again(mates, regions, number, p)


def walk_again(mates: dict[int, Mate], regions: list[dict], number: int, p: AlignParams) -> None:
    own, mate = [r for r in regions if r["mate"] == number], mates[number]
    walk({number: mate}, own, p, {number: mate.least_with(0.2 * mate.length)}, {number: int(0.01 * mate.length)}, RESCUED)


class Index(NamedTuple):
    """A stored index (contig_id, rpos, code, n), its k-mer size and sampling, and how many rows it has."""

    table: DataFrame
    k: int
    stride: int = 1
    rows: int | None = None


def seeds_of(signed: DataFrame, contigs: DataFrame, p: AlignParams, k: int, dna: bool, index: Index | None = None, longest: int | None = None) -> DataFrame:
    """Seeds of the kind that ``p.seed_type`` names. Codes of more than ``max_seeds`` places are left out before the
    join; where the reference is sampled or has such codes, what is found is extended to the matches it is part of."""
    stride = p.sparseness if index is None else index.stride
    table = S.index_of(contigs, k, dna, stride) if index is None else index.table
    places = (contigs.select(F.sum(F.length("seq")).alias("n")).first()["n"] or 0) // stride if index is None else index.rows if index.rows is not None else table.count()
    skip = p.skip(k, stride)
    found = S.hits(signed, contigs, k, dna, stride, p.max_seeds, table, places, skip)
    stride = math.lcm(stride, skip)
    found = S.mems(found, k, stride=stride)
    repeats = table.where(F.col("n") > p.max_seeds) if "n" in table.columns else S.frequent(table, p.max_seeds)
    if places > p.max_seeds and repeats.limit(1).count():
        found = S.whole(found, signed, contigs, longest or longest_read(signed), dna)
    elif stride > 1:
        found = S.whole(found, signed, contigs, longest or longest_read(signed), dna, stride - 1)
    kinds = {
        SeedType.MEM: lambda x: x, SeedType.SMEM: S.longest_only, SeedType.PSMEM: lambda x: S.partly_longest(x, p.max_smems, k, p.max_seeds),
        SeedType.MAM: S.unique_in_reference, SeedType.MUM: S.unique_in_both,
    }
    return S.frequency_cap(kinds[p.seed_type](found), p.max_seeds)


_SEEDS = "array<struct<qpos:long,rpos:long,len:long>>"
REGION = f"read_id long, mate long, strand string, contig_id long, key string, begin long, until long, ref_begin long, ref_end long, covered long, length long, seeds {_SEEDS}"


def tier_of(length, seed_length, k: int):  # noqa: ANN001, ANN201
    """Which of three minima a seed's length reaches: that for its read, k, or the one half way (0 is strictest)."""
    first = F.greatest(seed_length, F.lit(k))
    return F.when(length >= first, 0).when(length >= F.floor((first + k) / 2), 1).otherwise(2)


def strictest(seeds: DataFrame, lengths: DataFrame, p: AlignParams, k: int) -> DataFrame:
    """Seeds (read_id as in ``candidate_regions``) with their read's ``length``: those that reach the minimum for the
    read's length; where neither strand of a mate has any, and ``p.rescue``, those of the next lower minimum."""
    rows = seeds.withColumn("__mate", F.floor(F.col("read_id") / 2)).join(lengths, "__mate")
    n = F.col("length")
    rows = rows.withColumn("__tier", tier_of(F.col("len"), seed_length(n, max_edits(n, p.error_rate), p.error_rate, p.min_seed), k))
    best = F.min("__tier").over(Window.partitionBy("__mate")) if p.rescue else F.lit(0)
    return rows.withColumn("__best", best).where("__tier <= __best").drop("__tier", "__best")


def candidate_regions(
    mates: DataFrame, contigs: DataFrame, p: AlignParams, k: int, dna: bool = True, index: Index | None = None, longest: int | None = None
) -> DataFrame:
    """Regions of mates (read_id, mate 1 or 2, seq): REGION columns. ``begin`` and ``until`` (inclusive) are where
    the read would lie by the region's longest seed; ref_begin and ref_end are bounds of the seeds. A kernel row is
    one strand of a mate with its seeds, at most ``max_seeds`` for each stretch of it."""
    both = S.strands(mates.select("read_id", "mate", "seq"), "seq", p.forward, p.reverse) if dna else mates.select("read_id", "mate", "seq", F.lit("+").alias("strand"))
    number = F.col("read_id") * 4 + (F.col("mate") - 1) * 2 + (F.col("strand") == "-").cast("long")
    signed = both.select(number.alias("read_id"), "seq")
    seed = F.struct(*(F.col(c).cast("long").alias(c) for c in ("contig_id", "qpos", "rpos", "len")))
    lengths = mates.select((F.col("read_id") * 2 + F.col("mate") - 1).alias("__mate"), F.length("seq").cast("long").alias("length"))
    seeds = strictest(seeds_of(signed, contigs, p, k, dna, index, longest), lengths, p, k)
    rows = seeds.groupBy("__mate", "read_id").agg(F.first("length").alias("length"), F.collect_list(seed).alias("seeds")).select("read_id", "length", "seeds")
    schema = StructType.fromDDL(REGION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mate, strand = row["read_id"] % 4 // 2 + 1, "+-"[row["read_id"] % 2]
                seeds = [(s["contig_id"], s["qpos"], s["rpos"], s["len"]) for s in row["seeds"]]
                for contig, i, covered, held in group_regions(seeds, p, row["length"]):
                    q, r, _ = max(held, key=lambda s: (s[2], -s[1], -s[0]))
                    key = f"{mate}{strand}{contig}/{i}"
                    out.append((
                        row["read_id"] // 4, mate, strand, contig, key, r - q, r - q + row["length"] - 1, min(s[1] for s in held),
                        max(s[1] + s[2] for s in held), covered, row["length"], [dict(zip(("qpos", "rpos", "len"), s)) for s in held],
                    ))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def placed_regions(regions: DataFrame, contigs: DataFrame, p: AlignParams, longest: int) -> DataFrame:
    """One row per read: ``regions`` in order (most covered bases first), each with the bases that its
    extension may need. ``longest`` is the length of the longest read."""
    slack = F.floor(F.col("length") * p.error_rate).cast("long") + 3
    reach = F.col("length") + slack
    rows = regions.withColumn("low", F.greatest(F.col("ref_begin") - reach, F.lit(0))).withColumn("high", F.col("ref_end") + reach)
    rows = with_window(rows, contigs, 4 * (longest + p.max_edits(longest) + 3))
    fields = ["mate", "strand", "contig_id", "key", "begin", "until", "covered", "low", "window", "seeds"]
    one = F.struct((-F.col("covered")).alias("order"), *(F.col(c) for c in ("mate", "contig_id", "ref_begin", "strand", "key")), F.struct(*fields).alias("region"))
    return rows.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["region"]).alias("regions"))


def both_strands(mates: DataFrame) -> DataFrame:
    """read_id, plus1, minus1, plus2, minus2 of mates (read_id, mate, seq). A read id stands for one read; where it
    repeats, the query fails when it runs (``raise_error``), since seeds of several reads would be mixed."""
    once = lambda n: F.when(F.count_if(F.col("mate") == n) > 1, F.raise_error(F.lit("a read id repeats")))
    one = lambda n, x: F.coalesce(once(n), F.max(F.when(F.col("mate") == n, x)))
    return mates.groupBy("read_id").agg(*(one(n, x).alias(f"{name}{n}") for n in (1, 2) for name, x in (("plus", F.col("seq")), ("minus", reverse_complement("seq")))))


def extended(rows: DataFrame, p: AlignParams, strategy, reported: int | None = None) -> DataFrame:
    """Alignments of rows (read_id, plus and minus of both mates, regions, ...): ``mate`` and the ALIGNED columns.
    ``strategy(mates, regions, row)`` fills the mates' alignments. Only the ``reported`` best of a mate (None: all)
    are traced; the others have null nm and x0."""
    schema = StructType.fromDDL(f"mate long, {ALIGNED}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mates = {n: Mate(row[f"plus{n}"] or "", row[f"minus{n}"] or "", p) for n in (1, 2)}
                strategy(mates, row["regions"], row)
                for n, mate in mates.items():
                    for rank, x in enumerate(sorted(mate.found, key=lambda x: (-x.score, x.contig, x.start, x.strand))):
                        nm = clips = None
                        if reported is None or rank < reported:
                            cigar = traced(mate.text[x.strand], x.window, x.pieces, p)
                            nm = K.edits(cigar)
                            clips = (f"{x.q_start}S" if x.q_start else "") + cigar + (f"{mate.length - x.q_end}S" if x.q_end < mate.length else "")
                        out.append((n, row["read_id"], x.strand, x.contig, x.start, x.end, x.q_start, x.q_end, x.score, nm, clips))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def longest_read(reads: DataFrame) -> int:
    return reads.select(F.max(F.length("seq")).alias("n")).first()["n"] or 0


def alignments(
    reads: DataFrame, contigs: DataFrame, p: AlignParams, k: int, dna: bool = True, index: Index | None = None, reported: int | None = None
) -> DataFrame:
    """All alignments of reads (read_id, seq) to contigs (contig_id, seq). A kernel row is one read with its
    regions on both strands of all contigs, each with the piece of reference around it. Reads that stay without
    an alignment are tried once more (``p.rescue``): regions for twice the error rate, a fifth of the bases may differ."""
    mates = reads.select(F.col("read_id").cast("long").alias("read_id"), F.lit(1).alias("mate"), "seq")
    longest = longest_read(reads)

    def found(mates: DataFrame, regions_by: AlignParams, strategy) -> DataFrame:
        regions = candidate_regions(mates, contigs, regions_by, k, dna, index, longest)
        rows = placed_regions(regions, contigs, regions_by, longest).join(both_strands(mates), "read_id")
        return extended(rows, p, strategy, reported).drop("mate")

    out = found(mates, p, lambda mates, regions, _: walk_alone(mates, regions, 1, p))
    if not p.rescue or p.local:
        return out
    out = written(out, "alignments")
    missed = written(mates.join(out.select("read_id").distinct(), "read_id", "left_anti"), "missed")
    if not missed.limit(1).count():
        return out
    return out.unionByName(found(missed, replace(p, error_rate=2 * p.error_rate), lambda mates, regions, _: walk_again(mates, regions, 1, p)))


def triage(seeds: list[tuple[int, int, int, int]], p: AlignParams) -> tuple[list, list]:
    """(chosen, reserves) of a strand's seeds (contig, q, r, len): chosen ones make regions, reserves only fill them.
    Seeds of one stretch of the read go together. A stretch is chosen if it ends beyond the one before and has at most
    ``max_seeds`` places, or if it is long and with those before it that share its ends has at most ``max_mems``."""
    chosen: list = []
    reserves: list = []
    before, running = -1, 0
    for (q, n), group in groupby(sorted(seeds, key=lambda s: (s[1], -s[3])), key=lambda s: (s[1], s[3])):
        group = list(group)
        fresh = q + n > before
        running = len(group) if fresh else running + len(group)
        good = fresh and running <= p.max_seeds or running <= p.max_mems and n >= p.min_mem_length
        (chosen if good else reserves).extend(group)
        before = q + n
    return chosen, reserves


def grown(seeds: list[tuple[int, int, int]], edits: int, length: int) -> list[list]:
    """Regions [first place, last place, seeds] of one contig's chosen seeds (q, r, len). From its first seed a region
    grows as long as seeds end where the read would, placed by the longest one so far; that one's placement also
    tells which earlier seeds belong to it. Regions that overlap are one."""
    seeds = sorted(seeds, key=lambda s: (s[1], s[0]))
    out: list[list] = []
    at = 0
    while at < len(seeds):
        longest, end = seeds[at], at + 1
        high = longest[1] - longest[0] + length + edits
        while end < len(seeds) and seeds[end][1] + seeds[end][2] <= high:
            if seeds[end][2] > longest[2]:
                longest = seeds[end]
                high = longest[1] - longest[0] + length + edits
            end += 1
        low = longest[1] - longest[0] - edits
        if out and out[-1][1] >= low:
            out[-1][0], out[-1][1] = min(out[-1][0], low), max(out[-1][1], high)
            out[-1][2] += seeds[at:end]
        else:
            first = at
            while first and seeds[first - 1][1] >= low:
                first -= 1
            out.append([low, high, seeds[first:end]])
        at = end
    return out


def group_regions(seeds: list[tuple[int, int, int, int]], p: AlignParams, length: int) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(contig, number, covered read bases, seeds (q, r, len)) of the regions of a strand's seeds (contig, q, r, len)."""
    chosen, reserves = triage(seeds, p)
    regions: dict[int, list[list]] = {}
    for contig in sorted({s[0] for s in chosen}):
        regions[contig] = grown([s[1:] for s in chosen if s[0] == contig], p.max_edits(length), length)
    for contig, q, r, n in reserves:
        here = regions.get(contig, [])
        at = bisect_left(here, r, key=lambda x: x[1])
        if at < len(here) and here[at][0] <= r:
            here[at][2].append((q, r, n))

    def covered(region: list[tuple[int, int, int]]) -> int:
        total = top = 0
        for q, _, n in sorted(region):
            total += max(0, q + n - max(q, top))
            top = max(top, q + n)
        return total

    return [(contig, i, covered(held), held) for contig, here in regions.items() for i, (_, _, held) in enumerate(here)]


def full_dp(rows: DataFrame, reads: DataFrame, contigs: DataFrame, p: AlignParams) -> DataFrame:
    """The max(4, report) best alignments of each read, aligned anew from end to end of their stretch: a new
    score, nm and x0 in place of those of the chain."""
    best = top_k(rows, max(4, p.report), ["contig_id", "start", "strand"]).drop("rank")
    both = S.strands(reads.select(F.col("read_id").cast("long").alias("read_id"), "seq"))
    longest = longest_read(reads)
    cut = with_window(best.withColumn("low", F.col("start")).withColumn("high", F.col("end")), contigs, 4 * (longest + p.max_edits(longest) + 3))
    whole = cut.join(both, ["read_id", "strand"])
    piece = whole.withColumn("a", F.expr("substring(seq, cast(q_start as int) + 1, cast(q_end - q_start as int))")).withColumn("b", F.col("window"))
    left = piece.select("read_id", "strand", "contig_id", "start", "end", "q_start", "q_end", (F.length("seq") - F.col("q_end")).alias("__rest"), "a", "b")
    done = trace_rows(left, p.match, p.mismatch, -p.gap_open, -p.gap_extend)
    clips = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise(F.lit(""))
    return done.select(
        "read_id", "strand", "contig_id", "start", "end", "q_start", "q_end", "score", cigar_length("x0", "XID").cast("long").alias("nm"),
        F.concat(clips(F.col("q_start")), "x0", clips(F.col("__rest"))).alias("x0"),
    )


def align(reads: DataFrame, contigs: DataFrame, p: AlignParams, k: int = 20, dna: bool = True, index: Index | None = None) -> DataFrame:
    """SAM-like rows of the best ``p.report`` alignments of each read, and one unmapped row where none is. ``k`` is the
    shortest seed; ``index`` a stored index of the contigs, in place of their k-mers."""
    order = ["contig_id", "start", "strand"]
    found = alignments(reads, contigs, p, k if index is None else index.k, dna, index, 0 if p.full_dp else p.report)
    if p.full_dp:
        found = full_dp(found, reads, contigs, p)
    rows = found.join(reads.select("read_id", F.length("seq").alias("__l")), "read_id")
    rows = with_mapq(rows, "__l", p.mismatch, order).where(F.col("rank") <= p.report)
    flag = F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.col("secondary"), 256).otherwise(0)
    rows = rows.select(
        "read_id", flag.cast("long").alias("flag"), "contig_id", (F.col("start") + 1).alias("pos"), "mapq", collapse_cigar("x0").alias("cigar"), "score", "nm", "x0", "rank"
    )
    return with_unmapped(reads.select("read_id"), rows)


def window_rescue(windows: DataFrame, p: AlignParams) -> DataFrame:
    """Local alignment of each mate (seq) inside its window (ref): adds score, q_start, q_end, r_start, r_end, x0."""
    added = "score long, q_start long, q_end long, r_start long, r_end long, x0 string"
    schema = StructType([*windows.schema.fields, *StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, r = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seq", "ref"))
            got = [K.align_local(a or "", b or "", p.match, p.mismatch, -p.gap_open, -p.gap_extend) for a, b in zip(q, r)]
            columns = list(zip(*got)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string() if i == 5 else pa.int64()) for i, c in enumerate(columns))], names=schema.names)

    return windows.mapInArrow(run, schema)


def trace_rows(pairs: DataFrame, match=1, mismatch=-4, opening=6, extend=1) -> DataFrame:
    """Global alignment of columns a and b: adds score and x0."""
    schema = StructType([*pairs.schema.fields, *StructType.fromDDL("score long, x0 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
            got = [K.align_global(x or "", y or "", match, mismatch, opening, extend) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in got], pa.int64()), pa.array([c for _, c in got], pa.string())], names=schema.names)

    return pairs.mapInArrow(run, schema)


def kernel_rows(pairs: DataFrame, kernel, added: str) -> DataFrame:
    """Columns a and b of each row through ``kernel(a, b)``, whose values are the columns ``added``."""
    schema = StructType([*pairs.schema.fields, *StructType.fromDDL(added).fields])
    kinds = to_arrow_schema(StructType.fromDDL(added)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
            got = list(zip(*(kernel(x or "", y or "") for x, y in zip(a, b)))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(got, kinds))], names=schema.names)

    return pairs.mapInArrow(run, schema)


def walked(cigar: str, seq: str, reference: str) -> tuple[int, str]:
    """(edits, CIGAR with = and X) of an alignment with M, I, D, N, S, H, P, = and X; ``reference`` begins where it
    does. Letters are compared whatever their case; a base beyond the reference's end is a mismatch."""
    import re

    edits, q, r, out = 0, 0, 0, []
    a, b = seq.lower(), reference.lower()
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            for i in range(n):
                same = r + i < len(b) and q + i < len(a) and a[q + i] == b[r + i]
                edits += not same
                out.append("=" if same else "X")
            q, r = q + n, r + n
            continue
        out += [op] * n
        edits += n if op in "ID" else 0
        q += n if op in "IS" else 0
        r += n if op in "DN" else 0
    return edits, K.rle(out)


def walk_cigars(sam: DataFrame, contigs: DataFrame, longest: int) -> DataFrame:
    """``sam`` (contig_id, pos from 1, cigar, seq) plus edits and x0, from the sequences alone: for rows without an
    edit tag. ``longest``: bases of the reference that a row spans at most."""
    span = F.greatest(reference_span("cigar"), F.lit(0))
    rows = with_window(sam.withColumn("low", F.col("pos") - 1).withColumn("high", F.col("pos") - 1 + span), contigs, longest)
    names = sam.columns
    schema = StructType([*sam.schema.fields, *StructType.fromDDL("edits long, x0 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            got = [walked(c or "", s or "", w or "") for c, s, w in zip(*(column(c).to_pylist() for c in ("cigar", "seq", "window")))]
            new = [pa.array([e for e, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in names), *new], names=schema.names)

    return rows.select(*names, "window").mapInArrow(run, schema)


def pair_best(one: DataFrame) -> DataFrame:
    """Best alignment of each read by score, contig, start, strand."""
    w = Window.partitionBy("read_id").orderBy(F.desc("score"), "contig_id", "start", "strand")
    return one.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
