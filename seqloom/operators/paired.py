"""Mapping of read pairs. The modes differ in which regions are extended and in what order; which alignments make
a pair is for the rules of concordance alone, whatever the mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import clip, collapse_cigar, mapq, template_length
from ..params import AlignParams, PairParams
from ..sources.tables import written
from . import pairing as P
from .align import both_strands, candidate_regions, extended, longest_read, placed_regions, walk, walk_again, walk_alone, window_rescue
from .reference import with_window

#: Errors that a mate may have, as a multiple of the usual, where its region fits one of the other mate.
RELAXED = 1.5


def region_pairs(regions: DataFrame, p: AlignParams, pair: PairParams) -> DataFrame:
    """read_id, a_key, b_key, covered (of both): regions of both mates that may hold a concordant pair."""
    edits = F.floor(F.col("length") * p.error_rate) + 1
    side = regions.select("read_id", "mate", F.col("contig_id").alias("contig"), "key", "begin", "until", (F.col("strand") == "-").alias("reverse"), edits.alias("edits"), "covered")
    one, two = (side.where(F.col("mate") == n).drop("mate") for n in (1, 2))
    rename = lambda df, x: df.select("read_id", *(F.col(c).alias(x + c) for c in df.columns if c != "read_id"))
    a, b = rename(one, "a_"), rename(two, "b_")
    met = a.join(b, (a["read_id"] == b["read_id"]) & (F.col("a_contig") == F.col("b_contig"))).drop(b["read_id"])
    return met.where(P.concordant_regions(pair)).select("read_id", "a_key", "b_key", (F.col("a_covered") + F.col("b_covered")).alias("covered"))


def _apart(mates, regions, row, p: AlignParams) -> None:
    for n in (1, 2):
        walk_alone(mates, regions, n, p)


def _fitting(mates, regions, row, p: AlignParams) -> None:
    """Mode 3: only regions that fit one of the other mate; pairs without such regions as in mode 1."""
    if not row["couples"]:
        return _apart(mates, regions, row, p)
    keys = {k for c in row["couples"] for k in (c["a_key"], c["b_key"])}
    kept = [r for r in regions if r["key"] in keys]
    for n, mate in mates.items():
        walk({n: mate}, [r for r in kept if r["mate"] == n], p, {n: mate.least_with(RELAXED * mate.edits)}, {n: 0}, max(p.report, p.max_alignments))
        if not mate.found and p.rescue:
            walk_again(mates, kept, n, p)


def _rescue_one(mates, regions, p: AlignParams) -> None:
    """A mate without any alignment gets a laxer walk if the other has one."""
    for n, other in ((1, 2), (2, 1)):
        if not mates[n].found and mates[other].found and p.rescue:
            walk_again(mates, regions, n, p)


def _merged(mates, regions, row, p: AlignParams) -> None:
    """Mode 4: the regions of both mates in one order."""
    walk(mates, regions, p, {n: m.least for n, m in mates.items()}, {n: m.coverage for n, m in mates.items()}, max(p.report, p.max_alignments))
    _rescue_one(mates, regions, p)


def mate_place(start: int, end: int, reverse: bool, length: int, second: bool, p: PairParams) -> tuple[bool, int, int]:
    """``pairing.mate_window`` for one alignment (end inclusive)."""
    at = end if reverse else start
    if p.orientation.value == "ff":
        right, wanted = (not reverse) != second, reverse
    else:
        right, wanted = (reverse if p.orientation.value == "rf" else not reverse), not reverse
    low = (at + p.min_insert if right else at - p.max_insert) - (length if wanted else 0)
    high = (at + p.max_insert if right else at - p.min_insert) + (0 if wanted else length)
    if not p.overlap:
        low, high = (max(low, end), high) if right else (low, min(high, start))
    elif not p.dovetail:
        low, high = (max(low, start), high) if right else (low, min(high, end))
    return wanted, max(low, 0), high


def _at_once(mates, regions, row, p: AlignParams, pair: PairParams) -> None:
    """Mode 5: after every extension the place of the mate is searched: an alignment there will do, else
    the most covered region there is extended."""
    done: set[str] = set()

    def then(number: int, new: list) -> None:
        other = 3 - number
        mate = mates[other]
        for a in new:
            wanted, low, high = mate_place(a.start, a.end - 1, a.strand == "-", mate.length, number == 2, pair)
            strand = "-" if wanted else "+"
            if any(x.contig == a.contig and x.strand == strand and x.start >= low and x.end - 1 <= high for x in mate.found):
                continue
            fits = (
                r for r in regions
                if r["mate"] == other and r["contig_id"] == a.contig and r["strand"] == strand and r["key"] not in done
                and r["begin"] + mate.edits >= low and r["until"] - mate.edits <= high
            )
            best = next(fits, None)
            if best is not None and mate.extend(best, mate.least, int(0.01 * mate.length)) >= 0:
                done.add(best["key"])

    walk(mates, regions, p, {n: m.least for n, m in mates.items()}, {n: m.coverage for n, m in mates.items()}, max(p.report, p.max_alignments), done, then)
    _rescue_one(mates, regions, p)


def _couples(mates, regions, row, p: AlignParams) -> None:
    """Mode 6: fitting regions of both mates together, by the bases that they cover in sum."""
    if not row["couples"]:
        return _apart(mates, regions, row, p)
    by_key, failures, top = {r["key"]: r for r in regions}, 0, 0
    least = {n: m.least_with(RELAXED * m.edits) for n, m in mates.items()}
    limit, tried = max(p.report, p.max_alignments), {}
    for c in sorted(row["couples"], key=lambda c: (-c["covered"], c["a_key"], c["b_key"])):
        if failures >= p.max_failures or min(len(m.found) for m in mates.values()) >= limit:
            break
        keys, best = {1: c["a_key"], 2: c["b_key"]}, {}
        for n, mate in mates.items():
            # a region in several couples is extended once
            if keys[n] not in tried:
                tried[keys[n]] = mate.extend(by_key[keys[n]], least[n], 0)
            best[n] = tried[keys[n]]
        for n, other in ((1, 2), (2, 1)):
            if best[n] < 0 <= best[other] and p.rescue:
                best[n] = tried[keys[n]] = mates[n].extend(by_key[keys[n]], mates[n].least_with(0.2 * mates[n].length), 0)
        score = best[1] + best[2]
        failures = 0 if min(best.values()) >= 0 and (p.reset_failures or score > top) else failures + 1
        top = max(top, score)


def mate_alignments(mates: DataFrame, contigs: DataFrame, p: AlignParams, pair: PairParams, k: int) -> DataFrame:
    """``mate`` and the ALIGNED columns for mates (read_id, mate 1 or 2, seq); modes other than 1 to 6 count as 1.
    Mode 2 aligns like mode 1 here: its search of windows comes with the pairing."""
    regions = written(candidate_regions(mates, contigs, p, k), "regions")
    rows = placed_regions(regions, contigs, p, longest_read(mates)).join(both_strands(mates), "read_id")
    if pair.mode in (3, 6):
        couples = region_pairs(regions, p, pair).groupBy("read_id").agg(F.collect_list(F.struct("a_key", "b_key", "covered")).alias("couples"))
        rows = rows.join(couples, "read_id", "left")
    if pair.mode == 5:
        return extended(rows, p, lambda m, r, row: _at_once(m, r, row, p, pair))
    strategy = {3: _fitting, 4: _merged, 6: _couples}.get(pair.mode, _apart)
    return extended(rows, p, lambda m, r, row: strategy(m, r, row, p))


def _side(found: DataFrame, mate: int) -> DataFrame:
    return found.where(F.col("mate") == mate).select(
        "read_id", F.col("contig_id").alias("contig"), "start", (F.col("end") - 1).alias("end"), (F.col("strand") == "-").alias("reverse"),
        "q_start", "q_end", "score", "nm", "x0",
    )


def windowed_mates(alone: DataFrame, mates: DataFrame, contigs: DataFrame, p: AlignParams, pair: PairParams) -> DataFrame:
    """Mates of alignments (``mate`` and ALIGNED) by local alignment where they should lie; ``mate`` is theirs.
    All of a read's alignments are tried, or the first ``window_tries`` by score where that is set."""
    tried = alone
    if pair.window_tries is not None:
        order = Window.partitionBy("read_id", "mate").orderBy(F.desc("score"), "contig_id", "start", "strand")
        tried = alone.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= pair.window_tries).drop("__n")
    other = both_strands(mates).select(
        "read_id", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("wm"), F.col(f"plus{n}").alias("wp"), F.col(f"minus{n}").alias("wr")) for n in (1, 2)))).alias("w")
    )
    rows = tried.join(other.select("read_id", "w.*"), "read_id").where("wm <> mate and wp is not null")
    c = F.col
    wanted, low, high = P.mate_window(c("start"), c("end") - 1, c("strand") == "-", F.length("wp"), c("mate") == 2, pair)
    rows = rows.select("read_id", c("wm").alias("mate"), "contig_id", F.when(wanted, "-").otherwise("+").alias("strand"), low.alias("low"), (high + 1).alias("high"), F.when(wanted, c("wr")).otherwise(c("wp")).alias("seq"))
    longest = longest_read(mates)
    rows = with_window(rows.where("high > low").distinct(), contigs, 2 * longest + pair.max_insert + p.max_edits(longest) + 3)
    local = window_rescue(rows.withColumn("ref", F.col("window")).drop("window"), p).withColumnRenamed("score", "got")
    edits = F.floor(F.length("seq") * p.error_rate) + 1
    least = (F.length("seq") * p.match + edits * (p.mismatch - p.match)).cast("long")
    kept = local.where((F.col("got") > F.greatest(least, F.lit(0))))
    clipped = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise(F.lit(""))
    gaps = F.aggregate(F.regexp_extract_all("x0", F.lit(r"(\d+)[XID]"), 1), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    return kept.select(
        "mate", "read_id", "strand", "contig_id", (c("low") + c("r_start")).alias("start"), (c("low") + c("r_end")).alias("end"), "q_start", "q_end",
        c("got").alias("score"), gaps.alias("nm"), F.concat(clipped(c("q_start")), "x0", clipped(F.length("seq") - c("q_end"))).alias("x0"),
    )


def _short_of_pairs(found: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """Alignments of reads with fewer than ``most`` pairs that are in no pair themselves."""
    enough = pairs.groupBy("read_id").count().where(F.col("count") >= most).select("read_id")
    used = [pairs.select("read_id", F.lit(n).cast("long").alias("mate"), F.col(f"{x}_contig").alias("contig_id"), F.col(f"{x}_start").alias("start"), F.when(F.col(f"{x}_reverse"), "-").otherwise("+").alias("strand")) for n, x in ((1, "a"), (2, "b"))]
    free = found.join(enough, "read_id", "left_anti")
    return free.join(used[0].unionByName(used[1]).distinct(), ["read_id", "mate", "contig_id", "start", "strand"], "left_anti")


def with_windows(found: DataFrame, mates: DataFrame, contigs: DataFrame, p: AlignParams, pair: PairParams) -> DataFrame:
    """``found`` and, in mode 2 or with ``pair.rescue``, the mates found in windows. Alignments of one place
    count once, the best-scoring first."""
    if pair.mode != 2 and not pair.rescue:
        return found
    pairs = P.concordant_pairs(_side(found, 1), _side(found, 2), pair)
    more = windowed_mates(_short_of_pairs(found, pairs, p.report + 1), mates, contigs, p, pair)
    one = Window.partitionBy("read_id", "mate", "contig_id", "strand", "start").orderBy(F.desc("score"), "end", "x0")
    return written(found.unionByName(more).withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n"), "alignments")


def pairs_of(found: DataFrame, p: AlignParams, pair: PairParams) -> DataFrame:
    """The best ``report`` pairs of each read: a_ and b_ columns, concordant, score (sum), rank, mapq, secondary.
    Discordant ones come only where a read has no concordant one. Quality compares the best two sums."""
    one, two = _side(found, 1), _side(found, 2)
    good = P.concordant_pairs(one, two, pair)
    rows = good.withColumn("concordant", F.lit(True))
    if pair.discordant:
        rows = rows.unionByName(P.discordant_pairs(one, two, good).withColumn("concordant", F.lit(False)))
    rows = rows.withColumn("score", F.col("a_score") + F.col("b_score"))
    place = Window.partitionBy("read_id").orderBy(F.desc("score"), *(f"{x}_{c}" for x in "ab" for c in ("contig", "start", "reverse")))
    whole = Window.partitionBy("read_id")
    rows = rows.withColumn("rank", F.row_number().over(place).cast("long")).withColumn("__best", F.max("score").over(whole))
    rows = rows.withColumn("__second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(whole))
    length = F.col("a_q_end") + clip(F.col("a_x0"), True)
    top = F.col("score") == F.col("__best")
    quality = F.max(mapq(F.col("__best"), F.col("__second"), length * p.mismatch)).over(whole)
    rows = rows.withColumn("mapq", F.when(top, quality).otherwise(0).cast("long")).withColumn("secondary", ~top)
    return rows.where(F.col("rank") <= p.report).drop("__best", "__second")


def _bits(**bits: Column) -> Column:
    values = {"reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "secondary": 256}
    return sum((F.when(on, values[name]).otherwise(0) for name, on in bits.items()), F.lit(1)).cast("long")


PAIRED = ["read_id", "mate", "flag", "contig_id", "pos", "mapq", "cigar", "mate_contig_id", "mate_pos", "tlen", "score", "nm", "x0", "rank"]


def align_pairs(mates1: DataFrame, mates2: DataFrame, contigs: DataFrame, p: AlignParams, pair: PairParams, k: int = 20) -> DataFrame:
    """SAM-like rows (PAIRED) of read pairs (read_id, seq): two rows for every pair reported; where a read has none, its
    mates' best alignments (``pair.mixed``) or unmapped rows. A mate without any alignment has an unmapped row."""
    each = [df.select(F.col("read_id").cast("long").alias("read_id"), F.lit(n).cast("long").alias("mate"), "seq") for n, df in ((1, mates1), (2, mates2))]
    mates = each[0].unionByName(each[1])
    found = written(mate_alignments(mates, contigs, p, pair, k), "alignments")
    found = with_windows(found, mates, contigs, p, pair)
    pairs, c = written(pairs_of(found, p, pair), "pairs"), F.col

    def half(x: str, y: str, n: int) -> DataFrame:
        flag = _bits(proper=c("concordant"), reverse=c(f"{x}_reverse"), mate_reverse=c(f"{y}_reverse"), first=F.lit(n == 1), second=F.lit(n == 2), secondary=c("secondary"))
        span = template_length(*(c(f"{z}_{e}") for z in (x, y) for e in ("start", "end")), c(f"{x}_reverse"), c(f"{y}_reverse"))
        return pairs.select(
            "read_id", F.lit(n).cast("long").alias("mate"), flag.alias("flag"), c(f"{x}_contig").alias("contig_id"), (c(f"{x}_start") + 1).alias("pos"), "mapq",
            collapse_cigar(f"{x}_x0").alias("cigar"), c(f"{y}_contig").alias("mate_contig_id"), (c(f"{y}_start") + 1).alias("mate_pos"),
            F.when(c(f"{x}_contig") == c(f"{y}_contig"), span).otherwise(0).cast("long").alias("tlen"), c(f"{x}_score").alias("score"), c(f"{x}_nm").alias("nm"), c(f"{x}_x0").alias("x0"), "rank",
        )

    rows = half("a", "b", 1).unionByName(half("b", "a", 2))
    # mates of reads without a pair: every one has rows, be they of alignments or of none
    rest = mates.select("read_id", "mate", F.length("seq").alias("__l")).join(pairs.select("read_id").distinct(), "read_id", "left_anti")
    alone = found if pair.mixed else found.where(F.lit(False))
    whole, place = Window.partitionBy("read_id", "mate"), Window.partitionBy("read_id", "mate").orderBy(F.desc("score"), "contig_id", "start", "strand")
    alone = rest.join(alone, ["read_id", "mate"], "left").withColumn("rank", F.row_number().over(place).cast("long"))
    alone = alone.withColumn("__best", F.max("score").over(whole)).withColumn("__second", F.max(F.when(c("rank") == 2, c("score"))).over(whole))
    has = Window.partitionBy("read_id")
    alone = alone.withColumn("__mapped", F.collect_set(F.when(c("contig_id").isNotNull(), c("mate"))).over(has)).where(c("rank") <= p.report)
    missing, top = c("contig_id").isNull(), c("score") == c("__best")
    flag = _bits(
        unmapped=missing, mate_unmapped=~F.array_contains("__mapped", F.lit(3).cast("long") - c("mate")), reverse=F.coalesce(c("strand") == "-", F.lit(False)),
        first=c("mate") == 1, second=c("mate") == 2, secondary=F.coalesce(~top, F.lit(False)),
    )
    quality = F.when(top, mapq(c("__best"), c("__second"), c("__l") * p.mismatch)).otherwise(0).cast("long")
    none = F.lit(None).cast("long")
    alone = alone.select(
        "read_id", "mate", flag.alias("flag"), "contig_id", (c("start") + 1).alias("pos"), quality.alias("mapq"), F.when(~missing, collapse_cigar("x0")).alias("cigar"),
        none.alias("mate_contig_id"), none.alias("mate_pos"), F.lit(0).cast("long").alias("tlen"), "score", "nm", "x0", F.when(~missing, c("rank")).alias("rank"),
    )
    return rows.select(*PAIRED).unionByName(alone.select(*PAIRED))
