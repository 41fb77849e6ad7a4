"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a pseudo-random order, are cut into blocks of equal size (the last may be
shorter). One slot holds one block. Block i of a source with target weight w is released at slot
floor(i / w) and due at slot ceil((i + 1) / w); earliest deadline first over released blocks keeps
every source, at every slot, within less than one block of its target (all weights sum to 1, so
every block meets its window). When a slot stays idle because a source has no blocks left, its weight
goes and the same schedule starts anew over the remaining sources: no document is dropped or repeated.

Weights are whole numbers of units, so the schedule of a set of sources repeats after as many slots as
there are units, and the driver works out one such period and what remains after the last whole one,
whatever the number of blocks; a block's slot in a whole period follows from its number. The block size
is thus the one asked for at every input size. Targets whose common denominator is above MOST_UNITS
are rounded to that many units, each by less than one.

Ranks inside a source come from counts of hash ranges, in two levels, plus a window inside each range,
so a hot source never meets in one task. Sources are expected to be named, bounded in number
(MOST_SOURCES); each that is used up starts a new schedule.

Defined results: a null source counts as the source ''; null ids and repeated rows are rows like others
(those that are equal in all columns without maps may trade places); an empty table gives no rows; a
target for an absent source is ignored, a present source without a target gets no weight and follows
after all others, in its own schedule with equal weights. Columns of any names pass through; an added
column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .common import boxed, quoted, read, unboxed

BLOCK_ROWS, MOST_UNITS, MOST_SOURCES = 64, 2**14, 10_000
#: Rows that are expected to share a hash range of a source, ranges that share a coarse one (as bits), table rows to broadcast.
RANGE_ROWS, COARSE_BITS, MOST_BROADCAST = 512, 10, 500_000
ADDED = ["mix_source", "mix_block", "mix_slot", "mix_position"]


def default_targets(counts: dict[str, int]) -> dict[str, Fraction]:
    """Target weights that flatten the sources' shares: proportional to the root of their rows."""
    roots = {s: math.isqrt(n * 10_000) for s, n in counts.items()}
    total = sum(roots.values())
    return units({s: Fraction(r, total) for s, r in roots.items()})


def units(targets: dict[str, Fraction]) -> dict[str, Fraction]:
    """The targets as whole numbers of units: exactly where at most MOST_UNITS (or four a source) do, else
    rounded to that sum, the largest remainders up and no positive target to nothing."""
    targets = {s: Fraction(w) for s, w in targets.items() if w > 0}
    total = sum(targets.values())
    shares = {s: w / total for s, w in targets.items()}
    most = max(MOST_UNITS, 4 * len(shares))
    if math.lcm(*(w.denominator for w in shares.values())) <= most:
        whole = math.lcm(*(w.denominator for w in shares.values()))
        return {s: w * whole for s, w in shares.items()}
    out = {s: max(1, math.floor(w * most)) for s, w in shares.items()}
    left = most - sum(out.values())
    for s in sorted(shares, key=lambda s: (math.floor(shares[s] * most) - shares[s] * most, s)):
        if left <= 0:
            break
        out[s], left = out[s] + 1, left - 1
    return {s: Fraction(u) for s, u in out.items()}


def _simulated(blocks: dict[str, int], share: dict[str, Fraction], slots: int | None) -> list[str]:
    """The sources by slot, earliest deadline first, until a slot stays idle or ``slots`` are filled."""
    out: list[str] = []
    done = dict.fromkeys(share, 0)
    waiting = [(0, s) for s in share if blocks[s]]  # release slot, source
    ready: list[tuple[int, str]] = []  # deadline, source
    heapq.heapify(waiting)
    while slots is None or len(out) < slots:
        while waiting and waiting[0][0] <= len(out):
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((done[s] + 1) / share[s]), s))
        if not ready:
            break
        _, s = heapq.heappop(ready)
        out.append(s)
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (math.floor(done[s] / share[s]), s))
    return out


def phases(blocks: dict[str, int], targets: dict[str, Fraction]) -> list[tuple[int, list[str]]]:
    """(times, sources by slot) in order: a list of slots that is run through so many times. Each source's last
    block is in a list that runs once."""
    targets = units({s: targets.get(s, 0) for s in blocks}) if any(targets.get(s, 0) for s in blocks) else {}
    left = dict(blocks)
    out: list[tuple[int, list[str]]] = []
    while any(left.values()):
        live = [s for s in sorted(left) if left[s]]
        weights = {s: targets[s] for s in live if s in targets} or dict.fromkeys(live, Fraction(1))
        total = sum(weights.values())
        share = {s: w / total for s, w in weights.items()}
        period = math.lcm(*(w.denominator for w in share.values()))
        times = min((left[s] - 1) // int(share[s] * period) for s in share)
        if times > 1:
            out.append((times, _simulated(left, share, period)))
            for s in share:
                left[s] -= times * int(share[s] * period)
        rest = _simulated(left, share, None)
        out.append((1, rest))
        for s in rest:
            left[s] -= 1
    return out


def schedule(blocks: dict[str, int], targets: dict[str, Fraction]) -> list[tuple[str, int]]:
    """(source, block) by slot, written out."""
    done = dict.fromkeys(blocks, 0)
    out = []
    for times, slots in phases(blocks, targets):
        for s in slots * times:
            out.append((s, done[s]))
            done[s] += 1
    return out


def _tables(counts: dict[str, int], targets: dict[str, Fraction], size: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The schedule as two tables: stretches of a source's blocks (source, low, high, stretch, per: blocks in one run
    of the stretch's slots, width: slots of one run, slot and start: where it begins), and the places inside one run
    (source, stretch, nth, offset of the slot, skipped: rows that shorter last blocks before it lack)."""
    blocks = {s: -(-n // size) for s, n in counts.items()}
    lack = {s: blocks[s] * size - n for s, n in counts.items()}
    done = dict.fromkeys(blocks, 0)
    stretches, places = [], []
    slot = start = 0
    for number, (times, slots) in enumerate(phases(blocks, targets)):
        seen: dict[str, int] = {}
        skipped = 0
        for offset, s in enumerate(slots):
            nth = seen.get(s, 0)
            seen[s] = nth + 1
            places.append((s, number, nth, offset, skipped))
            if times == 1 and done[s] + nth + 1 == blocks[s]:
                skipped += lack[s]
        for s, per in seen.items():
            stretches.append((s, done[s], done[s] + per * times, number, per, len(slots), slot, start))
            done[s] += per * times
        slot += times * len(slots)
        start += times * len(slots) * size - skipped
    columns = ["mix_source", "low", "high", "stretch", "per", "width", "slot", "start"], ["mix_source", "stretch", "nth", "offset", "skipped"]
    return pd.DataFrame(stretches, columns=columns[0]), pd.DataFrame(places, columns=columns[1])


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, StructType) or all(_hashable(f.dataType) for f in kind.fields)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast a table whose number of rows is known to be small."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def positioned(docs: DataFrame, targets: dict[str, Fraction] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``box`` (the columns of ``docs``) and the ADDED columns."""
    spark = docs.sparkSession
    tie = F.xxhash64(*(F.col(quoted(f.name)) for f in docs.schema.fields if _hashable(f.dataType)))
    rows = boxed(docs, mix_source=F.coalesce(F.col("source").cast("string"), F.lit("")), id=F.col("doc_id"), tie=tie)
    rows = rows.withColumn("h", F.when(F.col("id").isNull(), F.xxhash64(F.lit("mix"), F.lit(0), "tie")).otherwise(F.xxhash64(F.lit("mix"), F.col("id"))))
    counts = {r[0]: r[1] for r in rows.groupBy("mix_source").count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(counts.values())
    stretches, places = _tables(counts, default_targets(counts) if targets is None and counts else targets or {}, block_rows)
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE_ROWS))))
    rows = rows.withColumn("r", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    ranges = rows.groupBy("mix_source", "r").count().withColumn("c", F.shiftright("r", COARSE_BITS))
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = ranges.groupBy("mix_source", "c").agg(F.sum("count").alias("count"))
    coarse = coarse.select("mix_source", "c", before(Window.partitionBy("mix_source").orderBy("c")).alias("far"))
    ranges = ranges.withColumn("near", before(Window.partitionBy("mix_source", "c").orderBy("r")))
    ranges = ranges.join(coarse, ["mix_source", "c"]).select("mix_source", "r", (F.col("far") + F.col("near")).alias("before"))
    unsigned = F.col("h").bitwiseXOR(F.lit(-(2**63)))  # the order of the ranges
    inside = Window.partitionBy("mix_source", "r").orderBy(unsigned, "id", "tie")
    rows = rows.withColumn("n", F.row_number().over(inside) - 1)
    rows = rows.join(_small(ranges, len(counts) << bits), ["mix_source", "r"])
    rows = rows.withColumn("rank", F.col("before") + F.col("n")).withColumn("mix_block", F.expr(f"rank div {block_rows}"))
    kinds = "mix_source string, low long, high long, stretch long, per long, width long, slot long, start long"
    found = _small(spark.createDataFrame(stretches, kinds), len(stretches)).withColumnRenamed("mix_source", "s")
    rows = rows.join(found, (F.col("mix_source") == F.col("s")) & (F.col("mix_block") >= F.col("low")) & (F.col("mix_block") < F.col("high"))).drop("s")
    rows = rows.withColumn("nth", (F.col("mix_block") - F.col("low")) % F.col("per")).withColumn("run", F.expr("(mix_block - low) div per"))
    rows = rows.join(_small(spark.createDataFrame(places, "mix_source string, stretch long, nth long, offset long, skipped long"), len(places)), ["mix_source", "stretch", "nth"])
    slots = F.col("run") * F.col("width") + F.col("offset")
    rows = rows.withColumn("mix_slot", F.col("slot") + slots)
    rows = rows.withColumn("mix_position", F.col("start") + slots * block_rows - F.col("skipped") + F.col("rank") % block_rows)
    return rows.select("box", *ADDED)


def with_positions(docs: DataFrame, targets: dict[str, Fraction] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` plus mix_source, mix_block, mix_slot and mix_position (0 to rows - 1, without gaps)."""
    return unboxed(positioned(docs, targets, block_rows), {c: F.col(c) for c in ADDED})


def mixed(docs: DataFrame, targets: dict[str, Fraction] | None = None) -> DataFrame:
    """All rows of ``docs``, in the order of the schedule: partitions and rows inside them follow it."""
    rows = positioned(docs, targets)
    return rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("box.*")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_positions(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


SQL: dict[str, str] = {}
QUERIES = {"op3_source_mixing": op3_source_mixing}
