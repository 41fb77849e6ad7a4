import gzip
import os
import random
import re
import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from seqloom.functions import sequence as Q
from seqloom.operators import align as A
from seqloom.operators import evaluate as E
from seqloom.operators import kernels as K
from seqloom.operators import paired as PA
from seqloom.operators import pairing as P
from seqloom.operators import reference as R
from seqloom.operators import regions
from seqloom.operators import seeds as S
from seqloom.operators.kmers import codes, kmers, windows
from seqloom.params import AlignParams, Orientation, PairParams, SeedType, comma_list
from seqloom.sources import fastx, index
from seqloom.sources.report import write_report
from seqloom.sources.sam import read_sam, sam_header, write_sam

DNA = st.text("acgt", max_size=24)


def naive(a, b, match, mismatch, opening, extend):
    """Unbanded affine global alignment by three plain tables."""
    low = -(10**9)
    n, m = len(a), len(b)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                e[i][j] = max(h[i - 1][j] - opening, e[i - 1][j]) - extend
            if j:
                f[i][j] = max(h[i][j - 1] - opening, f[i][j - 1]) - extend
            best = h[i][j]
            if i and j:
                best = max(best, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch))
            h[i][j] = max(best, e[i][j], f[i][j])
    return h[n][m]


@settings(max_examples=150, deadline=None)
@given(DNA, DNA)
def test_global_kernels(a, b):
    want = naive(a, b, 1, -4, 6, 1)
    score, cigar = K.align_global(a, b)
    assert score == want == K.score_global(a, b)
    import re

    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([=XID])", cigar)]
    assert sum(n for n, op in ops if op in "=XI") == len(a) and sum(n for n, op in ops if op in "=XD") == len(b)
    assert sum(n * {"=": 1, "X": -4}.get(op, -1) - 6 * (op in "ID") for n, op in ops) == score


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_local_kernel(a, b):
    want = max([0] + [naive(a[i:j], b[k:m], 1, -4, 6, 1) for i in range(len(a)) for j in range(i + 1, len(a) + 1) for k in range(len(b)) for m in range(k + 1, min(len(b), k + j - i + 6) + 1)][:4000] if len(a) * len(b) < 60 else [K.align_local(a, b)[0]])
    assert K.align_local(a, b)[0] == want


def test_extension_kernel():
    read, ref = "acgtacgtac", "acgtacgtacgg"
    assert K.extend_from(read, ref, 20) == (30, 10, 10, 30, 10)
    assert K.extend_from("", ref, 7)[3] == 7
    assert K.extend_from("tttttttttt", "cccccccccc", 5, zdrop=3)[:3] == (5, 0, 0)


def brute_mems(read, ref, least):
    out = set()
    for q in range(len(read)):
        for r in range(len(ref)):
            if q and r and read[q - 1] == ref[r - 1]:
                continue
            n = 0
            while q + n < len(read) and r + n < len(ref) and read[q + n] == ref[r + n]:
                n += 1
            if n >= least:
                out.add((q, r, n))
    return out


def test_seeds_against_brute_force(spark):
    rng = random.Random(5)
    reads, refs = [], []
    for i in range(12):
        ref = "".join(rng.choice("acgt") for _ in range(200))
        ref += ref[40:90]
        read = list(ref[20:160])
        for _ in range(8):
            read[rng.randrange(len(read))] = rng.choice("acgt")
        reads.append((i, "".join(read)))
        refs.append((i, ref))
    r, c = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(refs, "contig_id long, seq string")
    found = S.mems(S.hits(r, c, 10, dna=True), 10).where("read_id = contig_id")
    got = {(x.read_id, x.qpos, x.rpos, x.len) for x in found.collect()}
    want = {(i, *m) for (i, a), (_, b) in zip(reads, refs) for m in brute_mems(a, b, 10)}
    assert got == want
    longest = {(x.read_id, x.qpos, x.rpos, x.len) for x in S.longest_only(found).collect()}
    assert longest == {x for x in want if all(y[1] > x[1] or y[1] + y[3] <= x[1] + x[3] for y in want if y[0] == x[0])}


def test_kmers(spark):
    assert windows(np.array([1, 2, 3, 0], np.uint64), 3, np.uint64(4)).tolist() == [27, 44]
    pos, code = codes("acgtnacgtt", 4, True)
    assert pos.tolist() == [0, 5, 6] and code[0] == code[1] == 27
    rows = spark.createDataFrame([(1, "acg"), (2, None), (3, ""), (None, "acgtacgt"), (4, "n" * 30)], "k long, seq string")
    assert kmers(rows, "k", "seq", 4, dna=True).count() == 0
    assert kmers(spark.createDataFrame([(1, "é中" * 5)], "k long, seq string"), "k", "seq", 4).select("code").distinct().count() == 2


def test_scalar_functions(spark):
    row = spark.createDataFrame([("acgtrn!", "3S10=2X5M1I4=2D6=1S", "read/1", "a_b_10_20_1:2:3_4:5:6_ff")], "s string, c string, q string, n string")
    out = row.select(
        Q.reverse_complement("s").alias("rc"), Q.base_codes("s").alias("codes"), Q.collapse_cigar("c").alias("m"), Q.reference_span("c").alias("span"),
        Q.clip("c", False).alias("l"), Q.clip("c", True).alias("r"), Q.strip_mate("q").alias("q"), Q.simulated_origin("n").alias("o"), Q.simulated_origin("q").alias("none"),
    ).first()
    assert (out.rc, out.codes, out.m, out.span, out.l, out.r, out.q) == ("nnyacgt", "0123444", "3S17M1I4M2D6M1S", 29, 3, 1, "read")
    assert (out.o.contig, out.o.fwd_pos, out.o.rev_pos, out.o.fwd_edits, out.o.rev_edits, out.o.counter, out.none) == ("a_b", 10, 20, 6, 15, "ff", None)
    m = lambda b, s: Q.mapq(F.lit(b), F.lit(s), F.lit(-400))
    got = spark.range(1).select(m(100, 100), m(100, 90), m(100, None), m(0, None)).first()
    assert tuple(got) == (0, 25, 60, 0)


def simulate(rng, contigs, n, length=300, rate=0.03):
    out = []
    for i in range(n):
        c = rng.randrange(len(contigs))
        at = rng.randrange(len(contigs[c]) - length)
        read = list(contigs[c][at : at + length])
        for j in range(length):
            x = rng.random()
            if x < rate * 0.7:
                read[j] = rng.choice("acgt")
            elif x < rate * 0.85:
                read[j] += rng.choice("acgt")
            elif x < rate:
                read[j] = ""
        seq = "".join(read)
        reverse = rng.random() < 0.5
        if reverse:
            seq = seq[::-1].translate(str.maketrans("acgt", "tgca"))
        out.append((i, seq, c, at, reverse))
    return out


def test_mapping_finds_the_origin(spark):
    rng = random.Random(9)
    contigs = ["".join(rng.choice("acgt") for _ in range(8000)) for _ in range(3)]
    sim = simulate(rng, contigs, 60)
    reads = spark.createDataFrame([(i, s) for i, s, *_ in sim] + [(900, ""), (901, "n" * 100), (902, "acg")], "read_id long, seq string")
    refs = spark.createDataFrame(list(enumerate(contigs)), "contig_id long, seq string")
    got = {r.read_id: r for r in A.align(reads, refs, AlignParams(), 16).collect()}
    assert len(got) == 63 and all(got[i].flag == 4 for i in (900, 901, 902))
    right = sum(got[i].contig_id == c and abs(got[i].pos - 1 - at) <= 20 and (got[i].flag & 16 != 0) == rev for i, _, c, at, rev in sim)
    assert right >= 59
    assert all(got[i].mapq == 60 for i, *_ in sim if got[i].flag != 4)
    strict = AlignParams(error_rate=0.01, rescue=False)
    again = A.align(reads, refs, replace(strict, rescue=True), 16).where("flag = 4").count()
    assert 3 <= again < A.align(reads, refs, strict, 16).where("flag = 4").count()
    local = A.align(reads, refs, AlignParams(local=True), 16).where("flag <> 4 and read_id < 900").count()
    assert local == 60


def brute_concordant(a, b, p):
    (ac, a0, a1, ar), (bc, b0, b1, br) = a, b
    if ac != bc or (ar == br) != (p.orientation is Orientation.FF):
        return False
    first = ar if p.orientation is Orientation.RF else not ar
    left, right = ((a0, a1), (b0, b1)) if first else ((b0, b1), (a0, a1))
    inside = (a0 >= b0 and a1 <= b1) or (b0 >= a0 and b1 <= a1)
    over = inside or a0 <= b0 <= a1 or a0 <= b1 <= a1
    span = max(a1, b1) - min(a0, b0) + 1
    if right[1] <= left[0] or not p.min_insert <= span <= p.max_insert or (inside and not p.contain) or (over and not p.overlap):
        return False
    return left[0] <= right[0] or (over and p.dovetail)


@pytest.mark.parametrize("p", [PairParams(0, 60), PairParams(10, 60, Orientation.RF, dovetail=True), PairParams(0, 50, Orientation.FF, contain=False), PairParams(0, 60, overlap=False)])
def test_concordance(spark, p):
    rng = random.Random(4)
    make = lambda: (rng.randrange(2), s := rng.randrange(50), s + rng.randrange(1, 30), rng.random() < 0.5)
    pairs = [(i, make(), make()) for i in range(400)]
    one = spark.createDataFrame([(i, *a, 1) for i, a, _ in pairs], "read_id long, contig long, start long, end long, reverse boolean, score long")
    two = spark.createDataFrame([(i, *b, 1) for i, _, b in pairs], one.schema)
    got = {r.read_id for r in P.concordant_pairs(one, two, p).collect()}
    assert got == {i for i, a, b in pairs if brute_concordant(a, b, p)}


def test_regions_triage_edges(spark):
    empty = spark.createDataFrame([], "read_id long, contig_id long, qpos int, rpos int, len int")
    assert regions.ranked(regions.covered(regions.sessions(empty, 5), ["read_id", "contig_id", "region"])).count() == 0
    assert regions.triage(empty, 1, 1, 1).count() == 0
    assert A.chain([(0, 0, 10), (20, 21, 10), (500, 2, 9)], 0, 0.08, 600) == ([0, 1], 2, 20)
    assert A.chain([(3, 0, 10), (23, 21, 10)], 1, 0.08, 33) == ([0, 1], 2, 20)


def test_growth_and_reserves():
    p = AlignParams(max_seeds=2, max_mems=2, min_mem_length=50, error_rate=0.04)
    # one stretch in three places is a reserve; it fills the region of the others, but not a place of its own
    seeds = [(0, 0, 1000, 30), (0, 60, 1060, 35), *((0, 20, r, 12) for r in (1020, 5020, 9020))]
    assert A.triage(seeds, p) == ([seeds[0], seeds[1]], seeds[2:])
    assert A.group_regions(seeds, p, 100) == [(0, 0, 30 + 35 + 2, [(0, 1000, 30), (60, 1060, 35), (20, 1020, 12)])]
    # the longest seed places the read: what lies left of that place begins no region of its own with it
    far = [(90, 890, 10), (0, 1000, 30), (50, 1050, 45)]
    assert [(a, b, x) for a, b, x in A.grown(far, 5, 100)] == [(795, 905, far[:1]), (995, 1105, far[1:])]
    assert A.grown([], 5, 100) == []


def test_anchors_near_a_corner():
    p = AlignParams()
    assert A.out_of_reach((2, 3, 20), (0, 100, 0, 100), p) and not A.out_of_reach((30, 35, 20), (0, 100, 0, 100), p)
    assert not A.out_of_reach((2, 200, 20), (0, 100, 0, 100), p)


def test_sampled_reference_gives_whole_matches(spark):
    rng = random.Random(5)
    for stride in (2, 4):
        reads, refs = [], []
        for i in range(8):
            ref = "".join(rng.choice("acgt") for _ in range(400))
            at = rng.randrange(150)
            read = list(ref[at : at + 200])
            for _ in range(6):
                read[rng.randrange(200)] = rng.choice("acgtn")
            reads.append((i, "".join(read)))
            refs.append((i, ref))
        r, c = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(refs, "contig_id long, seq string")
        found = S.mems(S.hits(r, c, 12, dna=True, stride=stride), 12, stride=stride)
        got = {(x.read_id, x.qpos, x.rpos, x.len) for x in S.whole(found, r, c, 200, True, stride - 1).where("read_id = contig_id").collect()}
        want = {(i, *m) for (i, a), (_, b) in zip(reads, refs) for m in brute_mems(a, b, 12)}
        # every match that holds a sampled k-mer is there, whole, and nothing else
        assert got <= want and {x for x in want if x[3] >= 12 + stride - 1} <= got


def brute_partly(found, length, min_len, m, most):
    """Position by position, from the rightmost end to the left; found: (q, r, n)."""
    end_at, places = {}, {}
    for p in range(length):
        ends = [q + n for q, _, n in found if q <= p and q + n - p >= min_len]
        if ends:
            end_at[p] = max(ends)
            places[p] = sum(q <= p and q + n >= end_at[p] for q, _, n in found)
    size, limit = {}, {}
    for e in set(end_at.values()):
        total = 0
        for p in sorted(p for p in end_at if end_at[p] == e):
            if e not in limit or p <= limit[e] + 1:
                total += places[p]
            if e not in limit and total >= m:
                limit[e] = p
        size[e] = total
    out, least = set(), length
    for e in sorted(size, reverse=True):
        mine = sorted(p for p in end_at if end_at[p] == e)
        if size[e] >= most or mine[0] > least + 1:
            continue
        if size[e] >= m:
            least = min(least, limit[e])
        stop = max((x for x in size if x < e and size[x] >= m), default=-1)
        for p in mine:
            if p > least + 1 or (size[e] >= m and p > limit[e] + 1):
                continue
            for q, r, n in found:
                if q == p and (n + q == e or (size[e] < m and (q + n > stop or (q + n == stop and p <= limit[stop] + 1)))):
                    out.add((q, r, n))
    return out


@pytest.mark.parametrize("m", [2, 6, 30])
def test_partly_longest_against_brute_force(spark, m):
    rng = random.Random(m)
    reads, refs = [], []
    for i in range(12):
        piece = "".join(rng.choice("ac") for _ in range(14))
        ref = "".join(piece[: rng.randrange(5, 14)] + "".join(rng.choice("acgt") for _ in range(rng.randrange(4))) for _ in range(9))
        reads.append((i, "".join(piece[rng.randrange(4) :] + rng.choice("gt") for _ in range(4))))
        refs.append((i, ref))
    r, c = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(refs, "contig_id long, seq string")
    found = S.mems(S.hits(r, c, 5, dna=True), 5).where("read_id = contig_id")
    for most in (10_000, 25):
        got = {(x.read_id, x.qpos, x.rpos, x.len) for x in S.partly_longest(found, m, 5, most).collect()}
        want = {(i, *x) for (i, a), (_, b) in zip(reads, refs) for x in brute_partly(brute_mems(a, b, 5), len(a), 5, m, most)}
        assert got == want


def test_sampled_reads_too(spark):
    rng = random.Random(15)
    reads, refs = [], []
    for i in range(8):
        ref = "".join(rng.choice("acgt") for _ in range(600))
        read = list(ref[100:500])
        for _ in range(5):
            read[rng.randrange(400)] = rng.choice("acgt")
        reads.append((i, "".join(read)))
        refs.append((i, ref))
    r, c = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(refs, "contig_id long, seq string")
    p = AlignParams(sparseness=4, sample_reads=True, seed_type=SeedType.MEM)
    assert p.skip(16, 4) == 6
    got = {(x.read_id, x.qpos, x.rpos, x.len) for x in A.seeds_of(r, c, p, 16, True).where("read_id = contig_id").collect()}
    want = {(i, *m) for (i, a), (_, b) in zip(reads, refs) for m in brute_mems(a, b, 16)}
    assert got <= want and {x for x in want if x[3] >= 40} <= got


def test_repeats_cost_nothing_before_the_join(spark):
    rng = random.Random(6)
    unique = "".join(rng.choice("acgt") for _ in range(300))
    contigs = spark.createDataFrame([(0, "a" * 5000 + unique + "a" * 3000)], "contig_id long, seq string")
    reads = spark.createDataFrame([(i, "a" * 600) for i in range(5)] + [(9, "a" * 40 + unique[:200] + "a" * 60)], "read_id long, seq string")
    assert S.hits(reads, contigs, 20, True, most=50).count() < 400
    found = S.whole(S.mems(S.hits(reads, contigs, 20, True, most=50), 20), reads, contigs, 600, True)
    assert {(r.qpos, r.rpos, r.len) for r in found.where("len >= 100").collect()} == {(0, 4960, 240)}
    got = {r.read_id: r for r in A.align(reads, contigs, AlignParams(max_seeds=50, local=True), 20).collect()}
    assert got[9].pos == 4961 and all(got[i].flag == 4 for i in range(5))


def test_align_by_a_stored_sampled_index(spark, tmp_path):
    rng = random.Random(12)
    contigs = ["".join(rng.choice("acgt") for _ in range(6000)) for _ in range(2)]
    sim = simulate(rng, contigs, 30)
    reads = spark.createDataFrame([(i, s) for i, s, *_ in sim], "read_id long, seq string")
    refs = spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(contigs)], "contig_id long, name string, seq string")
    table, dim, params = index.load_or_build(refs, str(tmp_path / "ix"), 16, 4)
    got = {r.read_id: r for r in A.align(reads, dim, AlignParams(), index=A.Index(table, params["k"], params["stride"])).collect()}
    assert all(got[i].contig_id == c and abs(got[i].pos - 1 - at) <= 50 and (got[i].flag & 16 != 0) == rev for i, _, c, at, rev in sim)


def test_repeated_read_ids_are_refused(spark):
    reads = spark.createDataFrame([(1, "acgtacgttgcaacgtggacta"), (1, "acgtacgttgcaacgtggacta")], "read_id long, seq string")
    contigs = spark.createDataFrame([(0, "ttacgtacgttgcaacgtggactatt")], "contig_id long, seq string")
    with pytest.raises(Exception, match="repeats"):
        A.align(reads, contigs, AlignParams(), 10).collect()


def test_banded_kernels_are_small():
    rng = random.Random(7)
    a = "".join(rng.choice("acgt") for _ in range(20_000))
    b = "".join(c for c in a if rng.random() > 0.01)
    tracemalloc.start()
    score, cigar = K.align_global(b, a, band=250)
    assert tracemalloc.get_traced_memory()[1] < 100e6 and score > 15_000
    assert sum(int(n) for n, op in re.findall(r"(\d+)([=XID])", cigar) if op != "I") == 20_000
    tracemalloc.reset_peak()
    assert K.extend_from(b, a, 40, band=100)[0] > 5_000 and tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()


def test_evaluation_edges(spark):
    sam = spark.createDataFrame([("a", 4, "*", 0, 0, "*", -1), ("b", 77, "*", 0, 0, "*", -1), ("c", 0, "x", 10, 60, "*", 0), ("c", 256, "x", 90, 0, "*", 9)], "qname string, flag long, rname string, pos long, mapq long, rnext string, edits long")
    got = {r.level: r for r in E.summary(sam, [10]).collect()}
    assert got["all"].mapped == 2 and got["all"].secondary == 1 and got["all"].reads == 2 and got["mapq>=10"].mapped == 1
    truth = spark.createDataFrame([("c", 0, "x", 12, 1)], "qname string, flag long, rname string, pos long, edits long")
    rows = {(r.window, r.level): r for r in E.against_truth(truth, sam, [1, 5], [10]).collect()}
    assert rows[5, "all"].correct == 1 and rows[1, "all"].ok == 1 and rows[5, "all"].reads_correct == 1 and (5, "unique") not in rows


def test_fastx_and_sam_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    with gzip.open(tmp_path / "r" / "a.fq.gz", "wt") as f:
        f.write("@r1/1 first\nACGT\nAC\n+\nIIII\nII\n@r2\n\n+\n\n>r3\nacg t\nNN")
    fastx.register(spark)
    rows = [tuple(r)[1:] for r in spark.read.format("fastx").load(str(tmp_path / "r")).orderBy("ordinal").collect()]
    assert rows == [(0, "r1/1", "first", "acgtac", "IIIIII"), (1, "r2", "", "", ""), (2, "r3", "", "acgtnn", "*")]
    assert [r[:2] for r in fastx.records(iter([">a\tb c d", "ac", ">e f\tg", "> h", "g"]))] == [("a", "b c d"), ("e", "f\tg"), ("", " h".strip())]
    (tmp_path / "r" / "b.fa").write_text(">r9\nac\n")
    for path in (str(tmp_path / "r"), f"file://{tmp_path}/r"):
        rows = spark.read.format("fastx").load(path).orderBy("ordinal").select("ordinal", "name", "seq").collect()
        assert [tuple(r) for r in rows][2:] == [(2, "r3", "acgtnn"), (2**40, "r9", "ac")]
    with pytest.raises(fastx.BrokenRecord):
        list(fastx.records(iter(["@x", "acgt", "+", "II"])))
    sam = spark.createDataFrame([("q", 16, "c1", 5, 60, "2S3M", None, 0, 0, "acgta", "*", 7, 1, "2S3=")], "qname string, flag long, rname string, pos long, mapq long, cigar string, rnext string, pnext long, tlen long, seq string, qual string, as long, nm long, x0 string")
    dim = spark.createDataFrame([("c1", 100)], "name string, length long")
    write_sam(sam, dim, str(tmp_path / "out"))
    assert (tmp_path / "out" / sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part"))[0]).read_text().startswith("@HD")
    back = read_sam(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1 and (back[0].qname, back[0].left, back[0].edits, back[0].rnext) == ("q", 3, 1, "*")
    assert "@SQ\tSN:c1\tLN:100" in sam_header(dim)


def test_index_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "c", "acgtacgtacgtaaccgg")], "contig_id long, name string, seq string")
    assert index.load(spark, str(tmp_path / "no")) is None
    table, dim, params = index.load_or_build(contigs, str(tmp_path / "ix"), 8, 2)
    assert params == {"k": 8, "stride": 2, "dna": True} and dim.first().length == 18
    assert table.count() == 6 and index.load(spark, str(tmp_path / "ix")) is not None
    held = {r.table: r for r in index.sizes(spark, str(tmp_path / "ix")).collect()}
    assert held["kmers"].rows == 6 and held["contigs"].bytes > 0 and held["params"].files >= 1
    assert {(r.rpos, r.n) for r in table.collect()} == {(0, 2), (2, 2), (4, 2), (6, 1), (8, 1), (10, 1)} or table.groupBy("code").agg(F.min("n") == F.count("*")).collect()


def test_report_files(spark, tmp_path):
    write_report(spark.createDataFrame([("b", 2), ("a", None)], "level string, n long"), ["level", "n"], str(tmp_path / "r"), ["about"])
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["# about", "#level\tn", "a\t", "b\t2"]


def test_walked_cigars():
    assert A.walked("2S3M1I2M2D2=1H", "ttacgGactg", "ACTacTTTG") == (4, "2S2=1X1I2=2D2=1H")
    assert A.walked("4M", "acgt", "ac") == (2, "2=2X") and A.walked("*", "ac", "ac") == (0, "")


def test_streams(spark, tmp_path):
    from seqloom.streaming.mapping import running_counts, seed_hits

    contigs = spark.createDataFrame([(0, "c", "acgtacgttgcaacgtgg")], "contig_id long, name string, seq string")
    table, _, _ = index.load_or_build(contigs, str(tmp_path / "ix"), 8)
    spark.createDataFrame([(1, "cgttgcaacg"), (2, "tttttttttt")], "read_id long, seq string").write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema("read_id long, seq string").parquet(str(tmp_path / "reads"))
    q = seed_hits(stream, table, 8).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("hits").collect()} == {(1, 0, i, 5 + i) for i in range(3)}
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a", 1.0), ("2020-01-01 00:20:00", "a", 2.0), ("2020-01-01 05:00:00", "b", 1.0)], "t string, event_type string, value double")
    events.select(F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "ev"))
    live = running_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev")))
    q = live.writeStream.outputMode("append").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.table("counts").collect()] == [("a", 2, 3.0)]


def test_parameters():
    assert SeedType.parse("MEM") is SeedType.MEM and SeedType.parse("?") is SeedType.SMEM and Orientation.parse("rf") is Orientation.RF
    p = AlignParams()
    assert (p.max_edits(100), p.min_score(100), p.seed_length(100), p.seed_length(1000)) == (9, 55, 40, 45)
    assert comma_list("1,2", 0, 9) == (1, 2)
    with pytest.raises(ValueError):
        comma_list("77", 0, 60)


def _fragments(rng, contigs, n, read=120):
    """(id, mate 1, mate 2, contig, start, start of mate 2) of fr pairs, a few bases changed."""
    flip = lambda s: s[::-1].translate(str.maketrans("acgt", "tgca"))
    noisy = lambda s: "".join(rng.choice("acgt") if rng.random() < 0.02 else x for x in s)
    out = []
    for i in range(n):
        c, size = rng.randrange(len(contigs)), rng.randrange(300, 700)
        at = rng.randrange(len(contigs[c]) - size)
        left, right = noisy(contigs[c][at : at + read]), flip(noisy(contigs[c][at + size - read : at + size]))
        out.append((i, left, right, c, at, at + size - read))
    return out


@pytest.fixture(scope="module")
def fragments(spark):
    rng = random.Random(3)
    contigs = ["".join(rng.choice("acgt") for _ in range(6000)) for _ in range(2)]
    # a second copy of a stretch, so that single mates are ambiguous and pairs are not
    contigs[1] = contigs[1][:3000] + contigs[0][1000:1400] + contigs[1][3400:]
    frags = _fragments(rng, contigs, 30)
    junk = "".join(rng.choice("acgt") for _ in range(120))
    rows = [(i, a, b) for i, a, b, *_ in frags] + [(100, frags[0][1], junk), (101, junk, ""), (102, None, None)]
    one = spark.createDataFrame([(i, a) for i, a, _ in rows], "read_id long, seq string")
    two = spark.createDataFrame([(i, b) for i, _, b in rows], "read_id long, seq string")
    return frags, one, two, spark.createDataFrame(list(enumerate(contigs)), "contig_id long, seq string")


@pytest.mark.parametrize("mode", [1, 2, 3, 4, 5, 6, 9])
def test_paired_modes(fragments, mode):
    frags, one, two, refs = fragments
    got = PA.align_pairs(one, two, refs, AlignParams(), PairParams(mode=mode), 16).collect()
    rows = {(r.read_id, r.mate): r for r in got}
    assert len(rows) == len(got) == 66
    right = sum(
        rows[i, 1].contig_id == rows[i, 2].contig_id == c and abs(rows[i, 1].pos - 1 - a) <= 9 and abs(rows[i, 2].pos - 1 - b) <= 9 and rows[i, 1].flag & 255 == 99 and rows[i, 2].flag & 255 == 147
        for i, _, _, c, a, b in frags
    )
    assert right >= 28
    assert all(rows[i, 1].tlen == -rows[i, 2].tlen and rows[i, 1].mate_pos == rows[i, 2].pos for i, *_ in frags if rows[i, 1].flag & 2)
    assert (rows[100, 1].flag & ~16, rows[100, 2].flag, rows[101, 1].flag, rows[101, 2].flag, rows[102, 2].flag) == (73, 133, 77, 141, 141)
    assert rows[101, 1].contig_id is None and rows[101, 1].cigar is None


def test_unmixed_and_window_rescue(fragments, spark):
    frags, one, two, refs = fragments
    rows = {(r.read_id, r.mate): r for r in PA.align_pairs(one, two, refs, AlignParams(), PairParams(mixed=False), 16).collect()}
    assert rows[100, 1].flag == 77
    # mate 2 has no exact match of 16 bases: only the search of its window finds it
    broken = lambda s: "".join(("c" if x != "c" else "g") if j % 14 == 13 else x for j, x in enumerate(s))
    bad = spark.createDataFrame([(i, broken(b)) for i, _, b, *_ in frags], "read_id long, seq string")
    p = AlignParams(error_rate=0.12)
    plain = PA.align_pairs(one, bad, refs, p, PairParams(), 16).where("flag & 2 = 2").count()
    for pair in (PairParams(mode=2), PairParams(rescue=True)):
        found = PA.align_pairs(one, bad, refs, p, pair, 16).where("flag & 2 = 2").collect()
        assert len(found) >= 50 > plain
        assert sum(r.mate == 2 and abs(r.pos - 1 - frags[r.read_id][5]) <= 12 for r in found) >= 25


@pytest.mark.parametrize("p", [PairParams(0, 60), PairParams(10, 60, Orientation.RF, dovetail=True), PairParams(0, 50, Orientation.FF), PairParams(0, 60, overlap=False)])
def test_mate_place_is_the_column(spark, p):
    rng = random.Random(8)
    rows = [(i, s := rng.randrange(200), s + rng.randrange(1, 40), rng.random() < 0.5, rng.randrange(60), rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, s long, e long, r boolean, n long, second boolean")
    wanted, low, high = P.mate_window(*(F.col(c) for c in "sern"), F.col("second"), p)
    got = {r.i: (r.w, r.lo, r.hi) for r in df.select("i", wanted.alias("w"), low.alias("lo"), high.alias("hi")).collect()}
    assert got == {i: PA.mate_place(s, e, r, n, second, p) for i, s, e, r, n, second in rows}


def test_regions_without_slack_follow_the_pair_rules(spark):
    rng = random.Random(5)
    make = lambda: (rng.randrange(2), s := rng.randrange(50), s + rng.randrange(1, 30), rng.random() < 0.5)
    pairs = [(i, *make(), *make()) for i in range(400)]
    cols = ", ".join(f"{x}_contig long, {x}_begin long, {x}_until long, {x}_reverse boolean" for x in "ab")
    df = spark.createDataFrame(pairs, f"i long, {cols}").withColumn("a_edits", F.lit(0)).withColumn("b_edits", F.lit(0))
    for p in (PairParams(0, 60), PairParams(5, 60, Orientation.RF, dovetail=True), PairParams(0, 50, Orientation.FF, contain=False)):
        assert {r.i for r in df.where(P.concordant_regions(p)).collect()} == {x[0] for x in pairs if brute_concordant(x[1:5], x[5:9], p)}
    wide = df.withColumn("a_edits", F.lit(3))
    assert df.where(P.concordant_regions(PairParams(0, 40))).count() <= wide.where(P.concordant_regions(PairParams(0, 40, dovetail=True))).count()


def test_chunks_hold_every_window(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("acgt") for _ in range(1000))
    refs = spark.createDataFrame([(0, text), (1, ""), (2, None)], "contig_id long, seq string")
    got = R.chunks(refs, 64, 10).collect()
    assert {(r.contig_id, r.chunk): r.piece for r in got} == {(0, i): text[64 * i : 64 * i + 74] for i in range(16)}
    rows = spark.createDataFrame([(0, -5, 20), (0, 990, 1040), (0, 500, 500), (1, 0, 5)], "contig_id long, low long, high long")
    assert sorted(r.window for r in R.with_window(rows, refs, 100).collect()) == sorted([text[:20], text[990:], ""])


def test_claims_full_dp_and_seed_kinds(spark, fragments):
    c = A.Claims()
    seed = lambda q, n: [{"qpos": q, "len": n}]
    assert [c.add(seed(*x)) for x in ((5, 10), (6, 5), (5, 12), (5, 12), (0, 3), (30, 2))] == [True, False, True, False, True, True]
    frags, one, _, refs = fragments
    plain = {r.read_id: r for r in A.align(one, refs, AlignParams(), 16).collect()}
    full = {r.read_id: r for r in A.align(one, refs, AlignParams(full_dp=True), 16).collect()}
    assert plain.keys() == full.keys() and all(full[i].score >= plain[i].score for i, *_ in frags)
    assert all(full[i].contig_id in (0, 1) for i, *_ in frags)
    counts = {t: A.align(one, refs, AlignParams(seed_type=t), 16).where("flag <> 4").count() for t in SeedType}
    assert counts[SeedType.MEM] >= 30 and counts[SeedType.SMEM] >= 30 and counts[SeedType.PSMEM] >= 30 and counts[SeedType.MUM] <= counts[SeedType.MAM] <= 31
