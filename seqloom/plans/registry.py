"""All queries of the mapping engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..operators import align as A
from ..operators import evaluate as E
from ..operators import kernels as K
from ..operators import pairing as P
from ..operators import post, regions
from ..operators import seeds as S
from ..operators.kmers import kmers, spectrum
from ..operators.paired import align_pairs
from ..params import AlignParams, PairParams
from ..sources.report import report_lines
from ..sources.sam import parse_sam
from . import views as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ERROR = 0.08


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scalar functions ---------------------------------------------------------------------------


@query(
    f"select doc_id as read_id, md5(reverse(translate(d, 'acgt', 'tgca'))) as revcomp_md5, length(d)::int as n from (select doc_id, {V.dna_sql('text')} as d from documents)"
)
def revcomp(spark, d):
    rows = V.reads_dna(spark, d)
    return rows.select("read_id", F.md5(Q.reverse_complement("seq").cast("binary")).alias("revcomp_md5"), F.length("seq").alias("n"))


@query(f"select item_id as contig_id, translate({V.dna_sql('text')}, 'acgt', '0123') as codes from benchmark")
def base_encode(spark, d):
    return V.contigs_dna(spark, d).select("contig_id", Q.base_codes("seq").alias("codes"))


@query(
    f"""select doc_id as read_id, length(replace(replace(s, 'a', ''), 't', ''))::bigint as gc, length(s)::bigint as n,
  coalesce((100 * length(replace(replace(s, 'a', ''), 't', ''))) // nullif(length(s), 0), 0)::bigint as pct
  from (select doc_id, {V.dna_sql('text')} as s from documents)"""
)
def gc_profile(spark, d):
    rows = V.reads_dna(spark, d).select("read_id", F.length(F.regexp_replace("seq", "[^gc]", "")).cast("long").alias("gc"), F.length("seq").cast("long").alias("n"))
    return rows.withColumn("pct", F.expr("coalesce(100 * gc div nullif(n, 0), 0)"))


_PARAMS = f"""select doc_id as read_id, n, e as max_edits, n + e * -5 as min_score,
  (40 + case when n >= 1000 then floor(floor(n / 500) * 20 / (100 * {ERROR}::double)) else 0 end)::bigint as seed_length,
  greatest(3, least(100, least(e, floor((n - 6) / 1)::bigint)))::bigint as band
  from (select doc_id, length(text)::bigint as n, (floor(length(text) * {ERROR}::double) + 1)::bigint as e from documents)"""


@query(_PARAMS)
def seed_params(spark, d):
    rows = V.reads_text(spark, d).select("read_id", F.length("seq").cast("long").alias("n"))
    n, e = F.col("n"), F.col("max_edits")
    return rows.withColumn("max_edits", Q.max_edits(n, ERROR)).select(
        "read_id", "n", "max_edits", Q.min_score(n, e, 1, -4).alias("min_score"), Q.seed_length(n, e, ERROR).alias("seed_length"), Q.band(e, n, 1, -6, -1, 100).alias("band")
    )


@query(
    f"""with {V.SAM} select distinct cigar, replace(collapsed, ' ', '') as collapsed from (select cigar,
  case when l_suppkey % 7 > 0 then (l_suppkey % 7) || 'S' else '' end || (l_partkey % 40 + 10 + l_linenumber + l_partkey % 20 + 5) || 'M2I12M' || (l_orderkey % 4 + 1) || 'D30M'
  || case when l_suppkey % 3 = 0 then '9S' else '' end as collapsed from sam)"""
)
def cigar_collapse(spark, d):
    return V.sam_like(spark, d).select("cigar").distinct().withColumn("collapsed", Q.collapse_cigar("cigar"))


@query(
    f"""with {V.SAM} select qname, pos, cigar, pos + l_partkey % 40 + 10 + l_linenumber + l_partkey % 20 + 5 + 12 + l_orderkey % 4 + 1 + 30 - 1 as right_pos from sam"""
)
def cigar_span(spark, d):
    rows = V.sam_like(spark, d)
    return rows.select("qname", "pos", "cigar", (F.col("pos") + Q.reference_span("cigar") - 1).alias("right_pos"))


@query(
    f"""with {V.SAM} select qname, pos, cigar, pos - l_suppkey % 7 as left_pos, pos + l_partkey % 40 + 10 + l_linenumber + l_partkey % 20 + 5 + 12 + l_orderkey % 4 + 1 + 30 - 1
  + case when l_suppkey % 3 = 0 then 9 else 0 end as right_pos from sam"""
)
def clip_positions(spark, d):
    rows = V.sam_like(spark, d)
    right = F.col("pos") + Q.reference_span("cigar") - 1 + Q.clip("cigar", True)
    return rows.select("qname", "pos", "cigar", (F.col("pos") - Q.clip("cigar", False)).alias("left_pos"), right.alias("right_pos"))


@query(f"with {V.SAM} select raw_name, case when length(raw_name) > 2 and raw_name[-2] = '/' then raw_name[:-3] else raw_name end as stripped, count(*) as n from sam group by all")
def qname_strip(spark, d):
    rows = V.sam_like(spark, d).select("raw_name", Q.strip_mate("raw_name").alias("stripped"))
    return rows.groupBy("raw_name", "stripped").agg(F.count("*").alias("n"))


@query(f"with {V.SIMULATED} select qname, contig, fwd_pos, rev_pos, fwd_edits, rev_edits, counter from origin")
def wgsim_parse(spark, d):
    rows = V.simulated(spark, d).select("qname", Q.simulated_origin("qname").alias("o"))
    return rows.select("qname", "o.contig", "o.fwd_pos", "o.rev_pos", "o.fwd_edits", "o.rev_edits", "o.counter")


# --- k-mer tables --------------------------------------------------------------------------------

_KMERS = f"""with r as (select item_id, {V.dna_sql('text')} as s from benchmark),
  k as (select substr(s, i, 10) as kmer from (select s, unnest(range(1, greatest(length(s) - 8, 1))) as i from r)),
  c as (select list_sum([(strpos('acgt', kmer[11 - j]) - 1) * (4 ** (j - 1)) for j in range(1, 11)])::bigint as code, count(*) as n from k group by kmer)"""


@query(_KMERS + " select code, n from c")
def kmer_spectrum(spark, d):
    return spectrum(kmers(V.contigs_dna(spark, d), "contig_id", "seq", 10, dna=True))


@query(_KMERS + " select code, n from c order by n desc, code limit 20")
def kmer_topk(spark, d):
    """A top-20 report."""
    return spectrum(kmers(V.contigs_dna(spark, d), "contig_id", "seq", 10, dna=True)).orderBy(F.desc("n"), "code").limit(20)


# --- seeds ---------------------------------------------------------------------------------------


@query(f"with {V.MEMS} select * from mems")
def mem_seeds(spark, d):
    return V.text_mems(spark, d)


@query(f"with {V.SMEMS} select * from smems")
def smem_seeds(spark, d):
    return S.longest_only(V.text_mems(spark, d))


_PSMEM = f""", tp as (select *, qpos + len as e, max(qpos + len) over (partition by read_id order by qpos range between unbounded preceding and current row) as top from mems),
  st as (select read_id, top, qpos, count(*) as n from tp where e = top group by all),
  rg as (select *, least(coalesce(lead(first) over (partition by read_id order by first), 1000000000000), top - {V.K} + 1) as till from (select read_id, top, min(qpos) as first from st group by all)),
  pt as (select st.*, first, till, sum(n) over (partition by read_id, top order by qpos) as c, lead(qpos) over (partition by read_id, top order by qpos) as nq from st join rg using (read_id, top)),
  p2 as (select *, least(coalesce(nq, 1000000000000), till) as nx, greatest(least(coalesce(nq, 1000000000000), till) - qpos, 0) * c as w from pt),
  p3 as (select *, coalesce(sum(w) over (partition by read_id, top order by qpos rows between unbounded preceding and 1 preceding), 0) as bf, lead(c) over (partition by read_id, top order by qpos) as th from p2),
  p4 as (select *, case when bf < {{m}} and bf + w >= {{m}} then qpos + ceil(({{m}} - bf) / c)::bigint - 1 end as b from p3),
  en as (select read_id, top, first, min(b) as lim, coalesce(max(bf + (b - qpos + 1) * c + case when b + 1 < nx then c when b + 1 < till then th else 0 end), sum(w)) as size from p4 group by all),
  e2 as (select *, case when lim is not null and size < {{most}} then lim end as own from en),
  e3 as (select *, min(own) over (partition by read_id order by top desc rows between unbounded preceding and 1 preceding) as rt,
    max(case when lim is not null then {{{{'t': top, 'l': lim}}}} end) over (partition by read_id order by top rows between unbounded preceding and 1 preceding) as stop from e2)
  select read_id, contig_id, qpos, rpos, len from tp join e3 using (read_id, top) where size < {{most}} and coalesce(first <= rt + 1, true) and coalesce(qpos <= least(rt, own) + 1, true)
   and case when lim is not null then e = top and qpos <= lim + 1 else e = top or coalesce(e > stop.t or (e = stop.t and qpos <= stop.l + 1), true) end"""


@query(f"with {V.MEMS}" + _PSMEM.format(m=40, most=10_000))
def psmem_seeds(spark, d):
    return S.partly_longest(V.text_mems(spark, d), 40, V.K)


_MAM = V.MEMS + ", mam as (select read_id, contig_id, qpos, rpos, len from (select *, count(*) over (partition by read_id, qpos, len) as n from mems) where n = 1)"


@query(f"with {_MAM} select * from mam")
def mam_seeds(spark, d):
    return S.unique_in_reference(V.text_mems(spark, d))


@query(f"with {_MAM} select read_id, contig_id, qpos, rpos, len from (select *, count(*) over (partition by read_id, contig_id, rpos, len) as n from mam) where n = 1")
def mum_seeds(spark, d):
    return S.unique_in_both(V.text_mems(spark, d))


@query(
    f"""with {V.MEMS}, t as (select *, case when len >= 100 then 0 when len >= 48 then 1 else 2 end as tier from mems)
  select read_id, contig_id, qpos, rpos, len, tier from (select *, min(tier) over (partition by read_id) as best from t) where tier <= best"""
)
def seed_rescue_tier(spark, d):
    return S.strictest_tier(V.text_mems(spark, d), [100, 48, 0])


@query(f"with {V.MEMS} select read_id, contig_id, qpos, rpos, len from (select *, count(*) over (partition by read_id, qpos, len) as n from mems) where n <= 2")
def seed_freq_cap(spark, d):
    return S.frequency_cap(V.text_mems(spark, d), 2)


_STRANDS = f"""
  dna as (select doc_id, {V.dna_sql('text')} as s from documents),
  st as (select doc_id as read_id, '+' as strand, s from dna union all select doc_id, '-', reverse(translate(s, 'acgt', 'tgca')) from dna),
  q as (select read_id, strand, substr(s, c + 1, 275) as t, c from (select *, unnest(range(0, greatest(length(s) - 19, 0), 256)) as c from st)),
  qk as (select read_id, strand, c + i as qpos, substr(t, i + 1, 20) as k from (select *, unnest(range(0, least(256, length(t) - 19))) as i from q)),
  b as (select item_id, {V.dna_sql('text')} as s from benchmark),
  rk as (select item_id as contig_id, i as rpos, substr(s, i + 1, 20) as k from (select *, unnest(range(0, greatest(length(s) - 19, 0))) as i from b)),
  h as (select read_id, strand, contig_id, qpos, rpos from qk join rk using (k))"""


@query(
    f"""with {_STRANDS} select read_id, strand, contig_id, min(qpos)::int as qpos, min(rpos)::int as rpos, (count(*) + 19)::int as len
  from (select *, rpos - qpos as d, qpos - row_number() over (partition by read_id, strand, contig_id, rpos - qpos order by qpos) as g from h)
  group by read_id, strand, contig_id, d, g"""
)
def strand_seeds(spark, d):
    """Exact matches of both strands of the folded documents."""
    both = S.strands(V.reads_dna(spark, d)).withColumn("read_id", F.col("read_id") * 2 + (F.col("strand") == "-").cast("long"))
    rows = S.mems(S.hits(both, V.contigs_dna(spark, d), 20, dna=True), 20)
    return rows.select(F.expr("read_id div 2").alias("read_id"), F.when(F.col("read_id") % 2 == 1, "-").otherwise("+").alias("strand"), "contig_id", "qpos", "rpos", "len")


# --- regions and ranking -------------------------------------------------------------------------

_SESSIONS = (
    V.SMEMS
    + """, j as (select *, rpos - qpos as diagonal from smems),
  g as (select *, case when diagonal - lag(diagonal) over w > 20 or lag(diagonal) over w is null then 1 else 0 end as jump from j window w as (partition by read_id, contig_id order by diagonal, qpos)),
  ses as (select read_id, contig_id, qpos, rpos, len, sum(jump) over (partition by read_id, contig_id order by diagonal, qpos)::bigint as region from g),
  tops as (select *, coalesce(max(qpos + len) over (partition by read_id, contig_id, region order by qpos, len desc rows between unbounded preceding and 1 preceding), 0) as top from ses),
  reg as (select read_id, contig_id, region, sum(greatest(0, qpos + len - greatest(qpos, top)))::bigint as covered, min(rpos)::bigint as ref_begin, max(rpos + len)::bigint as ref_end,
    min(qpos)::bigint as q_begin, max(qpos + len)::bigint as q_end, count(*) as seeds from tops group by all),
  rk2 as (select *, row_number() over (partition by read_id order by covered desc, contig_id, ref_begin, region) as rank from reg)"""
)


def _regions(spark, d):
    return regions.covered(regions.sessions(S.longest_only(V.text_mems(spark, d)), 20), ["read_id", "contig_id", "region"])


@query(f"with {_SESSIONS} select * from ses")
def region_sessions(spark, d):
    return regions.sessions(S.longest_only(V.text_mems(spark, d)), 20)


@query(f"with {_SESSIONS} select * from reg")
def region_coverage(spark, d):
    return _regions(spark, d)


@query(f"with {_SESSIONS} select * from rk2")
def region_rank(spark, d):
    return regions.ranked(_regions(spark, d))


@query(
    f"""with {_SESSIONS} select r.* from rk2 r join rk2 b on b.read_id = r.read_id and b.rank = 1 where r.rank > 1 and (r.q_end <= b.q_begin or r.q_begin >= b.q_end)"""
)
def region_overlap_anti(spark, d):
    return regions.apart_from_best(regions.ranked(_regions(spark, d)))


@query(
    f"""with {V.MEMS}, gr as (select read_id, qpos, len, qpos + len as e, count(*) as n from mems group by all),
  nw as (select *, coalesce(e > lag(e) over (partition by read_id order by qpos, len desc), true) as fresh from gr),
  bl as (select *, sum(fresh::int) over (partition by read_id order by qpos, len desc) as block from nw),
  rn as (select *, sum(n) over (partition by read_id, block order by qpos, len desc) as running from bl)
  select m.read_id, m.contig_id, m.qpos, m.rpos, m.len, (fresh and running <= 3) or (running <= 5 and m.len >= 50) as chosen from mems m join rn using (read_id, qpos, len)"""
)
def seed_triage(spark, d):
    return regions.triage(V.text_mems(spark, d), 3, 5, 50).select("read_id", "contig_id", "qpos", "rpos", "len", "chosen")


@query(f"with {_SESSIONS} select read_id, contig_id, covered, ref_begin, ref_end, q_begin, q_end from rk2 where rank = 1")
def best_hit_topk(spark, d):
    """The flagship: the reference passage that covers most of each document."""
    return regions.ranked(_regions(spark, d)).where("rank = 1").select("read_id", "contig_id", "covered", "ref_begin", "ref_end", "q_begin", "q_end")


@query(
    f"""with {_SESSIONS}, f as (select *, max(covered) over (partition by read_id) as best, max(case when rank = 2 then covered end) over (partition by read_id) as second from rk2)
  select read_id, contig_id, region, covered, rank, covered <> best as secondary, case when covered = best then case when best <= coalesce(second, -2000) then 0
   else greatest(0, least(60, floor((best - coalesce(second, -2000)) * 250.0::double / best + 0.499::double))) end else 0 end::bigint as mapq from f"""
)
def mapq(spark, d):
    rows = _regions(spark, d).withColumn("score", F.col("covered")).withColumn("length", F.lit(500))
    rows = post.with_mapq(rows, "length", -4, ["contig_id", "ref_begin", "region"])
    return rows.select("read_id", "contig_id", "region", "covered", "rank", "secondary", "mapq")


@query(f"with {_SESSIONS} select d.doc_id as read_id, case when r.read_id is null then 4 else 0 end::bigint as flag, contig_id, covered from documents d left join rk2 r on r.read_id = d.doc_id and r.rank = 1")
def unmapped_left(spark, d):
    best = regions.ranked(_regions(spark, d)).where("rank = 1").select("read_id", F.lit(0).cast("long").alias("flag"), "contig_id", "covered")
    return post.with_unmapped(V.reads_text(spark, d).select("read_id"), best)


# --- SAM rows and evaluation ---------------------------------------------------------------------

_LINE = "concat_ws(chr(9), raw_name, flag, rname, pos, mapq, cigar, rnext, 0, 0, '*', '*', 'NM:i:' || edits)"


@query(f"with {V.SAM} select {_LINE} as line, count(*) as n from sam group by all")
def sam_rows(spark, d):
    rows = V.sam_like(spark, d).withColumns({"qname": F.col("raw_name"), "pnext": F.lit(0), "tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*"), "nm": F.col("edits")})
    return post.sam_line(rows).groupBy("line").agg(F.count("*").alias("n"))


@query(f"with {V.SAM} select qname, flag, rname, pos, mapq, edits, pos - l_suppkey % 7 as \"left\" from sam")
def sam_parse(spark, d):
    """SAM text read back."""
    rows = V.sam_like(spark, d).withColumns({"qname": F.col("raw_name"), "pnext": F.lit(0), "tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*"), "nm": F.col("edits")})
    return parse_sam(post.sam_line(rows), "line").select("qname", "flag", "rname", "pos", "mapq", "edits", "left")


_LEVELS = """lv as (select *, unnest(['all', 'unique', 'mapq>=10', 'mapq>=30']) as level from (select *, count(*) over (partition by qname) as n from kept)),
  picked as (select * from lv where level = 'all' or (level = 'unique' and n <= {most}) or (level = 'mapq>=10' and mapq >= 10) or (level = 'mapq>=30' and mapq >= 30))"""


@query(
    f"""with {V.SAM}, kept as (select * from sam where flag <> 4), {_LEVELS.format(most=1)}
  select level, count_if(flag & 4 = 0)::bigint as mapped, count_if(rnext <> '*')::bigint as paired, count_if(flag & 2 <> 0)::bigint as paired_correct, count_if(flag & 256 <> 0)::bigint as secondary,
  count(distinct qname) as reads, (100 * count(distinct qname) // (select count(distinct qname) from sam))::bigint as pct_reads from picked group by level"""
)
def eval_summary(spark, d):
    return E.summary(V.sam_like(spark, d), [10, 30])


@query(f"with {V.SAM}, c as (select qname, least(count(*), 101) as alignments from sam where flag <> 4 group by qname) select alignments, count(*) as reads from c group by alignments")
def eval_histogram(spark, d):
    return E.histogram(V.sam_like(spark, d))


_TALLY = """rd as (select {by}, qname, max(verdict) as best, count_if(verdict = 2) as g, count_if(verdict = 1) as o, count(*) as n from v group by {by}, qname)
  select {by}, sum(g)::bigint as correct, sum(o)::bigint as ok, sum(n - g - o)::bigint as incorrect, count_if(best = 2)::bigint as reads_correct, count_if(best = 1)::bigint as reads_ok,
  count_if(best = 0)::bigint as reads_incorrect, (100 * sum(g) // sum(n))::bigint as pct_correct from rd group by {by}"""


@query(
    f"""with {V.SAM}, {V.TRUTH}, kept as (select * from sam where flag & 4 = 0), {_LEVELS.format(most=1)},
  w as (select p.*, t.flag as tf, t.rname as tr, t.pos as tp, t.edits as te, unnest([50, 300])::int as "window" from picked p join truth t using (qname)),
  v as (select *, case when rname = tr and flag & 16 = tf & 16 and abs(pos - tp) <= "window" then 2 when edits >= 0 and edits <= te then 1 else 0 end as verdict from w),
  {_TALLY.format(by='"window", level')}"""
)
def eval_truth_windows(spark, d):
    return E.against_truth(V.truth_like(spark, d), V.sam_like(spark, d), [50, 300], [10, 30])


@query(
    f"""with {V.SIMULATED}, kept as (select * from origin where flag & 4 = 0), {_LEVELS.format(most=2)}, w as (select *, unnest([20, 50])::int as "window" from picked),
  v as (select *, case when rname = contig and (case when flag & 16 <> 0 then least(abs("right" - rev_pos), abs(right0 - rev_pos)) else least(abs("left" - fwd_pos), abs(left0 - fwd_pos)) end) <= "window" then 2
    when edits >= 0 and edits <= (case when flag & 16 <> 0 then rev_edits else fwd_edits end) then 1 else 0 end as verdict from w), {_TALLY.format(by='"window", level')}"""
)
def eval_wgsim(spark, d):
    rows = V.simulated(spark, d).withColumn("o", Q.simulated_origin("qname")).select("*", "o.contig", "o.fwd_pos", "o.rev_pos", "o.fwd_edits", "o.rev_edits")
    return E.against_names(rows, [20, 50], [10, 30])


def _paired_truth(spark, d):
    """Two mates of every order as truth, and alignments of them."""
    o = V.table(spark, d, "orders")
    mate = F.explode(F.array(F.lit(1), F.lit(2)))
    truth = o.select("o_orderkey", "o_custkey", mate.alias("m")).select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"), F.when(F.col("m") == 1, 99).otherwise(147).cast("long").alias("flag"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("rname"), (F.col("o_custkey") % 1000 + 1).alias("pos"), F.lit("=").alias("rnext"), (F.col("o_orderkey") % 5).alias("edits"),
    )
    times = F.explode(F.expr("sequence(1, cast(1 + o_orderkey % 2 as int))"))
    sam = o.select("o_orderkey", "o_custkey", times.alias("t")).select("*", mate.alias("m")).select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"),
        F.when((F.col("o_custkey") + F.col("m")) % 7 == 0, 4).when(F.col("m") == 1, 99).otherwise(F.when(F.col("o_custkey") % 3 == 0, 403).otherwise(147)).cast("long").alias("flag"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("rname"), (F.col("o_custkey") % 1000 + 1 + F.col("o_orderkey") % 120 * F.col("t")).alias("pos"),
        F.when(F.col("o_orderkey") % 13 == 0, "c9").otherwise("=").alias("rnext"), (F.col("o_custkey") % 61).alias("mapq"), (F.col("o_orderkey") % 9 - 1).alias("edits"),
    )
    return truth, sam


_PAIRED_TRUTH = """ptruth as (select 'r' || o_orderkey as qname, m, case when m = 1 then 99 else 147 end as flag, 'c' || (o_custkey % 5) as rname, o_custkey % 1000 + 1 as pos, '=' as rnext, o_orderkey % 5 as edits
    from (select *, unnest([1, 2]) as m from orders)),
  psam as (select 'r' || o_orderkey as qname, case when (o_custkey + m) % 7 = 0 then 4 when m = 1 then 99 when o_custkey % 3 = 0 then 403 else 147 end as flag, 'c' || (o_custkey % 5) as rname,
    o_custkey % 1000 + 1 + o_orderkey % 120 * t as pos, case when o_orderkey % 13 = 0 then 'c9' else '=' end as rnext, o_custkey % 61 as mapq, o_orderkey % 9 - 1 as edits
    from (select *, unnest([1, 2]) as m from (select *, unnest(range(1, 2 + o_orderkey % 2)) as t from orders))),
  kept as (select *, case when flag & 64 <> 0 then 1 else 2 end as m from psam where flag & 4 = 0),
  lv as (select *, unnest(['all', 'unique', 'mapq>=30']) as level from (select *, count(*) over (partition by qname) as n from kept)),
  picked as (select * from lv where level = 'all' or (level = 'unique' and n = 2) or (level = 'mapq>=30' and mapq >= 30)),
  w as (select p.*, t.flag as tf, t.rname as tr, t.pos as tp, t.rnext as tn, t.edits as te, unnest([50, 100])::int as "window" from picked p join ptruth t using (qname, m)),
  v as (select *, case when rname = tr and flag & 127 = tf & 127 and abs(pos - tp) <= "window" and rnext = tn then 2 when edits >= 0 and edits <= te then 1 else 0 end as verdict from w)"""


@query(f"""with {_PAIRED_TRUTH}, {_TALLY.format(by='"window", level')}""")
def eval_paired(spark, d):
    return E.against_truth(*_paired_truth(spark, d), [50, 100], [30], paired=True)


@query(
    f"""with {_PAIRED_TRUTH}, q as (select distinct qname, unnest([50, 100])::int as "window" from ptruth),
  f as (select qname, "window", max(least(verdict, 1)) as found from v where level = 'all' group by all) select q.qname, q."window", coalesce(found, 0)::int as found from q left join f using (qname, "window")"""
)
def eval_per_read(spark, d):
    return E.per_read(*_paired_truth(spark, d), [50, 100], paired=True)


@query(
    f"""with {V.SAM}, e as (select *, pos + l_partkey % 40 + 10 + l_linenumber + l_partkey % 20 + 5 + 12 + l_orderkey % 4 + 1 + 30 - 1 as re, l_suppkey % 7 as lc, case when l_suppkey % 3 = 0 then 9 else 0 end as rc from sam)
  select qname, pos, cigar, pos - lc as "left", re + rc as "right", pos - rc as left0, re + lc as right0 from e"""
)
def clip_swapped(spark, d):
    return V.sam_like(spark, d).select("qname", "pos", "cigar", *(c.alias(n) for n, c in Q.clipped_places(F.col("pos"), "cigar").items()))


@query(f"with {V.SAM}, c as (select qname, least(count(*), 101) as alignments from sam where flag <> 4 group by qname) select concat_ws(chr(9), alignments, count(*)) as line from c group by alignments")
def report_rows(spark, d):
    """The histogram as lines of a report."""
    return report_lines(E.histogram(V.sam_like(spark, d)), ["alignments", "reads"])


@query(f"with {V.SAM} select count(distinct qname) as sequences, count(distinct case when flag & 4 = 0 then qname end) as mapped, count_if(flag & 4 = 0)::bigint as alignments from sam")
def run_stats(spark, d):
    return E.run_statistics(V.sam_like(spark, d))


# --- pairing -------------------------------------------------------------------------------------

_MATES = f"{V.mates_sql('m1', 1)}, {V.mates_sql('m2', 2)}"
_PAIRS = _MATES + """, pr as (select a.read_id, a.contig as a_contig, a.start as a_start, a."end" as a_end, a.reverse as a_reverse, a.score as a_score,
   b.contig as b_contig, b.start as b_start, b."end" as b_end, b.reverse as b_reverse, b.score as b_score from m1 a join m2 b using (read_id)),
  lr as (select *, case when not a_reverse then a_start else b_start end as ls, case when not a_reverse then b_end else a_end end as re, case when not a_reverse then b_start else a_start end as rs,
   greatest(a_end, b_end) - least(a_start, b_start) + 1 as span from pr),
  conc as (select * exclude (ls, re, rs, span) from lr where a_contig = b_contig and a_reverse <> b_reverse and re > ls and span between 0 and 1000 and ls <= rs)"""


@query(f"with {_PAIRS} select * from conc")
def pair_concordant(spark, d):
    return P.concordant_pairs(V.mates(spark, d, 1), V.mates(spark, d, 2), PairParams())


@query(
    f"""with {_PAIRS}, x as (select * from m1 where read_id not in (select read_id from conc)), y as (select * from m2 where read_id not in (select read_id from conc)),
  bx as (select * from (select *, max(score) over (partition by read_id) as m from x) where score = m), bz as (select * from (select *, max(score) over (partition by read_id) as m from y) where score = m)
  select a.read_id, a.contig as a_contig, a.start as a_start, a."end" as a_end, a.reverse as a_reverse, a.score as a_score,
   b.contig as b_contig, b.start as b_start, b."end" as b_end, b.reverse as b_reverse, b.score as b_score from bx a join bz b using (read_id)"""
)
def pair_discordant(spark, d):
    one, two = V.mates(spark, d, 1), V.mates(spark, d, 2)
    return P.discordant_pairs(one, two, P.concordant_pairs(one, two, PairParams()))


_TLEN = """case when (case when a_reverse then a_end else a_start end) > (case when b_reverse then b_end else b_start end) then -1 else 1 end * (greatest(a_end, b_end) - least(a_start, b_start) + 1)"""


@query(f"with {_PAIRS} select read_id, a_start, b_start, ({_TLEN})::bigint as tlen from pr")
def tlen(spark, d):
    rows = P.joined_mates(V.mates(spark, d, 1), V.mates(spark, d, 2))
    c = F.col
    return rows.select("read_id", "a_start", "b_start", Q.template_length(c("a_start"), c("a_end"), c("b_start"), c("b_end"), c("a_reverse"), c("b_reverse")).alias("tlen"))


@query(
    f"""with {_PAIRS}, sl as (select *, span, (1 + read_id % 5) + (1 + read_id % 7) as slack from lr)
  select read_id, a_contig, a_start as a_begin, a_end as a_until, b_start as b_begin, b_end as b_until from sl
  where a_contig = b_contig and a_reverse <> b_reverse and re > ls and span + slack >= 100 and span - slack <= 600 and ls <= rs + slack"""
)
def pair_regions(spark, d):
    """Regions of both mates that may hold a concordant pair, errors allowed for."""
    side = lambda n, m: V.mates(spark, d, n).withColumnsRenamed({"start": "begin", "end": "until"}).withColumn("edits", 1 + F.col("read_id") % m)
    rows = P.joined_mates(side(1, 5), side(2, 7)).where(P.concordant_regions(PairParams(100, 600)))
    return rows.select("read_id", "a_contig", "a_begin", "a_until", "b_begin", "b_until")


@query(
    f"""with {_MATES}, r as (select read_id, contig, reverse, start as "begin", "end" as until, score from m2)
  select * from r where not exists (select 1 from m1 where m1.read_id = r.read_id and m1.contig = r.contig and m1.reverse = r.reverse and m1."end" >= r."begin" and m1.start <= r.until)"""
)
def region_alignment_anti(spark, d):
    rows = V.mates(spark, d, 2).withColumnsRenamed({"start": "begin", "end": "until"}).select("read_id", "contig", "reverse", "begin", "until", "score")
    return regions.apart_from(rows, V.mates(spark, d, 1))


_WINDOWS = _MATES + """, wn as (select read_id, contig, start, "end", reverse, not reverse as wanted, score,
  greatest(0, case when not reverse then greatest(start, start) else "end" - 1000 - 100 end)::bigint as low0, 0 as z from m1),
  ww as (select read_id, contig, start, "end", not reverse as wanted, greatest(0, case when not reverse then greatest(start + 0 - 100, start) else "end" - 1000 end)::bigint as low,
   (case when not reverse then start + 1000 else least("end" - 0 + 100, "end") end)::bigint as high, dense_rank() over (partition by read_id order by start, "end", contig, reverse, score) as window_id from m1)"""


def _windows(spark, d):
    one = V.mates(spark, d, 1)
    c = F.col
    wanted, low, high = P.mate_window(c("start"), c("end"), c("reverse"), F.lit(100), F.lit(False), PairParams())
    place = F.dense_rank().over(Window.partitionBy("read_id").orderBy("start", "end", "contig", "reverse", "score")).cast("long")
    return one.select("read_id", "contig", "start", "end", wanted.alias("wanted"), low.alias("low"), high.alias("high"), place.alias("window_id"))


@query(f"with {_WINDOWS} select * from ww")
def pair_window(spark, d):
    return _windows(spark, d)


@query(
    f"""with {_WINDOWS} select read_id, window_id, contig, low, high, m_start, m_end, m_score from (select w.*, m.start as m_start, m."end" as m_end, m.score as m_score,
  row_number() over (partition by w.read_id, w.window_id order by m.score desc, m.start, m."end") as n from (select distinct * exclude (start, "end") from ww) w join m2 m
  on m.read_id = w.read_id and m.contig = w.contig and m.reverse = w.wanted and m.start >= w.low and m."end" <= w.high) where n = 1"""
)
def pair_best_in_window(spark, d):
    rows = P.best_in_window(_windows(spark, d).drop("start", "end").distinct(), V.mates(spark, d, 2))
    return rows.select("read_id", "window_id", "contig", "low", "high", "m_start", "m_end", "m_score")


@query(
    """with a as (select page_id as ordinal, url as name from pages), b as (select doc_id as ordinal, source as name from documents)
  select ordinal, a.name as a_name, b.name as b_name from a join b using (ordinal)"""
)
def paired_zip(spark, d):
    one = V.table(spark, d, "pages").select(F.col("page_id").alias("ordinal"), F.col("url").alias("name"))
    two = V.table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("name"))
    return P.zipped(one, two)


# --- kernels -------------------------------------------------------------------------------------


def _neighbours(spark, d):
    rows = V.contigs_dna(spark, d)
    other = rows.select((F.col("contig_id") - 1).alias("contig_id"), F.col("seq").alias("b"))
    return rows.select("contig_id", F.col("seq").alias("a")).join(other, "contig_id")


@query(
    f"""with b as (select item_id, {V.dna_sql('text')} as s from benchmark) select a.item_id as contig_id, levenshtein(a.s, b.s)::bigint as edits
  from b a join b on b.item_id = a.item_id + 1"""
)
def cigar_trace(spark, d):
    """Edit distances by the traceback kernel with unit costs."""
    rows = A.trace_rows(_neighbours(spark, d), 0, -1, 0, 1)
    gaps = Q.cigar_length("x0", "XID")
    return rows.select("contig_id", gaps.alias("edits"))


#: Costs of the kernels' queries: match, mismatch, gap opening and extension; band and drop of the extension.
_MATCH, _MISMATCH, _OPEN, _EXTEND, _BAND, _DROP, _START = 1, -4, 6, 1, 9, 12, 20
_LOW = -1_000_000


def _short_pairs(spark, d):
    """The start of every passage with each seventh letter changed and two missing, and the start as it is."""
    rows = V.contigs_dna(spark, d)
    read = F.concat(F.regexp_replace(F.expr("left(seq, 24)"), "(.{6})[cgt]", "$1a"), F.expr("substring(seq, 27, 18)"))
    return rows.select("contig_id", read.alias("a"), F.expr("left(seq, 46)").alias("b"))


_SHORT = f"""pairs as (select item_id as contig_id, regexp_replace(left(s, 24), '(.{{6}})[cgt]', '\\1a', 'g') || substr(s, 27, 18) as a, left(s, 46) as b
    from (select item_id, {V.dna_sql('text')} as s from benchmark))"""


def _sweep_sql(kind: str) -> str:
    """Affine dynamic programming over ``pairs``, one query letter a step: table dp with i, h (scores by reference
    column) and what ``kind`` (global, local, extension) keeps of earlier rows."""
    low, far = _LOW, f"{_OPEN} + {_EXTEND} * (j - 1)"
    start = {"global": f"case when j = 1 then 0 else -({far}) end", "local": "0", "extension": f"case when j = 1 then {_START} when j - 1 <= {_BAND} and {_START} - ({far}) > 0 then {_START} - ({far}) else {low} end"}[kind]
    inside = f"abs(j - 1 - (i + 1)) <= {_BAND}" if kind == "extension" else "true"
    came = "h[j - 1]" if kind != "extension" else f"(case when h[j - 1] > 0 then h[j - 1] else {low} end)"
    floor = "0" if kind == "local" else str(low)
    alive = f"case when x <= 0 then {low} else x end" if kind == "extension" else "x"
    kept = {
        "global": ("0 as best, 0 as best_q, 0 as best_r, false as done", "0, 0, 0, false"),
        "local": ("0 as best, 0 as best_q, 0 as best_r, false as done", "greatest(best, list_max(nh)), 0, 0, false"),
        "extension": (
            f"{_START} as best, 0 as best_q, 0 as best_r, false as done",
            f"""case when top > best then top else best end, case when top > best then i + 1 else best_q end, case when top > best then peak - 1 else best_r end,
              top <= 0 or (top <= best and best - top - {_EXTEND} * abs((peak - 1 - best_r) - (i + 1 - best_q)) > {_DROP})""",
        ),
    }[kind]
    return f"""dp as (
      select contig_id, a, b, 0 as i, list_transform(range(1, length(b) + 2), lambda j: {start}) as h, list_transform(range(1, length(b) + 2), lambda j: {low}) as v, {kept[0]} from pairs
      union all
      select contig_id, a, b, i + 1, nh, nv, {kept[1]} from (
        select *, list_max(nh) as top, list_position(nh, list_max(nh)) as peak from (
          select *, list_transform(full_row, lambda x: {alive}) as nh from (
            select *, list_transform(range(1, length(b) + 2), lambda j: case when {inside} then greatest(r0[j], case when j > 1 then
                list_max(list_transform(range(1, j), lambda l: r0[l] + {_EXTEND} * l)) - {_OPEN} - {_EXTEND} * j else {low} end) else {low} end) as full_row from (
              select *, list_transform(range(1, length(b) + 2), lambda j: case when {inside} then greatest({floor}, nv[j], case when j > 1 then
                  {came} + case when substr(a, i + 1, 1) = substr(b, (j - 1)::int, 1) then {_MATCH} else {_MISMATCH} end else {low} end) else {low} end) as r0 from (
                select *, list_transform(range(1, length(b) + 2), lambda j: case when {inside} then greatest(h[j] - {_OPEN}, v[j]) - {_EXTEND} else {low} end) as nv
                from dp where i < length(a) and not done))))))"""


@query(f"with recursive {_SHORT}, {_sweep_sql('global')} select contig_id, h[length(b) + 1]::bigint as score from dp where i = length(a)")
def global_scores(spark, d):
    """End-to-end scores with affine gaps."""
    return A.kernel_rows(_short_pairs(spark, d), lambda a, b: (K.score_global(a, b, _MATCH, _MISMATCH, _OPEN, _EXTEND),), "score long").drop("a", "b")


@query(f"with recursive {_SHORT}, {_sweep_sql('local')} select contig_id, max(best)::bigint as score from dp group by contig_id")
def local_scores(spark, d):
    """Best local scores with affine gaps."""
    return A.kernel_rows(_short_pairs(spark, d), lambda a, b: K.align_local(a, b, _MATCH, _MISMATCH, _OPEN, _EXTEND)[:1], "score long").drop("a", "b")


@query(
    f"""with recursive {_SHORT}, {_sweep_sql('extension')}, z as (select *, row_number() over (partition by contig_id order by i desc) as n from dp)
  select contig_id, best::bigint as best, best_q::bigint as best_q, best_r::bigint as best_r, (case when i = length(a) and not done then list_max(h) else -1 end)::bigint as whole,
  (case when i = length(a) and not done then list_position(h, list_max(h)) - 1 else 0 end)::bigint as whole_r from z where n = 1"""
)
def extend_scores(spark, d):
    """Extension of a seed of score 20 in a band, until its score falls too far."""
    extension = lambda a, b: K.extend_from(a, b, _START, _MATCH, _MISMATCH, _OPEN, _EXTEND, _BAND, _DROP)
    return A.kernel_rows(_short_pairs(spark, d), extension, "best long, best_q long, best_r long, whole long, whole_r long").drop("a", "b")


def _rle_sql(source: str, name: str) -> str:
    """Table ``name`` (id, part, x0, nm): where the strings a and b (of one length) of ``source`` (id, part, a, b) agree, as CIGAR."""
    return f"""{name}_l as (select id, part, p, substr(a, p::int, 1) = substr(b, p::int, 1) as same from (select *, unnest(range(1, length(a) + 1)) as p from {source})),
  {name}_g as (select *, p - row_number() over (partition by id, part, same order by p) as g from {name}_l),
  {name}_r as (select id, part, same, min(p) as p, count(*) as n from {name}_g group by id, part, same, g),
  {name} as (select id, part, string_agg(n || case when same then '=' else 'X' end, '' order by p) as x0, coalesce(sum(n) filter (where not same), 0)::bigint as nm from {name}_r group by id, part)"""


@query()
def align_local(spark, d):
    """Every document's best local placement on the folded passages, both strands."""
    return A.align(V.reads_dna(spark, d), V.contigs_dna(spark, d), AlignParams(local=True, min_coverage=0.0))


def _passages(spark, d):
    """Every passage as a read, as it stands or reversed, with every 40th base changed."""
    rows = V.contigs_dna(spark, d).select(F.col("contig_id").alias("read_id"), "seq")
    changed = F.regexp_replace("seq", "(.{39})[acg]", "$1t")
    return rows.withColumn("seq", F.when(F.col("read_id") % 2 == 0, changed).otherwise(Q.reverse_complement(changed)))


_PASSAGES = f"b0 as (select item_id, {V.dna_sql('text')} as s from benchmark), pa as (select item_id as id, 1 as part, regexp_replace(s, '(.{{39}})[acg]', '\\1t', 'g') as a, s as b from b0)"


@query(
    f"""with {_PASSAGES}, {_rle_sql('pa', 'pr')} select id as read_id, (id % 2 * 16)::bigint as flag, id as contig_id, 1::bigint as pos, 60::bigint as mapq, length(a) || 'M' as cigar,
  (length(a) - 5 * nm)::bigint as score, nm, x0, 1 as rank from pr join pa using (id)"""
)
def align_single(spark, d):
    return A.align(_passages(spark, d), V.contigs_dna(spark, d), AlignParams(error_rate=0.1), k=16)


_CUT = f"""{_PASSAGES}, mm as (select id, a, b, list_max(list_filter(range(1, length(a) + 1), lambda p: substr(a, p::int, 1) <> substr(b, p::int, 1))) as last from pa),
  ct as (select id, 1 as part, a, b, length(a) as n, case when last is not null and length(a) - last <= 4 then last - 1 else length(a) end as cut from mm),
  cp as (select id, part, left(a, cut::int) as a, left(b, cut::int) as b from ct)"""


@query(
    f"""with {_CUT}, {_rle_sql('cp', 'cr')} select id as read_id, (id % 2 * 16)::bigint as flag, id as contig_id, 1::bigint as pos, 60::bigint as mapq, '30S' || cut || 'M' || (30 + n - cut) || 'S' as cigar,
  (cut - 5 * nm)::bigint as score, nm, '30S' || x0 || (30 + n - cut) || 'S' as x0, 1 as rank from cr join ct using (id)"""
)
def align_clipped(spark, d):
    """Changed passages between 30 unknown bases on either side, local: what doesn't pay is clipped."""
    rows = _passages(spark, d).withColumn("seq", F.concat(F.lit("n" * 30), "seq", F.lit("n" * 30)))
    return A.align(rows, V.contigs_dna(spark, d), AlignParams(local=True, min_coverage=0.0), k=16)


def _indel_rows(spark, d):
    """Alignments of the first 100 bases of every passage, changed, with two bases more and three fewer."""
    rows = V.contigs_dna(spark, d).where("length(seq) >= 100")
    changed = lambda a, n: F.regexp_replace(F.expr(f"substring(seq, {a}, {n})"), "(.{8})[acg]", "$1t")
    seq = F.concat(F.lit("GG"), changed(1, 50), F.lit("nn"), changed(51, 20), changed(74, 27))
    return rows.select("contig_id", F.lit(1).cast("long").alias("pos"), F.lit("2S50M2I20M3D27M4H").alias("cigar"), seq.alias("seq"))


_INDELS = f"""b0 as (select item_id as id, {V.dna_sql('text')} as s from benchmark), b1 as (select * from b0 where length(s) >= 100),
  seg as (select id, part, regexp_replace(b, '(.{{8}})[acg]', '\\1t', 'g') as a, b from (select id, unnest([1, 2, 3]) as part, unnest([substr(s, 1, 50), substr(s, 51, 20), substr(s, 74, 27)]) as b from b1))"""


@query(
    f"""with {_INDELS}, {_rle_sql('seg', 'sr')} select id as contig_id, (sum(nm) + 5)::bigint as edits,
  '2S' || max(x0) filter (where part = 1) || '2I' || max(x0) filter (where part = 2) || '3D' || max(x0) filter (where part = 3) || '4H' as x0 from sr group by id"""
)
def cigar_walk(spark, d):
    """Edits and =/X CIGARs of alignments that have neither, from their sequences."""
    return A.walk_cigars(_indel_rows(spark, d), V.contigs_dna(spark, d), 4096).select("contig_id", "edits", "x0")


def _ends(spark, d):
    """Both ends of every passage as mates, and the passages."""
    rows = V.contigs_dna(spark, d)
    third = "cast(floor(length(seq) / 3) as int)"
    one = rows.select(F.col("contig_id").alias("read_id"), F.expr(f"left(seq, {third})").alias("seq"))
    two = rows.select(F.col("contig_id").alias("read_id"), Q.reverse_complement(F.expr(f"right(seq, {third})")).alias("seq"))
    return one, two, rows


def _paired(mode: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: align_pairs(*_ends(spark, d), AlignParams(error_rate=0.1), PairParams(max_insert=2000, mode=mode), 16)


_PAIRED = f"""with b0 as (select item_id as id, length({V.dna_sql('text')}) as n from benchmark), m as (select *, n // 3 as t, unnest([1, 2]) as mate from b0)
  select id as read_id, mate::bigint as mate, case when mate = 1 then 99 else 147 end::bigint as flag, id as contig_id, (case when mate = 1 then 1 else n - t + 1 end)::bigint as pos, 60::bigint as mapq,
  t || 'M' as cigar, id as mate_contig_id, (case when mate = 1 then n - t + 1 else 1 end)::bigint as mate_pos, (case when mate = 1 then n else -n end)::bigint as tlen,
  t::bigint as score, 0::bigint as nm, t || '=' as x0, 1::bigint as rank from m"""
for _mode in range(1, 7):
    _name = "align_paired" if _mode == 1 else f"align_paired_mode{_mode}"
    _QUERIES[_name], _SQL[_name] = _paired(_mode), _PAIRED


@query(
    f"""with b0 as (select item_id as id, {V.dna_sql('text')} as s from benchmark), m as (select id, least(length(s) // 3, length(s) - 19)::bigint as n from b0)
  select id as read_id, n as score, 0::bigint as q_start, n as q_end, 19::bigint as r_start, 19 + n as r_end, n || '=' as x0 from m"""
)
def window_rescue(spark, d):
    """Local alignment of a third of every passage inside the whole."""
    rows = V.contigs_dna(spark, d)
    mates = rows.select(F.col("contig_id").alias("read_id"), F.expr("substring(seq, 20, cast(length(seq) / 3 as int))").alias("seq"), F.col("seq").alias("ref"))
    return A.window_rescue(mates, AlignParams()).drop("seq", "ref")
