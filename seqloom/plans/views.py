"""Sequence and alignment views over the warehouse tables, as DataFrames and as SQL of an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import FOLDED, LETTERS, fold_to_bases
from ..operators import seeds as S

K = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))


def contigs_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("contig_id"), F.col("text").alias("seq"))


def reads_dna(spark: SparkSession, d: str) -> DataFrame:
    return reads_text(spark, d).withColumn("seq", fold_to_bases("seq"))


def contigs_dna(spark: SparkSession, d: str) -> DataFrame:
    return contigs_text(spark, d).withColumn("seq", fold_to_bases("seq"))


def text_mems(spark: SparkSession, d: str) -> DataFrame:
    return S.mems(S.hits(reads_text(spark, d), contigs_text(spark, d), K), K)


def dna_sql(text: str) -> str:
    return f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), '{LETTERS}', '{FOLDED}')"


_STEP = 256
MEMS = f"""
q as (select doc_id as read_id, substr(text, c + 1, {_STEP + K - 1}) as t, c
  from (select doc_id, text, unnest(range(0, greatest(length(text) - {K - 1}, 0), {_STEP})) as c from documents)),
qk as (select read_id, c + i as qpos, substr(t, i + 1, {K}) as k
  from (select read_id, t, c, unnest(range(0, least({_STEP}, length(t) - {K - 1}))) as i from q)),
rk as (select item_id as contig_id, i as rpos, substr(text, i + 1, {K}) as k
  from (select item_id, text, unnest(range(0, greatest(length(text) - {K - 1}, 0))) as i from benchmark)),
hits as (select read_id, contig_id, qpos, rpos from qk join rk using (k)),
mems as (select read_id, contig_id, min(qpos)::int as qpos, min(rpos)::int as rpos, (count(*) + {K - 1})::int as len
  from (select *, rpos - qpos as d, qpos - row_number() over (partition by read_id, contig_id, rpos - qpos order by qpos) as g from hits)
  group by read_id, contig_id, d, g)"""
SMEMS = (
    MEMS
    + """,
smems as (select read_id, contig_id, qpos, rpos, len from (select *, max(qpos + len) over (partition by read_id order by qpos
  range between unbounded preceding and current row) as top from mems) where qpos + len >= top)"""
)


def sam_like(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    flag = F.element_at(F.array(*(F.lit(x) for x in (4, 0, 16, 99, 147, 256))), (F.col("l_linenumber") % 6 + 1).cast("int")).cast("long")
    clipped = F.col("l_suppkey") % 7
    cigar = F.concat(
        F.when(clipped > 0, F.concat(clipped.cast("string"), F.lit("S"))).otherwise(""), (F.col("l_partkey") % 40 + 10).cast("string"), F.lit("="),
        F.col("l_linenumber").cast("string"), F.lit("X"), (F.col("l_partkey") % 20 + 5).cast("string"), F.lit("M2I12="),
        (F.col("l_orderkey") % 4 + 1).cast("string"), F.lit("D30="), F.when(F.col("l_suppkey") % 3 == 0, "9S").otherwise(""),
    )
    return li.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "/1").otherwise("")).alias("raw_name"),
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("qname"),
        flag.alias("flag"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("rname"),
        (F.col("l_partkey") % 1000 + 1).alias("pos"),
        (F.floor("l_quantity") % 61).cast("long").alias("mapq"),
        cigar.alias("cigar"),
        F.when(flag.bitwiseAND(1) != 0, "=").otherwise("*").alias("rnext"),
        (F.col("l_partkey") % 7 - 1).alias("edits"),
    )


SAM = """
s0 as (select *, [4, 0, 16, 99, 147, 256][(l_linenumber % 6 + 1)::int]::bigint as flag from lineitem),
sam as (select 'r' || l_orderkey || case when l_linenumber % 2 = 0 then '/1' else '' end as raw_name, 'r' || l_orderkey as qname, flag, 'c' || (l_suppkey % 5) as rname,
  l_partkey % 1000 + 1 as pos, floor(l_quantity)::bigint % 61 as mapq,
  case when l_suppkey % 7 > 0 then (l_suppkey % 7) || 'S' else '' end || (l_partkey % 40 + 10) || '=' || l_linenumber || 'X' || (l_partkey % 20 + 5) || 'M2I12='
    || (l_orderkey % 4 + 1) || 'D30=' || case when l_suppkey % 3 = 0 then '9S' else '' end as cigar,
  case when flag & 1 <> 0 then '=' else '*' end as rnext, l_partkey % 7 - 1 as edits, l_partkey, l_suppkey, l_orderkey, l_linenumber from s0)"""


def truth_like(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("qname"),
        (F.col("o_custkey") % 2 * 16).alias("flag"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")).alias("rname"),
        (F.col("o_custkey") % 1000 + 1).alias("pos"),
        (F.col("o_orderkey") % 5).alias("edits"),
    )


TRUTH = """
truth as (select 'r' || o_orderkey as qname, o_custkey % 2 * 16 as flag, 'c' || (o_custkey % 5) as rname, o_custkey % 1000 + 1 as pos, o_orderkey % 5 as edits from orders)"""


def mates(spark: SparkSession, d: str, number: int) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_linenumber") == number)
    start = F.col("l_partkey") % 2000
    return li.select(
        F.col("l_orderkey").alias("read_id"),
        (F.col("l_suppkey") % 2).alias("contig"),
        start.alias("start"),
        (start + F.col("l_suppkey") % 100 + 20).alias("end"),
        ((F.col("l_orderkey") + F.col("l_partkey")) % 2 == 1).alias("reverse"),
        F.floor("l_quantity").cast("long").alias("score"),
    )


def mates_sql(name: str, number: int) -> str:
    return f"""
{name} as (select l_orderkey as read_id, l_suppkey % 2 as contig, l_partkey % 2000 as start, l_partkey % 2000 + l_suppkey % 100 + 20 as "end",
  (l_orderkey + l_partkey) % 2 = 1 as reverse, floor(l_quantity)::bigint as score from lineitem where l_linenumber = {number})"""


def simulated(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of simulated reads: qname with the origin in it, flag, rname, left, right, mapq, edits."""
    o = table(spark, d, "orders")
    s = lambda c: c.cast("string")
    fwd, rev = F.col("o_custkey") % 1000 + 1, F.col("o_custkey") % 1000 + 300
    e = [F.col("o_orderkey") % 3, F.col("o_orderkey") % 2, F.lit(0), F.col("o_custkey") % 4, F.lit(1), F.col("o_custkey") % 2]
    name = F.concat(
        F.lit("ctg_"), s(F.col("o_custkey") % 5), F.lit("_"), s(fwd), F.lit("_"), s(rev), F.lit("_"), s(e[0]), F.lit(":"), s(e[1]), F.lit(":"), s(e[2]),
        F.lit("_"), s(e[3]), F.lit(":"), s(e[4]), F.lit(":"), s(e[5]), F.lit("_"), s(F.col("o_orderkey")),
    )
    return o.select(
        name.alias("qname"),
        (F.col("o_orderkey") % 2 * 16).alias("flag"),
        F.concat(F.lit("ctg_"), s((F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)) % 5)).alias("rname"),
        (fwd + F.col("o_orderkey") % 60).alias("left"),
        (rev + F.col("o_orderkey") % 70).alias("right"),
        (fwd + F.col("o_orderkey") % 60 - F.col("o_custkey") % 9).alias("left0"),
        (rev + F.col("o_orderkey") % 70 - F.col("o_custkey") % 13).alias("right0"),
        (F.col("o_orderkey") % 61).alias("mapq"),
        (F.col("o_orderkey") % 6).alias("edits"),
    )


SIMULATED = """
sim as (select 'ctg_' || (o_custkey % 5) || '_' || (o_custkey % 1000 + 1) || '_' || (o_custkey % 1000 + 300) || '_' || (o_orderkey % 3) || ':' || (o_orderkey % 2) || ':0_'
   || (o_custkey % 4) || ':1:' || (o_custkey % 2) || '_' || o_orderkey as qname, o_orderkey % 2 * 16 as flag,
   'ctg_' || ((o_custkey + case when o_orderkey % 11 = 0 then 1 else 0 end) % 5) as rname, o_custkey % 1000 + 1 + o_orderkey % 60 as "left",
   o_custkey % 1000 + 300 + o_orderkey % 70 as "right", o_custkey % 1000 + 1 + o_orderkey % 60 - o_custkey % 9 as left0,
   o_custkey % 1000 + 300 + o_orderkey % 70 - o_custkey % 13 as right0, o_orderkey % 61 as mapq, o_orderkey % 6 as edits from orders),
parsed as (select *, regexp_extract(qname, '^(.*)_([0-9]+)_([0-9]+)_([0-9]+):([0-9]+):([0-9]+)_([0-9]+):([0-9]+):([0-9]+)_([^_]*)$',
   ['contig', 'f', 'r', 'a', 'b', 'c', 'x', 'y', 'z', 'counter']) as p from sim),
origin as (select qname, flag, rname, "left", "right", left0, right0, mapq, edits, p.contig as contig, p.f::bigint as fwd_pos, p.r::bigint as rev_pos,
   p.a::bigint + p.b::bigint + p.c::bigint as fwd_edits, p.x::bigint + p.y::bigint + p.z::bigint as rev_edits, p.counter as counter from parsed)"""
