"""URL filter: host and path rules, then a blocked Bloom filter before an exact hash join. SQL functions only.

A url's host is what stands between its first ``://`` and the next ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; its path runs from there up to ``?``, ``#`` or the end. A rule fits its host
and all subdomains when the path starts with the rule's path; the longest fitting rule decides. Rules
are tables, one for each number of labels that a rule's host has, joined on as many last labels of the
url's host: any number of rules will do, and a url is compared with those of its own hosts alone.

Without a rule, a url is blocked when its canonical form is listed. The listing is turned into a
blocked Bloom filter (one 256-bit block for 16 listed urls, eight bits of one block per url); urls
whose eight bits are all set are joined with the listing itself, which removes false positives. The
filter is broadcast up to MOST_BLOCKS blocks (BLOCK_BYTES each in memory, 144 MB), beyond that joined
by block; the listing is broadcast up to BROADCAST_ROWS urls, beyond that only possible hits are dealt out.

Defined results: a null url, or one without ``://``, has empty host, path and canonical form, fits
no rule (but one whose host and path are empty) and is never listed: it is allowed. Rows repeat as they
come; the listing may hold repeats. Columns of any names pass through; an added column whose name is
taken gets an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, boxed, read, unboxed, written

#: Fixed values: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
KEYS_PER_BLOCK, WORDS, WORD_BITS = 16, 8, 32
#: Blocks that are broadcast, and what one takes there: two words in each of four longs, the key, and a row's overhead.
MOST_BLOCKS, BLOCK_BYTES = 2_000_000, 72
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ["host", "path", "canonical", "maybe_listed", "listed", "rule", "verdict"]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and canonical: host without ``www.`` and a default port, path without closing
    slashes, and the query; the fragment goes."""
    at = F.instr(F.col(url), "://")
    df = df.withColumn("rest", F.when(at > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)")).otherwise(""))
    df = df.withColumn("rest", F.coalesce("rest", F.lit("")))
    df = df.withColumn("host", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER))
    df = df.withColumn("path", F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract("rest", r"^[^?#]*(\?[^#]*)", 1)
    host = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), ":(80|443)$", "")
    return df.withColumn("canonical", F.concat(host, F.regexp_replace("path", "/+$", ""), query)).drop("rest")


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``found``: the longest rule (verdict, host, path) that fits host and path, else null."""
    spark = rows.sparkSession
    best = F.lit(None).cast("struct<n:int,hn:int,verdict:string,host:string,path:string>")
    by_depth: dict[int, list] = {}
    for verdict, host, path in rules:
        by_depth.setdefault(host.count(".") + 1, []).append((len(host + path), len(host), verdict, host, path))
    for depth, own in sorted(by_depth.items()):
        table = spark.createDataFrame(own, "n int, hn int, verdict string, host string, path string")
        table = table.groupBy(F.col("host").alias("last")).agg(F.collect_list(F.struct("n", "hn", "verdict", "host", "path")).alias("own"))
        table = F.broadcast(table) if len(own) <= BROADCAST_ROWS else table
        rows = rows.withColumn("last", F.substring_index("host", ".", -depth)).join(table, "last", "left")
        fitting = F.filter("own", lambda r: F.col("path").startswith(r["path"]))
        best = F.greatest(best, F.array_max(fitting))
        rows = rows.withColumn("found", best).drop("own", "last")
        best = F.col("found")
    return rows if by_depth else rows.withColumn("found", best)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """The bits that a url sets in its block: one in each 32-bit word, two words to a long."""
    h = F.xxhash64(url, F.lit("bits"))
    bit = lambda i: F.shiftright(h, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    return [one(bit(2 * i)).bitwiseOR(one(bit(2 * i + 1) + WORD_BITS)) for i in range(WORDS // 2)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows: block, w0..w3. Its size follows the listing's, never the urls judged."""
    bits = listed.select(_block(F.col("canonical"), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("canonical")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS // 2)))


def judge(urls: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``urls`` plus the ADDED columns; maybe_listed is the filter's word. ``listed`` has a column of urls named ``url``."""
    names = with_parts(listed.select("url")).where("canonical <> ''").select("canonical").distinct()
    names = written(names, "listing")
    n = names.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    bloom = bloom_blocks(names, blocks)
    rows = with_parts(boxed(urls, url=F.col(url).cast("string"))).drop("url").withColumn("block", _block(F.col("canonical"), blocks))
    rows = rows.join(F.broadcast(bloom) if blocks <= MOST_BLOCKS else bloom, ["block"], "left")
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    rows = rows.withColumn("maybe_listed", F.coalesce(hit, F.lit(False)) & (F.col("canonical") != "")).drop("block", *(f"w{i}" for i in range(WORDS // 2)))
    names = names.select(F.col("canonical").alias("name"))
    if n <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(names), F.col("maybe_listed") & (F.col("canonical") == F.col("name")), "left")
        rows = rows.withColumn("listed", F.col("name").isNotNull()).drop("name")
    else:  # only possible hits are dealt out
        exact = rows.where("maybe_listed").join(names, F.col("canonical") == F.col("name"), "left").withColumn("listed", F.col("name").isNotNull()).drop("name")
        rows = rows.where(~F.col("maybe_listed")).withColumn("listed", F.lit(False)).unionByName(exact)
    rows = with_rule(rows, rules)
    added = {c: F.col(c) for c in ADDED[:5]}
    added["rule"] = F.concat("found.host", "found.path")
    added["verdict"] = F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return unboxed(rows, added)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page; the listing is the urls of the pages whose id is divisible by 50."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where("page_id % 50 = 0").select("url")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_FITS = " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p}'"
    for _, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1]), r), reverse=True)
)
_VERDICTS = " ".join(f"when '{h + p}' then '{v}'" for v, h, p in RULES)
SQL = {
    "op7_url_filter": f"""
    with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) as query from a),
    c as (select *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || query as canonical from b),
    l as (select distinct canonical from c where page_id % 50 = 0 and canonical <> ''),
    j as (select page_id, host, path, case {_FITS} end as rule, l.canonical is not null as listed from c left join l using (canonical))
    select page_id, host, path, rule, case rule {_VERDICTS} else case when listed then 'block' else 'allow' end end as verdict, listed from j"""
}
QUERIES = {"op7_url_filter": op7_url_filter}
