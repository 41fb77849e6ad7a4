"""Licence scan by canonical digest lookup, from SQL functions only.

A text is made canonical: lower case, copyright lines dropped, punctuation and white space to
single spaces, equivalent spellings unified. The SHA-256 digest of the canonical text is
hash-joined with the digests of known licence texts and notices (a fixed list, so it may be
broadcast). Each document is looked up as one entire text, and each of its lines as an entire
text of its own, which finds notices inside documents. Only texts that begin with the first word of a
known text, in any spelling, are hashed; the others can't be known.

Result: one row per document, licence and scope (``document`` or ``line``) with the number of
matching units; documents without a known licence have no row. Defined results: null and empty
texts match nothing; copies of a row with one id add up; null ids form one document. Texts longer
than any known text can be in any spelling are never hashed, which loses nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .licence_texts import DIGESTS, FIRST_WORDS, LONGEST, known

COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Fixed values: (spelling, equivalent spelling) as whole words of canonical text.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
ANY_SPELLING = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def plain_lines(text: Column) -> Column:
    """Canonical but for spellings; lines are kept apart."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    return F.regexp_replace(text, PUNCTUATION, " ")


def spelled(text: Column) -> Column:
    out = text
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.when(text.rlike(ANY_SPELLING), out).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known_digests(spark: SparkSession) -> DataFrame:
    """licence and digest of every known text."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    rows = spark.sql("select * from values " + ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known()) + " as t(licence, text)")
    rows = rows.withColumn("plain", one_line(plain_lines(F.col("text"))))
    rows = rows.select("licence", F.sha2(spelled(F.col("plain")).cast("binary"), 256).alias("digest"))
    return rows.unionByName(spark.createDataFrame(DIGESTS, "licence string, digest string")).distinct()


def longest() -> int:
    """Characters beyond which a text can't be a known one: spellings at most double a text."""
    return 2 * max(LONGEST, *(len(t) for _, t in known()))


def first_words() -> list[str]:
    """The words that a canonical text of a known licence may begin with before spellings are unified."""
    words = {re.sub(r"[\W_]+", " ", t.lower()).split()[0] for _, t in known()} | set(FIRST_WORDS)
    while True:
        more = {a.split()[0] for a, b in SPELLINGS if b.split()[0] in words} - words
        if not more:
            return sorted(words)
        words |= more


def scan(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_lines(F.col("text").cast("string")).alias("plain"))
    rows = rows.withColumn("whole", one_line(F.col("plain")))
    begins = lambda x: F.substring_index(x, " ", 1).isin(first_words()) & (F.length(x) <= longest())
    lines = F.filter(F.transform(F.split("plain", "\n"), lambda x: F.trim(x)), begins)
    units = F.concat(
        F.when(begins(F.col("whole")), F.array(F.struct(F.lit("document").alias("scope"), F.col("whole").alias("unit")))).otherwise(
            F.array().cast("array<struct<scope:string,unit:string>>")
        ),
        F.transform(lines, lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit"))),
    )
    rows = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.scope", F.sha2(spelled(F.col("u.unit")).cast("binary"), 256).alias("digest"))
    hits = rows.join(F.broadcast(known_digests(docs.sparkSession)), "digest")
    return hits.groupBy("doc_id", "licence", "scope").agg(F.count("*").alias("n_matches"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_spelled(x: str) -> str:
    for a, b in SPELLINGS:
        x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'g')"
    return x


def _duck_plain(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), {_q(COPYRIGHT)}, '', 'g'), {_q(PUNCTUATION)}, ' ', 'g')"


SQL = {
    "op10_licence_scan": f"""
    with known(licence, text) as (values {", ".join(f"({_q(i)}, {_q(t)})" for i, t in known())}),
    k as (select distinct licence, {_duck_spelled(f"trim(regexp_replace({_duck_plain('text')}, '[ \\n]+', ' ', 'g'))")} as canonical from known),
    d as (select doc_id, {_duck_plain('text')} as plain from documents),
    u as (select doc_id, 'document' as scope, trim(regexp_replace(plain, '[ \\n]+', ' ', 'g')) as unit from d
          union all select doc_id, 'line' as scope, trim(unnest(string_split(plain, chr(10)))) as unit from d),
    s as (select doc_id, scope, {_duck_spelled('unit')} as canonical from u where unit <> '' and length(unit) <= {longest()}),
    kd as (select licence, sha256(canonical) as digest from k union select * from (values {", ".join(f"({_q(i)}, {_q(d)})" for i, d in DIGESTS)}) as x(licence, digest))
    select doc_id, licence, scope, count(*) as n_matches from (select doc_id, scope, sha256(canonical) as digest from s) join kd using (digest) group by all"""
}
QUERIES = {"op10_licence_scan": op10_licence_scan}
