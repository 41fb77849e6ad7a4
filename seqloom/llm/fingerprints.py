"""Document fingerprints: a threshold-scaled sketch, built from SQL functions only.

Every 5-word shingle is hashed (first 64 bits of MD5, as 16 hexadecimal digits) and each hash
below a fixed fraction of the hash range is kept, so a sketch grows with its document, sketches
merge by union, and the containment of a short document in a very long one can be estimated.
A document with fewer than FLOOR such hashes keeps its FLOOR smallest ones instead; the sketch
records the ``bound`` up to which it holds *every* hash, and two sketches are compared below the
smaller of their bounds, where both are complete. Documents of up to FLOOR shingles are exact.
FLOOR is a parameter of the sketch's format: 0 gives the pure fixed fraction, in which most
documents of a few lines have nothing to compare.

Where a short sketch has no hash below the bound of a longer one, the longer one says nothing of
it: containment is then null (unknown), never 0. ``exact_containment`` answers from the texts.

Defined results: null text is the empty text; a text without words has an empty sketch; two empty
sketches have likeness 1, an empty and a non-empty one 0; an empty sketch is contained in all; with
fewer than five words the whole word sequence is the one shingle. Repeated rows are separate
documents, those of one id in the order of their texts; null ids sort last, whatever the other ids.
Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, text_or_empty

WORDS = 5
#: One hash in eight is kept.
BOUND = "1fffffffffffffff"
#: Greater than every hash: the sketch holds all of them.
ALL = "g"
#: Least hashes that a sketch keeps, where its text has so many.
FLOOR = 16
#: Rows that share a bucket of the key order, and buckets that one task may order.
BUCKET_BITS, TOP_BITS = 6, 12


def _hashes(words: str) -> str:
    """The hash of every shingle of an array column of words."""
    return (
        f"if(size({words}) = 0, cast(array() as array<string>), "
        f"transform(sequence(1, greatest(size({words}) - {WORDS - 1}, 1)), "
        f"i -> left(md5(cast(array_join(slice({words}, i, {WORDS}), ' ') as binary)), 16)))"
    )


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), "[ \\t-\\r]+", -1), "")


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: struct<bound string, hashes array<string>> of the column ``text``."""
    w, a, k = f"__w_{out}", f"__a_{out}", f"__k_{out}"
    df = df.withColumn(w, _words(text)).withColumn(a, F.expr(_hashes(w)))
    df = df.withColumn(k, F.expr(f"array_sort(array_distinct(filter({a}, h -> h <= '{BOUND}')))"))
    small = f"array_sort(array_distinct({a}))"
    df = df.withColumn(
        k,
        F.expr(
            f"if(size({k}) >= {FLOOR}, named_struct('d', -1, 'h', {k}), "
            f"transform(array({small}), s -> named_struct('d', size(s), 'h', slice(s, 1, {FLOOR})))[0])"
        ),
    )
    return df.withColumn(
        out,
        F.expr(
            f"named_struct('bound', case when {k}.d < 0 then '{BOUND}' when {k}.d <= {FLOOR} then '{ALL}' "
            f"else {k}.h[{FLOOR - 1}] end, 'hashes', {k}.h)"
        ),
    ).drop(w, a, k)


def as_text(sketch: str) -> Column:
    return F.concat_ws(":", F.col(f"{sketch}.bound"), F.array_join(F.col(f"{sketch}.hashes"), ","))


def _compared(a: str, b: str, result: str) -> Column:
    """``result`` over s.a, s.b (the hashes below the common bound), s.both (how many they share), s.none_a and
    s.none_b (whether a sketch is empty). Each sketch is bound once, so that an optimizer that pulls a sketch's
    own expression in here doesn't repeat it for every hash."""
    return F.expr(
        f"transform(transform(transform(array(named_struct('x', {a}, 'y', {b})), s -> named_struct('x', s.x.hashes, 'y', s.y.hashes, "
        f"'m', least(s.x.bound, s.y.bound))), s -> named_struct('a', filter(s.x, h -> h <= s.m), 'b', filter(s.y, h -> h <= s.m), "
        f"'none_a', size(s.x) = 0, 'none_b', size(s.y) = 0)), s -> {result})[0]"
    )


_BOTH = "cast(size(array_intersect(s.a, s.b)) as double)"


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketch columns."""
    return _compared(a, b, f"case when s.none_a and s.none_b then 1.0D else transform(array({_BOTH}), n -> n / nullif(size(s.a) + size(s.b) - n, 0))[0] end")


def containment(a: str, b: str) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds too; 1 if ``a`` has none, null if the
    sketches can't tell (``a`` has no hash below the bound of ``b``)."""
    return _compared(a, b, f"case when s.none_a then 1.0D when size(s.a) > 0 then {_BOTH} / size(s.a) end")


def exact_containment(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the share of the shingles of text ``a`` that text ``b`` holds too; 1 if ``a`` has none."""
    wa, wb, ha = f"__wa_{out}", f"__wb_{out}", f"__ha_{out}"
    df = df.withColumn(wa, F.coalesce(_words(a), F.array().cast("array<string>"))).withColumn(wb, F.coalesce(_words(b), F.array().cast("array<string>")))
    df = df.withColumn(ha, F.expr(f"array_distinct({_hashes(wa)})"))
    share = f"if(size({ha}) = 0, 1.0D, cast(size(array_intersect({ha}, {_hashes(wb)})) as double) / greatest(size({ha}), 1))"
    return df.withColumn(out, F.expr(share)).drop(wa, wb, ha)


def merged(sketches: str) -> Column:
    """The sketch of the union of the documents whose sketches the array column holds."""
    return F.expr(
        f"transform(array(array_min(transform({sketches}, s -> s.bound))), b -> named_struct('bound', b, 'hashes', "
        f"array_sort(array_distinct(filter(flatten(transform({sketches}, s -> s.hashes)), h -> h <= b)))))[0]"
    )


def _lower_bucket(buckets: DataFrame, span: int) -> DataFrame:
    """(b, lower): for each distinct bucket number the next lower one that exists. No task orders
    more than 2 ** TOP_BITS numbers: above that, numbers are ordered within coarser buckets, and only
    the lowest of each looks to the highest of the next coarser bucket."""
    if span < 1 << TOP_BITS:
        return buckets.withColumn("lower", F.lead("b").over(Window.orderBy(F.desc("b"))))
    coarse = buckets.withColumn("c", F.shiftright("b", TOP_BITS))
    inside = coarse.withColumn("lower", F.lead("b").over(Window.partitionBy("c").orderBy(F.desc("b"))))
    tops = coarse.groupBy("c").agg(F.max("b").alias("top"))
    steps = _lower_bucket(tops.select(F.col("c").alias("b")), span >> TOP_BITS)
    bridge = steps.join(tops.select(F.col("c").alias("lower"), "top"), "lower").select(F.col("b").alias("c"), "top")
    return inside.join(bridge, "c", "left").select("b", F.coalesce("lower", "top").alias("lower"))


def with_next(df: DataFrame, key: str, text: str, make: Callable[[DataFrame], DataFrame], made: str) -> DataFrame:
    """``make(df)`` plus next_<text> and next_<made>: those of the next row in descending order of the
    integer column ``key``, nulls last (the last row gets the first row's). Texts are dealt out once, in
    buckets of 64 key values and one of null keys, and ``made`` is worked out from them afterwards; of each
    bucket only the first row travels on to another one."""
    low, high = (None if x is None else x >> BUCKET_BITS for x in df.agg(F.min(key), F.max(key)).first())
    span = -1 if low is None else high - low
    df = df.withColumn("__b", F.coalesce(F.shiftright(F.col(key), BUCKET_BITS) - F.lit(low or 0).cast("long"), F.lit(-1).cast("long")))
    own = Window.partitionBy("__b").orderBy(F.desc(key), F.asc(text))
    rows = make(df.repartition("__b")).withColumn("__next", F.lead(F.struct(text, made)).over(own))
    steps = _lower_bucket(df.select(F.col("__b").alias("b")).distinct(), span).withColumn("lower", F.coalesce("lower", F.lit(span)))
    heads = df.select("__b", key, text).withColumn("__n", F.row_number().over(own)).where("__n = 1")
    heads = heads.join(steps, heads["__b"] == steps["lower"]).select(F.col("b").alias("__b"), text)
    bridge = make(heads).select("__b", F.struct(text, made).alias("__head"))
    out = rows.join(bridge, "__b", "left").withColumn("__next", F.coalesce("__next", "__head"))
    columns = [c for c in rows.columns if c not in ("__b", "__next")]
    return out.select(*columns, F.col(f"__next.{text}").alias(f"next_{text}"), F.col(f"__next.{made}").alias(f"next_{made}"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("doc_id").cast("long").alias("__key"),
        text_or_empty().alias("text"),
    )
    rows = with_next(own, "__key", "text", lambda df: with_sketch(df, "text", "sketch"), "sketch")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn(
        "edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))")
    ).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "next_sketch").alias("held_by_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


def _duck_sketch(text: str) -> str:
    return f"""
      (select struct_pack(bound := case when len(k) >= {FLOOR} then '{BOUND}' when len(s) <= {FLOOR} then '{ALL}' else s[{FLOOR}] end,
                          hashes := case when len(k) >= {FLOOR} then k else s[1:{FLOOR}] end)
       from (select s, list_filter(s, lambda h: h <= '{BOUND}') as k from (select list_sort(list_distinct(
         case when len(w) = 0 then []::varchar[] else list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1),
           lambda i: left(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 16)) end)) as s
       from (select list_filter(regexp_split_to_array(lower({text}), '[ \\t-\\r]+'), lambda x: x <> '') as w))))"""


def _duck_like(a: str, b: str, of: str) -> str:
    bound = f"least({a}.bound, {b}.bound)"
    fa, fb = (f"list_filter({x}.hashes, lambda h: h <= {bound})" for x in (a, b))
    both = f"len(list_intersect({fa}, {fb}))"
    if of == "union":
        return f"case when len({a}.hashes) = 0 and len({b}.hashes) = 0 then 1.0::double else {both}::double / (len({fa}) + len({fb}) - {both}) end"
    return f"case when len({a}.hashes) = 0 then 1.0::double else {both}::double / nullif(len({fa}), 0) end"


SQL = {
    "op1_document_fingerprints": f"""
    with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
    o as (select *, lead(text) over w as nx, first_value(text) over w as ft from d
          window w as (order by doc_id desc nulls last, text rows between unbounded preceding and unbounded following)),
    e as (select doc_id, text, n, coalesce(nx, ft) as nt, left(text, (n - n // 2)::int) || left(coalesce(nx, ft), (n // 2)::int) as edited from o),
    f as (select *, {_duck_sketch('text')} as s, {_duck_sketch('edited')} as es, {_duck_sketch('nt')} as ns from e)
    select doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256,
      concat(s.bound, ':', array_to_string(s.hashes, ',')) as fingerprint,
      concat(es.bound, ':', array_to_string(es.hashes, ',')) as edited_fingerprint,
      {_duck_like('s', 'es', 'union')} as near_edited, {_duck_like('s', 'ns', 'union')} as near_next,
      {_duck_like('s', 'ns', 'own')} as held_by_next
    from f"""
}
QUERIES = {"op1_document_fingerprints": op1_document_fingerprints}
