"""Language identification by Bayesian evidence fusion.

Four pieces of evidence on a document's language are multiplied:

* the text: a naive Bayes model of hashed byte trigrams of the whole text, fitted on about
  MOST_FIT documents a language (those of least hash) and smoothed towards the trigrams of all
  languages; overlapping trigrams are no independent witnesses, so a text counts for at most
  TEXT_WEIGHT trigrams;
* the declared (markup) language and the address suffix: how often documents whose text is in
  language l declare d (or stand under suffix s), counted over all documents by grouped
  aggregation, smoothed towards each value's overall frequency;
* the host: the shares of languages among the host's documents, smoothed towards their shares
  under the host's suffix and those towards their overall shares.

A document is rejected if it has no words, if no language has a posterior of 0.5, or if its text,
having enough trigrams, is far less likely under every language than the least likely of all texts
labelled with that language, in the sample or not (another language, or none). A label on noise thus
lowers its language's bound.

Every label is a language, however few documents it has; a rare one leans on the trigrams of all, so
it doesn't draw other texts. Tables are made, broadcast and applied for AT_ONCE languages at a time,
so memory doesn't grow with their number. Labels are names of languages, and what is counted by label
reaches the driver; beyond MOST_LANGUAGES (more than there are codes in use) the rarest labels have no
model, and a document that declares one of them, if it has words, is kept with the language it declares
and a null posterior, and is not counted as evidence for others.

Where the judged documents are the labelled ones, each text is scored once; the scores are written.

Defined results: null texts and values are empty ones; empty declared and suffix values are values
like others; null ids and repeated rows are rows like others; without any labelled text nothing
can be identified and every row is rejected. Columns of any names pass through; an added column
whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, plus, read, sized_join, small_batches, unboxed, written
from .words import pieces

MOST_FIT, MOST_LANGUAGES, AT_ONCE = 2000, 10_000, 32
BINS = 2**16
#: Trigrams of all languages that are added to those of each; weight of a text; documents that a level above counts for.
SHARED, TEXT_WEIGHT, SMOOTHING = 2000.0, 60.0, 20.0
#: Trigrams that a text needs, and nats a trigram that it must fall below all labelled texts, to be no known language.
FIT_TRIGRAMS, FIT_MARGIN = 30, 1.5
ADDED = ["language", "language_posterior", "text_language", "language_keep"]


def trigrams(raw: bytes) -> Iterator[np.ndarray]:
    """Hashed trigrams of a text, piece by piece: A-Z lower-cased, white space and line ends as single spaces."""
    last = b" "
    for piece in pieces(raw):
        words = piece.lower().split()
        if not words:
            continue
        b = np.frombuffer(last + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        last = b[-2:].astype(np.uint8).tobytes()
        yield (h >> np.uint32(16)).astype(np.int64)


def score(logs: np.ndarray, raw: bytes) -> tuple[int, np.ndarray]:
    """(trigrams, mean log probability by column of ``logs``) of a text."""
    n, total = 0, np.zeros(logs.shape[1])
    for bins in trigrams(raw):
        for at in range(0, len(bins), 100_000):
            total += logs[bins[at : at + 100_000]].sum(0, dtype=np.float64)
        n += len(bins)
    return n, total / max(n, 1)


@dataclass
class Model:
    """Languages in order, tables (broadcast) of log probabilities by trigram bin for AT_ONCE of them each, and the
    least mean log probability of a text labelled with each language, once that is known."""

    languages: list[str]
    tables: list[Broadcast] = field(default_factory=list)
    least: np.ndarray | None = None


def fitted(docs: DataFrame, text: str = "text", language: str = "lang", most: int = MOST_FIT) -> Model:
    """A model without ``least``. Trigrams are counted by language in a bounded sample, distributed; the driver
    holds the counts of AT_ONCE languages at a time."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select(F.col("doc_id"), F.col(language).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("l is not null and l <> '' and t is not null")
    sizes = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["l"] for r in sizes)
    if not languages:
        return Model([])
    at = {l: i for i, l in enumerate(languages)}
    table = spark.createDataFrame([(r["l"], at[r["l"]], min(1.0, most / r["count"])) for r in sizes], "l string, i int, share double")
    # a hash below a share of its range: the sample's size is bounded in expectation, and any executor draws the same
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(2**30)) / float(2**30)
    sample = labelled.join(F.broadcast(table), "l").where(draw < F.col("share")).select("i", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for i, counts in tables.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["i", "bin", "n"])
            tables.clear()

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if i not in tables and len(tables) >= AT_ONCE:
                    yield from flush()
                counts = tables.setdefault(i, np.zeros(BINS, np.int64))
                for bins in trigrams(t):
                    counts += np.bincount(bins, minlength=BINS)
        yield from flush()

    counted = written(sample.mapInArrow(count, "i int, bin int, n long").groupBy("i", "bin").agg(F.sum("n").alias("n")), "trigrams")
    got = counted.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    overall = np.zeros(BINS)
    overall[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    overall = (overall + 0.1) / (overall.sum() + 0.1 * BINS)
    model = Model(languages)
    for first in range(0, len(languages), AT_ONCE):
        width = min(AT_ONCE, len(languages) - first)
        got = counted.where(F.col("i").between(first, first + width - 1)).toArrow()
        counts = np.zeros((BINS, width))
        counts[got.column("bin").to_numpy(), got.column("i").to_numpy() - first] = got.column("n").to_numpy()
        logs = np.log((counts + SHARED * overall[:, None]) / (counts.sum(0) + SHARED)).astype(np.float32)
        model.tables.append(spark.sparkContext.broadcast(logs))
    return model


def scored(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` without ``text`` plus trigrams and means (mean log probabilities by language), as a written table."""
    small_batches(rows.sparkSession)
    for number, shared in enumerate(model.tables):
        first, last = number == 0, number == len(model.tables) - 1
        kept = [f for f in rows.schema.names if not (last and f == text) and f not in ("trigrams", "means")]
        schema = plus(rows.select(*kept), "trigrams long, means array<double>")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, kept=kept) -> Iterator[pa.RecordBatch]:
            logs = shared.value
            for batch in batches:
                column = lambda name: batch.column(batch.schema.get_field_index(name))
                got = [score(logs, t or b"") for t in column(text).cast(pa.binary()).to_pylist()]
                means = [np.round(s, 8).tolist() for _, s in got]
                if not first:
                    means = [a + b for a, b in zip(column("means").to_pylist(), means)]
                columns = [*(column(c) for c in kept), pa.array([n for n, _ in got], pa.int64()), pa.array(means, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "trigrams", "means"])

        rows = rows.mapInArrow(run, schema)
        if number % 4 == 3 and not last:
            rows = written(rows, "scores")
    return written(rows, "scores")


def bounds(rows: DataFrame, model: Model, label: str) -> np.ndarray:
    """The least mean log probability of the scored rows labelled with each language, under that language."""
    names = F.array(*(F.lit(l) for l in model.languages))
    fits = rows.where(F.col("trigrams") >= FIT_TRIGRAMS).withColumn("at", F.array_position(names, F.col(label))).where("at > 0")
    least = {r["at"]: r["least"] for r in fits.groupBy("at").agg(F.min(F.element_at("means", F.col("at").cast("int"))).alias("least")).collect()}
    return np.array([least.get(i + 1, -1e9) for i in range(len(model.languages))])


def train(docs: DataFrame, text: str = "text", language: str = "lang", most: int = MOST_FIT) -> Model:
    """A whole model, for judging other documents than the labelled ones."""
    model = fitted(docs, text, language, most)
    if model.languages:
        rows = boxed(docs, [], label=F.col(language).cast("string"), text=F.col(text).cast("string")).drop("box")
        model.least = bounds(scored(rows.where("label is not null and text is not null"), model), model, "label")
    return model


def fused(rows: DataFrame, model: Model) -> DataFrame:
    """Scored rows (box, declared, suffix, host, trigrams, means) as box and the ADDED columns."""
    n = len(model.languages)
    arr = lambda xs: F.array(*(F.lit(x) for x in xs))
    names, least = arr(model.languages), arr([float(x) - FIT_MARGIN for x in model.least])
    weight = F.least(F.col("trigrams").cast("double"), F.lit(TEXT_WEIGHT))
    fits = F.exists(F.zip_with("means", least, lambda s, l: s >= l), lambda x: x)
    rows = rows.withColumns({
        "scores": F.transform("means", lambda s: F.round(s * weight, 6)),
        "known": (F.col("trigrams") > 0) & ((F.col("trigrams") < FIT_TRIGRAMS) | fits),
        "modelled": (F.col("declared") == "") | F.array_contains(names, F.col("declared")),
    })
    first = lambda scores: F.array_position(scores, F.array_max(scores))
    # counts over all documents that the models can judge: text language by (declared, suffix, host)
    seen = rows.where("modelled and known").groupBy("declared", "suffix", "host", first(F.col("scores")).alias("l")).count()
    seen = written(seen, "languages")

    def table(by: list[str]) -> DataFrame:
        """by, c: how many documents of each language, as an array."""
        per = seen.groupBy(*by, "l").agg(F.sum("count").cast("double").alias("c"))
        per = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("m"))
        return per.select(*by, F.expr(f"transform(sequence(1L, {n}L), i -> coalesce(try_element_at(m, i), 0D))").alias("c"))

    whole = seen.groupBy("l").agg(F.sum("count").alias("c")).collect()
    overall = np.zeros(n)
    for r in whole:
        overall[r["l"] - 1] = r["c"]
    prior = (overall + 1.0) / (overall + 1.0).sum()
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def spoken(key: str, out: str) -> DataFrame:
        """Log P(value | language), smoothed towards P(value)."""
        share = total(F.col("c")) / float(max(overall.sum(), 1.0))
        return table([key]).select(key, F.zip_with("c", arr(map(float, overall)), lambda x, o: F.log((x + SMOOTHING * share) / (o + SMOOTHING))).alias(out))

    by_suffix = table(["suffix"]).select("suffix", F.zip_with("c", arr(map(float, prior)), lambda x, p: (x + SMOOTHING * p) / (total(F.col("c")) + SMOOTHING)).alias("above"))
    by_host = table(["host", "suffix"]).join(by_suffix, "suffix")
    by_host = by_host.select("host", "suffix", F.zip_with("c", "above", lambda x, p: F.log((x + SMOOTHING * p) / (total(F.col("c")) + SMOOTHING))).alias("prior"))
    rows = sized_join(rows, spoken("declared", "of_declared"), ["declared"])
    rows = sized_join(rows, spoken("suffix", "of_suffix"), ["suffix"])
    rows = sized_join(rows, by_host, ["host", "suffix"])
    zero, log_prior = arr([0.0] * n), arr(float(np.log(p)) for p in prior)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    sums = add(add(F.col("scores"), F.coalesce("of_declared", zero)), add(F.coalesce("of_suffix", zero), F.coalesce("prior", log_prior)))
    rows = rows.withColumn("sums", sums).withColumn("top", F.array_max("sums"))
    at = lambda scores: F.element_at(names, first(F.col(scores)).cast("int"))
    worded = F.col("trigrams") > 0
    rows = rows.withColumn("language", F.when(worded, F.when(F.col("modelled"), at("sums")).otherwise(F.col("declared"))))
    rows = rows.withColumn("text_language", F.when(worded, at("scores")))
    posterior = F.round(1 / total(F.transform("sums", lambda x: F.exp(x - F.col("top")))), 9)
    rows = rows.withColumn("language_posterior", F.when(F.col("modelled"), posterior))
    rows = rows.withColumn("language_keep", F.when(F.col("modelled"), F.col("known") & (F.col("language_posterior") >= 0.5)).otherwise(worded))
    return rows.select("box", *ADDED)


def identified(
    docs: DataFrame, model: Model | None = None, text: str = "text", declared: Column | None = None, suffix: Column | None = None,
    host: Column | None = None, label: str = "lang", keep: list[str] | None = None, most: int = MOST_FIT,
) -> DataFrame:
    """``box`` (the columns of ``docs``, or those of ``keep``) and the ADDED columns. Without a model, the column
    ``label`` of the documents themselves teaches one."""
    own = model is None
    model = fitted(docs, text, label, most) if own else model
    if not model.languages:
        return boxed(docs, keep, language=F.lit(None).cast("string"), language_posterior=F.lit(0.0), text_language=F.lit(None).cast("string"), language_keep=F.lit(False))
    value = lambda c: F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))
    named = {"declared": value(declared), "suffix": value(suffix), "host": value(host), "text": F.col(text).cast("string")}
    rows = boxed(docs, keep, **named, **({"label": F.col(label).cast("string")} if own else {}))
    rows = scored(rows, model)
    if own:
        model = Model(model.languages, model.tables, bounds(rows, model, "label"))
    return fused(rows, model)


def identify(docs: DataFrame, model: Model | None = None, text: str = "text", **evidence) -> DataFrame:
    """``docs`` plus language, language_posterior, text_language and language_keep; evidence as in ``identified``."""
    return unboxed(identified(docs, model, text, **evidence), {c: F.col(c) for c in ADDED})


def suffix_of(host: Column) -> Column:
    """What follows a host's last dot; empty without one."""
    return F.regexp_extract(F.coalesce(host.cast("string"), F.lit("")), r"\.([^.]+)$", 1)


def of_documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``identified`` for the table of documents: the source stands for the host, and its suffix for the address
    suffix; the column ``lang`` is what was declared, and the label of the texts that teach the model."""
    return identified(docs, declared=F.col("lang"), suffix=suffix_of(F.col("source")), host=F.col("source"), keep=keep)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, page_text (markup off), declared (the html tag's lang), suffix and host of the url."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]+://([^/?#:]*)", 1))
    return pages.select(
        "page_id",
        body.alias("page_text"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)).alias("declared"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        host.alias("host"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; its language column is what was declared, its source the host."""
    return unboxed(of_documents(read(spark, sf_dir, "documents"), ["doc_id"]), {c: F.col(c) for c in ADDED})


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with the evidence of its markup and address; texts of the documents teach the model."""
    model = train(read(spark, sf_dir, "documents"))
    pages = page_evidence(read(spark, sf_dir, "pages"))
    rows = identify(pages, model, "page_text", declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), keep=["page_id", "declared"])
    return rows.select("page_id", "language", "language_posterior", "text_language", "declared", "language_keep")


SQL: dict[str, str] = {}
QUERIES = {"op4_language_id": op4_language_id, "language_of_pages": language_of_pages}
