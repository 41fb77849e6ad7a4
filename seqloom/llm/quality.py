"""Quality classifier: hierarchical empirical Bayes.

A logistic model of the text alone gives each document's evidence. Its inputs are the shape of the
whole text (shares of byte classes, word lengths, repeats) and two lexical ones: the mean log
likelihood ratio of the text's distinct words, and that of its distinct byte trigrams, both hashed
into BINS bins whose good and bad documents are counted by grouped aggregation. It is fitted on at
most MOST_LABELLED labelled rows, those of least hash; the lexical inputs of a labelled document come
from the half of the sample that it isn't in. Grouped aggregation then sums the evidence by host and
by path inside a host; rates of sparse groups are shrunk to the level above (path to host, host to
all) by Beta priors whose strength is estimated from the spread between groups. The posterior odds
are the text's likelihood ratio times the odds of the document's path, the document itself left out.
Documents with a posterior under 0.5 are rejected.

Every text is scored once; the scores are written and joined with the group tables, which are
broadcast only when their counted size is small. Documents have no address: unless given, the source
stands for the host and the language for the path.

Defined results: null and wordless texts are rejected (evidence 0); null host and path count as '';
repeated rows count as often as they come, but teach once; null ids are rows like others; a document
with both labels teaches nothing; without labels of both kinds the evidence is 0 for all. Columns of
any names pass through; an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, plus, read, sized_join, small_batches, unboxed, written
from .words import hashes, pieces, spans

MOST_LABELLED, BINS = 20_000, 2**16
#: Pseudo-documents of each kind in every bin.
SMOOTHING = 0.5
SHAPE = [
    "upper", "lower", "digit", "space", "comma_dot", "other_mark", "symbol", "bang", "bar", "high",
    "word_length", "distinct", "repeated", "line_repeats", "log_words", "runs_of_marks", "shouted_words",
]
FEATURES = [*SHAPE, "words", "trigrams"]
ADDED = ["quality_evidence", "host_rate", "path_rate", "quality_posterior", "quality_keep"]


def _classes() -> np.ndarray:
    """[byte, class] of the ten byte classes that come first in SHAPE."""
    out = np.zeros((256, 10))
    for b in range(256):
        c = chr(b)
        if "A" <= c <= "Z":
            k = 0
        elif "a" <= c <= "z":
            k = 1
        elif c.isdigit() and b < 128:
            k = 2
        elif c in " \t\n\r\f\v":
            k = 3
        elif c in ".,;:?'\"-()":
            k = 4
        elif c in "/\\[]{}<>":
            k = 5
        elif c == "!":
            k = 7
        elif c == "|":
            k = 8
        else:
            k = 6 if b < 128 else 9
        out[b, k] = 1
    return out


CLASSES = _classes()
_KIND = CLASSES.argmax(1)
#: Bytes that are marks: neither letters, digits, white space nor beyond ASCII.
_MARK = np.isin(_KIND, [4, 5, 6, 7, 8])


def measure(raw: bytes) -> tuple[list[float], np.ndarray, np.ndarray] | None:
    """(shape, distinct word bins, distinct trigram bins) of a text, piece by piece; None without words."""
    counts = np.zeros(256)
    n = letters = repeated = runs = shouted = 0
    words, grams, lines, last = [], np.zeros(BINS, bool), [], b"\n"
    for piece in pieces(raw):
        text = np.frombuffer(piece + b" ", np.uint8)
        counts += np.bincount(text[:-1], minlength=256)
        low = np.frombuffer(piece.lower() + b" ", np.uint8)
        space, starts, ends = spans(low)
        got = hashes(low, space, starts, ends)
        if len(got):
            n, letters = n + len(got), letters + int((ends - starts).sum())
            before = words[-1][-1:] if words else got[:0]
            repeated += int((got[1:] == got[:-1]).sum()) + int((before == got[:1]).sum())
            kind = _KIND[text]
            shouted += int(((np.add.reduceat(kind == 0, starts) > 0) & (np.add.reduceat(kind == 1, starts) == 0)).sum())
            words.append(got)
        runs += int(((text[1:] == text[:-1]) & _MARK[text[1:]]).sum())
        wide = np.frombuffer(last + piece.lower(), np.uint8).astype(np.uint32)
        if len(wide) > 2:
            h = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)
            grams[h >> np.uint32(16)] = True
        last = (last + piece.lower())[-2:]
        lines += [hash(x) for x in piece.split(b"\n")]
    if not n:
        return None
    every = words[0] if len(words) == 1 else np.concatenate(words)
    distinct = np.unique(every)
    shape = [
        *(counts @ CLASSES / len(raw)).tolist(), (letters + n - 1) / n / 10, len(distinct) / n**0.9, repeated / n,
        1 - len(set(lines)) / len(lines), np.log(n) / 10, min(runs / n, 2.0), shouted / n,
    ]
    return shape, np.unique(distinct >> np.uint64(48)).astype(np.int64), np.flatnonzero(grams)


def features(measured: tuple[list[float], np.ndarray, np.ndarray], tables: np.ndarray) -> list[float]:
    """All inputs of the model; ``tables`` has a row of log likelihood ratios for words and one for trigrams."""
    shape, words, grams = measured
    return [*shape, float(tables[0][words].mean()), float(tables[1][grams].mean()) if len(grams) else 0.0]


class Model:
    """Weights (constant first) over FEATURES, and the tables of the lexical ones."""

    def __init__(self, weights: np.ndarray, tables: np.ndarray):
        self.weights, self.tables = weights, tables

    def evidence(self, raw: bytes) -> float | None:
        """The log likelihood ratio for good quality; None without words."""
        got = measure(raw)
        return None if got is None else float(self.weights[0] + np.dot(self.weights[1:], features(got, self.tables)))


def with_evidence(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text`` plus evidence, null without words."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.tables))
    schema = plus(df.drop(text), "evidence double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = [m.evidence(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def fit(rows: np.ndarray, good: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights (constant first) of the log likelihood ratio: ridge logistic regression by Newton steps
    on standardised features, less the log odds of the labels. Rows are put in one order first, so the
    weights don't depend on how the sample was gathered."""
    if len(rows) == 0 or good.min() == good.max():
        return np.zeros(len(FEATURES) + 1)
    order = np.lexsort([*rows.T, good])
    rows, good = rows[order], good[order]
    mean, spread = rows.mean(0), rows.std(0) + 1e-6
    x = np.c_[np.ones(len(rows)), (rows - mean) / spread]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (good - p) - ridge * len(rows) * np.r_[0, w[1:]]
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(rows) * np.diag(np.r_[1e-9, np.ones(len(w) - 1)])
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = np.r_[w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread]
    out[0] -= np.log(good.mean() / (1 - good.mean()))
    return np.round(out, 6)


def sample_of(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """fold (0 or 1), quality, text of at most ``most`` labelled documents, one row a document. The sample of
    labels is bounded, so it may be broadcast."""
    picked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    draw = F.xxhash64(F.lit("fit"), "doc_id")
    picked = picked.where("quality = other").orderBy(draw, "doc_id").limit(most).select("doc_id", F.col("quality").cast("int").alias("quality"), F.pmod(draw, F.lit(2)).cast("int").alias("fold"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "fold", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).drop("doc_id")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model; what reaches the driver is bounded: counts by bin, fold and label, and the sample's features."""
    small_batches(docs.sparkSession)
    sample = written(sample_of(docs, labels, most), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, documents = np.zeros((2, 2, 2, BINS), np.int64), np.zeros((2, 2), np.int64)  # fold, label, kind
        for batch in batches:
            for f, q, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist()):
                if got := measure(t):
                    documents[f, q] += 1
                    bins[f, q, 0, got[1]] += 1
                    bins[f, q, 1, got[2]] += 1
        flat = np.r_[bins.ravel(), documents.ravel()]
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["at", "n"])

    got = sample.select("fold", "quality", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(8 * BINS + 4, np.int64)
    flat[got.column("at").to_numpy()] = got.column("n").to_numpy()
    bins, documents = flat[:-4].reshape(2, 2, 2, BINS), flat[-4:].reshape(2, 2)

    def ratios(b: np.ndarray, d: np.ndarray) -> np.ndarray:
        share = np.log((b + SMOOTHING) / (d[:, None, None] + 2 * SMOOTHING))
        return np.round(share[1] - share[0], 6).astype(np.float32)

    halves = docs.sparkSession.sparkContext.broadcast([ratios(bins[1 - f], documents[1 - f]) for f in (0, 1)])

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = halves.value
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist())
            out = [(q, features(m, tables[f])) for f, q, t in rows if (m := measure(t))]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.float64()))], names=["quality", "f"])

    got = sample.select("fold", "quality", "text").mapInArrow(inputs, "quality int, f array<double>").toArrow()
    good = np.array(got.column(0).to_pylist(), float)
    weights = fit(np.array(got.column(1).to_pylist(), float).reshape(len(good), len(FEATURES)), good)
    return Model(weights, ratios(bins.sum(0), documents.sum(0)))


def _rate(total: Column, n: Column, strength: float, above: Column) -> Column:
    return (total + above * strength) / (n + strength)


def _strength(groups: DataFrame, total: str, n: str, above: Column | float) -> float:
    """How many documents the level above counts for: Beta moments of the groups' rates around it."""
    above = above if isinstance(above, Column) else F.lit(above)
    m = groups.where(F.col(n) > 0).select(
        F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - above, 2)).alias("spread"),
        F.sum(above * (1 - above)).alias("noise"),
        F.sum(F.col(n) * above * (1 - above)).alias("most"),
        F.sum(n).alias("n"),
    ).first()
    if not m["n"]:
        return 1.0
    between = max((m["spread"] - m["noise"]) / m["n"], 0.0)
    most = m["most"] / m["n"]
    return float(round(min(max(most / between - 1, 1.0), 1e4), 6)) if between > 0 else 1e4


def judged(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, model: Model | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``box`` (the columns of ``docs``, or those of ``keep``) and the ADDED columns."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(docs, labels) if model is None else model
    named = {c: F.coalesce(x.cast("string"), F.lit("")) for c, x in (("host", host), ("path", path))}
    rows = with_evidence(boxed(docs, keep, **named, text=F.col("text").cast("string")), model)
    rows = written(rows, "evidence")
    p = 1 / (1 + F.exp(-F.col("evidence")))
    seen = rows.where("evidence is not null")
    paths = written(seen.groupBy("host", "path").agg(F.sum(F.round(p, 9).cast("decimal(20,9)")).cast("double").alias("ps"), F.count("*").alias("pn")), "paths")
    hosts = paths.groupBy("host").agg(F.sum(F.col("ps").cast("decimal(28,9)")).cast("double").alias("hs"), F.sum("pn").alias("hn"))
    all_s, all_n = hosts.agg(F.sum(F.col("hs").cast("decimal(28,9)")).cast("double"), F.sum("hn")).first()
    rate = min(max((all_s or 0.0) / (all_n or 1), 1e-6), 1 - 1e-6)
    host_strength = _strength(hosts, "hs", "hn", rate)
    groups = paths.join(hosts, "host")
    path_strength = _strength(groups, "ps", "pn", _rate(F.col("hs"), F.col("hn"), host_strength, F.lit(rate)))
    rows = sized_join(rows, groups, ["host", "path"])
    own, one = F.coalesce(F.round(p, 9), F.lit(0.0)), F.col("evidence").isNotNull().cast("int")
    less = lambda c, x: F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - x, F.lit(0.0))
    rows = rows.withColumn("host_rate", _rate(less("hs", own), less("hn", one), host_strength, F.lit(rate)))
    rows = rows.withColumn("path_rate", _rate(less("ps", own), less("pn", one), path_strength, F.col("host_rate")))
    rows = rows.withColumn("quality_evidence", F.coalesce("evidence", F.lit(0.0)))
    odds = F.col("quality_evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    rows = rows.withColumn("quality_posterior", 1 / (1 + F.exp(-odds)))
    rows = rows.withColumn("quality_keep", F.col("evidence").isNotNull() & (F.col("quality_posterior") >= 0.5))
    return rows.select("box", *ADDED)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` plus quality_evidence, host_rate, path_rate, quality_posterior, quality_keep; options as in ``judged``."""
    return unboxed(judged(docs, labels, **options), {c: F.col(c) for c in ADDED})


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns alone."""
    return judged(docs, labels, **options).where("quality_keep").select("box.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])


SQL: dict[str, str] = {}
QUERIES = {"op2_quality_classifier": op2_quality_classifier}
