"""From raw documents to token ids: five stages over one table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``; then its intermediate tables go. All but the last return the columns of ``documents``, and of these
all that there are: a column of any name passes through every stage, and the names that the last
stage adds get an underscore behind them where they are taken. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, jaccard_join, language, mixing, quality
from seqloom.llm.common import drop, folders_of, read, tables, written

#: Intermediate tables of the last stage that was called.
_LEFT: list[str] = []


def _tidy(stage: Callable) -> Callable:
    """A stage that deletes the intermediate tables of the one before it: that one's result is saved before its
    successor is called. Where ``docs`` reads them itself, or anything but saved files, they stay."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = folders_of(docs)
        if held is not None and not any(t.rsplit("/", 1)[-1] in held for t in _LEFT):
            drop(spark, _LEFT)
        before = len(tables())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = tables(before)
        return out

    return run_stage


@_tidy
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; the labels teach it. Texts without words go."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


@_tidy
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language. Texts without words go."""
    return language.of_documents(docs).where("language_keep").select("box.*")


@_tidy
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id. Of rows that repeat an id one stays;
    rows without an id, and texts without words, all stay."""
    return jaccard_join.one_of_each(docs)


@_tidy
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources meet their target weights; a null source is the source ''."""
    return mixing.mixed(docs)


@_tidy
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixed order (mix_position, and its source, block and slot)
    and its token ids (little-endian unsigned 32-bit integers) and their number. Files that are read
    again keep no order, so the order is a column; the same rows give the same places as in mixing."""
    return bpe.with_ids(mixing.with_positions(docs))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("source mixing", mixed_sources),
    ("BPE encoding", token_ids),
]
#: The fitted models and the schedule are beyond SQL; a test holds run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, saved = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = written(docs, name.replace(" ", "-"))
            drop(spark, saved)
            saved = tables()[-1:]
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
