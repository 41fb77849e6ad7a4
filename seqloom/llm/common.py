"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most rows of a side that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Rows of one key up to which a shuffle deals them to one task.
HOT_ROWS = 512
#: Rows of a small intermediate table that go into one task and file.
PACK_ROWS = 20_000
#: Bytes of a row group of an intermediate table, which a writer holds in memory.
BLOCK_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local master gets a folder of
    its own and a cluster an error: a folder of one machine would lose data there."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _OWN["dir"] = tempfile.mkdtemp(prefix="seqloom-")
    return where.rstrip("/")


_TABLES: list[str] = []


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives lost executors. Where at most
    ``rows`` rows are expected, its last stage has a task for every PACK_ROWS of them, if there were more tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    out = df if rows is None else df.coalesce(max(1, -(-rows // PACK_ROWS)))
    out.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(since: int = 0) -> list[str]:
    """The tables that ``written`` made in this process, from a number of them on."""
    return _TABLES[since:]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``written`` made and that no result needs any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Deletes all tables that ``written`` made in this process, once their results are saved; their number."""
    paths = tables()
    drop(spark, paths)
    _TABLES.clear()
    return len(paths)


def folders_of(df: DataFrame) -> list[str] | None:
    """Names of the folders and files that ``df`` reads; None if it reads anything else."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = []
    for leaf in (leaves.apply(i) for i in range(leaves.length())):
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        paths = leaf.relation().location().rootPaths()
        out += [paths.apply(i).getName() for i in range(paths.length())]
    return out


def sized_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Joins a per-key table. ``small`` is written (``rows`` as in ``written``) and counted first: at most ``most``
    rows are broadcast, more are joined by a shuffle whose skewed partitions adaptive execution splits."""
    small = written(small, "side", rows)
    if small.count() <= most:
        small = F.broadcast(small)
    return left.join(small, on, how)


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` (about ``total``) with the columns of ``table``, which has one row a key and in ``weight`` how
    many of ``rows`` have it. Keys of more than max(HOT_ROWS, total / BROADCAST_ROWS) rows, of which there are
    at most BROADCAST_ROWS, are broadcast; so no shuffle deals a hot key to one task."""
    hot_at = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    hot = F.broadcast(table.where(F.col(weight) > hot_at))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(weight) <= hot_at), key)
    return rows.join(hot, key).unionByName(cold)


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers by bytes, since rows may be very long texts. It is a setting of
    the session, since the plan is made when the caller runs it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def plus(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def boxed(df: DataFrame, keep: list[str] | None = None, **named: Column) -> DataFrame:
    """``box``, a struct of the columns of ``df`` (or of ``keep``), and the named columns. Whatever the columns
    of ``df`` are called, they can't be taken for those that an operator adds."""
    kept = [F.col(quoted(c)) for c in (df.columns if keep is None else keep)]
    return df.select(F.struct(*kept).alias("box"), *(c.alias(n) for n, c in named.items()))


def unboxed(rows: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The columns of ``box``, then the added ones. An added one whose name the box has (in any case) is named
    with as many underscores behind it as make it new."""
    inside = rows.schema["box"].dataType.names
    names = free_names(inside, [*added])
    return rows.select(*(F.col("box")[c].alias(c) for c in inside), *(column.alias(n) for n, column in zip(names, added.values())))


def free_names(taken: list[str], names: list[str]) -> list[str]:
    """The names, each with as many underscores behind it as make it differ (in any case) from all taken ones."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """The columns under plain names, for functions over Arrow batches, which can't be handed names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
