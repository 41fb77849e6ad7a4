"""The reference index as tables: k-mers, contigs and a row of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.seeds import index_of


def build(contigs: DataFrame, path: str, k: int = 20, stride: int = 1, dna: bool = True) -> None:
    """Writes contigs (contig_id, name, seq) and their sampled k-mers, sorted by code inside ranges of codes,
    so that a probe's row groups are pruned by their statistics. Each has its code's number of places ``n``,
    so that frequent ones are left out as the table is read."""
    dim = contigs.select("contig_id", "name", F.length("seq").cast("long").alias("length"), "seq")
    dim.write.mode("overwrite").parquet(f"{path}/contigs")
    table = index_of(contigs, k, dna, stride)
    counts = table.groupBy("code").agg(F.count("*").alias("n"))
    table.join(counts, "code").repartitionByRange("code").sortWithinPartitions("code").write.mode("overwrite").parquet(f"{path}/kmers")
    contigs.sparkSession.createDataFrame([(k, stride, dna)], "k int, stride int, dna boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """(k-mers, contigs, parameters), or None if there is no complete index."""
    try:
        params = spark.read.parquet(f"{path}/params").first()
        return spark.read.parquet(f"{path}/kmers"), spark.read.parquet(f"{path}/contigs"), params.asDict()
    except AnalysisException:
        return None


def load_or_build(contigs: DataFrame, path: str, k: int = 20, stride: int = 1, dna: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    found = load(contigs.sparkSession, path)
    if found is None:
        build(contigs, path, k, stride, dna)
        found = load(contigs.sparkSession, path)
    return found


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """table, files, bytes, rows of a stored index."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for table in ("contigs", "kmers", "params"):
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        held = where.getFileSystem(conf).getContentSummary(where)
        out.append((table, held.getFileCount(), held.getLength(), spark.read.parquet(f"{path}/{table}").count()))
    return spark.createDataFrame(out, "table string, files long, bytes long, rows long")
