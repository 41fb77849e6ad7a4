"""SAM text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import clip, strip_mate
from ..operators.post import SAM, sam_line

NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}


def parse_sam(lines: DataFrame, column: str = "value", edit_tag: str = "NM") -> DataFrame:
    """The mandatory columns, edits (-1 without the tag) and left (position less the leading clip); header
    and empty lines go, a carriage return at the end too."""
    line = F.regexp_replace(F.col(column), "\r$", "")
    rows = lines.select(line.alias("l")).where("l <> '' and l not like '@%'").withColumn("f", F.split("l", "\t"))
    picked = [F.get("f", F.lit(i)).try_cast("long").alias(c) if c in NUMBERS else F.get("f", F.lit(i)).alias(c) for i, c in enumerate(SAM)]
    tag = F.regexp_extract("l", rf"\t{edit_tag}:i:(-?\d+)", 1)
    rows = rows.select(*picked, F.when(tag == "", F.lit(-1)).otherwise(tag.try_cast("long")).cast("long").alias("edits"))
    return rows.withColumn("qname", strip_mate("qname")).withColumn("left", F.col("pos") - clip("cigar", False))


def read_sam(spark: SparkSession, path: str, edit_tag: str = "NM") -> DataFrame:
    return parse_sam(spark.read.text(path), "value", edit_tag)


def sam_header(contigs: DataFrame, version: str = "1.0") -> list[str]:
    """Header lines; one for each contig (name, length), so the dimension must fit the driver."""
    lines = ["@HD\tVN:1.4\tSO:unknown"]
    lines += [f"@SQ\tSN:{r['name']}\tLN:{r['length']}" for r in contigs.select("name", "length").orderBy("name").toLocalIterator()]
    return [*lines, f"@PG\tID:seqloom\tVN:{version}"]


def write_sam(rows: DataFrame, contigs: DataFrame, path: str) -> None:
    """A folder of text files, as ``read_sam`` takes it; the header is the first one's."""
    spark = rows.sparkSession
    head = spark.createDataFrame([("\n".join(sam_header(contigs)),)], "line string").coalesce(1)
    head.union(sam_line(rows).select("line")).write.text(path)
