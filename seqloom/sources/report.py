"""Reports as text: tab-separated rows under commented lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: each row's columns, tab-separated; a null is empty."""
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def write_report(rows: DataFrame, columns: list[str], path: str, about: list[str] = ()) -> None:
    """A text folder of one file: lines about the report and the column names behind ``#``, then the rows in the
    order of their columns. A report is a table of levels or classes, so it fits one task."""
    head = [f"# {x}" for x in about] + ["#" + "\t".join(columns)]
    first = rows.sparkSession.createDataFrame([("\n".join(head),)], "line string").coalesce(1)
    first.union(report_lines(rows.coalesce(1).sortWithinPartitions(*columns), columns)).coalesce(1).write.text(path)
