"""FASTA and FASTQ as a Python data source: ``spark.read.format("fastx").load(path)``.

One partition a file (gzip can't be split); records are streamed. Options: ``mode`` reads or fasta
(which drops empty records). A path is a file, a folder, a glob pattern of this machine's files, or an address of a
store that Arrow can open (hdfs, s3, gs, file). An ordinal is unique: the file's number in order times 2 ** 40,
plus the record's place in the file; so the n-th files of two lists go together when reads are paired by ordinal."""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ordinal long, name string, comment string, seq string, qual string"


class BrokenRecord(ValueError):
    """A quality string whose length isn't the sequence's."""


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str]]:
    """(name, comment, lower-case sequence, quality or ``*``) of FASTA or FASTQ lines, in one go."""
    name = None
    seq: list[str] = []
    qual: list[str] | None = None
    need = 0

    def done() -> tuple[str, str, str, str]:
        head, comment = (name.split(None, 1) + ["", ""])[:2] if name[:1].strip() else ("", name)
        letters = "".join(seq).lower()
        quality = "*" if qual is None else "".join(qual)
        if qual is not None and len(quality) != len(letters):
            raise BrokenRecord(f"{head}: {len(quality)} qualities for {len(letters)} bases")
        return head, comment.strip(), letters, quality

    for raw in lines:
        line = raw.rstrip("\r\n")
        if qual is not None and need > 0:
            qual.append(line)
            need -= len(line)
        elif line[:1] in (">", "@"):
            if name is not None:
                yield done()
            name, seq, qual = line[1:], [], None
        elif line[:1] == "+" and name is not None and qual is None:
            qual = []
            need = sum(map(len, seq))
        elif name is not None and qual is None:
            seq.append("".join(line.split()))
    if name is not None:
        yield done()


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _files(path: str) -> list[str]:
    if "://" not in path:
        return sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
    store, inner = FileSystem.from_uri(path)
    if store.get_file_info(inner).type != FileType.Directory:
        return [path]
    found = store.get_file_info(FileSelector(inner))
    return sorted(path.rstrip("/") + "/" + f.base_name for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))


def _opened(path: str):  # noqa: ANN202
    if "://" not in path:
        return (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="latin-1")
    store, inner = FileSystem.from_uri(path)
    return io.TextIOWrapper(store.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None), encoding="latin-1")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.mode = options.get("mode", "reads")

    def partitions(self) -> list[InputPartition]:
        return [_File(f, i) for i, f in enumerate(f for p in self.paths for f in _files(p))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(partition.path) as f:
            for i, (name, comment, seq, qual) in enumerate(records(f)):
                if seq or self.mode != "fasta":
                    yield partition.path, partition.number << 40 | i, name, comment, seq, qual


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)
