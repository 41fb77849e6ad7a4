"""k-mer tables: the index of a reference and the probes of reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 18
_CODES = np.full(256, 4, np.uint64)
for _i, _c in enumerate("acgt"):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i


def windows(values: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Of every k values in a row, the number they spell in a base (modulo 2 ** 64), by doubling."""
    out, done = values, 1
    for bit in bin(k)[3:]:
        out, done = out[: len(out) - done] * np.uint64(pow(int(base), done, 1 << 64)) + out[done:], 2 * done
        if bit == "1":
            out, done = out[: len(values) - done] * base + values[done:], done + 1
    return out


def codes(text: str, k: int, dna: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) of a sequence's k-mers. DNA: exact 2-bit codes (k up to 31) without those over
    other letters; other texts: 64-bit hashes over code points."""
    if len(text) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if not dna:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        h = windows(points + np.uint64(1), k, BASE)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return np.arange(len(h)), h ^ h >> np.uint64(32)
    bases = _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    bad = np.cumsum(np.r_[0, bases == 4])
    good = np.flatnonzero(bad[k:] == bad[:-k])
    return good, windows(np.where(bases == 4, np.uint64(0), bases), k, np.uint64(4))[good]


def held(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes the sorted ``known`` ones hold."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def kmers(df: DataFrame, key: str, seq: str, k: int, dna: bool = False, stride: int = 1, wanted: Broadcast | None = None) -> DataFrame:
    """(<key> long, pos int, code long): every ``stride``-th k-mer of every sequence; null: none. ``wanted``: bytes of
    sorted codes; k-mers of other codes are left out where they are made."""
    if dna and k > 31:
        raise ValueError("k is at most 31 for DNA")
    schema = f"`{key}` long, pos int, code long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else np.frombuffer(wanted.value, np.int64)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pos, code = codes(text or "", k, dna)
                if stride > 1:
                    pos, code = pos[pos % stride == 0], code[pos % stride == 0]
                if known is not None:
                    kept = held(known, code.view(np.int64))
                    pos, code = pos[kept], code[kept]
                for at in range(0, len(pos), CHUNK):
                    p, c = pos[at : at + CHUNK], code[at : at + CHUNK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), -1 if i is None else i, np.int64)), pa.array(p.astype(np.int32)), pa.array(c.view(np.int64))], names=[key, "pos", "code"]
                    )

    return df.select(F.col(key).cast("long").alias(key), F.col(seq).cast("string").alias(seq)).where(f"`{key}` is not null").mapInArrow(run, schema)


def spectrum(table: DataFrame) -> DataFrame:
    """code, n: how often each k-mer occurs."""
    return table.groupBy("code").agg(F.count("*").alias("n"))
