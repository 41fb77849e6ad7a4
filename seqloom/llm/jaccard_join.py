"""N-gram Jaccard join: token-group matrix over word shingles, exact.

A document's set is its distinct 5-word shingles, as 64-bit hashes; documents of one set (copies)
form a class and go on as one. Two classes link when their Jaccard similarity is at least 3/4.

1. profile: set size and digest of every document. Shingles that many documents share are counted
   (repeats inside each batch, summed) and put last in the global order of shingles, so they stay
   out of prefixes; any order gives exact results, this one keeps posting lists short.
2. postings: two linked sets share a shingle among the first n // 4 + 1 of each (n // 7 + 1 of the
   smaller one). These prefixes are dealt out by hash range; shingles of two or more classes stay.
3. groups: each class is compared with the LEADERS least classes of each of its postings. What links
   by that falls into groups of similar documents; classes that nothing links are groups of their own.
   That settles every pair of a posting of up to LEADERS + 1 classes.
4. matrix: each group, in slices of SLICE classes, keeps the union of its members' shingles as a
   bit row; classes still unlinked are grouped by shingle and size for that. A query class and a group
   that meet in a posting are compared by bits: every bit of the query that the group's row lacks is a
   shingle that no member has, which bounds the overlap with any member. Only qualifying slices are opened, member by member:
   by size, by bits, and at last by their sets, the nearest by bits first and the rest where those
   don't link the query. Only longer postings get here.

Copies are never expanded, pairs inside a found group are never made, and no list is cut. The
frequent shingles are at most MOST_COMMON (their threshold rises until they are), so they can be
broadcast; those of over HOT documents are dealt out in parts. Hashes stand for shingles (64 bits) and
sets (128 bits: the second half names a set wherever the first half is that of two).

Defined results: null and wordless texts have empty sets and link with nothing; with fewer than
five words the whole sequence is the one shingle; rows with a null id link with nothing and have
no component; rows that repeat an id are separate texts of one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, boxed, read, sized_join, small_batches, spread_join, written
from .components import components
from .words import U, hashes, mix, spans, word_hashes

WORDS = 5
#: Links have 4 * intersection >= 3 * union.
MOST_COMMON, LEAST_COMMON = 2**21, 8
#: Bytes of text hashed at once, prefix shingles a bucket is made for, shingles a worker gathers, classes in a slice.
CHUNK, BUCKET_SHINGLES, GATHER, SLICE = 250_000, 250_000, 400_000, 32
#: Classes of a posting that all others in it are compared with.
LEADERS = 6
#: Documents of a shingle from which its posting is dealt out in parts of about so many.
HOT = 2**15
#: Rows with a bit row weigh as much as so many plain ones, those with whole sets four times as much.
HEAVY = 4
#: Sizes of unlinked classes in a group differ by this much in their logarithms.
SIZE_BAND = 0.1
#: Members of a slice that a query is compared with at first; all others follow where that links nothing.
NEAREST = 2


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; short texts are worked on together, long ones in pieces."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < CHUNK):
            size += len(raws[end]) + 1
            end += 1
        if size > 2 * CHUNK:
            words = word_hashes(raws[at])
            out += _sets(words, np.array([0, len(words)]))
        else:
            text = np.frombuffer(b" ".join(r.lower() for r in raws[at:end]) + b" ", np.uint8)
            space, starts, ends = spans(text)
            borders = np.cumsum([0, *(len(r) + 1 for r in raws[at:end])])
            out += _sets(hashes(text, space, starts, ends), np.searchsorted(starts, borders))
        at = end
    return out


def _sets(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sets of texts whose words begin at ``first``."""
    k = U(0xFF51AFD7ED558CCD)
    n = len(words) - WORDS + 1
    many = words[: max(n, 0)].copy()
    for i in range(1, WORDS):
        many *= k
        many += words[i : max(n, 0) + i]
    many = mix(many)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(many[a : b - WORDS + 1]))
        elif b > a:
            whole = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * k + w
            out.append(mix(np.array([whole ^ U(0x2545F4914F6CDD1D)], U)))
        else:
            out.append(np.empty(0, U))
    return out


def class_id(tokens: np.ndarray, doubled: frozenset[int] = frozenset()) -> int:
    """A 64-bit name of a set; the other half of its 128-bit digest where two sets have the first one (``doubled``)."""
    first, second = names_of(tokens)
    return second if first in doubled else first


def names_of(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _raws(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _common_of(gathered: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Shingles (of the lower half of the hash range) that occur twice or more, with their counts."""
    if not gathered:
        return [], []
    tokens, counts = np.unique(np.concatenate(gathered), return_counts=True)
    some = counts >= 2
    return tokens[some].view(np.int64).tolist(), counts[some].tolist()


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, cls and other (both halves of the set's name), n, bits of every row (null cls: empty set), and rows of
    batch counts (tokens, counts)."""
    schema = "doc_id long, cls long, other long, n long, bits binary, tokens array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64()] * 4 + [pa.binary()] + [pa.list_(pa.int64())] * 2
        gathered: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            ids, classes, others, sizes, rows = batch.column(0), [], [], [], []
            for tokens in shingle_sets(_raws(batch.column(1))):
                c, other = names_of(tokens) if len(tokens) else (None, None)
                classes.append(c)
                others.append(other)
                sizes.append(len(tokens))
                rows.append(bits_of(tokens, len(tokens)))
                if c is not None and c not in gathered:
                    gathered[c] = tokens[: int(np.searchsorted(tokens, U(2**63)))].copy()
                    size += len(gathered[c])
            columns = [ids, *(pa.array(c, pa.int64()) for c in (classes, others, sizes)), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(classes), t) for t in types[5:])], names=names)
            if size > GATHER:
                yield flush(gathered, names, types)
                gathered, size = {}, 0
        yield flush(gathered, names, types)

    def flush(gathered: dict[int, np.ndarray], names: list[str], types: list) -> pa.RecordBatch:
        tokens, counts = _common_of([*gathered.values()])
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None, None, None, None, None, tokens, counts], types)], names=names)

    return docs.mapInArrow(run, schema)


def ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Shingles in the global order: by hash, the common ones last."""
    if not len(common) or not len(tokens):
        return tokens
    at = np.searchsorted(common, tokens)
    late = common[np.minimum(at, len(common) - 1)] == tokens
    return np.concatenate([tokens[~late], tokens[late]]) if late.any() else tokens


def prefixes(docs: DataFrame, common, hot, buckets: int, doubled: frozenset[int]) -> DataFrame:
    """Rows (bucket, tokens, classes, sizes): packed prefix shingles; a negative size marks those
    beyond n // 7 + 1. Copies inside a batch go once. A shingle of more than HOT classes (``hot``: those
    shingles, and in how many parts they go) is dealt out by class too, to buckets below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(common.value, U)
        hot_tokens, hot_parts = (np.frombuffer(x, U) for x in hot.value)
        seen: set[int] = set()
        gathered: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) for t, _, _ in gathered], np.int64)
            tokens = np.concatenate([t for t, _, _ in gathered]) if gathered else np.empty(0, U)
            classes = np.repeat(np.array([c for _, c, _ in gathered], np.int64), lengths)
            n = np.repeat(np.array([n for _, _, n in gathered], np.int64), lengths)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            n = np.where(place <= n // 7, n, -n).astype(np.int32)
            bucket = ((tokens >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            if len(hot_tokens):
                at = np.minimum(np.searchsorted(hot_tokens, tokens), len(hot_tokens) - 1)
                split = np.flatnonzero(hot_tokens[at] == tokens)
                part = mix(classes[split].view(U)) % hot_parts[at[split]]
                bucket[split] = -1 - (mix(tokens[split] + part) >> U(2)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, classes, n = bucket[order], tokens[order], classes[order], n[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
            stops = np.r_[cuts[1:], len(bucket)] if len(cuts) else cuts
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pack(tokens), pack(classes), pack(n)], names=["bucket", "tokens", "classes", "sizes"])

        for batch in batches:
            for tokens in shingle_sets(_raws(batch.column(1))):
                n = len(tokens)
                if n and (c := class_id(tokens, doubled)) not in seen:
                    seen.add(c)
                    part = ordered(tokens, frequent)[: n // 4 + 1].copy()
                    gathered.append((part, c, n))
                    size += len(part)
            if size > GATHER:
                yield flush()
                gathered.clear()
                seen.clear()
                size = 0
        yield flush()

    return docs.mapInArrow(run, "bucket long, tokens binary, classes binary, sizes binary")


def postings(packed: DataFrame) -> DataFrame:
    """By bucket: candidate links (a, b), the smaller set first, of each class with the leaders of its
    postings, and the packed entries (token, cls, size) of postings that leaders don't settle: the long ones
    and all of those that are dealt out in parts."""
    schema = "tokens binary, classes binary, sizes binary, a array<long>, b array<long>"

    def run(table: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        tokens, classes, sizes = join("tokens", U), join("classes", np.int64), join("sizes", np.int32)
        parted = len(table) > 0 and table.column("bucket")[0].as_py() < 0
        order = np.lexsort([classes, tokens])
        tokens, classes, sizes = tokens[order], classes[order], sizes[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])]
        tokens, classes, sizes = tokens[new], classes[new], sizes[new]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        lengths = np.diff(np.r_[starts, len(tokens)])
        several = np.repeat(parted | (lengths > 1) & (np.maximum.reduceat(sizes, starts) > 0), lengths)
        tokens, classes, sizes = tokens[several], classes[several], sizes[several]
        a = b = np.empty(0, np.int64)
        if len(tokens):
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            lengths = np.diff(np.r_[starts, len(tokens)])
            first, length = np.repeat(starts, lengths), np.repeat(lengths, lengths)
            place = np.arange(len(tokens)) - first
            rows = [np.flatnonzero(place > k) for k in range(LEADERS)]
            lead = np.concatenate([first[r] + k for k, r in enumerate(rows)])
            rows = np.concatenate(rows)
            ok = possible(sizes[rows], sizes[lead])
            rows, lead = rows[ok], lead[ok]
            small = np.abs(sizes[rows]) < np.abs(sizes[lead])
            a, b = np.where(small, classes[rows], classes[lead]), np.where(small, classes[lead], classes[rows])
            order = np.lexsort([b, a])
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
            a, b = a[new], b[new]
            long = parted | (length > LEADERS + 1)
            tokens, classes, sizes = tokens[long], classes[long], sizes[long]
        row = [[tokens.tobytes()], [classes.tobytes()], [sizes.tobytes()], [a.tolist()], [b.tolist()]]
        types = [pa.binary()] * 3 + [pa.list_(pa.int64())] * 2
        return pa.table([pa.array(v, t) for v, t in zip(row, types)], names=["tokens", "classes", "sizes", "a", "b"])

    return packed.groupBy("bucket").applyInArrow(run, schema)


def possible(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these (signed) sizes that share this shingle can link by it."""
    x, y = np.abs(n.astype(np.int64)), np.abs(m.astype(np.int64))
    small = np.where(x < y, n, np.where(y < x, m, np.maximum(n, m)))
    return (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & (small > 0)


def bits_of(tokens: np.ndarray, n: int) -> bytes:
    """A bit row of a power of two of at least 2 n bits, one set for each shingle."""
    size = max(64, 1 << (2 * max(n, 1) - 1).bit_length())
    row = np.zeros(size, bool)
    row[(tokens & U(size - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").tobytes()


def _folded(row: np.ndarray, size: int) -> np.ndarray:
    """A bit row (bytes) of a smaller power of two: halves laid over each other."""
    return np.bitwise_or.reduce(row.reshape(-1, size), 0) if len(row) > size else row


def lacks(query: bytes, group: bytes) -> int:
    """At least so many of the query's shingles aren't in the group."""
    q, g = np.frombuffer(query, np.uint8), np.frombuffer(group, np.uint8)
    size = min(len(q), len(g))
    return int(np.bitwise_count(_folded(q, size) & ~_folded(g, size)).sum())


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that sizes and bits don't rule out."""
    bits = classes.select("cls", "n", "bits")
    near = pairs.join(bits.toDF("a", "a_n", "a_bits"), "a").join(bits.toDF("b", "b_n", "b_bits"), "b")
    near = near.where("4 * least(a_n, b_n) >= 3 * greatest(a_n, b_n)").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, p, m, q in zip(*(batch.column(c).to_pylist() for c in ("a_n", "a_bits", "b_n", "b_bits"))):
                need = -(-3 * (n + m) // 7)
                keep.append(n - lacks(p, q) >= need and m - lacks(q, p) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(bound, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, most: int, doubled: frozenset[int]) -> DataFrame:
    """cls, tokens of the wanted classes (doc_id, cls; at most ``most``), made anew from their texts."""
    rows = sized_join(docs, wanted, ["doc_id"], "inner", 20 * BROADCAST_ROWS, most).select("text", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(c, t) for c, t in zip(batch.column(1).to_pylist(), shingle_sets(_raws(batch.column(0)))) if len(t) and class_id(t, doubled) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([t.tobytes() for _, t in got], pa.binary())], names=["cls", "tokens"])

    return rows.mapInArrow(run, "cls long, tokens binary")


def verified(near: DataFrame, pairs: int, classes: DataFrame, docs: DataFrame, repeats: bool, doubled: frozenset[int]) -> DataFrame:
    """The links among the pairs (a, b) that bits leave, of about ``pairs`` that met, as a written table; sets are made
    only for classes in them."""
    near = written(near, "near", HEAVY * pairs)
    left = near.count()
    wanted = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    tokens = sets_of(docs, wanted.join(classes, "cls").select("doc_id", "cls"), 2 * left, doubled)
    tokens = written(tokens.dropDuplicates(["cls"]) if repeats else tokens, "sets")
    whole = near.join(tokens.toDF("a", "a_tokens"), "a").join(tokens.toDF("b", "b_tokens"), "b").select("a", "b", "a_tokens", "b_tokens")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(4 * common >= 3 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(whole.mapInArrow(exact, "a long, b long"), "links", 4 * HEAVY * left)


def _entries(found: DataFrame) -> DataFrame:
    """token, cls, size: the packed entries as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                arrays = [pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int64)), pa.array(np.frombuffer(n, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "cls", "size"])

    return found.select("tokens", "classes", "sizes").mapInArrow(run, "token long, cls long, size int")


def _band(size: Column) -> Column:
    """Sizes by the power of 4/3 (a little more, so that rounding can't matter) that they reach."""
    return F.floor(F.log(size.cast("double")) / math.log(1.334)).cast("int")


class Matrix:
    """Groups in slices with their union rows, and the queries that meet them in postings.

    Groups are the linked ones (settled by one link) and, among classes that nothing linked yet, those
    of one least shared shingle and about one size (where every pair counts)."""

    def __init__(self, entries: DataFrame, many: int, grouped: DataFrame, classes: DataFrame):
        """``many``: the number of entries."""
        total = grouped.count()
        sizes = written(grouped.groupBy("root").agg((F.count("*") + 1).alias("members")), "sizes", total)
        rooted = spread_join(grouped, sizes, "root", "members", total).select(F.col("vertex").alias("cls"), F.col("root").alias("grp"), "members")
        self.rooted = written(rooted.unionByName(sizes.select(F.col("root").alias("cls"), F.col("root").alias("grp"), "members")), "groups", 2 * total)
        alone = entries.join(self.rooted, "cls", "left_anti").groupBy("cls").agg(F.min("token").alias("t"), F.max(F.abs("size")).alias("n"))
        alone = alone.select("cls", F.xxhash64("t", F.floor(F.log("n") / SIZE_BAND)).alias("grp"))
        alone = written(alone, "alone", many)
        counts = alone.groupBy("grp").agg(F.count("*").alias("members"))
        alone = spread_join(alone, counts, "grp", "members", alone.count()).select("cls", "grp", "members", F.lit(False).alias("linked"))
        groups = written(self.rooted.withColumn("linked", F.lit(True)).unionByName(alone), "groups", 2 * total + many)
        self.meets = written(self._meets(entries.join(groups, "cls")), "meets", 4 * many)
        self.met = self.meets.count()
        slices = classes.select("cls", "n", "bits").join(groups, "cls").withColumn("slice", F.pmod(F.xxhash64("cls"), F.ceil(F.col("members") / SLICE)))
        slices = slices.groupBy(F.col("grp").alias("to"), "linked", "slice").agg(F.collect_list(F.struct("cls", "n", "bits")).alias("m"))
        slices = slices.select("to", "linked", "slice", F.col("m.cls").alias("ids"), F.col("m.n").alias("sizes"), F.col("m.bits").alias("rows"))
        schema = "to long, linked boolean, slice long, ids array<long>, sizes array<long>, rows array<binary>, row binary"
        self.rows = slices.mapInArrow(self._unions, schema).withColumns({"low": F.array_min("sizes"), "high": F.array_max("sizes")})
        self.queries = classes.select("cls", "n", "bits")

    @staticmethod
    def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(5).to_pylist():
                size = max(map(len, rows))
                row = np.zeros(size, np.uint8)
                for r in rows:
                    row |= np.tile(np.frombuffer(r, np.uint8), size // len(r))
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["to", "linked", "slice", "ids", "sizes", "rows", "row"])

    @staticmethod
    def _meets(placed: DataFrame) -> DataFrame:
        """(cls, to, own): queries and the groups to ask. Of two linked groups in a posting the smaller one
        asks, unlinked classes ask linked groups, and of two unlinked groups one, or the same, is asked."""
        at = placed.groupBy("token", "grp", "members", "linked").agg(
            F.min(F.abs("size")).alias("low"), F.max(F.abs("size")).alias("high"), F.max("size").alias("marked"), F.count("*").alias("here")
        )
        # sizes that may link lie in one band or in two next to each other, so sides of other sizes don't even meet
        other = at.toDF("token", "to", "to_members", "to_linked", "low", "high", "marked", "here")
        other = other.withColumn("band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("high")))))
        own = _band(F.abs("size"))
        placed = placed.withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
        meets = placed.join(other, ["token", "band"]).where(
            "4 * high >= 3 * abs(size) and 4 * abs(size) >= 3 * low and (size > 0 or marked > 0) and ("
            "(to_linked and (not linked or to_members > members or (to_members = members and `to` < grp)))"
            " or (not to_linked and not linked and (`to` < grp or (`to` = grp and here > 1))))"
        )
        return meets.select("cls", "to", (F.col("to") == F.col("grp")).alias("own")).distinct()

    def opened(self, meets: DataFrame, most: int | None) -> DataFrame:
        """(a, b): queries with the members of the slices that qualify, as far as bits leave them; ``most``:
        only so many nearest ones of each slice of a linked group."""
        asked = meets.join(self.queries, "cls").join(self.rows, "to").where("4 * high >= 3 * n and 4 * n >= 3 * low")
        names = ["cls", "n", "bits", "row", "ids", "sizes", "rows", "linked", "own", "low"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a: list[int] = []
                b: list[int] = []
                for c, n, q, union, ids, sizes, rows, linked, own, low in zip(*(batch.column(i).to_pylist() for i in range(10))):
                    # a member has at least ``low`` shingles, so that many of the query's must be in the union
                    if n - lacks(q, union) < max(-(-3 * (n + low) // 7), -(-3 * n // 4)):
                        continue
                    near = []
                    for i, m, row in zip(ids, sizes, rows):
                        need = -(-3 * (n + m) // 7)
                        if own and i >= c or n - (x := lacks(q, row)) < need or m - (y := lacks(row, q)) < need:
                            continue
                        near.append((x + y, i))
                    near = sorted(near)[: most if linked else None]
                    a += [c] * len(near)
                    b += [i for _, i in near]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return asked.select(*names).mapInArrow(run, "a long, b long")

    def unsettled(self, roots: DataFrame) -> DataFrame:
        """Those meets with groups of more than NEAREST members whose sides aren't connected by now."""
        ask = roots.toDF("cls", "__own")
        far = self.meets.join(self.rooted.where(f"cls = grp and members > {NEAREST}").select(F.col("cls").alias("to")), "to", "left_semi")
        far = far.join(ask, "cls", "left").join(roots.toDF("to", "__its"), "to", "left")
        return far.where("coalesce(__own, cls) <> coalesce(__its, `to`)").select("cls", "to", "own")


def roots_of(docs: DataFrame, profiled: DataFrame, classes: DataFrame, doubled: frozenset[int]) -> DataFrame:
    """(vertex, root) of the classes that link with a lesser one, through others or not."""
    spark = docs.sparkSession
    shingles = profiled.where("doc_id is not null").agg(F.sum(F.expr("n div 4 + 1"))).first()[0]
    counted = profiled.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    counted = counted.groupBy(F.col("x.tokens").alias("t")).agg(F.sum("x.counts").alias("c")).where(F.col("c") >= LEAST_COMMON)
    counted = written(counted, "counted", 4 * (shingles or 0) // LEAST_COMMON)
    threshold, left = 1 << 40, MOST_COMMON  # powers of two, so that the histogram is a few rows
    for row in counted.groupBy(F.floor(F.log2("c")).alias("p")).count().orderBy(F.desc("p")).collect():
        left -= row["count"]
        if left < 0:
            break
        threshold = 1 << row["p"]
    found = counted.where(F.col("c") >= threshold).select("t", "c").toArrow()
    order = np.argsort(found.column("t").to_numpy().view(U))
    common, often = found.column("t").to_numpy().view(U)[order], found.column("c").to_numpy()[order]
    shared = spark.sparkContext.broadcast(common.tobytes())
    hot = spark.sparkContext.broadcast((common[often > HOT].tobytes(), (-(-often[often > HOT] // HOT)).astype(U).tobytes()))
    buckets = max(8, -(-(shingles or 0) // BUCKET_SHINGLES))
    found = written(postings(prefixes(docs, shared, hot, buckets, doubled)), "postings")
    entries = _entries(found)
    met, many = (x or 0 for x in found.agg(F.sum(F.size("a")), F.sum(F.expr("length(tokens) div 8"))).first())
    repeats = profiled.where("cls is not null and doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    check = lambda pairs, met: verified(pairs, met, classes, docs, repeats, doubled)
    links = check(bounded(found.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b").distinct(), classes), met)
    n = links.count()
    matrix = Matrix(entries, many, components(links, n), classes)
    more = check(matrix.opened(matrix.meets, NEAREST), matrix.met)
    links, n = links.unionByName(more), n + more.count()
    roots = components(links, n)
    unsettled = written(matrix.unsettled(roots), "unsettled", matrix.met)
    left = unsettled.count()
    if not left:
        return roots
    more = check(matrix.opened(unsettled, None), left * SLICE)
    return components(links.unionByName(more), n + more.count())


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiled = written(profile(docs.select("doc_id", "text")), "profile")
    total = profiled.count()

    def by_class(rows: DataFrame) -> DataFrame:
        own = rows.where("cls is not null and doc_id is not null").groupBy("cls")
        return written(own.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"), (F.min("other") != F.max("other")).alias("two")), "classes", HEAVY * total)

    classes = by_class(profiled)
    # sets that share the first half of their name, one pair or so among 10 ** 10, go by the second half
    doubled = frozenset(r["cls"] for r in classes.where("two").select("cls").toLocalIterator())
    if doubled:
        profiled = profiled.withColumn("cls", F.when(F.col("cls").isin(*doubled), F.col("other")).otherwise(F.col("cls")))
        classes = by_class(profiled)
    classes = classes.drop("two")
    # null ids link with nothing
    known = profiled.where("doc_id is not null or tokens is not null")
    roots = roots_of(docs.where("doc_id is not null"), known, classes, doubled).withColumnRenamed("vertex", "cls")
    rows = profiled.where("tokens is null").select("doc_id", "cls", "n")
    # classes that link with a lesser one, and the roots that others point at; all others are their own component
    inside = classes.select("cls", "doc_id").join(roots, "cls")
    tops = roots.select(F.col("root").alias("cls")).distinct().join(classes.select("cls", "doc_id"), "cls").withColumn("root", F.col("cls"))
    inside = written(inside.unionByName(tops), "inside", total)
    least = inside.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    inside = spread_join(inside, least, "root", "members", inside.count()).select("cls", "component_id")
    own = classes.select("cls", "doc_id", "copies").join(inside, "cls", "left").select("cls", "copies", F.coalesce("component_id", "doc_id").alias("component_id"))
    own = written(own, "own", total)
    out = spread_join(rows.where("doc_id is not null"), own, "cls", "copies", total).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("cls is null or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(doc_id is null, null, coalesce(component_id, doc_id))").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the least id of each component, and one row of an id (that of the least hash
    of id and text); null ids stay."""
    found = written(join(docs), "components")
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    rows = boxed(docs, id=F.col("doc_id").cast("long"), h=F.xxhash64(F.col("text").cast("string")))
    rows = sized_join(rows, gone, ["id"]).where("gone is null").drop("gone")
    twice = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    if twice.limit(1).count():
        one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min_by("box", "h").alias("box"))
        rows = rows.join(twice, "id", "left_anti").select("box").unionByName(one.select("box"))
    return rows.select("box.*")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


SQL = {
    "op9_ngram_jaccard_join": r"""
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0d]+'), lambda x: x <> '') as w from documents),
    s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
    c as (select min(doc_id) as id, list_sort(s) as s from s group by list_sort(s)),
    t as (select id, len(s) as n, unnest(s) as t from c where len(s) > 0),
    k as (select a.id as a, b.id as b from t a join t b on a.t = b.t and a.id < b.id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
        group by a.id, b.id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    e as (select a, b from k union select b, a from k),
    r(v, root) as (select a, a from e union select e.b, r.root from r join e on e.a = r.v and r.root < e.b),
    m as (select v, min(root) as root from r group by v)
    select s.doc_id, len(s.s)::bigint as n_shingles, case when len(s.s) = 0 then s.doc_id else coalesce(m.root, c.id) end as component_id
    from s join c on c.s = list_sort(s.s) left join m on m.v = c.id"""
}
QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
