"""BPE encoding and decoding: speculate, verify, and merge exactly where that fails.

Each distinct word (piece of the byte-level pre-tokenizer) is first cut greedily into the longest
known tokens. Every adjacent pair of proposed tokens is then tested for compatibility, vectorised
over all new pairs at once; if all pairs pass, the proposal is what merging in rank order gives.
Only failing words are merged exactly (heap over ranks, O(n log n) in the word's length).

Why pairs suffice: while a token grows by merges, its rightmost part runs through the token's
right spine and its leftmost part through the left spine, each part living from the rank that made
it to the rank that consumes it. Two neighbours stay apart exactly if no merge (x, y) of a right
spine part x and a left spine part y comes up while both live; equal ranks go left to right.
Tokens that their own bytes don't merge to are left to exact merging.

Results equal the tokenizers library's for byte-level BPE files without normalizer, prefix space or
post-processing; strings of special tokens in a text become their ids. Defined results: null and
empty texts have no ids and decode to the empty text; rows repeat as they come; an empty table gives no
rows. Columns of any names pass through; an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, numbered, plus, read, small_batches

#: Fixed value: the byte-level pre-tokenizer's pattern; white space is Unicode's property of that name.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words that a worker keeps in each of two generations, token pairs that it remembers, and characters
#: of text that it handles at once.
MOST_WORDS, MOST_PAIRS, CHUNK_CHARS = 150_000, 200_000, 1_000_000
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Model:
    """A byte-level BPE model from the text of its JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.at_added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.split, self.border = regex.compile(PATTERN), regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
        self.plain_added = not any(self.border.search(t) for t in added)
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.longest = max(map(len, self.id_of))
        self.byte_id = [self.id_of.get(bytes([b])) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        left, right, rank = (np.full(size, -1, np.int64) for _ in range(3))
        sound = np.ones(size, bool)
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = r, z
            sound[z] &= rank[z] < 0  # a token of two merges has no one history
            left[z], right[z], rank[z] = x, y, r
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], NEVER), np.append(ranks[order], NEVER)
        self.right_spine, self.right_ends = self._spines(right, rank)
        self.left_spine, self.left_ends = self._spines(left, rank)
        made = np.nonzero(rank >= 0)[0]
        sound[made] &= self._first_crossing(left[made], right[made], rank[made]) >= rank[made]
        for z in made[np.argsort(rank[made])]:
            sound[z] &= sound[left[z]] and sound[right[z]]
        for i in added.values():
            sound[i] = False
        self.sound = sound.tolist()
        self.words: dict[str | tuple, bytes] = {}
        self.old: dict[str | tuple, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _spines(child: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[token, depth]: the parts at one end of each token, and the rank that consumes each."""
        parts, ends = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while True:
            last = parts[-1]
            down = np.where(last >= 0, child[last], -1)
            if (down < 0).all():
                return np.stack(parts, 1), np.stack(ends, 1)
            ends.append(np.where(down >= 0, rank[last], -1))
            parts.append(down)

    def _first_crossing(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For token pairs: the least rank at which a merge crosses their border while both parts live."""
        out = np.full(len(a), NEVER)
        for i in range(self.right_spine.shape[1]):
            x, x_end = self.right_spine[a, i], self.right_ends[a, i]
            rows = np.nonzero(x >= 0)[0]
            if not len(rows):
                break
            for j in range(self.left_spine.shape[1]):
                rows = rows[self.left_spine[b[rows], j] >= 0]
                if not len(rows):
                    break
                y, y_end = self.left_spine[b[rows], j], self.left_ends[b[rows], j]
                key = x[rows] * self.size + y
                at = np.searchsorted(self.keys, key)
                r = np.where(self.keys[at] == key, self.ranks[at], NEVER)
                out[rows] = np.where((r < x_end[rows]) & (r <= y_end) & (r < out[rows]), r, out[rows])
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids = [], 0, len(word), self.id_of
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
            else:
                raise ValueError(f"no token for byte {word[at]}")
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the least rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], made, ids[after[i]]))
            if (p := before[i]) >= 0 and (m := self.merges.get((ids[p], made))):
                heapq.heappush(heap, (m[0], p, m[1], ids[p], made))
        return [i for i in ids if i >= 0]

    def _compatible(self, proposals: list[list[int]]) -> list[bool]:
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(lengths.sum()))
        first, second = flat[:-1], flat[1:]
        ends = np.cumsum(lengths)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False
        keys, where = np.unique(first[inner] * self.size + second[inner], return_inverse=True)
        known = [self.pairs.get(k) for k in keys.tolist()]
        new = np.array([k for k, v in zip(keys.tolist(), known) if v is None], np.int64)
        if len(new):
            good = self._first_crossing(new // self.size, new % self.size) == NEVER
            if len(self.pairs) + len(new) > MOST_PAIRS:
                self.pairs.clear()
            self.pairs.update(zip(new.tolist(), good.tolist()))
            fresh = dict(zip(new.tolist(), good.tolist()))
            known = [fresh[k] if v is None else v for k, v in zip(keys.tolist(), known)]
        bad = np.zeros(max(len(flat), 1), np.int64)
        bad[np.nonzero(inner)[0]] = ~np.array(known, bool)[where] if len(keys) else 0
        sound = np.array(self.sound)[flat]
        fails = np.add.reduceat(bad[: len(flat)] + ~sound, ends - lengths)
        return (fails == 0).tolist()

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of new words, as little-endian 32-bit ids, into self.words."""
        if not words:
            return
        raw = [w.encode() for w in words]
        proposals = [[self.id_of[r]] if r in self.id_of else self.propose(r) for r in raw]
        for w, r, p, good in zip(words, raw, proposals, self._compatible(proposals)):
            self.words[w] = np.array(p if good else self.merge(r), "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand between them as themselves."""
        if self.at_added is None or not self.at_added.search(text):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append((m[0],))
            at = m.end()
        return out + self.split.findall(text[at:])

    def sections(self, text: str) -> Iterator[str]:
        """A long text in sections of about CHUNK_CHARS that are encoded one by one: no word goes on from other
        characters into white space, so each such place is a border between words."""
        at = 0
        while self.plain_added and len(text) - at > 2 * CHUNK_CHARS and (m := self.border.search(text, at + CHUNK_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Texts, and the sections of long ones, are
        handled about CHUNK_CHARS characters at a time."""
        parts = [list(self.sections(t)) for t in texts]
        done = iter(self._encoded([x for p in parts for x in p]))
        return [next(done) if len(p) == 1 else b"".join(next(done) for _ in p) for p in parts]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self._pieces(t) for t in texts[at:end]]
            needed = set().union(*split)
            if len(self.words) > MOST_WORDS:
                self.old, self.words = self.words, {}
            new = []
            for w in needed.difference(self.words):
                if (ids := self.old.get(w)) is not None:
                    self.words[w] = ids
                elif isinstance(w, tuple):
                    self.words[w] = np.array([self.added[w[0]]], "<u4").tobytes()
                else:
                    new.append(w)
            self.learn(new)
            get = self.words.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            at = end
        return out

    def decode(self, ids: bytes) -> str:
        all_ids, get = np.frombuffer(ids, "<u4"), self.bytes_of.__getitem__
        parts = (all_ids[at : at + CHUNK_CHARS].tolist() for at in range(0, len(all_ids), CHUNK_CHARS))
        return b"".join(b"".join(map(get, part)) for part in parts).decode("utf-8", "replace")


def _source(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _model(source: str) -> Model:
    """One model in each Python worker, whatever number of tasks it runs. Functions come to workers as code of their
    own for each stage, so what outlives a task is kept by the interpreter's own module."""
    kept = sys.__dict__.setdefault("_seqloom_bpe", {})
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = Model(source)
    return kept[key]


def with_ids(df: DataFrame, text: str = "text", path: str | None = None, decode: bool = False) -> DataFrame:
    """``df`` plus ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and, if asked for,
    ``decoded``, the text that the ids decode to. The model (a file of fixed size) is broadcast."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_source(path))
    names = free_names(df.columns, ["ids", "n_tokens", "decoded"][: 2 + decode])
    schema = plus(df, ", ".join(f"{n} {t}" for n, t in zip(names, ["binary", "long", "string"])))

    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for at in _slices(batch.column(column)):
                part = batch.slice(*at)
                ids = model.encode([t or "" for t in part.column(column).to_pylist()])
                arrays = [*part.columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if decode:
                    arrays.append(pa.array([model.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return numbered(df).mapInArrow(run, schema)


def _slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of texts of up to ``most`` bytes together, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > most:
            yield at, i - at
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes) - at


def with_text(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` plus ``decoded``: the text of a column of ids as ``with_ids`` makes it; null ids: empty."""
    shared = df.sparkSession.sparkContext.broadcast(_source(path))
    schema = plus(df, f"{free_names(df.columns, ['decoded'])[0]} string")
    column = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            texts = [model.decode(i or b"") for i in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return numbered(df).mapInArrow(run, schema)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), decode=True)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
