"""Media columns: MPEG audio.

``frame_offsets`` reads any MPEG-1/2/2.5 audio stream: it skips and parses ID3 tags, resynchronises
on frame headers (a header counts if the stream ends, or another one of the same kind stands,
where its frame ends), reads Xing/Info and VBRI tables, verifies the checksum of protected Layer
III frames, and gives exact durations (samples over sample rate) and the offset of each frame.

``store`` lays a payload down as such a stream: an ID3v2.3 tag with the payload's length, an Info
frame with frame count, byte count and seek table, then one protected Layer III frame (224 kbit/s,
48 kHz, mono data in a stereo frame) for each 576 payload bytes, which stand in the frame's main
data as they are, but for three zero bytes where an ID3v1 tag would begin if the stream ended with
the frame: no payload can look like one. ``load`` reads them back. Defined results: null and empty texts are a payload of
576 bytes 255; equal texts give equal bytes; rows repeat as they come. Broken streams give what
frames can be found; no frames: no payload, zero samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, numbered, plus, quoted, read, small_batches

UNIT = 576
#: kbit/s by header index, for (MPEG-1, layer) and (MPEG-2 and 2.5, layer).
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
#: Samples a second of MPEG-1 by header index; MPEG-2 has half, MPEG-2.5 a quarter.
RATES = [44100, 48000, 32000]
HEADER, INFO_HEADER = bytes([0xFF, 0xFA, 0xC4, 0x00]), bytes([0xFF, 0xFB, 0xC4, 0x00])
FRAME_BYTES, SIDE = 672, 32
BODY = 4 + 2 + SIDE
#: Payload bytes of a frame before the three bytes that are 128 bytes from its end, and those after them.
HEAD = FRAME_BYTES - 128 - BODY
REST = BODY + HEAD + 3


def header(four: bytes) -> dict | None:
    """What a frame header says; None if it isn't one or the bitrate is free."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1.0, 2: 2.0, 0: 2.5}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate_at, kbit_at = four[2] >> 2 & 3, four[2] >> 4
    if version is None or layer == 4 or rate_at == 3 or kbit_at in (0, 15) or four[3] & 3 == 2:
        return None
    kbit = BITRATES[1 if version == 1 else 2, layer][kbit_at]
    rate = int(RATES[rate_at] / {1.0: 1, 2.0: 2, 2.5: 4}[version])
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    pad = four[2] >> 1 & 1
    size = (12000 * kbit // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else 9 if mono else 17
    return {"version": version, "layer": layer, "rate": rate, "kbit": kbit, "samples": samples, "size": size, "side": side, "protected": not four[1] & 1}


_known: dict[bytes, dict | None] = {}


def _header(four: bytes) -> dict | None:
    if four not in _known:
        if len(_known) > 10_000:
            _known.clear()
        _known[four] = header(four)
    return _known[four]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes (polynomial 0x8005, all ones at first)."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ CRC[(crc >> 8) ^ column]
    return crc


def tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(start of audio, end of audio, ID3 text fields) of a stream."""
    at, end, found = 0, len(data), {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 127) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
        stop, p = min(at + 10 + size, len(data)), at + 10
        while p + 10 <= stop and data[p] and data[at + 3] in (3, 4):
            n = int.from_bytes(data[p + 4 : p + 8], "big") if data[at + 3] == 3 else sum((b & 127) << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0)))
            name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : min(p + 10 + n, stop)]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                found[key] = value.rstrip("\0")
            p += 10 + n
        at = stop
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if value := data[end + a : end + b].split(b"\0")[0].strip().decode("latin-1"):
                found.setdefault(key, value)
    return at, end, found


def vbr_table(frame: bytes, side: int) -> dict | None:
    """A Xing, Info or VBRI table in the first frame."""
    at = 4 + side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out, flags, p = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["seek"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        total, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        table = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": total, "frames": frames, "seek": table}
    return None


def frame_offsets(data: bytes) -> dict:
    """Offsets (and sizes) of all audio frames, samples, rate, table, tags, checksums and skipped bytes."""
    at, end, found = tags(data)
    view = np.frombuffer(data, np.uint8)
    runs: list[tuple[int, int, dict]] = []  # start, frames, header
    table, skipped, first = None, 0, True
    while at + 4 <= end:
        h = _header(data[at : at + 4])
        if h is not None and at + h["size"] > end:
            h = None
        if h is not None and (not runs or skipped and runs[-1][0] + runs[-1][1] * runs[-1][2]["size"] != at) and at + h["size"] + 4 <= end:
            after = _header(data[at + h["size"] : at + h["size"] + 4])
            if after is None or (after["version"], after["layer"], after["rate"]) != (h["version"], h["layer"], h["rate"]):
                h = None
        if h is None:
            step = data.find(b"\xff", at + 1, end)
            step = step if step >= 0 else end
            skipped += step - at
            at = step
            continue
        size = h["size"]
        if first:
            first = False
            table = vbr_table(data[at : at + size], h["side"])
            if table:
                at += size
                continue
        most = (end - at) // size
        same = (view[at : at + most * size].reshape(most, size)[:, :4] == view[at : at + 4]).all(1)
        count = most if same.all() else int(same.argmin())
        runs.append((at, count, h))
        at += count * size
    skipped += max(0, end - at)
    good = bad = samples = 0
    offsets = []
    for start, count, h in runs:
        offsets.append(start + np.arange(count, dtype=np.int64) * h["size"])
        samples += count * h["samples"]
        if h["protected"] and h["layer"] == 3:
            frames = view[start : start + count * h["size"]].reshape(count, h["size"])
            ok = crc16(np.concatenate([frames[:, 2:4], frames[:, 6 : 6 + h["side"]]], 1)) == frames[:, 4].astype(np.uint32) * 256 + frames[:, 5]
            good, bad = good + int(ok.sum()), bad + int((~ok).sum())
    return {
        "offsets": np.concatenate(offsets) if offsets else np.empty(0, np.int64),
        "runs": runs,
        "samples": samples,
        "rate": runs[0][2]["rate"] if runs else 0,
        "table": table,
        "tags": found,
        "crc_good": good,
        "crc_bad": bad,
        "skipped": skipped,
    }


def store(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds a payload of a positive multiple of 576 bytes."""
    frames = len(payload) // UNIT
    side = bytes(SIDE)
    check = int(crc16(np.frombuffer(HEADER[2:] + side, np.uint8)[None])[0]).to_bytes(2, "big")
    body = np.zeros((frames, FRAME_BYTES), np.uint8)
    body[:, :BODY] = np.frombuffer(HEADER + check + side, np.uint8)
    units = np.frombuffer(payload, np.uint8).reshape(frames, UNIT)
    body[:, BODY : BODY + HEAD], body[:, REST : REST + UNIT - HEAD] = units[:, :HEAD], units[:, HEAD:]
    total = (frames + 1) * FRAME_BYTES
    seek = bytes(min(255, 256 * (FRAME_BYTES + i * frames // 100 * FRAME_BYTES) // total) for i in range(100))
    info = (INFO_HEADER + side + b"Info" + struct.pack(">III", 7, frames, total) + seek).ljust(FRAME_BYTES, b"\0")
    field = b"\0n_bytes\0" + str(n_bytes).encode()
    frame = b"TXXX" + struct.pack(">I", len(field)) + b"\0\0" + field
    size = bytes(len(frame) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + size + frame + info + body.tobytes()


def load(data: bytes) -> tuple[bytes, dict]:
    """(payload, what frame_offsets found) of a stored stream."""
    found = frame_offsets(data)
    view = np.frombuffer(data, np.uint8)
    frames = [view[s : s + n * h["size"]].reshape(n, h["size"]) for s, n, h in found["runs"]]
    parts = [np.concatenate([f[:, BODY : BODY + HEAD], f[:, REST : REST + UNIT - HEAD]], 1).tobytes() for f in frames]
    return b"".join(parts), found


def _parts(column: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > most:
            yield at, i - at
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield at, len(sizes) - at


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, plus n_bytes and media: the text stored as MPEG audio."""
    keep = [c for c in df.columns if c != text]
    kept = df.select(*map(quoted, keep))
    schema = plus(kept, "{} long, {} binary".format(*free_names(keep, ["n_bytes", "media"])))
    df = df.select(*map(quoted, keep), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _parts(batch.column(len(keep))):
                part = batch.slice(*at)
                raw = part.column(len(keep)).to_pylist()
                media = [store(r.ljust(max(1, -(-len(r) // UNIT)) * UNIT, b"\xff"), len(r)) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=schema.names
                )

    return numbered(df).mapInArrow(run, schema)


FOUND = "payload binary, n_frames long, n_samples long, sample_rate int, seek_offsets array<long>, n_crc_good long, n_crc_bad long, n_skipped long, table_kind string, tag_n_bytes long"


def with_found(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` plus what its media column holds: payload, exact duration (n_samples over sample_rate),
    frame seek offsets, checksums, skipped bytes, table and tag."""
    names, kinds = zip(*(f.split() for f in FOUND.split(", ")))
    small_batches(df.sparkSession)
    schema = plus(df, ", ".join(f"{n} {k}" for n, k in zip(free_names(df.columns, names), kinds)))
    column = df.columns.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _parts(batch.column(column)):
                part = batch.slice(*at)
                got = [load(m or b"") for m in part.column(column).to_pylist()]
                f = [x for _, x in got]
                lengths = np.array([0, *(len(x["offsets"]) for x in f)])
                offsets = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(x["offsets"] for x in f)])))
                new = [
                    pa.array([p for p, _ in got], pa.binary()),
                    pa.array(lengths[1:], pa.int64()),
                    pa.array([x["samples"] for x in f], pa.int64()),
                    pa.array([x["rate"] for x in f], pa.int32()),
                    offsets,
                    pa.array([x["crc_good"] for x in f], pa.int64()),
                    pa.array([x["crc_bad"] for x in f], pa.int64()),
                    pa.array([x["skipped"] for x in f], pa.int64()),
                    pa.array([x["table"]["kind"] if x["table"] else None for x in f], pa.string()),
                    pa.array([int(n) if (n := x["tags"].get("n_bytes", "")).isdigit() else None for x in f], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return numbered(df).mapInArrow(run, schema)


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_found(with_media(read(spark, sf_dir, "documents").select("doc_id", "text")))
    duration = F.concat_ws("/", F.col("n_samples"), F.col("sample_rate"))
    seek = F.sha2(F.concat_ws(",", F.col("seek_offsets").cast("array<string>")).cast("binary"), 256)
    return rows.select(
        "doc_id",
        F.col("tag_n_bytes").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("duration="), duration), F.concat(F.lit("crc="), "n_crc_good", F.lit("/"), "n_crc_bad"),
            F.concat(F.lit("skipped="), "n_skipped"), F.concat(F.lit("table="), "table_kind"), F.concat(F.lit("seek="), seek),
        ).alias("feature"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op8_mpeg_audio": op8_mpeg_audio}
