"""Media columns: telephony audio.

A clip's bytes are kept verbatim in a RIFF/WAVE file as 8-bit mu-law, 8-bit
A-law or 4-bit IMA ADPCM blocks, all three mono at 8 kHz, so storing loses
nothing. Reading gives the bytes back and decodes them to 16-bit PCM: mu-law
and A-law by 256-entry lookup tables, ADPCM step by step but across all blocks
of a batch at once. ``resample`` brings PCM to another rate in whole numbers
(means of samples at a whole part of the rate, else linear interpolation), and the
resampled PCM is stored as a table of its own (``stored_pcm``), from which the
features are computed.

Null payloads count as empty; every clip is padded with byte 32 to a positive
multiple of ``BLOCK`` bytes, so empty clips have one block. Clips are coded one
by one: long ones are split over blocks, repeated rows give repeated rows with
equal values, an empty table gives empty tables. Columns other than the id and
the payload are not read, and may have any names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm.store import written
from noteflow.sources.splits import spread

BLOCK, RATE = 192, 8000
#: Rate of the stored PCM; at 4000 its files were 0.92 times as large as the texts, with the media 1.59 times.
PCM_RATE = 2000
MULAW, ALAW, ADPCM = 7, 6, 17  # WAVE format tags
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}
#: Bytes of payload that are decoded at once.
BATCH_BYTES = 4 << 20

# Fixed values of IMA ADPCM: step sizes and changes of the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: code to 16-bit sample."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: code to 16-bit sample."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment = (code >> 4) & 7
    size = ((code & 0x0F) << 4) + 8 + np.where(segment > 0, 0x100, 0) << np.maximum(segment - 1, 0)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, BLOCK) of bytes to samples (n, 2 * (BLOCK - 4) + 1); one step for all blocks at a time.

    A step index over 88 in a block's header counts as 88.
    """
    n = len(blocks)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * codes.shape[0] + 1, n), dtype=np.int16)
    out[0] = sample
    for i, pair in enumerate(codes):
        for j, code in ((1, pair & 15), (2, pair >> 4)):
            step = STEPS[index]
            size = code & 7
            change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            sample += np.where(code & 8, -change, change)
            np.clip(sample, -32768, 32767, out=sample)
            index += INDEX_CHANGE[size]
            np.clip(index, 0, 88, out=index)
            out[2 * i + j] = sample
    return out.T


def wave(payload: bytes, tag: int) -> bytes:
    """A RIFF/WAVE file that holds the payload as it is."""
    if tag == ADPCM:
        per_block = 2 * (BLOCK - 4) + 1
        samples, align, bits, extra = len(payload) // BLOCK * per_block, BLOCK, 4, struct.pack("<HH", 2, per_block)
        rate = RATE * BLOCK // per_block
    else:
        samples, align, bits, extra, rate = len(payload), 1, 8, struct.pack("<H", 0), RATE
    form = struct.pack("<HHIIHH", tag, 1, RATE, rate, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and payload of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(clips: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of each (tag, payload); the ADPCM blocks of all clips are decoded together."""
    out: list[np.ndarray | None] = [None if tag == ADPCM else TABLES[tag][np.frombuffer(p, np.uint8)] for tag, p in clips]
    coded = [i for i, (tag, _) in enumerate(clips) if tag == ADPCM]
    if coded:
        samples = decode_adpcm(np.frombuffer(b"".join(clips[i][1] for i in coded), np.uint8).reshape(-1, BLOCK))
        ends = np.cumsum([len(clips[i][1]) // BLOCK for i in coded])
        for i, part in zip(coded, np.split(samples, ends[:-1])):
            out[i] = part.reshape(-1)
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """At a whole part of the rate the mean of that many samples, else linear interpolation between the two nearest, rounded down."""
    if rate == to or not len(pcm):
        return pcm
    if rate % to == 0:
        every = rate // to
        sums = np.add.reduceat(pcm.astype(np.int64), np.arange(0, len(pcm), every))
        return (sums // np.minimum(every, len(pcm) - np.arange(0, len(pcm), every))).astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    place = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = place // to, place % to
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (to - part) + pcm[right].astype(np.int64) * part) // to).astype(np.int16)


def padded(payload: bytes) -> bytes:
    return payload + b" " * (-len(payload) % BLOCK or (0 if payload else BLOCK))


def to_media(clips: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """doc_id, n_bytes, media: a WAVE file per row. The codec follows from the payload's checksum."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, payload in zip(batch["doc_id"], batch["payload"]):
                full = padded(payload)
                rows.append((key, len(payload), wave(full, (MULAW, ALAW, ADPCM)[zlib.crc32(full) % 3])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media"]).astype({"doc_id": "Int64"})

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return spread(clips).select(F.col(id_col).cast("long").alias("doc_id"), payload.alias("payload")).mapInPandas(store, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pd.DataFrame], rate: int) -> Iterator[tuple[list, list[bytes], list[tuple[int, bytes]], list[np.ndarray]]]:
    """Rows, media, clips and resampled PCM, a bounded number of bytes at a time."""
    for batch in batches:
        rows, media, clips, size = [], [], [], 0
        for row in batch.itertuples(index=False):
            tag, own, payload = read_wave(row.media)
            rows.append((row.doc_id, row.n_bytes))
            media.append(row.media)
            clips.append((tag, payload, own))
            size += len(payload)
            if size >= BATCH_BYTES:
                yield rows, media, clips, [resample(p, c[2], rate) for p, c in zip(decode([c[:2] for c in clips]), clips)]
                rows, media, clips, size = [], [], [], 0
        if rows:
            yield rows, media, clips, [resample(p, c[2], rate) for p, c in zip(decode([c[:2] for c in clips]), clips)]


PCM_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, rate int, pcm binary"
)


def to_pcm(media: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """Checksums of the stored and of the recovered bytes, and the clip decoded and resampled, as little-endian 16-bit samples."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PCM_SCHEMA.split(", ")]
        for rows, files, clips, sound in _decoded(batches, rate):
            out = [
                (key, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), NAMES[tag], rate, pcm.astype("<i2").tobytes())
                for (key, n), f, (tag, p, _), pcm in zip(rows, files, clips, sound)
            ]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return media.mapInPandas(store, PCM_SCHEMA)


def feature(codec: str, rate: int, data: bytes) -> str:
    """Codec, rate, samples, loudness (root mean square), peak, sign changes and checksum of stored PCM."""
    wide = np.frombuffer(data, "<i2").astype(np.int64)
    loud = math.isqrt(int(np.dot(wide, wide)) // len(wide))
    turns = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{codec};rate={rate};samples={len(wide)};rms={loud};peak={int(np.abs(wide).max())};turns={turns};pcm={zlib.crc32(data):08x}"


def features(pcm: DataFrame) -> DataFrame:
    """The checksums of a table of stored PCM, and a feature string of each clip."""

    @F.pandas_udf("string")
    def described(codec: pd.Series, rate: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([feature(*x) for x in zip(codec, rate, data)], dtype=object)

    return pcm.withColumn("feature", described("codec", "rate", "pcm")).drop("codec", "rate", "pcm")


def stored_media(spark: SparkSession, clips: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """Write the media table to the shared folder and read it back."""
    return written(spark, to_media(clips, id_col, payload_col), "media", "zstd")


def stored_pcm(spark: SparkSession, media: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """Write the table of resampled PCM to the shared folder and read it back."""
    return written(spark, to_pcm(media, rate), "pcm", "zstd")
