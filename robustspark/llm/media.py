"""Telephony audio as media columns.

A text's bytes are taken as one A-law channel at 8 kHz. The lookup table expands each byte to 16-bit PCM; the signal is
resampled to 16 kHz by linear interpolation, which keeps every original sample at an even place, and stored as a WAV
file. A-law's table is one to one, so reading the even samples back and inverting the table restores the payload exactly.
The features also read the payload as mu-law and as blocks of IMA ADPCM.

Null and empty texts give one frame of padding; equal texts give equal values; a text of any length is stored whole, and
memory is bounded by the longest text (about 40 times its bytes) or ``CHUNK``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustspark.llm.textops import chunks

FRAME = 576
RATE = 8_000

#: Fixed values of the IMA ADPCM format: the index steps of a 4-bit code; the step sizes follow from a rule of 10 percent.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of the IMA ADPCM format: step sizes.
STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of every mu-law byte (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of every A-law byte (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    exponent, size = (code & 0x70) >> 4, ((code & 0x0F) << 4) + 8
    size = np.where(exponent == 0, size, (size + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
ALAW_CODE = np.zeros(65536, np.uint8)
ALAW_CODE[ALAW.astype(np.int32) + 32768] = np.arange(256)


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of the frame."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: original samples at even places, means of neighbours between them."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def wav(pcm: np.ndarray, rate: int) -> bytes:
    """A WAV file of one 16-bit channel."""
    data = pcm.astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def payload_of(media: bytes) -> bytes:
    """The payload in a stored WAV file: its ``data`` chunk's even samples through the inverse A-law table."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    size = struct.unpack_from("<I", media, at + 4)[0]
    pcm = np.frombuffer(media, "<i2", size // 2, at + 8)[::2]
    return ALAW_CODE[pcm.astype(np.int32) + 32768].tobytes()


def adpcm_energy(blocks: np.ndarray) -> np.ndarray:
    """Per block of IMA ADPCM (rows of bytes) the mean absolute sample, decoded in step across all blocks."""
    n, width = blocks.shape
    sample = np.frombuffer(np.ascontiguousarray(blocks[:, :2]).tobytes(), "<i2").astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    total = np.abs(sample).astype(np.int64)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for byte in codes:
        for code in (byte & 15, byte >> 4):
            step, low = STEP[index], (code & 7).astype(np.int32)
            delta = ((2 * low + 1) * step) >> 3
            sample = np.clip(sample + np.where(code & 8, -delta, delta), -32768, 32767)
            index = np.clip(index + INDEX_STEP[low], 0, 88)
            total += np.abs(sample)
    return total // (1 + 2 * (width - 4))


BLOCK = 96


def features(payloads: list[bytes]) -> list[str]:
    """Level, crossings and peak of the A-law reading, level of the mu-law reading, level of the ADPCM reading."""
    energy = adpcm_energy(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK))
    out, at = [], 0
    for raw in payloads:
        code = np.frombuffer(raw, np.uint8)
        a, blocks = ALAW[code], len(raw) // BLOCK
        level = int(np.abs(a.astype(np.int32)).sum()) // len(a)
        crossings = int(np.count_nonzero((a[1:] < 0) != (a[:-1] < 0)))
        mu = int(np.abs(MULAW[code].astype(np.int32)).sum()) // len(a)
        out.append(f"samples={2 * len(a)};level={level};crossings={crossings};peak={int(np.abs(a.astype(np.int32)).max())};mulaw={mu};adpcm={int(energy[at : at + blocks].sum()) // blocks}")
        at += blocks
    return out


def store(raw: bytes) -> bytes:
    """The media file of one text's bytes."""
    return wav(resampled(ALAW[np.frombuffer(pad(raw), np.uint8)]), 2 * RATE)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per document: id, n_bytes, payload and media digests and sizes, feature, and the file itself as ``media``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in chunks(whole, "text"):
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                files = [store(x) for x in texts]
                back = [payload_of(x) for x in files]
                columns = [
                    part.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in files], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array(features(back)),
                ]
                names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                if keep_media:
                    columns, names = [*columns, pa.array(files, pa.binary())], [*names, "media"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return rows.mapInArrow(build, schema).withColumnRenamed("id", id_col)
