"""Telephony audio: bytes stored as 8-bit companded or ADPCM samples in WAV files, and read back as linear PCM.

mu-law and A-law (one byte a sample) are expanded by lookup tables; IMA ADPCM blocks (two samples a byte) are
decoded in numpy sample by sample across all blocks at once. Resampling is linear interpolation.
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

from lumenframe.llm.session import bounded_batches
from lumenframe.llm.text import slices

MULAW, ALAW, ADPCM = 7, 6, 17  # format tags of WAV
RATE = 8000
#: Payloads are filled with zero bytes to a positive multiple of this.
UNIT = 64
#: Bytes of an ADPCM block: a header of 4 and 2 samples for each other byte.
BLOCK = 256
BLOCKS = 1 << 13
#: Samples that are expanded at a time; features are summed over them.
SPAN = 1 << 18


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = (((mantissa.astype(np.int32) << 3) + 132) << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((code >> 4) & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}

# Fixed values of IMA ADPCM: index steps of a 4-bit code; the 89 step sizes.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
STEP = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
        209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
        2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
        24623, 27086, 29794, 32767,
    ]
)


def wav(data: bytes, form: int, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is `data`."""
    if form == ADPCM:
        per_block = (BLOCK - 4) * 2 + 1
        head = struct.pack("<4sIHHIIHHHH", b"fmt ", 20, form, 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        head = struct.pack("<4sIHHIIHHH", b"fmt ", 18, form, 1, rate, rate, 1, 8, 0)
    body = data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + 8 + len(body), b"WAVE") + head + struct.pack("<4sI", b"data", len(data)) + body


def read_wav(stored: bytes) -> tuple[int, int, memoryview]:
    """(format tag, rate, bytes of the data chunk)."""
    view, at, form, rate = memoryview(stored), 12, 0, 0
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            form, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            return form, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of (n, BLOCK) bytes as (n, samples): all blocks step through their samples together."""
    blocks = np.ascontiguousarray(blocks, np.uint8)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for t in range(codes.shape[1]):
        code, step = codes[:, t].astype(np.int32), STEP[index]
        delta = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[:, t + 1] = value
    return out


def pcm(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(rate, 16-bit samples) of WAV files in the three formats. The ADPCM blocks of all files are decoded together,
    BLOCKS at a time; a file's last part block is filled with zeros."""
    read = [read_wav(x) for x in files]
    out: list = [None] * len(files)
    blocks, owner = [], []
    for k, (form, rate, data) in enumerate(read):
        raw = np.frombuffer(data, np.uint8)
        if form in EXPAND:
            out[k] = (rate, EXPAND[form][raw])
        elif form == ADPCM:
            whole = np.zeros(-(-len(raw) // BLOCK) * BLOCK, np.uint8)
            whole[: len(raw)] = raw
            blocks.append(whole.reshape(-1, BLOCK))
            owner.append(k)
        else:
            raise ValueError(f"format {form}")
    if blocks:
        every = np.concatenate(blocks)
        decoded = np.concatenate([decode_adpcm(every[i : i + BLOCKS]) for i in range(0, len(every), BLOCKS)]) if len(every) else every
        at = 0
        for k, own in zip(owner, blocks, strict=True):
            out[k] = (read[k][1], decoded[at : at + len(own)].reshape(-1))
            at += len(own)
    return out


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate, rounded to 16 bits."""
    n = len(samples) * to // rate
    if to == rate or not n:
        return samples[:n] if to == rate else np.zeros(0, np.int16)
    return np.floor(np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples) + 0.5).astype(np.int16)


def feature(*heard: tuple[int, np.ndarray]) -> str:
    """Mean level, peak and sign changes in a thousand samples of each PCM, given as (rate, samples), as text."""
    out = []
    for to, samples in heard:
        total, changes, peak, n = 0.0, 0, 0, 0
        # Spans share their last sample with the next one, so the pieces join without a seam.
        for k in range(0, max(len(samples) - 1, 1), SPAN):
            part = samples[k : k + SPAN + 1].astype(np.int64)
            total += float((part * part).sum())
            changes += int(np.count_nonzero((part[1:] < 0) != (part[:-1] < 0)))
            peak, n = max(peak, int(np.abs(part).max(initial=0))), n + len(part)
        out.append(f"{to}:{int((total / max(n, 1)) ** 0.5)}:{peak}:{round(1000 * changes / max(n, 1))}")
    return ";".join(out)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, pcm binary"


def store_as_audio(docs: DataFrame, key: str = "doc_id", text: str = "text", forms: tuple = (MULAW, ALAW, ADPCM), to: int = 2 * RATE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, the WAV file (media) and its PCM resampled to the rate `to` (16-bit little-endian).

    The payload is the text in UTF-8 (null as empty) and zero bytes up to a positive multiple of UNIT. It becomes the
    samples (for ADPCM the blocks) of a WAV file in one of `forms`, chosen by the payload's checksum; hashes and
    features are of what is read back from that file, features of its PCM at both rates. Equal texts give equal values;
    rows that repeat a key get a row each. Other columns are not read. An empty table gives an empty result.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, raw, offsets in slices(b.column(1)):
                data, files, sizes, rows = raw.tobytes(), [], [], []
                for i in range(hi - lo):
                    payload = data[offsets[i] : offsets[i + 1]]
                    sizes.append(len(payload))
                    payload += b"\0" * ((-len(payload)) % UNIT or UNIT * (not payload))
                    files.append(wav(payload, forms[zlib.crc32(payload) % len(forms)]))
                for k, (stored, (rate, samples)) in enumerate(zip(files, pcm(files), strict=True)):
                    back = read_wav(stored)[2]
                    heard = resampled(samples, rate, to)
                    rows.append((ids[lo + k], sizes[k], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature((rate, samples), (to, heard)), stored, heard.astype("<i2").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    bounded_batches(docs)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", key)
