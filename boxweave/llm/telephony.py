"""Media columns of telephony audio.

A media column holds whole RIFF/WAVE files of 8 kHz mono mu-law, A-law (one byte
a sample) or IMA ADPCM (blocks of BLOCK bytes).  Mu-law and A-law expand by
lookup tables; ADPCM is decoded by numpy one step at a time across all blocks of
a batch; PCM is resampled by an integer polyphase filter, so that any machine
gets the same samples.

``pack`` stores bytes losslessly as such files, ``read_back`` takes the stored bytes
out again and decodes them to resampled 16-bit PCM in WAVE files, which are stored in
turn, ``features`` describes stored PCM, and ``decode`` gives the PCM alone.

A null text is stored as no bytes.  A null or unreadable file gives nulls, and so does
null or unreadable PCM.  Equal texts have equal files and features, repeated rows are
each kept; an empty table gives no rows; columns of the input with the names of the
results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

RATE, OUT_RATE = 8000, 16000
#: What the query stores, of one of PARTS parts of the table at a time: PCM of all
#: texts at this rate is several times the table.
STORED_RATE, PARTS = OUT_RATE, 8
#: Bytes of a payload are a multiple of this; also the ADPCM block.
BLOCK = 576
PAD = 255
#: WAVE format tags: ITU G.711 mu-law and A-law, IMA ADPCM.
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
TAGS = {v: k for k, v in CODECS.items()}
BLOCK_SAMPLES = (BLOCK - 4) * 2 + 1

# Fixed values of the IMA ADPCM format: quantiser steps, and index changes by the low three bits of a code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits; sign, 3 bits of segment, 4 of step."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted; a set sign bit is positive."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, step + 8, step + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By index * 16 + code: the change of the sample, and the next index * 16."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = STEPS[index]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(index + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32), (after * 16).astype(np.int32)


CHANGE, AFTER = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) to (n, samples) of int16; a step at a time, all blocks at once."""
    n, width = blocks.shape
    out = np.empty((1 + (width - 4) * 2, n), np.int16)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.empty(((width - 4) * 2, n), np.uint8)
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out[0] = sample
    at = np.empty(n, np.int32)
    for k in range(len(codes)):
        np.add(index, codes[k], out=at, casting="unsafe")
        sample += CHANGE[at]
        np.clip(sample, -32768, 32767, out=sample)
        index = AFTER[at]
        out[k + 1] = sample
    return np.ascontiguousarray(out.T)


#: Taps on either side, at the lower of the two rates.
HALF_TAPS = 4


@functools.lru_cache
def _filters(up: int, down: int) -> np.ndarray:
    """A Hann-windowed sinc for each phase, in 1/32768; each sums to one."""
    half = HALF_TAPS * max(1, -(-down // up))
    x = np.arange(up)[:, None] / up - np.arange(1 - half, half + 1)
    h = np.sinc(x * min(1.0, up / down)) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / half, -1, 1)))
    h = np.rint(h / h.sum(1, keepdims=True) * 32768).astype(np.int64)
    h[:, half - 1] += 32768 - h.sum(1)
    return h


def resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """int16 samples at another rate; len * out_rate / rate of them, rounded up."""
    g = np.gcd(rate, out_rate)
    up, down = int(out_rate // g), int(rate // g)
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    h = _filters(up, down)
    half = h.shape[1] // 2
    padded = np.pad(pcm.astype(np.int32), (half - 1, half))
    n = -(-len(pcm) * up // down)
    out = np.empty(n, np.int16)
    for first in range(up):  # outputs first, first + up, ... share a phase
        place = np.arange(first, n, up, dtype=np.int64) * down
        if not len(place):
            continue
        phase, base = int(place[0] % up), place // up
        total = np.full(len(place), 16384, np.int64)
        for k, tap in enumerate(h[phase].tolist()):
            if tap:
                total += padded[base + k].astype(np.int64) * tap if down > 1 else padded[base[0] + k : base[0] + k + len(base)].astype(np.int64) * tap
        out[first::up] = np.clip(total >> 15, -32768, 32767)
    return out


def payload_of(data: bytes) -> bytes:
    """Bytes padded to a positive multiple of BLOCK."""
    return data + bytes([PAD]) * ((-len(data)) % BLOCK if data else BLOCK)


def codec_of(payload: bytes) -> str:
    """A codec for these bytes: equal payloads, equal codec."""
    return list(CODECS)[zlib.crc32(payload) % len(CODECS)]


def wave(payload: bytes, codec: str) -> bytes:
    """A RIFF/WAVE file around the coded samples."""
    adpcm = codec == "adpcm"
    align, bits = (BLOCK, 4) if adpcm else (1, 8)
    samples = len(payload) // BLOCK * BLOCK_SAMPLES if adpcm else len(payload)
    per_second = RATE * BLOCK // BLOCK_SAMPLES if adpcm else RATE
    extra = struct.pack("<HH", 2, BLOCK_SAMPLES) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", CODECS[codec], 1, RATE, per_second, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pcm_wave(pcm: np.ndarray, rate: int) -> bytes:
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm) * 2)
    return b"RIFF" + struct.pack("<I", len(body) + len(pcm) * 2) + body + pcm.astype("<i2").tobytes()


def parse_wave(media: bytes) -> tuple[str, int, int, bytes] | None:
    """Codec, rate, block size and coded bytes; None if it's no file of ours."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if fmt is None or fmt[0] not in TAGS or at + 8 + size > len(media):
                return None
            return TAGS[fmt[0]], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None


def to_pcm(files: list[bytes | None]) -> list[tuple[int, np.ndarray] | None]:
    """Rate and samples of each file.  ADPCM blocks of one size, of whichever
    files, are decoded together; a rest shorter than a block is left out."""
    out: list[tuple[int, np.ndarray] | None] = [None] * len(files)
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for i, media in enumerate(files):
        if media is None or (found := parse_wave(media)) is None:
            continue
        codec, rate, align, body = found
        data = np.frombuffer(body, np.uint8)
        if codec == "adpcm":
            if align > 4:
                waiting.setdefault(align, []).append((i, rate, data[: len(data) // align * align].reshape(-1, align)))
        else:
            out[i] = rate, (MULAW if codec == "mulaw" else ALAW)[data]
    for group in waiting.values():
        pcm, at = decode_adpcm(np.concatenate([b for _, _, b in group])), 0
        for i, rate, blocks in group:
            out[i] = rate, pcm[at : at + len(blocks)].reshape(-1)
            at += len(blocks)
    return out


def describe(pcm: np.ndarray, rate: int) -> str:
    """rate:samples:peak:mean magnitude:root mean square:sign changes:CRC-32, in whole numbers."""
    wide = pcm.astype(np.int64)
    n = max(1, len(wide))
    peak = int(np.abs(wide).max()) if len(wide) else 0
    turns = int(np.count_nonzero(np.diff(wide < 0)))
    power = int((wide * wide).sum()) // n
    root = int(power**0.5)
    return f"{rate}:{len(wide)}:{peak}:{int(np.abs(wide).sum()) // n}:{root}:{turns}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


PACK_FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("media", T.BinaryType())]
READ_FIELDS = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
]
PCM_FIELDS = [T.StructField("pcm", T.BinaryType())]
FEATURE_FIELDS = [T.StructField("feature", T.StringType())]


def pack(df: DataFrame, *, text_col: str = "text", codec: str | None = None) -> DataFrame:
    """The UTF-8 bytes of a column as audio files: n_bytes, codec, media.

    codec: one for all; else each payload's own checksum picks one.
    """

    def kernel(col: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = common.utf8(col)
        raw = data.tobytes()
        payloads = [payload_of(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codecs = [codec or codec_of(p) for p in payloads]
        media = [wave(p, c) for p, c in zip(payloads, codecs, strict=True)]
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(codecs, pa.string()), pa.array(media, pa.binary())]

    return common.annotate(df, text_col, kernel, PACK_FIELDS)


def _sound(sound: tuple[int, np.ndarray] | None, out_rate: int) -> bytes | None:
    return None if sound is None else pcm_wave(resample(sound[1], sound[0], out_rate), out_rate)


def read_back(df: DataFrame, *, media_col: str = "media", out_rate: int = OUT_RATE) -> DataFrame:
    """READ_FIELDS of stored files, and pcm: their sound as a WAVE file of 16-bit
    samples at out_rate, to be stored; nulls where a file can't be read."""

    def kernel(col: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        files = col.to_pylist()
        rows = []
        for media, sound in zip(files, to_pcm(files), strict=True):
            if sound is None:
                rows.append((None,) * (len(READ_FIELDS) + 1))
                continue
            payload = parse_wave(media)[3]
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), _sound(sound, out_rate),
            ))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return common.annotate(df, media_col, kernel, READ_FIELDS + PCM_FIELDS)


def decode(df: DataFrame, *, media_col: str = "media", out_rate: int = OUT_RATE) -> DataFrame:
    """``df`` with a column pcm: 16-bit WAVE files at out_rate, to be stored in
    place of the coded ones; null where a file can't be read."""

    def kernel(col: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_sound(s, out_rate) for s in to_pcm(col.to_pylist())], pa.binary())]

    return common.annotate(df, media_col, kernel, PCM_FIELDS)


def parse_pcm(media: bytes | None) -> tuple[int, np.ndarray] | None:
    """Rate and samples of a file of ``pcm_wave``."""
    if media is None or len(media) < 44 or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        return None
    rate, size = struct.unpack_from("<I", media, 24)[0], struct.unpack_from("<I", media, 40)[0]
    return (rate, np.frombuffer(media, "<i2", size // 2, 44)) if 44 + size <= len(media) else None


def features(df: DataFrame, *, pcm_col: str = "pcm") -> DataFrame:
    """``df`` with a column feature, of stored PCM."""

    def kernel(col: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        sounds = map(parse_pcm, col.to_pylist())
        return [pa.array([s and describe(s[1], s[0]) for s in sounds], pa.string())]

    return common.annotate(df, pcm_col, kernel, FEATURE_FIELDS)
