"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM, decoded in batches and resampled."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, read

RATE = 8000
#: Samples a second of stored PCM.
STORED_RATE = 16000
#: WAVE format tags. Fixed values.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: Bytes of a mono ADPCM block: 4 of header, then two samples a byte.
BLOCK = 64
#: Payload bytes that are decoded at once.
SLICE = 1 << 20
#: Step index changes of IMA ADPCM by the three lower bits of a code. Fixed values.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


#: The 89 step sizes of IMA ADPCM. Fixed values.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (G.711): sign, 3 bits of exponent, 4 of mantissa, all inverted."""
    c = ~np.arange(256) & 255
    size = ((((c & 15) << 3) + 132) << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (G.711): even bits inverted; the first segment is linear."""
    c = np.arange(256) ^ 0x55
    e, m = (c >> 4) & 7, (c & 15) << 4
    size = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


MU, A = mulaw_table(), alaw_table()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (size - 4)) of n mono IMA ADPCM blocks as bytes (n, size): one step for all blocks at a time.

    A block starts with its first sample (16 bits), a step index (clamped to the table) and a byte that isn't used.
    """
    n, size = blocks.shape
    at = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = at
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * (size - 4)):
        c = (codes[i // 2] >> 4 if i % 2 else codes[i // 2] & 15).astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + (step >> 2) * (c & 1) + (step >> 1) * (c >> 1 & 1) + step * (c >> 2 & 1)
        at = np.clip(np.where(c & 8, at - change, at + change), -32768, 32767)
        index = np.clip(index + INDEX[c & 7], 0, len(STEPS) - 1)
        out[i + 1] = at
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """pcm at another rate: ceil(n * to / rate) samples, interpolated in integers between neighbours, the last one held.

    To a lower rate, each sample is first replaced by the mean of the rate // to samples from it on, against aliasing.
    SLICE samples are computed at once, so memory beside the result is bounded.
    """
    if rate <= 0 or to <= 0:
        raise ValueError(f"rates {rate}, {to}")
    n = len(pcm)
    if not n or rate == to:
        return pcm.astype(np.int16)
    x = pcm.astype(np.int32)
    if (wide := rate // to) > 1:
        sums = np.concatenate([[0], np.cumsum(np.concatenate([x, np.repeat(x[-1:], wide - 1)]), dtype=np.int64)])
        x = (sums[wide:] - sums[:-wide]) // wide
    g = gcd(rate, to)
    step, phases = rate // g, to // g  # output i stands at i * step / phases
    out = np.empty(-(-n * phases // step), np.int16)
    for i in range(0, len(out), SLICE):
        at = np.arange(i, min(len(out), i + SLICE), dtype=np.int64) * step
        k, part = np.divmod(at, phases)
        a = x[k].astype(np.int64)
        out[i : i + len(at)] = a + (x[np.minimum(k + 1, n - 1)] - a) * part // phases
    return out


def wave(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A WAVE file of one channel: header and data, lossless for bytes taken as 8-bit samples (or as ADPCM blocks)."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), IMA: (4, BLOCK)}[tag]
    extra = struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4)) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    per = rate * 2 if tag == PCM else rate if tag != IMA else rate * BLOCK // (1 + 2 * (BLOCK - 4))
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per, align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) if tag != IMA else len(data) // BLOCK * (1 + 2 * (BLOCK - 4)))
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, data) of a WAVE file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, tag, rate, data = 12, None, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 16 <= len(media):
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if tag is None or data is None:
        raise ValueError("no format or no data")
    return tag, rate, data


def decode(tag: int, data: bytes) -> np.ndarray:
    """PCM samples of a WAVE file's data; a part of an ADPCM block at the end is left out."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MU[raw]
    if tag == ALAW:
        return A[raw]
    if tag == IMA:
        return adpcm(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).ravel()
    if tag == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    raise ValueError(f"format {tag}")


def decode_media(df: DataFrame, media: str = "media", rate: int = STORED_RATE) -> DataFrame:
    """(id, rate, n_samples, pcm) of df(id, media): each WAVE file of one channel as 16-bit PCM resampled to `rate`.

    Null, broken, cut off or unknown media and those of no rate give null rate and pcm and 0 samples; empty data give
    empty PCM; data that end early are decoded as far as they go; df's other columns are left out; an empty table gives an
    empty one.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for m in b.column(1):
                try:
                    tag, own, data = unwave(m.as_py() or b"")
                    pcm = resampled(decode(tag, data), own, rate)
                    rows.append((rate, len(pcm), pcm.astype("<i2").tobytes()))
                except ValueError:
                    rows.append((None, 0, None))
            rates, ns, pcms = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rates, pa.int32()), pa.array(ns, pa.int64()), pa.array(pcms, pa.binary())], names=["id", "rate", "n_samples", "pcm"])

    batches(df.sparkSession)
    return df.select(F.col("id").cast("long").alias("id"), F.col(media).cast("binary").alias("media")).mapInArrow(run, "id long, rate int, n_samples long, pcm binary")


def payload(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of BLOCK."""
    return text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))


def sums(x: np.ndarray) -> np.ndarray:
    """(energy, zero crossings, peak) of the samples (n, m) of each row."""
    y = x.astype(np.int64)
    return np.stack([(y * y).sum(1), (np.diff(x < 0, axis=1) != 0).sum(1), np.abs(y).max(1)], 1)


def features(data: list[bytes]) -> list[str]:
    """Of each of the payloads: root mean square, zero crossings and peak as mu-law, A-law and ADPCM, all payloads' blocks decoded together.

    Blocks are decoded SLICE bytes at a time; crossings are counted within blocks.
    """
    joined = np.frombuffer(b"".join(data), np.uint8).reshape(-1, BLOCK)
    parts = []
    for i in range(0, len(joined), SLICE // BLOCK):
        b = joined[i : i + SLICE // BLOCK]
        parts.append(np.stack([sums(MU[b]), sums(A[b]), sums(adpcm(b))], 1))
    each = np.concatenate(parts)
    ends = np.cumsum([len(d) // BLOCK for d in data])
    starts = np.r_[0, ends[:-1]]
    total, peak = np.add.reduceat(each[:, :, :2], starts), np.maximum.reduceat(each[:, :, 2], starts)
    samples = (ends - starts)[:, None] * np.array([BLOCK, BLOCK, 1 + 2 * (BLOCK - 4)])
    rms = np.sqrt(total[:, :, 0] / samples)
    names = ("mulaw", "alaw", "adpcm")
    return [";".join(f"{n}:rms={r:.1f},zc={z},peak={p}" for n, r, z, p in zip(names, rms[i], total[i, :, 1], peak[i], strict=True)) for i in range(len(data))]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_samples long, pcm_crc32 long, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """DIGEST of documents(doc_id, text): the whole text as the mu-law samples of a WAVE file, which is then read back.

    All but n_bytes and the media columns come from the bytes that were read back; pcm_samples and pcm_crc32 are those of the
    stored PCM, the file decoded and resampled to STORED_RATE as decode_media does. Null texts are empty; equal texts
    give equal values whatever stands beside them; null ids and repeated rows are kept.
    """
    types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, back = [], []
            for text in b.column(1):
                t = text.as_py()
                media = wave(payload(t), MULAW)
                tag, rate, p = unwave(media)
                pcm = resampled(decode(tag, p), rate, STORED_RATE)
                back.append(p)
                rows.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), len(pcm), zlib.crc32(pcm.astype("<i2").tobytes())))
            if rows:
                columns = [b.column(0).to_pylist(), *zip(*rows, strict=True), features(back)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, DIGEST)


def store(docs: DataFrame) -> DataFrame:
    """(id, media) of documents(doc_id, text): the WAVE files that media_digest describes, for a table of media columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wave(payload(t.as_py()), MULAW) for t in b.column(1)], pa.binary())], names=["id", "media"])

    batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("id"), text).mapInArrow(run, "id long, media binary")


def op9_media(spark, sf_dir) -> DataFrame:
    return media_digest(read(spark, sf_dir, "documents"))
