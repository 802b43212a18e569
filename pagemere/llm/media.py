"""Media columns: bytes kept as WAV samples, read back by the wave module, with spectral fingerprints.

A text's UTF-8 bytes, filled up with blanks to a positive multiple of ``unit``, are the 8-bit mono samples of a
WAV file.  The files are a binary column of a table in the shared folder.  Reading them back gives the payload
and, by a short-time Fourier transform (frame 2*unit, hop unit, Hann window), the strongest bin of each of four
bands in each frame.  Each peak is paired with the strongest peak of the next frame; a pair's code holds the
two bins, its time the frame.  Both are stored as arrays of one length.

Defined results: null and empty texts are one unit of blanks; a single frame is filled up with silence; texts of any
length are stored whole; of equally strong bins (ties) the lowest counts; equal texts and repeated rows give equal
values; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

UNIT = 192
RATE = 8000
BANDS = ((2, 24), (24, 60), (60, 110), (110, 193))


def encode(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(payload: bytes, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs of peaks; long payloads go through in slices of frames."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    frame = 2 * unit
    x = np.concatenate((x, np.zeros(unit, np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::unit]
    hann = np.hanning(frame).astype(np.float32)
    bins = np.empty((len(frames), len(BANDS)), np.int32)
    top = np.empty(len(frames), np.int32)
    for i in range(0, len(frames), 2048):
        part = frames[i : i + 2048]
        part = (part - part.mean(axis=1, keepdims=True)) * hann
        z = np.fft.rfft(part, axis=1)
        power = z.real**2 + z.imag**2
        best = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
        bins[i : i + 2048] = best
        strength = np.take_along_axis(power, best, axis=1)
        top[i : i + 2048] = np.take_along_axis(best, strength.argmax(axis=1)[:, None], axis=1)[:, 0]
    if len(bins) == 1:
        return np.zeros(len(BANDS), np.int32), bins[0] << 9
    times = np.repeat(np.arange(len(bins) - 1, dtype=np.int32), len(BANDS))
    return times, (bins[:-1] << 9 | top[1:, None]).ravel()


def _store(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, media = [], []
        for text in b.column(1):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            media.append(encode(raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" ")))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads, times, codes = [], [], []
        for m in b.column(2):
            payloads.append(decode(m.as_py()))
            t, c = peaks(payloads[-1], unit)
            times.append(t)
            codes.append(c)
        arrays = [b.column(0), b.column(1), b.column(2), pa.array(payloads, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media", "payload", "times", "codes"])


def store(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """docs(doc_id, text) to the written table (doc_id, n_bytes, media)."""
    tables = Tables(docs.sparkSession, "media")
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tables.write(got.mapInArrow(lambda it: _store(it, unit), "doc_id bigint, n_bytes bigint, media binary"), "wav", product=True)


def read(media: DataFrame, unit: int = UNIT) -> DataFrame:
    """The stored bytes read back: doc_id, n_bytes, media, payload, times, codes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda it: _features(it, unit), "doc_id bigint, n_bytes bigint, media binary, payload binary, times array<int>, codes array<int>")


def tail_crc(payload: bytes, n: int = 16) -> int:
    return zlib.crc32(payload[-n:])
