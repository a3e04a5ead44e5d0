"""Media columns: 8-bit WAV, short-time Fourier transform and spectral-peak pair fingerprints.

A text's UTF-8 bytes, filled up with 255 to a positive multiple of FRAME, are the samples of a
mono WAV file written and read by the wave module. Windows of FRAME samples at half-window steps are
transformed; each keeps its PEAKS largest local maxima (silence has none), and each peak is paired with the peaks of
the next REACH windows. A pair is coded as one long: time << 40 | first bin << 24 | second bin << 8 | step.

Null and empty texts give one frame of 255s. Rows are independent; repeated rows give repeated
results, and columns other than doc_id and text are not read. A text is transformed window by
window in blocks of BLOCK windows, so memory follows one text's bytes and no more.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bytescan as bs
from sextant.llm.shared import bounded_batches

FRAME, PEAKS, REACH, BLOCK, RATE = 576, 3, 2, 512, 8000
HANN = np.hanning(FRAME).astype(np.float32)


def stored(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def landmarks(samples: bytes) -> np.ndarray:
    """Codes of the peak pairs, in order of time."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: FRAME // 2]
    bins = []
    for k in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[k : k + BLOCK] * HANN, axis=1))
        inner = power[:, 2:-1]
        peak = np.where((inner > power[:, 1:-2]) & (inner >= power[:, 3:]), inner, np.float32(0))
        rows = np.arange(len(peak))
        top = np.empty((len(peak), PEAKS), np.int64)
        for m in range(PEAKS):
            best = np.argmax(peak, axis=1)
            top[:, m] = np.where(peak[rows, best] > 0, best + 2, 0)  # 0: the window has no such peak
            peak[rows, best] = 0
        bins.append(np.sort(top, axis=1))
    bins = np.concatenate(bins)
    codes = [np.zeros(0, np.int64)]
    for step in range(1, REACH + 1):
        a, b = bins[:-step, :, None], bins[step:, None, :]
        if len(a):
            time = np.arange(len(a))[:, None, None]
            codes.append(((time << 40) | (a << 24) | (b << 8) | step)[(a > 0) & (b > 0)])
    if len(bins) == 1:  # a single window has its own peaks only
        codes.append(bins[0][bins[0] > 0] << 24)
    return np.sort(np.concatenate(codes))


def _media(full: bool):
    def media(batches):
        for ids, text in bs.arrow_batches(batches, ["doc_id", "text"]):
            data, offsets = bs.buffers(text)
            rows, prints, files = [], [], []
            for r in range(len(offsets) - 1):
                body = data[offsets[r] : offsets[r + 1]].tobytes()
                payload = body.ljust(max(FRAME, -(-len(body) // FRAME) * FRAME), b"\xff")
                file = stored(payload)
                back = read_back(file)
                codes = landmarks(back)
                feature = f"{len(codes)}:{xxhash.xxh3_128_hexdigest(codes.tobytes())}"
                rows.append((len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                if full:
                    prints.append(codes)
                    files.append(file)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if full:
                columns += [pa.array(prints, pa.list_(pa.int64())), pa.array(files, pa.binary())]
                names += ["landmarks", "media"]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return media


def media_columns(documents: DataFrame, full: bool = True) -> DataFrame:
    """Per row: doc_id, sizes and digests of payload and file, feature (count and digest of the
    fingerprint); with full also landmarks (time-coded array) and media (the WAV file)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return bounded_batches(rows).mapInArrow(_media(full), schema + ", landmarks array<long>, media binary" * full)


def op2_media_columns(spark, sf_dir):
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
