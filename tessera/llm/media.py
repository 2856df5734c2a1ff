"""Text payloads as 8-bit WAV columns with spectral-peak fingerprints.

The payload (UTF-8 bytes, padded with blanks to a positive multiple of 192) is stored
by the ``wave`` module as 8-bit mono samples and read back by it. The samples read back
get a short-time Fourier transform; the strongest bin of each frame that stands out in
time is a landmark, and each landmark is paired with the next few. A pair is stored as
one long: frame << 24 | bin << 16 | next bin << 8 | frames between (a time-coded array).
The media column is written as a table and read again before anything is computed of it.

Defined results for odd input: null and empty texts give one padding frame of blanks;
repeated rows give repeated results; an empty table gives an empty result; further
columns are ignored. All work is per row, in slices of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shared
from tessera.session import table

FRAME, HOP, UNIT, RATE = 192, 96, 192, 8000
PAIRS, REACH = 3, 255


def padded(data: bytes, unit: int = UNIT) -> bytes:
    size = max(unit, -(-len(data) // unit) * unit)
    return data.ljust(size, b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def fingerprint(samples: bytes, most_frames: int = 8192) -> np.ndarray:
    """The time-coded pairs of one payload. Spectra are quantised to sixteenths of an
    octave, ties go to the lower bin and the earlier frame."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    best, level = [], []
    for i in range(0, len(frames), most_frames):
        power = np.abs(np.fft.rfft(frames[i : i + most_frames] * _WINDOW, axis=1))[:, 1:]
        top = np.rint(16 * np.log2(power + 1)).astype(np.int16)
        at = top.argmax(axis=1)
        best.append(at + 1)
        level.append(top[np.arange(len(at)), at])
    bins, height = np.concatenate(best), np.concatenate(level).astype(np.int32)
    before = np.concatenate([[-1], height[:-1]])
    after = np.concatenate([height[1:], [-1]])
    marks = np.flatnonzero((height > before) & (height >= after))
    coded = []
    for k in range(1, PAIRS + 1):
        a, b = marks[:-k], marks[k:]
        near = b - a <= REACH
        a, b = a[near].astype(np.int64), b[near].astype(np.int64)
        coded.append(a << 24 | bins[a].astype(np.int64) << 16 | bins[b].astype(np.int64) << 8 | (b - a))
    return np.sort(np.concatenate(coded))


FIELDS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
)


def stored_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The media column, stored: (key, n_bytes, media), one WAV file per row."""

    def work(batches):
        for batch in batches:
            for some in shared.text_slices(batch, "text"):
                raw, offs = shared.utf8(some.column("text"))
                data = memoryview(raw)
                medias = [to_wav(padded(bytes(data[a:b]))) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(np.diff(offs)), pa.array(medias, pa.binary())], ["key", "n_bytes", "media"])

    rows = docs.select(F.col(key).alias("key"), shared.whole_text().alias("text"))
    return shared.stored(rows.mapInArrow(work, f"key {dict(docs.dtypes)[key]}, n_bytes long, media binary"), "media")


def media_columns(docs: DataFrame, key: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Digest columns and ``fingerprint`` (array of long) per row, of the stored media
    column as it is read back; with ``keep_media`` also ``media`` (the WAV file)."""

    def work(batches):
        for batch in batches:
            rows = []
            for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media")):
                media = media.as_py()
                back = from_wav(media)
                pairs = fingerprint(back)
                rows.append((
                    n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(),
                    f"{(len(back) - FRAME) // HOP + 1}f{len(pairs)}p{zlib.crc32(pairs.astype('<i8').tobytes()):08x}", pairs,
                ))
            if not rows:
                continue
            names = [f.split()[0] for f in FIELDS.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.list_(pa.int64()) if f.endswith(">") else pa.int64() for f in FIELDS.split(", ")]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *cols, *([batch.column("media")] if keep_media else [])], [key, *names, *(["media"] if keep_media else [])])

    kind = dict(docs.dtypes)[key]
    return stored_media(docs, key).mapInArrow(work, f"{key} {kind}, {FIELDS}" + (", media binary" if keep_media else ""))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared.prepare(spark)
    return media_columns(table(spark, sf_dir, "documents"))
