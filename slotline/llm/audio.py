"""Audio features of payloads stored as 8-bit PCM.

`store` writes a payload, zero-padded to whole blocks of 64 bytes, as a mono 8-bit WAV file;
`analyse` parses the file and works on the samples read back: a polyphase resampler from
RATE by UP/DOWN, overlapped Hann frames, a log-mel filterbank, and speech segments by
hysteresis on the frame energy (a segment opens above HIGH and closes below LOW standard
deviations over the file's mean). Log-mel frames are dealt into windows of a fixed shape
FRAMES x MELS, each with its time span, and stored in the `tensors` column as an Arrow
stream whose type is a fixed-shape tensor (Spark has no such type of its own); `read_tensors`
gives them back. Every file is analysed whole, and alone, so equal payloads give equal values.

Defined cases. A null text is an empty payload, stored as 64 zero bytes. A null doc_id stays
null. Repeated rows are analysed once each. A file shorter than one frame is padded to one
frame. Of other columns nothing is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import small_batches, texts

BLOCK, RATE, UP, DOWN = 64, 16_000, 3, 4
FRAME, HOP, MELS, FRAMES = 256, 128, 32, 64
HIGH, LOW = 0.5, 0.0

SPAN = "struct<start_ms:double,end_ms:double>"
FEATURES = f"doc_id long, n_bytes long, media binary, samples binary, n_frames long, n_windows long, tensors binary, tensor_hash long, segments array<{SPAN}>"
TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
WINDOWS = pa.schema([("start_ms", pa.float64()), ("end_ms", pa.float64()), ("frames", pa.int32()), ("tensor", TENSOR)])


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 8-bit samples of a mono PCM file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        elif name == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


@lru_cache(maxsize=8)
def lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc filter at the rate of `up` samples, with gain `up`."""
    widest = max(up, down)
    n = np.arange(-half * widest, half * widest + 1)
    h = np.sinc(n / widest) / widest * np.hanning(len(n) + 2)[1:-1]
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: each output sample is one sub-filter's dot product with the input near it."""
    h = lowpass(up, down)
    centre, n = len(h) // 2, -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for phase in range(min(up, n)):  # outputs phase, phase + up, ... share a sub-filter
        at = phase * down
        taps = h[(at + centre) % up :: up][::-1].copy()
        newest = (at + centre) // up  # index of the last input sample that the first output sees
        count = -(-(n - phase) // up)
        low = newest - len(taps) + 1
        padded = np.pad(x, (max(0, -low), max(0, newest + (count - 1) * down + 1 - len(x))))
        frames = np.lib.stride_tricks.sliding_window_view(padded[max(0, low) :], len(taps))[::down][:count]
        out[phase::up] = frames @ taps
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles equally wide on the mel scale, frequency bins x mels."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[:, None] - edges[None, :-2]) / np.diff(edges)[:-1]
    fall = (edges[None, 2:] - bins[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Frames x mels, and each frame's log energy; in blocks of frames."""
    if len(y) < frame:
        y = np.pad(y, (0, frame - len(y)))
    y = np.pad(y, (0, -(len(y) - frame) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(y, frame)[::hop]
    window, filters, mels, energy = np.hanning(frame).astype(np.float32), mel_filters(rate, frame), [], []
    for k in range(0, len(frames), block):
        power = np.abs(np.fft.rfft(frames[k : k + block] * window)) ** 2
        mels.append(np.log(np.maximum(power @ filters, 1e-6)))
        energy.append(np.log(np.maximum(power[:, 1:].sum(axis=1), 1e-6)))
    return np.concatenate(mels).astype(np.float32), np.concatenate(energy)


def hysteresis(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Spans of frames, half-open: opened at or above the high mark, closed below the low one."""
    mean, spread = energy.mean(), energy.std()
    if spread == 0:
        return []
    turn = np.where(energy >= mean + high * spread, 1, np.where(energy < mean + low * spread, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.concatenate([[0], (last >= 0) & (turn[np.maximum(last, 0)] == 1), [0]]).astype(np.int8)
    step = np.diff(on)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def write_tensors(start: np.ndarray, end: np.ndarray, frames: np.ndarray, mel: np.ndarray) -> bytes:
    """Windows (n x FRAMES x MELS) with their spans and numbers of frames as an Arrow stream."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(mel.ravel(), pa.float32()), FRAMES * MELS)
    batch = pa.record_batch([pa.array(start), pa.array(end), pa.array(frames, pa.int32()), pa.ExtensionArray.from_storage(TENSOR, flat)], schema=WINDOWS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WINDOWS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.RecordBatch:
    """What `write_tensors` wrote; `tensor` is a fixed-shape tensor array."""
    with pa.ipc.open_stream(stored) as reader:
        return reader.read_next_batch()


def features(media: bytes, up: int = UP, down: int = DOWN) -> tuple[bytes, int, bytes, list[dict]]:
    """A file's samples, number of frames, tensors and speech segments."""
    rate, samples = from_wav(media)
    new_rate = rate * up / down
    y = resample((samples.astype(np.float32) - 128) / 128, up, down)
    mel, energy = log_mel(y - y.mean(), new_rate)
    ms = lambda frame: frame * HOP / new_rate * 1000
    first = np.arange(0, len(mel), FRAMES)
    frames = np.minimum(FRAMES, len(mel) - first)
    pad = np.pad(mel, ((0, -len(mel) % FRAMES), (0, 0))).reshape(-1, FRAMES, MELS)
    tensors = write_tensors(ms(first.astype(float)), ms(first + frames - 1.0) + FRAME / new_rate * 1000, frames, pad)
    return samples.tobytes(), len(mel), tensors, [{"start_ms": ms(a), "end_ms": ms(b)} for a, b in hysteresis(energy)]


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes as a WAV file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                raw = [t.encode() for t in part.column("text").to_pylist()]
                media = [to_wav(x + bytes(-len(x) % BLOCK if x else BLOCK)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def analyse(stored: DataFrame) -> DataFrame:
    """The features of each stored file, beside its doc_id, n_bytes, media and the samples read from it; `tensor_hash` is of the tensors read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())])
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                samples, n, tensors, segments = zip(*(features(m) for m in part.column("media").to_pylist()), strict=True)
                back = [read_tensors(t).column("tensor").to_numpy_ndarray() for t in tensors]
                hashes = [xxhash.xxh64_intdigest(t.tobytes()) - (1 << 63) for t in back]
                columns = [pa.array(samples, pa.binary()), pa.array(n, pa.int64()), pa.array([len(t) for t in back], pa.int64()), pa.array(tensors, pa.binary()), pa.array(hashes, pa.int64()), pa.array(segments, pa.list_(span))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *columns], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def digest(analysed: DataFrame) -> DataFrame:
    """The query's form of `analyse`: digests of the stored file, of what it gives back and of the features."""
    speech = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x.end_ms - x.start_ms)
    counts = [F.concat(F.col(c).cast("string"), F.lit(unit)) for c, unit in (("n_frames", "f"), ("n_windows", "w"))]
    feature = F.concat_ws(" ", *counts, F.concat(F.size("segments").cast("string"), F.lit("s")), F.concat(F.round(speech).cast("long").cast("string"), F.lit("ms")), F.lower(F.hex("tensor_hash")))
    return analysed.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
