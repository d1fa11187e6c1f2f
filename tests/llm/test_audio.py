import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from slotline.llm import audio as au


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (4, 1), (1, 1)])
@pytest.mark.parametrize("n", [64, 128, 1000])
def test_resample_equals_plain_filtering(up, down, n):
    x = np.random.default_rng(0).normal(size=n).astype(np.float32)
    h = au.lowpass(up, down).astype(float)
    stuffed = np.zeros(n * up)
    stuffed[::up] = x
    plain = np.convolve(stuffed, h)[len(h) // 2 :][: n * up : down]
    assert np.allclose(au.resample(x, up, down), plain, atol=1e-4)


def test_log_mel_equals_plain_transform():
    y = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    mel, energy = au.log_mel(y, 8000.0, block=3)
    padded = np.pad(y, (0, -(len(y) - au.FRAME) % au.HOP))
    for k in range(len(mel)):
        frame = padded[k * au.HOP : k * au.HOP + au.FRAME] * np.hanning(au.FRAME)
        basis = np.exp(-2j * np.pi * np.outer(np.arange(au.FRAME // 2 + 1), np.arange(au.FRAME)) / au.FRAME)
        power = np.abs(basis @ frame) ** 2
        assert np.allclose(mel[k], np.log(np.maximum(power @ au.mel_filters(8000.0), 1e-6)), atol=1e-3)
        assert np.isclose(energy[k], np.log(power[1:].sum()), atol=1e-3)


def test_hysteresis():
    e = np.array([0, 2, 1, 1, 0, 1, 2, 2, 0, 1.0])
    mean, spread, on, want, start = e.mean(), e.std(), False, [], 0
    for k, x in enumerate([*e, -9]):
        if not on and x >= mean + 0.5 * spread:
            on, start = True, k
        elif on and x < mean:
            on = False
            want.append((start, k))
    assert au.hysteresis(e) == want and au.hysteresis(np.zeros(5)) == []


@pytest.mark.parametrize("n", [64, 128, 4096])
def test_wav_reads_back(n):
    payload = np.random.default_rng(2).integers(0, 256, n, np.uint8).tobytes()
    rate, samples = au.from_wav(au.to_wav(payload))
    assert rate == au.RATE and samples.tobytes() == payload


def test_query(odd_docs, no_docs):
    got = au.digest(au.analyse(au.store(odd_docs))).collect()
    raw = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in odd_docs.collect()}
    seen = {}
    for r in got:
        x = raw[(r.doc_id, r.n_bytes)]
        payload = x + bytes(-len(x) % 64 if x else 64)
        media = au.to_wav(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert seen.setdefault(x, r.feature) == r.feature
    assert len(got) == odd_docs.count() and len(set(seen.values())) > 3
    assert au.digest(au.analyse(au.store(no_docs))).count() == 0


def test_tensors(odd_docs):
    """The stored column gives back fixed-shape tensors, equal to the windows of the log-mel frames."""
    row = au.analyse(au.store(odd_docs.filter("doc_id = 8"))).collect()[0]
    got = au.read_tensors(bytes(row.tensors))
    tensors = got.column("tensor")
    assert tensors.type == pa.fixed_shape_tensor(pa.float32(), [au.FRAMES, au.MELS])
    n = row.n_windows
    assert tensors.to_numpy_ndarray().shape == (n, au.FRAMES, au.MELS) and n > 10
    start, end, frames = (got.column(c).to_numpy() for c in ("start_ms", "end_ms", "frames"))
    assert (end > start).all() and (np.diff(start) > 0).all() and frames.sum() == row.n_frames
    y = au.resample((np.frombuffer(row.samples, np.uint8).astype(np.float32) - 128) / 128)
    mel, _ = au.log_mel(y - y.mean(), au.RATE * au.UP / au.DOWN)
    assert np.allclose(tensors.to_numpy_ndarray().reshape(-1, au.MELS)[: len(mel)], mel, atol=1e-4)
    assert au.UP > 1 and bytes(row.media).endswith(bytes(row.samples))
