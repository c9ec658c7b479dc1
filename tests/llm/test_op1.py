import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import audio_features as A
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_payloads_survive_the_round_trip(spark):
    texts = {r.doc_id: r.text for r in cases.documents(spark).select("doc_id", "text").collect()}
    for r in A.op1_audio_features(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)


def test_hard_cases(spark):
    df = cases.frame(spark).withColumn("media", A.wav_of_text(F.col("text")))
    rows = A.extract(df).collect()
    assert len(rows) == len(cases.TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[1].feature == by[2].feature and by[3].feature == by[4].feature and by[4].payload_bytes == 64
    table = A.from_arrow(by[7].tensors)
    assert table.schema == A.FEATURES and table.num_rows == by[7].n_windows
    assert A.extract(df.limit(0)).count() == 0
    assert A.extract(df.withColumn("media", F.lit(None).cast("binary"))).where("feature is null").count() == len(rows)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (1, 1), (2, 3), (4, 1)])
def test_resampling_equals_filtering_of_all_samples(up, down):
    x = np.random.default_rng(1).normal(size=300)
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    want = x if up == down else np.convolve(spread, A.phases(up, down).T.ravel())[::down]
    n = len(x) * up // down - 10
    assert np.allclose(A.resample(x, up, down, 5, n), want[5:n])


def test_blocks_do_not_show(monkeypatch):
    x = memoryview(np.random.default_rng(2).integers(0, 256, 70_000).astype(np.uint8).tobytes())
    whole = A.log_mel(x, 11_025)
    monkeypatch.setattr(A, "BLOCK_WINDOWS", 1)
    assert np.allclose(A.log_mel(x, 11_025), whole, atol=1e-12)


def test_hysteresis_and_spans():
    level = np.array([0, 5, 11, 5, 0, 5, 5, 0, 12, 0.0])
    assert A.hysteresis(level, 10, 4).tolist() == [False, True, True, True, False, False, False, False, True, False]
    tone = (128 + 100 * np.sin(np.arange(16_000) * 0.3)).astype(np.uint8)
    quiet = np.full(16_000, 128, np.uint8)
    f = A.features(memoryview(np.concatenate([quiet, tone, quiet]).tobytes()), 16_000)
    assert len(f.segments) == 1 and abs(f.segments[0, 0] - 1) < 0.05 and abs(f.segments[0, 1] - 2) < 0.05


def plain_features(samples, rate):
    """Energies, level, loud frames and spans by the definitions, one frame after the other."""
    x = [(v - 128) / 128 for v in samples]
    g = np.gcd(rate, A.RATE)
    up, down = A.RATE // g, rate // g
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    y = np.convolve(spread, A.phases(up, down).T.ravel())[::down] if up != down else np.array(x)
    frames = max(1, -(-(-(-len(x) * up // down) - A.FRAME) // A.STEP) + 1)
    y = np.pad(y, (0, frames * A.STEP + A.FRAME))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20.0), mel(A.RATE / 2), A.MELS + 2)]
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / A.FRAME) for i in range(A.FRAME)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(A.FFT // 2 + 1), np.arange(A.FRAME)) / A.FFT)
    bank = np.zeros((A.FFT // 2 + 1, A.MELS))
    for k in range(A.FFT // 2 + 1):
        f = k * A.RATE / A.FFT
        for m in range(A.MELS):
            lo, mid, hi = edges[m : m + 3]
            bank[k, m] = max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
    energies = np.log10(np.maximum([abs(turn @ (y[i * A.STEP : i * A.STEP + A.FRAME] * window)) ** 2 @ bank for i in range(frames)], 1e-10))
    level = [10 * np.log10(sum(10**e for e in row)) for row in energies]
    loud, inside = [], False
    for i, v in enumerate(level):  # a run over the lower threshold counts if it reaches the upper one
        if v < max(level) - A.LOWER:
            inside = False
        elif not inside:
            end = next((j for j in range(i, frames) if level[j] < max(level) - A.LOWER), frames)
            inside = max(level[i:end]) >= max(level) - A.UPPER
        loud.append(inside)
    return energies, np.array(loud)


@pytest.mark.parametrize(("rate", "n"), [(16_000, 9_000), (16_000, 64), (8_000, 3_000), (11_025, 2_000)])
def test_features_equal_a_plain_version(rate, n):
    samples = np.random.default_rng(n).integers(60, 200, n).astype(np.uint8)
    samples[n // 3 : n // 2] = 128 + samples[n // 3 : n // 2] % 3
    energies, loud = plain_features(samples.tolist(), rate)
    table = A.from_arrow(A.to_arrow(A.features(memoryview(samples.tobytes()), rate)))
    stored = np.concatenate([c.to_numpy_ndarray() for c in table["log_mel"].chunks]).reshape(-1, A.MELS)
    assert table.schema.field("log_mel").type.shape == [A.WINDOW_FRAMES, A.MELS]
    assert np.abs(stored[: len(energies)] - energies).max() < 1e-3 and (stored[len(energies) :] == -10).all()
    assert np.concatenate(table["in_segment"].to_pylist())[: len(loud)].tolist() == loud.tolist()
    starts = [k * A.WINDOW_FRAMES * A.STEP / A.RATE for k in range(table.num_rows)]
    assert np.allclose(table["start_s"], starts) and abs(table["end_s"][-1].as_py() - ((len(energies) - 1) * A.STEP + A.FRAME) / A.RATE) < 1e-9


def test_the_query_returns_its_tensors(spark):
    for r in A.op1_audio_features(spark, SF).limit(5).collect():
        assert hashlib.sha256(r.tensors).hexdigest() == r.feature and A.from_arrow(bytes(r.tensors)).num_rows == r.n_windows


def test_other_files_are_errors():
    with pytest.raises(ValueError, match="not a WAV"):
        A.read_wav(b"junk")
