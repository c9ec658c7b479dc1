"""Operator 1: media columns: audio features as fixed-shape Arrow tensors with time spans.

Media are WAV files (mono, unsigned 8-bit samples) in a binary column. Each is resampled by a
polyphase filter, cut into overlapping frames, and turned into log-mel filterbank energies; frames
are segmented by hysteresis (a segment starts where the energy passes the upper threshold and lasts
while it stays over the lower one). The features of a file are an Arrow stream with one row per
window of WINDOW_FRAMES frames: its span in seconds, which frames are in a segment, and the energies
as an ``arrow.fixed_shape_tensor`` of WINDOW_FRAMES x MELS numbers (the last window is filled up).

Long files are worked through in blocks of fixed length, so memory is bounded and equal files have
equal features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: Payloads are filled up with 0 to a multiple of so many bytes; sample rate that a text is stored with.
UNIT, TEXT_RATE = 64, 16_000
#: Sample rate of the features; taps of the filter for each phase.
RATE, TAPS = 8_000, 16
#: Frames: samples, step, length of the transform; mel bands; frames of a window; windows of a block.
FRAME, STEP, FFT, MELS, WINDOW_FRAMES, BLOCK_WINDOWS = 200, 80, 256, 24, 64, 32
#: Hysteresis: decibels under the file's loudest frame for the start and for the end of a segment.
UPPER, LOWER = 12.0, 18.0
#: Decimals of stored energies.
DECIMALS = 3


def little(n: Column, size: int) -> Column:
    """n as little-endian bytes."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(size)))


def wav_of_text(text: Column, rate: int = TEXT_RATE) -> Column:
    """A text's UTF-8 bytes as the samples of a WAV file, filled up with 0 to a positive multiple of UNIT (null: empty)."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    size = (F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT).cast("long")
    number = lambda v, k: F.lit(v.to_bytes(k, "little"))
    payload = F.concat(raw, F.substring(F.lit(bytes(UNIT)), 1, (size - n).cast("int")))
    return F.concat(F.lit(b"RIFF"), little(size + 36, 4), F.lit(b"WAVEfmt "), number(16, 4), number(1, 2), number(1, 2), number(rate, 4), number(rate, 4), number(1, 2), number(8, 2), F.lit(b"data"), little(size, 4), payload)


def read_wav(media: bytes) -> tuple[int, memoryview]:
    """(sample rate, samples) of a mono 8-bit WAV file; ValueError for anything else."""
    view = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono samples of 8 bits are read")
        elif name == b"data" and rate is not None:
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int) -> np.ndarray:
    """Low-pass filter for resampling by up/down, a row of taps (newest sample first) for each of `up` phases."""
    n = TAPS * max(1, -(-down // up)) * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    taps = np.sinc(cutoff * t) * np.hamming(n) * cutoff
    return (up * taps / taps.sum()).reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int, down: int, first: int, last: int) -> np.ndarray:
    """Outputs first..last-1 of x resampled by up/down; x is silent before and after."""
    if up == down:
        return np.pad(x, (0, max(0, last - len(x))))[first:last]
    taps = phases(up, down)
    m = np.arange(first, last)
    phase, newest = m * down % up, m * down // up
    lo, hi = int(newest[0]) - taps.shape[1] + 1, int(newest[-1]) + 1
    part = np.pad(x[max(0, lo) : max(0, hi)], (max(0, -lo), max(0, hi - max(len(x), lo, 0))))
    spans = np.lib.stride_tricks.sliding_window_view(part, taps.shape[1])[:, ::-1]
    out = np.empty(len(m))
    for p in range(up):
        own = np.flatnonzero(phase == p)
        out[own] = spans[newest[own] - newest[0]] @ taps[p]
    return out


@lru_cache(maxsize=2)
def filterbank(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of the transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    up = (bins[:, None] - edges[:-2]) / np.diff(edges)[:-1]
    down = (edges[2:] - bins[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down))


@dataclass
class Features:
    energies: np.ndarray  # windows x WINDOW_FRAMES x MELS, float32
    loud: np.ndarray  # windows x WINDOW_FRAMES
    spans: np.ndarray  # windows x 2, seconds
    segments: np.ndarray  # segments x 2, seconds


def log_mel(samples: memoryview, rate: int) -> np.ndarray:
    """Log-mel energies of all frames (one at least; what lies beyond the end is silent), in blocks of fixed length."""
    x = np.frombuffer(samples, np.uint8)
    g = int(np.gcd(rate, RATE))
    up, down = RATE // g, rate // g
    n = -(-len(x) * up // down)
    frames = max(1, -(-(n - FRAME) // STEP) + 1)
    out, window, bank = [], np.hanning(FRAME + 1)[:-1], filterbank(RATE)
    for f in range(0, frames, WINDOW_FRAMES * BLOCK_WINDOWS):
        k = min(frames - f, WINDOW_FRAMES * BLOCK_WINDOWS)
        first, last = f * STEP, (f + k - 1) * STEP + FRAME
        lo, hi = max(0, first * down // up - TAPS * -(-down // up) - 1), last * down // up + 1
        lo -= lo % down  # so that the phases of the part are those of the whole
        part = (x[lo:hi].astype(float) - 128) / 128
        y = resample(part, up, down, first - lo * up // down, last - lo * up // down)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::STEP] * window
        power = np.abs(np.fft.rfft(cut, FFT)) ** 2
        out.append(np.log10(np.maximum(power @ bank, 1e-10)))
    return np.concatenate(out)


def hysteresis(level: np.ndarray, upper: float, lower: float) -> np.ndarray:
    """Which frames are in a segment: runs at or over `lower` that reach `upper` somewhere."""
    over = np.concatenate([[False], level >= lower, [False]])
    starts, ends = np.flatnonzero(over[1:] & ~over[:-1]), np.flatnonzero(~over[1:] & over[:-1])
    out = np.zeros(len(level), bool)
    if len(starts):
        reach = np.maximum.reduceat(np.append(level, -np.inf), np.stack([starts, ends], 1).ravel())[::2] >= upper
        steps = np.zeros(len(level) + 1, int)
        np.add.at(steps, starts[reach], 1)
        np.add.at(steps, ends[reach], -1)
        out = np.cumsum(steps)[:-1] > 0
    return out


def features(samples: memoryview, rate: int) -> Features:
    energies = log_mel(samples, rate)
    level = np.round(10 * np.log10((10**energies).sum(1)), DECIMALS)
    loud = hysteresis(level, level.max() - UPPER, level.max() - LOWER)
    edge = np.diff(np.concatenate([[0], loud.view(np.int8), [0]]))
    segments = np.stack([np.flatnonzero(edge == 1) * STEP, (np.flatnonzero(edge == -1) - 1) * STEP + FRAME], 1) / RATE
    windows = -(-len(energies) // WINDOW_FRAMES)
    spare = windows * WINDOW_FRAMES - len(energies)
    starts = np.arange(windows) * WINDOW_FRAMES * STEP
    ends = np.minimum(starts + (WINDOW_FRAMES - 1) * STEP, (len(energies) - 1) * STEP) + FRAME
    padded = np.pad(np.round(energies, DECIMALS), ((0, spare), (0, 0)), constant_values=-10.0)
    return Features(padded.astype(np.float32).reshape(windows, WINDOW_FRAMES, MELS) + np.float32(0), np.pad(loud, (0, spare)).reshape(windows, WINDOW_FRAMES), np.stack([starts, ends], 1) / RATE, segments)


TENSOR = pa.fixed_shape_tensor(pa.float32(), (WINDOW_FRAMES, MELS))
FEATURES = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("in_segment", pa.list_(pa.bool_(), WINDOW_FRAMES)), ("log_mel", TENSOR)])


def to_arrow(f: Features) -> bytes:
    """The features as an Arrow stream of schema FEATURES."""
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(f.energies.ravel()), WINDOW_FRAMES * MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(f.spans[:, 0].copy()), pa.array(f.spans[:, 1].copy()), pa.FixedSizeListArray.from_arrays(pa.array(f.loud.ravel()), WINDOW_FRAMES), tensors], schema=FEATURES)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, FEATURES) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def extract(df: DataFrame, media_col: str = "media", id_cols: tuple[str, ...] = ("doc_id",), tensors: bool = True) -> DataFrame:
    """(id_cols, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_windows, segments[, tensors]) of every row.

    Payload columns describe the samples as read back from the file, `feature` is the SHA-256 of the
    Arrow stream, segments holds start and end seconds in turn, tensors is the stream itself. A null file
    has nulls throughout; a file that isn't WAV is an error; files of any length are worked through in
    blocks; repeated rows repeat; ids may be null; further columns, whatever their names, are left out;
    an empty table gives an empty one.
    """

    id_cols = list(id_cols)

    def rows(*columns):
        out = [[] for _ in range(8 + tensors)]
        for media in columns[-1]:
            made = [None] * len(out)
            if media is not None:
                rate, samples = read_wav(media)
                found = features(samples, rate)
                stream = to_arrow(found)
                made = [len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(stream).hexdigest(), len(found.spans), found.segments.ravel().tolist(), *([stream] if tensors else [])]
            for column, v in zip(out, made, strict=True):
                column.append(v)
        return [*columns[:-1], *out]

    kinds = dict(df.dtypes)
    ids = ", ".join(f"{c} {kinds[c].replace('bigint', 'long')}" for c in id_cols)
    schema = f"{ids}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_windows long, segments array<double>" + ", tensors binary" * tensors
    return C.per_batch(df, [*id_cols, media_col], schema, rows)


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a WAV file, written to the shared folder, read back and analysed; `tensors` are the features themselves."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    media = C.dealt(spark, sf_dir, "documents").select("doc_id", size.alias("n_bytes"), wav_of_text(F.col("text")).alias("media"))
    return extract(C.saved(media), id_cols=("doc_id", "n_bytes"))
