"""Audio intervals: operators on PCM samples, applied to WAV bytes in Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import CAPABILITY_UNAVAILABLE, REDACTION, VeilError
from ..plans.policy import Redaction


def _wave(kind: str, phase: np.ndarray) -> np.ndarray:
    turn = phase % 1.0
    if kind == "sine":
        return np.sin(2 * np.pi * phase)
    if kind == "square":
        return np.where(turn < 0.5, 1.0, -1.0)
    if kind == "triangle":
        return 1 - 4 * np.abs(turn - 0.5)
    if kind == "sawtooth":
        return 2 * turn - 1
    raise VeilError(REDACTION, f"no waveform {kind!r}")


def apply(samples: np.ndarray, rate: int, intervals: list[tuple[float, float]], r: Redaction) -> np.ndarray:
    """``samples`` (frames x channels, signed) with operator ``r`` on intervals in seconds; erase cuts them out, the others keep the length."""
    if r.kind == "keep":
        return samples
    out, gone = samples.copy(), np.zeros(len(samples), bool)
    for start, end in intervals:
        a, z = max(0, int(round(start * rate))), min(len(samples), int(round(end * rate)))
        if a >= z:
            continue
        if r.kind == "erase":
            gone[a:z] = True
        elif r.kind == "silence":
            out[a:z] = 0
        elif r.kind == "beep":
            top = np.iinfo(samples.dtype).max
            tone = _wave(r["waveform"], np.arange(z - a) * float(r["hz"]) / rate) * float(r["amplitude"]) * top
            out[a:z] = np.rint(tone).astype(samples.dtype)[:, None]
        else:
            raise VeilError(REDACTION, f"no audio operator {r.kind!r}")
    return out[~gone] if gone.any() else out


def redact_wav(data: bytes, intervals: list[tuple[float, float]], r: Redaction) -> bytes:
    """A 16- or 32-bit PCM WAV file with ``r`` on its intervals."""
    with wave.open(io.BytesIO(data)) as w:
        params, frames = w.getparams(), w.readframes(w.getnframes())
    kinds = {2: np.int16, 4: np.int32}
    if params.sampwidth not in kinds:
        raise VeilError(CAPABILITY_UNAVAILABLE, f"WAV with {8 * params.sampwidth} bits")
    samples = np.frombuffer(frames, kinds[params.sampwidth]).reshape(-1, params.nchannels)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(params.nchannels)
        w.setsampwidth(params.sampwidth)
        w.setframerate(params.framerate)
        w.writeframes(apply(samples, params.framerate, intervals, r).tobytes())
    return out.getvalue()


def redact_audio(df: DataFrame, r: Redaction, content_col: str = "content", intervals_col: str = "intervals") -> DataFrame:
    """``df`` with operator ``r`` on each clip's intervals (array<struct<t_start,t_end>>); without intervals the bytes stay as they are."""
    at, spans = df.columns.index(content_col), df.columns.index(intervals_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, intervals in zip(b.column(at).to_pylist(), b.column(spans).to_pylist()):
                out.append(redact_wav(data, [(x["t_start"], x["t_end"]) for x in intervals], r) if data is not None and intervals and r.kind != "keep" else data)
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.binary())
            yield pa.record_batch(columns, b.schema.names)

    return df.mapInArrow(run, df.schema)
