"""Media columns: audio features over byte payloads kept as 8-bit PCM.

A text's UTF-8 bytes, filled up with 0 to a positive multiple of 64, are the samples of a mono
8-bit WAV. The WAV is decoded again and features come from its samples: a polyphase resampling
by 2/3, log-mel filterbanks over half-overlapping windows, and energy segments by hysteresis.
Filterbanks are cut into tensors of one fixed shape (TENSOR_FRAMES x MELS), each with its time span.

store() writes media and features as Arrow files of about FILE_BYTES in the shared folder, in which tensors
are a list of Arrow's fixed-shape tensor type (16-bit floats), and gives the table of these files. load() and
digest() read the files back; nothing of what they return comes from the texts.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values; further
columns of the input are ignored, repeated rows are kept, an empty table gives no file and no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from stowlens.llm import files
from stowlens.llm.common import BATCH_ROWS, shared_folder, ship, whole_text, written

PAD, RATE, UP, DOWN = 64, 12_000, 2, 3
TAPS = 8  # of each phase
FRAME, HOP, MELS, TENSOR_FRAMES = 256, 128, 20, 32
RISE_DB, FALL_DB = 3.0, 1.0  # above the text's median energy
HEADER = 44
#: Bytes of media and tensors after which a file is closed.
FILE_BYTES = 32 << 20
TENSOR = pa.fixed_shape_tensor(pa.float16(), [TENSOR_FRAMES, MELS])
_SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
#: What a file has of each document; the k-th span is the k-th tensor's.
STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("n_samples", pa.int64()), ("n_frames", pa.int32()),
    ("tensors", pa.list_(TENSOR)), ("spans", pa.list_(_SPAN)), ("segments", pa.list_(_SPAN)),
])

SCHEMA = (
    "doc_id bigint, n_bytes bigint, media binary, n_samples bigint, n_frames int, "
    "tensors array<struct<start_s: double, end_s: double, values: array<float>>>, "
    "segments array<struct<start_s: double, end_s: double>>"
)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes((-len(raw)) % PAD or PAD * (not raw)), len(raw)


def wav_encode(payload: bytes) -> bytes:
    """A mono 8-bit PCM WAV of the payload, sample for byte."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def wav_decode(media: bytes) -> bytes:
    riff, _, wave, fmt, _, codec, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, data, codec, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != HEADER + n:
        raise ValueError("not an 8-bit mono WAV")
    return media[HEADER:]


@functools.cache
def _filter() -> np.ndarray:
    """Phases of a Hann-windowed sinc low-pass: row p holds the taps for outputs k*UP + p."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return h.reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP/DOWN times its rate; y[m] = sum of h[m*DOWN - i*UP] x[i], by phases."""
    n_out = -(-len(x) * UP // DOWN)
    steps = -(-n_out // UP)
    padded = np.concatenate([np.zeros(TAPS, np.float32), x, np.zeros(DOWN * 2 + TAPS, np.float32)])
    y = np.zeros((steps, UP), np.float32)
    for p in range(UP):
        at, phase = divmod(p * DOWN, UP)
        for j, w in enumerate(_filter()[phase]):
            first = TAPS + at - j
            y[:, p] += w * padded[first : first + DOWN * steps : DOWN][:steps]
    return y.reshape(-1)[:n_out]


@functools.cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """The window, and triangular filters evenly spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (f[:, None] - edges[:-2]) / np.diff(edges)[:-1]
    down = (edges[2:] - f[:, None]) / np.diff(edges)[1:]
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of half-overlapping windows, and each window's energy in dB."""
    window, mel = _mel()
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(y)), np.float32)])
    rows, energy = [], []
    for at in range(0, frames, 4096):  # a very long text needs no more memory than this
        cut = sliding_window_view(y, FRAME)[at * HOP : (min(at + 4096, frames) - 1) * HOP + 1 : HOP] * window
        power = np.abs(np.fft.rfft(cut, axis=1)) ** 2
        rows.append(np.log(power @ mel + np.float32(1e-6)).astype(np.float32))
        energy.append(10 * np.log10(power.sum(axis=1) + 1e-6))
    return np.concatenate(rows), np.concatenate(energy)


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that begin above the rising threshold and end below the falling one."""
    floor = np.median(energy)
    mark = np.where(energy >= floor + RISE_DB, 1, np.where(energy < floor + FALL_DB, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (at >= 0) & (mark[at] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(payload: bytes) -> dict:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    mel, energy = log_mel(resample(x))
    seconds = HOP * DOWN / (RATE * UP)
    blocks = -(-len(mel) // TENSOR_FRAMES)
    cube = np.zeros((blocks * TENSOR_FRAMES, MELS), np.float32)
    cube[: len(mel)] = np.round(mel, 3)
    return {"n_samples": len(x), "n_frames": len(mel), "seconds": seconds, "cube": cube.reshape(blocks, -1), "segments": hysteresis(energy)}


def extracted(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """A batch of a file: media and features of texts."""
    out = {k: [] for k in ("n_bytes", "media", "n_samples", "n_frames", "spans", "segments")}
    cubes, counts = [np.zeros((0, TENSOR_FRAMES * MELS), np.float32)], [0]
    for text in texts:
        payload, n = payload_of(text)
        media = wav_encode(payload)
        f = features(wav_decode(media))
        s, blocks = f["seconds"], len(f["cube"])
        ends = [min((k + 1) * TENSOR_FRAMES, f["n_frames"]) * s for k in range(blocks)]
        spans = [{"start_s": k * TENSOR_FRAMES * s, "end_s": end} for k, end in enumerate(ends)]
        segments = [{"start_s": a * s, "end_s": b * s} for a, b in f["segments"]]
        for name, value in zip(out, (n, media, f["n_samples"], f["n_frames"], spans, segments), strict=True):
            out[name].append(value)
        cubes.append(f["cube"])
        counts.append(counts[-1] + blocks)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(cubes).astype(np.float16).reshape(-1)), TENSOR_FRAMES * MELS)
    tensors = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.ExtensionArray.from_storage(TENSOR, flat))
    made = {k: pa.array(v, STORED.field(k).type) for k, v in out.items()}
    return pa.RecordBatch.from_arrays([ids, *(tensors if k == "tensors" else made[k] for k in STORED.names[1:])], schema=STORED)


def store(docs: DataFrame) -> DataFrame:
    """path and n_docs of the files that hold the documents' media and features."""
    folder = shared_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                for b in waiting:
                    file.write_batch(b)
            path, n = files.put(folder, "media", sink.getvalue()), sum(b.num_rows for b in waiting)
            waiting.clear()
            return pa.RecordBatch.from_pydict({"path": [path], "n_docs": [n]})

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                cut = batch.slice(at, BATCH_ROWS)
                waiting.append(extracted(cut.column(0), cut.column(1).to_pylist()))
                if sum(b.nbytes for b in waiting) >= FILE_BYTES:
                    yield closed()
        if waiting:
            yield closed()

    ship(docs.sparkSession)
    return written(docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "path string, n_docs bigint"))


def _read(stored: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over the batches of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.opened(path) as source, pa.ipc.open_file(source) as file:
                    for k in range(file.num_record_batches):
                        yield fn(file.get_batch(k))

    ship(stored.sparkSession)
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.select("path").repartition(tasks).mapInArrow(run, schema)


def _tensors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All tensors of a stored batch, and where each document's begin."""
    lists = batch.column("tensors")
    return lists.values.to_numpy_ndarray(), lists.offsets.to_numpy()


def load(stored: DataFrame) -> DataFrame:
    """One row for each document: its media, filterbank tensors with time spans, segments, read from the files."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cubes, _ = _tensors(batch)
        spans, size = batch.column("spans").values, TENSOR_FRAMES * MELS
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(cubes) + 1, dtype=np.int32) * size), pa.array(cubes.reshape(-1).astype(np.float32)))
        each = pa.StructArray.from_arrays([spans.field("start_s"), spans.field("end_s"), values], ["start_s", "end_s", "values"])
        tensors = pa.ListArray.from_arrays(batch.column("tensors").offsets, each)
        return pa.RecordBatch.from_arrays([*batch.columns[:5], tensors, batch.column("segments")], ["doc_id", "n_bytes", "media", "n_samples", "n_frames", "tensors", "segments"])

    return _read(stored, run, SCHEMA)


def audio_features(docs: DataFrame) -> DataFrame:
    """Stored media and features of documents, read back."""
    return load(store(docs))


def digest(stored: DataFrame) -> DataFrame:
    """Digests of stored media and features: the payload is decoded from the media, the feature's sums are the tensors'."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cubes, offsets = _tensors(batch)
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        segments = batch.column("segments").to_pylist()
        for k, media in enumerate(batch.column("media").to_pylist()):
            payload = wav_decode(media)
            spans = ",".join(f"{s['start_s']:.3f}-{s['end_s']:.3f}" for s in segments[k])
            mel = cubes[offsets[k] : offsets[k + 1]].astype(np.float64).sum()
            feature = f"frames={batch.column('n_frames')[k]};mel={mel:.1f};segments={len(segments[k])};spans={hashlib.md5(spans.encode()).hexdigest()}"
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, out.values())], ["doc_id", "n_bytes", *out])

    return _read(stored, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
