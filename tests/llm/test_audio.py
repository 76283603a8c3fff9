"""Audio features against plain definitions, and the stored files."""

import numpy as np
import pyarrow as pa
import pytest

from stowlens.llm import audio, files

TEXTS = [None, "", "short", "A longer text, whose bytes are samples. " * 40, "ünïcödé " * 900, "A longer text, whose bytes are samples. " * 40]


def samples(n, seed=1):
    t = np.arange(n) / audio.RATE
    return (0.4 * np.sin(2 * np.pi * 700 * t) + np.random.default_rng(seed).normal(0, 0.1, n)).astype(np.float32)


def taps():
    """The low-pass in one piece: a Hann-windowed sinc with a sum of UP."""
    n = audio.TAPS * audio.UP
    h = np.sinc((np.arange(n) - (n - 1) / 2) / audio.DOWN) * np.hanning(n + 2)[1:-1]
    return h * audio.UP / h.sum()


@pytest.mark.parametrize("n", [64, 128, 640, 4096])
def test_polyphase_resampling_is_filter_and_decimation(n):
    x, h = samples(n), taps()
    up = np.zeros(n * audio.UP)
    up[:: audio.UP] = x  # zeros between samples, the low-pass, then every DOWN-th
    want = np.convolve(up, h)[: n * audio.UP : audio.DOWN]
    assert audio.resample(x) == pytest.approx(want, abs=1e-5) and len(audio.resample(x)) == -(-n * audio.UP // audio.DOWN)


def test_log_mel_by_the_definition():
    y = samples(1000, 2)
    mel, energy = audio.log_mel(y)
    frames = -(-(len(y) - audio.FRAME) // audio.HOP) + 1
    y = np.concatenate([y, np.zeros(frames * audio.HOP + audio.FRAME)])
    window, bank = np.hanning(audio.FRAME), audio._mel()[1]
    k = np.arange(audio.FRAME // 2 + 1)
    for f in range(frames):
        cut = y[f * audio.HOP : f * audio.HOP + audio.FRAME] * window
        power = np.abs((cut * np.exp(-2j * np.pi * np.outer(k, np.arange(audio.FRAME)) / audio.FRAME)).sum(axis=1)) ** 2
        assert mel[f] == pytest.approx(np.log(power @ bank + 1e-6), abs=1e-3) and energy[f] == pytest.approx(10 * np.log10(power.sum() + 1e-6), abs=1e-3)
    assert len(mel) == frames and (bank.max(axis=0) > 0).all()


def test_mel_filters_are_triangles_between_neighbours():
    rate = audio.RATE * audio.UP / audio.DOWN
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    centres = np.linspace(0, to_mel(rate / 2), audio.MELS + 2)
    f = np.arange(audio.FRAME // 2 + 1) * rate / audio.FRAME
    bank = audio._mel()[1]
    for m in range(audio.MELS):
        assert not bank[(to_mel(f) <= centres[m]) | (to_mel(f) >= centres[m + 2]), m].any() and (bank[:, m] <= 1).all()


def test_hysteresis_by_a_loop():
    rng = np.random.default_rng(3)
    for _ in range(300):
        energy = rng.normal(0, 3, rng.integers(1, 60))
        floor, on, runs = np.median(energy), False, []
        for k, e in enumerate(energy):
            if not on and e >= floor + audio.RISE_DB:
                on = True
                runs.append([k, k])
            elif on and e < floor + audio.FALL_DB:
                on = False
            if on:
                runs[-1][1] = k + 1
        assert audio.hysteresis(energy) == [tuple(r) for r in runs]


def test_files_hold_fixed_shape_tensors(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    stored = audio.store(df)
    seen = {}
    for r in stored.collect():
        with pa.ipc.open_file(files.opened(r.path)) as file:
            t = file.read_all()
        assert t.schema == audio.STORED and t.schema.field("tensors").type.value_type == pa.fixed_shape_tensor(pa.float16(), [audio.TENSOR_FRAMES, audio.MELS])
        assert r.n_docs == t.num_rows
        seen |= {k: (m, len(x), len(s)) for k, m, x, s in zip(t["doc_id"].to_pylist(), t["media"].to_pylist(), t["tensors"].combine_chunks(), t["spans"].to_pylist(), strict=True)}
    for k, text in enumerate(TEXTS):
        payload, _ = audio.payload_of(text)
        assert seen[k][0] == audio.wav_encode(payload) and seen[k][1] == seen[k][2]
    back = {r.doc_id: r for r in audio.load(stored).collect()}
    assert all(len(x["values"]) == audio.TENSOR_FRAMES * audio.MELS for r in back.values() for x in r.tensors) and len(back) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        f = audio.features(audio.payload_of(text)[0])
        got = np.array([x["values"] for x in back[k].tensors])
        assert got == pytest.approx(f["cube"], abs=0.01) and back[k].tensors[-1]["end_s"] == pytest.approx(f["n_frames"] * f["seconds"])
        assert [(s["start_s"], s["end_s"]) for s in back[k].segments] == pytest.approx([(a * f["seconds"], b * f["seconds"]) for a, b in f["segments"]])
    digests = {r.doc_id: r for r in audio.digest(stored).collect()}
    assert digests[3][1:] == digests[5][1:] and digests[0][1:] == digests[1][1:]
