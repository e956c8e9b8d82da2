import io
import struct
import wave

import numpy as np

from tessera.llm import media


def tone(freq, seconds=0.5, rate=8000):
    return np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate)


def test_wav_round_trip_in_all_widths():
    x = (tone(440) * 0.5).astype(np.float32)
    rate, y = media.read_wav(media.write_wav(x))
    assert rate == 8000 and np.abs(x - y).max() < 1e-4
    for width in (1, 2, 3, 4):
        full = (1 << (8 * width - 1)) - 1
        ints = np.round(x * full).astype(np.int64) + (128 if width == 1 else 0)
        raw = b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in ints for _ in range(2))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
        _, y = media.read_wav(out.getvalue())
        assert len(y) == len(x) and np.abs(x - y).max() < 0.01


def brute_peaks(p):
    out = []
    for t in range(p.shape[0]):
        for f in range(p.shape[1]):
            near = p[max(0, t - media.NEAR_FRAMES) : t + media.NEAR_FRAMES + 1, max(0, f - media.NEAR_BINS) : f + media.NEAR_BINS + 1]
            if p[t, f] >= near.max() and p[t, f] >= media.FLOOR * p.max():
                out.append((t, f))
    return out


def test_peaks_and_pairs_against_brute_force():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 50, (40, 129)).astype(float)  # ties abound
    frames, bins = media.peaks(p)
    want = brute_peaks(p)
    assert list(zip(frames, bins)) == want
    at, hashes = media.pair_hashes(frames, bins)
    pairs = [(a, (f << 20) | (g << 8) | (b - a)) for a, f in want for b, g in want if 0 < b - a <= media.ZONE_FRAMES and abs(g - f) <= media.ZONE_BINS]
    assert sorted(zip(at.tolist(), hashes.tolist())) == sorted(pairs)


def test_stft_finds_the_tone():
    power = media.stft_power(tone(1000))
    assert (power.argmax(axis=1) == round(1000 / 8000 * media.WINDOW)).all()
    assert media.stft_power(np.ones(10)).shape == (1, media.WINDOW // 2 + 1)


def test_a_part_of_a_clip_has_its_prints():
    rng = np.random.default_rng(1)
    whole = np.concatenate([tone(f, 0.1) * a for f, a in zip(rng.integers(300, 3500, 30), rng.uniform(0.3, 1, 30))])
    part = whole[media.HOP * 40 : media.HOP * 120]
    a, b = set(media.fingerprint(media.write_wav(whole))[5].tolist()), media.fingerprint(media.write_wav(part))[5].tolist()
    other = media.fingerprint(media.write_wav(rng.normal(0, 0.3, 8000)))[5].tolist()
    share = lambda x: sum(h in a for h in x) / len(x)
    assert share(b) > 0.6 > 0.2 > share(other)


def test_table(spark):
    rows = [(1, None), (2, b""), (3, b"RIFFnonsense"), (4, media.write_wav(np.zeros(0))), (5, media.write_wav(np.zeros(9000))), (6, media.write_wav(tone(700, 20))), (6, media.write_wav(tone(700, 20))), (None, media.write_wav(tone(500)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, wav binary, prints string")
    got = media.fingerprints(df).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == 8 and [by[i].status for i in (1, 2, 3, 4, 5, 6)] == ["null", "unreadable", "unreadable", "ok", "ok", "ok"]
    assert by[1].prints is None and by[4].prints == by[5].prints == [] and by[6].n_samples == 160_000 and by[6].prints
    times = [p.t_ms for p in by[6].prints]
    assert times == sorted(times) and media.fingerprints(df.limit(0)).count() == 0
    v = spark.createDataFrame([(1, [0.1] * 64), (2, []), (3, None), (4, [1.0, -2.0, 0.5])], "vec_id long, embedding array<float>")
    wavs = {r.vec_id: r.wav for r in media.render_wav(v).collect()}
    assert wavs[2] is wavs[3] is None and media.read_wav(bytes(wavs[1]))[1].size == 8 * media.SEGMENT and media.read_wav(bytes(wavs[4]))[1].size == media.SEGMENT


def wav_of(bits, rate=8000, frames=400):
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 0, (bits + 7) // 8, bits) + b"data" + struct.pack("<I", frames * bits // 8) + bytes(range(200)) * (frames * bits // 1600 + 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def test_headers_that_are_odd(spark):
    rows = [(1, wav_of(40)), (2, wav_of(16, 3_000_000_000)), (3, wav_of(64)), (4, wav_of(16)[:30]), (5, wav_of(12))]
    by = {r.vec_id: r for r in media.fingerprints(spark.createDataFrame(rows, "vec_id long, wav binary")).collect()}
    assert [by[i].status for i in (1, 2, 3, 4)] == ["unreadable", "ok", "unreadable", "unreadable"] and by[5].status in ("ok", "unreadable")
    assert by[2].sample_rate == 3_000_000_000 and all(by[i].prints is None for i in (1, 3, 4))


def test_a_long_clip_is_read_whole():
    rng = np.random.default_rng(5)
    x = np.concatenate([tone(f, 1.0) * 0.8 for f in rng.integers(300, 3500, 900)])  # fifteen minutes: several blocks of frames
    status, rate, n, n_peaks, times, hashes = media.fingerprint(media.write_wav(x))
    assert status == "ok" and n == len(x) and times.max() > 890_000 and len(times) == len(hashes) and (np.diff(times) >= 0).all()
    late = media.fingerprint(media.write_wav(x[8000 * 800 :]))
    assert np.isin(late[5], hashes).mean() > 0.95
