import io
import wave

import numpy as np

from tidemark.llm import media
from tidemark.llm.media import FRAME, HOP, RATE, SPAN, _filters, align, chroma, decode, fingerprint, fingerprints, sonify


def test_filters_by_brute_force():
    c = np.random.default_rng(1).random((70, 12))
    wide = np.concatenate([c, c], axis=1)
    got = fingerprint(c)
    assert len(got) == len(c) - SPAN + 1 and {k for k, *_ in _filters()} == {0, 1, 2, 3}
    for f in range(len(got)):
        want = 0
        for kind, p, h, w in _filters():
            a = b = 0.0
            for i in range(w):
                for j in range(h):
                    late, upper, inside = i >= w // 2, j >= h // 2, w // 4 <= i < w - w // 4
                    plus = (late, upper, late == upper, inside)[kind]
                    a, b = a + wide[f + i, p + j] * plus, b + wide[f + i, p + j] * (not plus)
            level = sum(np.log((a + 0.1) / (b + 0.1)) >= t for t in (-0.25, 0.0, 0.25))
            want = want << 2 | level ^ level >> 1
        assert int(got[f]) == want


def wav(x, width=2, rate=RATE, channels=1):
    """Samples on the 16-bit scale as a WAV of another width."""
    x = np.repeat(np.asarray(x, dtype=float), channels)
    raw = (x / 256 + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v * 256 ** (width - 2)).to_bytes(width, "little", signed=True) for v in x)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def test_widths_rates_and_broken_files():
    x = np.round(np.sin(np.arange(5000) / 7) * 20000)
    for width in (1, 2, 3, 4):
        for channels in (1, 2):
            got = decode(wav(x, width, channels=channels))
            assert len(got) == len(x) and np.abs(got - x).max() <= (256 if width == 1 else 0.01)
    assert abs(len(decode(wav(x, rate=8000))) - 2500) <= 1 and len(decode(wav(x, rate=2000))) == 10000
    zero = bytearray(wav(x))
    zero[24:28] = bytes(4)
    assert all(len(decode(raw)) == 0 for raw in (None, b"", b"RIFF", bytes(zero), wav(x, rate=1), wav([])))
    assert len(decode(wav(x)[:-3])) in (0, len(x) - 2)


def test_blocks_of_frames(monkeypatch):
    x = np.random.default_rng(0).normal(size=20000)
    whole = chroma(x)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert np.allclose(whole, chroma(x))


def test_recall_between_hops(spark):
    """Copies that start anywhere between two hops, with noise and cuts, are found; no foreign recording is."""
    rng = np.random.default_rng(0)
    songs = [decode(sonify(rng.normal(size=64))) for _ in range(20)]
    cuts = [(k, shift) for k in range(20) for shift in (64, 128, 192, 300)]
    pieces = [songs[k][shift : len(songs[k]) - 900] for k, shift in cuts]
    noisy = [p + rng.normal(size=len(p)) * p.std() * 10 ** (-db / 20) for p, db in zip(pieces, [10, 20] * len(cuts))]
    rows = [(100 * (k + 1), wav(x)) for k, x in enumerate(songs)] + [(10_001 + i, wav(np.clip(p, -32000, 32000))) for i, p in enumerate(noisy)]
    got = align(fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id")).where("kind = 'match'").collect()
    found = {(r["a"] // 100 - 1, r["b"] - 10_001): r["offset"] for r in got if r["b"] > 10_000 and r["a"] <= 2000}
    right = [i for i, (k, shift) in enumerate(cuts) if (k, i) in found and abs(found[k, i] + shift / HOP) <= 1]
    print("recall", len(right) / len(cuts))
    assert len(right) >= 0.9 * len(cuts) and all(cuts[i][0] == k for k, i in found)


def test_table_with_planted_parts(spark, tmp_path):
    """The registered query over vectors of which some hold parts of others, against all offsets compared."""
    from tidemark.llm.contract import op9_media

    rng = np.random.default_rng(8)
    v = [rng.uniform(-1, 1, 70) for _ in range(6)]
    rows = [(100 * i, x) for i, x in enumerate(v)] + [(1 + i, np.concatenate([rng.uniform(-1, 1, 9), x[15:60]])) for i, x in enumerate(v[:4])]
    rows = [(i, np.append(x, 1.0).tolist()) for i, x in rows] + [(7, np.append(v[0], 1.0).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    prints = {i: fingerprint(chroma(decode(sonify(np.array(x))))).view(np.int32) for i, x in rows if i != 7}
    want = {(a, b): m for a in prints if a % 100 == 0 for b in prints if a != b and (m := brute_match(prints[a], prints[b]))}
    assert all((100 * i, 1 + i) in want for i in range(4))
    out = op9_media(spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]): (r["votes"], -abs(r["offset"]), r["offset"], r["bit_error"]) for r in out if r["kind"] == "match"} == want
    assert [(r["a"], r["b"]) for r in out if r["kind"] == "copy"] == [(0, 7)]


def test_alignment(spark):
    rng = np.random.default_rng(3)
    song = rng.normal(size=120)
    other = [rng.normal(size=120) for _ in range(3)]
    noisy = decode(sonify(song)) + rng.normal(size=120 * 512) * 300
    top = np.append(song, np.abs(song).max())  # keeps the scale of the cut piece
    rows = [(100, sonify(top)), (1, sonify(top)), (2, wav(noisy.clip(-32000, 32000))), (3, sonify(np.append(song[20:], np.abs(song).max()))), (4, sonify(other[0])), (200, sonify(other[1])), (5, None), (6, b""), (7, b"no sound"), (None, sonify(top))]
    df = spark.createDataFrame(rows, "vec_id long, audio binary")
    got = {(r["kind"], r["a"], r["b"]): r for r in align(fingerprints(df, "vec_id")).collect()}
    assert ("copy", 1, 100) in got and ("match", 1, 2) in got and ("match", 1, 3) in got
    assert got["match", 1, 3]["offset"] == -40 and got["match", 1, 2]["offset"] == 0
    assert not any(4 in k[1:] or 200 in k[1:] for k in got)
    assert align(fingerprints(df.limit(0), "vec_id")).count() == 0
    assert chroma(np.zeros(FRAME + 3 * HOP)).shape == (4, 12)


def brute_match(x, y, max_error=0.2, min_votes=4):
    """Best of all offsets, every pair of frames compared."""
    x, y, found = np.array(x, dtype=np.int32), np.array(y, dtype=np.int32), []
    for offset in range(-len(x) + 1, len(y)):
        lo = max(0, -offset)
        n = min(len(x) - lo, len(y) - lo - offset)
        a, b = x[lo : lo + n], y[lo + offset : lo + offset + n]
        votes, error = int((a == b).sum()), sum(int(v).bit_count() for v in (a ^ b).view(np.uint32)) / (32 * n)
        if votes >= min_votes and error <= max_error:
            found.append((votes, -abs(offset), offset, error))
    return max(found, default=None)


def test_repeated_sections(spark):
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(-(2**31), 2**31, n).tolist()
    line, x, y, loop = draw(60), draw(80), draw(50), draw(3)
    noisy = [v ^ (int(i % 3 > 0) << int(rng.integers(31))) for i, v in enumerate(loop * 40)]
    rows = [(100, line + x + line + y), (1, line + y), (200, loop * 30), (2, loop * 20), (3, noisy), (300, [7] * 90), (4, [7] * 130), (5, draw(90)), (6, draw(9) + line[:30])]
    df = spark.createDataFrame(rows, "id long, print array<int>")
    want = {(a, b): m for a, p in rows if a % 100 == 0 for b, q in rows if a != b and (m := brute_match(p, q))}
    assert want[100, 1][:3] == (110, -140, -140) and (200, 2) in want and (300, 4) in want
    got = {(r["a"], r["b"]): (r["votes"], -abs(r["offset"]), r["offset"], r["bit_error"]) for r in align(df).collect()}
    assert got == want


def test_correlate():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (5, 300), (400, 70)):
        x, y = np.sort(rng.choice(2000, n, replace=False)), np.sort(rng.choice(3000, m, replace=False))
        at, c = np.unique(y[None, :] - x[:, None], return_counts=True)
        assert dict(zip(*(v.tolist() for v in media.correlate(x, y)))) == dict(zip(at.tolist(), c.tolist()))


def test_second_voice():
    note = np.append(np.random.default_rng(2).integers(0, 36, 60), 36)
    low, high = ((note + np.append(np.full(60, f), 0)) / 18 - 1 for f in (0.1, 0.9))
    assert sonify(low) != sonify(high)
    assert (fingerprint(chroma(decode(sonify(low)))) != fingerprint(chroma(decode(sonify(high))))).any()


def test_query_returns_every_recording(spark, tmp_path):
    from tidemark.llm.contract import op9_media

    v = np.random.default_rng(4).normal(size=(3, 40)).tolist()
    rows = [(5, v[0]), (2, v[0]), (7, v[1]), (8, [1.0]), (9, None), (None, v[2])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = [r for r in op9_media(spark, str(tmp_path)).collect() if r["kind"] == "recording"]
    assert {(r["b"], r["a"], r["frames"]) for r in out} == {(5, 2, 46), (2, 2, 46), (7, 7, 46), (8, None, 0), (9, None, 0), (None, None, 46)} and len(out) == 6
    digest = {r["b"]: r["digest"] for r in out}
    assert digest[5] == digest[2] != digest[7] and all(digest.values())
