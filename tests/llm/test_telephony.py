import hashlib
import zlib

import numpy as np
import pytest

from sylva.llm import telephony as m


def test_tables():
    # corners of G.711: fixed values
    assert [int(m.MU[i]) for i in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(m.A[i]) for i in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert len(set(m.MU.tolist())) == 255 and len(set(m.A.tolist())) == 256
    assert (m.A == -m.A[np.arange(256) ^ 0x80]).all()


def one_by_one(block):
    at = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(at)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(m.STEPS[index])
            change = step >> 3
            change += step >> 2 if code & 1 else 0
            change += step >> 1 if code & 2 else 0
            change += step if code & 4 else 0
            at = max(-32768, min(32767, at - change if code & 8 else at + change))
            index = max(0, min(88, index + int(m.INDEX[code & 7])))
            out.append(at)
    return out


def test_adpcm_against_a_loop():
    b = np.random.default_rng(0).integers(0, 256, (50, 64), dtype=np.uint8)
    got = m.adpcm(b)
    for i in range(50):
        assert got[i].tolist() == one_by_one(bytes(b[i]))


@pytest.mark.parametrize("tag", [m.PCM, m.ALAW, m.MULAW, m.IMA])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000])
def test_round_trip(tag, n):
    data = bytes(i * 7 % 256 for i in range(n))
    got = m.unwave(m.wave(data, tag))
    assert got == (tag, m.RATE, data)


def test_bad_media(spark):
    rows = [(1, m.wave(b"\x80" * 100, m.MULAW)), (2, None), (3, b"RIFF"), (4, b"junk" * 10), (5, m.wave(b"", m.ALAW)), (None, m.wave(bytes(range(128)), m.IMA)), (6, m.wave(b"\x01\x02\x03", m.PCM)), (7, m.wave(b"abc", m.PCM).replace(b"WAVEfmt \x10\0\0\0\x01\0", b"WAVEfmt \x10\0\0\0\x63\0"))]
    got = {r.id: r for r in m.decode_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert [got[i].n_samples for i in (1, 2, 3, 4, 5, None, 6, 7)] == [200, 0, 0, 0, 0, 484, 2, 0]
    assert got[1].rate == 16000 and got[2].rate is None and got[7].pcm is None and got[5].pcm == b""
    assert np.frombuffer(got[1].pcm, "<i2").tolist() == [32124] * 200


def test_cut_off_media(spark):
    """Every prefix of a file, and files whose sizes lie, give a row and don't end the task."""
    whole = m.wave(bytes(range(128)), m.IMA)
    rows = [(i, whole[:i]) for i in range(len(whole) + 1)] + [(-1, m.wave(b"ab", m.MULAW, 0)), (-2, b"RIFF\0\0\0\0WAVEfmt \xff\xff\xff\xff"), (-3, b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x07\0")]
    got = {r.id: r for r in m.decode_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert len(got) == len(rows) and got[len(whole)].n_samples == 484 and got[10].pcm is None and got[-1].pcm is got[-2].pcm is got[-3].pcm is None
    assert got[len(whole) - 1].n_samples == 242


def at_rate(x, rate, to):
    """Sample by sample."""
    wide = max(1, rate // to)
    if rate == to:
        return list(x)
    y = [sum(x[min(len(x) - 1, i + j)] for j in range(wide)) // wide for i in range(len(x))]
    out = []
    for i in range(-(-len(x) * to // rate)):
        k, part = divmod(i * rate, to)
        out.append(y[k] + (y[min(len(y) - 1, k + 1)] - y[k]) * part // to)
    return out


def test_resampled():
    assert m.resampled(np.array([0, 10, -10], np.int16), 8000, 16000).tolist() == [0, 5, 10, 0, -10, -10]
    rng = np.random.default_rng(3)
    for rate, to in ((8000, 16000), (8000, 8000), (8000, 11025), (44100, 16000), (16000, 8000), (48000, 8000), (7, 5), (1, 1000)):
        for n in (0, 1, 2, 50, 333):
            x = rng.integers(-32768, 32768, n).astype(np.int16)
            assert m.resampled(x, rate, to).tolist() == at_rate(x.tolist(), rate, to)


def test_stored_pcm(odd):
    """The query's digest of PCM is that of the files that store() writes and decode_media() reads."""
    pcm = {r.id: r for r in m.decode_media(m.store(odd)).collect()}
    for r in m.media_digest(odd).collect():
        if r.doc_id is not None and r.doc_id != 4:
            assert (r.pcm_samples, r.pcm_crc32) == (pcm[r.doc_id].n_samples, zlib.crc32(pcm[r.doc_id].pcm)) and r.pcm_samples == 2 * r.payload_bytes


def test_digest(odd, clashing, empty):
    texts = sorted((r.text or "" for r in odd.collect()))
    for df in (odd, clashing.repartition(3)):
        rows = m.media_digest(df).collect()
        stored = {r.id: r.media for r in m.store(df).collect()}
        by = {}
        for r in rows:
            by.setdefault(r.payload_sha256, set()).add(r[1:])
            if r.doc_id is not None and r.doc_id > 4:
                assert hashlib.sha256(stored[r.doc_id]).hexdigest() == r.media_sha256 and len(stored[r.doc_id]) == r.media_bytes
        assert all(len(x) == 1 for x in by.values()) or len({x[0] for y in by.values() for x in y}) > 1
        want = []
        for t in texts:
            b = t.encode()
            p = b + b"\0" * ((-len(b) % 64) if b else 64)
            want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert m.media_digest(empty).count() == 0


def test_features_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    data = [bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 5, 40, 2)]
    assert m.features(data) == [m.features([d])[0] for d in data]
