"""Text primitives and FLAC media columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from profilum.llm import flac
from profilum.llm import text as X


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0cabAZé中\x00|", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    raw, starts, ends, rows, hashes = X.split_words(pa.array(texts, pa.string()))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert list(np.diff(rows)) == [len(w) for w in words]
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for ws in words for w in ws]
    seen = {}
    for w, h in zip([w for ws in words for w in ws], hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_window_hashes_tell_windows_apart():
    words = X.mix64(np.arange(50, dtype=np.uint64) % np.uint64(7))
    for size in (1, 2, 5, 10, 35):
        got = X.window_hashes(words, size)
        assert len(got) == 51 - size
        assert len(set(got.tolist())) == min(7, 51 - size)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
def test_round_trip_and_plain_decoder_agree(payloads):
    padded = [flac.pad(p) for p in payloads]
    streams = flac.encode(padded)
    signed = flac.decode(streams)
    assert [(np.frombuffer(s, np.uint8) ^ 0x80).tobytes() for s in signed] == padded
    for stream, samples in zip(streams, signed):
        info, channels = flac.decode_plain(stream)
        assert np.array(channels[0], np.int8).tobytes() == samples and info["samples"] == len(samples)


def test_linear_predictors_and_many_frames_and_seeking():
    t = np.arange(192 * 700)
    wave = (100 * np.sin(t / 9.0) + 20 * np.sin(t / 2.3)).astype(np.int8)
    payload = (wave.view(np.uint8) ^ 0x80).tobytes()
    (stream,) = flac.encode([payload])
    assert len(stream) < 0.8 * len(payload)
    assert flac.decode([stream])[0] == wave.tobytes()
    assert len(flac.metadata(stream)[0]["seek"]) == -(-700 // flac.SEEK_FRAMES)
    for start, count in ((0, 10), (25_000, 400), (192 * 699, 192)):
        assert flac.read_samples(stream, start, count) == wave[start : start + count].tobytes()


def test_damage_is_found():
    rng = random.Random(1)
    (stream,) = flac.encode([flac.pad(bytes(rng.randrange(97, 122) for _ in range(3000)))])
    for at in (4 + 4 + 20, len(stream) // 2, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 0x10
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode([stream[:-30]])


def _frame(channel_bits: int, subframes: str, number: int = 0, size_code: str = "0110", extra: str = "00000111", depth: str = "001") -> bytes:
    """A frame of 8 samples from bit strings."""
    head = f"{0x7FFC:015b}0{size_code}0000{channel_bits:04b}{depth}0{number:08b}{extra}"
    raw = bytes(int(head[i : i + 8], 2) for i in range(0, len(head), 8))
    raw += bytes([int(flac.crc8(np.frombuffer(raw, np.uint8)[None])[0])])
    body = "".join(f"{b:08b}" for b in raw) + subframes
    body += "0" * (-len(body) % 8)
    raw = bytes(int(body[i : i + 8], 2) for i in range(0, len(body), 8))
    crc = int(flac.crc16(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), np.full(1, len(raw)))[0])
    return raw + crc.to_bytes(2, "big")


def _stream(frames: bytes, channels: int, samples: int) -> bytes:
    packed = (8000 << 44 | (channels - 1) << 41 | 7 << 36 | samples).to_bytes(8, "big")
    return b"fLaC\x80" + (34).to_bytes(3, "big") + (8).to_bytes(2, "big") * 2 + bytes(6) + packed + bytes(16) + frames


def test_plain_decoder_knows_stereo_wasted_bits_and_escapes():
    s = lambda v, n: f"{v & (1 << n) - 1:0{n}b}"
    left = [1, 2, 3, 4, 5, 6, 7, 8]
    side = [a - b for a, b in zip(left, [8, 7, 6, 5, 4, 3, 2, 1])]
    verbatim = lambda v, n: "00000010" + "".join(s(x, n) for x in v)
    info, channels = flac.decode_plain(_stream(_frame(8, verbatim(left, 8) + verbatim(side, 9)), 2, 8))
    assert channels == [left, [8, 7, 6, 5, 4, 3, 2, 1]]
    mid = [(a + b) >> 1 for a, b in zip(left, channels[1])]
    _, channels = flac.decode_plain(_stream(_frame(10, verbatim(mid, 8) + verbatim(side, 9)), 2, 8))
    assert channels == [left, [8, 7, 6, 5, 4, 3, 2, 1]]
    wasted = "00000011" + "01" + "".join(s(x // 4, 6) for x in [4, 8, -4, 0, 12, 16, 20, 24])
    assert flac.decode([_stream(_frame(0, wasted), 1, 8)])[0] == np.array([4, 8, -4, 0, 12, 16, 20, 24], np.int8).tobytes()
    values = [5, -3, 0, 7, -8, 1, 2, -1]
    escape = "00010000" + "00" + "0000" + "1111" + "00100" + "".join(s(x, 4) for x in values)
    assert flac.decode([_stream(_frame(0, escape), 1, 8)])[0] == np.array(values, np.int8).tobytes()


def test_query_digest_and_blocks(odd, none):
    media = flac.encode_media(odd)
    got = flac.media_digest(media).collect()
    assert len(got) == 20
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in got:
        payloads = [flac.pad(t.encode()) for t in texts[r["doc_id"]]]
        assert r["payload_sha256"] in {hashlib.sha256(p).hexdigest() for p in payloads}
        assert r["tail_crc32"] in {zlib.crc32(p[-16:]) for p in payloads}
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 2)}) == 1
    blocks = flac.pcm_blocks(media.where("doc_id = 11"), 5000).orderBy("first_sample").collect()
    assert [b["first_sample"] for b in blocks] == [5000 * i for i in range(len(blocks))]
    assert b"".join(bytes(b["pcm"]) for b in blocks) == flac.pad(texts[11][0].encode())
    assert flac.media_digest(flac.encode_media(none)).count() == 0
