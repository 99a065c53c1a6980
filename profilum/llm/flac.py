"""FLAC media columns: lossless 8-bit mono streams, encoded and decoded with numpy over whole batches.

The encoder cuts samples into blocks of 192, codes each block by the cheapest
of a constant, verbatim, fixed-predictor or quantised linear-predictor
subframe with Rice-coded residuals, and writes STREAMINFO (with the MD5 of the
samples) and a SEEKTABLE of sample offsets.

The decoder finds frames by their sync codes and header CRC-8, checks each
frame's CRC-16 and the stream's MD5, and undoes Rice codes and predictors one
sample position at a time for all frames of a batch together.  Streams beyond
that path (several channels, wasted bits, other sample sizes, misleading sync
codes) go through a plain bit reader that follows the format in full.
Damaged streams raise ``FlacError``.

Cases: a null or empty payload is one block of padding (see ``pad``); equal
texts give equal streams; extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.llm import text as X
from profilum.sources.tables import read_table

BLOCK = 192
#: Frames between two seek points.
SEEK_FRAMES = 128
#: Order of the linear predictor that competes with the fixed ones.
LPC_ORDER = 4
LPC_PRECISION, LPC_SHIFT = 12, 10
RATE = 8000
#: Fixed values of the format: header byte of 192-sample blocks at 8 kHz, and of mono 8-bit frames.
HEADER = (0xFF, 0xF8, 0x14, 0x02)
#: Fixed values of the format: coefficients of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Fixed values of the format: samples of the block-size codes.
BLOCK_SIZES = {1: 192, **{n: 576 << (n - 2) for n in range(2, 6)}, **{n: 256 << (n - 8) for n in range(8, 16)}}


class FlacError(ValueError):
    """A stream that isn't what its checksums or its format say."""


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Remainders of all ``bits``-wide inputs."""
    x = np.arange(1 << bits, dtype=np.uint32) << (width - bits)
    for _ in range(bits):
        x = np.where(x >> (width - 1) & 1, (x << 1) ^ poly, x << 1) & ((1 << width) - 1)
    return x


CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8)
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)


def crc8(rows: np.ndarray) -> np.ndarray:
    """CRC-8 of each row; leading zero bytes don't change it."""
    crc = np.zeros(len(rows), np.uint8)
    for k in range(rows.shape[1]):
        crc = CRC8[crc ^ rows[:, k]]
    return crc


def crc16(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range, two bytes a step; ranges are aligned at their ends, where zeros before don't count."""
    crc = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return crc
    longest = int((ends - starts).max())
    for back in range(longest + longest % 2, 0, -2):
        at = ends - back
        high = np.where(at >= starts, raw[np.maximum(at, 0)], 0).astype(np.uint16)
        low = np.where(at + 1 >= starts, raw[np.maximum(at + 1, 0)], 0)
        crc = CRC16[crc ^ ((high << np.uint16(8)) | low)]
    return crc


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """Spaces appended up to a positive multiple of the block."""
    return payload + b" " * (-len(payload) % block or (0 if payload else block))


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the header's UTF-8-like code: 6 bytes each, of which the last ``size`` count."""
    size = 1 + (n >= 1 << 7) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(6):
        from_end = 5 - k
        out[:, k] = np.where(from_end < size, 0x80 | (n >> 6 * from_end) & 0x3F, 0)
    lead = 6 - size
    value = n >> 6 * (size - 1)
    out[np.arange(len(n)), lead] = np.where(size == 1, n, (0xFF00 >> size) & 0xFF | value)
    return out, size


def _lpc(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised coefficients of each row by the autocorrelation method."""
    y = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, : y.shape[1] - k], y[:, k:]) for k in range(order + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-9
    a, err = np.zeros((len(x), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= 1 - k * k
        err = np.maximum(err, 1e-9)
    top = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top - 1, top).astype(np.int32)


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of blocks (rows of signed samples): all bytes, and the offsets of the frames."""
    n, block = x.shape
    x = x.astype(np.int32)
    orders, residuals, coefs = [], [], None
    d = x
    for o in range(3):
        orders.append(o)
        residuals.append(d)
        d = np.diff(d, axis=1)
    if LPC_ORDER:
        coefs = _lpc(x, LPC_ORDER)
        acc = coefs[:, :1] * x[:, LPC_ORDER - 1 : -1]
        for j in range(1, LPC_ORDER):
            acc += coefs[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : -1 - j]
        orders.append(LPC_ORDER)
        residuals.append(x[:, LPC_ORDER:] - (acc >> LPC_SHIFT))
    best = np.full(n, 8 + 8 * block, np.int64)  # verbatim
    kind, rice = np.full(n, -1), np.zeros(n, np.int64)
    zigzag = []
    for c, (o, r) in enumerate(zip(orders, residuals)):
        zigzag.append(u := ((r << 1) ^ (r >> 31)).astype(np.uint16))
        fixed = 8 + 8 * o + 10 + (9 + LPC_PRECISION * o if c == 3 else 0)
        for k in range(1, 9):
            bits = fixed + (1 + k) * u.shape[1] + (u >> np.uint16(k)).sum(1, dtype=np.int64)
            better = bits < best
            best[better], kind[better], rice[better] = bits[better], c, k
    same = (x == x[:, :1]).all(1)
    kind[same], best[same] = -2, 16
    code, size = _number(number)
    head = 8 * (5 + size)
    length = (head + best + 7) // 8 + 2
    offsets = np.concatenate([[0], np.cumsum(length)])
    bits = np.zeros(8 * int(offsets[-1]), np.uint8)
    at = offsets[:-1] * 8

    def put(rows: np.ndarray | slice, value: np.ndarray | int, width: int) -> None:
        value = np.broadcast_to(value, at[rows].shape)
        for j in range(width):
            bits[at[rows] + j] = value >> (width - 1 - j) & 1
        at[rows] += width

    whole = slice(None)
    for b in HEADER:
        put(whole, b, 8)
    for k in range(6):
        put(np.flatnonzero(6 - size <= k), code[6 - size <= k, k], 8)
    header = np.concatenate([np.broadcast_to(np.array(HEADER, np.uint8), (n, 4)), np.zeros((n, 6), np.uint8)], 1)
    for s in range(1, 7):
        rows = np.flatnonzero(size == s)
        header[rows, :6 - s] = 0
        header[rows, 6 - s : 10 - s] = HEADER
        header[rows, 10 - s :] = code[rows, 6 - s :]
    put(whole, crc8(header).astype(np.int64), 8)
    rows = np.flatnonzero(kind == -2)
    put(rows, 0, 8)
    put(rows, x[rows, 0] & 0xFF, 8)
    rows = np.flatnonzero(kind == -1)
    put(rows, 2, 8)
    for j in range(block):
        put(rows, x[rows, j] & 0xFF, 8)
    for c, o in enumerate(orders):
        rows = np.flatnonzero(kind == c)
        if not len(rows):
            continue
        put(rows, (0x20 | o - 1) << 1 if c == 3 else (8 | o) << 1, 8)
        for j in range(o):
            put(rows, x[rows, j] & 0xFF, 8)
        if c == 3:
            put(rows, LPC_PRECISION - 1, 4)
            put(rows, LPC_SHIFT, 5)
            for j in range(o):
                put(rows, coefs[rows, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
        put(rows, 0, 6)
        put(rows, rice[rows], 4)
        for k in np.unique(rice[rows]).tolist():
            sub = rows[rice[rows] == k]
            u = zigzag[c][sub]
            spans = (u >> np.uint16(k)).astype(np.int64) + (1 + k)
            stop = at[sub][:, None] + np.cumsum(spans, 1) - (1 + k)
            bits[stop] = 1
            for j in range(k):
                bits[stop + (1 + j)] = (u >> np.uint16(k - 1 - j)).astype(np.uint8) & 1
    out = np.packbits(bits)
    check = crc16(out, offsets[:-1], offsets[1:] - 2)
    out[offsets[1:] - 2], out[offsets[1:] - 1] = check >> 8, check & 0xFF
    return out, offsets


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of the block."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    if not len(lengths):
        return []
    if (lengths % BLOCK).any() or not lengths.all():
        raise ValueError(f"payloads must be padded to positive multiples of {BLOCK}")
    blocks = lengths // BLOCK
    signed = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    frames, offsets = _frames(signed.reshape(-1, BLOCK), X.expand(np.zeros(len(blocks), np.int64), blocks))
    data, sizes, first, out = frames.tobytes(), np.diff(offsets), 0, []
    samples = signed.tobytes()
    for n, b, end in zip(lengths.tolist(), blocks.tolist(), np.cumsum(lengths).tolist()):
        own = sizes[first : first + b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(samples[end - n : end]).digest()
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[first + i] - offsets[first]), BLOCK) for i in range(0, b, SEEK_FRAMES))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + data[offsets[first] : offsets[first + b]])
        first += b
    return out


# ---------------------------------------------------------------- decoding


def metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO and seek points, and where the frames start."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info = 4, {"seek": []}
    while True:
        if at + 4 > len(stream):
            raise FlacError("metadata cut short")
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("metadata cut short")
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            info |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34], "block": struct.unpack(">H", body[2:4])[0]}
        elif kind & 0x7F == 3:
            info["seek"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + size
        if kind & 0x80:
            break
    if "bits" not in info:
        raise FlacError("no STREAMINFO")
    return info, at


class _Bits:
    """A plain reader of big-endian bit fields."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at * 8

    def get(self, n: int) -> int:
        if n == 0:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise FlacError("frame cut short")
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.get(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.get(1):
            n += 1
        return n


def _subframe(b: _Bits, n: int, bits: int) -> list[int]:
    if b.get(1):
        raise FlacError("bad subframe")
    kind, wasted = b.get(6), b.unary() + 1 if b.get(1) else 0
    bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * n
    elif kind == 1:
        out = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = b.get(4) + 1
            shift = b.signed(5)
            coefs = [b.signed(precision) for _ in range(order)]
        width = (4, 5)[m] if (m := b.get(2)) < 2 else 0
        if not width:
            raise FlacError("bad residual coding")
        parts = 1 << b.get(4)
        for p in range(parts):
            k = b.get(width)
            raw = b.get(5) if k == (1 << width) - 1 else None
            for _ in range(n // parts - (order if p == 0 else 0)):
                if raw is None:
                    u = b.unary() << k | b.get(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(raw)
                out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise FlacError("reserved subframe type")
    return [v << wasted for v in out]


def decode_plain(stream: bytes) -> tuple[dict, list[list[int]]]:
    """One stream by the plain bit reader: STREAMINFO and the samples of each channel."""
    info, at = metadata(stream)
    out: list[list[int]] = [[] for _ in range(info["channels"])]
    while at < len(stream):
        b = _Bits(stream, at)
        if b.get(15) != 0x7FFC:
            raise FlacError("lost sync")
        b.get(1)
        size, rate, channels, depth = b.get(4), b.get(4), b.get(4), b.get(3)
        b.get(1)
        lead = b.get(8)
        for _ in range(max(0, (lead ^ 0xFF).bit_length() * -1 + 8 - 1) if lead >= 0x80 else 0):
            b.get(8)
        n = b.get(8) + 1 if size == 6 else b.get(16) + 1 if size == 7 else BLOCK_SIZES.get(size, 0)
        b.get({12: 8, 13: 16, 14: 16}.get(rate, 0))
        end = b.at >> 3
        if b.get(8) != crc8(np.frombuffer(stream[at:end], np.uint8)[None])[0]:
            raise FlacError("header checksum differs")
        bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
        if channels > 10 or not n:
            raise FlacError("reserved header value")
        side = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(channels, ())
        parts = [_subframe(b, n, bits + (side[c] if side else 0)) for c in range(2 if side else channels + 1)]
        end = (b.at + 7) >> 3
        if int(crc16(np.frombuffer(stream[at:end], np.uint8), np.zeros(1, np.int64), np.full(1, end - at))[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise FlacError("frame checksum differs")
        if channels == 8:
            parts[1] = [a - d for a, d in zip(*parts)]
        elif channels == 9:
            parts[0] = [a + d for a, d in zip(*parts)]
        elif channels == 10:
            parts = [[((m << 1 | d & 1) + d) >> 1 for m, d in zip(*parts)], [((m << 1 | d & 1) - d) >> 1 for m, d in zip(*parts)]]
        for c, p in zip(out, parts):
            c += p
        at = end + 2
    return info, out


CLZ16 = np.full(1 << 16, 16, np.uint8)
for _k in range(16):
    CLZ16[1 << _k : 2 << _k] = 15 - _k


class _Windows:
    """64-bit windows of a byte array at any bit."""

    def __init__(self, raw: np.ndarray) -> None:
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.raw = raw
        self.view = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(raw) + 8,), (1,), writeable=False)
        self.keep = padded

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.view[np.minimum(pos >> 3, len(self.view) - 1)].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def get(self, pos: np.ndarray, n: int) -> np.ndarray:
        return (self.at(pos) >> np.uint64(64 - n)).astype(np.int64)

    def signed(self, pos: np.ndarray, n: int) -> np.ndarray:
        return self.at(pos).astype(np.int64) >> (64 - n)

    def unary(self, pos: int) -> int:
        """Zeros before the next one, however many."""
        byte, last = pos >> 3, len(self.raw)
        rest, n = int(self.keep[byte]) & (0xFF >> (pos & 7)), -(pos & 7)
        while not rest:
            byte, n = byte + 1, n + 8
            if byte >= last:
                raise FlacError("frame cut short")
            rest = int(self.keep[byte])
        return n + 8 - rest.bit_length()


def _rice(w: _Windows, pos: np.ndarray, width: np.ndarray, parts: int, block: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (position by frame) of frames with the same partitions and order, and where they end."""
    out = np.empty((block - order, len(pos)), np.int64)
    k = np.zeros(len(pos), np.uint64)
    raw_bits: np.ndarray | None = None
    starts = {0, *range(block // parts - order, block - order, block // parts)}
    one = np.uint64(1)
    for i in range(block - order):
        if i in starts:
            param = np.where(width == 4, w.get(pos, 4), w.get(pos, 5))
            pos = pos + width
            escape = param == (1 << width) - 1
            raw_bits = None
            if escape.any():
                raw_bits = np.where(escape, w.get(pos, 5), -1)
                pos = pos + np.where(escape, 5, 0)
            k = np.where(escape, 0, param).astype(np.uint64)
            last = np.uint64(63) - k
        window = w.at(pos)
        q = CLZ16[window >> np.uint64(48)].astype(np.uint64)
        if (q == 16).any():
            for f in np.flatnonzero(q == 16):
                if raw_bits is None or raw_bits[f] < 0:
                    q[f] = w.unary(int(pos[f]))
            far = q > 24
            value = (window << np.minimum(q + one, np.uint64(63))) >> one >> last
            if far.any():
                value[far] = w.at(pos[far] + q[far].astype(np.int64) + 1) >> one >> last[far]
        else:
            value = (window << (q + one)) >> one >> last
        u = ((q << k) | value).astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        step = (q + one + k).astype(np.int64)
        if raw_bits is not None:
            for f in np.flatnonzero(raw_bits >= 0):
                n = int(raw_bits[f])
                r[f] = w.signed(pos[f : f + 1], n)[0] if n else 0
                step[f] = n
        out[i] = r
        pos = pos + step
    return out, pos


def _decode_frames(raw: np.ndarray, starts: np.ndarray, head: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """8-bit mono frames of one block size, as rows of samples; ``head``: where subframes start, ``ends``: without CRC-16."""
    w = _Windows(raw)
    x = np.empty((block, len(starts)), np.int64)
    first = raw[head].astype(np.int64)
    if (first & 0x81).any():
        raise FlacError("wasted bits or bad subframe")
    kind = first >> 1
    finish = np.zeros(len(starts), np.int64)
    for t in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == t)
        pos = (head[rows] + 1) * 8
        if t == 0:
            x[:, rows] = w.signed(pos, 8)
            finish[rows] = pos + 8
            continue
        if t == 1:
            for i in range(block):
                x[i, rows] = w.signed(pos + 8 * i, 8)
            finish[rows] = pos + 8 * block
            continue
        if not (8 <= t <= 12 or t >= 32):
            raise FlacError("reserved subframe type")
        order = t - 8 if t < 32 else t - 31
        if order > block:
            raise FlacError("order beyond the block")
        warm = [w.signed(pos + 8 * i, 8) for i in range(order)]
        pos = pos + 8 * order
        shift = np.zeros(len(rows), np.int64)
        if t < 32:
            coefs = [np.full(len(rows), c, np.int64) for c in FIXED[order]]
        else:
            precision = w.get(pos, 4) + 1
            shift = w.signed(pos + 4, 5)
            pos = pos + 9
            coefs = []
            for _ in range(order):
                coefs.append(w.at(pos).astype(np.int64) >> (64 - precision))
                pos = pos + precision
        method, split = w.get(pos, 2), w.get(pos + 2, 4)
        pos = pos + 6
        if (method > 1).any() or (shift < 0).any():
            raise FlacError("bad residual coding")
        for s in np.unique(split).tolist():
            sub = np.flatnonzero(split == s)
            if block % (1 << s) or block >> s < order:
                raise FlacError("bad partition order")
            residual, end = _rice(w, pos[sub], np.where(method[sub] == 1, 5, 4), 1 << s, block, order)
            finish[rows[sub]] = end
            own = np.empty((block, len(sub)), np.int64)
            for i in range(order):
                own[i] = warm[i][sub]
            c, sh = [v[sub] for v in coefs], shift[sub]
            for i in range(order, block):
                if order:
                    acc = c[0] * own[i - 1]
                    for j in range(1, order):
                        acc += c[j] * own[i - 1 - j]
                    own[i] = residual[i - order] + (acc >> sh if t >= 32 else acc)
                else:
                    own[i] = residual[i]
            x[:, rows[sub]] = own
    if ((finish + 7) // 8 != ends).any():
        raise FlacError("frame does not end where the next starts")
    return x.T


def _find_frames(raw: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates for frames: start, number, header size.  raw: all frame bytes; only 8-bit mono fixed-block headers without extra fields."""
    n = len(raw)
    at = np.flatnonzero(raw[:-1] == 0xFF) if n > 1 else np.zeros(0, np.int64)
    at = at[at + 16 < n + 12]
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    at = at[(padded[at + 1] == 0xF8) & (padded[at + 3] & 0xF1 == 0) & (padded[at + 3] & 0x0E == 0x02)]
    lead = padded[at + 4].astype(np.int64)
    size = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 0, 2, 3, 4, 5, 6], 0)
    at, size, lead = at[size > 0], size[size > 0], lead[size > 0]
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    ok = np.ones(len(at), bool)
    for k in range(1, 6):
        more = size > k
        byte = padded[at + 4 + np.minimum(k, 5)].astype(np.int64)
        number = np.where(more, number << 6 | byte & 0x3F, number)
        ok &= ~more | (byte & 0xC0 == 0x80)
    crc = np.zeros(len(at), np.uint8)
    for k in range(10):
        crc = np.where(k < 4 + size, CRC8[crc ^ padded[at + k]], crc)
    ok &= crc == padded[at + 4 + size]
    return at[ok], number[ok], size[ok] + 5


def decode(streams: list[bytes]) -> list[bytes]:
    """Samples of 8-bit mono streams as signed bytes; every checksum is verified."""
    out: list[bytes | None] = [None] * len(streams)
    parsed = [metadata(s) for s in streams]
    plain = [i for i, (info, _) in enumerate(parsed) if info["channels"] != 1 or info["bits"] != 8]
    groups: dict[int, list[int]] = {}
    for i, (info, _) in enumerate(parsed):
        if i not in set(plain):
            groups.setdefault(info["block"], []).append(i)
    for block, own in groups.items():
        if block not in BLOCK_SIZES.values():
            plain += own
            continue
        bounds = np.concatenate([[0], np.cumsum([len(streams[i]) - parsed[i][1] for i in own])]).astype(np.int64)
        raw = np.frombuffer(b"".join(streams[i][parsed[i][1] :] for i in own), np.uint8)
        starts, number, size = _find_frames(raw, bounds)
        blocks = np.array([-(-parsed[i][0]["samples"] // block) for i in own])
        ragged = np.array([parsed[i][0]["samples"] % block != 0 for i in own])
        who = np.searchsorted(bounds, starts, "right") - 1
        kept = np.ones(len(starts), bool)
        counts = np.bincount(who, minlength=len(own))
        first = np.cumsum(counts) - counts
        bad = ragged.copy()
        odd = np.zeros(len(own), bool)
        odd[who[number != np.arange(len(starts)) - first[who]]] = True
        for g in np.flatnonzero(odd | (counts != blocks)):
            expected = 0
            for c in range(first[g], first[g] + counts[g]):
                kept[c] = number[c] == expected
                expected += int(kept[c])
            bad[g] |= expected != blocks[g]
        starts, size, who = starts[kept], size[kept], who[kept]
        use = ~bad[who]
        ends = np.append(starts[1:], len(raw))
        lastof = np.append(who[1:] != who[:-1], True) if len(who) else np.zeros(0, bool)
        ends = np.where(lastof, bounds[who + 1], ends)
        starts, size, who, ends = starts[use], size[use], who[use], ends[use]
        said = (raw[ends - 2].astype(np.int64) << 8) | raw[ends - 1]
        wrong = crc16(raw, starts, ends - 2) != said
        bad[who[wrong]] = True
        use = ~bad[who]
        starts, size, who, ends = starts[use], size[use], who[use], ends[use]
        try:
            x = _decode_frames(raw, starts, starts + size, ends - 2, block).astype(np.int8)
            frames = np.bincount(who, minlength=len(own))
            at = np.cumsum(frames) - frames
            for g, i in enumerate(own):
                if not bad[g]:
                    out[i] = x[at[g] : at[g] + frames[g]].tobytes()
        except FlacError:
            bad[:] = True
        plain += [own[g] for g in np.flatnonzero(bad)]
    for i in plain:
        info, channels = decode_plain(streams[i])
        if len(channels) != 1 or info["bits"] != 8:
            raise FlacError("not an 8-bit mono stream; use decode_plain")
        out[i] = np.array(channels[0], np.int8).tobytes()
    for (info, _), samples in zip(parsed, out):
        if len(samples) != info["samples"] or info["md5"] != bytes(16) and hashlib.md5(samples).digest() != info["md5"]:
            raise FlacError("decoded samples differ from the stream's MD5 or length")
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """``count`` samples from ``start``, reading only frames from the seek point before it."""
    info, at = metadata(stream)
    point = max((p for p in info["seek"] if p[0] <= start), default=(0, 0, 0))
    raw = np.frombuffer(stream[at:], np.uint8)[point[1] :]
    later = min((p[1] for p in info["seek"] if p[0] >= start + count), default=len(stream) - at)
    raw = raw[: later - point[1]]
    block = info["block"]
    starts, number, size = _find_frames(raw, np.array([0, len(raw)]))
    expected, keep = point[0] // block, []
    for i, n in enumerate(number.tolist()):
        if n == expected:
            keep.append(i)
            expected += 1
    starts, size = starts[keep], size[keep]
    ends = np.append(starts[1:], len(raw))
    if (crc16(raw, starts, ends - 2) != ((raw[ends - 2].astype(np.int64) << 8) | raw[ends - 1])).any():
        raise FlacError("frame checksum differs")
    samples = _decode_frames(raw, starts, starts + size, ends - 2, block).astype(np.int8).reshape(-1)
    return samples[start - point[0] : start - point[0] + count].tobytes()


# ---------------------------------------------------------------- operators


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: doc_id, n_bytes (of the text), media (its padded UTF-8 bytes as a FLAC stream)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches):
            raw, offsets = X.utf8(batch.column(1))
            data = raw.tobytes()
            media = encode([pad(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def features(samples: list[bytes]) -> list[str]:
    """Length, range, energy, zero crossings and total variation of signed samples."""
    out = []
    for s in samples:
        x = np.frombuffer(s, np.int8).astype(np.int32)
        d = np.diff(x)
        out.append(f"n={len(x)};min={x.min()};max={x.max()};energy={int((x * x).sum(dtype=np.int64))};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};variation={int(np.abs(d).sum())}")
    return out


def pcm_blocks(media: DataFrame, block_samples: int = BLOCK * SEEK_FRAMES) -> DataFrame:
    """Decoded samples in blocks that start at known offsets: doc_id, first_sample, n_samples, pcm (unsigned 8-bit)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "media"):
            rows: list[tuple] = []
            for doc, samples in zip(batch.column(0).to_pylist(), decode([b or b"" for b in batch.column(1).to_pylist()])):
                pcm = (np.frombuffer(samples, np.uint8) ^ 0x80).tobytes()
                rows += [(doc, i, len(pcm[i : i + block_samples]), pcm[i : i + block_samples]) for i in range(0, len(pcm), block_samples)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "first_sample", "n_samples", "pcm"])

    return media.where("media IS NOT NULL").select("doc_id", "media").mapInArrow(blocks, "doc_id bigint, first_sample bigint, n_samples int, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Per stored stream: sizes and checksums of what decoding gives back, and its features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "media"):
            stored = batch.column(2).to_pylist()
            samples = decode(stored)
            payload = [(np.frombuffer(s, np.uint8) ^ 0x80).tobytes() for s in samples]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in payload], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                    pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                    pa.array(features(samples)),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a FLAC stream, read back."""
    return media_digest(encode_media(read_table(spark, f"{sf_dir}/documents.parquet")))
