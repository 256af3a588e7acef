"""FLAC coding of many streams at once: frames are numpy rows that are coded in step.

Encoding, of mono samples, chooses for each frame the fixed predictor or the 4-tap linear predictor of least Rice cost, or verbatim or
constant samples. Decoding reads Rice residuals, fixed and linear predictors of any order, partitions, escaped partitions, constant and
verbatim subframes of 4 to 24 bits, wasted bits, and up to 8 channels, two of them also as left/side, right/side or mid/side; it verifies
each frame header's CRC-8, each frame's CRC-16 and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 1024
RATE = 8000
ORDER, PRECISION = 4, 10
#: Fixed values of the format: the fixed predictors as linear ones.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MAX_ORDER = 32
#: Samples coded in step, for a bound on memory.
CHUNK = 1 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each run of bytes, all runs in step."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    c = np.zeros(len(at), dtype=np.int64)
    shift, mask = bits - 8, (1 << bits) - 1
    active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    for i, m in enumerate(active):
        c[:m] = (c[:m] << 8 & mask) ^ table[(c[:m] >> shift) ^ buf[at[:m] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _utf8_number(n: int) -> bytes:
    """The format's variable-length frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 6
    while n >> lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead -= 1
    return bytes([(0xFF << (lead + 1) & 0xFF) | n, *reversed(tail)])


def _residual(x: np.ndarray, coef: tuple[int, ...]) -> np.ndarray:
    r = x.copy()
    for j, c in enumerate(coef):
        r[:, j + 1 :] -= c * x[:, : -j - 1]
    return r


def _linear(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised 4-tap predictors from the frames' autocorrelations, and their shifts."""
    f = x.astype(np.float64)
    lag = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    r = lag[:, np.abs(np.arange(ORDER)[:, None] - np.arange(ORDER)[None, :])] + (np.eye(ORDER) * (1e-9 * lag[:, :1, None] + 1e-3))
    coef = np.linalg.solve(r, lag[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(coef).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(top)).astype(np.int64), 0, 15)
    lim = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(coef * (1 << shift)[:, None]), -lim, lim).astype(np.int32), shift


def _frames(x: np.ndarray, n: np.ndarray, number: list[int]) -> list[bytes]:
    """Frames of 8-bit samples; x is a row for each, zero beyond its n."""
    count, width = x.shape
    col = np.arange(width)
    valid = col[None, :] < n[:, None]
    best, residual = np.full(count, np.iinfo(np.int64).max), np.zeros_like(x)
    kind, order, rice = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    coef, shift = _linear(x, n)

    def consider(r: np.ndarray, o: int, k_kind: int, extra: int) -> None:
        u = np.where(valid & (col >= o), (r << 1) ^ (r >> 31), 0)
        total = u.sum(axis=1, dtype=np.int64)
        k = np.clip(np.floor(np.log2(np.maximum(total * 0.7 / np.maximum(n - o, 1), 1))).astype(np.int64), 0, 14)
        bits = (u >> k[:, None]).sum(axis=1, dtype=np.int64) + (n - o) * (k + 1) + 8 * o + 10 + extra
        win = bits < best
        best[win], kind[win], order[win], rice[win] = bits[win], k_kind, o, k[win]
        residual[win] = u[win]

    for o, c in enumerate(FIXED):
        consider(_residual(x, c), o, 8 + o, 0)
    guess = np.zeros(x.shape, dtype=np.int32)
    for j in range(ORDER):
        guess[:, j + 1 :] += coef[:, j : j + 1] * x[:, : -j - 1]
    consider(x - (guess >> shift[:, None].astype(np.int32)), ORDER, 32 + ORDER - 1, 9 + ORDER * PRECISION)
    verbatim = best >= 8 * n
    kind[verbatim], order[verbatim], best[verbatim] = 1, 0, 8 * n[verbatim]
    same = (np.where(valid, x, x[:, :1]) == x[:, :1]).all(axis=1)
    kind[same], order[same], best[same] = 0, 0, 8

    heads = []
    for i in range(count):
        heads.append(b"\xff\xf8\x70\x02" + _utf8_number(number[i]) + struct.pack(">H", n[i] - 1))
    head_len = np.array([len(h) for h in heads])
    size = head_len + 2 + (best + 7) // 8  # header, its CRC, the subframe's type
    start = np.concatenate([[0], np.cumsum(size + 2)])
    bits = np.zeros(8 * int(start[-1]), dtype=np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
        """Writes values of `width` bits, most significant first, at bit positions."""
        width = np.broadcast_to(width, at.shape)
        for b in range(int(width.max(initial=0))):
            m = width > b
            bits[at[m] + b] = value[m] >> (width[m] - 1 - b) & 1

    body = 8 * (start[:-1] + head_len + 1)
    put(body, kind << 1, 8)
    body = body + 8
    put(body[same], x[same, 0].astype(np.int64) & 255, 8)
    raw = np.flatnonzero((kind == 1) & ~same)
    if len(raw):
        r, c = np.nonzero(valid[raw])
        put(body[raw][r] + 8 * c, x[raw][r, c].astype(np.int64) & 255, 8)
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        o, k = order[coded], rice[coded]
        for j in range(ORDER):
            m = o > j
            put(body[coded][m] + 8 * j, x[coded[m], j].astype(np.int64) & 255, 8)
        at = body[coded] + 8 * o
        lpc = kind[coded] >= 32
        if lpc.any():
            put(at[lpc], np.full(int(lpc.sum()), PRECISION - 1), 4)
            put(at[lpc] + 4, shift[coded][lpc], 5)
            for j in range(ORDER):
                put(at[lpc] + 9 + j * PRECISION, coef[coded][lpc, j].astype(np.int64) & ((1 << PRECISION) - 1), PRECISION)
            at = at + np.where(lpc, 9 + ORDER * PRECISION, 0)
        put(at + 6, k, 4)  # Rice coding with 4-bit parameters, one partition
        at = at + 10
        own = valid[coded] & (col >= o[:, None])
        u = residual[coded].astype(np.int64)
        high = u >> k[:, None]
        length = np.where(own, high + 1 + k[:, None], 0)
        ends = np.cumsum(length, axis=1)
        ones = at[:, None] + ends - 1 - k[:, None]
        bits[ones[own]] = 1
        for b in range(int(k.max(initial=0))):
            m = k > b
            sel = own[m]
            bits[(ones[m] + 1 + b)[sel]] = (u[m] >> (k[m] - 1 - b)[:, None] & 1)[sel]
    out = np.packbits(bits)
    for i, h in enumerate(heads):
        out[start[i] : start[i] + len(h)] = np.frombuffer(h, dtype=np.uint8)
    out[start[:-1] + head_len] = crcs(out, start[:-1], head_len, CRC8, 8)
    tail = crcs(out, start[:-1], size, CRC16, 16)
    out[start[:-1] + size], out[start[:-1] + size + 1] = tail >> 8, tail & 255
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of 8-bit mono samples, byte b being sample b - 128, for each payload that isn't empty."""
    out: list[bytes] = []
    at = 0
    while at < len(payloads):
        end, total = at, 0
        while end < len(payloads) and (end == at or total + len(payloads[end]) <= CHUNK):
            total += len(payloads[end])
            end += 1
        out += _encode_chunk(payloads[at:end])
        at = end
    return out


def _encode_chunk(payloads: list[bytes]) -> list[bytes]:
    pieces = [(p, i) for p in range(len(payloads)) for i in range(-(-len(payloads[p]) // BLOCK))]
    frames: list[bytes] = []
    for first in range(0, len(pieces), CHUNK // BLOCK):
        part = pieces[first : first + CHUNK // BLOCK]
        n = np.array([min(BLOCK, len(payloads[p]) - i * BLOCK) for p, i in part])
        x = np.zeros((len(part), BLOCK), dtype=np.int32)
        for row, ((p, i), m) in enumerate(zip(part, n, strict=True)):
            x[row, :m] = np.frombuffer(payloads[p], dtype=np.uint8, count=m, offset=i * BLOCK).astype(np.int32) - 128
        order = np.argsort(-n, kind="stable")  # frames of like size side by side: short ones aren't widened to a whole block
        coded: list[bytes] = [b""] * len(part)
        for group in np.split(order, np.flatnonzero(np.diff(-(-n[order] // 256))) + 1):
            width = -(-int(n[group].max()) // 256) * 256
            for i, f in zip(group.tolist(), _frames(np.ascontiguousarray(x[group, :width]), n[group], [part[g][1] for g in group.tolist()]), strict=True):
                coded[i] = f
        frames += coded
    out, k = [], 0
    for payload in payloads:
        count = -(-len(payload) // BLOCK)
        own = frames[k : k + count]
        k += count
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, offset = [], 0
        for i, s in enumerate(sizes):
            points.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(payload) - i * BLOCK)))
            offset += s
        table = b"".join(points)
        if len(table) < 1 << 24:
            head = b"\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table
        else:  # the block's size has 24 bits; such a stream is read frame after frame
            head = b"\x80\x00\x00\x22" + info
        out.append(b"fLaC" + head + b"".join(own))
    return out


class Damaged(ValueError):
    """A stream that isn't FLAC of the kinds read here, or whose checksums don't agree."""


def _metadata(s: bytes) -> dict:
    if s[:4] != b"fLaC":
        raise Damaged("no FLAC stream")
    at, out, last = 4, {"points": []}, False
    while not last:
        if at + 4 > len(s):
            raise Damaged("the metadata runs beyond the stream's end")
        last, kind, size = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        body = s[at + 4 : at + 4 + size]
        if len(body) < size:
            raise Damaged("the metadata runs beyond the stream's end")
        if kind == 0:
            if size < 34:
                raise Damaged("the stream's information is too short")
            packed = int.from_bytes(body[10:18], "big")
            out |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            if size % 18:
                raise Damaged("a seek table isn't made of whole points")
            out["points"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
        at += 4 + size
    if "bps" not in out:
        raise Damaged("the stream has no information")
    if not 4 <= out["bps"] <= 24:
        raise Damaged("only samples of 4 to 24 bits are read")
    return out | {"start": at}


class _Bits:
    """Reads bits at many places of a buffer in step."""

    def __init__(self, buf: bytes):
        self.raw = np.frombuffer(buf + b"\x00" * 16, dtype=np.uint8)
        self.words = np.ndarray((len(buf) + 8,), dtype=">u8", buffer=self.raw.data, strides=(1,)).astype(np.uint64)

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each bit position on, in the high bits."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: np.ndarray | int, signed: bool = False) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, dtype=np.int64), at.shape)
        v = (self.window(at) >> np.uint64(1) >> (63 - width).astype(np.uint64)).astype(np.int64)
        return v - (np.where(width > 0, v >> np.maximum(width - 1, 0) & 1, 0) << width) if signed else v


def _leading_zeros(w: np.ndarray) -> np.ndarray:
    """Of the 53 high bits: 53 if all are zero."""
    top = (w >> np.uint64(11)).astype(np.float64)
    return np.where(top > 0, 52 - ((top.view(np.int64) >> 52) - 1023), 53)


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [step, frame] of one channel's subframes, which begin at bit positions, and where they end. Frames come in order of falling sizes."""
    raw = bits.raw
    kind = bits.read(pos, 8)
    wasted = kind & 1
    kind = kind >> 1 & 63
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise Damaged("a subframe of a kind that isn't read")
    pos = pos + 8
    if wasted.any():  # low bits that are all zero are left out, their number is written in unary
        zeros = _leading_zeros(bits.window(pos))
        pos, wasted = np.where(wasted > 0, pos + zeros + 1, pos), np.where(wasted > 0, zeros + 1, 0)
        bps = bps - wasted
        if (bps < 1).any():
            raise Damaged("a subframe has no bits left")
    taps = np.select([kind == 0, kind == 1, kind < 32], [1, 0, kind - 8], kind - 31)
    most, count = int(taps.max(initial=0)), len(n)
    x = np.zeros((int(n.max(initial=0)), count), dtype=np.int64)
    for t in range(most):
        m = taps > t
        x[t, m] = bits.read(pos[m], bps[m], signed=True)
        pos[m] += bps[m]
    coef, shift = np.zeros((most, count), dtype=np.int64), np.zeros(count, dtype=np.int64)
    for o, c in enumerate(FIXED):
        for j, v in enumerate(c[:most]):
            coef[j, (kind == 8 + o) | ((kind == 0) & (o == 1))] = v
    lpc = kind >= 32
    if lpc.any():
        precision = np.where(lpc, bits.read(pos, 4) + 1, 0)
        shift = np.where(lpc, bits.read(pos + 4, 5), 0)
        pos = pos + np.where(lpc, 9, 0)
        for j in range(most):
            m = lpc & (taps > j)
            coef[j, m] = bits.read(pos[m], precision[m], signed=True)
            pos[m] += precision[m]
    coded = kind >= 8
    wide = np.where(coded, bits.read(pos, 2), 0)
    if (wide > 1).any():
        raise Damaged("a residual of a kind that isn't read")
    depth = np.where(coded, bits.read(pos + 2, 4), 0)
    pos = pos + np.where(coded, 6, 0)
    length = n >> depth
    rice, plain = np.zeros(count, dtype=np.int64), ~coded  # plain: residuals of `rice` bits as they are
    rice[kind == 1] = bps[kind == 1]
    starts: dict[int, list[int]] = {}
    for f in np.flatnonzero(coded):
        for p in range(1 << int(depth[f])):
            starts.setdefault(int(max(p * length[f], taps[f])) if p == 0 else int(p * length[f]), []).append(int(f))
    active = np.searchsorted(-n, -np.arange(len(x)), side="left")
    for t in range(len(x)):
        m = int(active[t])
        if t in starts:
            f = np.array(starts[t])
            p_bits = 4 + wide[f]
            rice[f] = bits.read(pos[f], p_bits)
            pos[f] += p_bits
            plain[f] = rice[f] == (1 << p_bits) - 1
            e = f[plain[f]]
            rice[e] = bits.read(pos[e], 5)
            pos[e] += 5
        at, k = pos[:m], rice[:m]
        w = bits.window(at)
        q = _leading_zeros(w)
        if t < most or plain[:m].any() or (q + k > 52).any():
            go = taps[:m] <= t
            esc = plain[:m]
            long = go & ~esc & (q == 53)
            while long.any():  # runs of zeros beyond the window
                at_l = np.flatnonzero(long)
                more = _leading_zeros(bits.window(at[at_l] + q[at_l]))
                q[at_l] += more
                long[at_l] = more == 53
                if (at[at_l] + q[at_l] > 8 * len(raw)).any():
                    raise Damaged("a residual runs beyond the stream's end")
            q = np.where(esc, 0, q)
            low = bits.read(at + q + ~esc, k)
            u = q << k | low
            r = np.where(esc, low - (np.where(k > 0, low >> np.maximum(k - 1, 0) & 1, 0) << k), u >> 1 ^ -(u & 1))
            guess = np.zeros(m, dtype=np.int64)
            for j in range(min(most, t)):
                guess += coef[j, :m] * x[t - 1 - j, :m]
            x[t, :m] = np.where(go, r + (guess >> shift[:m]), x[t, :m])
            pos[:m] += np.where(go, q + ~esc + k, 0)
        else:
            low = w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)
            u = q << k | low.astype(np.int64)
            r = u >> 1 ^ -(u & 1)
            if most:
                guess = coef[0, :m] * x[t - 1, :m]
                for j in range(1, most):
                    guess += coef[j, :m] * x[t - 1 - j, :m]
                r += guess >> shift[:m]
            x[t, :m] = r
            pos[:m] += q + 1 + k
    return x << wasted[None, :], pos


def _decode_frames(bits: _Bits, start: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples [channel, step, frame], frame sizes in samples, channels and ends in bytes; headers and frames whose checksums don't agree raise."""
    raw = bits.raw
    if len(start) and int(start.max()) + 16 > len(raw):
        raise Damaged("a frame begins beyond the stream's end")
    ok = (raw[start] == 0xFF) & (raw[start + 1] & 0xFE == 0xF8)
    lead = raw[start + 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = start + 4 + number
    code, rate = raw[start + 2] >> 4, raw[start + 2] & 15
    at_limit = np.minimum(at, len(raw) - 3)
    n = np.select(
        [code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8],
        [192, 576 << np.clip(code.astype(np.int64) - 2, 0, 3), raw[at_limit] + 1, (raw[at_limit].astype(np.int64) << 8 | raw[at_limit + 1]) + 1, 256 << np.clip(code.astype(np.int64) - 8, 0, 7)], 0,
    )
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, rate == 13, rate == 14], [1, 2, 2], 0)
    ok &= n > 0
    ok &= crcs(raw, start, at - start, CRC8, 8) == raw[np.minimum(at, len(raw) - 1)]
    if not ok.all():
        raise Damaged("a frame header's checksum is wrong")
    layout = raw[start + 3].astype(np.int64) >> 4
    if (layout > 10).any():
        raise Damaged("channels of a kind that isn't read")
    order = np.argsort(-n, kind="stable")
    n, pos, bps, layout = n[order], 8 * (at[order] + 1), bps[order], layout[order]
    channels = np.where(layout < 8, layout + 1, 2)
    x = np.zeros((int(channels.max(initial=1)), int(n.max(initial=0)), len(n)), dtype=np.int64)
    for c in range(len(x)):
        own = np.flatnonzero(channels > c)
        side = ((layout[own] == 8) | (layout[own] == 10)) & (c == 1) | (layout[own] == 9) & (c == 0)  # a difference takes a bit more
        got, pos[own] = _subframes(bits, pos[own], n[own], bps[own] + side)
        x[c][: len(got), own] = got
    if len(x) > 1:
        left, right = x[0], x[1]
        for f in np.flatnonzero(layout >= 8):
            if layout[f] == 8:
                right[:, f] = left[:, f] - right[:, f]
            elif layout[f] == 9:
                left[:, f] += right[:, f]
            else:
                mid = left[:, f] << 1 | right[:, f] & 1
                left[:, f], right[:, f] = mid + right[:, f] >> 1, mid - right[:, f] >> 1
    end = (pos + 7) >> 3
    if (end + 2 > len(raw) - 16).any() and len(end) and int(end.max()) + 2 > len(raw) - 16:
        raise Damaged("a frame ends beyond the stream")
    got = crcs(raw, start[order], end - start[order], CRC16, 16)
    if (got != (raw[end].astype(np.int64) << 8 | raw[end + 1])).any():
        raise Damaged("a frame's checksum is wrong")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return x[:, :, back], n[back], channels[back], end[back] + 2


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int]], int]]:
    """Of each stream: its samples [sample] or [sample, channel], its blocks as (sample offset, byte offset, samples), and its bits a sample.

    Damaged streams raise.
    """
    out: list = []
    at = 0
    while at < len(streams):
        end, total = at, 0
        while end < len(streams) and (end == at or total + len(streams[end]) <= CHUNK):
            total += len(streams[end])
            end += 1
        out += _decode_chunk(streams[at:end])
        at = end
    return out


def _indexed(head: dict, size: int) -> bool:
    """Whether the seek table lists every frame, so that all can be decoded in step; its points must then come in order of samples and of bytes."""
    points, at, byte = head["points"], 0, -1
    if not points or sum(p[2] for p in points) != head["samples"]:
        return False
    for first, offset, n in points:
        if first != at or offset <= byte or not n or offset >= size:
            raise Damaged("the seek table is wrong")
        at, byte = first + n, offset
    return True


def _decode_chunk(streams: list[bytes]) -> list:
    heads = [_metadata(s) for s in streams]
    base = np.cumsum([0, *(len(s) for s in streams)])
    bits = _Bits(b"".join(streams))
    found: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in heads]  # what frames hold; nothing is reserved for what a header claims
    indexed = [_indexed(h, len(s)) for h, s in zip(heads, streams, strict=True)]
    jobs = [(i, p[0], int(base[i]) + h["start"] + p[1]) for i, h in enumerate(heads) if indexed[i] for p in h["points"]]
    follow = [(i, 0, int(base[i]) + h["start"]) for i, h in enumerate(heads) if not indexed[i] and h["samples"]]
    while jobs or follow:
        batch, jobs = [*jobs[: CHUNK // BLOCK], *follow], jobs[CHUNK // BLOCK :]
        follow = []
        x, n, channels, ends = _decode_frames(bits, np.array([b for _, _, b in batch]), np.array([heads[i]["bps"] for i, _, _ in batch]))
        rows = np.ascontiguousarray(x.transpose(2, 1, 0)).astype(np.int32)
        for row, ((i, first, b), m, c, e) in enumerate(zip(batch, n.tolist(), channels.tolist(), ends.tolist(), strict=True)):
            if first + m > heads[i]["samples"] or e > base[i + 1]:
                raise Damaged("more samples than the stream has")
            if c != heads[i]["channels"]:
                raise Damaged("a frame has other channels than the stream")
            found[i].append((first, b - int(base[i]), rows[row, :m, :c].copy()))
            if not indexed[i] and first + m < heads[i]["samples"]:
                follow.append((i, first + m, e))
    out = []
    for h, own in zip(heads, found, strict=True):
        own.sort(key=lambda f: f[0])
        if sum(len(f[2]) for f in own) != h["samples"]:
            raise Damaged("frames and samples don't agree")
        x = np.concatenate([f[2] for f in own]) if own else np.zeros((0, h["channels"]), dtype=np.int32)
        raw = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : (h["bps"] + 7) // 8].tobytes()
        if any(h["md5"]) and hashlib.md5(raw).digest() != h["md5"]:
            raise Damaged("the stream's MD5 is wrong")
        out.append((x[:, 0] if h["channels"] == 1 else x, [(first, byte, len(y)) for first, byte, y in own], h["bps"]))
    return out


def decode_range(stream: bytes, first: int, n: int) -> np.ndarray:
    """Samples [first, first + n) of a stream with a seek table of all frames: only the frames that hold them are decoded."""
    head = _metadata(stream)
    if not _indexed(head, len(stream)):
        raise Damaged("the seek table doesn't list all frames")
    if not 0 <= first <= first + n <= head["samples"]:
        raise ValueError("samples beyond the stream")
    own = [p for p in head["points"] if p[0] < first + n and p[0] + p[2] > first]
    if not own:
        return np.zeros(0, dtype=np.int32)
    begin, end = head["start"] + own[0][1], min([len(stream), *(head["start"] + p[1] for p in head["points"] if p[0] >= first + n)])
    x, sizes, channels, _ = _decode_frames(_Bits(stream[begin:end]), np.array([p[1] - own[0][1] for p in own]), np.full(len(own), head["bps"]))
    whole = np.concatenate([x[: channels[i], : sizes[i], i].T for i in range(len(own))]).astype(np.int32)[first - own[0][0] :][:n]
    return whole[:, 0] if head["channels"] == 1 else whole
