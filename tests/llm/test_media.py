"""FLAC against a plain reader and writer, bit by bit; damaged streams; seeking."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealgrove.llm import flac, media


class Reader:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n, signed=False):
        v = int(self.bits[self.at : self.at + n] or "0", 2)
        self.at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def unary(self):
        n = self.bits.index("1", self.at) - self.at
        self.at += n + 1
        return n


def crc(data, poly, bits):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & ((1 << bits) - 1) if c >> (bits - 1) else c << 1
    return c


def read_plainly(s):
    """Samples of a mono 8-bit stream whose frames have 16-bit sizes, as the encoder writes them."""
    assert s[:4] == b"fLaC"
    at, last, samples = 4, 0, 0
    while not last:
        last, kind, size = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        if kind == 0:
            samples, md5 = int.from_bytes(s[at + 14 : at + 22], "big") & (1 << 36) - 1, s[at + 22 : at + 38]
        at += 4 + size
    out = []
    while len(out) < samples:
        r = Reader(s[at:])
        assert r.take(14) == 0x3FFE and r.take(18) == 0x7002 | 0 << 16
        lead = r.take(8)
        for _ in range(0 if lead < 0x80 else f"{lead:08b}".index("0") - 1):
            r.take(8)
        n = r.take(16) + 1
        assert crc(s[at : at + r.at // 8], 7, 8) == r.take(8)
        assert r.take(1) == 0
        kind, _ = r.take(6), r.take(1)
        if kind == 0:
            own = [r.take(8, True)] * n
        elif kind == 1:
            own = [r.take(8, True) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            own = [r.take(8, True) for _ in range(order)]
            coef, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
            if kind >= 32:
                precision, shift = r.take(4) + 1, r.take(5)
                coef = [r.take(precision, True) for _ in range(order)]
            wide, parts = r.take(2), 1 << r.take(4)
            for p in range(parts):
                k = r.take(4 + wide)
                for _ in range(n // parts - (order if p == 0 else 0)):
                    u = r.unary() << k | r.take(k)
                    own.append((u >> 1 ^ -(u & 1)) + (sum(c * own[-1 - j] for j, c in enumerate(coef)) >> shift))
        r.at = -(-r.at // 8) * 8
        assert crc(s[at : at + r.at // 8], 0x8005, 16) == r.take(16)
        at += r.at // 8
        out += own
    assert at == len(s) and hashlib.md5(np.array(out, dtype=np.int8).tobytes()).digest() == md5
    return out


def payloads():
    rng = np.random.default_rng(2)
    texts = [b"the cat sat on the mat, again and again. " * 60, bytes(64), bytes(range(256)) * 9, rng.bytes(2048), "né à l'été ".encode() * 200, b"x" * 1025]
    return [t + bytes(-len(t) % 64) for t in texts]


def test_streams_read_plainly():
    for p, s in zip(payloads(), flac.encode_streams(payloads()), strict=True):
        assert [x + 128 for x in read_plainly(s)] == list(p)


def written_plainly(channels, bps, layout, wasted=0, block=192):
    """A stream of verbatim subframes; channels are given as they are to be stored."""
    n = len(channels[0])
    frames = b""
    for number, first in enumerate(range(0, n, block)):
        m = min(block, n - first)
        head = bytes([0xFF, 0xF8, 0x70, layout << 4, number]) + struct.pack(">H", m - 1)
        head += bytes([crc(head, 7, 8)])
        bits = ""
        for c, x in enumerate(channels):
            width = bps + (layout in (8, 10) and c == 1 or layout == 9 and c == 0) - wasted
            bits += "0000001" + ("1" + "0" * (wasted - 1) + "1" if wasted else "0")
            bits += "".join(f"{(int(v) >> wasted) & (1 << width) - 1:0{width}b}" for v in x[first : first + m])
        body = head + int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
        frames += body + crc(body, 0x8005, 16).to_bytes(2, "big")
    count = {8: 2, 9: 2, 10: 2}.get(layout, layout + 1)
    info = struct.pack(">HH", block, block) + bytes(6) + (8000 << 44 | (count - 1) << 41 | (bps - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + frames


@pytest.mark.parametrize("layout", [1, 8, 9, 10])
def test_two_channels(layout):
    rng = np.random.default_rng(layout)
    left, right = rng.integers(-9000, 9000, 500), rng.integers(-9000, 9000, 500)
    stored = {1: (left, right), 8: (left, left - right), 9: (left - right, right), 10: (left + right >> 1, left - right)}[layout]
    x, blocks, bps = flac.decode_streams([written_plainly(stored, 16, layout)])[0]
    assert bps == 16 and (x == np.stack([left, right], axis=1)).all() and [b[2] for b in blocks] == [192, 192, 116]


def test_wasted_bits_and_many_channels():
    rng = np.random.default_rng(7)
    x = rng.integers(-100, 100, 300) * 8
    assert (flac.decode_streams([written_plainly([x], 16, 0, wasted=3)])[0][0] == x).all()
    many = rng.integers(-(1 << 23), 1 << 23, (5, 200))
    assert (flac.decode_streams([written_plainly(list(many), 24, 4)])[0][0] == many.T).all()


def test_ranges_are_read_by_their_frames():
    p = b"".join(bytes([97 + i * i % 26]) for i in range(64 * 200))
    s = flac.encode_streams([p])[0]
    for first, n in [(0, 1), (1000, 100), (5000, 5000), (len(p) - 1, 1), (77, 0), (0, len(p))]:
        assert (flac.decode_range(s, first, n) + 128).astype(np.uint8).tobytes() == p[first : first + n]
    with pytest.raises(ValueError):
        flac.decode_range(s, len(p), 1)


def test_blocks_and_damaged_columns(spark):
    good = flac.encode_streams([b"abc " * 700])[0]
    forged = bytearray(good)
    forged[8 + 13 : 8 + 18] = bytes([forged[8 + 13] | 0x0F, 255, 255, 255, 255])  # claims 2 ** 36 samples
    table = good.index(b"\x83") + 1
    uneven = good[:table] + (int.from_bytes(good[table : table + 3], "big") - 1).to_bytes(3, "big") + good[table + 3 :]
    rows = [(1, good), (2, None), (3, bytes(forged)), (4, uneven), (5, b"fLaC"), (6, b""), (7, good[:200]), (8, b"RIFF" * 20), (9, good[:-1])]
    df = spark.createDataFrame(rows, "id long, media binary").withColumns({"pcm": F.lit("own"), "_row": F.lit("x"), "block_no": F.lit("y")})
    out = media.decode_media(df)
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["pcm"] == b"abc " * 700 and got[1]["media_error"] is None
    assert got[2]["pcm"] is None and got[2]["media_error"] is None
    assert all(got[i]["pcm"] is None and got[i]["media_error"] for i in range(3, 10))
    blocks = media.pcm_blocks(out).orderBy("id", "block_no").collect()
    assert [(r["id"], r["_row"], r["block_no"], r["sample_offset"], r["n_samples"]) for r in blocks] == [(1, "x", i, 1024 * i, min(1024, 2800 - 1024 * i)) for i in range(3)]
    assert b"".join(r["pcm"] for r in blocks) == b"abc " * 700
    encoded = media.encode_media(spark.createDataFrame([(1, b"ab" * 40), (2, None), (3, b"")], "id long, payload binary"))
    assert {r["id"]: r["media"] is None for r in encoded.collect()} == {1: False, 2: True, 3: True}
