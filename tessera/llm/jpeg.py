"""Baseline JPEG in numpy: a writer that keeps payload bytes as quantised coefficients, and a reader of scans.

The writer makes grey images of 9 blocks (72 pixels) a row; every byte of the payload is one coefficient in scan order,
so nothing is rounded. One restart interval is a row of blocks, so the reader can decode all intervals of all images of
a batch side by side, a symbol of each at a time. The reader takes any baseline scan (several components, sampling
factors, zero runs, end-of-block codes, no restart markers); progressive and arithmetic frames are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

ROW = 576  # bytes (coefficients) in a row of blocks
STRIP = 4096  # rows of blocks in an image at most; longer payloads go to several images
#: Bytes in the order of their usual frequency in European prose (UTF-8); the rest follows in ascending order.
COMMON = (
    b" eta\xffnoirshdlu\xc3cmpgfbwyv,.\n"  # letters, the payload's filling, the lead byte of accented letters, marks
    b"\xa9\xa8\xb3\xa7\xaa\xa0\xb1\xa1\xad\xbc\xb6\xa4\x9fkxjqz"  # their second bytes, rare letters
    b"ETAOINSRHDLUCMPGFBWYV!?-'\"0123456789:;()"  # capitals and the rest of a page
)
ORDER = bytes(dict.fromkeys(COMMON + bytes(range(256))))
#: Code length of each size category (Huffman tables of the writer).
DC_LENGTHS = {0: 4, 1: 3, 2: 3, 3: 2, 4: 2, 5: 3, 6: 5, 7: 6, 8: 7, 9: 8}
AC_LENGTHS = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}


def _value_maps() -> tuple[np.ndarray, np.ndarray]:
    """Coefficient of each byte (1, -1, 2, -2, ... in ORDER), and the byte of each coefficient at index value + 128."""
    to, back = np.zeros(256, np.int16), np.zeros(257, np.uint8)
    for rank, byte in enumerate(ORDER):
        v = (rank // 2 + 1) * (1 if rank % 2 == 0 else -1)
        to[byte] = v
        back[v + 128] = byte
    return to, back


TO_VALUE, TO_BYTE = _value_maps()


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body (16 counts, then symbols) and {symbol: (code, length)} of the canonical code with these lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(x == n for x in lengths.values()) for n in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(counts) + bytes(symbols), codes


def _bit_table(codes: dict[int, tuple[int, int]], least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and number of bits that stand for each value least..most (Huffman code of its size, then the size's bits)."""
    bits, sizes = np.zeros(most - least + 1, np.uint64), np.zeros(most - least + 1, np.int64)
    for v in range(least, most + 1):
        s = abs(v).bit_length()
        if s in codes:
            code, n = codes[s]
            bits[v - least], sizes[v - least] = code << s | (v if v > 0 else v + (1 << s) - 1), n + s
    return bits, sizes


DC_BODY, DC_CODES = canonical(DC_LENGTHS)
AC_BODY, AC_CODES = canonical(AC_LENGTHS)
DC_BITS, DC_SIZES = _bit_table(DC_CODES, -256, 256)
AC_BITS, AC_SIZES = _bit_table(AC_CODES, -128, 128)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int, n_bytes: int) -> bytes:
    """Everything before the scan's data; the comment holds the payload's length without padding."""
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", n_bytes)),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 72, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_BODY),
        _segment(0xC4, b"\x10" + AC_BODY),
        _segment(0xDD, struct.pack(">H", 9)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


HEADER = len(header(1, 0))


def encode(payload: np.ndarray, image_rows: list[int], lengths: list[int]) -> list[bytes]:
    """Images of ``image_rows[k]`` rows of blocks each, that hold ``payload`` one after another."""
    values = TO_VALUE[payload].reshape(-1, ROW)
    n = len(values)
    dc = values[:, ::64].astype(np.int64)
    dc[:, 1:] -= values[:, :-64:64]
    bits, sizes = np.empty((n, ROW + 1), np.uint64), np.empty((n, ROW + 1), np.int64)
    ac = values.astype(np.int64) + 128
    bits[:, :ROW], sizes[:, :ROW] = AC_BITS[ac], AC_SIZES[ac]
    bits[:, :ROW:64], sizes[:, :ROW:64] = DC_BITS[dc + 256], DC_SIZES[dc + 256]
    filled = sizes[:, :ROW].sum(axis=1)
    sizes[:, ROW] = -filled % 8  # an interval ends on a whole byte, filled up with ones
    bits[:, ROW] = (np.uint64(1) << sizes[:, ROW].astype(np.uint64)) - np.uint64(1)
    flat = sizes.ravel()
    at = np.cumsum(flat) - flat
    row_start = at.reshape(n, ROW + 1)[:, 0] // 8
    total = int(at[-1] + flat[-1]) // 8
    shifted = bits.ravel() << (64 - (at & 31) - flat).astype(np.uint64)
    word = at >> 5
    m = total // 4 + 2
    packed = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), m + 1) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), m + 1)
    data = packed.astype(np.uint32).astype(">u4").view(np.uint8)[:total]
    # Places in the output: stuffed zeros after FF, a marker between rows, a header before and an end after each image.
    image = np.repeat(np.arange(len(image_rows)), image_rows)
    inner = np.arange(n) - np.repeat(np.cumsum(image_rows) - image_rows, image_rows)  # row's place in its image
    marks = np.cumsum(np.where(inner > 0, 2, 0)) + (image + 1) * HEADER + image * 2
    row_of = np.repeat(np.arange(n), np.diff(np.append(row_start, total)))
    stuffed = data == 0xFF
    before = np.cumsum(stuffed) - stuffed
    place = np.arange(total) + before + marks[row_of]
    out = np.zeros(total + int(stuffed.sum()) + int(marks[-1]) + 2, np.uint8)
    out[place] = data
    first = place[row_start]
    later = inner > 0
    out[first[later] - 2], out[first[later] - 1] = 0xFF, 0xD0 + (inner[later] - 1) % 8
    begin = first[inner == 0] - HEADER
    stop = np.append(begin[1:], len(out))
    whole = bytearray(out.tobytes())
    for b, e, rows, length in zip(begin.tolist(), stop.tolist(), image_rows, lengths):
        whole[b : b + HEADER] = header(rows, length)
        whole[e - 2 : e] = b"\xff\xd9"
    view = memoryview(whole)
    return [bytes(view[b:e]) for b, e in zip(begin.tolist(), stop.tolist())]


@dataclass
class Image:
    """What the markers of one image say. ``layout`` is the same for images whose scans can be decoded together."""

    width: int = 0
    height: int = 0
    interval: int = 0
    quant: dict[int, bytes] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    comment: bytes = b""
    data: tuple[int, int] = (0, 0)  # the scan's first byte and end

    def layout(self) -> tuple:
        return tuple(sorted(self.quant.items())), tuple(sorted(self.tables.items())), tuple(self.parts), tuple(self.scan)

    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def sequence(self) -> list[tuple[int, int, int]]:
        """(component's place, DC table, AC table) of each block of an MCU."""
        out, place = [], {p[0]: k for k, p in enumerate(self.parts)}
        for part, dc, ac in self.scan:
            _, h, v, _ = self.parts[place[part]]
            out += [(place[part], dc, 16 + ac)] * (1 if len(self.parts) == 1 else h * v)
        return out


def markers(media: bytes) -> Iterator[Image]:
    """Parse the markers of the images that follow one another in ``media``."""
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = Image(), at + 2
        while True:
            kind, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = body[1 : 65 + 64 * wide] if not wide else bytes(min(255, x) for x in struct.unpack(">64H", body[1:129]))
                    body = body[65 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    image.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xC0 or kind == 0xC1:
                image.height, image.width, n = struct.unpack(">HHB", body[1:6])
                image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline frame")
            elif kind == 0xDD:
                image.interval = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                image.comment = body
            elif kind == 0xDA:
                image.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        end = media.index(b"\xff\xd9", at)
        image.data = (at, end)
        at = end + 2
        yield image


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code they begin with (0: none)."""
    table, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            lo = code << (16 - n)
            table[lo : lo + (1 << (16 - n))] = n << 8 | body[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def scans(images: list[tuple[np.ndarray, Image]]) -> list[np.ndarray]:
    """Quantised coefficients, as (blocks, 64) in scan order, of images with the same layout. Each comes with the bytes of its scan."""
    like = images[0][1]
    sequence = like.sequence()
    used = sorted({t for _, dc, ac in sequence for t in (dc, ac)})
    tables = np.concatenate([_lookup(like.tables[t]) for t in used])
    dc_at, ac_at = (np.array([used.index(s[k]) << 16 for s in sequence], np.int64) for k in (1, 2))
    per = len(sequence)
    pieces, blocks, base, at, n_blocks = [], [], [], [], []
    byte = done = 0
    for data, image in images:
        ff = np.flatnonzero(data[:-1] == 0xFF) if len(data) > 1 else np.zeros(0, np.int64)
        follow = data[ff + 1]
        cut = ff[follow != 0]
        drop = np.zeros(len(data), bool)
        drop[ff[follow == 0] + 1] = True
        drop[cut] = drop[cut + 1] = True
        starts = np.append(0, cut + 2)
        kept = np.cumsum(~drop)
        total = image.mcus()[0] * image.mcus()[1] * per
        each = image.interval * per or total
        at.append(byte + np.where(starts > 0, kept[np.maximum(starts - 1, 0)], 0))
        first = np.arange(len(starts)) * each
        base.append(done + first)
        blocks.append(np.minimum(each, total - first))
        pieces.append(data[~drop])
        byte, done = byte + int(kept[-1]), done + total
        n_blocks.append(total)
    buf = np.concatenate([*pieces, np.zeros(8, np.uint8)]).astype(np.uint64)
    m = len(buf) - 5
    window = buf[:m] << np.uint64(32) | buf[1 : m + 1] << np.uint64(24) | buf[2 : m + 2] << np.uint64(16) | buf[3 : m + 3] << np.uint64(8) | buf[4 : m + 4]
    window = window.astype(np.int64)
    out = np.zeros(done * 64, np.int16)
    bit, left, block = np.concatenate(at) * 8, np.concatenate(blocks), np.concatenate(base)
    segment_first, segment_blocks = block.copy(), left.copy()
    inner, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    alive = left > 0
    bit, left, block, inner, k = bit[alive], left[alive], block[alive], inner[alive], k[alive]
    while len(bit):
        w, off = window[bit >> 3], bit & 7
        is_dc = k == 0
        place = np.where(is_dc, dc_at[inner], ac_at[inner]) if per > 1 else np.where(is_dc, dc_at[0], ac_at[0])
        found = tables[place + ((w >> (24 - off)) & 0xFFFF)]
        if not found.all():
            raise ValueError("bad code in a scan")
        n, symbol = found >> 8, found & 255
        size, run = symbol & 15, symbol >> 4
        v = (w >> (40 - off - n - size)) & ((1 << size) - 1)
        v = np.where((v << 1) >> size == 0, v - (1 << size) + 1, v)
        v[size == 0] = 0
        bit += n + size
        k = np.where(is_dc, 0, k + run)
        out[block * 64 + np.minimum(k, 63)] += v.astype(np.int16)
        k += 1
        k[~is_dc & (symbol == 0)] = 64  # end of block
        over = k > 63
        if over.any():
            k[over] = 0
            block[over] += 1
            left[over] -= 1
            if per > 1:
                inner[over] = (inner[over] + 1) % per
            if not left.all():
                alive = left > 0
                bit, left, block, inner, k = bit[alive], left[alive], block[alive], inner[alive], k[alive]
    coefficients = out.reshape(-1, 64)
    # DC values are differences within a component and restart interval.
    part = np.array([s[0] for s in sequence])
    segment = np.repeat(np.arange(len(segment_first)), segment_blocks)
    within = np.arange(done) - segment_first[segment]
    for c in set(part.tolist()):
        mine = np.flatnonzero(part[within % per] == c)
        total = np.cumsum(coefficients[mine, 0].astype(np.int64))
        seg = segment[mine]
        head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        carried = np.where(head > 0, total[head - 1], 0)
        coefficients[mine, 0] = total - np.repeat(carried, np.diff(np.append(head, len(mine))))
    return np.split(coefficients, np.cumsum(n_blocks)[:-1])


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from the DC coefficients alone: one pixel for each block of the first component."""
    sequence = image.sequence()
    _, h, v, table = image.parts[0]
    if len(image.parts) == 1:
        h = v = 1
    across, down = image.mcus()
    dc = coefficients[:, 0].reshape(-1, len(sequence))[:, [k for k, s in enumerate(sequence) if s[0] == 0]].astype(np.float64)
    pixels = np.clip(np.rint(dc * image.quant[table][0] / 8) + 128, 0, 255).astype(np.uint8)
    grid = pixels.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return grid[: -(-image.height * v // (8 * max(p[2] for p in image.parts))) or 1, : -(-image.width * h // (8 * max(p[1] for p in image.parts))) or 1] if len(image.parts) > 1 else grid


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: does brightness rise from left to right, on the picture's means in 8 rows of 9 cells."""

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.arange(cells) * n // cells
        return lo, np.maximum(lo + 1, (np.arange(cells) + 1) * n // cells)

    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    (a, b), (c, d) = edges(pixels.shape[0], 8), edges(pixels.shape[1], 9)
    mean = (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / ((b - a)[:, None] * (d - c)[None, :])
    return int.from_bytes(np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes(), "big")
