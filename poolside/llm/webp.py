"""Media columns in lossless WebP (op9).

The decoder reads prefix codes, back-references and the colour cache, inverts the predictor, cross-colour,
subtract-green and palette transforms, and gives pixel arrays (0xAARRGGBB). Where
there is one group of codes without a cache and the channels but green have one symbol, only greens are decoded, and
a reference is copied as a whole; other images are decoded pixel by pixel.

Texts are stored as grey images, a byte to a pixel: rows of ``ROW`` pixels, frames of ``FRAME`` bytes at most
with a file each, one after another. A file uses the subtract-green transform, a predictor behind it where that
makes the code shorter, or a palette of up to 16 greys with several pixels to a symbol if it is smaller; and
back-references where they take fewer bits than literals (files of five rows or less have literals only). So only the green and distance codes have more than a
symbol. The cache and the cross-colour transform can't make a grey image smaller, as its green code alone tells a
pixel. ``encode_image`` can use all transforms, the cache, references and several groups of codes for any image.

Null and empty texts are stored as ``ROW`` bytes 0. Rows whose id is null or repeats are stored like others.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from poolside.llm.common import in_groups, record_batches, rows_of, text_rows

#: Samples of a row of a stored text's image, and of a file.
ROW, FRAME = 64, 1 << 15
#: Fixed values of the format: the order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Longest code that the encoder makes, and that images decoded together may have.
SHORT = 11
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Samples of a file that is written with literals only, at most.
SMALL = 5 * ROW
#: Samples that are encoded together, so that what is told of them stays near the processor.
TOGETHER = 1 << 17
#: Samples of a reference that texts are stored with, at least and at most; the share of the bits that a prediction may leave.
LEAST, MOST, PREDICTED = 6, 4096, 0.9
#: Fixed values of the format: the least length or distance of a prefix, and its number of extra bits.
EXTRA = np.array([0] * 4 + [k - 2 >> 1 for k in range(4, 40)])
VALUES = np.array([1, 2, 3, 4] + [(2 + (k & 1) << (k - 2 >> 1)) + 1 for k in range(4, 40)])


@lru_cache(maxsize=1)
def near_pixels() -> list[tuple[int, int]]:
    """(x, y) to the left and up of the first 120 distance codes: the nearest first, then those less far to the side."""
    around = [(x, y) for y in range(8) for x in range(-7 if y else 1, 9)]
    return sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---- bits


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        return int.from_bytes(self.data[byte : byte + (n + shift + 7 >> 3)], "little") >> shift & (1 << n) - 1


class BitWriter:
    def __init__(self):
        self.bits = self.n = 0

    def write(self, value: int, n: int) -> None:
        self.bits |= value << self.n
        self.n += n


# ---- prefix codes


def code_lengths(counts: Sequence[int], longest: int) -> list[int]:
    """Lengths of an optimal prefix code; counts are levelled until no code is longer than ``longest``."""
    used = [s for s, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    least = 1
    while True:
        heap = [(max(counts[s], least), i) for i, s in enumerate(used)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= longest:
            for i, s in enumerate(used):
                out[s] = depth[i]
            return out
        least *= 2


@lru_cache(maxsize=16)
def reversal(n: int) -> np.ndarray:
    """Each number of ``n`` bits, its bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


@lru_cache(maxsize=16)
def reversed_numbers(n: int) -> list[int]:
    return reversal(n).tolist()


def codes_of(lengths: Sequence[int]) -> list[int]:
    """The code of each symbol as it is written, its first bit lowest."""
    order = sorted((s for s, n in enumerate(lengths) if n), key=lengths.__getitem__)
    out = [0] * len(lengths)
    if len(order) > 1:
        longest, at = lengths[order[-1]], 0
        turned = reversed_numbers(longest)
        for s in order:
            out[s] = turned[at]
            at += 1 << longest - lengths[s]
    return out


def lookup(lengths: Sequence[int]) -> tuple[list[int], int]:
    """(symbol << 4 | code length) by the next bits, and how many bits. A code of one symbol takes none."""
    used = [(s, n) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return [used[0][0] << 4], 0
    longest = max(n for _, n in used) if used else 0
    if not used or sum(1 << longest - n for _, n in used) != 1 << longest:
        raise ValueError("not a prefix code")
    out, codes = [0] * (1 << longest), codes_of(lengths)
    for s, n in used:
        out[codes[s] :: 1 << n] = [s << 4 | n] * (1 << longest - n)
    return out, longest


def read_code(bits: BitReader, size: int) -> list[int]:
    """Code lengths of an alphabet of ``size`` symbols."""
    out = [0] * size
    if bits.read(1):
        two = bits.read(1)
        out[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    inner = [0] * 19
    for i in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[i]] = bits.read(3)
    table, width = lookup(inner)
    mask = (1 << width) - 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, data, place = 0, 8, bits.data, bits.at
    while at < size and left:
        left -= 1
        window = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        entry = table[window & mask]
        symbol, n = entry >> 4, entry & 15
        window >>= n
        if symbol < 16:
            out[at] = symbol
            at += 1
            last = symbol or last
        else:
            extra, base, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[symbol - 16]
            times = base + (window & (1 << extra) - 1)
            n += extra
            if at + times > size:
                raise ValueError("too many code lengths")
            out[at : at + times] = [value] * times
            at += times
        place += n
    bits.at = place
    return out


def write_code(bits: BitWriter, lengths: Sequence[int]) -> list[int]:
    """Write a code; returns the lengths that it is used with (none for a single symbol)."""
    lengths = [int(n) for n in lengths]
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 3 and all(s < 256 for s in used):
        bits.write(1, 1)
        bits.write(len(used) == 2, 1)
        bits.write(1, 1)
        bits.write(used[0] if used else 0, 8)
        if len(used) == 2:
            bits.write(used[1], 8)
        return lengths if len(used) == 2 else [0] * len(lengths)
    steps, last = [], 8  # (symbol, extra bits, value)
    for n, same in groupby(lengths):
        times = len(list(same))
        while times:
            if not n and times >= 3:
                part = min(times, 138)
                steps.append((17, 3, part - 3) if part < 11 else (18, 7, part - 11))
            elif n and n == last and times >= 3:
                part = min(times, 6)
                steps.append((16, 2, part - 3))
            else:
                part = 1
                steps.append((n, 0, 0))
                last = n or last
            times -= part
    counts = [0] * 19
    for s, _, _ in steps:
        counts[s] += 1
    inner = code_lengths(counts, 7)
    bits.write(0, 1)
    stored = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if inner[s]))
    bits.write(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        bits.write(inner[s], 3)
    bits.write(0, 1)
    codes, single = codes_of(inner), sum(map(bool, inner)) == 1
    for s, extra, value in steps:
        bits.write(codes[s], 0 if single else inner[s])
        bits.write(value, extra)
    return lengths


def prefix_coded(value: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits and their value of a length or distance from 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    extra = top - 1
    half = value >> extra & 1
    return 2 * top + half, extra, value & (1 << extra) - 1


# ---- decoding


class Image:
    """A file's header: size, transforms, and where its pixels begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
            raise ValueError("not a lossless WebP file")
        self.bits = bits = BitReader(data, 8 * 21)
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.transforms, self.across = [], self.width
        while bits.read(1):
            kind = bits.read(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                tile = bits.read(3) + 2
                part = coded_pixels(bits, -(-self.across >> tile), -(-self.height >> tile), False)
                self.transforms.append((kind, tile, part, self.across))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, 0, None, self.across))
            else:
                size = bits.read(8) + 1
                table = np.cumsum(channels(coded_pixels(bits, size, 1, False)), axis=0) & 255
                pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((kind, pack, joined(table), self.across))
                self.across = -(-self.across >> pack)

    def inverted(self, pixels: np.ndarray) -> np.ndarray:
        for kind, at, part, width in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = unpredicted(pixels, width, self.height, at, part)
            elif kind == CROSS_COLOUR:
                pixels = uncrossed(pixels, width, self.height, at, part)
            elif kind == SUBTRACT_GREEN:
                green = pixels >> np.uint32(8) & np.uint32(255)
                both = (pixels & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green)
                pixels = pixels & np.uint32(0xFF00FF00) | both & np.uint32(0xFF00FF)
            else:
                pixels = unpacked(pixels, width, self.height, at, part)
        return pixels.reshape(self.height, self.width)


def channels(pixels: np.ndarray) -> np.ndarray:
    """(pixel, 4) of alpha, red, green, blue."""
    return (pixels[:, None] >> np.array([24, 16, 8, 0], np.uint32) & np.uint32(255)).astype(np.int64)


def joined(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint32)
    return v[:, 0] << np.uint32(24) | v[:, 1] << np.uint32(16) | v[:, 2] << np.uint32(8) | v[:, 3]


def read_group(bits: BitReader, cache_bits: int) -> list[list[int]]:
    """Code lengths for green with lengths and cache, red, blue, alpha and distances."""
    return [read_code(bits, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def coded_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an entropy-coded image, one by one."""
    cache_bits, tile, groups_at, n_groups = bits.read(4) if bits.read(1) else 0, 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups_at = (coded_pixels(bits, -(-width >> tile), -(-height >> tile), False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        n_groups = max(groups_at) + 1
    groups = [[(t, (1 << n) - 1) for t, n in map(lookup_or_zero, read_group(bits, cache_bits))] for _ in range(n_groups)]
    return one_by_one(bits, width, height, cache_bits, tile, groups_at, groups)


def lookup_or_zero(lengths):
    return lookup(lengths) if any(lengths) else ([0], 0)


def one_by_one(bits, width, height, cache_bits, tile, groups_at, groups) -> np.ndarray:
    total, out, at, data = width * height, [], bits.at, bits.data
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0
    across, near = -(-width >> tile), near_pixels()

    def symbol(code):
        nonlocal at
        entry = code[0][int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & code[1]]
        at += entry & 15
        return entry >> 4

    def value(prefix):
        nonlocal at
        if prefix < 4:
            return prefix + 1
        extra = prefix - 2 >> 1
        more = int.from_bytes(data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & (1 << extra) - 1
        at += extra
        return (2 + (prefix & 1) << extra) + more + 1

    while (n := len(out)) < total:
        green, red, blue, alpha, distance = groups[groups_at[(n // width >> tile) * across + (n % width >> tile)] if groups_at else 0]
        s = symbol(green)
        if s < 256:
            r = symbol(red)
            b = symbol(blue)
            out.append(symbol(alpha) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length, code = value(s - 256), value(symbol(distance))
            if code > 120:
                back = code - 120
            else:
                x, y = near[code - 1]
                back = max(1, x + y * width)
            if back > n or n + length > total:
                raise ValueError("a reference outside the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            # the cache holds the pixels before this one
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            cached = n
            out.append(cache[s - 280])
    bits.at = at
    return np.array(out, np.uint32)


def half(a, b):
    return a + b >> 1


def unpredicted(pixels, width, height, tile, modes) -> np.ndarray:
    """Inverse of the predictor transform; along a row where the left pixel counts, else a row at once."""
    modes = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, -(-width >> tile)).tolist()
    rest, out = channels(pixels).reshape(height, width, 4), np.zeros((height, width, 4), np.int64)
    opaque = np.array([255, 0, 0, 0])
    for y in range(height):
        row, above = out[y], out[y - 1]
        if not y:
            rest[0, 0] += opaque
            row[:] = np.cumsum(rest[0], axis=0) & 255
            continue
        row[0] = rest[y, 0] + above[0] & 255
        for first in range(0, width, 1 << tile):
            mode, last = modes[y >> tile][first >> tile], min(width, first + (1 << tile))
            first = max(first, 1)
            if first >= last:
                continue
            t, tl = above[first:last], above[first - 1 : last - 1]
            tr = np.concatenate([above[first + 1 : last + 1], row[:1]])[: last - first]
            here = rest[y, first:last]
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                guess = {2: t, 3: tr, 4: tl, 8: half(tl, t), 9: half(t, tr)}.get(mode, opaque)
                row[first:last] = here + guess & 255
                continue
            if mode == 1:
                row[first:last] = row[first - 1] + np.cumsum(here, axis=0) & 255
                continue
            for i in range(last - first):
                row[first + i] = here[i] + guessed(mode, row[first + i - 1], t[i], tl[i], tr[i]) & 255
    return joined(out.reshape(-1, 4))


def guessed(mode, left, t, tl, tr):
    if mode == 5:
        return half(half(left, tr), t)
    if mode == 6:
        return half(left, tl)
    if mode == 7:
        return half(left, t)
    if mode == 10:
        return half(half(left, tl), half(t, tr))
    if mode == 11:
        return left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
    if mode == 12:
        return np.clip(left + t - tl, 0, 255)
    middle = half(left, t)
    return np.clip(middle + np.trunc((middle - tl) / 2).astype(np.int64), 0, 255)


def signed(x):
    return (x + 128 & 255) - 128


def of_tiles(part, width, height, tile) -> np.ndarray:
    """Each pixel's value in an image of tiles."""
    x, y = np.arange(width) >> tile, np.arange(height) >> tile
    return part.reshape(-1, -(-width >> tile))[y[:, None], x].ravel()


def uncrossed(pixels, width, height, tile, part) -> np.ndarray:
    c, by = channels(pixels), signed(channels(of_tiles(part, width, height, tile)))
    c[:, 1] = c[:, 1] + (by[:, 3] * signed(c[:, 2]) >> 5) & 255
    c[:, 3] = c[:, 3] + (by[:, 2] * signed(c[:, 2]) >> 5) + (by[:, 1] * signed(c[:, 1]) >> 5) & 255
    return joined(c)


def crossed(pixels, width, height, tile, part) -> np.ndarray:
    c, by = channels(pixels), signed(channels(of_tiles(part, width, height, tile)))
    c[:, 3] = c[:, 3] - (by[:, 2] * signed(c[:, 2]) >> 5) - (by[:, 1] * signed(c[:, 1]) >> 5) & 255
    c[:, 1] = c[:, 1] - (by[:, 3] * signed(c[:, 2]) >> 5) & 255
    return joined(c)


def unpacked(pixels, width, height, pack, table) -> np.ndarray:
    green = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    x, bits = np.arange(width), 8 >> pack
    index = green[:, x >> pack].astype(np.int64) >> ((x & (1 << pack) - 1) * bits) & (1 << bits) - 1
    return np.concatenate([table, np.zeros(256, np.uint32)])[index].ravel()


def decode(files: Sequence[bytes]) -> list[np.ndarray]:
    """The pixels (row, column) of each file."""
    out = []
    for image in map(Image, files):
        bits, at = image.bits, image.bits.at
        if not bits.read(2):  # no cache, and one group of codes
            group = read_group(bits, 0)
            if max(group[0]) <= SHORT and max(group[4]) <= SHORT and all(g.count(0) == 255 for g in group[1:4]):
                rest = group[3].index(1) << 24 | group[1].index(1) << 16 | group[2].index(1)
                greens = np.frombuffer(green_pixels(bits, group[0], group[4], image.across, image.across * image.height), np.uint8)
                out.append(image.inverted(greens.astype(np.uint32) << np.uint32(8) | np.uint32(rest)))
                continue
        bits.at = at
        out.append(image.inverted(coded_pixels(bits, image.across, image.height, True)))
    return out


def green_pixels(bits: BitReader, green: Sequence[int], distance: Sequence[int], width: int, total: int) -> bytes:
    """The greens of an image of one group whose other channels have one symbol."""
    far, far_n = lookup_or_zero(distance)
    table, mask, far_mask = literal_pairs(green), (1 << SHORT) - 1, (1 << far_n) - 1
    data = np.frombuffer(bits.data[bits.at >> 3 :] + bytes(4), np.uint8)
    window = (data[:-2].astype(np.int32) | data[1:-1].astype(np.int32) << 8 | data[2:].astype(np.int32) << 16).tolist()
    near, extras, values, literals, refers = near_pixels(), EXTRA.tolist(), VALUES.tolist(), one_or_two(), len(one_or_two()) << 4
    out, at = bytearray(), bits.at & 7
    try:
        while (left := total - len(out)) > 0:
            for _ in range(left + 1 >> 1):
                k = table[window[at >> 3] >> (at & 7) & mask]
                at += k & 15
                if k >= refers:
                    break
                out += literals[k >> 4]
            else:
                continue
            s = k - refers >> 4
            length = values[s] + (window[at >> 3] >> (at & 7) & (1 << extras[s]) - 1)
            at += extras[s]
            k = far[window[at >> 3] >> (at & 7) & far_mask]
            at += k & 15
            k >>= 4
            back = values[k] + (window[at >> 3] >> (at & 7) & (1 << extras[k]) - 1) - 120
            at += extras[k]
            if back <= 0:
                x, y = near[back + 119]
                back = max(1, x + y * width)
            here = len(out)
            if back > here or here + length > total:
                raise ValueError("a reference outside the image")
            part = out[here - back : here - back + length]
            out += part if back >= length else (part * (length // back + 1))[:length]
    except IndexError:
        raise ValueError("a file ends before its pixels") from None
    return bytes(out[:total])


@lru_cache(maxsize=1)
def one_or_two() -> list[bytes]:
    """Each byte, then each two."""
    return [bytes([i]) for i in range(256)] + [i.to_bytes(2, "little") for i in range(1 << 16)]


def literal_pairs(lengths: Sequence[int]) -> list[int]:
    """By the next ``SHORT`` bits: their number in ``one_or_two``, or behind these a reference's length prefix, << 4 | bits read. Two literals are one entry where both are told by these bits."""
    table, n = lookup(lengths)
    first = np.tile(np.array(table, np.int32), 1 << SHORT - n)
    symbol, size = first >> 4, first & 15
    second = first[np.arange(1 << SHORT) >> size]
    both = size + (second & 15)
    out = np.where(symbol < 256, symbol, symbol - 256 + len(one_or_two())) << 4 | size
    pair = (symbol < 256) & (second < 256 << 4) & (both <= SHORT)
    return np.where(pair, 256 + symbol + (second & ~15) * 16 << 4 | both, out).tolist()


# ---- encoding


def container(bits: BitWriter) -> bytes:
    body = b"\x2f" + bits.bits.to_bytes(bits.n + 7 >> 3, "little")
    return riff(body)


def riff(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def header(width: int, height: int) -> BitWriter:
    bits = BitWriter()
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(0, 4)
    return bits


def repeats(samples: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """References that some images (one after another, up to ``ends``) are written with: their places, lengths, and how far back the samples stand.

    A place's candidate is the nearest one before it with the same ``LEAST`` samples; as long as the next places' are
    as far back, it goes on. Of what is found, the first is taken, then the first behind it.
    """
    none = (np.empty(0, np.int64),) * 3
    n = len(samples) - LEAST + 1
    if n < 2:
        return none
    key = np.ndarray((n,), "<u8", samples.tobytes() + bytes(8), strides=(1,)) & np.uint64((1 << 8 * LEAST) - 1)
    short = key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    order = np.argsort(short.astype(np.uint16), kind="stable")
    order = order[np.argsort((short >> np.uint64(16)).astype(np.uint16)[order], kind="stable")].astype(np.int32)
    image = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    key, of = key[order], image[order]
    same = np.flatnonzero((key[1:] == key[:-1]) & (of[1:] == of[:-1]))
    back, here = np.zeros(n, np.int32), order[same + 1]
    back[here] = here - order[same]
    back[image[:n] != image[LEAST - 1 :]] = 0
    last = np.flatnonzero(np.append(back[1:] != back[:-1], True))
    until = np.repeat(last, np.diff(last, prepend=-1))
    places = np.flatnonzero(back)
    if not len(places):
        return none
    lengths = np.minimum(until[places] - places + LEAST, MOST)
    following = np.searchsorted(places, places + lengths).tolist()
    taken, j = [], 0
    while j < len(following):
        taken.append(j)
        j = following[j]
    return places[taken], lengths[taken], back[places[taken]].astype(np.int64)


def near_codes(width: int) -> np.ndarray:
    """The distance code of each short way back in an image of this width; 0: none."""
    out = np.zeros(8 * width + 9, np.int64)
    for k, (x, y) in reversed(list(enumerate(near_pixels()))):
        if x + y * width > 0:
            out[x + y * width] = k + 1
    return out


@lru_cache(maxsize=1)
def count_bits() -> np.ndarray:
    """n log2 n of counts to ``FRAME``."""
    n = np.arange(FRAME + 1)
    return n * np.log2(np.maximum(n, 1))


def bits_for(counts: np.ndarray) -> np.ndarray:
    """For each row of counts, the bits of an ideal code for symbols that come so often."""
    return count_bits()[counts.sum(axis=1)] - count_bits()[counts].sum(axis=1)


def counted(image: np.ndarray, symbols: np.ndarray, images: int, size: int) -> np.ndarray:
    """How often each symbol comes in each image."""
    return np.bincount(image * size + symbols, minlength=images * size).reshape(images, size)


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lengths or distances, and the values of their extra bits."""
    symbols = np.searchsorted(VALUES, values, side="right") - 1
    return symbols, values - VALUES[symbols]


def encode_greens(images: Sequence[tuple[BitWriter, np.ndarray, int, tuple]]) -> list[bytes]:
    """Files of images whose green channel alone differs by pixel: (the header and transforms so far, greens, width, the red, blue and alpha of all pixels).

    Each is written with references to what stands before, or with literals only, whichever takes fewer bits.
    """
    if not images:
        return []
    sizes = np.array([len(g) for _, g, _, _ in images])
    ends = np.cumsum(sizes)
    greens = np.concatenate([g for _, g, _, _ in images])
    places, lengths, back = repeats(greens, ends)
    width = np.array([w for _, _, w, _ in images])
    of = np.searchsorted(ends, places, side="right")
    distance = back + 120
    for w in set(width.tolist()):
        codes = near_codes(w)
        mine = np.flatnonzero((width[of] == w) & (back < len(codes)))
        near = codes[back[mine]]
        distance[mine[near > 0]] = near[near > 0]
    (by_length, length_more), (by_distance, distance_more) = prefixes(lengths), prefixes(distance)

    # what stands in references is left out of the literals, where references pay
    edges = np.zeros(len(greens) + 1, np.int8)
    edges[places] += 1
    edges[places + lengths] -= 1
    inside = np.cumsum(edges, dtype=np.int8)[:-1] > 0
    image, n = np.repeat(np.arange(len(images), dtype=np.int32), sizes), len(images)
    literal = np.flatnonzero(~inside)
    plain, others = counted(image, greens, n, 256), counted(image[literal], greens[literal], n, 320)
    others += counted(np.append(of, of), np.append(256 + by_length, 280 + by_distance), n, 320)
    symbols = np.count_nonzero(others, axis=1) - np.count_nonzero(plain, axis=1)
    bits = bits_for(others[:, :280]) + bits_for(others[:, 280:]) + np.bincount(of, EXTRA[by_length] + EXTRA[by_distance], n) + 4 * symbols
    pays = (bits < bits_for(plain)) & (sizes > SMALL) & (np.bincount(of, minlength=n) > 0)
    counts = np.where(pays[:, None], others, np.pad(plain, ((0, 0), (0, 64))))

    codes, ns = np.zeros((len(images), 320), np.int64), np.zeros((len(images), 320), np.int64)
    heads = []
    for i, ((bits, _, _, rest), mine) in enumerate(zip(images, counts.tolist())):
        bits.write(0, 3)  # no further transform, no cache, one group
        used = write_code(bits, code_lengths(mine[:280], SHORT))
        for symbol in rest:
            bits.write(0b101 | symbol << 3, 11)
        far = write_code(bits, code_lengths(mine[280:], SHORT))
        ns[i, :280], codes[i, :280] = used, codes_of(used)
        if any(far):
            ns[i, 280:], codes[i, 280:] = far, codes_of(far)
        heads.append(bits.bits.to_bytes(bits.n + 7 >> 3, "little"))

    # a field for each literal or reference: a symbol's code, its extra bits, and the same of a distance
    refers = np.repeat(pays, sizes)
    refers &= inside
    here = np.flatnonzero(pays[of])
    places, of = places[here], of[here]
    refers[places] = False
    tokens = np.flatnonzero(~refers)
    image = image[tokens]
    symbol = greens[tokens].astype(np.int32)
    at = np.searchsorted(tokens, places)
    symbol[at] = 256 + by_length[here]
    symbol += image * 320
    n, value = ns.ravel()[symbol], codes.ravel()[symbol]
    for extra_bits, more in ((EXTRA[by_length[here]], length_more[here]), (ns[of, 280 + by_distance[here]], codes[of, 280 + by_distance[here]]), (EXTRA[by_distance[here]], distance_more[here])):
        value[at] |= more << n[at]
        n[at] += extra_bits
    until = np.cumsum(n)
    upto = np.append(0, until)[np.searchsorted(image, np.arange(len(images) + 1))]
    head_bits = np.array([bits.n for bits, *_ in images])
    file_sizes = head_bits + np.diff(upto) + 7 >> 3
    file_at = np.cumsum(file_sizes) - file_sizes
    starts = until - n + (file_at * 8 + head_bits - upto[:-1])[image]
    body = np.zeros(int(file_sizes.sum()) + 7, np.uint8)
    shifted, byte = value << (starts & 7), starts >> 3
    for k in range(7):
        if k == 3:  # literals end here
            shifted, byte = shifted[at], byte[at]
        if len(byte):
            body += np.bincount(byte + k, shifted >> 8 * k & 255, len(body)).astype(np.uint8)
    out = []
    for head, a, size in zip(heads, file_at.tolist(), file_sizes.tolist()):
        body[a : a + len(head)] |= np.frombuffer(head, np.uint8)
        out.append(riff(b"\x2f" + body[a : a + size].tobytes()))
    return out


def encode_grey(images: Sequence[np.ndarray], width: int) -> list[bytes]:
    """Files of grey images of 8-bit samples: with subtract-green, also predicted from above or the left if that has a shorter code; or with a palette, if that is smaller."""

    def begun(samples: np.ndarray) -> BitWriter:
        return header(width, len(samples) // width)

    def plain(group: Sequence[np.ndarray]) -> list[tuple]:
        sizes = np.array([len(s) for s in group])
        samples, image, ends = np.concatenate(group), np.repeat(np.arange(len(group), dtype=np.int32), sizes), np.cumsum(sizes)
        rows = samples.reshape(-1, width)
        # from the left, from above; the first row and column have one neighbour
        left, above = np.zeros_like(rows), np.zeros_like(rows)
        left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
        left[1:, 0] = rows[:-1, 0]
        top = (ends - sizes) // width
        left[top, 0], above[top, 0], above[top, 1:] = 0, 0, rows[top, :-1]
        ways = [samples, (rows - left).ravel(), (rows - above).ravel()]
        bits = np.stack([bits_for(counted(image, way, len(group), 256)) for way in ways])
        bits[0] *= PREDICTED
        return [begun_plain(s, mode, ways[mode][end - len(s) : end]) for s, mode, end in zip(group, bits.argmin(axis=0).tolist(), ends.tolist())]

    def begun_plain(samples: np.ndarray, mode: int, greens: np.ndarray) -> tuple:
        bits = begun(samples)
        bits.write(1 | SUBTRACT_GREEN << 1, 3)
        if not mode:
            return bits, greens, width, (0, 0, 255)
        bits.write(1 | PREDICTOR << 1, 3)
        bits.write(7, 3)  # tiles of 512
        write_pixels(bits, [mode << 8] * -(-len(samples) // width // 512), 1, False)
        return bits, greens, width, (0, 0, 0)

    def packed(samples: np.ndarray, table: np.ndarray) -> tuple:
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
        bits, each = begun(samples), 1 << pack
        bits.write(1 | PALETTE << 1, 3)
        bits.write(len(table) - 1, 8)
        greys = np.diff(table, prepend=0).tolist()
        write_pixels(bits, [(255 << 24 if not i else 0) | v << 16 | v << 8 | v for i, v in enumerate(greys)], len(table), False)
        across = -(-width // each)
        index = np.zeros((len(samples) // width, across * each), np.int64)
        index[:, :width] = np.searchsorted(table, samples).reshape(-1, width)
        greens = (index.reshape(-1, across, each) << np.arange(each) * (8 >> pack)).sum(axis=2).astype(np.uint8).ravel()
        return bits, greens, across, (0, 0, 0)

    files = [f for group in in_groups(images, len, TOGETHER) for f in encode_greens(plain(group))]
    few = [(i, np.flatnonzero(np.bincount(s))) for i, s in enumerate(images) if len(s) < 1024 or len(set(s[:1024].tolist())) <= 16]
    few = [(i, table) for i, table in few if 1 < len(table) <= 16]
    for (i, _), other in zip(few, encode_greens([packed(images[i], table) for i, table in few])):
        files[i] = min(files[i], other, key=len)
    return files


def write_pixels(bits: BitWriter, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, split: int = 0) -> None:
    """An entropy-coded image; ``split``: tile bits of a grid of tiles that take turns with two groups of codes."""
    bits.write(cache_bits > 0, 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    height = len(pixels) // width
    across = -(-width >> split)
    turn = [0] * len(pixels)
    if main:
        bits.write(split > 0, 1)
        if split:
            bits.write(split - 2, 3)
            tiles = [(x + y) % 2 for y in range(-(-height >> split)) for x in range(across)]
            write_pixels(bits, [t << 8 for t in tiles], across, False)
            turn = [tiles[(i // width >> split) * across + (i % width >> split)] for i in range(len(pixels))]
    cache, shift, seen, steps, i = {}, 32 - cache_bits, {}, [], 0
    near = {p[0] + p[1] * width: k + 1 for k, p in reversed(list(enumerate(near_pixels())))}
    while i < len(pixels):
        length, back = 1, 0
        if references:
            key = tuple(pixels[i : i + 4])
            if key in seen:
                back = i - seen[key]
                while i + length < len(pixels) and length < 4096 and pixels[i + length] == pixels[i + length - back]:
                    length += 1
            back = back if length >= 4 else 0
            length = length if back else 1
        p = pixels[i]
        slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> shift
        if back:
            steps.append((turn[i], prefix_coded(length), prefix_coded(near.get(back, back + 120))))
        elif cache_bits and cache.get(slot, 0) == p:
            steps.append((turn[i], slot, None))
        else:
            steps.append((turn[i], p, True))
        for j in range(i, i + length):
            seen[tuple(pixels[j : j + 4])] = j
            cache[(CACHE_FACTOR * pixels[j] & 0xFFFFFFFF) >> shift] = pixels[j]
        i += length
    groups = []
    for g in range(2 if split else 1):
        counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
        for t, what, more in steps:
            if t != g:
                continue
            if more is True:
                for channel, at in ((0, 8), (1, 16), (2, 0), (3, 24)):
                    counts[channel][what >> at & 255] += 1
            elif more is None:
                counts[0][280 + what] += 1
            else:
                counts[0][256 + what[0]] += 1
                counts[4][more[0]] += 1
        groups.append([(n, codes_of(n)) for n in (write_code(bits, code_lengths(c, 15)) for c in counts)])
    for t, what, more in steps:
        codes = groups[t]

        def put(channel, symbol, codes=codes):
            bits.write(codes[channel][1][symbol], codes[channel][0][symbol])

        if more is True:
            for channel, at in ((0, 8), (1, 16), (2, 0), (3, 24)):
                put(channel, what >> at & 255)
        elif more is None:
            put(0, 280 + what)
        else:
            put(0, 256 + what[0])
            bits.write(what[2], what[1])
            put(4, more[0])
            bits.write(more[2], more[1])


def encode_image(pixels: np.ndarray, transforms: Sequence[tuple] = (), cache_bits: int = 0, references: bool = False, split: int = 0) -> bytes:
    """A file of any pixels (0xAARRGGBB). ``transforms``: (PREDICTOR, tile bits, modes), (CROSS_COLOUR, tile bits, elements), (SUBTRACT_GREEN,) or (PALETTE,), in their order."""
    height, width = pixels.shape
    bits, p = header(width, height), pixels.astype(np.uint32).ravel()
    for kind, *how in transforms:
        bits.write(1 | kind << 1, 3)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile, values = how
            part = np.resize(np.array(values, np.uint32), -(-width >> tile) * -(-height >> tile))
            if kind == PREDICTOR:
                p, part = predicted(p, width, height, tile, part), part << np.uint32(8)
            else:
                p = crossed(p, width, height, tile, part)
            bits.write(tile - 2, 3)
            write_pixels(bits, part.tolist(), -(-width >> tile), False)
        elif kind == SUBTRACT_GREEN:
            c = channels(p)
            c[:, 1] -= c[:, 2]
            c[:, 3] -= c[:, 2]
            p = joined(c & 255)
        else:
            table, index = np.unique(p, return_inverse=True)
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            bits.write(len(table) - 1, 8)
            steps = np.diff(np.concatenate([np.zeros((1, 4), np.int64), channels(table)]), axis=0) & 255
            write_pixels(bits, joined(steps).tolist(), len(table), False)
            across = -(-width >> pack)
            wide = np.zeros((height, across << pack), np.int64)
            wide[:, :width] = index.reshape(height, width)
            p = ((wide.reshape(height, across, 1 << pack) << np.arange(1 << pack) * (8 >> pack)).sum(axis=2) << 8).astype(np.uint32).ravel()
            width = across
    bits.write(0, 1)
    write_pixels(bits, p.tolist(), width, True, cache_bits, references, split)
    return container(bits)


def predicted(pixels, width, height, tile, modes) -> np.ndarray:
    c, opaque = channels(pixels).reshape(height, width, 4), np.array([255, 0, 0, 0])
    out = np.empty_like(c)
    for y in range(height):
        for x in range(width):
            mode = int(modes[(y >> tile) * -(-width >> tile) + (x >> tile)])
            if not (x or y):
                guess = opaque
            elif not x or not y:
                guess = c[y - 1, 0] if y else c[0, x - 1]
            else:
                left, t, tl, tr = c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                plain = {0: opaque, 1: left, 2: t, 3: tr, 4: tl, 8: half(tl, t), 9: half(t, tr)}
                guess = plain[mode] if mode in plain else guessed(mode, left, t, tl, tr)
            out[y, x] = c[y, x] - guess & 255
    return joined(out.reshape(-1, 4))


# ---- texts as media


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % ROW or ROW * (not data))


def stored(datas: Sequence[bytes]) -> list[bytes]:
    """The files of each payload, one after another."""
    frames = [[d[i : i + FRAME] for i in range(0, len(d), FRAME)] for d in datas]
    files = iter(encode_grey([np.frombuffer(f, np.uint8) for parts in frames for f in parts], ROW))
    return [b"".join(next(files) for _ in parts) for parts in frames]


def store(data: bytes) -> bytes:
    return stored([data])[0]


def files_of(media: bytes) -> list[bytes]:
    found, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        found.append(media[at:end])
        at = end
    return found


def samples_of(medias: Sequence[bytes]) -> list[np.ndarray]:
    """The stored samples of each row's media."""
    parts = [files_of(m) for m in medias]
    pixels = iter(decode([f for p in parts for f in p]))
    return [np.concatenate([(next(pixels) & np.uint32(255)).astype(np.uint8).ravel() for _ in p]) for p in parts]


def feature(samples: np.ndarray) -> str:
    """64 bits, for the samples' 64 equal parts in turn (those of a grid of columns): 1 if the mean is over the whole's mean; and the mean."""
    means = samples.reshape(-1, ROW).mean(axis=0)
    mean = means.mean()
    return f"{int.from_bytes(np.packbits(means > mean).tobytes(), 'big'):016x}-{mean:.3f}"


def to_webp(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes and media (the files)."""

    def run(batches):
        def rows():
            for group in in_groups(rows_of(batches, "id", "text"), lambda r: len(r[1]), 4 << 20):
                for (doc, text), media in zip(group, stored([payload(text) for _, text in group])):
                    yield doc, len(text.encode("utf-8", "surrogatepass")), media

        yield from record_batches(rows(), (id_col, "n_bytes", "media"), (pa.int64(), pa.int64(), pa.binary()))

    return text_rows(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, media binary")


def from_webp(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``to_webp``: ``id_col``, n_bytes and samples (the payload, read back)."""

    def run(batches):
        def rows():
            for group in in_groups(rows_of(batches, id_col, "n_bytes", "media"), lambda r: len(r[2]), 2 << 20):
                for (doc, n, _), samples in zip(group, samples_of([r[2] for r in group])):
                    yield doc, n, samples.tobytes()

        yield from record_batches(rows(), (id_col, "n_bytes", "samples"), (pa.int64(), pa.int64(), pa.binary()))

    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` long, n_bytes long, samples binary")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Every text is stored and read back within its task; the same text next to another in a group is stored once.
    """

    def digests(texts):
        medias = stored([payload(t) for t in texts])
        for text, media, samples in zip(texts, medias, samples_of(medias)):
            data = samples.tobytes()
            n = len(text.encode("utf-8", "surrogatepass"))
            yield n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    def run(batches):
        def rows():
            for group in in_groups(rows_of(batches, "id", "text"), lambda r: len(r[1]), 4 << 20):
                texts = list(dict.fromkeys(t for _, t in group))
                found = dict(zip(texts, digests(texts)))
                for doc, text in group:
                    yield doc, *found[text]

        yield from record_batches(rows(), names, types)

    names = (id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    schema = f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return text_rows(df, id_col, text_col).mapInArrow(run, schema)
