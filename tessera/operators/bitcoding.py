"""Byte-exact coders of compressed streams: asymmetric numeral systems for symbols and bits, plain and folded bits, the choice between tagged and raw symbols,
and the tree coder for integer points. Each call codes one sequence; over tables they run in Arrow batches, many sequences to a batch.

Tables of probabilities add up to a power of two. A coder's bytes are read from the end: the last one tells by its upper two bits how many bytes the state has.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np

#: Fixed values of the layout: states of the symbol coder start at 4 times the table's size, those of the bit coder at 4096; 18 bits is the most a raw symbol has.
BIT_BASE, MAX_RAW_BITS, TAG_PRECISION, MAX_RUN = 4096, 18, 12, 64
TAGGED, RAW = 0, 1


#: Up to so many symbols, and in tables of so many, probabilities are kept by their counts or bytes, of the last KEPT tables.
SMALL, SMALL_TABLE, KEPT = 512, 64, 8192
_LAYOUTS = {k: struct.Struct("<" + k) for k in "bBhHiIqQf"}


class StreamError(ValueError):
    pass


class Reader:
    """A place in bytes; reading beyond the end is an error."""

    def __init__(self, data: bytes, version: tuple[int, int] = (2, 2)):
        self.data, self.at, self.version = data, 0, version

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise StreamError(f"{n} bytes at {self.at} are beyond the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str):
        layout = _LAYOUTS[kind]
        return layout.unpack(self.take(layout.size))[0]

    def varint(self) -> int:
        if self.at < len(self.data) and (b := self.data[self.at]) < 128:
            self.at += 1
            return b
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7
            if shift > 63:
                raise StreamError("a varint of more than nine bytes")

    def signed_varint(self) -> int:
        return unzigzag(self.varint())


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def zigzag(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def unzigzag(u: int) -> int:
    return u >> 1 if u & 1 == 0 else -(u >> 1) - 1


def signed_varint(v: int) -> bytes:
    return varint(zigzag(v))


# --- state of a coder


def closed(state: int, base: int) -> bytes:
    """The last bytes: what the state is above its base, with the number of bytes less one in the top bits of the last."""
    left = state - base
    for extra in range(4):
        if left < 1 << (6 + 8 * extra):
            body = left | extra << (6 + 8 * extra)
            return body.to_bytes(extra + 1, "little")
    raise StreamError("the state is too large")


def opened(data: bytes, base: int) -> tuple[int, int]:
    """The state, and how many bytes are left before it."""
    if not data:
        raise StreamError("no state")
    extra = data[-1] >> 6
    if len(data) < extra + 1:
        raise StreamError("a state of too few bytes")
    body = int.from_bytes(data[len(data) - extra - 1 :], "little")
    return (body & ((1 << (6 + 8 * extra)) - 1)) + base, len(data) - extra - 1


# --- symbols


def shares(counts: list[int], precision: int) -> list[int]:
    """Counts scaled to add up to 2^precision, each that occurs at least 1. What rounding leaves goes to the largest; what it takes too much is taken from the largest on,
    in proportion, as often as it needs."""
    whole, total = 1 << precision, sum(counts)
    if not total or sum(c > 0 for c in counts) > whole:
        raise StreamError("no symbols, or more than the table holds")
    p = [max(int(c / total * whole + 0.5), 1) if c else 0 for c in counts]
    over = sum(p) - whole
    order = sorted(range(len(p)), key=p.__getitem__)
    if over < 0:
        p[order[-1]] -= over
    while over > 0:
        scale = whole / (whole + over)
        for i in reversed(order[1:]):
            if p[i] <= 1 or not over:
                break
            cut = min(max(p[i] - math.floor(scale * p[i]), 1), p[i] - 1, over)
            p[i] -= cut
            over -= cut
    return p


def table_bytes(p: list[int], version: tuple[int, int]) -> bytes:
    """The number of symbols and the table: two low bits tell how many bytes a probability has beyond its first, or (3) that the other six count a run of unused symbols."""
    out = bytearray(struct.pack("<I", len(p)) if version < (2, 0) else varint(len(p)))
    i = 0
    while i < len(p):
        if p[i]:
            extra = 0 if p[i] < 1 << 6 else 1 if p[i] < 1 << 14 else 2
            out += (p[i] << 2 | extra).to_bytes(extra + 1, "little")
            i += 1
            continue
        run = 1
        while run < MAX_RUN and i + run < len(p) and not p[i + run]:
            run += 1
        out.append(run - 1 << 2 | 3)
        i += run
    return bytes(out)


def read_table(r: Reader) -> list[int]:
    n = r.number("I") if r.version < (2, 0) else r.varint()
    if n > MAX_RUN * max(1, len(r.data) - r.at):
        raise StreamError("a table larger than its bytes can say")
    p: list[int] = []
    while len(p) < n:
        b = r.take(1)[0]
        if b & 3 == 3:
            p += [0] * ((b >> 2) + 1)
        else:
            p.append((b | int.from_bytes(r.take(b & 3), "little") << 8) >> 2)
    if len(p) != n:
        raise StreamError("a run of unused symbols beyond the table")
    return p


def _starts(p: list[int]) -> list[int]:
    return list(accumulate(p, initial=0))


def _table(counts, precision: int, version: tuple[int, int]) -> tuple[list[int], list[int], bytes]:
    """Probabilities, where they start, and the table's bytes."""
    p = shares(list(counts), precision)
    return p, _starts(p), table_bytes(p, version)


_kept_table = lru_cache(KEPT)(_table)


def coded(symbols, counts: list[int], precision: int, version: tuple[int, int]) -> bytes:
    """Table, size and bytes of symbols."""
    p, starts, table = _kept_table(tuple(counts), precision, version) if len(counts) <= SMALL_TABLE else _table(counts, precision, version)
    base = 4 << precision
    state, body = base, bytearray()
    for s in reversed(symbols):
        own = p[s]
        limit = 1024 * own
        while state >= limit:
            body.append(state & 255)
            state >>= 8
        state = (state // own << precision) + state % own + starts[s]
    body += closed(state, base)
    size = struct.pack("<Q", len(body)) if version < (2, 0) else varint(len(body))
    return table + size + bytes(body)


def _table_end(data: bytes, at: int) -> int | None:
    """Where a small table (of version 2.0 on) ends, or None if it is not small, or cut."""
    last = len(data)
    if at >= last or (n := data[at]) > SMALL_TABLE:
        return None
    at, have = at + 1, 0
    while have < n:
        if at >= last:
            return None
        b = data[at]
        if b & 3 == 3:
            at, have = at + 1, have + (b >> 2) + 1
        else:
            at, have = at + 1 + (b & 3), have + 1
    return at if at <= last else None


@lru_cache(KEPT)
def _read_kept(table: bytes) -> tuple[list[int], list[int]]:
    p = read_table(Reader(table))
    return p, _starts(p)


class SymbolReader:
    def __init__(self, r: Reader, precision: int):
        end = _table_end(r.data, r.at) if r.version >= (2, 0) else None
        if end is None:
            p = read_table(r)
            starts = _starts(p)
        else:
            p, starts = _read_kept(bytes(r.data[r.at : end]))
            r.at = end
        data = r.take(r.number("Q") if r.version < (2, 0) else r.varint())
        self.p, self.precision, self.one = p, precision, len(p) <= 1
        if not p:
            return
        if starts[-1] != 1 << precision:
            raise StreamError("probabilities that do not fill the table")
        self.starts = starts
        if not self.one:
            self.data, self.base = data, 4 << precision
            self.state, self.left = opened(data, self.base)

    def run(self, n: int) -> list[int]:
        if self.one:
            return [0] * n
        out, mask, k = [], (1 << self.precision) - 1, self.precision
        state, left, data, base, p, starts = self.state, self.left, self.data, self.base, self.p, self.starts
        lookup = np.repeat(np.arange(len(p)), p).tolist() if n > SMALL else None
        for _ in range(n):
            while state < base and left:
                left -= 1
                state = state << 8 | data[left]
            rest = state & mask
            s = lookup[rest] if lookup else bisect_right(starts, rest) - 1
            out.append(s)
            state = (state >> k) * p[s] + rest - starts[s]
        self.state, self.left = state, left
        return out


def entropy_bits(counts) -> int:
    """Bits of an ideal coder, truncated."""
    counts = tuple(c for c in counts if c)
    return _kept_bits(counts) if len(counts) <= SMALL_TABLE else _entropy_bits(counts)


def _entropy_bits(counts: tuple[int, ...]) -> int:
    n = np.array(counts, float)
    return int(-(n * (np.log2(n) - math.log2(n.sum()))).sum()) if len(n) else 0


_kept_bits = lru_cache(KEPT)(_entropy_bits)


def _table_estimate(most: int, unique: int) -> int:
    return 8 * unique + 8 * (unique + max(0, most - unique) // 64)


def scheme_bits(symbols: list[int], components: int) -> tuple[int, int, list[int]]:
    """Estimated bits of the tagged and of the raw scheme, and the bit length of each chunk of so many symbols."""
    lengths = [max(1, max(symbols[i : i + components]).bit_length()) for i in range(0, len(symbols), components)]
    tags, values = Counter(lengths), Counter(symbols)
    tagged = components * sum(lengths) + entropy_bits(tags[k] for k in sorted(tags)) + _table_estimate(len(tags), len(tags))
    raw = entropy_bits(values[k] for k in sorted(values)) + _table_estimate(max(symbols), len(values))
    return tagged, raw, lengths


def raw_bits(unique: int, level: int) -> int:
    """What sizes the table of raw symbols: the bits of their number, a few more or less by the compression level."""
    more = -2 if level < 4 else -1 if level < 6 else 2 if level > 9 else 1 if level > 7 else 0
    return min(18, max(1, unique.bit_length() + more))


def precision_of(bits: int) -> int:
    return min(20, max(12, 3 * bits // 2))


def encode_symbols(symbols: list[int], components: int = 1, level: int = 7, version: tuple[int, int] = (2, 2)) -> bytes:
    """Symbols (natural numbers) in chunks of components by the cheaper scheme; nothing for no symbols."""
    if not symbols:
        return b""
    tagged, raw, lengths = scheme_bits(symbols, components)
    if max(symbols).bit_length() > MAX_RAW_BITS or tagged < raw:
        tags = [0] * 33
        for size in lengths:
            tags[size] += 1
        values = bytearray()
        held = n = 0
        for i, size in enumerate(lengths):
            for v in symbols[i * components : (i + 1) * components]:
                held |= v << n
                n += size
                while n >= 8:
                    values.append(held & 255)
                    held, n = held >> 8, n - 8
        if n:
            values.append(held)
        return bytes([TAGGED]) + coded(lengths, tags, TAG_PRECISION, version) + bytes(values)
    of = Counter(symbols)
    bits = raw_bits(len(of), level)
    return bytes([RAW, bits]) + coded(symbols, [of[k] for k in range(max(of) + 1)], precision_of(bits), version)


def decode_symbols(r: Reader, n: int, components: int = 1) -> list[int]:
    if not n:
        return []
    if components < 1 or n % components:
        raise StreamError("symbols that do not fill their chunks")
    scheme = r.take(1)[0]
    if scheme % 2 == RAW and scheme < 4:
        bits = r.take(1)[0]
        return SymbolReader(r, precision_of(bits)).run(n) if bits else [0] * n
    if scheme % 2 != TAGGED or scheme > 3:
        raise StreamError(f"symbol scheme {scheme}")
    lengths = SymbolReader(r, TAG_PRECISION).run(n // components)
    if any(not 1 <= k <= 32 for k in lengths):
        raise StreamError("a bit length beyond 32")
    data = r.take(-(-components * sum(lengths) // 8))
    out, held, have, at = [], 0, 0, 0
    for size in lengths:
        for _ in range(components):
            while have < size:
                held |= data[at] << have
                at, have = at + 1, have + 8
            out.append(held & ((1 << size) - 1))
            held, have = held >> size, have - size
    return out


# --- bits


def encode_bits(bits: list[int], version: tuple[int, int] = (2, 2)) -> bytes:
    """Bits under one probability: that of 0 in 256ths, size, bytes."""
    zeros = bits.count(0)
    p0 = max(1, min(255, int(zeros / max(1, len(bits)) * 256 + 0.5)))
    p1 = 256 - p0
    state, body = BIT_BASE, bytearray()
    for bit in reversed(bits):
        own = p1 if bit else p0
        if state >= 4096 * own:
            body.append(state & 255)
            state >>= 8
        state = (state // own << 8) + state % own + (0 if bit else p1)
    body += closed(state, BIT_BASE)
    return bytes([p0]) + (struct.pack("<I", len(body)) if version < (2, 2) else varint(len(body))) + bytes(body)


class BitReader:
    def __init__(self, r: Reader):
        self.p1 = 256 - r.take(1)[0]
        self.data = r.take(r.number("I") if r.version < (2, 2) else r.varint())
        self.state, self.left = opened(self.data, BIT_BASE)

    def bit(self) -> int:
        if self.state < BIT_BASE and self.left:
            self.left -= 1
            self.state = self.state << 8 | self.data[self.left]
        whole, rest = self.state >> 8, self.state & 255
        if rest < self.p1:
            self.state = whole * self.p1 + rest
            return 1
        self.state -= whole * self.p1 + self.p1
        return 0

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v


def number_bits(value: int, n: int) -> list[int]:
    """The n lowest bits of a number, the highest of them first."""
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


def direct_bytes(bits: list[int]) -> bytes:
    """Bits as they stand, from the top of 32-bit words on; a word more than needed where they fill the last."""
    words = len(bits) // 32 + 1
    packed = np.packbits(np.array(bits + [0] * (32 * words - len(bits)), np.uint8)).view(">u4").astype("<u4").tobytes()
    return struct.pack("<I", len(packed)) + packed


class DirectReader:
    def __init__(self, r: Reader):
        size = r.number("I")
        if size % 4 or not size:
            raise StreamError("bits that fill no words")
        self.all = np.unpackbits(np.frombuffer(r.take(size), "<u4").astype(">u4").view(np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        return self.bits(1)

    def bits(self, n: int) -> int:
        if self.at + n > len(self.all):
            raise StreamError("bits beyond the end")
        v = 0
        for b in self.all[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v


class DirectWriter:
    def __init__(self):
        self.all: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.all += number_bits(value, n)

    def bytes(self, version: tuple[int, int]) -> bytes:
        return direct_bytes(self.all)


class EntropyWriter(DirectWriter):
    """The same bits under one probability."""

    def bytes(self, version: tuple[int, int]) -> bytes:
        return encode_bits(self.all, version)


class FoldedWriter:
    """Numbers with a probability for each of their 32 leading places; single bits apart."""

    def __init__(self):
        self.places: list[list[int]] = [[] for _ in range(32)]
        self.single: list[int] = []

    def put(self, value: int, n: int) -> None:
        for place, bit in zip(self.places, number_bits(value, n), strict=False):
            place.append(bit)

    def bytes(self, version: tuple[int, int]) -> bytes:
        return b"".join(encode_bits(x, version) for x in [*self.places, self.single])


class FoldedReader:
    def __init__(self, r: Reader):
        self.places = [BitReader(r) for _ in range(32)]
        self.single = BitReader(r)

    def bits(self, n: int) -> int:
        v = 0
        for place in self.places[:n]:
            v = v << 1 | place.bit()
        return v


# --- integer points


def _number_coder(level: int, reading: bool):
    if level <= 1:
        return DirectReader if reading else DirectWriter
    return (BitReader if reading else EntropyWriter) if level <= 3 else (FoldedReader if reading else FoldedWriter)


def encode_points(points: np.ndarray, level: int, version: tuple[int, int] = (2, 3)) -> bytes:
    """Rows of natural numbers as a multiset: cells are halved, axis after axis, and each tells how far its halves are from equal. The order of rows is lost."""
    points = np.asarray(points, np.uint32)
    n, axes = points.shape
    bits = int(points.max()).bit_length() if points.size else 0
    head = struct.pack("<II", bits, n)
    if not n:
        return head
    numbers, rest, axis_bits, half = _number_coder(level, False)(), DirectWriter(), DirectWriter(), DirectWriter()
    stack = [(points, [0] * axes, [0] * axes, 0)]
    while stack:
        own, base, levels, last = stack.pop()
        if level != 6:
            axis = (last + 1) % axes
        elif len(own) < 64:
            axis = levels.index(min(levels))
        else:
            # the axis whose halves are the least equal, of those with bits left
            uneven = []
            for i in range(axes):
                left = bits - levels[i]
                below = int((own[:, i] < base[i] + (1 << (left - 1))).sum()) if left else 0
                uneven.append(max(below, len(own) - below) if left else 0)
            axis = uneven.index(max(uneven))
            axis_bits.put(axis, 4)
        left = bits - levels[axis]
        if not left:
            continue
        if len(own) <= 2:
            for p in own.tolist():
                for j in range(axes):
                    i = (axis + j) % axes
                    rest.put(p[i], bits - levels[i])
            continue
        split = base[axis] + (1 << (left - 1))
        upper = own[:, axis] >= split
        first, second = own[~upper], own[upper]
        if len(first) != len(second):
            half.put(len(first) < len(second), 1)
        numbers.put(len(own) // 2 - min(len(first), len(second)), len(own).bit_length() - 1)
        levels = [v + (i == axis) for i, v in enumerate(levels)]
        if len(first):
            stack.append((first, base, levels, axis))
        if len(second):
            stack.append((second, [split if i == axis else v for i, v in enumerate(base)], levels, axis))
    return head + b"".join(x.bytes(version) for x in (numbers, rest, axis_bits, half))


def decode_points(r: Reader, axes: int, level: int) -> np.ndarray:
    bits, n = r.number("I"), r.number("I")
    if bits > 32:
        raise StreamError("points of more than 32 bits")
    out: list[list[int]] = []
    if not n:
        return np.zeros((0, axes), np.uint32)
    if bits and n > 64 * len(r.data) * 32:
        raise StreamError("more points than the bytes can say")
    numbers, rest, axis_bits, half = _number_coder(level, True)(r), DirectReader(r), DirectReader(r), DirectReader(r)
    stack = [(n, [0] * axes, [0] * axes, 0)]
    while stack:
        own, base, levels, last = stack.pop()
        if level != 6:
            axis = (last + 1) % axes
        else:
            axis = levels.index(min(levels)) if own < 64 else axis_bits.bits(4)
        if axis >= axes:
            raise StreamError("an axis that the points do not have")
        left = bits - levels[axis]
        if not left:
            out += [base] * own
            continue
        if own <= 2:
            for _ in range(own):
                p = list(base)
                for j in range(axes):
                    i = (axis + j) % axes
                    p[i] = base[i] + rest.bits(bits - levels[i])
                out.append(p)
            continue
        first = own // 2 - numbers.bits(own.bit_length() - 1)
        if first < 0:
            raise StreamError("a half of less than no points")
        second = own - first
        if first != second and not half.bit():
            first, second = second, first
        levels = [v + (i == axis) for i, v in enumerate(levels)]
        if first:
            stack.append((first, base, levels, axis))
        if second:
            stack.append((second, [v + (1 << (left - 1)) if i == axis else v for i, v in enumerate(base)], levels, axis))
    return np.array(out, np.uint64).astype(np.uint32).reshape(-1, axes)
