"""Residuals of integer values in the order in which they are coded: difference, parallelogram and averages of parallelograms over a mesh, and the transforms that keep residuals small.
Values are rows of integers; every function has its inverse."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tessera.operators.corner_table import NONE, after, before

#: Ids of predictors and transforms in a stream.
NO_PREDICTOR, DIFFERENCE, PARALLELOGRAM, MULTI_PARALLELOGRAM = -2, 0, 1, 2
WRAP, OCTAHEDRON = 1, 3
MAX_PARALLELOGRAMS = 4


def int_sqrt(n: int) -> int:
    """The greatest integer whose square is at most n."""
    return math.isqrt(n)


@dataclass(frozen=True)
class Wrap:
    """Residuals within the width of the values, low to high; predictions are clamped to it first."""

    low: int
    high: int

    @classmethod
    def of(cls, values: np.ndarray) -> Wrap:
        return cls(int(values.min()), int(values.max())) if values.size else cls(0, 0)

    def encode(self, value: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        width = 1 + self.high - self.low
        r = value - np.clip(predicted, self.low, self.high)
        top = width // 2 - (width % 2 == 0)
        return np.where(r < -(width // 2), r + width, np.where(r > top, r - width, r))

    def decode(self, residual: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        width = 1 + self.high - self.low
        v = np.clip(predicted, self.low, self.high) + residual
        return np.where(v > self.high, v - width, np.where(v < self.low, v + width, v))


@dataclass(frozen=True)
class Octahedron:
    """Residuals of octahedral normals of so many bits: the square is turned so that the prediction lies in the inner diamond and in its bottom left quarter; residuals are natural numbers."""

    bits: int

    @property
    def width(self) -> int:
        return (1 << self.bits) - 1

    @property
    def center(self) -> int:
        return (self.width - 1) // 2

    def in_diamond(self, s: int, t: int) -> bool:
        return abs(s) + abs(t) <= self.center

    def inverted(self, s: int, t: int) -> tuple[int, int]:
        """The other side of the diamond's edge in the same quarter; its own inverse."""
        if s >= 0 and t >= 0:
            a = b = 1
        elif s <= 0 and t <= 0:
            a = b = -1
        else:
            a, b = (1 if s > 0 else -1), (1 if t > 0 else -1)
        x, y = 2 * s - a * self.center, 2 * t - b * self.center
        x, y = (-y, -x) if a * b > 0 else (y, x)
        half = lambda v: int(v / 2)  # toward zero
        return half(x + a * self.center), half(y + b * self.center)

    @staticmethod
    def in_bottom_left(s: int, t: int) -> bool:
        return (s == 0 and t == 0) or (s < 0 and t <= 0)

    @staticmethod
    def turns(s: int, t: int) -> int:
        """Quarter turns that bring a point to the bottom left."""
        if s == 0:
            return 0 if t == 0 else 3 if t > 0 else 1
        if s > 0:
            return 2 if t >= 0 else 1
        return 0 if t <= 0 else 3

    @staticmethod
    def turned(s: int, t: int, n: int) -> tuple[int, int]:
        return ((s, t), (t, -s), (-s, -t), (-t, s))[n % 4]

    def mod_max(self, x: int) -> int:
        return x - self.width if x > self.center else x + self.width if x < -self.center else x

    def make_positive(self, x: int) -> int:
        return x + self.width if x < 0 else x

    def _placed(self, predicted: tuple[int, int]) -> tuple[int, int, bool, int]:
        s, t = (int(x) - self.center for x in predicted)
        outside = not self.in_diamond(s, t)
        if outside:
            s, t = self.inverted(s, t)
        n = 0 if self.in_bottom_left(s, t) else self.turns(s, t)
        return (*self.turned(s, t, n), outside, n)

    def encode(self, value, predicted) -> tuple[int, int]:
        ps, pt, outside, n = self._placed(predicted)
        s, t = (int(x) - self.center for x in value)
        if outside:
            s, t = self.inverted(s, t)
        s, t = self.turned(s, t, n)
        return self.make_positive(s - ps), self.make_positive(t - pt)

    def decode(self, residual, predicted) -> tuple[int, int]:
        ps, pt, outside, n = self._placed(predicted)
        s, t = self.turned(self.mod_max(int(residual[0]) + ps), self.mod_max(int(residual[1]) + pt), -n)
        if outside:
            s, t = self.inverted(s, t)
        return s + self.center, t + self.center


def canonical_vector(x: int, y: int, z: int, center: int) -> tuple[int, int, int]:
    """An integer vector scaled so that its absolute values add up to center; no length becomes (center, 0, 0)."""
    total = abs(x) + abs(y) + abs(z)
    if not total:
        return center, 0, 0
    a, b = (int(v * center / total) if abs(v * center) < 1 << 52 else (abs(v) * center // total) * (1 if v > 0 else -1) for v in (x, y))
    c = center - abs(a) - abs(b)
    return a, b, c if z >= 0 else -c


@dataclass(frozen=True)
class MeshOrder:
    """Connectivity of the values: the corner of each value and the place of each vertex, as edge_walk.visits gives them."""

    vertex: list[int]
    opposite: list[int]
    corners: list[int]
    place: list[int]

    def parallelogram(self, i: int, corner: int) -> tuple[int, int, int] | None:
        """(next, previous, far): values whose sum of the first two less the third predicts value i across the edge of one of its corners, if all three come before it."""
        o = self.opposite[corner]
        if o == NONE:
            return None
        far, a, b = (self.place[self.vertex[c]] for c in (o, after(o), before(o)))
        return (a, b, far) if all(0 <= x < i for x in (a, b, far)) else None

    @cached_property
    def plan(self) -> list[tuple[int, int, int] | None]:
        """The parallelogram of each value, as _guess takes it."""
        return [self.parallelogram(i, c) if i else None for i, c in enumerate(self.corners)]

    def ring(self, corner: int):
        """Corners at the vertex of a corner: to the right until the border, and then to the left of it."""
        c = corner
        while c != NONE:
            yield c
            o = self.opposite[before(c)]
            c = NONE if o == NONE else before(o)
            if c == corner:
                return
        c = corner
        while (o := self.opposite[after(c)]) != NONE:
            c = after(o)
            yield c

    def parallelograms(self, i: int) -> list[tuple[int, int, int]]:
        return [p for c in self.ring(self.corners[i]) if (p := self.parallelogram(i, c))]


def _toward_zero(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def texcoord_guesses(i: int, order: MeshOrder, uv, positions) -> tuple[tuple[int, int], tuple[int, int] | None]:
    """Predictions of the texture coordinates i from those of its face's other two corners, with the face's shape kept: two, one on either side of the edge, or one where nothing tells more. All
    in integers. positions: those of the same places."""
    c = order.corners[i]
    a, b = order.place[order.vertex[after(c)]], order.place[order.vertex[before(c)]]
    get = lambda j: tuple(int(x) for x in uv[j])
    if 0 <= a < i and 0 <= b < i:
        ua, ub = get(a), get(b)
        if ua == ub:
            return ub, None
        tip, pa, pb = ([int(x) for x in positions[j]] for j in (i, a, b))
        edge = [y - x for x, y in zip(pa, pb, strict=True)]
        length = sum(x * x for x in edge)
        if length:
            along = sum(x * (t - y) for x, t, y in zip(edge, tip, pa, strict=True))
            foot = [y + _toward_zero(x * along, length) for x, y in zip(edge, pa, strict=True)]
            height = int_sqrt(sum((t - x) ** 2 for t, x in zip(tip, foot, strict=True)) * length)
            du, dv = ub[0] - ua[0], ub[1] - ua[1]
            u, v = ua[0] * length + along * du, ua[1] * length + along * dv
            side = lambda sign: (_toward_zero(u + sign * dv * height, length), _toward_zero(v - sign * du * height, length))
            return side(1), side(-1)
    return (get(a) if 0 <= a < i else get(i - 1) if i else (0, 0)), None


def texcoord_residuals(uv: np.ndarray, positions: np.ndarray, order: MeshOrder) -> tuple[np.ndarray, list[bool]]:
    """Wrapped residuals, and for each place with two predictions whether the first was taken, the nearer one."""
    wrap, guesses, sides = Wrap.of(uv), [], []
    for i in range(len(uv)):
        one, other = texcoord_guesses(i, order, uv, positions)
        if other is not None:
            far = lambda g, i=i: sum((int(x) - y) ** 2 for x, y in zip(uv[i], g, strict=True))
            sides.append(far(one) < far(other))
            one = one if sides[-1] else other
        guesses.append(one)
    return wrap.encode(uv.astype(np.int64), np.array(guesses, np.int64).reshape(-1, 2)), sides


def texcoords_restored(coded: np.ndarray, positions: np.ndarray, order: MeshOrder, wrap: Wrap, sides: list[bool]) -> np.ndarray:
    out, left = np.zeros((len(coded), 2), np.int64), iter(sides)
    for i in range(len(coded)):
        one, other = texcoord_guesses(i, order, out, positions)
        guess = one if other is None or next(left) else other
        out[i] = wrap.decode(coded[i], np.array(guess))
    return out


#: A sum of cross products is scaled down beyond this.
NORMAL_LIMIT = 1 << 29


def face_normal(order: MeshOrder, positions: np.ndarray, i: int) -> tuple[int, int, int]:
    """Sum of the cross products of the faces around a place, so that larger faces weigh more, scaled to stay within NORMAL_LIMIT."""
    at = lambda c: positions[order.place[order.vertex[c]]].astype(object)
    total, middle = [0, 0, 0], positions[i].astype(object)
    for c in order.ring(order.corners[i]):
        u, w = at(after(c)) - middle, at(before(c)) - middle
        for k in range(3):
            total[k] += int(u[(k + 1) % 3] * w[(k + 2) % 3] - u[(k + 2) % 3] * w[(k + 1) % 3])
    size = sum(map(abs, total))
    if size > NORMAL_LIMIT:
        by = size // NORMAL_LIMIT
        total = [_toward_zero(x, by) for x in total]
    return tuple(total)


def vector_octahedral(vector: tuple[int, int, int], bits: int) -> tuple[int, int]:
    """An integer vector as octahedral (s, t), canonical."""
    center = (1 << (bits - 1)) - 1
    return tuple(octahedral(np.array([canonical_vector(*vector, center)], float) / center, bits)[0].tolist())


def geometric_normal_residuals(st: np.ndarray, positions: np.ndarray, order: MeshOrder, bits: int) -> tuple[np.ndarray, list[bool]]:
    """Residuals of normals against the surface's own, and whether that was turned around, which it is where the residual gets smaller."""
    o, out, flips = Octahedron(bits), [], []
    for i, v in enumerate(st):
        n = face_normal(order, positions, i)
        both = [o.encode(v, vector_octahedral(tuple(sign * x for x in n), bits)) for sign in (1, -1)]
        size = [sum(abs(o.mod_max(x)) for x in r) for r in both]
        flips.append(size[1] < size[0])
        out.append(both[flips[-1]])
    return np.array(out, np.int64).reshape(-1, 2), flips


def geometric_normals_restored(coded: np.ndarray, positions: np.ndarray, order: MeshOrder, bits: int, flips: list[bool]) -> np.ndarray:
    o = Octahedron(bits)
    guess = lambda i: vector_octahedral(tuple((-1 if flips[i] else 1) * x for x in face_normal(order, positions, i)), bits)
    return np.array([o.decode(r, guess(i)) for i, r in enumerate(coded)], np.int64).reshape(-1, 2)


class Tracker:
    """Symbols so far, and what an ideal coder takes for them."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.n, self.sum = 0, 0.0

    def bits(self, more: list[int] = ()) -> int:
        """With more symbols, which are not kept."""
        extra: dict[int, int] = {}
        for x in more:
            extra[x] = extra.get(x, 0) + 1
        xlog = lambda k: k * math.log2(k) if k else 0.0
        total = self.sum + sum(xlog(self.counts.get(x, 0) + k) - xlog(self.counts.get(x, 0)) for x, k in extra.items())
        return math.ceil(round(xlog(self.n + len(more)) - total, 6))

    def push(self, more: list[int]) -> None:
        for x in more:
            k = self.counts.get(x, 0)
            self.sum += (k + 1) * math.log2(k + 1) - (k * math.log2(k) if k else 0.0)
            self.counts[x], self.n = k + 1, self.n + 1


def constrained_residuals(values: np.ndarray, order: MeshOrder) -> tuple[np.ndarray, list[list[bool]]]:
    """Residuals against the average of the best choice of up to MAX_PARALLELOGRAMS parallelograms, and for each number of them the flags of those left out, by place. The choice is the one of fewest bits, of
    residuals as all so far are coded and of its flags; then the one of the least residuals."""
    values = values.astype(np.int64)
    wrap, tracker = Wrap.of(values), Tracker()
    flags: list[list[bool]] = [[] for _ in range(MAX_PARALLELOGRAMS)]
    left_out, all_flags = [0] * MAX_PARALLELOGRAMS, [0] * MAX_PARALLELOGRAMS
    out = np.zeros_like(values)
    for i in range(len(values)):
        ps = order.parallelograms(i)[:MAX_PARALLELOGRAMS] if i else []
        tries = [((), values[i - 1] if i else np.zeros_like(values[0]))] if i or not ps else []
        guesses = [values[a] + values[b] - values[far] for a, b, far in ps]
        for choice in range(1, 1 << len(ps)):
            used = tuple(k for k in range(len(ps)) if choice >> k & 1)
            tries.append((used, _average([guesses[k] for k in used])))
        scored = []
        for used, guess in tries:
            r = wrap.encode(values[i], guess)
            symbols = [int(2 * x if x >= 0 else -2 * x - 1) for x in r]
            cost = tracker.bits(symbols)
            if ps:
                k, n = left_out[len(ps) - 1] + len(ps) - len(used), all_flags[len(ps) - 1] + len(ps)
                p = k / n
                cost += math.ceil(0 if p in (0, 1) else -n * (p * math.log2(p) + (1 - p) * math.log2(1 - p)))
            scored.append((cost, int(np.abs(r).sum()), used, r, symbols))
        _, _, used, r, symbols = min(scored, key=lambda x: x[:2])
        tracker.push(symbols)
        if ps:
            flags[len(ps) - 1] += [k not in used for k in range(len(ps))]
            left_out[len(ps) - 1] += len(ps) - len(used)
            all_flags[len(ps) - 1] += len(ps)
        out[i] = r
    return out, flags


def _average(guesses: list) -> np.ndarray:
    return np.array([_toward_zero(int(x), len(guesses)) for x in sum(guesses)], np.int64)


def constrained_restored(coded: np.ndarray, order: MeshOrder, wrap: Wrap, flags: list[list[bool]]) -> np.ndarray:
    out, left = np.zeros_like(coded.astype(np.int64)), [iter(x) for x in flags]
    for i in range(len(coded)):
        ps = order.parallelograms(i)[:MAX_PARALLELOGRAMS] if i else []
        used = [p for p in ps if not next(left[len(ps) - 1])]
        guess = _average([out[a] + out[b] - out[far] for a, b, far in used]) if used else out[i - 1] if i else np.zeros_like(out[0])
        out[i] = wrap.decode(coded[i], guess)
    return out


def _guess(method: int, order: MeshOrder | None, values: np.ndarray, i: int) -> np.ndarray:
    """The prediction of value i from those before it: the fallback is the value before, and 0 for the first."""
    if i and method == PARALLELOGRAM and (p := order.parallelogram(i, order.corners[i])):
        return values[p[0]] + values[p[1]] - values[p[2]]
    if i and method == MULTI_PARALLELOGRAM and (ps := order.parallelograms(i)):
        total = sum(values[a] + values[b] - values[far] for a, b, far in ps)
        return np.array([int(x / len(ps)) if abs(x) < 1 << 50 else x // len(ps) for x in total.tolist()], np.int64)
    return values[i - 1] if i else np.zeros_like(values[0])


def residuals(values: np.ndarray, method: int, transform: Wrap, order: MeshOrder | None = None) -> np.ndarray:
    values = values.astype(np.int64)
    if method == NO_PREDICTOR or not len(values):
        return values
    if method == DIFFERENCE:
        guesses = np.concatenate([np.zeros_like(values[:1]), values[:-1]])
    else:
        guesses = np.array([_guess(method, order, values, i) for i in range(len(values))])
    return transform.encode(values, guesses)


def restored(coded: np.ndarray, method: int, transform: Wrap, order: MeshOrder | None = None) -> np.ndarray:
    coded = coded.astype(np.int64)
    if method == NO_PREDICTOR or not len(coded):
        return coded
    if method == DIFFERENCE:
        # in closed form: the running sum, modulo the width
        width = 1 + transform.high - transform.low
        first = min(max(0, transform.low), transform.high)
        return transform.low + (first + np.cumsum(coded, 0) - transform.low) % width
    out = np.zeros_like(coded)
    for i in range(len(coded)):
        out[i] = transform.decode(coded[i], _guess(method, order, out, i))
    return out


#: Up to so many rows plain numbers are faster than arrays.
SMALL = 64


def small_residuals(rows: list[list[int]], method: int, wrap: Wrap, order: MeshOrder | None) -> list[int]:
    """residuals of a few rows by difference or parallelogram, all in one list."""
    low, high = wrap.low, wrap.high
    width = 1 + high - low
    least, top = -(width // 2), width // 2 - (width % 2 == 0)
    plan = order.plan if method == PARALLELOGRAM else [None] * len(rows)
    guess, out = [0] * len(rows[0]), []
    for row, p in zip(rows, plan, strict=True):
        if p:
            guess = [a + b - far for a, b, far in zip(rows[p[0]], rows[p[1]], rows[p[2]], strict=True)]
        for v, g in zip(row, guess, strict=True):
            r = v - (low if g < low else high if g > high else g)
            out.append(r + width if r < least else r - width if r > top else r)
        guess = row
    return out


def small_restored(coded: list[int], components: int, method: int, wrap: Wrap, order: MeshOrder | None) -> list[list[int]]:
    """restored of a few rows, which come in one list."""
    low, high = wrap.low, wrap.high
    width = 1 + high - low
    if method == DIFFERENCE:
        sums, out = [min(max(0, low), high) - low] * components, []
        for i in range(0, len(coded), components):
            sums = [x + r for x, r in zip(sums, coded[i : i + components], strict=True)]
            out.append([low + x % width for x in sums])
        return out
    guess, out = [0] * components, []
    for p, i in zip(order.plan, range(0, len(coded), components), strict=True):
        if p:
            guess = [a + b - far for a, b, far in zip(out[p[0]], out[p[1]], out[p[2]], strict=True)]
        row = []
        for r, g in zip(coded[i : i + components], guess, strict=True):
            v = (low if g < low else high if g > high else g) + r
            row.append(v - width if v > high else v + width if v < low else v)
        out.append(row)
        guess = row
    return out


def normal_residuals(st: np.ndarray, transform: Octahedron) -> np.ndarray:
    return np.array([transform.encode(v, st[i - 1] if i else (0, 0)) for i, v in enumerate(st)], np.int64).reshape(-1, 2)


def normals_restored(coded: np.ndarray, transform: Octahedron) -> np.ndarray:
    out = np.zeros((len(coded), 2), np.int64)
    for i, r in enumerate(coded):
        out[i] = transform.decode(r, out[i - 1] if i else (0, 0))
    return out


def octahedral(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Unit vectors to octahedral (s, t), canonical."""
    center = (1 << (bits - 1)) - 1
    v = np.asarray(vectors, np.float64).reshape(-1, 3)
    norm = np.abs(v).sum(1)
    v = np.where(norm[:, None] > 1e-6, v / np.maximum(norm, 1e-300)[:, None], [1.0, 0.0, 0.0])
    a, b = np.floor(v[:, 0] * center + 0.5).astype(np.int64), np.floor(v[:, 1] * center + 0.5).astype(np.int64)
    c = center - np.abs(a) - np.abs(b)
    b = np.where(c < 0, np.where(b > 0, b + c, b - c), b)
    c = np.maximum(c, 0) * np.where(v[:, 2] < 0, -1, 1)
    top = 2 * center
    s = np.where(a >= 0, b + center, np.where(b < 0, np.abs(c), top - np.abs(c)))
    t = np.where(a >= 0, c + center, np.where(c < 0, np.abs(b), top - np.abs(b)))
    corner = ((s == 0) & (t == 0)) | ((s == 0) & (t == top)) | ((s == top) & (t == 0))
    s2 = np.where(corner, top, np.where(((t == top) & (s < center)) | ((t == 0) & (s > center)), top - s, s))
    t2 = np.where(corner, top, np.where(((s == 0) & (t > center)) | ((s == top) & (t < center)), top - t, t))
    return np.stack([s2, t2], 1)


def octahedral_vectors(st: np.ndarray, bits: int) -> np.ndarray:
    y, z = (np.asarray(st, np.float64).reshape(-1, 2) * (2.0 / ((1 << bits) - 2)) - 1).T
    x = 1 - np.abs(y) - np.abs(z)
    fold = np.maximum(0, -x)
    v = np.stack([x, y + np.where(y < 0, fold, -fold), z + np.where(z < 0, fold, -fold)], 1)
    norm = (v * v).sum(1)
    return np.where(norm[:, None] < 1e-6, 0.0, v / np.sqrt(np.maximum(norm, 1e-12))[:, None])
