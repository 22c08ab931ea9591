"""Compressed streams of meshes and point clouds, as bytes and as DataFrames: sequential and edge-walk meshes, sequential and tree-coded point clouds.

A stream begins with a word of five bytes, which the caller names (None: any), major and minor version, geometry, method and flags. A geometry is a Shape: faces and attributes, each with a
semantic kind, a value type and rows of values. Streams are lossless for integer attributes and for floats that are not quantized; tree coding loses the order of points, the edge walk
that of points and faces, and it drops flat faces and unused points.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import predictors as P
from tessera.operators.bitcoding import Reader, StreamError, decode_points, decode_symbols, encode_points, encode_symbols, signed_varint, unzigzag, varint
from tessera.operators.corner_table import CornerTable
from tessera.operators.edge_walk import Unwalked, visits, visits_by_degree, walk, walk_bytes

#: Fixed values of the format.
CLOUD, MESH_GEOMETRY = 0, 1
SEQUENTIAL, OTHER = 0, 1  # the other method of a cloud is tree coding, that of a mesh the edge walk
POSITION, NORMAL, COLOR, TEXCOORD, GENERIC = range(5)
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "i8", 8: "u8", 9: "f4", 10: "f8", 11: "?"}
CODES = {v: k for k, v in TYPES.items()}
RAW_VALUES, INTEGERS, QUANTIZED, NORMALS = range(4)
METADATA = 0x8000
HEADER = 11
MESH_VERSION, CLOUD_VERSION, TREE_VERSION = (2, 2), (1, 3), (2, 3)


@dataclass
class Attribute:
    kind: int
    values: np.ndarray  # rows of components
    normalized: bool = False
    unique_id: int = 0

    @property
    def code(self) -> int:
        return CODES[self.values.dtype.str[1:].replace("b1", "?")]


@dataclass
class Shape:
    faces: np.ndarray | None  # rows of three points; None for a cloud
    attributes: list[Attribute] = field(default_factory=list)

    @property
    def n_points(self) -> int:
        return len(self.attributes[0].values) if self.attributes else 0

    def first(self, kind: int) -> Attribute | None:
        """The first attribute of a kind."""
        return next((a for a in self.attributes if a.kind == kind), None)


@dataclass(frozen=True)
class Header:
    word: bytes
    major: int
    minor: int
    geometry: int
    method: int
    flags: int

    @property
    def has_metadata(self) -> bool:
        return bool(self.flags & METADATA)


def read_header(data: bytes, word: bytes | None = None) -> Header:
    if len(data) < HEADER or (word is not None and data[:5] != word):
        raise StreamError("no header of such a stream")
    return Header(data[:5], *struct.unpack_from("<4BH", data, 5))


def header_columns(content: str = "content") -> dict:
    """The header of a binary column as columns, without a call to Python."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 1)), 16, 10).cast("int")
    flags = number(10) + 256 * number(11)
    return {"word": F.substring(content, 1, 5), "major": number(6), "minor": number(7), "geometry": number(8), "method": number(9), "flags": flags, "has_metadata": flags >= METADATA}


# --- quantization


@dataclass(frozen=True)
class Quantization:
    low: tuple[float, ...]
    span: float
    bits: int

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> Quantization:
        """Least value of each component and the widest range of any (1 if that is 0). No values, or one that is not finite, are refused."""
        if not 1 <= bits <= 31:
            raise StreamError(f"{bits} bits")
        if not values.size or not np.isfinite(values).all():
            raise StreamError("values that are not finite, or none at all")
        low, high = values.min(0).astype("f4"), values.max(0).astype("f4")
        return cls(tuple(low.tolist()), float(np.float32((high - low).max())) or 1.0, bits)

    def encode(self, values: np.ndarray) -> np.ndarray:
        scale = np.float32((1 << self.bits) - 1) / np.float32(self.span)
        return np.floor((values.astype("f4") - np.array(self.low, "f4")) * scale + np.float32(0.5)).astype(np.int64)

    def decode(self, q: np.ndarray) -> np.ndarray:
        step = np.float32(self.span) / np.float32((1 << self.bits) - 1)
        return q.astype("f4") * step + np.array(self.low, "f4")

    def bytes(self) -> bytes:
        return struct.pack(f"<{len(self.low)}ffB", *self.low, self.span, self.bits)

    @classmethod
    def read(cls, r: Reader, components: int) -> Quantization:
        low = tuple(r.number("f") for _ in range(components))
        span, bits = r.number("f"), r.number("B")
        if not 1 <= bits <= 31:
            raise StreamError(f"{bits} bits")
        return cls(low, span, bits)


# --- integer values


def _integers(values: np.ndarray, method: int, order: P.MeshOrder | None, level: int, version: tuple[int, int]) -> bytes:
    if 0 < len(values) <= P.SMALL and values.shape[1]:
        rows = values.tolist()
        wrap = P.Wrap(min(map(min, rows)), max(map(max, rows)))
        symbols = [2 * r if r >= 0 else -2 * r - 1 for r in P.small_residuals(rows, method, wrap, order)]
    else:
        wrap = P.Wrap.of(values)
        r = P.residuals(values, method, wrap, order)
        symbols = np.where(r >= 0, 2 * r, -2 * r - 1).ravel().tolist()
    head = struct.pack("<bBB", method, P.WRAP, 1)
    return head + encode_symbols(symbols, values.shape[1], level, version) + struct.pack("<ii", wrap.low, wrap.high)


def _read_symbols(r: Reader, n: int, components: int) -> np.ndarray:
    if r.take(1)[0]:
        return np.array(decode_symbols(r, n * components, components), np.int64)
    return _read_raw(r, n, components)


def _read_raw(r: Reader, n: int, components: int) -> np.ndarray:
    width = r.take(1)[0]
    if width > 4:
        raise StreamError(f"raw integers of {width} bytes")
    raw = np.frombuffer(r.take(width * n * components), np.uint8).reshape(-1, width).astype(np.int64)
    return (raw << (8 * np.arange(width))).sum(1) if width else np.zeros(n * components, np.int64)


def _read_integers(r: Reader, n: int, components: int, order: P.MeshOrder | None) -> np.ndarray:
    method = r.number("b")
    if method in (P.NO_PREDICTOR, -1):
        coded, transform = _read_symbols(r, n, components), None
        return _unzigzag(coded).reshape(n, components)
    transform = r.number("b")
    if method not in (P.DIFFERENCE, P.PARALLELOGRAM, P.MULTI_PARALLELOGRAM) or transform != P.WRAP:
        raise StreamError(f"predictor {method} with transform {transform}")
    small = 0 < n <= P.SMALL and (not order or method != P.MULTI_PARALLELOGRAM)
    if not small:
        coded = _unzigzag(_read_symbols(r, n, components)).reshape(n, components)
    else:
        symbols = decode_symbols(r, n * components, components) if r.take(1)[0] else _read_raw(r, n, components).tolist()
    wrap = P.Wrap(r.number("i"), r.number("i"))
    if wrap.low > wrap.high:
        raise StreamError("bounds that hold nothing")
    method = method if order else P.DIFFERENCE
    if small:
        rows = P.small_restored([u >> 1 if u & 1 == 0 else -(u >> 1) - 1 for u in symbols], components, method, wrap, order)
        return np.array(rows, np.int64).reshape(n, components)
    return P.restored(coded, method, wrap, order)


def _unzigzag(u: np.ndarray) -> np.ndarray:
    return np.where(u & 1 == 0, u >> 1, -(u >> 1) - 1)


def _normals(vectors: np.ndarray, bits: int, level: int, version: tuple[int, int]) -> bytes:
    transform = P.Octahedron(bits)
    r = P.normal_residuals(P.octahedral(vectors, bits), transform)
    head = struct.pack("<bBB", P.DIFFERENCE, P.OCTAHEDRON, 1)
    return head + encode_symbols(r.ravel().tolist(), 2, level, version) + struct.pack("<ii", transform.width, transform.center)


def _read_normals(r: Reader, n: int) -> np.ndarray:
    method, transform = r.number("b"), r.number("b")
    if (method, transform) != (P.DIFFERENCE, P.OCTAHEDRON):
        raise StreamError(f"predictor {method} with transform {transform} of normals")
    coded = _read_symbols(r, n, 2).reshape(n, 2)
    width, _ = r.number("i"), r.number("i")
    bits = width.bit_length()
    if width != (1 << bits) - 1 or not 2 <= bits <= 30:
        raise StreamError("bounds of no octahedron")
    return P.normals_restored(coded, P.Octahedron(bits))


# --- attributes


def _coder(a: Attribute, bits: int, cloud: bool) -> int:
    if a.kind == NORMAL and (cloud or (bits > 0 and a.code in (9, 10))):
        return NORMALS
    if bits > 0 and a.code in (9, 10):
        return QUANTIZED
    return RAW_VALUES if a.code == 9 or cloud else INTEGERS


def _attributes(shape: Shape, rows: np.ndarray, bits: dict[int, int], speed: int, version: tuple[int, int], order: P.MeshOrder | None, cloud: bool) -> bytes:
    """Descriptors, coders, values of all attributes and then the parameters of their transforms. rows: the points whose values come, in order."""
    count = struct.pack("<I", len(shape.attributes)) if version < (2, 0) else varint(len(shape.attributes))
    out, tail = [count], []
    for i, a in enumerate(shape.attributes):
        out.append(struct.pack("<4B", a.kind, a.code, a.values.shape[1], a.normalized) + (varint(i) if version >= (1, 3) else struct.pack("<H", i)))
    coders = [_coder(a, bits.get(a.kind, 0), cloud) for a in shape.attributes]
    out.append(bytes(coders))
    method = P.PARALLELOGRAM if order and speed < 8 else P.DIFFERENCE
    for a, coder in zip(shape.attributes, coders, strict=True):
        v, b = a.values[rows], bits.get(a.kind, 0)
        if coder == RAW_VALUES:
            out.append(np.ascontiguousarray(v).astype("<" + v.dtype.str[1:]).tobytes())
        elif coder == INTEGERS:
            out.append(_integers(v, method, order, 10 - speed, version))
        elif coder == QUANTIZED:
            q = Quantization.of(v, b)
            out.append(_integers(q.encode(v), method, order, 10 - speed, version))
            tail.append(q.bytes())
        else:
            if b < 2:
                raise StreamError("normals need two bits or more")
            out.append(_normals(v, b, 10 - speed, version))
            tail.append(bytes([b]))
    return b"".join(out + tail)


def _read_descriptors(r: Reader) -> list[tuple[int, int, int, bool, int]]:
    n = r.number("I") if r.version < (2, 0) else r.varint()
    if n > len(r.data):
        raise StreamError("more attributes than bytes")
    out = []
    for _ in range(n):
        kind, code, components, normalized = struct.unpack("<4B", r.take(4))
        if kind > GENERIC or code not in TYPES or not components:
            raise StreamError("an attribute of no kind, type or component")
        out.append((kind, code, components, bool(normalized), r.varint() if r.version >= (1, 3) else r.number("H")))
    return out


def _read_attributes(r: Reader, n: int, order: P.MeshOrder | None) -> list[Attribute]:
    described = _read_descriptors(r)
    coders = list(r.take(len(described)))
    if any(c > NORMALS for c in coders):
        raise StreamError("an unknown coder of values")
    if n > 64 * 8 * len(r.data) * 64:
        raise StreamError("more values than the bytes can hold")
    read = []
    for (_, code, components, _, _), coder in zip(described, coders, strict=True):
        if coder == RAW_VALUES:
            kind = np.dtype("<" + TYPES[code])
            read.append(np.frombuffer(r.take(kind.itemsize * n * components), kind).reshape(n, components))
        else:
            read.append(_read_normals(r, n) if coder == NORMALS else _read_integers(r, n, components, order))
    out = []
    for (kind, code, components, normalized, unique_id), coder, v in zip(described, coders, read, strict=True):
        if coder == INTEGERS:
            v = v.astype("<" + TYPES[code])  # narrowed to its type, with wrap
        elif coder == QUANTIZED:
            v = Quantization.read(r, components).decode(v).astype(TYPES[code])
        elif coder == NORMALS:
            v = P.octahedral_vectors(v, r.number("B")).astype("f4")
        out.append(Attribute(kind, v, normalized, unique_id))
    return out


# --- whole streams


def index_bytes(faces: np.ndarray, n_points: int) -> bytes:
    """Indices as they stand: by the number of points one byte each, two, a varint, or four."""
    flat = faces.ravel()
    if n_points < 256:
        return flat.astype("u1").tobytes()
    if n_points < 65536:
        return flat.astype("<u2").tobytes()
    return b"".join(map(varint, flat.tolist())) if n_points < 1 << 21 else flat.astype("<u4").tobytes()


def _read_indices(r: Reader, n_faces: int, n_points: int) -> np.ndarray:
    coding = r.take(1)[0]
    if coding == 0:
        # differences to the index before, as symbols with the sign in the lowest bit
        symbols = np.array(decode_symbols(r, 3 * n_faces, 1), np.int64)
        flat = np.cumsum(np.where(symbols & 1 == 1, -(symbols >> 1), symbols >> 1))
    elif n_points < 65536:
        kind = np.dtype("u1" if n_points < 256 else "<u2")
        flat = np.frombuffer(r.take(3 * n_faces * kind.itemsize), kind).astype(np.int64)
    elif n_points < 1 << 21 and r.version >= (2, 2):
        flat = np.array([r.varint() for _ in range(3 * n_faces)], np.int64)
    else:
        flat = np.frombuffer(r.take(12 * n_faces), "<u4").astype(np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= n_points):
        raise StreamError("a face beyond the points")
    return flat.reshape(-1, 3)


#: The walks of meshes of so many faces are kept, the last KEPT of them: small meshes have few connectivities.
SMALL_MESH, KEPT = 64, 2048


def _walked(faces: bytes, by_degree: bool) -> tuple[bytes, P.MeshOrder]:
    """The bytes of a connectivity (rows of three longs) and the order of its values."""
    t = CornerTable(np.frombuffer(faces, np.int64).reshape(-1, 3).tolist())
    w = walk(t)
    return walk_bytes(t, w), P.MeshOrder(t.vertex, t.opposite, *(visits_by_degree if by_degree else visits)(t, w.order()))


_kept_walk = lru_cache(KEPT)(_walked)


def _back(t: Unwalked, by_degree: bool) -> tuple[np.ndarray, P.MeshOrder, np.ndarray]:
    """Faces, the order of values, and the place of each point's."""
    corners, place = (visits_by_degree if by_degree else visits)(t, t.order())
    faces, at = np.array(t.vertex, np.int64).reshape(-1, 3), np.array(place, np.int64)
    faces.flags.writeable = at.flags.writeable = False
    return faces, P.MeshOrder(t.vertex, t.opposite, corners, place), at


@lru_cache(KEPT)
def _kept_back(connectivity: bytes, by_degree: bool) -> tuple[np.ndarray, P.MeshOrder, np.ndarray]:
    return _back(Unwalked(Reader(connectivity)), by_degree)


def _connectivity_end(data: bytes, at: int) -> int | None:
    """Where the connectivity of a small mesh ends, whose numbers are all of one byte; None if it is not small, or cut."""
    try:
        n_faces, n_events = data[at + 2], data[at + 6]
        if data[at] or data[at + 3] or n_faces > SMALL_MESH or n_events > SMALL_MESH or max(data[at + 1 : at + 7 + 2 * n_events]) > 127:
            return None
        at += 7 + 2 * n_events + -(-n_events // 8)
        for skip in (1, 2):  # the symbols; the starts, behind their probability
            size = data[at + skip - 1]
            if size > 127:
                return None
            at += skip + size
        return at if at <= len(data) else None
    except IndexError:
        return None


def write_stream(shape: Shape, word: bytes, bits: dict[int, int] | None = None, speed: int = 7, tree: bool = False) -> bytes:
    """A mesh (speed 10: sequential; 0 to 9: edge walk, at 0 with values by degree; predictors are differences from 8 on and parallelograms below) or, without faces, a cloud (sequential, or tree coded). bits: quantization by kind of attribute; 0 or none keeps floats as they are."""
    bits = bits or {}
    if len(word) != 5:
        raise StreamError("the word has five bytes")
    if len({len(a.values) for a in shape.attributes}) > 1:
        raise StreamError("attributes of different numbers of points")
    head = lambda version, geometry, method: word + struct.pack("<4BH", *version, geometry, method, 0)
    n = shape.n_points
    if shape.faces is None:
        if tree:
            return head(TREE_VERSION, CLOUD, OTHER) + struct.pack("<I", n) + _tree(shape, bits, speed)
        start = head(CLOUD_VERSION, CLOUD, SEQUENTIAL) + struct.pack("<I", n)
        return start + (b"\1" + _attributes(shape, np.arange(n), bits, speed, CLOUD_VERSION, None, True) if shape.attributes else b"\0")
    faces = np.asarray(shape.faces, np.int64).reshape(-1, 3)
    if not len(faces):
        raise StreamError("a mesh without faces")
    start, rows, order = mesh_start(faces, n, word, speed)
    return start + _attributes(shape, rows, bits, speed, MESH_VERSION, order, False)


def mesh_start(faces: np.ndarray, n: int, word: bytes, speed: int) -> tuple[bytes, np.ndarray, P.MeshOrder | None]:
    """A mesh's stream up to its attributes, the points whose values come, in order, and the order's connectivity."""
    head = lambda method: word + struct.pack("<4BH", *MESH_VERSION, MESH_GEOMETRY, method, 0)
    if speed == 10:
        return head(SEQUENTIAL) + varint(len(faces)) + varint(n) + b"\1" + index_bytes(faces, n) + b"\1", np.arange(n), None
    if not 0 <= speed <= 9:
        raise StreamError(f"speed {speed}")
    connectivity, order = (_kept_walk if len(faces) <= SMALL_MESH else _walked)(faces.tobytes(), speed == 0)
    # one coder for all attributes, of the mesh's own connectivity, and the order of values
    return head(OTHER) + connectivity + struct.pack("<BbBB", 1, -1, 0, speed == 0), faces.ravel()[order.corners], order


def read_stream(data: bytes, word: bytes | None = None) -> Shape:
    """The shape that a stream holds. A stream that is cut, or whose counts its bytes cannot hold, is an error."""
    h = read_header(data, word)
    if h.geometry not in (CLOUD, MESH_GEOMETRY) or h.method > 1 or not (1, 0) <= (h.major, h.minor) <= (2, 3):
        raise StreamError(f"geometry {h.geometry}, method {h.method}, version {h.major}.{h.minor}")
    r = Reader(data, (h.major, h.minor))
    r.at = HEADER
    try:
        if h.has_metadata:
            _skip_metadata(r)
        return _read_cloud(r, h) if h.geometry == CLOUD else _read_mesh(r, h)
    except (IndexError, OverflowError, struct.error) as e:
        raise StreamError(f"a broken stream: {e}") from e


def _skip_metadata(r: Reader) -> None:
    for _ in range(r.varint()):
        r.varint()
        _skip_entries(r, 0)
    _skip_entries(r, 0)


def _skip_entries(r: Reader, depth: int) -> None:
    if depth > 100:
        raise StreamError("metadata too deep")
    for _ in range(r.varint()):
        r.take(r.take(1)[0])
        r.take(r.varint())
    for _ in range(r.varint()):
        r.take(r.take(1)[0])
        _skip_entries(r, depth + 1)


def _read_cloud(r: Reader, h: Header) -> Shape:
    n, coders = r.number("I"), r.take(1)[0]
    out = Shape(None)
    for _ in range(coders):
        out.attributes += _read_tree(r, n) if h.method == OTHER else _read_attributes(r, n, None)
    return out


def _read_mesh(r: Reader, h: Header) -> Shape:
    if h.method == SEQUENTIAL:
        n_faces, n = (r.varint(), r.varint()) if r.version >= (2, 2) else (r.number("I"), r.number("I"))
        if n_faces > 64 * 8 * len(r.data):
            raise StreamError("more faces than the bytes can hold")
        out = Shape(_read_indices(r, n_faces, n) if n_faces and n else np.zeros((0, 3), np.int64))
        for _ in range(r.take(1)[0]):
            out.attributes += _read_attributes(r, n, None)
        return out
    if r.version < (2, 2):
        raise StreamError("an edge walk of an older version")
    start, end = r.at, _connectivity_end(r.data, r.at)
    if end is None:
        t = Unwalked(r)
    else:
        r.at = end
    kinds = [struct.unpack("<bBB", r.take(3)) for _ in range(r.take(1)[0])]
    if any(k[:2] != (-1, 0) or k[2] > 1 for k in kinds) or len(set(kinds)) > 1:
        raise StreamError("values of another connectivity or order")
    by_degree = bool(kinds and kinds[0][2])
    faces, order, place = _back(t, by_degree) if end is None else _kept_back(bytes(r.data[start:end]), by_degree)
    out = Shape(faces)
    for _ in kinds:
        for a in _read_attributes(r, len(order.corners), order):
            out.attributes.append(Attribute(a.kind, a.values[place] if len(place) else a.values, a.normalized, a.unique_id))
    return out


def _tree(shape: Shape, bits: dict[int, int], speed: int) -> bytes:
    """All attributes as one table of natural numbers: floats quantized, signed integers above their least."""
    columns, tail, lows = [], b"", b""
    for a in shape.attributes:
        if a.code == 9:
            q = Quantization.of(a.values, bits.get(a.kind, 0))
            columns.append(q.encode(a.values))
            tail += q.bytes()
        elif a.code in (1, 3, 5):
            low = a.values.astype(np.int64).min(0)
            columns.append(a.values - low)
            lows += b"".join(map(signed_varint, low.tolist()))
        elif a.code in (2, 4, 6):
            columns.append(a.values)
        else:
            raise StreamError("a type that the tree does not code")
    table = np.concatenate([c.astype(np.int64) for c in columns], 1)
    level = min(max(10 - speed, 0), 6)
    level = 5 if level == 6 and table.shape[1] > 15 else level
    described = b"".join(struct.pack("<4B", a.kind, a.code, a.values.shape[1], a.normalized) + varint(i) for i, a in enumerate(shape.attributes))
    return b"\1" + varint(len(shape.attributes)) + described + bytes([level]) + encode_points(table.astype(np.uint32), level, TREE_VERSION) + tail + lows


def _read_tree(r: Reader, n: int) -> list[Attribute]:
    described = _read_descriptors(r)
    level = r.take(1)[0]
    if level > 6:
        raise StreamError(f"tree level {level}")
    table = decode_points(r, sum(d[2] for d in described), level).astype(np.int64)
    if len(table) != n:
        raise StreamError("another number of points than the stream says")
    quantizations = [Quantization.read(r, d[2]) if d[1] == 9 else None for d in described]
    out, at = [], 0
    for (kind, code, components, normalized, unique_id), q in zip(described, quantizations, strict=True):
        v = table[:, at : at + components]
        at += components
        if q:
            v = q.decode(v)
        elif code in (1, 3, 5):
            v = v + np.array([unzigzag(r.varint()) for _ in range(components)], np.int64)
        out.append(Attribute(kind, v.astype(TYPES[code]), normalized, unique_id))
    return out


def stats(data: bytes) -> dict:
    """What a stream is: geometry, method, version, bytes, points, faces and the kinds of its attributes."""
    h, shape = read_header(data), read_stream(data)
    return {"geometry": ("cloud", "mesh")[h.geometry], "method": ("sequential", "tree" if h.geometry == CLOUD else "edge_walk")[h.method], "version": f"{h.major}.{h.minor}", "bytes": len(data), "points": shape.n_points, "faces": 0 if shape.faces is None else len(shape.faces), "kinds": [a.kind for a in shape.attributes]}


# --- over tables


def _rows_of(column: pa.Array, width: int | None, kind: str) -> list[np.ndarray | None]:
    """Arrays of rows of a column of lists of lists; width: that of rows where a list has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    inner = column.flatten()
    flat, sizes = inner.flatten(), np.diff(inner.offsets.to_numpy())
    if inner.null_count or flat.null_count or not len(sizes) or (sizes != sizes[0]).any() or not sizes[0]:
        return [None if x is None else np.array(x, kind).reshape(len(x), -1) if x or width is None else np.zeros((0, width), kind) for x in column.to_pylist()]
    table, ends = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, sizes[0]), np.concatenate([[0], np.cumsum([n or 0 for n in pc.list_value_length(column).to_pylist()])]).tolist()
    return [table[a:b] if valid else None for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


def _lists_of(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrays of rows as a column of lists of lists of longs."""
    whole = [a for a in arrays if a is not None]
    sizes = np.concatenate([np.full(len(a), a.shape[1]) for a in whole]) if whole else np.zeros(0, np.int64)
    flat = np.concatenate([a.ravel() for a in whole]).astype(np.int64, copy=False) if whole else np.zeros(0, np.int64)
    offsets = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    inner = pa.ListArray.from_arrays(offsets(sizes), flat)
    return pa.ListArray.from_arrays(offsets([0 if a is None else len(a) for a in arrays]), inner, mask=pa.array([a is None for a in arrays], pa.bool_()))


def coded(shapes: DataFrame, word: bytes, bits: dict[int, int] | None = None, speed: int = 7, tree: bool = False) -> DataFrame:
    """shapes (m, faces: array of index triples, or null for a cloud; points: array of integer rows, coded as generic 32-bit integers without loss) -> (m, content)."""
    from tessera.sources.stream_batches import write_meshes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            faces, points = _rows_of(b.column(1), 3, "i8"), _rows_of(b.column(2), None, "i4")
            if len(word) == 5 and not tree and not bits:
                out = write_meshes(faces, points, word, speed)
            else:
                out = [write_stream(Shape(f, [Attribute(GENERIC, p)]), word, bits, speed, tree) for f, p in zip(faces, points, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["m", "content"])

    return shapes.select("m", "faces", "points").mapInArrow(run, f"m {shapes.schema['m'].dataType.simpleString()}, content binary")


def decoded(streams: DataFrame, word: bytes | None = None) -> DataFrame:
    """streams (m, content) -> (m, faces, points, error): the first attribute's rows as longs; a stream that cannot be read is a row with its error."""
    from tessera.sources.stream_batches import read_meshes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            faces, points, errors = zip(*read_meshes(b.column(1).to_pylist(), word), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists_of(faces), _lists_of(points), pa.array(errors, pa.string())], ["m", "faces", "points", "error"])

    return streams.select("m", "content").mapInArrow(run, f"m {streams.schema['m'].dataType.simpleString()}, faces array<array<bigint>>, points array<array<bigint>>, error string")
