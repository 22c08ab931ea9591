"""Binary FBX: records of a name, properties and further records. Geometry is Vertices (doubles) and PolygonVertexIndex (polygons whose last
index is the complement)."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from tessera.sources.formats import FormatError, fan, mesh

MAGIC = b"Kaydara FBX Binary  \x00\x1a\x00"
PLAIN = {b"Y": "<h", b"C": "<?", b"I": "<i", b"F": "<f", b"D": "<d", b"L": "<q"}
_PLAIN = {k: struct.Struct(v) for k, v in PLAIN.items()}
ARRAYS = {b"f": "<f4", b"d": "<f8", b"l": "<i8", b"i": "<i4", b"b": "<u1"}
_KIND_OF = {np.dtype(t): k for k, t in ARRAYS.items()}
_WIDE, _NARROW, _THREE, _HEAD = struct.Struct("<QQQ"), struct.Struct("<III"), struct.Struct("<III"), struct.Struct("<QQQB")
#: From this version on offsets have 64 bits.
WIDE = 7500
#: Arrays of so many bytes are compressed where that makes them smaller.
COMPRESS_FROM = 128


@dataclass
class Record:
    name: str
    properties: list = field(default_factory=list)
    records: list[Record] = field(default_factory=list)

    def all(self, name: str) -> list[Record]:
        return [r for r in self.records if r.name == name]

    def value(self, name: str):
        found = self.all(name)
        return found[0].properties[0] if found and found[0].properties else None


def parse(data: bytes) -> tuple[int, Record]:
    """Version and a record that holds those of the file."""
    if data[: len(MAGIC)] != MAGIC:
        raise FormatError("no binary FBX")
    try:
        version = struct.unpack_from("<I", data, len(MAGIC))[0]
        top, at = Record(""), len(MAGIC) + 4
        while at < len(data):
            record, at = _record(data, at, version >= WIDE)
            if record is None:
                break
            top.records.append(record)
    except (struct.error, zlib.error, IndexError) as e:
        raise FormatError(f"a record ends early: {e}") from e
    return version, top


def _record(data: bytes, at: int, wide: bool) -> tuple[Record | None, int]:
    end, count, _ = (_WIDE if wide else _NARROW).unpack_from(data, at)
    at += 24 if wide else 12
    size = data[at]
    if not end:
        return None, at + 1
    if end > len(data):
        raise FormatError("a record beyond the file")
    record, at = Record(data[at + 1 : at + 1 + size].decode("utf-8", "replace")), at + 1 + size
    for _ in range(count):
        value, at = _property(data, at)
        record.properties.append(value)
    while at < end:
        inner, at = _record(data, at, wide)
        if inner is None:
            break
        record.records.append(inner)
    return record, end


def _property(data: bytes, at: int):
    kind, at = data[at : at + 1], at + 1
    if kind in PLAIN:
        layout = _PLAIN[kind]
        return layout.unpack_from(data, at)[0], at + layout.size
    if kind in ARRAYS:
        n, packed, size = _THREE.unpack_from(data, at)
        raw, item = data[at + 12 : at + 12 + size], np.dtype(ARRAYS[kind])
        if packed > 1:
            raise FormatError(f"array encoding {packed}")
        values = np.frombuffer(zlib.decompress(raw) if packed else data[at + 12 : at + 12 + n * item.itemsize], item)
        if len(values) != n:
            raise FormatError("an array of another length than it says")
        return values, at + 12 + (size if packed else n * item.itemsize)
    if kind in (b"S", b"R"):
        n = struct.unpack_from("<I", data, at)[0]
        raw = data[at + 4 : at + 4 + n]
        return (raw.decode("utf-8", "replace") if kind == b"S" else raw), at + 4 + n
    raise FormatError(f"property type {kind!r}")


def polygons(index) -> list[list[int]]:
    out, ring = [], []
    for i in map(int, index):
        ring.append(i if i >= 0 else ~i)
        if i < 0:
            out.append(ring)
            ring = []
    return out


def read_fbx(data: bytes) -> list[dict]:
    """A mesh for each geometry with vertices, polygons as fans; named by the model it is connected to, if any."""
    _, top = parse(data)
    objects = [r for o in top.all("Objects") for r in o.records if r.properties]
    models = {r.properties[0]: str(r.properties[1]).split("\0")[0] for r in objects if r.name == "Model" and len(r.properties) > 1}
    parent = {c.properties[1]: c.properties[2] for t in top.all("Connections") for c in t.records if len(c.properties) > 2}
    out = []
    for r in objects:
        vertices = r.value("Vertices") if r.name == "Geometry" else None
        if vertices is None:
            continue
        positions = np.asarray(vertices, float).reshape(-1, 3)
        index = r.value("PolygonVertexIndex")
        faces = [t for ring in polygons(index if index is not None else []) for t in fan(ring)]
        if any(not 0 <= i < len(positions) for f in faces for i in f):
            raise FormatError("a face beyond the vertices")
        out.append(mesh(positions, faces, name=models.get(parent.get(r.properties[0]), f"mesh_{len(out)}")))
    return out


def connections(top: Record) -> list[tuple[int, int]]:
    """(child, parent) of all objects: the edges of the scene."""
    return [(c.properties[1], c.properties[2]) for t in top.all("Connections") for c in t.records if len(c.properties) > 2 and c.properties[0] == "OO"]


def _numbers(model: Record, name: str, default: float) -> list[float]:
    """The last three numbers of a property of a model, as P records of its Properties70 have them."""
    for table in model.all("Properties70"):
        for p in table.all("P"):
            if p.properties and p.properties[0] == name and len(p.properties) >= 7:
                return [float(x) for x in p.properties[-3:]]
    return [default] * 3


def model_matrix(model: Record) -> list[float]:
    """Sixteen numbers by rows, the translation in the last row: scale, turns about x, y and z in degrees, translation, for row vectors."""
    x, y, z = np.radians(_numbers(model, "Lcl Rotation", 0.0))
    cx, sx, cy, sy, cz, sz = np.cos(x), np.sin(x), np.cos(y), np.sin(y), np.cos(z), np.sin(z)
    r = np.array([[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]])
    out = np.eye(4)
    out[:3, :3] = (r * np.array(_numbers(model, "Lcl Scaling", 1.0))).T
    out[3, :3] = _numbers(model, "Lcl Translation", 0.0)
    return out.ravel().tolist()


def read_fbx_scene(data: bytes) -> list[dict]:
    """The models from those without a model above them down, depth first: node, parent, name, mesh (the place of its geometry among the geometries, or None), matrix. Ids are those of the file; a model that is
    reached twice is an error."""
    _, top = parse(data)
    objects = [r for o in top.all("Objects") for r in o.records if r.properties]
    models = {r.properties[0]: r for r in objects if r.name == "Model"}
    shapes = {r.properties[0]: i for i, r in enumerate(x for x in objects if x.name == "Geometry" and x.value("Vertices") is not None)}
    edges = connections(top)
    mesh_of = {parent: shapes[child] for child, parent in edges if child in shapes and parent in models}
    below: dict[int, list[int]] = {}
    for child, parent in edges:
        if child in models:
            below.setdefault(parent if parent in models else 0, []).append(child)
    linked = {child for child, _ in edges}
    out, seen = [], set()
    stack = [(m, None) for m in reversed(below.get(0, []) + [m for m in models if m not in linked])]
    while stack:
        m, parent = stack.pop()
        if m in seen:
            raise FormatError("a model that is reached twice")
        seen.add(m)
        r = models[m]
        name = str(r.properties[1]).split("\0")[0] if len(r.properties) > 1 else f"model_{m}"
        out.append({"node": m, "parent": parent, "name": name, "mesh": mesh_of.get(m), "matrix": model_matrix(r)})
        stack += [(c, m) for c in reversed(below.get(m, []))]
    return out


def _packed(value, compress: bool) -> bytes:
    if isinstance(value, np.ndarray):
        kind, raw = _KIND_OF[value.dtype], value.tobytes()
        small = zlib.compress(raw) if compress and len(raw) >= COMPRESS_FROM else raw
        body = small if len(small) < len(raw) else raw
        return kind + _THREE.pack(len(value), int(body is not raw), len(body)) + body
    if isinstance(value, float):
        return b"D" + struct.pack("<d", value)
    if isinstance(value, str):
        text = value.encode()
        return b"S" + len(text).to_bytes(4, "little") + text
    return b"L" + _PLAIN[b"L"].pack(value)


def _written(r: Record, at: int, compress: bool) -> bytes:
    body, name = b"".join(_packed(p, compress) for p in r.properties), r.name.encode()
    start = at + 25 + len(name) + len(body)
    inner = b""
    for x in r.records:
        inner += _written(x, start + len(inner), compress)
    inner += b"\0" * 25 if r.records else b""
    return _HEAD.pack(start + len(inner), len(r.properties), len(body), len(name)) + name + body + inner


def write_fbx(meshes: list[dict], compress: bool = True) -> bytes:
    """Version 7500, a model for each mesh."""
    objects, links = Record("Objects"), Record("Connections")
    for i, m in enumerate(meshes):
        shape, model = 1000 + 2 * i, 1001 + 2 * i
        index = np.array([x for a, b, c in m["faces"] for x in (a, b, ~c)], "<i4")
        objects.records.append(Record("Geometry", [shape, f"{m['name']}\0\1Geometry", "Mesh"], [Record("Vertices", [np.array(m["positions"], "<f8").ravel()]), Record("PolygonVertexIndex", [index])]))
        objects.records.append(Record("Model", [model, f"{m['name']}\0\1Model", "Mesh"]))
        links.records += [Record("C", ["OO", shape, model]), Record("C", ["OO", model, 0])]
    out = MAGIC + struct.pack("<I", WIDE)
    for r in (objects, links):
        out += _written(r, len(out), compress)
    return out + b"\0" * 25
