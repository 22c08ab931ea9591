"""Mesh formats as pure functions of bytes: PLY, OBJ, glTF and GLB. A mesh is a dict with positions, normals, colors, uvs (lists of tuples,
maybe empty), faces (index triples) and name."""

from __future__ import annotations

import base64
import json
import re
import struct
import urllib.parse
from collections.abc import Callable

import numpy as np

PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_LETTERS = {"i1": "b", "u1": "B", "i2": "h", "u2": "H", "i4": "i", "u4": "I", "f4": "f", "f8": "d"}
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}


_JSON = json.JSONEncoder()


class FormatError(ValueError):
    pass


def mesh(positions, faces=(), normals=(), colors=(), uvs=(), name="") -> dict:
    rows = lambda v, kind: list(map(tuple, v.astype(kind).tolist())) if isinstance(v, np.ndarray) and v.ndim == 2 else [tuple(map(kind, x)) for x in v]
    return {"name": name, "positions": rows(positions, float), "faces": rows(faces, int), "normals": rows(normals, float), "colors": rows(colors, int), "uvs": rows(uvs, float)}


def fan(ring) -> list[tuple[int, int, int]]:
    return [(ring[0], ring[j], ring[j + 1]) for j in range(1, len(ring) - 1)]


# --- OBJ


def read_obj(data: bytes, whole_polygons: bool = True, expand: bool = False, name: str = "") -> dict:
    """v, vn, vt and f lines; others and broken ones are passed over. whole_polygons: fans, or else the first triangle of each face.
    expand: a point for each corner with its own normal and texture coordinates, or else one for each v. Negative indices count from the end."""
    v, vn, vt, rings = [], [], [], []
    for line in data.decode("utf-8", "replace").splitlines():
        part = line.split()
        try:
            if part[:1] in (["v"], ["vn"]):
                (v if part[0] == "v" else vn).append(tuple(float(x) for x in part[1:4]) if len(part) >= 4 else _short())
            elif part[:1] == ["vt"]:
                vt.append((float(part[1]), float(part[2])))
            elif part[:1] == ["f"] and len(part) >= 4:
                rings.append([_corner(x, len(v), len(vt), len(vn)) for x in part[1:]])
        except (ValueError, IndexError):
            continue
    rings = [r for r in rings if all(0 <= c[0] < len(v) for c in r)]
    triangles = [t for r in rings for t in (fan(r) if whole_polygons else fan(r[:3]))]
    if not expand:
        return mesh(v, [[c[0] for c in t] for t in triangles], name=name)
    corners = [c for t in triangles for c in t]
    pick = lambda table, i, width: table[i] if i is not None and 0 <= i < len(table) else (0.0,) * width
    return mesh([v[c[0]] for c in corners], [(3 * i, 3 * i + 1, 3 * i + 2) for i in range(len(triangles))], [pick(vn, c[2], 3) for c in corners] if vn else (), (), [pick(vt, c[1], 2) for c in corners] if vt else (), name)


def _short():
    raise ValueError("a vertex of fewer than three numbers")


def _corner(text: str, nv: int, nt: int, nn: int) -> tuple:
    parts = (text.split("/") + ["", ""])[:3]
    at = lambda s, n: None if not s else int(s) - 1 if int(s) > 0 else n + int(s) if int(s) < 0 else -1
    return at(parts[0], nv), at(parts[1], nt), at(parts[2], nn)


def read_obj_positions(data: bytes) -> list[tuple[float, float, float]]:
    """The v lines alone."""
    return read_obj(b"\n".join(x for x in data.splitlines() if x.lstrip()[:2] == b"v "))["positions"]


def write_obj(meshes: list[dict], precision: int = 6) -> bytes:
    """All meshes in one file, indices running on; numbers with so many decimals."""
    number = f"%.{precision}f"
    out, base = [], 1
    for m in meshes:
        if m["name"]:
            out.append(f"o {m['name']}")
        out += [f"v {number} {number} {number}" % tuple(p) for p in m["positions"]]
        out += [f"vn {number} {number} {number}" % tuple(n) for n in m["normals"]]
        corner = "{0}//{0}" if m["normals"] else "{0}"
        out += ["f " + " ".join(corner.format(i + base) for i in f) for f in m["faces"]]
        base += len(m["positions"])
    return ("\n".join(out) + "\n").encode()


# --- PLY


def read_ply(data: bytes, name: str = "") -> dict:
    """ASCII and both binary forms. The face list is the one named vertex_indices, or else the first list of the face element."""
    end = re.search(rb"(?m)^\s*end_header[ \t]*\r?\n", data)
    if not data.lstrip().startswith(b"ply") or not end:
        raise FormatError("no PLY header")
    form, elements = None, []
    for line in data[: end.start()].decode("ascii", "replace").splitlines():
        p = line.split()
        if p[:1] == ["format"]:
            form = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}.get(p[1])
        elif p[:1] == ["element"]:
            elements.append((p[1], int(p[2]), []))
        elif p[:1] == ["property"]:
            if not elements:
                raise FormatError("a property before any element")
            kinds = [PLY_TYPES.get(k) for k in (p[2:4] if p[1] == "list" else p[1:2])]
            if None in kinds:
                raise FormatError(f"unknown type in {line!r}")
            elements[-1][2].append((p[-1], kinds))
    if form is None:
        raise FormatError("unknown format")
    body = data[end.end() :]
    rows = _ply_ascii(body, elements) if form == "" else _ply_binary(body, elements, form)
    vertex, props = rows.get("vertex", []), [n for n, _ in next((e[2] for e in elements if e[0] == "vertex"), [])]
    if not {"x", "y", "z"} <= set(props):
        raise FormatError("no x, y, z")
    at = {n: i for i, n in enumerate(props)}
    columns = lambda names: [tuple(r[at[n]] for n in names) for r in vertex]
    has = lambda names: set(names) <= set(props)
    color = [n for n in props if n in ("red", "green", "blue", "alpha")]
    lists = [n for n, k in next((e[2] for e in elements if e[0] == "face"), []) if len(k) == 2]
    faces = []
    if lists:
        names = [n for n, _ in next(e[2] for e in elements if e[0] == "face")]
        k = names.index("vertex_indices" if "vertex_indices" in lists else lists[0])
        faces = [t for r in rows["face"] for t in fan([int(i) for i in r[k]])]
        if any(not 0 <= i < len(vertex) for f in faces for i in f):
            raise FormatError("a face beyond the vertices")
    return mesh(columns("xyz"), faces, columns(("nx", "ny", "nz")) if has(("nx", "ny", "nz")) else (), columns(color) if len(color) >= 3 else (), (), name)


def _ply_ascii(body: bytes, elements) -> dict:
    words, rows = iter(body.split()), {}
    def number(kind: str):
        word = next(words)
        return float(word) if kind[0] == "f" else int(word) if word.isdigit() and len(word) < 16 else int(float(word))

    try:
        for name, n, props in elements:
            rows[name] = [[number(k[0]) if len(k) == 1 else [number(k[1]) for _ in range(number(k[0]))] for _, k in props] for _ in range(n)]
    except (StopIteration, RuntimeError) as e:
        raise FormatError("the body ends early") from e
    return rows


def _ply_binary(body: bytes, elements, order: str) -> dict:
    at, rows = 0, {}
    try:
        for name, n, props in elements:
            if all(len(k) == 1 for _, k in props):
                kind = np.dtype([(f"p{i}", order + k[0]) for i, (_, k) in enumerate(props)])
                rows[name] = np.frombuffer(body, kind, n, at).tolist()
                at += n * kind.itemsize
                continue
            rows[name] = []
            kinds = [[(order + _LETTERS[x], np.dtype(x).itemsize) for x in k] for _, k in props]
            for _ in range(n):
                row = []
                for k in kinds:
                    count = 1
                    if len(k) == 2:
                        count, at = int(struct.unpack_from(k[0][0], body, at)[0]), at + k[0][1]
                    letter, size = k[-1]
                    if count < 0:
                        raise FormatError("a list of less than nothing")
                    got, at = struct.unpack_from(f"{letter[0]}{count}{letter[1]}", body, at), at + count * size
                    row.append(list(got) if len(k) == 2 else got[0])
                rows[name].append(row)
    except (ValueError, struct.error) as e:
        raise FormatError("the body ends early") from e
    return rows


def ply_info(data: bytes) -> dict:
    """The header: form, and the elements with their counts and properties."""
    lines = [x.split() for x in data[: data.index(b"end_header")].decode("ascii", "replace").splitlines()]
    out = {"form": next((p[1] for p in lines if p[:1] == ["format"]), None), "elements": []}
    for p in lines:
        if p[:1] == ["element"]:
            out["elements"].append({"name": p[1], "count": int(p[2]), "properties": []})
        elif p[:1] == ["property"] and out["elements"]:
            out["elements"][-1]["properties"].append({"name": p[-1], "type": " ".join(p[1:-1])})
    return out


def write_ply(m: dict, form: str = "ascii", precision: int | None = None) -> bytes:
    """precision: decimals of ASCII numbers; without it as many as single precision needs."""
    order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[form]
    n, columns = len(m["positions"]), [("float x", "f4"), ("float y", "f4"), ("float z", "f4")]
    normals, colors = len(m["normals"]) == n > 0, len(m["colors"]) == n > 0
    columns += [(f"float n{c}", "f4") for c in "xyz"] * normals + [(f"uchar {c}", "u1") for c in ("red", "green", "blue", "alpha")] * colors
    rows = [tuple(p) + (tuple(m["normals"][i]) if normals else ()) + ((tuple(m["colors"][i]) + (255,) * 4)[:4] if colors else ()) for i, p in enumerate(m["positions"])]
    head = ["ply", f"format {form} 1.0", f"element vertex {n}", *(f"property {c}" for c, _ in columns), f"element face {len(m['faces'])}", "property list uchar int vertex_indices", "end_header"]
    head = ("\n".join(head) + "\n").encode()
    if not order:
        return head + "".join(" ".join((repr(float(np.float32(x))) if precision is None else f"{x:.{precision}f}") if columns[j][1] == "f4" else str(int(x)) for j, x in enumerate(r)) + "\n" for r in rows).encode() + "".join(f"3 {a} {b} {c}\n" for a, b, c in m["faces"]).encode()
    body = np.array(rows, np.dtype([(c, order + k) for c, k in columns])).tobytes() if rows else b""
    return head + body + b"".join(struct.pack(order + "B3i", 3, *f) for f in m["faces"])


# --- glTF


def split_glb(data: bytes) -> tuple[dict, bytes | None]:
    magic, version, length = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2 or length > len(data):
        raise FormatError("no GLB of version 2")
    at, text, binary = 12, None, None
    while at + 8 <= length:
        n, kind = struct.unpack_from("<I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if len(chunk) < n:
            raise FormatError("a chunk ends early")
        text, binary = (chunk if kind == b"JSON" and text is None else text), (chunk if kind == b"BIN\0" and binary is None else binary)
        at += 8 + n
    if text is None:
        raise FormatError("no JSON chunk")
    return json.loads(text), binary


def read_gltf(data: bytes, fetch: Callable[[str], bytes] | None = None, extension: str | None = None, decode: Callable[[bytes], dict] | None = None) -> list[dict]:
    """The meshes of a glTF or GLB file (told apart by the first four bytes), one for each primitive of points or triangles.

    extension names the compression extension of the files at hand, and decode turns such a primitive's bytes into {unique id: rows of values} with "faces" for the triangles. A primitive
    that is compressed otherwise is an error, not left out. fetch gives the bytes of an external buffer by its uri.
    """
    doc, buffers = _opened(data, fetch)
    out = []
    for i, m in enumerate(doc.get("meshes", [])):
        for j, p in enumerate(m["primitives"]):
            if p.get("mode", 4) not in (0, 4):
                raise FormatError(f"mode {p['mode']} of a primitive")
            name = m.get("name", f"mesh_{i}") + (f"_{j}" if len(m["primitives"]) > 1 else "")
            packed = compressed(p)
            if packed is not None:
                if packed != extension or decode is None:
                    raise FormatError(f"a primitive compressed by {packed}")
                own = p["extensions"][packed]
                shape = decode(_view(doc, buffers, own["bufferView"]))
                get = lambda key, own=own, shape=shape: shape.get(own["attributes"].get(key), [])
                at, faces = get("POSITION"), shape["faces"]
            else:
                get = lambda key, p=p: _accessor(doc, buffers, p["attributes"][key]) if key in p["attributes"] else []
                at = get("POSITION")
                index = _accessor(doc, buffers, p["indices"]).ravel() if "indices" in p else np.arange(len(at))
                if p.get("mode", 4) == 4 and (len(index) % 3 or (len(index) and index.max() >= len(at))):
                    raise FormatError("indices")
                faces = index.reshape(-1, 3) if p.get("mode", 4) == 4 else ()
            if len(at) == 0:
                raise FormatError("no positions")
            colors = np.array(get("COLOR_0"))
            colors = np.round(colors * 255) if colors.dtype.kind == "f" else colors
            out.append(mesh(at, faces, get("NORMAL"), colors, _texcoords(doc, p, get("TEXCOORD_0"), packed), name))
    return out


def _opened(data: bytes, fetch) -> tuple[dict, list[bytes]]:
    doc, binary = split_glb(data) if data[:4] == b"glTF" else (json.loads(data), None)
    return doc, [_buffer(b, i, binary, fetch) for i, b in enumerate(doc.get("buffers", []))]


def _texcoords(doc: dict, p: dict, rows, packed: str | None):
    """Normalized integers stand for 0 to 1."""
    if packed is None and len(rows) and np.asarray(rows).dtype.kind == "u" and doc["accessors"][p["attributes"]["TEXCOORD_0"]].get("normalized"):
        return np.asarray(rows, float) / np.iinfo(np.asarray(rows).dtype).max
    return rows


def compressed(primitive: dict) -> str | None:
    """The compression extension of a primitive, if it has one: the one that has a view of its own."""
    return next((k for k, v in primitive.get("extensions", {}).items() if isinstance(v, dict) and "bufferView" in v), None)


def compressed_primitives(data: bytes) -> list[dict]:
    """Mesh, primitive, extension, view and the attributes' unique ids of each compressed primitive."""
    doc = split_glb(data)[0] if data[:4] == b"glTF" else json.loads(data)
    rows = [(i, j, p, compressed(p)) for i, m in enumerate(doc.get("meshes", [])) for j, p in enumerate(m["primitives"])]
    return [{"mesh": i, "primitive": j, "extension": k, "view": p["extensions"][k]["bufferView"], "attributes": p["extensions"][k].get("attributes", {})} for i, j, p, k in rows if k]


def _view(doc: dict, buffers: list[bytes], i: int) -> bytes:
    view = doc["bufferViews"][i]
    start = view.get("byteOffset", 0)
    data = buffers[view["buffer"]][start : start + view["byteLength"]]
    if len(data) < view["byteLength"]:
        raise FormatError("a view beyond its buffer")
    return data


def node_matrix(node: dict) -> list[float]:
    """Sixteen numbers by rows: the matrix (by columns in the file), or translation, rotation and scale."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T.ravel().tolist()
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = r * np.array(node.get("scale", (1, 1, 1)))
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out.ravel().tolist()


def read_gltf_scene(data: bytes) -> list[dict]:
    """The nodes of the default scene (or the first, or the nodes without a parent) depth first: node, parent, name, mesh, matrix by rows. A node that is reached twice is an error."""
    doc = split_glb(data)[0] if data[:4] == b"glTF" else json.loads(data)
    nodes, scenes = doc.get("nodes", []), doc.get("scenes", [])
    children = {c for n in nodes for c in n.get("children", [])}
    roots = scenes[doc.get("scene", 0)].get("nodes", []) if scenes else [i for i in range(len(nodes)) if i not in children]
    out, seen, stack = [], set(), [(i, None) for i in reversed(roots)]
    while stack:
        i, parent = stack.pop()
        if i in seen:
            raise FormatError("a node that is reached twice")
        seen.add(i)
        n = nodes[i]
        out.append({"node": i, "parent": parent, "name": n.get("name", f"node_{i}"), "mesh": n.get("mesh"), "matrix": node_matrix(n)})
        stack += [(c, i) for c in reversed(n.get("children", []))]
    return out


def _buffer(b: dict, i: int, binary: bytes | None, fetch) -> bytes:
    uri = b.get("uri")
    if uri is None:
        if i or binary is None:
            raise FormatError("a buffer without data")
        return binary
    if uri.startswith("data:"):
        head, _, body = uri.partition(",")
        return base64.b64decode(body) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(body)
    if fetch is None:
        raise FormatError(f"an external buffer: {uri}")
    return fetch(urllib.parse.unquote(uri))


def _accessor(doc: dict, buffers: list[bytes], i: int) -> np.ndarray:
    a = doc["accessors"][i]
    if "sparse" in a or "bufferView" not in a:
        raise FormatError("a sparse accessor, or one without a view")
    view = doc["bufferViews"][a["bufferView"]]
    kind, width, n = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]], a["count"]
    start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride") or kind.itemsize * width
    data = buffers[view["buffer"]]
    if n and (start + step * (n - 1) + kind.itemsize * width > len(data) or a.get("byteOffset", 0) + step * (n - 1) + kind.itemsize * width > view["byteLength"]):
        raise FormatError("an accessor beyond its view")
    if n and step == kind.itemsize * width:
        return np.frombuffer(data, kind, n * width, start).reshape(n, width)
    return np.lib.stride_tricks.as_strided(np.frombuffer(data, kind, offset=start, count=1) if n else np.zeros(0, kind), (n, width), (step, kind.itemsize)).copy() if n else np.zeros((0, width), kind)


def write_gltf(meshes: list[dict], form: str = "glb", extension: str | None = None, encode: Callable[[dict], tuple[bytes, dict[str, int]]] | None = None, scene: list[dict] | None = None) -> bytes | tuple[bytes, bytes]:
    """Every mesh as one primitive, views and chunks at multiples of four. form: glb, embedded (JSON with the data in it) or separate (JSON, and the bytes of data.bin).

    With extension and encode (a mesh to its stream and the unique ids of its attributes by semantic), meshes with faces are compressed under that name. scene: nodes (node, parent, name, mesh, matrix by
    rows) as read_gltf_scene gives them; without it every mesh has a node of its own.
    """
    blob, views, accessors, out = bytearray(), [], [], []

    def view(data: bytes) -> int:
        blob.extend(b"\0" * (-len(blob) % 4))
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": len(data)})
        blob.extend(data)
        return len(views) - 1

    def put(rows, kind: str, shape: str, code: int, stored: bool, **more) -> int:
        accessors.append(({"bufferView": view(np.array(rows, kind).tobytes())} if stored else {}) | {"componentType": code, "count": len(rows), "type": shape} | more)
        return len(accessors) - 1

    for m in meshes:
        packed = extension is not None and encode is not None and bool(m["faces"])
        p = np.array(m["positions"], "<f4")
        attributes = {"POSITION": put(p, "<f4", "VEC3", 5126, not packed, min=p.min(0).tolist(), max=p.max(0).tolist())}
        for key, name, kind, shape, code in (("normals", "NORMAL", "<f4", "VEC3", 5126), ("uvs", "TEXCOORD_0", "<f4", "VEC2", 5126), ("colors", "COLOR_0", "<u1", "VEC4", 5121)):
            if m[key]:
                rows = [(tuple(c) + (255,) * 4)[:4] for c in m[key]] if key == "colors" else m[key]
                attributes[name] = put(rows, kind, shape, code, not packed, **({"normalized": True} if key == "colors" else {}))
        primitive = {"attributes": attributes, "mode": 4 if m["faces"] else 0}
        if m["faces"]:
            primitive["indices"] = put(np.array(m["faces"]).ravel(), "<u4", "SCALAR", 5125, not packed)
        if packed:
            stream, ids = encode(m)
            primitive["extensions"] = {extension: {"bufferView": view(stream), "attributes": ids}}
        out.append({"name": m["name"], "primitives": [primitive]})
    if scene is None:
        nodes, roots = [{"mesh": i, "name": m["name"]} for i, m in enumerate(out)], list(range(len(out)))
    else:
        place = {n["node"]: i for i, n in enumerate(scene)}
        nodes = []
        for n in scene:
            own = {"name": n["name"], "matrix": np.array(n["matrix"], float).reshape(4, 4).T.ravel().tolist()} | ({"mesh": n["mesh"]} if n["mesh"] is not None else {})
            below = [place[c["node"]] for c in scene if c["parent"] == n["node"]]
            nodes.append(own | ({"children": below} if below else {}))
        roots = [place[n["node"]] for n in scene if n["parent"] is None]
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": roots}], "nodes": nodes, "meshes": out, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(blob)}]}
    if any("extensions" in p for m in out for p in m["primitives"]):
        doc |= {"extensionsUsed": [extension], "extensionsRequired": [extension]}
    if form == "embedded":
        doc["buffers"][0]["uri"] = "data:application/octet-stream;base64," + base64.b64encode(blob).decode()
        return json.dumps(doc).encode()
    if form == "separate":
        doc["buffers"][0]["uri"] = "data.bin"
        return json.dumps(doc).encode(), bytes(blob)
    text = _JSON.encode(doc).encode()
    text, blob = text + b" " * (-len(text) % 4), bytes(blob) + b"\0" * (-len(blob) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


def write_glb(meshes: list[dict]) -> bytes:
    """A GLB file with every mesh as it is, uncompressed."""
    return write_gltf(meshes)
