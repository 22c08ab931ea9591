"""Meshes from and to files, as DataFrames: files are read as binary rows and parsed where they are, one row a mesh."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import fbx, formats, streams

MESH = "file string, mesh int, name string, positions array<array<double>>, normals array<array<double>>, colors array<array<int>>, uvs array<array<double>>, faces array<array<int>>, error string"
_ARROW = pa.schema([("file", pa.string()), ("mesh", pa.int32()), ("name", pa.string()), *[(k, pa.list_(pa.list_(t))) for k, t in (("positions", pa.float64()), ("normals", pa.float64()), ("colors", pa.int32()), ("uvs", pa.float64()), ("faces", pa.int32()))], ("error", pa.string())])


LISTS = ("positions", "normals", "colors", "uvs", "faces")
#: Bytes of files whose meshes leave in one batch.
BATCH_BYTES = 4 << 20


def parse(path: str, content: bytes, **options) -> list[dict]:
    """By the first bytes, or else the name."""
    stem, ending = os.path.splitext(os.path.basename(path))
    if content[:4] == b"glTF" or ending == ".gltf":
        return formats.read_gltf(content, sibling(path), **{k: v for k, v in options.items() if k in ("extension", "decode")})
    if options.get("word") is not None and content[:5] == options["word"]:
        return [of_shape(streams.read_stream(content, options["word"]), stem)]
    if content[: len(fbx.MAGIC)] == fbx.MAGIC:
        return fbx.read_fbx(content)
    if content.lstrip()[:3] == b"ply":
        return [formats.read_ply(content, stem)]
    if ending == ".obj":
        return [formats.read_obj(content, name=stem, **{k: v for k, v in options.items() if k in ("whole_polygons", "expand")})]
    raise formats.FormatError(f"unknown format: {path}")


def sibling(path: str):
    """A function that reads a file by its uri relative to the folder of path."""
    def fetch(uri: str) -> bytes:
        fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        with fs.open_input_stream(os.path.join(os.path.dirname(name), uri), compression=None) as f:
            return f.read()

    return fetch


#: Semantics of a mesh's columns as kinds of a stream's attributes.
KINDS = {"positions": streams.POSITION, "normals": streams.NORMAL, "colors": streams.COLOR, "uvs": streams.TEXCOORD}
SEMANTICS = {"positions": "POSITION", "normals": "NORMAL", "colors": "COLOR_0", "uvs": "TEXCOORD_0"}
#: Bits that a stream's attributes are quantized to unless others are asked for.
QUANTIZATION = {streams.POSITION: 14, streams.NORMAL: 10, streams.COLOR: 8, streams.TEXCOORD: 12, streams.GENERIC: 8}


def to_shape(m: dict) -> streams.Shape:
    n = len(m["positions"])
    columns = [(k, np.array(m[k], "u1" if k == "colors" else "f4").reshape(n, -1)) for k in KINDS if m[k] and len(m[k]) == n]
    return streams.Shape(np.array(m["faces"], np.int64).reshape(-1, 3) if m["faces"] else None, [streams.Attribute(KINDS[k], v, k == "colors") for k, v in columns])


def of_shape(shape: streams.Shape, name: str) -> dict:
    """The first attribute of each kind; integer positions become floats."""
    get = lambda k: a.values if (a := shape.first(KINDS[k])) else ()
    return formats.mesh(get("positions"), () if shape.faces is None else shape.faces, get("normals"), get("colors"), get("uvs"), name)


def stream_encoder(word: bytes, bits: dict[int, int] | None = None, speed: int = 7):
    """For write_gltf: a mesh to its stream and the unique ids of its attributes."""
    def encode(m: dict) -> tuple[bytes, dict[str, int]]:
        ids = [k for k in KINDS if m[k] and len(m[k]) == len(m["positions"])]
        return streams.write_stream(to_shape(m), word, QUANTIZATION if bits is None else bits, speed), {SEMANTICS[k]: i for i, k in enumerate(ids)}

    return encode


def stream_decoder(word: bytes | None = None):
    """For read_gltf: a stream to its values by unique id, and its faces."""
    def decode(data: bytes) -> dict:
        shape = streams.read_stream(data, word)
        return {a.unique_id: a.values for a in shape.attributes} | {"faces": () if shape.faces is None else shape.faces}

    return decode


def read_scene(path: str, content: bytes) -> list[dict]:
    """The nodes of a file (node, parent, name, mesh, matrix); formats without scenes have one root, named by the file."""
    if content[:4] == b"glTF" or path.endswith(".gltf"):
        return formats.read_gltf_scene(content)
    if content[: len(fbx.MAGIC)] == fbx.MAGIC:
        return fbx.read_fbx_scene(content)
    return [{"node": 0, "parent": None, "name": os.path.splitext(os.path.basename(path))[0], "mesh": 0, "matrix": np.eye(4).ravel().tolist()}]


SCENE = "file string, node bigint, parent bigint, name string, mesh int, matrix array<double>, error string"


def scenes(files: DataFrame) -> DataFrame:
    """files (path, content) -> SCENE, a row a node; a file that cannot be read is one row with its error."""
    schema = pa.schema([("file", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("name", pa.string()), ("mesh", pa.int32()), ("matrix", pa.list_(pa.float64())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"file": path, "error": None, **n} for n in read_scene(path, content)]
                except (ValueError, KeyError, IndexError, TypeError) as e:
                    rows.append({"file": path, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, SCENE)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row a mesh of every file under path (a folder or pattern). A file that cannot be read is one row with its error."""
    return parsed(spark.read.format("binaryFile").load(path).select("path", "content"), **options)


def parsed(files: DataFrame, **options) -> DataFrame:
    """files (path, content) -> MESH."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"file": path, "mesh": i, "error": None, **m} for i, m in enumerate(parse(path, content, **options))]
                except (ValueError, KeyError, IndexError, TypeError, OSError) as e:
                    rows.append({"file": path, "mesh": 0, "error": f"{type(e).__name__}: {e}"[:200]})
                held += len(content)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, MESH)


def points(meshes: DataFrame) -> DataFrame:
    """(file, mesh, point, position, normal, color, uv)."""
    at = lambda c: F.get(c, F.col("point"))
    d = meshes.where("error is null").select("file", "mesh", F.posexplode("positions").alias("point", "position"), "normals", "colors", "uvs")
    return d.select("file", "mesh", "point", "position", at("normals").alias("normal"), at("colors").alias("color"), at("uvs").alias("uv"))


def faces(meshes: DataFrame) -> DataFrame:
    """(file, mesh, f, p0, p1, p2)."""
    d = meshes.where("error is null").select("file", "mesh", F.posexplode("faces").alias("f", "p"))
    return d.select("file", "mesh", "f", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3)])


WRITERS = {
    "obj": lambda m: formats.write_obj([m]), "ply": formats.write_ply, "glb": lambda m: formats.write_glb([m]), "fbx": lambda m: fbx.write_fbx([m]),
    "ply_little": lambda m: formats.write_ply(m, "binary_little_endian"), "ply_big": lambda m: formats.write_ply(m, "binary_big_endian"),
}


def encoded(meshes: DataFrame, form: str) -> DataFrame:
    """meshes (MESH) -> (path, content), a file for each mesh."""
    write, ending = WRITERS[form], form.partition("_")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # empty and null columns are told apart from others as a whole: most meshes have neither normals nor colors
            columns = {k: b.column(k).to_pylist() if len(b.column(k).flatten()) else [[]] * len(b) for k in LISTS}
            names, numbers = b.column("name").to_pylist(), b.column("mesh").to_pylist()
            rows = [dict(zip(("name", *LISTS), (name or "", *(v or [] for v in lists)), strict=True)) for name, lists in zip(names, zip(*columns.values(), strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{n or 'mesh'}-{i}.{ending}" for n, i in zip(names, numbers, strict=True)], pa.string()), pa.array([write(r) for r in rows], pa.binary())], ["path", "content"])

    return meshes.mapInArrow(run, "path string, content binary")


def write(files: DataFrame, folder: str) -> DataFrame:
    """Write each (path, content) into folder; returns (path, bytes). Files have fixed names and contents, so a task that runs again writes the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(c) for c in b.column(1).to_pylist()], pa.int64())], ["path", "bytes"])

    return files.mapInArrow(run, "path string, bytes bigint")
