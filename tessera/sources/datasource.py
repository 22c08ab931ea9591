"""Meshes as a data source: spark.read.format("shapes").load(folder), and df.write.format("shapes").option("form", "glb").save(folder).

Register it with register(spark). Options of reading: word and extension, in UTF-8, for files with compressed streams. Options of writing: form (one of meshes.WRITERS).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.sources import meshes


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return meshes.MESH

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(dict(self.options), [f.name for f in schema])


class ShapeReader(DataSourceReader):
    """Files are dealt into partitions of about the same bytes."""

    PARTITION_BYTES = 32 << 20

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        fs, root = _located(self.options["path"])
        info = fs.get_file_info(root)
        found = [info] if info.type == pa.fs.FileType.File else [f for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out, held = [Files([])], 0
        for f in sorted(found, key=lambda f: f.path):
            if held > self.PARTITION_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        word, extension = self.options.get("word"), self.options.get("extension")
        options = {"word": word.encode() if word else None, "extension": extension, "decode": meshes.stream_decoder(word.encode() if word else None) if extension else None}
        fs, _ = _located(self.options["path"])
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as f:
                content = f.read()
            try:
                rows = [(path, i, m["name"], m["positions"], m["normals"], m["colors"], m["uvs"], m["faces"], None) for i, m in enumerate(meshes.parse(path, content, **options))]
            except (ValueError, KeyError, IndexError, TypeError, OSError) as e:
                rows = [(path, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
            for r in rows:
                yield tuple([list(map(list, x)) if isinstance(x, list) else x for x in r])


class ShapeWriter(DataSourceWriter):
    """A file for each row, under a name of its own; those of attempts that did not commit are removed."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def write(self, rows: Iterator) -> Written:
        form = self.options.get("form", "glb")
        fs, root = _located(self.options["path"])
        fs.create_dir(root, recursive=True)
        files = []
        for r in rows:
            m = {**dict.fromkeys(("positions", "normals", "colors", "uvs", "faces"), None), **dict(zip(self.columns, r, strict=True))}
            m = {k: (v or []) if k in ("positions", "normals", "colors", "uvs", "faces") else v for k, v in m.items()} | {"name": m.get("name") or ""}
            path = f"{root}/{m['name'] or 'mesh'}-{uuid.uuid4().hex}.{form.partition('_')[0]}"
            with fs.open_output_stream(path, compression=None) as out:
                out.write(meshes.WRITERS[form](m))
            files.append(path)
        return Written(files)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        fs, _ = _located(self.options["path"])
        for m in messages:
            for path in m.files if m else []:
                fs.delete_file(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapeSource)
