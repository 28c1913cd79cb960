"""Spark data sources for points: a store that is read and written by format name, and Parquet lists of 16-bit numbers.

``points`` keeps a log of segments in a folder that driver and executors share. A write goes to a segment under a name of its
own; tasks put their files there under the names of their attempts, and the segment counts from the moment that the driver
writes its commit file, which lists the files of the attempts that succeeded. A write that fails leaves no commit file, and its
files are removed. Readers see the last write of each identifier and never a part of one.

    register(spark)
    rows.write.format("points").option("path", path).mode("append").save()
    spark.read.format("points").option("path", path).load()

Files are opened by Arrow's file systems: local and shared folders, and stores for which Arrow has one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructType

from tessera.sources.files import arrow_path
from tessera.sources.shipping import ship

#: Points that a task writes to one file, at most.
FILE_POINTS = 1 << 18


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(arrow_path(path))


def _names(fs: pyarrow.fs.FileSystem, folder: str, end: str) -> list[str]:
    found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(end))


def commits(path: str) -> list[dict]:
    """The committed writes of a store, first to last: number, overwrite, files and their points."""
    fs, root = _opened(path)
    out = []
    for name in _names(fs, f"{root}/_commits", ".json"):
        with fs.open_input_file(name) as f:
            out.append(json.loads(f.read()))
    out.sort(key=lambda c: c["number"])
    starts = [i for i, c in enumerate(out) if c["overwrite"]]
    return out[starts[-1] :] if starts else out


@dataclass
class FilePart(InputPartition):
    """One file, and the number of the write that it belongs to."""

    path: str
    number: int
    first: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class PointReader(DataSourceReader):
    """Rows of the committed files; a partition is a file."""

    def __init__(self, path: str, schema: StructType, extra: bool) -> None:
        self.path, self.schema, self.extra = path, schema, extra

    def partitions(self) -> list[FilePart]:
        return [FilePart(name, c["number"], first) for c in commits(self.path) for first, (name, _) in enumerate(c["files"])] or [FilePart("", 0, 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _opened(self.path)
        wanted = to_arrow_schema(self.schema)
        kept = [f for f in wanted if f.name not in ("write", "place")] if self.extra else list(wanted)
        at = partition.first << 33
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(4096, columns=[c.name for c in kept]):
                columns = [batch.column(batch.schema.get_field_index(c.name)).cast(c.type) for c in kept]
                if self.extra:
                    columns += [pa.array([partition.number] * batch.num_rows, pa.int64()), pa.array(range(at, at + batch.num_rows), pa.int64())]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, [c.name for c in wanted])


class PointWriter(DataSourceArrowWriter):
    """Each task writes its own files; the driver commits them all at once, or removes them."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.path)
        folder, files = f"{root}/segments/{self.write_id}", []
        fs.create_dir(folder, recursive=True)
        writer, n, name = None, 0, ""
        schema = to_arrow_schema(self.schema)
        for batch in iterator:
            table = pa.table([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)
            if writer is None:
                name = f"{folder}/{uuid.uuid4().hex}.parquet"
                writer = pq.ParquetWriter(fs.open_output_stream(name), schema, compression="snappy")
            writer.write_table(table)
            n += table.num_rows
            if n >= FILE_POINTS:
                writer.close()
                files.append((name, n))
                writer, n = None, 0
        if writer is not None:
            writer.close()
            files.append((name, n))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        number = 1 + max([c["number"] for c in commits(self.path)], default=0)
        told = {"number": number, "id": self.write_id, "overwrite": self.overwrite, "schema": self.schema.json(), "files": sorted(f for m in messages if m for f in m.files)}
        fs.create_dir(f"{root}/_commits", recursive=True)
        draft = f"{root}/_commits/{self.write_id}.draft"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(told).encode())
        fs.move(draft, f"{root}/_commits/{number:012d}-{self.write_id}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        folder = f"{root}/segments/{self.write_id}"
        if fs.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(folder)


class PointSource(DataSource):
    """The log of a point store. Options: ``path``; ``log``, true for all writes of an identifier, with ``write`` (the number of the
    write) and ``place`` (the row's order in it)."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> StructType:
        held = commits(self.options["path"])
        if not held:
            raise ValueError(f"there is no store at {self.options['path']!r}")
        schema = StructType.fromJson(json.loads(held[-1]["schema"]))
        return schema.add("write", LongType()).add("place", LongType()) if self._log() else schema

    def _log(self) -> bool:
        return self.options.get("log", "false").lower() == "true"

    def reader(self, schema: StructType) -> PointReader:
        return PointReader(self.options["path"], schema, self._log())

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        return PointWriter(self.options["path"], schema, overwrite)


class HalfReader(DataSourceReader):
    """Parquet files with lists of 16-bit numbers; a partition is a row group."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[FilePart]:
        fs, root = _opened(self.path)
        names = [root] if fs.get_file_info(root).type == pyarrow.fs.FileType.File else [n for n in _names(fs, root, ".parquet") if "/_" not in n]
        out = []
        for name in names:
            with fs.open_input_file(name) as f:
                out += [FilePart(name, g, 0) for g in range(pq.ParquetFile(f).num_row_groups)]
        return out or [FilePart("", 0, 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _opened(self.path)
        schema = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1024, row_groups=[partition.number], columns=schema.names):
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c.name)).cast(c.type) for c in schema], schema.names)


class HalfSource(DataSource):
    """``spark.read.format("half_vectors").option("path", path).load()``: 16-bit numbers come as 32-bit ones."""

    @classmethod
    def name(cls) -> str:
        return "half_vectors"

    def schema(self) -> StructType:
        fs, root = _opened(self.options["path"])
        first = root if fs.get_file_info(root).type == pyarrow.fs.FileType.File else _names(fs, root, ".parquet")[0]
        with fs.open_input_file(first) as f:
            held = pq.ParquetFile(f).schema_arrow
        return from_arrow_schema(pa.schema([pa.field(c.name, _widened(c.type)) for c in held]))

    def reader(self, schema: StructType) -> HalfReader:
        return HalfReader(self.options["path"], schema)


def _widened(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_float16(kind):
        return pa.float32()
    return pa.list_(_widened(kind.value_type)) if pa.types.is_list(kind) or pa.types.is_fixed_size_list(kind) else kind


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    ship(spark)
    spark.dataSource.register(PointSource)
    spark.dataSource.register(HalfSource)
