"""Array files by row ranges: a Spark data source over ``.npy`` and ``.npz``, read by offset, written a range of rows a task."""

from __future__ import annotations

import ast
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of rows that a task reads, and that it turns into one batch.
RANGE, BATCH = 32 << 20, 4 << 20
# Fixed values of the format: what a file begins with, and the name of the list of written files.
MAGIC, MANIFEST = b"\x93NUMPY", "rows.json"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(f) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, whether columns come first, and where the values begin; pickled content is refused."""
    start = f.read(8)
    if start[:6] != MAGIC:
        raise ValueError("this is no array file")
    n = struct.unpack("<H", f.read(2))[0] if start[6] == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(n).decode("utf-8" if start[6] == 3 else "latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("pickled arrays are not read")
    return tuple(head["shape"]), kind, head["fortran_order"], (10 if start[6] == 1 else 12) + n


@dataclass
class Rows(InputPartition):
    """Rows ``a`` to ``b`` of an array that begins at byte ``base`` of a file, or of a member that has to be inflated first."""

    path: str
    name: str
    a: int
    b: int
    base: int
    size: int
    kind: str
    member: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int | None):
        self.path, self.rows = path, rows

    def _files(self) -> list[str]:
        system, where = _at(self.path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            names = [f.path for f in system.get_file_info(fs.FileSelector(where)) if f.path.endswith((".npy", ".npz"))]
        else:
            names = [where]
        prefix = self.path[: len(self.path) - len(where)] if self.path.endswith(where) else ""
        return [prefix + n for n in sorted(names)]

    def partitions(self) -> list[Rows]:
        out = []
        for path in self._files():
            system, where = _at(path)
            with system.open_input_file(where) as f:
                if where.endswith(".npy"):
                    out += self._ranges(path, "", f, 0)
                    continue
                with zipfile.ZipFile(f) as z:
                    for info in z.infolist():
                        name = info.filename.removesuffix(".npy")
                        if info.compress_type == zipfile.ZIP_STORED:
                            f.seek(info.header_offset + 26)
                            a, b = struct.unpack("<HH", f.read(4))
                            base = info.header_offset + 30 + a + b
                            f.seek(base)
                            out += self._ranges(path, name, f, base)
                        else:
                            with z.open(info) as m:
                                out += self._ranges(path, name, m, 0, info.filename)
        return out

    def _ranges(self, path: str, name: str, f, base: int, member: str | None = None) -> list[Rows]:
        shape, kind, turned, head = _header(f)
        if turned and len(shape) > 1:
            raise ValueError(f"{path} holds columns first; rows cannot be read by offset")
        n, size = (shape[0], int(np.prod(shape[1:]))) if shape else (1, 1)
        step = n if member else self.rows or max(1, RANGE // max(1, size * kind.itemsize))
        return [Rows(path, name, a, min(n, a + step), base + head, size, kind.str, member) for a in range(0, n, max(1, step))]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p, kind = partition, np.dtype(partition.kind)
        system, where = _at(p.path)
        step = max(1, BATCH // max(1, p.size * kind.itemsize))
        with system.open_input_file(where) as f:
            if p.member:
                with zipfile.ZipFile(f) as z, z.open(p.member) as m:
                    _header(m)
                    yield from self._batches(p, m, kind, step)
            else:
                f.seek(p.base + p.a * p.size * kind.itemsize)
                yield from self._batches(p, f, kind, step)

    def _batches(self, p: Rows, f, kind: np.dtype, step: int) -> Iterator[pa.RecordBatch]:
        for a in range(p.a, p.b, step):
            n = min(step, p.b - a)
            x = np.frombuffer(f.read(n * p.size * kind.itemsize), kind).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p.size + 1, p.size, dtype=np.int32) if p.size else np.zeros(n + 1, np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array([p.path] * n, pa.string()), pa.array([p.name] * n, pa.string()), pa.array(np.arange(a, a + n), pa.int64()), values], names=["source_file", "name", "row", "values"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None = None
    first: int = 0
    rows: int = 0


class _Writer(DataSourceArrowWriter):
    """Each task writes its rows as one file, appended batch by batch; its header, of a fixed size, is what is written last."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path.rstrip("/"), kind, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, where = _at(self.path)
        system.create_dir(where, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.npy"
        out, n, first, width, before = None, 0, 0, 0, None
        body = io.BytesIO()
        for b in iterator:
            if not len(b):
                continue
            row, values = b.column("row").to_numpy(), b.column("values")
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            if out is None:
                first, width, before = int(row[0]), x.shape[1], int(row[0]) - 1
                out = system.open_output_stream(f"{where}/_{name}")
            if x.shape[1] != width or (np.diff(row, prepend=before) != 1).any():
                raise ValueError("rows must be of one length, in order and without gaps in a task")
            out.write(np.ascontiguousarray(x, np.dtype(self.kind)).tobytes())
            n, before = n + len(b), int(row[-1])
        if out is None:
            return Written()
        out.close()
        # The header is known now: it goes before the values, which are copied in pieces.
        np.lib.format.write_array_header_1_0(body, {"descr": np.dtype(self.kind).str, "fortran_order": False, "shape": (n, width)})
        with system.open_input_stream(f"{where}/_{name}") as f, system.open_output_stream(f"{where}/{name}.tmp") as whole:
            whole.write(body.getvalue())
            while piece := f.read(BATCH):
                whole.write(piece)
        system.delete_file(f"{where}/_{name}")
        return Written(name, first, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, where = _at(self.path)
        done = sorted((m for m in messages if m and m.file), key=lambda m: m.first)
        for a, b in zip(done[:-1], done[1:], strict=True):
            if a.first + a.rows != b.first:
                raise ValueError(f"rows {a.first + a.rows} to {b.first} are missing or there twice")
        for k, m in enumerate(done):
            system.move(f"{where}/{m.file}.tmp", f"{where}/rows-{k:05d}.npy")
        with system.open_output_stream(f"{where}/{MANIFEST}") as f:
            f.write(json.dumps([{"file": f"rows-{k:05d}.npy", "first": m.first, "rows": m.rows} for k, m in enumerate(done)]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, where = _at(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{where}/{m.file}.tmp")


class ArrayRows(DataSource):
    """``spark.read.format("array_rows")``: ``(source_file, name, row, values)`` of arrays, a row range a task.

    Options: ``path``, a file or folder of any store that pyarrow opens;
    ``rows``, how many a task reads. Values of further dimensions lie in a row;
    deflated members are one task, inflated as they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "source_file string, name string, row long, values array<double>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options["rows"]) if "rows" in self.options else None)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("kind", "<f8"), overwrite)


def read(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Arrays of a file or folder, a row range a task."""
    spark.dataSource.register(ArrayRows)
    found = spark.read.format("array_rows").option("path", path)
    return (found if rows is None else found.option("rows", str(rows))).load()


def write(df: DataFrame, path: str, row: str, values: str, *, parts: int = 8, kind: str = "<f4") -> None:
    """The array column in the order of ``row`` (0 to n - 1, each once) as ``.npy`` files of row ranges, and the list of them.

    Tasks write ranges of rows; what a task that is lost has written is never
    part of the result. A gap or a row that is there twice is an error.
    """
    spark = df.sparkSession
    spark.dataSource.register(ArrayRows)
    x = df.select(F.lit("").alias("source_file"), F.lit("").alias("name"), F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("values"))
    x = x.repartitionByRange(parts, "row").sortWithinPartitions("row")
    x.write.format("array_rows").option("path", path).option("kind", kind).mode("append").save()


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """``(values, row)`` of what :func:`write` made, numbered over all files by its list."""
    system, where = _at(path.rstrip("/"))
    with system.open_input_stream(f"{where}/{MANIFEST}") as f:
        listed = json.loads(f.read())  # a row a file
    firsts = spark.createDataFrame([(x["file"], x["first"]) for x in listed], "_file string, _first long")
    x = read(spark, path).withColumn("_file", F.element_at(F.split("source_file", "/"), -1))
    return x.join(F.broadcast(firsts), "_file").select((F.col("row") + F.col("_first")).alias("row"), "values")
