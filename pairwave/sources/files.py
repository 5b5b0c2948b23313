"""Binary catalogs as a Spark data source: spark.read.format("pairwave") and df.write.format("pairwave"), after register(spark).

Options: kind, and path (a URI that pyarrow knows, or an absolute local path; a file or a folder).

Reading: kind is fits (the columns of the first binary table, under their names), fits-healpix and numpy-healpix (pix, value, nside, nest), binary (packed
doubles), gadget (x, y, z, vx, vy, vz, particle, box). The first file's header gives the schema; files are dealt to tasks in ranges of rows of some RANGE
bytes, small files several to a task. columns: names, by comma, of those wanted; only these are decoded. With pix (bounds, as in "0,1000") a
full map's ranges outside aren't read.

Writing: kind is fits (columns under their names in capitals; cards: more cards of the header, as JSON), binary (all columns as rows of doubles), numpy-healpix (pix, value,
nside as records) or numpy (one column). Each task writes a file, more for very many rows, into a folder beside the target. When all tasks have ended, the commit moves
the folder to the target's place (overwrite) or its files into the target (append); after a failure the abort deletes it, and what was there stays.
"""

from __future__ import annotations

import json
import time
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship
from . import binary

NAME = "pairwave"
#: Rows after which a task begins another file.
FILE_ROWS = 1 << 24

_registered: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, once."""
    if spark not in _registered:
        ship(spark)
        spark.dataSource.register(CatalogFiles)
        _registered.add(spark)


def known(uri: str) -> bool:
    """Whether pyarrow has the file system of a URI."""
    return uri.split(":")[0] in ("file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")


def _table(raw: list[bytes], _: int, info: dict) -> dict[str, np.ndarray]:
    """Columns of a FITS table as numbers (vectors: a list for each row) or text."""
    data, out = np.frombuffer(raw[0], binary._row_type(info["cards"])), {}
    for k, name in enumerate(data.dtype.names):
        if data[name].dtype.kind == "S":
            out[name] = np.char.decode(data[name], "ascii", "replace")
        elif data[name].ndim > 1:
            out[name] = list(binary._column(data, info["cards"], k).reshape(len(data), -1))
        else:
            out[name] = binary._column(data, info["cards"], k)
    return out


def _of_table(info: dict) -> T.StructType:
    kind = binary._row_type(info["cards"])
    return T.StructType([T.StructField(n, T.StringType() if kind[n].kind == "S" else T.ArrayType(T.DoubleType()) if kind[n].shape else T.DoubleType()) for n in kind.names])


def _struct(fields: str) -> T.StructType:
    """The type of fields given as "name type, ..."; a source's worker has no session that would parse it."""
    types = {"long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def _packed(raw: list[bytes], _: int, info: dict) -> dict[str, np.ndarray]:
    data = np.frombuffer(raw[0], "<f8").reshape(-1, info["width"])
    return {c: data[:, k] for k, c in enumerate(binary.PACKED_NAMES[: info["width"]])}


def _frame(part):
    return lambda raw, first, info: {c: v for c, v in part(raw, first, info).items()}


_PIXELS = "pix long, value double, nside int, nest boolean"
#: Of each kind: where its rows lie, columns from their bytes, and the schema.
KINDS = {
    "fits": (binary.table_layout, _table, _of_table),
    "fits-healpix": (binary.table_layout, _frame(binary.map_rows), lambda _: _struct(_PIXELS)),
    "numpy-healpix": (binary.array_layout, _frame(binary.array_rows), lambda _: _struct(_PIXELS)),
    "binary": (binary.packed_layout, _packed, lambda info: _struct(", ".join(f"{c} double" for c in binary.PACKED_NAMES[: info["width"]]))),
    "gadget": (binary.snapshot_layout, _frame(binary.particles), lambda _: _struct(binary.PARTICLES)),
}


def encoded(kind: str, columns: dict[str, np.ndarray], cards: dict) -> tuple[bytes, str]:
    """A file's bytes, and the end of its name."""
    if kind == "fits":
        return binary.fits_bytes({k.upper(): v for k, v in columns.items()}, cards), "fits"
    if kind == "binary":
        return binary.packed_bytes(columns), "bin"
    if kind == "numpy-healpix":
        return binary.array_bytes(binary.records(columns)), "npy"
    if kind == "numpy":
        return binary.array_bytes(next(iter(columns.values()))), "npy"
    raise ValueError(f"no such kind: {kind}")


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some FILE_ROWS rows at most from a task's batches."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= FILE_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class CatalogFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _kind(self) -> str:
        kind = self.options.get("kind", "fits")
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind}")
        return kind

    def schema(self) -> T.StructType:
        layout, _, names = KINDS[self._kind()]
        files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no files in {self.options['path']}")
        with binary.opened(files[0][0]) as f:
            have = names(layout(f)[3])
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if unknown := set(wanted) - set(have.names):
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return T.StructType([have[c] for c in wanted]) if wanted else have

    def reader(self, schema: T.StructType) -> DataSourceReader:
        bounds = self.options.get("pix")
        return Ranges(self._kind(), self.options["path"], schema, tuple(map(int, bounds.split(","))) if bounds else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], self.options.get("kind", "fits"), json.loads(self.options.get("cards", "{}")), overwrite)


def listed(path: str) -> list[tuple[str, int]]:
    """URIs or paths and sizes of a file, or of the files in a folder, in order."""
    system, where = fs.FileSystem.from_uri(path)
    found = system.get_file_info(where)
    inner = system.get_file_info(fs.FileSelector(where)) if found.type == fs.FileType.Directory else [found]
    ahead = path.removesuffix("/").removesuffix(where.removesuffix("/"))
    return sorted((ahead + i.path, i.size) for i in inner if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """Ranges of rows: file, places of the segments, bytes of a row in each, first row, rows, and what parsing needs."""

    parts: list[tuple[str, list[int], list[int], int, int, dict]]


class Ranges(DataSourceReader):
    def __init__(self, kind: str, path: str, schema: T.StructType, pix: tuple[int, int] | None):
        self.kind, self.path, self.schema, self.pix = kind, path, schema, pix

    def partitions(self) -> list[Range]:
        layout, out, held, size = KINDS[self.kind][0], [], [], 0
        for uri, _ in listed(self.path):
            with binary.opened(uri) as f:
                begins, widths, n, info = layout(f)
            first, end = self._rows(n, info)
            width = sum(widths)
            step = max(1, binary.RANGE // width)
            for at in range(first, end, step):
                many = min(step, end - at)
                held.append((uri, begins, widths, at, many, info))
                size += many * width
                if size >= binary.RANGE // 2:
                    out.append(Range(held))
                    held, size = [], 0
        if held or not out:
            out.append(Range(held))
        return out

    def _rows(self, n: int, info: dict) -> tuple[int, int]:
        """First row and row after the last that may have a pixel within the bounds; rows of a full map are its pixels in order."""
        if not self.pix or not (per_row := binary.pixels_per_row(self.kind, info)):
            return 0, n
        return min(n, max(0, self.pix[0]) // per_row), min(n, max(0, -(-self.pix[1] // per_row)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        decode, names = KINDS[self.kind][1], self.schema.names
        for uri, begins, widths, first, many, info in partition.parts:
            with binary.opened(uri) as f:
                for at in range(0, many, binary.BATCH):
                    n = min(binary.BATCH, many - at)
                    found = decode([f.read_at(n * w, b + (first + at) * w) for b, w in zip(begins, widths, strict=True)], first + at, info)
                    batch = pa.RecordBatch.from_arrays([pa.array(found[c], from_pandas=c == "particle") for c in names], names)
                    if self.pix and "pix" in found:
                        batch = batch.filter(pa.array((np.asarray(found["pix"]) >= self.pix[0]) & (np.asarray(found["pix"]) < self.pix[1])))
                    yield batch


@dataclass
class Written(WriterCommitMessage):
    """Names of the files of one task."""

    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, cards: dict, overwrite: bool):
        self.path, self.kind, self.cards, self.overwrite = path.rstrip("/"), kind, cards, overwrite
        self.mark = uuid.uuid4().hex
        # Made once, by the driver: tasks that still run after an abort find no folder.
        system, _, beside = self._places()
        system.create_dir(beside, recursive=True)

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        system, where = fs.FileSystem.from_uri(self.path)
        return system, where, f"{where}.writing-{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, _, beside = self._places()
        task, names = TaskContext.get().partitionId(), []
        attempt = uuid.uuid4().hex[:8]  # a task that runs twice: the commit takes the files that its message names
        for table in bounded(iterator):
            content, ending = encoded(self.kind, {c: table.column(c).to_numpy() for c in table.column_names}, self.cards)
            names.append(f"part-{task:05d}-{len(names):05d}-{attempt}.{ending}")
            with system.open_output_stream(f"{beside}/{names[-1]}") as out:
                out.write(content)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, where, beside = self._places()
        wanted = {n for m in messages if m for n in m.names}
        for found in system.get_file_info(fs.FileSelector(beside)):
            if found.base_name not in wanted:
                system.delete_file(found.path)
        if not self.overwrite:
            system.create_dir(where, recursive=True)
            for name in sorted(wanted):
                system.move(f"{beside}/{name}", f"{where}/{name}")
            return system.delete_dir(beside)
        old = f"{where}.old-{self.mark}"
        there = system.get_file_info(where).type != fs.FileType.NotFound
        if there:
            system.move(where, old)
        try:
            system.move(beside, where)
        except OSError:
            if there:
                system.move(old, where)
            raise
        if there:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, beside = self._places()
        for last in range(20):
            try:
                if system.get_file_info(beside).type != fs.FileType.NotFound:
                    system.delete_dir(beside)
                return
            except OSError:  # a task still writes there
                if last == 19:
                    raise
                time.sleep(0.1)
