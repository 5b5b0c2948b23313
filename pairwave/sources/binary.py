"""Binary catalogs: FITS tables and maps, GADGET snapshots, NumPy maps, Fortran-record maps, packed doubles.

A file is one row of Spark's binaryFile source, so it may come from any file system, and is parsed with NumPy in
the executors. Tables, maps and packed catalogs beyond RANGE bytes are read in ranges of rows, a task each, where pyarrow knows the
file system (local or shared folders, HDFS, object stores); their size has no bound then. Snapshots must fit into a task: they come in parts.
"""

from __future__ import annotations

import io
import json
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import catalog, from_sky, number
from ..functions import healpix
from ..functions.geometry import wrap

#: Rows of an Arrow batch.
BATCH = 100_000
#: Bytes of a file beyond which it is read in ranges, and bytes of a range.
RANGE = 128 << 20
BLOCK = 2880
#: NumPy types of FITS table columns, big-endian.
FITS_TYPES = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def _files(spark: SparkSession, path: str | list[str], parse: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                df = parse(name, bytes(content))
                for at in range(0, len(df), BATCH):
                    yield df.iloc[at : at + BATCH]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def opened(uri: str):
    """A file for reading at any place, by URI."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    return system.open_input_file(where)


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files that a path, folder or pattern names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(where) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [(f.getPath().toString(), f.getLen()) for f in inner if not f.isDirectory() and not f.getPath().getName().startswith((".", "_"))]
    return out


#: Of a file: places where rows of each segment begin, bytes of a row in each, rows, and what parsing needs.
Layout = tuple[list[int], list[int], int, dict]


def _rows(spark: SparkSession, path: str, parse: Callable[[str, bytes], pd.DataFrame], layout: Callable[[object], Layout], part: Callable[[list[bytes], int, dict], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of files: small files whole (parse), large ones in ranges. layout: of an open file; part: rows from the segments' bytes and the number of the first row."""
    files = sizes(spark, path)
    large = [uri for uri, size in files if size > RANGE]
    if not large:
        return _files(spark, path, parse, schema)
    tasks = []
    for uri in large:
        with opened(uri) as f:
            begins, widths, n, info = layout(f)
        step = max(1, RANGE // sum(widths))
        tasks += [(uri, begins, widths, at, min(step, n - at), json.dumps(info)) for at in range(0, n, step)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, begins_, widths_, first, many, info_ in frame.itertuples(index=False):
                with opened(uri) as f:
                    for at in range(0, many, BATCH):
                        n = min(BATCH, many - at)
                        yield part([f.read_at(n * w, b + (first + at) * w) for b, w in zip(begins_, widths_, strict=True)], first + at, json.loads(info_))

    # A slice for each range, so each has a task of its own.
    plan = spark.createDataFrame(spark.sparkContext.parallelize(tasks, len(tasks)), "uri string, begins array<long>, widths array<long>, first long, many long, info string")
    out = plan.mapInPandas(run, schema)
    small = [uri for uri, size in files if size <= RANGE]
    return out.union(_files(spark, small, parse, schema)) if small else out


# FITS.


def fits_layout(f) -> tuple[dict[str, str], np.dtype, int, int]:
    """Header, row type, rows and place of an open file's first binary table."""
    size, at = f.size(), 0
    while at < size:
        head = b""
        while not head or not any(head[k : k + 80].strip() == b"END" for k in range(len(head) - BLOCK, len(head), 80)):
            block = f.read_at(BLOCK, at + len(head))
            if len(block) < BLOCK:
                raise ValueError("broken FITS header")
            head += block
        cards, _ = fits_cards(head, 0)
        at += len(head)
        if cards.get("XTENSION") == "BINTABLE":
            return cards, _row_type(cards), int(cards["NAXIS2"]), at
        at += -(-_data_size(cards) // BLOCK) * BLOCK
    raise ValueError("no binary table")


def _data_size(cards: dict[str, str]) -> int:
    axes = [int(cards[f"NAXIS{k + 1}"]) for k in range(int(cards.get("NAXIS", 0)))]
    return abs(int(cards.get("BITPIX", 8))) // 8 * math.prod(axes) + int(cards.get("PCOUNT", 0)) if axes else 0


def _row_type(cards: dict[str, str]) -> np.dtype:
    fields = []
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = cards[f"TFORM{k}"]
        kind = form.lstrip("0123456789")[:1]
        many = int(form[: len(form) - len(form.lstrip("0123456789"))] or 1)
        base = f"S{many}" if kind == "A" else FITS_TYPES[kind]
        fields.append((cards.get(f"TTYPE{k}", f"col{k}"), base) if kind == "A" or many == 1 else (cards.get(f"TTYPE{k}", f"col{k}"), base, (many,)))
    return np.dtype(fields)


def table_layout(f) -> Layout:
    cards, kind, n, at = fits_layout(f)
    return [at], [kind.itemsize], n, {"cards": cards}


def fits_cards(raw: bytes, at: int) -> tuple[dict[str, str], int]:
    """Values of a header's cards by keyword, and the place after the header."""
    cards: dict[str, str] = {}
    while True:
        block = raw[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("broken FITS header")
        at += BLOCK
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[key] = value[1 : value.index("'", 1)].strip() if value.startswith("'") else value.split("/")[0].strip()


def fits_tables(raw: bytes) -> list[tuple[dict[str, str], np.ndarray]]:
    """Headers and structured arrays of all binary tables."""
    at, out = 0, []
    while at < len(raw) and raw[at : at + BLOCK].strip(b"\0 "):
        cards, at = fits_cards(raw, at)
        if cards.get("XTENSION") == "BINTABLE":
            out.append((cards, np.frombuffer(raw, _row_type(cards), int(cards["NAXIS2"]), at)))
        at += -(-_data_size(cards) // BLOCK) * BLOCK
    return out


def _column(data: np.ndarray, cards: dict[str, str], k: int) -> np.ndarray:
    name = data.dtype.names[k]
    value = data[name].astype(np.float64).ravel()
    return value * float(cards.get(f"TSCAL{k + 1}", 1)) + float(cards.get(f"TZERO{k + 1}", 0))


def fits_columns(spark: SparkSession, path: str, columns: list[int]) -> DataFrame:
    """c1, c2, ... (double): chosen 1-based columns of each file's first binary table."""

    def parse(_: str, raw: bytes) -> pd.DataFrame:
        cards, data = fits_tables(raw)[0]
        return pd.DataFrame({f"c{c}": _column(data, cards, c - 1) for c in columns})

    def part(raw: list[bytes], _: int, info: dict) -> pd.DataFrame:
        data = np.frombuffer(raw[0], _row_type(info["cards"]))
        return pd.DataFrame({f"c{c}": _column(data, info["cards"], c - 1) for c in columns})

    return _rows(spark, path, parse, table_layout, part, ", ".join(f"c{c} double" for c in columns))


def _renamed(df: DataFrame, columns: list[int], names: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"c{c}").alias(n) for c, n in zip(columns, names)])


def fits(spark: SparkSession, path: str, columns: list[int] | None = None, **_) -> DataFrame:
    """x y z kappa."""
    c = columns or [1, 2, 3, 4]
    return catalog(number(_renamed(fits_columns(spark, path, c), c, ("x", "y", "z", "kappa"))))


def fits_radec_field(spark: SparkSession, path: str, columns: list[int] | None = None, degrees: bool = True, **_) -> DataFrame:
    c = columns or [1, 2, 3]
    return catalog(number(from_sky(_renamed(fits_columns(spark, path, c), c, ("ra", "dec", "kappa")), "ra", "dec", degrees)))


def fits_radecr_field(spark: SparkSession, path: str, columns: list[int] | None = None, degrees: bool = True, **_) -> DataFrame:
    c = columns or [1, 2, 3, 4]
    return catalog(number(from_sky(_renamed(fits_columns(spark, path, c), c, ("ra", "dec", "r", "kappa")), "ra", "dec", degrees, radius="r")))


def _map_rows(cards: dict[str, str], data: np.ndarray, first: int, field: int) -> pd.DataFrame:
    explicit = cards.get("INDXSCHM", "").upper() == "EXPLICIT"
    value = _column(data, cards, field + explicit)
    many = len(value) // max(1, len(data))  # maps may have several pixels to a row
    pix = data[data.dtype.names[0]].astype(np.int64) if explicit else np.arange(len(value)) + first * many
    nside = int(cards.get("NSIDE") or healpix.npix2nside(int(cards["NAXIS2"]) * many))
    return pd.DataFrame({"pix": pix, "value": value, "nside": np.int32(nside), "nest": cards.get("ORDERING", "RING").upper().startswith("NEST")})


def map_rows(raw: list[bytes], first: int, info: dict, field: int = 0) -> pd.DataFrame:
    """Pixels from bytes of a table's rows."""
    return _map_rows(info["cards"], np.frombuffer(raw[0], _row_type(info["cards"])), first, field)


def pixels_per_row(kind: str, info: dict) -> int | None:
    """Pixels that each row of a full map has, in order; None where rows aren't numbered by pixels."""
    if kind == "numpy-healpix":
        return None if _kind(info["kind"]).names else 1
    if kind != "fits-healpix" or info["cards"].get("INDXSCHM", "").upper() == "EXPLICIT":
        return None
    types = _row_type(info["cards"])
    return math.prod(types[0].shape)


def fits_map(spark: SparkSession, path: str, field: int = 0) -> DataFrame:
    """pix, value, nside, nest: a map's field; pixels are numbered by row, or by the first column in maps of a part of the sky (INDXSCHM EXPLICIT)."""

    def parse(_: str, raw: bytes) -> pd.DataFrame:
        return _map_rows(*fits_tables(raw)[0], 0, field)

    def part(raw: list[bytes], first: int, info: dict) -> pd.DataFrame:
        return map_rows(raw, first, info, field)

    return _rows(spark, path, parse, table_layout, part, "pix long, value double, nside int, nest boolean")


def array_layout(f) -> Layout:
    head = io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if kind.hasobject or fortran and len(shape) > 1:
        raise ValueError("an array of another kind than numbers in order")
    return [head.tell()], [kind.itemsize], math.prod(shape), {"kind": np.lib.format.dtype_to_descr(kind), "rows": math.prod(shape)}


def _kind(described: str | list) -> np.dtype:
    return np.dtype(described if isinstance(described, str) else [tuple(x) for x in described])


def records(columns: dict[str, object]) -> np.ndarray:
    """Records of pixel numbers (long), values (double) and nside (int)."""
    out = np.empty(len(next(iter(columns.values()))), [("pix", "<i8"), ("value", "<f8"), ("nside", "<i4")])
    for name, values in columns.items():
        out[name] = values
    return out


def array_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def _array_rows(value: np.ndarray, first: int, n: int, nest: bool) -> pd.DataFrame:
    if value.dtype.names:
        return pd.DataFrame({"pix": value["pix"], "value": value["value"], "nside": value["nside"], "nest": nest})
    return pd.DataFrame({"pix": np.arange(len(value)) + first, "value": value.astype(np.float64), "nside": np.int32(healpix.npix2nside(n)), "nest": nest})


def array_rows(raw: list[bytes], first: int, info: dict, nest: bool = False) -> pd.DataFrame:
    """Pixels from bytes of an array's elements."""
    return _array_rows(np.frombuffer(raw[0], _kind(info["kind"])), first, info["rows"], nest)


def numpy_map(spark: SparkSession, path: str, nest: bool = False) -> DataFrame:
    """pix, value, nside, nest from .npy files with one number for each pixel, or with records of pixel, value and nside."""

    def parse(_: str, raw: bytes) -> pd.DataFrame:
        value = np.load(io.BytesIO(raw), allow_pickle=False).ravel()
        return _array_rows(value, 0, len(value), nest)

    def part(raw: list[bytes], first: int, info: dict) -> pd.DataFrame:
        return array_rows(raw, first, info, nest)

    return _rows(spark, path, parse, array_layout, part, "pix long, value double, nside int, nest boolean")


def map_catalog(map_: DataFrame, mask: DataFrame | None = None, inside_only: bool = True) -> DataFrame:
    """A map as points on the unit sphere, one for each pixel.

    mask: a map whose positive pixels stay; with inside_only false, all pixels stay and the column mask tells which.
    """
    first = map_.select("nside", "nest").first()
    if first is None:
        return catalog(map_.selectExpr("pix AS id", "0d AS x", "0d AS y", "0d AS z"))
    x, y, z = healpix.pix2vec(first["nside"], F.col("pix"), first["nest"])
    df = map_.select("pix", F.col("pix").alias("id"), F.col("value").alias("kappa"))
    if mask is not None:
        kept = mask.where("value > 0").select("pix", F.lit(True).alias("_in"))
        df = df.join(kept, "pix", "inner" if inside_only else "left").withColumn("mask", F.coalesce("_in", F.lit(False)))
    return catalog(df.withColumns({"x": x, "y": y, "z": z}))


def fits_healpix(spark: SparkSession, path: str, mask: str | None = None, field: int = 0, inside_only: bool = True, **_) -> DataFrame:
    return map_catalog(fits_map(spark, path, field), fits_map(spark, mask) if mask else None, inside_only)


def numpy_healpix(spark: SparkSession, path: str, mask: str | None = None, nest: bool = False, inside_only: bool = True, **_) -> DataFrame:
    return map_catalog(numpy_map(spark, path, nest), numpy_map(spark, mask, nest) if mask else None, inside_only)


def fits_bytes(columns: dict[str, np.ndarray], cards: dict[str, object] | None = None) -> bytes:
    """A FITS file with one binary table of doubles (D) or the arrays' own types."""
    codes = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B"}

    def card(key: str, value: object) -> str:
        shown = f"'{value:<8}'" if isinstance(value, str) else ("T" if value else "F").rjust(20) if isinstance(value, bool) else str(value).rjust(20)
        return f"{key:<8}= {shown}".ljust(80)

    def head(pairs: list[tuple[str, object]]) -> bytes:
        text = "".join(card(k, v) for k, v in pairs) + "END".ljust(80)
        return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")

    arrays = {k: np.asarray(v) for k, v in columns.items()}
    kinds = {k: a.dtype.str[1:] for k, a in arrays.items()}
    data = np.empty(len(next(iter(arrays.values()))), np.dtype([(k, ">" + kinds[k]) for k in arrays]))
    for k, a in arrays.items():
        data[k] = a
    raw = data.tobytes()
    names = [p for i, k in enumerate(arrays, 1) for p in ((f"TTYPE{i}", k), (f"TFORM{i}", codes[kinds[k]]))]
    table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", data.dtype.itemsize), ("NAXIS2", len(data)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(arrays)), *names, *(cards or {}).items()]
    return head([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + head(table) + raw + b"\0" * (-len(raw) % BLOCK)


def map_bytes(values: np.ndarray, nest: bool = False, coordinates: str = "G") -> bytes:
    """A FITS file with one full map of floats."""
    nside = healpix.npix2nside(len(values))
    if nside < 0:
        raise ValueError("no map has so many pixels")
    return fits_bytes({"SIGNAL": np.asarray(values, np.float32)}, {"PIXTYPE": "HEALPIX", "ORDERING": "NESTED" if nest else "RING", "NSIDE": nside, "FIRSTPIX": 0, "LASTPIX": len(values) - 1, "COORDSYS": coordinates, "INDXSCHM": "IMPLICIT"})


# GADGET.


def gadget_blocks(raw: bytes) -> list[bytes]:
    """Records between matching length marks."""
    at, out = 0, []
    while at < len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        if at + 8 + size > len(raw) or struct.unpack_from("<i", raw, at + 4 + size)[0] != size:
            raise ValueError("broken snapshot: length marks differ")
        out.append(raw[at + 4 : at + 4 + size])
        at += 8 + size
    return out


#: Names of a snapshot's first blocks, in their order.
BLOCKS = ("HEAD", "POS", "VEL", "ID")


def gadget_header(block: bytes) -> dict:
    """Numbers of particles, masses, time, redshift, size of the box."""
    counts = np.frombuffer(block, "<i4", 6)
    time, redshift = struct.unpack_from("<2d", block, 72)
    total = np.frombuffer(block, "<i4", 6, 96)
    files, box = struct.unpack_from("<i", block, 124)[0], struct.unpack_from("<d", block, 128)[0]
    return {"counts": counts.tolist(), "mass": np.frombuffer(block, "<f8", 6, 24).tolist(), "time": time, "redshift": redshift, "total": total.tolist(), "files": files, "box": box}


def gadget_index(f) -> list[tuple[str, int, int]]:
    """Name, place and size of an open snapshot's blocks, in format 1 (blocks by their order) or 2 (each behind a block of 8 bytes with its name)."""
    size, at, out, tag = f.size(), 0, [], None
    while at < size:
        (n,) = struct.unpack("<i", f.read_at(4, at))
        if n < 0 or at + 8 + n > size or struct.unpack("<i", f.read_at(4, at + 4 + n))[0] != n:
            raise ValueError("broken snapshot: length marks differ")
        if n == 8 and tag is None and (name := f.read_at(4, at + 4)).strip().isalnum():
            tag = name.decode("ascii").strip()
        else:
            out.append((tag or (*BLOCKS, f"block{len(out)}")[min(len(out), len(BLOCKS))], at + 4, n))
            tag = None
        at += 8 + n
    if not out or out[0][2] != 256:
        raise ValueError("broken snapshot: no header of 256 bytes")
    return out


def snapshot_layout(f) -> Layout:
    """Places of positions, velocities and ids, as far as they are there, so that ranges of particles take the same rows of each."""
    blocks = gadget_index(f)
    head = gadget_header(f.read_at(256, blocks[0][1]))
    n, found = sum(head["counts"]), {name: (at, size) for name, at, size in blocks}
    if found.get("POS", (0, -1))[1] != 12 * n:
        raise ValueError("broken snapshot: positions and header differ")
    taken = [("POS", 12)]
    for name, width in (("VEL", 12), ("ID", found.get("ID", (0, 0))[1] // max(1, n))):
        if width and name in found and found[name][1] == width * n:
            taken.append((name, width))
    return [found[name][0] for name, _ in taken], [width for _, width in taken], n, {"box": head["box"], "names": [name for name, _ in taken]}


PARTICLES = "x double, y double, z double, vx double, vy double, vz double, particle long, box double"


def particles(raw: list[bytes], _: int, info: dict) -> pd.DataFrame:
    """Particles from bytes of a snapshot's blocks."""
    got = dict(zip(info["names"], raw, strict=True))
    pos = np.frombuffer(got["POS"], "<f4").reshape(-1, 3).astype(np.float64)
    vel = np.frombuffer(got["VEL"], "<f4").reshape(-1, 3).astype(np.float64) if "VEL" in got else np.full(pos.shape, np.nan)
    ids = np.frombuffer(got["ID"], f"<u{len(got['ID']) // max(1, len(pos))}").astype(np.int64) if "ID" in got and len(pos) else np.zeros(len(pos), np.int64)
    return pd.DataFrame({**{c: pos[:, k] for k, c in enumerate("xyz")}, **{f"v{c}": vel[:, k] for k, c in enumerate("xyz")}, "particle": pd.array(ids, "Int64") if "ID" in got else pd.array([None] * len(pos), "Int64"), "box": info["box"]})


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, vx, vy, vz, particle (its id), box of snapshots in format 1 or 2 (a file, or a pattern for all parts); large files in ranges of particles. Null: not there."""

    def parse(_: str, raw: bytes) -> pd.DataFrame:
        f = _Bytes(raw)
        begins, widths, n, info = snapshot_layout(f)
        return particles([f.read_at(n * w, b) for b, w in zip(begins, widths, strict=True)], 0, info)

    return _rows(spark, path, parse, snapshot_layout, particles, PARTICLES)


class _Bytes:
    """Bytes read like an open file."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def size(self) -> int:
        return len(self.raw)

    def read_at(self, n: int, at: int) -> bytes:
        return self.raw[at : at + n]


def gadget(spark: SparkSession, path: str, box: float | None = None, **_) -> DataFrame:
    """Positions of a snapshot in format 1 or 2 (one file, or a pattern for all parts), wrapped into the box, with a synthetic field."""
    df = snapshot(spark, path).select("x", "y", "z", "box")
    side = F.lit(box) if box else F.col("box")
    wrapped = df.withColumns({c: F.pmod(F.col(c), side) if box is None else wrap(F.col(c), box) for c in "xyz"})
    return catalog(number(wrapped.withColumn("kappa", wave(side))))


def wave(side) -> "F.Column":
    """The synthetic field of box catalogs: 1 + cos(40 pi x / L) sin(40 pi y / L)."""
    return 1.0 + F.cos(F.col("x") * (40 * math.pi) / side) * F.sin(F.col("y") * (40 * math.pi) / side)


def gadget_bytes(positions: np.ndarray, box: float, redshift: float = 0.0, velocities: np.ndarray | None = None, ids: np.ndarray | None = None, tagged: bool = False) -> bytes:
    """A snapshot of one kind of particles: header and positions, velocities and ids; tagged: format 2."""
    n = len(positions)
    head = np.zeros(256, np.uint8)
    head[:24] = np.array([0, n, 0, 0, 0, 0], "<i4").view(np.uint8)
    head[72:88] = np.array([1 / (1 + redshift), redshift], "<f8").view(np.uint8)
    head[96:120] = np.array([0, n, 0, 0, 0, 0], "<i4").view(np.uint8)
    head[124:128] = np.array([1], "<i4").view(np.uint8)
    head[128:136] = np.array([box], "<f8").view(np.uint8)
    blocks = [("HEAD", head.tobytes()), ("POS ", np.asarray(positions, "<f4").tobytes())]
    if velocities is not None:
        blocks.append(("VEL ", np.asarray(velocities, "<f4").tobytes()))
    if ids is not None:
        blocks.append(("ID  ", np.asarray(ids).tobytes()))
    framed = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    return b"".join((framed(name.encode() + struct.pack("<i", len(b) + 8)) if tagged else b"") + framed(b) for name, b in blocks)


def head_of(uri: str, kind: str) -> tuple:
    """rows, columns, nside, box, other of a binary file, from its first bytes."""
    with opened(uri) as f:
        if kind.startswith("fits"):
            cards, types, n, _ = fits_layout(f)
            many = math.prod(types[0].shape) if len(types) == 1 else 1
            explicit = cards.get("INDXSCHM", "").upper() == "EXPLICIT"
            nside = int(cards["NSIDE"]) if "NSIDE" in cards else None
            if nside is None and kind == "fits-healpix" and not explicit:
                nside = healpix.npix2nside(n * many)
            return n * many, ",".join(types.names), nside, None, cards.get("ORDERING")
        if kind == "numpy-healpix":
            _, _, n, info = array_layout(f)
            names = _kind(info["kind"]).names
            side = healpix.npix2nside(n)
            return n, ",".join(names) if names else "value", side if side > 0 and not names else None, None, None
        if kind == "gadget":
            blocks = gadget_index(f)
            head = gadget_header(f.read_at(256, blocks[0][1]))
            return sum(head["counts"]), ",".join(name for name, _, _ in blocks), None, [head["box"]] * 3, json.dumps({k: head[k] for k in ("redshift", "files", "total")})
        if kind.startswith("takaha"):
            fields, _, n, info = _record_layout(f)
            return n, ",".join(("kappa", "gamma1", "gamma2")[: len(fields)]), info["nside"], None, None
        mark, width, n = struct.unpack(PACKED, f.read_at(struct.calcsize(PACKED), 0))
        if mark != b"PWCAT01\0":
            raise ValueError("not a packed catalog")
        return n, ",".join(PACKED_NAMES[:width]), None, None, None


# Fortran records and packed doubles.


def fortran_map(raw: bytes) -> dict[str, np.ndarray | int]:
    """nside and fields kappa, gamma1, gamma2, omega of a full-sky map: records of nside, number of pixels, then each field in one or more records."""
    records = gadget_blocks(raw)
    nside = int(np.frombuffer(records[0], "<i4")[0])
    npix = healpix.nside2npix(nside)
    values = np.frombuffer(b"".join(r for r in records[1:] if len(r) > 8), "<f4")
    names = ("kappa", "gamma1", "gamma2", "omega")
    if len(values) % npix or not 1 <= len(values) // npix <= len(names):
        raise ValueError("broken map: its records don't hold whole fields")
    return {"nside": nside, **{name: values[k * npix : (k + 1) * npix] for k, name in enumerate(names[: len(values) // npix])}}


def _record_layout(f) -> Layout:
    """Places of the fields of a map whose fields are a record each."""
    at, found, size = 0, [], f.size()
    while at < size:
        (n,) = struct.unpack("<i", f.read_at(4, at))
        if at + 8 + n > size or struct.unpack("<i", f.read_at(4, at + 4 + n))[0] != n:
            raise ValueError("broken map: length marks differ")
        found.append((at + 4, n))
        at += 8 + n
    nside = struct.unpack("<i", f.read_at(4, found[0][0]))[0]
    pixels = healpix.nside2npix(nside)
    fields = [place for place, n in found[1:] if n > 8]
    if any(n != 4 * pixels for _, n in found[1:] if n > 8):
        raise ValueError("a large map whose fields aren't a record each")
    return fields[:3], [4] * len(fields[:3]), pixels, {"nside": nside}


def takahashi(spark: SparkSession, path: str, **_) -> DataFrame:
    """A full-sky map of convergence and shear in Fortran records, ring scheme, as points."""

    def parse(_: str, raw: bytes) -> pd.DataFrame:
        got = fortran_map(raw)
        n = healpix.nside2npix(got["nside"])
        return pd.DataFrame({"id": np.arange(n), "nside": got["nside"], **{k: got[k].astype(np.float64) if k in got else np.nan for k in ("kappa", "gamma1", "gamma2")}})

    names = ("kappa", "gamma1", "gamma2")

    def part(raw: list[bytes], begin: int, info: dict) -> pd.DataFrame:
        got = {name: np.frombuffer(r, "<f4").astype(np.float64) for name, r in zip(names, raw)}
        n = len(got["kappa"])
        return pd.DataFrame({"id": np.arange(n) + begin, "nside": info["nside"], **{k: got.get(k, np.nan) for k in names}})

    df = _rows(spark, path, parse, _record_layout, part, "id long, nside int, kappa double, gamma1 double, gamma2 double")
    first = df.select("nside").first()
    x, y, z = healpix.pix2vec(first["nside"] if first else 1, F.col("id"))
    return catalog(df.withColumns({"x": x, "y": y, "z": z}))


#: Header of the packed format: mark, fields to a row, rows.
PACKED = "<8sqq"
PACKED_NAMES = ("x", "y", "z", "kappa", "weight", "mass", "m")


def packed_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """x, y, z, kappa (and weight, mass, mask with all fields) as rows of doubles behind a header."""
    rows = np.column_stack(list(columns.values())).astype("<f8")
    return struct.pack(PACKED, b"PWCAT01\0", rows.shape[1], rows.shape[0]) + rows.tobytes()


def _packed_head(raw: bytes) -> tuple[int, int]:
    mark, width, n = struct.unpack_from(PACKED, raw)
    if mark != b"PWCAT01\0":
        raise ValueError("not a packed catalog")
    return width, n


def packed_layout(f) -> Layout:
    width, n = _packed_head(f.read_at(struct.calcsize(PACKED), 0))
    return [struct.calcsize(PACKED)], [8 * width], n, {"width": width}


def packed(spark: SparkSession, path: str, **_) -> DataFrame:
    """Catalogs in packed doubles with 4 fields or all 7."""
    names = PACKED_NAMES

    def rows(raw: bytes, width: int) -> pd.DataFrame:
        data = np.frombuffer(raw, "<f8").reshape(-1, width)
        return pd.DataFrame({c: data[:, k] if k < width else np.ones(len(data)) for k, c in enumerate(names)})

    def parse(_: str, raw: bytes) -> pd.DataFrame:
        width, n = _packed_head(raw)
        begin = struct.calcsize(PACKED)
        return rows(raw[begin : begin + 8 * width * n], width)

    df = _rows(spark, path, parse, packed_layout, lambda raw, _, info: rows(raw[0], info["width"]), ", ".join(f"{c} double" for c in names))
    return catalog(number(df.withColumn("mask", F.col("m") > 0)))
