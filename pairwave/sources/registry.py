"""Readers and writers of catalogs by format name."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SCHEMA, catalog, combined
from ..functions import healpix
from . import binary, files, text


def parquet(spark: SparkSession, path: str, **_) -> DataFrame:
    return catalog(spark.read.parquet(path))


#: Pixels of a full map that one task writes as one array.
WHOLE = 1 << 24

READERS: dict[str, Callable[..., DataFrame]] = {
    "columns-ascii": text.columns_ascii,
    "columns-ascii-all": text.columns_ascii_all,
    "columns-ascii-pos": text.columns_ascii_pos,
    "columns-ascii-2d-to-3d": text.columns_ascii_2d_to_3d,
    "multi-columns-ascii": text.multi_columns_ascii,
    "ra-dec-ascii": text.ra_dec_ascii,
    "binary": binary.packed,
    "binary-all": binary.packed,
    "takahashi": binary.takahashi,
    "takahasi": binary.takahashi,
    "fits": binary.fits,
    "fits-radec-field": binary.fits_radec_field,
    "fits-radecr-field": binary.fits_radecr_field,
    "fits-healpix": binary.fits_healpix,
    "numpy-healpix": binary.numpy_healpix,
    "gadget": binary.gadget,
    "parquet": parquet,
}


def read(spark: SparkSession, path: str, format: str = "columns-ascii", **options) -> DataFrame:
    if format not in READERS:
        raise ValueError(f"no such format: {format}")
    return READERS[format](spark, path, **options)


def read_many(spark: SparkSession, paths: str, formats: str = "columns-ascii", catalogs: str | None = None, **options) -> list[DataFrame]:
    """A catalog for each item of comma lists of paths and formats (one format may stand for all), numbered from 0 or as listed (from 1)."""
    names, kinds = [p.strip() for p in paths.split(",")], [f.strip() for f in formats.split(",")]
    kinds = kinds * len(names) if len(kinds) == 1 else kinds
    numbers = [int(c) - 1 for c in catalogs.split(",")] if catalogs else list(range(len(names)))
    if not len(names) == len(kinds) == len(numbers):
        raise ValueError("lists of files, formats and catalogs differ in length")
    return [read(spark, f, k, **options).withColumn("cat_id", F.lit(n)) for f, k, n in zip(names, kinds, numbers, strict=True)]


def read_all_in_one(spark: SparkSession, paths: str, formats: str = "columns-ascii", **options) -> DataFrame:
    """All files as one catalog; ids are distinct over all of them."""
    return combined(*read_many(spark, paths, formats, **options))


def write(df: DataFrame, path: str, format: str = "columns-ascii", box: float | None = None, nside: int | None = None, nest: bool = False) -> None:
    """A catalog in a format, written in parallel, a part for each partition.

    columns-ascii: x y z kappa, with a header; columns-ascii-all: all fields; columns-ascii-pos: positions only (box: shifted by half its
    side, from a centered box to one from 0); fits, binary, binary-all: one table in each part file; fits-healpix: ids as pixels of a map with
    kappa, each part file a map of a part of the sky (nside: by the number of points if not given); numpy-healpix: the same as .npy files, one plain array for
    a full map of at most WHOLE pixels; parquet.

    What is there stays until all is written beside it; then the new folder takes its place. So a catalog may be written over its own source, and
    a run that fails leaves the old one.
    """
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = lambda what: f"{path.rstrip('/')}.{what}-{uuid.uuid4().hex}"
    new, old = beside("new"), beside("old")
    there = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    try:
        _write(df, new, format, box, nside, nest)
        if system.exists(root) and not system.rename(root, there(old)):
            raise OSError(f"can't move {path}")
        if not system.rename(there(new), root):
            if system.exists(there(old)):
                system.rename(there(old), root)
            raise OSError(f"can't write {path}")
        system.delete(there(old), True)
    finally:
        system.delete(there(new), True)


def _write(df: DataFrame, path: str, format: str, box: float | None, nside: int | None, nest: bool) -> None:
    if format == "parquet":
        df.select(*[f.name for f in SCHEMA.fields]).write.mode("overwrite").parquet(path)
    elif format == "columns-ascii":
        sides = df.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
        text.write_columns(df, path, ["x", "y", "z", "kappa"], ["nbody NDIM Lx Ly Lz", f"{sides['n']} 3 {sides['x']} {sides['y']} {sides['z']}"])
    elif format == "columns-ascii-all":
        text.write_columns(df.withColumn("m", F.col("mask").cast("double")), path, ["x", "y", "z", "kappa", "weight", "mass", "m"])
    elif format == "columns-ascii-pos":
        text.write_columns(df.withColumns({c: F.col(c) + (box / 2 if box else 0.0) for c in "xyz"}), path, ["x", "y", "z"])
    elif format in ("fits", "binary", "binary-all"):
        names = ["x", "y", "z", "kappa", "weight", "mass", "mask"] if format == "binary-all" else ["x", "y", "z", "kappa"]
        _write_files(df.select(*[F.col(n).cast("double") for n in names]), path, "fits" if format == "fits" else "binary")
    elif format in ("fits-healpix", "numpy-healpix"):
        n = healpix.npix2nside(df.count()) if nside is None else nside
        if n < 1:
            raise ValueError("a map of a part of the sky needs nside")
        if format == "numpy-healpix":
            return _write_arrays(df.select("id", F.col("kappa").cast("double").alias("kappa")), path, n)
        cards = {"PIXTYPE": "HEALPIX", "ORDERING": "NESTED" if nest else "RING", "NSIDE": n, "COORDSYS": "G", "INDXSCHM": "EXPLICIT", "OBJECT": "PARTIAL"}
        _write_files(df.select(F.col("id").alias("pixel"), F.col("kappa").cast("double").alias("signal")), path, "fits", cards)
    else:
        raise ValueError(f"no such format: {format}")


def _write_arrays(df: DataFrame, path: str, nside: int) -> None:
    """A full map of bounded size as one array of its values, any other as records of pixel, value and nside, a file for each partition."""
    npix = healpix.nside2npix(nside)
    if npix <= WHOLE and df.agg(F.count_distinct("id")).first()[0] == npix:
        return _write_files(df.coalesce(1).sortWithinPartitions("id").select("kappa"), path, "numpy")
    _write_files(df.select(F.col("id").alias("pix"), F.col("kappa").alias("value"), F.lit(nside).alias("nside")), path, "numpy-healpix")


def headers(spark: SparkSession, paths: str, formats: str = "columns-ascii") -> DataFrame:
    """file, format, rows, columns (names), nside, box (sides), other: what the first bytes of files say; no rows are read. Null: not said there."""
    names, kinds = [p.strip() for p in paths.split(",")], [f.strip() for f in formats.split(",")]
    kinds = kinds * len(names) if len(kinds) == 1 else kinds
    if len(names) != len(kinds):
        raise ValueError("lists of files and formats differ in length")
    rows = []
    for path, kind in zip(names, kinds, strict=True):
        if kind not in READERS:
            raise ValueError(f"no such format: {kind}")
        if kind == "parquet":
            rows.append((path, kind, None, ",".join(spark.read.parquet(path).columns), None, None, None))
            continue
        for uri, _ in binary.sizes(spark, path):
            rows.append((uri, kind, *(text.head_of(spark, uri) if kind.endswith("ascii") or kind.startswith("columns-ascii") or kind == "ra-dec-ascii" else binary.head_of(uri, kind))))
    return spark.createDataFrame(rows, "file string, format string, rows long, columns string, nside int, box array<double>, other string")


def write_sky(df: DataFrame, path: str) -> None:
    """Longitude and latitude in radians and the field, as the reader of "ra-dec-ascii" takes them."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    sky = df.select(F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi)).alias("ra"), F.asin(F.col("z") / r).alias("dec"), "kappa")
    text.write_columns(sky, path, ["ra", "dec", "kappa"])


def _write_files(df: DataFrame, path: str, kind: str, cards: dict | None = None) -> None:
    """A file for each partition, more for one of very many rows, by the data source where pyarrow knows the file system; else handed to the driver one by one."""
    spark, names = df.sparkSession, df.columns
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(root).toString()
    if files.known(uri):
        files.register(spark)
        df.write.format(files.NAME).options(kind=kind, cards=json.dumps(cards or {})).mode("overwrite").save(uri)
        return
    system.delete(root, True)
    system.mkdirs(root)

    def run(batches):
        from pyspark import TaskContext

        for number, held in enumerate(files.bounded(batches)):
            content, ending = files.encoded(kind, {c: held.column(c).to_numpy() for c in names}, cards or {})
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():05d}-{number:05d}.{ending}"]), pa.array([content], pa.binary())], ["name", "content"])

    for row in df.mapInArrow(run, "name string, content binary").toLocalIterator():
        out = system.create(jvm.org.apache.hadoop.fs.Path(root, row["name"]))
        out.write(row["content"])
        out.close()
