"""Binary catalogs as a Spark data source."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.sources import binary, files


@pytest.fixture(scope="module")
def source(spark):
    files.register(spark)
    files.register(spark)
    return lambda path, **options: spark.read.format("pairwave").options(**options).load(str(path))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["fits", "binary"])
def test_written_rows_come_back(spark, source, tmp_path, kind):
    df = spark.range(1000).repartition(3).select(*[(F.col("id") * k).cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "kappa"), 1)])
    save = lambda d, mode: d.write.format("pairwave").option("kind", kind).mode(mode).save(f"{tmp_path}/c")
    save(df, "overwrite")
    back = source(tmp_path / "c", kind=kind)
    assert [n.lower() for n in back.columns] == df.columns and rows(back) == rows(df)
    assert len(os.listdir(tmp_path / "c")) == 3
    save(df, "append")
    assert source(tmp_path / "c", kind=kind).count() == 2000
    save(df.where("x < 10"), "overwrite")
    assert source(tmp_path / "c", kind=kind).count() == 10
    # A failed job leaves what was there, and nothing else.
    broken = df.withColumn("y", F.when(F.col("x") > 990, F.raise_error(F.lit("no"))).otherwise(F.col("y")).cast("double"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="no"):
            save(broken, mode)
        assert source(tmp_path / "c", kind=kind).count() == 10 and os.listdir(tmp_path) == ["c"]


def test_only_wanted_columns(spark, source, tmp_path):
    (tmp_path / "t.fits").write_bytes(binary.fits_bytes({"A": np.arange(5, dtype=np.int32), "B": np.arange(5) * 0.5, "C": np.arange(5, dtype=np.float32)}))
    got = source(tmp_path / "t.fits", kind="fits", columns="C,A")
    assert got.columns == ["C", "A"] and rows(got) == [(float(k), float(k)) for k in range(5)]
    assert source(tmp_path, kind="fits").schema.simpleString() == "struct<A:double,B:double,C:double>"
    for options in ({"columns": "C,D"}, {"kind": "csv"}):
        with pytest.raises(Exception, match="no such"):
            source(tmp_path, **options)
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no files"):
        source(tmp_path / "empty")


def test_large_files_in_ranges_small_ones_together(spark, source, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.fits").write_bytes(binary.fits_bytes({"A": np.arange(50) + 50.0 * k}))
    reader = lambda: files.Ranges("fits", str(tmp_path), None, None)
    assert len(reader().partitions()) == 1
    monkeypatch.setattr(binary, "RANGE", 160)
    parts = [p for r in reader().partitions() for p in r.parts]
    assert len(reader().partitions()) == 18 and sum(p[4] for p in parts) == 300
    monkeypatch.undo()
    assert rows(source(tmp_path)) == [(float(k),) for k in range(300)]


@pytest.mark.parametrize("kind", ["fits-healpix", "numpy-healpix"])
def test_ranges_of_a_map_by_pixels(spark, source, tmp_path, kind):
    values = np.arange(192) * 0.5
    raw = binary.map_bytes(values) if kind == "fits-healpix" else binary.array_bytes(values)
    (tmp_path / "map").write_bytes(raw)
    whole = source(tmp_path / "map", kind=kind)
    assert rows(whole) == [(k, k * 0.5, 4, False) for k in range(192)]
    assert rows(source(tmp_path / "map", kind=kind, pix="10,13", columns="pix,value")) == [(k, k * 0.5) for k in (10, 11, 12)]
    assert rows(source(tmp_path / "map", kind=kind, pix="190,500", columns="pix")) == [(190,), (191,)]
    (part,) = files.Ranges(kind, str(tmp_path / "map"), None, (10, 13)).partitions()
    assert [p[3:5] for p in part.parts] == [(10, 3)]
    # Pixels in any order are read whole and filtered.
    some = spark.range(100, 150).select(F.col("id").alias("pix"), (F.col("id") * 0.5).alias("value"), F.lit(4).alias("nside"))
    some.write.format("pairwave").option("kind", "numpy-healpix").mode("overwrite").save(f"{tmp_path}/some")
    assert rows(source(tmp_path / "some", kind="numpy-healpix", pix="140,1000")) == [(k, k * 0.5, 4, False) for k in range(140, 150)]


@pytest.mark.parametrize("tagged", [False, True])
def test_snapshots(spark, source, tmp_path, tagged):
    xyz = np.random.default_rng(1).random((40, 3)).astype("f4")
    (tmp_path / "s.0").write_bytes(binary.gadget_bytes(xyz, 7.0, velocities=xyz * 2, ids=np.arange(40, dtype="u4"), tagged=tagged))
    got = source(tmp_path / "s.0", kind="gadget", columns="particle,x,vz,box").orderBy("particle").collect()
    assert [tuple(r) for r in got] == [(k, float(xyz[k, 0]), float(xyz[k, 2] * 2), 7.0) for k in range(40)]
    (tmp_path / "s.1").write_bytes(binary.gadget_bytes(xyz, 7.0, tagged=tagged))
    assert source(tmp_path / "s.1", kind="gadget").where("particle IS NULL").count() == 40


def test_nothing_to_write(spark, source, tmp_path):
    spark.range(0).select(F.col("id").cast("double").alias("x")).write.format("pairwave").mode("overwrite").save(f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []
