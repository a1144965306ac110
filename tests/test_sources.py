import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.sources import windows as W


def tiff(a, kind):
    """A small uncompressed TIFF in one strip."""
    data = a.astype("<f4" if kind == 3 else "u1").tobytes()
    tags = [(256, 3, a.shape[1]), (257, 3, a.shape[0]), (258, 3, 32 if kind == 3 else 8), (259, 3, 1), (273, 4, 8), (278, 3, a.shape[0]), (279, 4, len(data)), (339, 3, kind)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


def test_tiff():
    a = np.arange(12).reshape(3, 4)
    assert (W.read_tiff(tiff(a, 1)) == a).all() and (W.read_tiff(tiff(a + 0.5, 3)) == a + 0.5).all()
    with pytest.raises(ValueError):
        W.read_tiff(b"nothing")


def test_archive(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    a[0, 0] = -9999
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for name, data in (("n30e120_dem.tif", tiff(a, 3)), ("bad_dem.tif", b"junk"), ("other.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    got = [tuple(r) for r in W.archive_lines(spark, str(tmp_path), "_dem.tif", -9999).orderBy("line").collect()]
    assert got == [("n30e120_dem.tif", 0, [None, 1.0, 2.0]), ("n30e120_dem.tif", 1, [3.0, 4.0, 5.0])]


def test_windows_and_pairs(spark, tmp_path):
    one = {"data": [1.0, None, 3.0, 4.0], "width": 2, "height": 2, "min_lon": 0, "max_lon": 1, "min_lat": 0, "max_lat": 1}
    for folder, names in (("dem", ["a_0001", "b_0001"]), ("geom", ["geom_90M_a_0001"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.json").write_text(json.dumps(one))
    dem, geom = W.windows(spark, str(tmp_path / "dem")), W.windows(spark, str(tmp_path / "geom"))
    assert [r.stem for r in W.pairs(dem, geom).collect()] == ["a_0001"] and [r.stem for r in W.unpaired(dem, geom).collect()] == ["b_0001"]
    assert {tuple(r)[1:] for r in W.cells_of(dem).collect()} == {(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)}


def test_names_and_climate_index(spark):
    d = spark.createDataFrame([("s05w070_x",), ("n30e120",), ("none",)], "n string")
    assert [None if r[0] is None else tuple(r[0]) for r in d.select(W.corner(F.col("n"))).collect()] == [(-5, -70), (30, 120), None]
    i = spark.range(1).select(W.climate_index(F.lit(-90.0), F.lit(180.0), 10, 1800, 3600)).first()[0]
    assert tuple(i) == (1799, 3599)
