"""Elevation and landform windows: JSON files, raster archives, region catalogues, class targets."""

from __future__ import annotations

import io
import struct
import tarfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = "data array<double>, width int, height int, min_lon double, max_lon double, min_lat double, max_lat double, terrain_class string"
REGIONS = (
    "version string, description string, regions array<struct<id: string, terrain_class: string, tectonic_context: string, description: string, "
    "bbox: struct<min_lat: double, max_lat: double, min_lon: double, max_lon: double>, merit_tiles: array<string>, geomorpho90m_tiles: array<string>, "
    "koppen_zones: array<string>, min_samples_target: int, estimated_available_tiles: int, filter_rules: array<string>, notes: string>>"
)


def regions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each region of a catalogue file."""
    return spark.read.schema(REGIONS).json(path, multiLine=True).select(F.explode("regions").alias("r")).select("r.*")


def windows(spark: SparkSession, path: str) -> DataFrame:
    """A row for each window file: its fields, file name, and stem; null cells are missing."""
    w = spark.read.schema(WINDOW).json(path, multiLine=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return w.select("*", name.alias("file_name")).withColumn("stem", F.regexp_replace("file_name", r"(?:^geom_90M_)|(?:\.json$)", ""))


def write_windows(tiles: DataFrame, path: str, region: str = "region_id") -> None:
    """Windows as JSON lines, a folder for each region."""
    tiles.write.mode("overwrite").partitionBy(region).json(path)


def manifest(tiles: DataFrame, region: str = "region_id") -> DataFrame:
    return tiles.groupBy(region).agg(F.count("*").alias("windows"), F.count("terrain_class").alias("classified"))


def pairs(dem: DataFrame, geom: DataFrame) -> DataFrame:
    """Elevation windows with the landform window of the same stem."""
    return dem.join(geom.select("stem", F.col("data").alias("geom")), "stem")


def unpaired(dem: DataFrame, geom: DataFrame) -> DataFrame:
    return dem.join(geom.select("stem"), "stem", "left_anti")


def cells_of(w: DataFrame, key: str = "stem") -> DataFrame:
    """Cells (key, r, c, z) of windows; row 0 is the south, NaN is null."""
    x = w.select(key, "width", F.posexplode("data").alias("i", "z"))
    return x.select(key, F.floor(F.col("i") / F.col("width")).cast("int").alias("r"), (F.col("i") % F.col("width")).alias("c"), F.when(~F.isnan("z"), F.col("z")).alias("z"))


def corner(name: Column) -> Column:
    """struct(lat, lon) of the first token such as n30e120 in a name, null without one."""
    part = lambda k: F.regexp_extract(name, r"([ns])(\d+)([ew])(\d+)", k)
    lat = F.when(part(1) == "s", -F.try_to_number(part(2), F.lit("999"))).otherwise(F.try_to_number(part(2), F.lit("999")))
    lon = F.when(part(3) == "w", -F.try_to_number(part(4), F.lit("999"))).otherwise(F.try_to_number(part(4), F.lit("999")))
    return F.when(name.rlike(r"[ns]\d+[ew]\d+"), F.struct(lat.cast("int").alias("lat"), lon.cast("int").alias("lon")))


def climate_index(lat: Column, lon: Column, per_degree: int, rows: int, cols: int) -> Column:
    """struct(krow, kcol): where a point lies in a climate raster, clamped to it; join on it."""
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x).cast("int")))
    return F.struct(clamp((90 - lat) * per_degree, rows).alias("krow"), clamp((lon + 180) * per_degree, cols).alias("kcol"))


_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}


def read_tiff(data: bytes) -> np.ndarray:
    """The first band of an uncompressed or deflated TIFF in strips or tiles, of bytes or floats."""
    import zlib

    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in _TYPES:
            code, size = _TYPES[kind]
            where = at + 10 + 12 * k
            if n * size > 4:
                where = struct.unpack(order + "I", data[where : where + 4])[0]
            tags[tag] = struct.unpack(f"{order}{n}{code}", data[where : where + n * size])
    w, h = tags[256][0], tags[257][0]
    bits, form, packed = tags.get(258, (8,))[0], tags.get(339, (1,))[0], tags.get(259, (1,))[0]
    if (bits, form) not in ((8, 1), (32, 3)) or packed not in (1, 8, 32946):
        raise ValueError(f"{bits} bits of kind {form}, packed by {packed}")
    cell = np.dtype("u1") if bits == 8 else np.dtype(order + "f4")
    tw, th = (tags[322][0], tags[323][0]) if 322 in tags else (w, tags.get(278, (h,))[0])
    out = np.zeros((-(-h // th) * th, -(-w // tw) * tw), cell)
    across = out.shape[1] // tw
    for k, (start, size) in enumerate(zip(*((tags[324], tags[325]) if 322 in tags else (tags[273], tags[279])), strict=True)):
        raw = data[start : start + size]
        block = np.frombuffer(raw if packed == 1 else zlib.decompress(raw), cell)
        r, c = k // across * th, k % across * tw
        block = block[: len(block) // tw * tw].reshape(-1, tw)[:th]
        out[r : r + len(block), c : c + tw] = block
    return out[:h, :w]


def archive_lines(spark: SparkSession, path: str, suffix: str, nodata: float) -> DataFrame:
    """(file, line, values) of every raster in .tar and .tar.gz archives whose name ends with suffix; nodata is null, unreadable members are left out.

    An archive is read by one task, as a stream of members; lines go out one by one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path).select("content")

    def run(batches):
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if not member.isfile() or not member.name.endswith(suffix):
                            continue
                        try:
                            z = read_tiff(tar.extractfile(member).read()).astype("f8")
                        except (ValueError, KeyError, struct.error):
                            continue
                        z[z == nodata] = np.nan
                        for at in range(0, len(z), 256):
                            part = z[at : at + 256]
                            yield pd.DataFrame({"file": member.name, "line": range(at, at + len(part)), "values": [[None if np.isnan(v) else v for v in row] for row in part]})

    return files.mapInPandas(run, "file string, line int, values array<double>")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """(terrain_class, n_windows, metric, mean, std, p10, p90) of the scalar metrics in class target files."""
    names = ["hurst_exponent", "roughness_elev_corr", "multifractal_width", "grain_anisotropy", "hypsometric_integral", "slope_mode_deg", "drainage_density", "morans_i", "tpi_scale_ratio"]
    stat = "struct<mean: double, std: double, p10: double, p90: double>"
    t = spark.read.schema("terrain_class string, n_windows int, " + ", ".join(f"{n} {stat}" for n in names)).json(path, multiLine=True)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("s")) for n in names]))
    return t.select("terrain_class", "n_windows", rows.alias("x")).where("x.s IS NOT NULL").select("terrain_class", "n_windows", "x.metric", "x.s.*")
