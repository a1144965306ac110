"""Rasters as cell tables (tile_id, r, c, z), and their neighbourhoods.

Cells are dealt out by tile once; every window by (tile, row), (tile, column)
or tile then finds its rows in place, so focal operators add no shuffle.
Missing values are null, and null neighbours make a result null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SIDE, CELL = 64, 90.0
#: The eight neighbours in the order in which ties are broken: name, row and column offset, distance in cells.
D8 = (("n", -1, 0), ("ne", -1, 1), ("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1))

def _windows() -> dict[str, WindowSpec]:
    """Windows along rows, along columns and over tiles; they need a session, so they are made when first used."""
    return {"ROW": Window.partitionBy("tile_id", "r").orderBy("c"), "COL": Window.partitionBy("tile_id", "c").orderBy("r"), "TILE": Window.partitionBy("tile_id")}


def __getattr__(name: str) -> WindowSpec:
    if name in ("ROW", "COL", "TILE"):
        return _windows()[name]
    raise AttributeError(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles_of(rows: DataFrame, side: int = SIDE, least_valid: float = 1.0) -> DataFrame:
    """Cells of the complete tiles of rows (line, values): line // side is the tile, line % side its row.

    A tile is kept if at least this share of its cells has a value.
    """
    lines = rows.select(F.floor(F.col("line") / side).cast("long").alias("tile_id"), (F.col("line") % side).cast("int").alias("r"), "values").repartition("tile_id")
    valid = F.sum(F.size(F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v)))).over(_windows()["TILE"])
    kept = lines.withColumn("_valid", valid).where(F.col("_valid") >= least_valid * side * side)
    return kept.select("tile_id", "r", F.posexplode("values").alias("c", "z")).where(F.col("c") < side).select("tile_id", "r", "c", F.when(~F.isnan("z"), F.col("z")).alias("z"))


def emb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a raster: a vector is a line of 64 cells, 64 vectors a tile, heights in metres."""
    e = table(spark, sf_dir, "embeddings")
    return tiles_of(e.select(F.col("vec_id").alias("line"), F.transform("embedding", lambda x: x.cast("double") * 1000).alias("values")))


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile of mean prices by order and part."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("r"), (F.col("l_partkey") % SIDE).cast("int").alias("c")).agg((F.avg("l_extendedprice") / 10).alias("z")).select(F.lit(0).cast("long").alias("tile_id"), "r", "c", "z")


#: Breaks between the ten landform codes of the stand-in raster.
GEOM_BREAKS = (-260.0, -170.0, -100.0, -50.0, 0.0, 50.0, 100.0, 170.0, 260.0)


def geom_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landform codes 1..10 by fixed breaks of the height."""
    code = F.lit(1)
    for b in GEOM_BREAKS:
        code = code + F.when(F.col("z") >= b, 1).otherwise(0)
    return emb_cells(spark, sf_dir).withColumn("geom", code.cast("int"))


def with_neighbours(cells: DataFrame, column: str = "z") -> DataFrame:
    """cells with the eight neighbours' values as n, ne, e, se, s, sw, w, nw (r - 1 is north)."""
    x = cells.withColumn("w", F.lag(column).over(_windows()["ROW"])).withColumn("e", F.lead(column).over(_windows()["ROW"]))
    for name, of in (("nw", "w"), ("n", column), ("ne", "e")):
        x = x.withColumn(name, F.lag(of).over(_windows()["COL"]))
    for name, of in (("sw", "w"), ("s", column), ("se", "e")):
        x = x.withColumn(name, F.lead(of).over(_windows()["COL"]))
    return x


def shifted(cells: DataFrame, offsets: Sequence[tuple[int, int]], column: str = "z", prefix: str = "v") -> DataFrame:
    """cells with column at each (row, column) offset as prefix0, prefix1, ...; one row window, then column windows."""
    cols = sorted({dc for _, dc in offsets})
    x = cells
    for dc in cols:
        x = x.withColumn(f"_c{dc}", F.lead(column, dc).over(_windows()["ROW"]) if dc > 0 else F.lag(column, -dc).over(_windows()["ROW"]) if dc < 0 else F.col(column))
    for k, (dr, dc) in enumerate(offsets):
        of = f"_c{dc}"
        x = x.withColumn(f"{prefix}{k}", F.lead(of, dr).over(_windows()["COL"]) if dr > 0 else F.lag(of, -dr).over(_windows()["COL"]) if dr < 0 else F.col(of))
    return x.drop(*[f"_c{dc}" for dc in cols])


def box_sums(cells: DataFrame, radius: int, column: str = "z") -> DataFrame:
    """cells with _sum and _n of the square window of this radius, cut off at the edges: two running frames instead of a 2-D one."""
    x = cells.withColumn("_rs", F.sum(column).over(_windows()["ROW"].rowsBetween(-radius, radius))).withColumn("_rn", F.count(column).over(_windows()["ROW"].rowsBetween(-radius, radius)))
    return x.withColumn("_sum", F.sum("_rs").over(_windows()["COL"].rowsBetween(-radius, radius))).withColumn("_n", F.sum("_rn").over(_windows()["COL"].rowsBetween(-radius, radius))).drop("_rs", "_rn")


def horn(cell: float = CELL) -> tuple[Column, Column]:
    """dz/dx and dz/dy of cells with neighbours, null at the edges."""
    c = F.col
    gx = ((c("ne") + 2 * c("e") + c("se")) - (c("nw") + 2 * c("w") + c("sw"))) / (8 * cell)
    gy = ((c("nw") + 2 * c("n") + c("ne")) - (c("sw") + 2 * c("s") + c("se"))) / (8 * cell)
    return gx, gy


def rounded(x: Column, digits: int = 6) -> Column:
    """x without noise in the last digits, and without -0."""
    return F.round(x, digits) + F.lit(0.0)
