"""Drainage, components, morphology and structure of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph, kernels
from ..operators import raster as R
from .sqltext import CELLS, GEOM, NB, q

rnd = R.rounded

_DROPS = [f"(z - {n}) / {2**0.5 if a and b else 1.0!r}" for n, a, b in R.D8]
_CODE = "d8 AS (SELECT tile_id, r, c, z, r * 64 + c AS id, CASE WHEN best <= 0 THEN 0 " + " ".join(f"WHEN {d} = best THEN {k}" for k, d in enumerate(_DROPS, 1)) + f" END AS code FROM (SELECT *, greatest({', '.join(_DROPS)}) AS best FROM nb))"
_DST = "fl AS (SELECT *, CASE code " + " ".join(f"WHEN {k} THEN id + {a * 64 + b}" for k, (_, a, b) in enumerate(R.D8, 1)) + " END AS dst FROM d8)"
_PATHS = "RECURSIVE_paths AS (SELECT tile_id, id, id AS cur, dst FROM fl UNION ALL SELECT p.tile_id, p.id, f.id, f.dst FROM RECURSIVE_paths p JOIN fl f ON f.tile_id = p.tile_id AND f.id = p.dst)"
_FLOW = (CELLS, NB, _CODE, _DST, _PATHS)


def rq(*parts: str, select: str) -> str:
    return q(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_paths", "paths")


def flow(spark, sf_dir: str) -> DataFrame:
    return graph.flow(R.emb_cells(spark, sf_dir))


@query("d8_direction", q(CELLS, NB, _CODE, select="SELECT tile_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, code FROM d8"))
def d8_direction(spark, sf_dir):
    return flow(spark, sf_dir).select("tile_id", "r", "c", "code")


@query("flow_accumulation", rq(*_FLOW, select="SELECT tile_id, cur AS id, count(*) AS acc FROM paths GROUP BY ALL"))
def flow_accumulation(spark, sf_dir):
    return graph.roots_and_counts(flow(spark, sf_dir)).select("tile_id", F.col("id").cast("long").alias("id"), "acc")


@query("drainage_density", rq(*_FLOW, "a AS (SELECT tile_id, cur, count(*) AS acc FROM paths GROUP BY ALL)", select="SELECT tile_id, round(count(*) FILTER (acc >= 50) * 0.09 / (count(*) * 0.09 * 0.09), 6) AS km_per_km2 FROM a GROUP BY 1"))
def drainage_density(spark, sf_dir):
    """Length of streams (accumulation of 50 or more on the raw heights) by area."""
    a = graph.roots_and_counts(flow(spark, sf_dir))
    return a.groupBy("tile_id").agg(rnd(F.count(F.when(F.col("acc") >= 50, 1)) * 0.09 / (F.count("*") * 0.09 * 0.09)).alias("km_per_km2"))


@query("basin_stats", rq(*_FLOW, "b AS (SELECT p.tile_id, p.id, p.cur AS basin FROM paths p WHERE p.dst IS NULL)", "s AS (SELECT b.tile_id, basin, count(*) AS cells, min(z) AS lo, max(z) AS hi, avg(z) AS mu, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM b JOIN cells ON cells.tile_id = b.tile_id AND r * 64 + c = b.id GROUP BY ALL)", select="SELECT tile_id, basin, cells, round(lo, 4) AS lowest, round(hi, 4) AS highest, round(CASE WHEN hi - lo <= 1 THEN 0.5 ELSE (mu - lo) / (hi - lo) END, 6) AS hi, round(least(h, w) / CAST(greatest(h, w) AS DOUBLE), 6) AS elongation FROM s"))
def basin_stats(spark, sf_dir):
    """Cells, heights, hypsometric integral and elongation of each basin."""
    f = flow(spark, sf_dir)
    b = graph.roots_and_counts(f).select("tile_id", "id", F.col("root").cast("long").alias("basin")).join(f.select("tile_id", "id", "r", "c", "z"), ["tile_id", "id"])
    s = b.groupBy("tile_id", "basin").agg(F.count("*").alias("cells"), F.min("z").alias("lo"), F.max("z").alias("top"), F.avg("z").alias("mu"), (F.max("r") - F.min("r") + 1).alias("h"), (F.max("c") - F.min("c") + 1).alias("w"))
    return s.select("tile_id", "basin", "cells", rnd(F.col("lo"), 4).alias("lowest"), rnd(F.col("top"), 4).alias("highest"), rnd(F.expr("CASE WHEN top - lo <= 1 THEN 0.5D ELSE (mu - lo) / nullif(top - lo, 0) END")).alias("hi"), rnd(F.least("h", "w") / F.greatest("h", "w")).alias("elongation"))


@query("morans_i_sequence", rq(*_FLOW, "b AS (SELECT p.tile_id, p.cur AS basin, avg(z) AS v FROM paths p JOIN cells ON cells.tile_id = p.tile_id AND r * 64 + c = p.id WHERE p.dst IS NULL GROUP BY ALL)", "d AS (SELECT tile_id, v - avg(v) OVER (PARTITION BY tile_id) AS x, basin FROM b)", "n AS (SELECT tile_id, x, lag(x) OVER w AS a, lead(x) OVER w AS b FROM d WINDOW w AS (PARTITION BY tile_id ORDER BY basin))", select="SELECT tile_id, round(count(*) / CAST(count(a) + count(b) AS DOUBLE) * sum(x * (coalesce(a, 0) + coalesce(b, 0))) / sum(x * x), 6) AS i FROM n GROUP BY 1"))
def morans_i_sequence(spark, sf_dir):
    """Moran's I of basins' mean heights, with the basins before and after as neighbours."""
    f = flow(spark, sf_dir)
    b = graph.roots_and_counts(f).join(f.select("tile_id", "id", "z"), ["tile_id", "id"]).groupBy("tile_id", "root").agg(F.avg("z").alias("v"))
    d = b.withColumn("x", F.col("v") - F.avg("v").over(R.TILE))
    w = R.TILE.orderBy("root")
    n = d.withColumn("a", F.lag("x").over(w)).withColumn("b", F.lead("x").over(w))
    return n.groupBy("tile_id").agg(rnd(F.expr("count(*) / (count(a) + count(b)) * sum(x * (coalesce(a, 0) + coalesce(b, 0))) / sum(x * x)")).alias("i"))


def _comp_sql(diagonal: bool) -> tuple[str, ...]:
    near = "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1" if diagonal else "abs(a.r - b.r) + abs(a.c - b.c) = 1"
    return (CELLS, GEOM, "m AS (SELECT tile_id, r, c, r * 64 + c AS id FROM geo WHERE geom >= 9)", f"ed AS (SELECT a.tile_id, a.id AS u, b.id AS v FROM m a JOIN m b ON a.tile_id = b.tile_id AND {near})", "reach AS (SELECT tile_id, id, id AS cur FROM m UNION SELECT p.tile_id, p.id, ed.v FROM reach p JOIN ed ON ed.tile_id = p.tile_id AND ed.u = p.cur)", "lab AS (SELECT tile_id, id, min(cur) AS label FROM reach GROUP BY ALL)")


def high_mask(spark, sf_dir: str) -> DataFrame:
    return R.geom_cells(spark, sf_dir).where("geom >= 9")


def _register(diagonal: bool) -> None:
    @query(f"connected_components_{8 if diagonal else 4}", rq(*_comp_sql(diagonal), select="SELECT tile_id, label, count(*) AS cells FROM lab GROUP BY ALL"))
    def run(spark, sf_dir):
        return graph.components(high_mask(spark, sf_dir), diagonal).groupBy("tile_id", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("cells"))


_register(False)
_register(True)


@query("patch_stats", rq(*_comp_sql(False), "p AS (SELECT tile_id, label, count(*) AS n FROM lab GROUP BY ALL)", select="SELECT tile_id, count(*) AS patches, round(avg(n), 6) AS mean_cells, CAST(median(n) AS DOUBLE) AS median_cells, max(n) AS largest, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS dominance FROM p GROUP BY 1"))
def patch_stats(spark, sf_dir):
    """Patches of one landform: number, areas and how far the largest dominates."""
    p = graph.components(high_mask(spark, sf_dir), False).groupBy("tile_id", "label").agg(F.count("*").alias("n"))
    return p.groupBy("tile_id").agg(F.count("*").alias("patches"), rnd(F.avg("n")).alias("mean_cells"), F.percentile("n", F.lit(0.5)).alias("median_cells"), F.max("n").alias("largest"), rnd(F.max("n") / F.sum("n")).alias("dominance"))


_DISC = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
_OFFS = "off AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in _DISC) + ") AS v(dr, dc))"


def dilated(mask: DataFrame, column: str, out: str, erode: bool = False) -> DataFrame:
    """Greatest (or least) value within a disc of radius 2, cells off the grid left out."""
    x = R.shifted(mask, _DISC, column, "_d")
    pick = F.least if erode else F.greatest
    return x.withColumn(out, pick(*[f"_d{k}" for k in range(len(_DISC))])).drop(*[f"_d{k}" for k in range(len(_DISC))])


def _morph_sql(select: str) -> str:
    return q(CELLS, GEOM, _OFFS, "k AS (SELECT tile_id, r, c, CAST(geom >= 9 AS INT) AS m FROM geo)", "di AS (SELECT a.tile_id, a.r, a.c, max(b.m) AS x, min(b.m) AS y FROM k a, off JOIN k b ON b.tile_id = a.tile_id AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL)", "cl AS (SELECT a.tile_id, a.r, a.c, min(b.x) AS z FROM di a, off JOIN di b ON b.tile_id = a.tile_id AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY ALL)", select=select)


@query("morphology", _morph_sql("SELECT tile_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, x AS dilated, y AS eroded, z AS closed FROM di JOIN cl USING (tile_id, r, c)"))
def morphology(spark, sf_dir):
    """Dilation, erosion and closing of a mask by a disc."""
    m = R.geom_cells(spark, sf_dir).select("tile_id", "r", "c", (F.col("geom") >= 9).cast("int").alias("m"))
    x = dilated(dilated(dilated(m, "m", "dilated"), "m", "eroded", True), "dilated", "closed", True)
    return x.select("tile_id", "r", "c", "dilated", "eroded", "closed")


@query("pca_grain", q(CELLS, GEOM, "m AS (SELECT tile_id, var_pop(c) AS xx, var_pop(r) AS yy, covar_pop(c, r) AS xy, count(*) AS n FROM geo WHERE geom >= 9 GROUP BY 1)", select="SELECT tile_id, n, round(degrees(CASE WHEN 0.5 * atan2(2 * xy, xx - yy) < 0 THEN 0.5 * atan2(2 * xy, xx - yy) + pi() ELSE 0.5 * atan2(2 * xy, xx - yy) END), 4) AS angle_deg FROM m WHERE n >= 50"))
def pca_grain(spark, sf_dir):
    """Direction of the first principal axis of the ridge cells, in [0, 180)."""
    m = high_mask(spark, sf_dir).groupBy("tile_id").agg(F.var_pop("c").alias("xx"), F.var_pop("r").alias("yy"), F.covar_pop("c", "r").alias("xy"), F.count("*").alias("n")).where("n >= 50")
    a = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    return m.select("tile_id", "n", rnd(F.degrees(F.when(a < 0, a + F.lit(3.141592653589793)).otherwise(a)), 4).alias("angle_deg"))


_RUNS = "runs AS (SELECT tile_id, r, g, min(c) AS a, max(c) AS b FROM (SELECT *, c - row_number() OVER (PARTITION BY tile_id, r ORDER BY c) AS g FROM geo WHERE geom <= 2) GROUP BY tile_id, r, g)"


def runs(spark, sf_dir: str) -> DataFrame:
    """Runs of low cells along rows: (tile_id, r, a, b)."""
    low = R.geom_cells(spark, sf_dir).where("geom <= 2").withColumn("g", F.col("c") - F.row_number().over(R.ROW))
    return low.groupBy("tile_id", "r", "g").agg(F.min("c").alias("a"), F.max("c").alias("b"))


@query("run_spacing", q(CELLS, GEOM, _RUNS, "s AS (SELECT tile_id, b - a + 1 AS width, lead((a + b) / 2.0) OVER w - (a + b) / 2.0 AS spacing, lead(a) OVER w - b - 1 AS gap FROM runs WINDOW w AS (PARTITION BY tile_id, r ORDER BY a))", select="SELECT tile_id, round(avg(width), 6) AS mean_width, round(avg(spacing), 6) AS mean_spacing, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap, count(*) AS runs FROM s GROUP BY 1"))
def run_spacing(spark, sf_dir):
    """Widths of runs along transects, distances of their centres, and the gaps between them."""
    w = Window.partitionBy("tile_id", "r").orderBy("a")
    mid = (F.col("a") + F.col("b")) / 2
    s = runs(spark, sf_dir).select("tile_id", (F.col("b") - F.col("a") + 1).alias("width"), (F.lead(mid).over(w) - mid).alias("spacing"), (F.lead("a").over(w) - F.col("b") - 1).alias("gap"))
    return s.groupBy("tile_id").agg(rnd(F.avg("width")).alias("mean_width"), rnd(F.avg("spacing")).alias("mean_spacing"), rnd(F.avg("gap")).alias("mean_gap"), rnd(F.stddev_pop("gap")).alias("std_gap"), F.count("*").alias("runs"))


@query("neighbour_semijoin", q(CELLS, GEOM, select="SELECT a.tile_id, count(*) AS n FROM geo a WHERE a.geom = 8 AND EXISTS (SELECT 1 FROM geo b WHERE b.tile_id = a.tile_id AND b.geom >= 9 AND greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1) GROUP BY 1"))
def neighbour_semijoin(spark, sf_dir):
    """Cells of one landform that touch another: a focal maximum instead of a join."""
    g = R.with_neighbours(R.geom_cells(spark, sf_dir).withColumn("hit", (F.col("geom") >= 9).cast("int")).drop("z"), "hit")
    return g.where((F.col("geom") == 8) & (F.greatest(*[n for n, _, _ in R.D8]) == 1)).groupBy("tile_id").agg(F.count("*").alias("n"))


def _kernel(name: str, f, note: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        return kernels.per_tile(R.emb_cells(spark, sf_dir), f, name)

    run.__doc__ = note


_kernel("pit_fill", kernels.pit_fill, "Heights without pits.")
_kernel("strahler_order", kernels.strahler, "Stream orders.")
_kernel("mass_wasting", kernels.mass_wasting, "Heights after slopes have failed.")
_kernel("stream_power", kernels.stream_power, "Heights after erosion by streams.")
_kernel("thinning", lambda z: kernels.thinned(z > 100), "Skeleton of the high cells.")
