"""Statistics by class, classification, scores, joins, the sphere and climate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import sphere
from ..operators import raster as R
from .sqltext import CELLS, GEOM, q

rnd = R.rounded


def class_stats(values: DataFrame, keys: list[str], value: str, index: str = "trunc") -> DataFrame:
    """Count, mean, population deviation, p10 and p90 of value by keys.

    Percentiles are the sorted value at trunc or round of p (n - 1); nulls and
    NaN are left out.  Ranks are dealt out by key; a key's rows are streamed
    through a sort, never collected.
    """
    clean = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    w = Window.partitionBy(*keys)
    place = F.floor if index == "trunc" else F.round
    ranked = clean.withColumn("_k", F.row_number().over(w.orderBy(value)) - 1)
    n = clean.groupBy(*keys).agg(F.count("*").alias("n"), rnd(F.avg(value)).alias("mean"), rnd(F.stddev_pop(value)).alias("std"))
    at = lambda p: F.max(F.when(F.col("_k") == place(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    picked = ranked.join(n.select(*keys, "n"), keys).groupBy(*keys).agg(rnd(at(0.1)).alias("p10"), rnd(at(0.9)).alias("p90"))
    return n.join(picked, keys)


def _stats_sql(source: str, key: str, value: str, place: str) -> str:
    return f"WITH v AS ({source}), k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS k, count(*) OVER (PARTITION BY {key}) AS m FROM v) SELECT {key}, count(*) AS n, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, round(max({value}) FILTER (k = {place}(0.1 * (m - 1))), 6) AS p10, round(max({value}) FILTER (k = {place}(0.9 * (m - 1))), 6) AS p90 FROM k GROUP BY {key}"


@query("class_stats_trunc", _stats_sql("SELECT l_returnflag AS cls, l_extendedprice AS x FROM lineitem", "cls", "x", "floor"))
def class_stats_trunc(spark, sf_dir):
    return class_stats(R.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_extendedprice").alias("x")), ["cls"], "x")


@query("class_stats_round", _stats_sql("SELECT label AS cls, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings", "cls", "x", "round"))
def class_stats_round(spark, sf_dir):
    return class_stats(R.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cls"), F.col("embedding")[0].cast("double").alias("x")), ["cls"], "x", "round")


@query("hist_stats", q("t AS (SELECT label, i AS bin, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS t(i))", "k AS (SELECT *, row_number() OVER (PARTITION BY label, bin ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY label, bin) AS m FROM t)", select="SELECT label, bin, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(x) FILTER (k = floor(0.1 * (m - 1))), 6) AS p10, round(max(x) FILTER (k = floor(0.9 * (m - 1))), 6) AS p90 FROM k GROUP BY ALL"))
def hist_stats(spark, sf_dir):
    """Statistics of each position of the vectors by class."""
    t = R.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return class_stats(t.select("label", (F.col("p") + 1).cast("long").alias("bin"), F.col("x").cast("double").alias("x")), ["label", "bin"], "x")


@query("class_rollup", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def class_rollup(spark, sf_dir):
    x = R.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return x.rollup("flag", "status").agg(F.count("*").alias("n"), rnd(F.avg("l_quantity")).alias("mean"))


#: Climate zones that count as humid and arid.
HUMID, ARID = (1, 2, 3, 14, 15), (4, 5, 6, 7)
#: Thresholds of the classes, in the order of the rules.
RULES = (
    ("Alpine", f"relief > 800 AND f2 + f3 + f4 > 0.04 AND zone NOT IN {ARID}"),
    ("Coastal", "coastal AND mean_z < 200 AND f1 + f8 > 0.20"),
    ("FluvialHumid", f"zone IN {HUMID} AND f1 + f6 + f7 + f9 > 0.60 AND relief > 20"),
    ("Cratonic", f"f1 > 0.40 AND zone NOT IN {HUMID} AND f7 + f9 < 0.15"),
    ("FluvialArid", f"zone IN {ARID} AND f6 + f7 + f9 > 0.30"),
)
_CLASSIFY = "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in RULES) + " ELSE 'unclassified' END"
_FRACTIONS = ", ".join(f"avg(CASE WHEN geom = {k} THEN 1.0 ELSE 0.0 END) AS f{k}" for k in range(1, 11))


@query("classify_windows", q(CELLS, GEOM, f"s AS (SELECT tile_id, max(z) - min(z) AS relief, avg(z) AS mean_z, CAST(tile_id % 16 AS INT) AS zone, tile_id % 3 = 0 AS coastal, {_FRACTIONS} FROM geo GROUP BY 1)", select=f"SELECT tile_id, round(relief, 6) AS relief, round(mean_z, 6) AS mean_z, round(f1, 6) AS flat_share, {_CLASSIFY} AS terrain_class FROM s"))
def classify_windows(spark, sf_dir):
    """Landform shares, relief and climate zone of each tile to its terrain class, first rule first."""
    s = R.geom_cells(spark, sf_dir).groupBy("tile_id").agg((F.max("z") - F.min("z")).alias("relief"), F.avg("z").alias("mean_z"), *[F.avg(F.when(F.col("geom") == k, 1.0).otherwise(0.0)).alias(f"f{k}") for k in range(1, 11)])
    s = s.withColumn("zone", (F.col("tile_id") % 16).cast("int")).withColumn("coastal", F.col("tile_id") % 3 == 0)
    return s.select("tile_id", rnd(F.col("relief")).alias("relief"), rnd(F.col("mean_z")).alias("mean_z"), rnd(F.col("f1")).alias("flat_share"), F.expr(_CLASSIFY).alias("terrain_class"))


#: Bands (p10, p90) of each metric by class, in the order of CLASSES.
CLASSES = ("Alpine", "Coastal", "Cratonic", "FluvialArid", "FluvialHumid")
BANDS = {
    "hurst": ((0.683, 0.819), (0.416, 0.572), (0.482, 0.662), (0.551, 0.782), (0.357, 0.629)),
    "roughness": ((0.023, 0.712), (-0.156, 0.240), (0.053, 0.632), (-0.087, 0.629), (-0.184, 0.560)),
    "multifractal": ((0.204, 1.123), (0.149, 0.740), (0.123, 0.648), (0.258, 0.907), (0.170, 0.888)),
    "slope": ((0.5, 20.5), (0.5, 1.5), (0.5, 0.5), (0.5, 2.5), (0.5, 2.5)),
    "aspect": ((0.4, 0.85), (0.4, 0.85), (0.4, 0.85), (0.4, 0.85), (0.4, 0.85)),
    "tpi": ((0.074, 0.130), (0.224, 0.347), (0.132, 0.334), (0.088, 0.198), (0.167, 0.393)),
    "hypsometry": ((0.196, 0.513), (0.334, 0.606), (0.137, 0.435), (0.217, 0.521), (0.218, 0.509)),
    "drainage": ((1.407, 3.187), (0.024, 1.886), (0.084, 0.972), (1.351, 2.793), (0.060, 2.662)),
    "morans": ((0.021, 0.355), (0.054, 0.404), (0.027, 0.350), (0.062, 0.404), (0.068, 0.378)),
}


def band_score(x: Column, lo: Column, hi: Column) -> Column:
    """1 within the band, falling to 0 over one width of the band on both sides."""
    away = F.greatest(lo - x, x - hi, F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - away / F.greatest(hi - lo, F.lit(1e-6)))


_BANDS = "bands AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{m}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for m, rows in BANDS.items() for c, (lo, hi) in zip(CLASSES, rows, strict=True)) + ") AS v(cls, metric, lo, hi))"


def bands(spark) -> DataFrame:
    """(cls, metric, lo, hi): forty-five fixed rows."""
    return spark.createDataFrame([(c, m, lo, hi) for m, rows in BANDS.items() for c, (lo, hi) in zip(CLASSES, rows, strict=True)], "cls string, metric string, lo double, hi double")


_TWO = "x AS (SELECT tile_id, 'hypsometry' AS metric, (avg(z) - min(z)) / (max(z) - min(z)) AS x FROM cells GROUP BY 1 UNION ALL SELECT tile_id, 'drainage', count(*) FILTER (z < 0) * 0.09 / 33.1776 FROM cells GROUP BY 1)"


@query("band_scores", q(CELLS, _BANDS, _TWO, select="SELECT tile_id, metric, cls, round(greatest(0.0, 1 - greatest(lo - x, x - hi, 0) / greatest(hi - lo, 1e-6)), 6) AS score, CASE WHEN x BETWEEN lo AND hi THEN 'PASS' WHEN x BETWEEN lo - 0.1 * (hi - lo) AND hi + 0.1 * (hi - lo) THEN 'WARN' ELSE 'FAIL' END AS status FROM x JOIN bands USING (metric)"))
def band_scores(spark, sf_dir):
    """Score and status of metrics of each tile against each class's band (the bands are fixed rows, so broadcast)."""
    cells = R.emb_cells(spark, sf_dir).groupBy("tile_id")
    h = cells.agg(((F.avg("z") - F.min("z")) / F.nullif(F.max("z") - F.min("z"), F.lit(0.0))).alias("hypsometry"), (F.count(F.when(F.col("z") < 0, 1)) * 0.09 / 33.1776).alias("drainage"))
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    slack = 0.1 * (hi - lo)
    status = F.when(x.between(lo, hi), "PASS").when(x.between(lo - slack, hi + slack), "WARN").otherwise("FAIL")
    return h.unpivot("tile_id", ["hypsometry", "drainage"], "metric", "x").where(x.isNotNull()).join(F.broadcast(bands(spark)), "metric").select("tile_id", "metric", "cls", rnd(band_score(x, lo, hi)).alias("score"), status.alias("status"))


@query("sanity_checks", q(CELLS, "h AS (SELECT tile_id % 5 AS cls, tile_id, (avg(z) - min(z)) / (max(z) - min(z)) AS hi FROM cells GROUP BY ALL)", select="SELECT CAST(cls AS INT) AS cls, count(*) AS n, count(*) >= 50 AS enough, bool_and(hi > 0 AND hi < 1) AS hi_in_range FROM h GROUP BY 1"))
def sanity_checks(spark, sf_dir):
    h = R.emb_cells(spark, sf_dir).groupBy("tile_id").agg(((F.avg("z") - F.min("z")) / F.nullif(F.max("z") - F.min("z"), F.lit(0.0))).alias("hi"))
    return h.groupBy((F.col("tile_id") % 5).cast("int").alias("cls")).agg(F.count("*").alias("n"), (F.count("*") >= 50).alias("enough"), F.bool_and((F.col("hi") > 0) & (F.col("hi") < 1)).alias("hi_in_range"))


@query("pair_join", "SELECT o_orderkey, count(*) AS lines, round(sum(l_extendedprice), 4) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def pair_join(spark, sf_dir):
    """Pairs by key, aggregated before the join, which then shuffles a row for each key."""
    lines = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 4).alias("price"))
    return R.table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey")


@query("unmatched_antijoin", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unmatched_antijoin(spark, sf_dir):
    """Customers without a large order."""
    o = R.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("left_outer_default", "SELECT c_custkey, coalesce(max(o_orderpriority), 'unclassified') AS label FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_outer_default(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("label"))
    return R.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("label", F.lit("unclassified")).alias("label"))


_BOX_A = "SELECT n_nationkey AS id, (n_nationkey * 37) % 340 - 170.0 AS x0, (n_nationkey * 37) % 340 - 155.0 AS x1, (n_nationkey * 23) % 140 - 70.0 AS y0, (n_nationkey * 23) % 140 - 60.0 AS y1 FROM nation"
_BOX_B = "SELECT s_suppkey AS tile, (s_suppkey * 7) % 355 - 180.0 AS u0, (s_suppkey * 7) % 355 - 175.0 AS u1, (s_suppkey * 11) % 175 - 90.0 AS v0, (s_suppkey * 11) % 175 - 85.0 AS v1 FROM supplier"


def overlapping(a: DataFrame, b: DataFrame, grid: float = 20.0) -> DataFrame:
    """Pairs of boxes (x0, x1, y0, y1) and (u0, u1, v0, v1) that overlap, strictly.

    Both sides are dealt out to the grid cells that they touch, so that the join
    is by equal keys; a pair counts in the cell where its overlap begins.
    """
    def cells(t: DataFrame, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
        along = lambda lo, hi: F.sequence(F.floor(F.col(lo) / grid), F.floor(F.col(hi) / grid))
        return t.withColumn("gx", F.explode(along(x0, x1))).withColumn("gy", F.explode(along(y0, y1)))

    j = cells(a, "x0", "x1", "y0", "y1").join(cells(b, "u0", "u1", "v0", "v1"), ["gx", "gy"])
    j = j.where("x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1")
    return j.where((F.col("gx") == F.floor(F.greatest("x0", "u0") / grid)) & (F.col("gy") == F.floor(F.greatest("y0", "v0") / grid))).drop("gx", "gy")


@query("bbox_overlap_join", q(f"a AS ({_BOX_A})", f"b AS ({_BOX_B})", select="SELECT id, CAST(count(*) AS BIGINT) AS tiles, min(tile) AS first_tile FROM a JOIN b ON x0 < u1 AND u0 < x1 AND y0 < v1 AND v0 < y1 GROUP BY 1"))
def bbox_overlap_join(spark, sf_dir):
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    a = R.table(spark, sf_dir, "nation").select(n.alias("id"), ((n * 37) % 340 - 170.0).alias("x0"), ((n * 37) % 340 - 155.0).alias("x1"), ((n * 23) % 140 - 70.0).alias("y0"), ((n * 23) % 140 - 60.0).alias("y1"))
    b = R.table(spark, sf_dir, "supplier").select(s.alias("tile"), ((s * 7) % 355 - 180.0).alias("u0"), ((s * 7) % 355 - 175.0).alias("u1"), ((s * 11) % 175 - 90.0).alias("v0"), ((s * 11) % 175 - 85.0).alias("v1"))
    return overlapping(a, b).groupBy("id").agg(F.count("*").alias("tiles"), F.min("tile").alias("first_tile"))


#: Seeds of the nearest-seed query: id, latitude, longitude, weight.
SEEDS = tuple((k, math.degrees(math.asin(1 - 2 * (k + 0.5) / 12)), (k * 137.50776405) % 360 - 180, 1.0 + (k % 4) * 0.5) for k in range(12))
_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {w!r}::DOUBLE)" for k, a, b, w in SEEDS) + ") AS v(seed, slat, slon, w))"
_GRID = "grid AS (SELECT r, c, 90 - (r + 0.5) / 36 * 180 AS lat, (c + 0.5) / 72 * 360 - 180 AS lon FROM range(36) AS a(r), range(72) AS b(c))"
_DIST = "acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(slat)) + cos(radians(lat)) * cos(radians(slat)) * cos(radians(lon - slon)))))"


def grid(spark, rows: int = 36, cols: int = 72) -> DataFrame:
    """Cell centres of a planet grid, row 0 in the north."""
    x = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    return x.withColumn("lat", 90 - (F.col("r") + 0.5) / rows * 180).withColumn("lon", (F.col("c") + 0.5) / cols * 360 - 180)


@query("nearest_seed_weighted", q(_SEEDS, _GRID, f"d AS (SELECT r, c, seed, {_DIST} AS d, w FROM grid, seeds)", select="SELECT r, c, CAST(arg_min(seed, d - 0.22 * ln(w)) AS INT) AS seed, round(min(d - 0.22 * ln(w)), 6) AS score, round(min(d), 6) AS nearest FROM d GROUP BY ALL"))
def nearest_seed_weighted(spark, sf_dir):
    """The seed of least weighted great-circle distance; the twelve seeds are literals of each row, so nothing is joined."""
    g = grid(spark)
    score = lambda s: sphere.angle(F.col("lat"), F.col("lon"), F.lit(s[1]), F.lit(s[2])) - 0.22 * math.log(s[3])
    best = F.array_min(F.array(*[F.struct(score(s).alias("score"), F.lit(s[0]).alias("seed")) for s in SEEDS]))
    near = F.least(*[sphere.angle(F.col("lat"), F.col("lon"), F.lit(s[1]), F.lit(s[2])) for s in SEEDS])
    return g.select("r", "c", best.alias("b"), rnd(near).alias("nearest")).select("r", "c", F.col("b.seed").alias("seed"), rnd(F.col("b.score")).alias("score"), "nearest")


@query("tile_addressing", "SELECT n_nationkey AS id, z, CAST(floor((lon + 180) / 360 * pow(2, z)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y FROM (SELECT n_nationkey, (n_nationkey * 37) % 340 - 170.0 AS lon, (n_nationkey * 23) % 140 - 70.0 AS lat FROM nation), (VALUES (3), (8)) AS v(z)")
def tile_addressing(spark, sf_dir):
    n = F.col("n_nationkey")
    p = R.table(spark, sf_dir, "nation").select(n.alias("id"), ((n * 37) % 340 - 170.0).alias("lon"), ((n * 23) % 140 - 70.0).alias("lat"), F.explode(F.array(F.lit(3), F.lit(8))).alias("z"))
    return p.select("id", "z", sphere.tile_x(F.col("lon"), F.col("z")).alias("x"), sphere.tile_y(F.col("lat"), F.col("z")).alias("y"))


_MAP = "greatest(1560 * exp(-abs(lat) * abs(lat) / 968) - 560 * exp(-power(abs(lat) - 28, 2) / 128) * greatest(2 - wa / 0.55, 1.0) + 420 * exp(-power(abs(lat) - 50, 2) / 450) + 160, 60.0) * wa / 0.55"
_CLIMATE = q(_GRID, f"m AS (SELECT *, {_MAP} AS map_mm FROM grid, (VALUES (0.3::DOUBLE), (0.55::DOUBLE)) AS v(wa) WHERE c = 0)", select="SELECT r, wa, round(map_mm, 6) AS map_mm, round(power(abs(lat) / 90, 0.7) * (1 - 0.8 * least(map_mm / 2500, 1)), 6) AS seasonality, CASE WHEN abs(lat) >= 90 - 25 * 0.3 THEN 'Active' WHEN abs(lat) >= 90 - 50 * 0.3 THEN 'Former' ELSE 'None' END AS glacial FROM m")


@query("climate_bands", _CLIMATE)
def climate_bands(spark, sf_dir):
    """Precipitation, seasonality and glaciation by latitude, for two abundances of water."""
    g = grid(spark).where("c = 0").withColumn("wa", F.explode(F.array(F.lit(0.3), F.lit(0.55))))
    m = g.withColumn("map_mm", sphere.precipitation(F.col("lat"), F.col("wa")))
    return m.select("r", "wa", rnd(F.col("map_mm")).alias("map_mm"), rnd(sphere.seasonality(F.col("lat"), F.col("map_mm"))).alias("seasonality"), sphere.glacial(F.col("lat"), 0.3).alias("glacial"))


@query("sea_level", q(CELLS, "k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY z, r, c) - 1 AS k, count(*) OVER (PARTITION BY tile_id) AS n FROM cells)", "l AS (SELECT tile_id, max(z) FILTER (k = floor(0.65 * n)) AS level FROM k GROUP BY 1)", select="SELECT tile_id, round(any_value(level), 6) AS level, round(avg(CASE WHEN z < level THEN 1.0 ELSE 0.0 END), 6) AS ocean FROM cells JOIN l USING (tile_id) GROUP BY 1"))
def sea_level(spark, sf_dir):
    """The height below which 65 in 100 cells lie, and the share of ocean."""
    k = R.emb_cells(spark, sf_dir).withColumn("k", F.row_number().over(R.TILE.orderBy("z", "r", "c")) - 1).withColumn("n", F.count("*").over(R.TILE))
    level = F.max(F.when(F.col("k") == F.floor(F.lit(0.65) * F.col("n")), F.col("z"))).over(R.TILE)
    return k.withColumn("level", level).groupBy("tile_id").agg(rnd(F.first("level")).alias("level"), rnd(F.avg(F.when(F.col("z") < F.col("level"), 1.0).otherwise(0.0))).alias("ocean"))


@query("regime_entropy", q(CELLS, GEOM, "n AS (SELECT tile_id, geom, count(*) AS n FROM geo WHERE z >= 0 GROUP BY ALL)", "p AS (SELECT tile_id, n / CAST(sum(n) OVER (PARTITION BY tile_id) AS DOUBLE) AS p FROM n)", select="SELECT tile_id, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY 1"))
def regime_entropy(spark, sf_dir):
    n = R.geom_cells(spark, sf_dir).where("z >= 0").groupBy("tile_id", "geom").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(R.TILE))
    return p.groupBy("tile_id").agg(rnd(-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


@query("transition_smoothness", q(CELLS, GEOM, "d AS (SELECT tile_id, abs(lead(geom) OVER (PARTITION BY tile_id, r ORDER BY c) - geom) AS d, (lead(z) OVER (PARTITION BY tile_id, r ORDER BY c) >= 0) = (z >= 0) AS same FROM geo UNION ALL SELECT tile_id, abs(lead(geom) OVER (PARTITION BY tile_id, c ORDER BY r) - geom), (lead(z) OVER (PARTITION BY tile_id, c ORDER BY r) >= 0) = (z >= 0) FROM geo)", select="SELECT tile_id, round(avg(d) / 9, 6) AS smoothness, count(*) AS pairs FROM d WHERE same GROUP BY 1"))
def transition_smoothness(spark, sf_dir):
    """Mean step between neighbours on the same side of the coast."""
    g = R.geom_cells(spark, sf_dir)
    pair = lambda w: F.struct(F.abs(F.lead("geom").over(w) - F.col("geom")).alias("d"), ((F.lead("z").over(w) >= 0) == (F.col("z") >= 0)).alias("same"))
    both = g.select("tile_id", pair(R.ROW).alias("a"), pair(R.COL).alias("b"))
    d = both.select("tile_id", F.explode(F.array("a", "b")).alias("x")).where("x.same")
    return d.groupBy("tile_id").agg(rnd(F.avg("x.d") / 9).alias("smoothness"), F.count("*").alias("pairs"))


@query("cumulative_area_cutoff", "SELECT p_partkey, p_brand FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) - p_size AS before, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part) WHERE before < 0.25 * total")
def cumulative_area_cutoff(spark, sf_dir):
    """Rows by priority until a quarter of the area is reached, the row that crosses included."""
    w = Window.partitionBy("p_brand")
    run = F.sum("p_size").over(w.orderBy(F.desc("p_retailprice"), "p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    p = R.table(spark, sf_dir, "part").withColumn("before", run - F.col("p_size")).withColumn("total", F.sum("p_size").over(w))
    return p.where("before < 0.25D * total").select("p_partkey", "p_brand")


@query("top_two", "SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE k <= 2")
def top_two(spark, sf_dir):
    n = R.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).where("k <= 2").drop("k")


@query("majority_label", "SELECT c_nationkey, max_by(c_mktsegment, n * 100000 + k) AS label FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) GROUP BY 1")
def majority_label(spark, sf_dir):
    """The most frequent label; of equals the greatest."""
    n = R.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.groupBy("c_nationkey").agg(F.max_by("c_mktsegment", F.struct("n", "c_mktsegment")).alias("label"))
