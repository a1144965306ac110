"""Realism score, shading, planet grids, profiles and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query, registered
from ..functions import noise, sphere
from ..operators import raster as R
from . import classes, network, terrain
from .classes import _DIST, _GRID, _SEEDS, SEEDS, grid
from .sqltext import CELLS, GRAD, NB, q

rnd = R.rounded

#: Shares of the ten landforms by class, in the order of their codes.
REFERENCE_SHARES = {
    "Alpine": (0.1046, 0.0068, 0.0715, 0.0188, 0.1422, 0.4195, 0.1292, 0.0294, 0.0755, 0.0024),
    "Coastal": (0.5484, 0.0016, 0.0374, 0.0930, 0.0341, 0.1262, 0.0304, 0.0777, 0.0495, 0.0017),
    "Cratonic": (0.6938, 0.0029, 0.0238, 0.0524, 0.0251, 0.0960, 0.0187, 0.0642, 0.0214, 0.0017),
    "FluvialArid": (0.1543, 0.0080, 0.0759, 0.0473, 0.1183, 0.3479, 0.1032, 0.0634, 0.0782, 0.0035),
    "FluvialHumid": (0.4525, 0.0035, 0.0518, 0.0756, 0.0583, 0.1828, 0.0469, 0.0599, 0.0650, 0.0037),
}
_SHARES = "ref AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k}, {x!r}::DOUBLE)" for c, row in REFERENCE_SHARES.items() for k, x in enumerate(row, 1)) + ") AS v(cls, landform, p))"


@query("geomorphon_l1", q(_SHARES, f"t AS ({registered('geomorphon_hist')})", "ids AS (SELECT DISTINCT tile_id FROM t)", "d AS (SELECT ids.tile_id, cls, sum(abs(coalesce(share, 0) - p)) / 2 AS l1 FROM ids CROSS JOIN ref LEFT JOIN t ON t.tile_id = ids.tile_id AND t.landform = ref.landform GROUP BY ALL)", select="SELECT tile_id, cls, round(l1, 4) AS l1, round(CASE WHEN l1 <= 0.15 THEN 1.0 ELSE greatest(0.0, 1 - (l1 - 0.15) / 0.15) END, 4) AS score FROM d"))
def geomorphon_l1(spark, sf_dir):
    """Distance of each tile's landform shares from each class's, and its score (fifty reference values, so broadcast)."""
    ref = spark.createDataFrame([(c, [float(x) for x in row]) for c, row in REFERENCE_SHARES.items()], "cls string, p array<double>")
    shares = terrain.landforms(spark, sf_dir).groupBy("tile_id").agg(*[F.avg(F.when(F.col("landform") == k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in range(1, 11)])
    s = shares.select("tile_id", F.array(*[F.round(f"s{k}", 6) for k in range(1, 11)]).alias("s"))
    both = s.join(F.broadcast(ref), F.size("s") == F.size("p"))
    l1 = F.aggregate(F.zip_with("s", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x) / 2
    return both.select("tile_id", "cls", l1.alias("d")).select("tile_id", "cls", rnd(F.col("d"), 4).alias("l1"), rnd(F.when(F.col("d") <= 0.15, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("d") - 0.15) / 0.15)), 4).alias("score"))


#: Metric, query, column, weight, and what a missing value counts as; landforms have 0.14, and the weights sum to 1.
SCORED = (
    ("hurst", "hurst_pooled", "hurst", 0.10, 0.0),
    ("roughness", "roughness_elev_corr", "r", 0.10, 0.0),
    ("multifractal", "multifractal_width", "width", 0.08, 0.0),
    ("slope", "slope_distribution", "mode_deg", 0.08, 0.0),
    ("aspect", "aspect_circular_variance", "circular_variance", 0.08, 0.5),
    ("tpi", "tpi_ratios", "r1_r2", 0.08, 0.0),
    ("hypsometry", "hypsometric_integral", "hi", 0.12, 0.0),
    ("drainage", "drainage_density", "km_per_km2", 0.12, 0.0),
    ("morans", "morans_i_blocks", "i", 0.10, 0.0),
)
LANDFORMS = 0.14


def _realism_sql() -> str:
    parts = [f"m{k} AS (SELECT tile_id, CAST({col} AS DOUBLE) AS x{k} FROM ({registered(name)}))" for k, (_, name, col, _, _) in enumerate(SCORED)]
    rows = ", ".join(f"('{c}', " + ", ".join(f"{x!r}::DOUBLE" for m, *_ in SCORED for x in classes.BANDS[m][i]) + ")" for i, c in enumerate(classes.CLASSES))
    names = ", ".join(f"lo{k}, hi{k}" for k in range(len(SCORED)))
    x = lambda k, none: f"CASE WHEN isfinite(x{k}) THEN x{k} ELSE {none} END"
    score = " + ".join(f"{w!r} * greatest(0.0, 1 - greatest(lo{k} - {x(k, none)}, {x(k, none)} - hi{k}, 0) / greatest(hi{k} - lo{k}, 1e-6))" for k, (_, _, _, w, none) in enumerate(SCORED))
    return q(*parts, f"g AS ({registered('geomorphon_l1')})", f"b AS (SELECT * FROM (VALUES {rows}) AS v(cls, {names}))", "ids AS (SELECT tile_id FROM m6)", select=f"SELECT ids.tile_id, b.cls, round(({score} + {LANDFORMS} * coalesce(g.score, 0)) * 100, 3) AS score FROM ids CROSS JOIN b " + " ".join(f"LEFT JOIN m{k} ON m{k}.tile_id = ids.tile_id" for k in range(len(SCORED))) + " LEFT JOIN g ON g.tile_id = ids.tile_id AND g.cls = b.cls")


@query("realism_score", _realism_sql())
def realism_score(spark, sf_dir):
    """Weighted scores of ten metrics of each tile as terrain of each class, out of 100."""
    functions = {**vars(terrain), **vars(network)}
    out = None
    for metric, name, col, _, none in SCORED:
        x = F.col(col).cast("double")
        one = functions[name](spark, sf_dir).select("tile_id", F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(none).alias(metric))
        out = one if out is None else out.join(one, "tile_id", "full")
    # a row for each class with its bands, which are constants
    of = [F.struct(F.lit(c).alias("cls"), *[F.struct(F.lit(classes.BANDS[m][i][0]).alias("lo"), F.lit(classes.BANDS[m][i][1]).alias("hi")).alias(m) for m, *_ in SCORED]) for i, c in enumerate(classes.CLASSES)]
    out = out.withColumn("b", F.explode(F.array(*of))).withColumn("cls", F.col("b.cls"))
    score = F.lit(0.0)
    for metric, _, _, w, none in SCORED:
        score = score + w * classes.band_score(F.coalesce(metric, F.lit(none)), F.col("b")[metric]["lo"], F.col("b")[metric]["hi"])
    landforms = geomorphon_l1(spark, sf_dir).select("tile_id", "cls", F.col("score").alias("g"))
    return out.join(landforms, ["tile_id", "cls"], "left").select("tile_id", "cls", rnd((score + LANDFORMS * F.coalesce("g", F.lit(0.0))) * 100, 3).alias("score"))


@query("hillshade", q(CELLS, NB, GRAD, "s AS (SELECT tile_id, r, c, atan(sqrt(gx * gx + gy * gy)) AS sl, atan2(gx, -gy) AS asp FROM grad WHERE gx + gy IS NOT NULL)", select="SELECT tile_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(greatest(0.0, cos(radians(45)) * cos(sl) + sin(radians(45)) * sin(sl) * cos(radians(315) - asp)), 5) AS light FROM s"))
def hillshade(spark, sf_dir):
    gx, gy = R.horn()
    g = R.with_neighbours(R.emb_cells(spark, sf_dir)).select("tile_id", "r", "c", gx.alias("gx"), gy.alias("gy")).where("gx + gy IS NOT NULL")
    slope, aspect = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))), F.atan2("gx", -F.col("gy"))
    half = F.radians(F.lit(45.0))
    return g.select("tile_id", "r", "c", rnd(F.greatest(F.lit(0.0), F.cos(half) * F.cos(slope) + F.sin(half) * F.sin(slope) * F.cos(F.radians(F.lit(315.0)) - aspect)), 5).alias("light"))


@query("plate_shares", q(_SEEDS, _GRID, f"n AS (SELECT r, c, arg_min(seed, {_DIST}) AS seed, any_value(lat) AS lat, any_value(lon) AS lon FROM grid, seeds GROUP BY r, c)", select="SELECT CAST(seed AS INT) AS seed, count(*) AS cells, round(sum(cos(radians(lat))) / (SELECT sum(cos(radians(lat))) FROM grid), 6) AS area, round(degrees(asin(sum(cos(radians(lat)) * sin(radians(lat))) / sqrt(power(sum(cos(radians(lat)) * cos(radians(lat)) * cos(radians(lon))), 2) + power(sum(cos(radians(lat)) * cos(radians(lat)) * sin(radians(lon))), 2) + power(sum(cos(radians(lat)) * sin(radians(lat))), 2)))), 4) AS centre_lat FROM n GROUP BY 1"))
def plate_shares(spark, sf_dir):
    """Area of each plate by the cosine of latitude, and the latitude of its centroid on the sphere."""
    best = F.array_min(F.array(*[F.struct(sphere.angle(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)).alias("d"), F.lit(k).alias("seed")) for k, a, b, _ in SEEDS]))
    w = F.cos(F.radians("lat"))
    v = grid(spark).select(best.alias("b"), w.alias("w"), sphere.unit_vector(F.col("lat"), F.col("lon")).alias("v"))
    s = v.groupBy(F.col("b.seed").alias("seed")).agg(F.count("*").alias("cells"), F.sum("w").alias("a"), *[F.sum(F.col("w") * F.col(f"v.{k}")).alias(k) for k in "xyz"])
    total = F.sum("a").over(Window.partitionBy())
    return s.select("seed", "cells", rnd(F.col("a") / total).alias("area"), rnd(F.degrees(F.asin(F.col("z") / F.sqrt(F.expr("x * x + y * y + z * z")))), 4).alias("centre_lat"))


@query("thermal_age", q(_SEEDS, _GRID, f"d AS (SELECT r, c, any_value(lat) AS lat, min({_DIST}) * 6371 AS km FROM grid, seeds GROUP BY r, c)", select="SELECT r, c, round(CASE WHEN abs(lat) < 30 THEN greatest(0.3, least(1, km / 2500)) ELSE greatest(0, least(1, km / 7000)) END, 6) AS age FROM d"))
def thermal_age(spark, sf_dir):
    km = F.least(*[sphere.angle(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)) for _, a, b, _ in SEEDS]) * sphere.EARTH_KM
    return grid(spark).select("r", "c", rnd(sphere.thermal_age(km, F.abs("lat") < 30)).alias("age"))


@query("upwind_barrier", q(CELLS, "w AS (SELECT tile_id, r, c + 64 * k AS x, z FROM cells, range(2) AS t(k))", "s AS (SELECT tile_id, r, x, z, max(CASE WHEN z > 150 THEN x END) OVER (PARTITION BY tile_id, r ORDER BY x ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m FROM w)", select="SELECT tile_id, CAST(r AS INT) AS r, CAST(x - 64 AS INT) AS c, CAST(x - m AS INT) AS cells_away FROM s WHERE x >= 64 AND m IS NOT NULL"))
def upwind_barrier(spark, sf_dir):
    """How far the nearest high cell is to the west within eight cells, around the globe."""
    x = R.emb_cells(spark, sf_dir).select("tile_id", "r", "z", F.explode(F.array(F.col("c"), F.col("c") + 64)).alias("x"))
    w = Window.partitionBy("tile_id", "r").orderBy("x").rowsBetween(-8, -1)
    s = x.withColumn("m", F.max(F.when(F.col("z") > 150, F.col("x"))).over(w))
    return s.where("x >= 64 AND m IS NOT NULL").select("tile_id", "r", (F.col("x") - 64).alias("c"), (F.col("x") - F.col("m")).alias("cells_away"))


@query("profile_variogram", "WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY h) AS i, n FROM h) SELECT v.lag, round(avg(power(b.n - a.n, 2)), 6) AS gamma FROM o a, (VALUES (1), (2), (4), (8)) AS v(lag), o b WHERE b.i = a.i + v.lag GROUP BY 1")
def profile_variogram(spark, sf_dir):
    """Variogram of hourly counts; hours, not events, go through the one ordered window."""
    h = R.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    w = Window.orderBy("h")
    d = h.select(F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("n", k).over(w) - F.col("n")).alias("d")) for k in (1, 2, 4, 8)]).alias("y")).select(F.explode("y").alias("x"))
    return d.where("x.d IS NOT NULL").groupBy(F.col("x.lag").alias("lag")).agg(rnd(F.avg(F.col("x.d") * F.col("x.d"))).alias("gamma"))


@query("weighted_mean", "SELECT o_orderpriority, round(sum(o_totalprice * n) / sum(n), 4) AS mean FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def weighted_mean(spark, sf_dir):
    n = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = R.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").join(n, "o_orderkey")
    return j.groupBy("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice") * F.col("n")) / F.sum("n"), 4).alias("mean"))


@query("tile_synthesis")
def tile_synthesis(spark, sf_dir) -> DataFrame:
    """A 64x64 tile of fractal noise, shaped to a hypsometric integral of 0.35 and 1200 m of relief."""
    x = spark.range(R.SIDE * R.SIDE).select(F.floor(F.col("id") / R.SIDE).alias("r"), (F.col("id") % R.SIDE).alias("c"))
    x = x.withColumn("z", noise.fbm_column(F.col("r") / 16.0, F.col("c") / 16.0)).withColumn("tile_id", F.lit(0))
    p = (F.row_number().over(R.TILE.orderBy("z", "r", "c")) - 1) / (R.SIDE * R.SIDE - 1)
    return x.select("tile_id", "r", "c", (1200 * F.pow(p, F.lit(1 / 0.35 - 1))).alias("z"))
