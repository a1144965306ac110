"""Ordered rules over columns, derived parameters, checks of class targets, and small window operators.

Where the tables have no sliders or influences of their own, the leading
positions of the vectors stand for them, clamped to 0..1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import raster as R
from .sqltext import CELLS, GEOM, q

rnd = R.rounded

SLIDERS = ("tectonic", "water", "age", "climate", "glaciation", "fragmentation", "mountains")
_UNIT = "least(1.0, greatest(0.0, 0.5 + 2 * CAST(embedding[{}] AS DOUBLE)))"
_SLIDERS = "p AS (SELECT vec_id, label, " + ", ".join(f"{_UNIT.format(i + 1)} AS {name}" for i, name in enumerate(SLIDERS)) + " FROM embeddings)"


def unit(i: int) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * F.col("embedding")[i].cast("double")))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def sliders(spark, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "embeddings").select("vec_id", "label", *[unit(i).alias(name) for i, name in enumerate(SLIDERS)])


def class_of_sliders() -> Column:
    """The terrain class of a parameter set; the first rule that holds."""
    c = F.col
    return (
        F.when(c("mountains") > 0.65, "Alpine").when((c("mountains") < 0.20) & (c("tectonic") < 0.30), "Cratonic").when(c("water") < 0.30, "FluvialArid")
        .when((c("water") > 0.70) & (c("mountains") < 0.25), "Coastal").otherwise("FluvialHumid")
    )


def glacial_class(x: Column) -> Column:
    return F.when(x > 0.65, "Active").when(x > 0.25, "Former").otherwise("None")


#: Erosion steps by class.
EROSION_STEPS = {"Alpine": 30, "FluvialHumid": 50, "FluvialArid": 20, "Cratonic": 10, "Coastal": 25}
_CLASS = "CASE WHEN mountains > 0.65 THEN 'Alpine' WHEN mountains < 0.20 AND tectonic < 0.30 THEN 'Cratonic' WHEN water < 0.30 THEN 'FluvialArid' WHEN water > 0.70 AND mountains < 0.25 THEN 'Coastal' ELSE 'FluvialHumid' END"
_STEPS = "CASE " + _CLASS.replace("CASE ", "(CASE ", 1) + ") " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EROSION_STEPS.items()) + " END"
_DERIVED = f"""SELECT vec_id, {_CLASS} AS terrain_class, CASE WHEN glaciation > 0.65 THEN 'Active' WHEN glaciation > 0.25 THEN 'Former' ELSE 'None' END AS glacial_class,
round(least(0.9, greatest(0.55, 0.65 + mountains * 0.2 - age * 0.1)), 6) AS h_base, round(least(0.25, greatest(0.1, 0.1 + climate * 0.15)), 6) AS h_variance,
CAST({_STEPS} AS INT) AS erosion_steps, CAST(round(7 + 15 * fragmentation) AS INT) AS n_plates, CAST(round(3 + 4 * fragmentation) AS INT) AS n_continents,
round(0.5 + tectonic * 1.5, 6) AS uplift_scale, round(0.7 + mountains * 0.6, 6) AS height_scale, round(least(2.0, greatest(0.05, (0.3 + water * 1.4) * (0.3 + age * 1.4))), 6) AS erosion_factor,
round(least(2.0, greatest(0.0, (0.3 + tectonic * 1.4) * (1 - age * 0.4))), 6) AS grain_scale, 0.015 AS warp_macro, 0.004 AS warp_micro FROM p"""


@query("slider_parameters", q(_SLIDERS, select=_DERIVED))
def slider_parameters(spark, sf_dir):
    """Classes and derived parameters of each set of sliders, in one projection."""
    c = F.col
    steps = F.create_map(*[F.lit(x) for pair in EROSION_STEPS.items() for x in pair])
    return sliders(spark, sf_dir).select(
        "vec_id",
        class_of_sliders().alias("terrain_class"),
        glacial_class(c("glaciation")).alias("glacial_class"),
        rnd(clamp(0.65 + c("mountains") * 0.2 - c("age") * 0.1, 0.55, 0.9)).alias("h_base"),
        rnd(clamp(0.1 + c("climate") * 0.15, 0.1, 0.25)).alias("h_variance"),
        F.element_at(steps, class_of_sliders()).alias("erosion_steps"),
        F.round(7 + 15 * c("fragmentation")).cast("int").alias("n_plates"),
        F.round(3 + 4 * c("fragmentation")).cast("int").alias("n_continents"),
        rnd(0.5 + c("tectonic") * 1.5).alias("uplift_scale"),
        rnd(0.7 + c("mountains") * 0.6).alias("height_scale"),
        rnd(clamp((0.3 + c("water") * 1.4) * (0.3 + c("age") * 1.4), 0.05, 2.0)).alias("erosion_factor"),
        rnd(clamp((0.3 + c("tectonic") * 1.4) * (1 - c("age") * 0.4), 0.0, 2.0)).alias("grain_scale"),
        F.lit(0.015).alias("warp_macro"),
        F.lit(0.004).alias("warp_micro"),
    )


@query("noise_parameters", q(_SLIDERS, select="SELECT label, round(avg(climate), 6) AS erodibility, round(avg(water), 6) AS grain_angle, round(least(1.0, greatest(0.0, avg(age) * (0.3 + max(tectonic) * 1.4) * (1 - min(age) * 0.4))), 6) AS grain_intensity, round(coalesce(avg(2000 * water), 800), 6) AS map_mm FROM p GROUP BY label"))
def noise_parameters(spark, sf_dir):
    """Field means of each group, scaled by its sliders and clamped."""
    p = sliders(spark, sf_dir).groupBy("label")
    grain = F.avg("age") * (0.3 + F.max("tectonic") * 1.4) * (1 - F.min("age") * 0.4)
    return p.agg(rnd(F.avg("climate")).alias("erodibility"), rnd(F.avg("water")).alias("grain_angle"), rnd(clamp(grain, 0.0, 1.0)).alias("grain_intensity"), rnd(F.coalesce(F.avg(2000 * F.col("water")), F.lit(800.0))).alias("map_mm"))


#: The least influence of an active regime, the least stability of a shield, and the width of a margin in cells.
ACTIVE, STABLE, MARGIN = 0.02, 0.05, 4
INFLUENCES = ("conv", "div", "trans", "hot", "craton")
_INFLUENCE = "f AS (SELECT vec_id, " + ", ".join(f"abs(CAST(embedding[{i + 8}] AS DOUBLE)) AS {n}" for i, n in enumerate(INFLUENCES)) + ", CAST(embedding[13] AS DOUBLE) AS rate, CAST(embedding[14] AS DOUBLE) AS slip, CAST(floor(abs(CAST(embedding[15] AS DOUBLE)) * 60) AS INT) AS to_conv, CAST(floor(abs(CAST(embedding[16] AS DOUBLE)) * 60) AS INT) AS to_ocean, embedding[17] > 0 AS land, 2000 * abs(CAST(embedding[18] AS DOUBLE)) AS map_mm FROM embeddings)"
_CRUST = "g AS (SELECT *, CASE WHEN NOT land THEN 'Oceanic' WHEN to_conv <= 4 THEN 'ActiveMargin' WHEN to_ocean <= 4 THEN 'PassiveMargin' ELSE 'Continental' END AS crust FROM f)"
_REGIME = "h AS (SELECT *, CASE WHEN conv >= 0.02 AND conv >= div AND conv >= trans AND conv >= hot AND conv >= craton THEN 'ActiveCompressional' WHEN div >= 0.02 AND div >= trans AND div >= hot AND div >= craton THEN 'ActiveExtensional' WHEN hot >= 0.02 AND hot >= trans AND hot >= craton THEN 'VolcanicHotspot' WHEN crust = 'Continental' AND craton >= 0.05 AND craton >= trans THEN 'CratonicShield' ELSE 'PassiveMargin' END AS regime FROM g)"
_LOCAL = "CASE WHEN regime IN ('ActiveCompressional', 'VolcanicHotspot') THEN 'Alpine' WHEN regime = 'CratonicShield' THEN 'Cratonic' WHEN regime = 'PassiveMargin' AND map_mm >= 600 THEN 'Coastal' WHEN regime = 'ActiveExtensional' AND map_mm > 800 THEN 'FluvialHumid' ELSE 'FluvialArid' END"


def regime(crust: Column) -> Column:
    """The regime with the greatest influence; ties go to the first named, and weak influences to none."""
    conv, div, trans, hot, craton = (F.col(x) for x in INFLUENCES)
    return (
        F.when((conv >= ACTIVE) & (conv >= div) & (conv >= trans) & (conv >= hot) & (conv >= craton), "ActiveCompressional")
        .when((div >= ACTIVE) & (div >= trans) & (div >= hot) & (div >= craton), "ActiveExtensional")
        .when((hot >= ACTIVE) & (hot >= trans) & (hot >= craton), "VolcanicHotspot")
        .when((crust == "Continental") & (craton >= STABLE) & (craton >= trans), "CratonicShield")
        .otherwise("PassiveMargin")
    )


@query("regime_rules", q(_INFLUENCE, _CRUST, _REGIME, select=f"SELECT vec_id, crust, crust <> 'Oceanic' AS continental, regime, CASE WHEN conv >= div AND conv >= trans AND conv >= hot THEN 'Convergent' WHEN div >= trans AND div >= hot THEN 'Divergent' WHEN trans >= hot THEN 'Transform' ELSE 'Hotspot' END AS mode, -rate > abs(slip) AS divergent, rate > abs(slip) AS convergent, {_LOCAL} AS terrain_class FROM h"))
def regime_rules(spark, sf_dir):
    """Crust type, regime, dominant boundary mode, boundary predicates and local class of each cell."""
    e = lambda i: F.col("embedding")[i].cast("double")
    far = lambda i: F.floor(F.abs(e(i)) * 60).cast("int")
    f = R.table(spark, sf_dir, "embeddings").select("vec_id", *[F.abs(e(i + 7)).alias(n) for i, n in enumerate(INFLUENCES)], e(12).alias("rate"), e(13).alias("slip"), far(14).alias("to_conv"), far(15).alias("to_ocean"), (e(16) > 0).alias("land"), (2000 * F.abs(e(17))).alias("map_mm"))
    conv, div, trans, hot, _ = (F.col(x) for x in INFLUENCES)
    crust = F.when(~F.col("land"), "Oceanic").when(F.col("to_conv") <= MARGIN, "ActiveMargin").when(F.col("to_ocean") <= MARGIN, "PassiveMargin").otherwise("Continental")
    g = f.withColumn("crust", crust)
    g = g.withColumn("regime", regime(F.col("crust")))
    mode = F.when((conv >= div) & (conv >= trans) & (conv >= hot), "Convergent").when((div >= trans) & (div >= hot), "Divergent").when(trans >= hot, "Transform").otherwise("Hotspot")
    rain, kind = F.col("map_mm"), F.col("regime")
    local = F.when(kind.isin("ActiveCompressional", "VolcanicHotspot"), "Alpine").when(kind == "CratonicShield", "Cratonic").when((kind == "PassiveMargin") & (rain >= 600), "Coastal").when((kind == "ActiveExtensional") & (rain > 800), "FluvialHumid").otherwise("FluvialArid")
    return g.select("vec_id", "crust", F.col("crust").isin("Continental", "ActiveMargin", "PassiveMargin").alias("continental"), "regime", mode.alias("mode"), (-F.col("rate") > F.abs("slip")).alias("divergent"), (F.col("rate") > F.abs("slip")).alias("convergent"), local.alias("terrain_class"))


@query("boundary_types", "SELECT vec_id // 16 AS line, round(avg(40 * CAST(embedding[13] AS DOUBLE)), 6) AS rate, CASE WHEN avg(40 * CAST(embedding[13] AS DOUBLE)) > 1 THEN 'Convergent' WHEN avg(40 * CAST(embedding[13] AS DOUBLE)) < -1 THEN 'Divergent' ELSE 'Transform' END AS kind FROM embeddings GROUP BY 1")
def boundary_types(spark, sf_dir):
    """The type of each line of boundary cells, by its mean rate of convergence."""
    x = R.table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).cast("long").alias("line")).agg(F.avg(40 * F.col("embedding")[12].cast("double")).alias("m"))
    return x.select("line", rnd(F.col("m")).alias("rate"), F.when(F.col("m") > 1, "Convergent").when(F.col("m") < -1, "Divergent").otherwise("Transform").alias("kind"))


@query("relief_bins", q(CELLS, "h AS (SELECT tile_id, r // 16 AS band, max(z) - min(z) AS relief FROM cells GROUP BY ALL)", select="SELECT tile_id, CAST(band AS INT) AS band, round(relief, 6) AS relief, CASE WHEN relief < 200 THEN 'Low' WHEN relief <= 800 THEN 'Moderate' ELSE 'High' END AS bin FROM h"))
def relief_bins(spark, sf_dir):
    h = R.emb_cells(spark, sf_dir).groupBy("tile_id", F.floor(F.col("r") / 16).cast("int").alias("band")).agg((F.max("z") - F.min("z")).alias("relief"))
    x = F.col("relief")
    return h.select("tile_id", "band", rnd(x).alias("relief"), F.when(x < 200, "Low").when(x <= 800, "Moderate").otherwise("High").alias("bin"))


@query("drainage_density_proxy", q(CELLS, GEOM, select="SELECT tile_id, count(*) FILTER (geom IN (7, 9)) AS cells, round(nullif(count(*) FILTER (geom IN (7, 9)), 0) * 0.09 / 33.1776, 6) AS density FROM geo GROUP BY 1"))
def drainage_density_proxy(spark, sf_dir):
    """Hollow and valley cells as streams: their length in km by the area of the tile; null if there are none."""
    n = F.count(F.when(F.col("geom").isin(7, 9), 1))
    return R.geom_cells(spark, sf_dir).groupBy("tile_id").agg(n.alias("cells"), rnd(F.nullif(n, F.lit(0)) * 0.09 / F.lit((R.SIDE * 0.09) ** 2)).alias("density"))


#: Stand-in for the region table: the class that each region's windows are expected to have.
EXPECTED = ("Alpine", "Coastal", "Cratonic", "FluvialArid", "FluvialHumid")
#: Published ranges of class means (class, metric, low, high, whether a deviation is documented).
LITERATURE = (
    ("Alpine", "hurst_exponent", 0.75, 0.90, False),
    ("FluvialHumid", "hurst_exponent", 0.70, 0.85, True),
    ("Alpine", "valley_hollow_share", 0.15, 0.35, False),
    ("Cratonic", "flat_slope_share", 0.55, 0.80, False),
    ("Alpine", "hypsometric_integral", 0.45, 0.65, True),
    ("FluvialHumid", "hypsometric_integral", 0.35, 0.55, False),
    ("Coastal", "hypsometric_integral", 0.30, 0.45, True),
)
_NAMES = "CASE CAST(tile_id % 5 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(EXPECTED)) + " END"
_TARGETS = f"""w AS (SELECT tile_id, {_NAMES} AS cls, (avg(z) - min(z)) / (max(z) - min(z)) AS hi, avg((geom IN (7, 9))::INT) AS vh, avg((geom IN (1, 6))::INT) AS fs FROM geo GROUP BY tile_id),
targets AS (SELECT cls, 'hypsometric_integral' AS metric, avg(hi) AS value FROM w GROUP BY 1 UNION ALL SELECT cls, 'valley_hollow_share', avg(vh) FROM w GROUP BY 1 UNION ALL SELECT cls, 'flat_slope_share', avg(fs) FROM w GROUP BY 1)"""
_CHECKS = "checks AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{m}', {lo}, {hi}, {known})" for c, m, lo, hi, known in LITERATURE) + ") AS v(cls, metric, lo, hi, known))"
_STATUS = "s AS (SELECT cls, metric, value, known, CASE WHEN value BETWEEN lo AND hi THEN 'PASS' WHEN value BETWEEN lo - 0.1 * (hi - lo) AND hi + 0.1 * (hi - lo) THEN 'WARN' ELSE 'FAIL' END AS status FROM targets JOIN checks USING (cls, metric) WHERE isfinite(value))"


def class_targets(spark, sf_dir: str) -> DataFrame:
    """(cls, metric, value): class means, by the class that each window's region is expected to have."""
    regions = spark.createDataFrame(list(enumerate(EXPECTED)), "region int, cls string")
    share = lambda *k: F.avg(F.col("geom").isin(*k).cast("int"))
    w = R.geom_cells(spark, sf_dir).groupBy("tile_id").agg(((F.avg("z") - F.min("z")) / (F.max("z") - F.min("z"))).alias("hypsometric_integral"), share(7, 9).alias("valley_hollow_share"), share(1, 6).alias("flat_slope_share"))
    w = w.withColumn("region", (F.col("tile_id") % 5).cast("int")).join(F.broadcast(regions), "region")
    metrics = ("hypsometric_integral", "valley_hollow_share", "flat_slope_share")
    return w.groupBy("cls").agg(*[F.avg(m).alias(m) for m in metrics]).unpivot("cls", list(metrics), "metric", "value")


def checked(spark, sf_dir: str) -> DataFrame:
    """The targets that a check knows, with their status; a check whose class or metric is missing is left out."""
    checks = spark.createDataFrame(list(LITERATURE), "cls string, metric string, lo double, hi double, known boolean")
    x, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    slack = 0.1 * (hi - lo)
    status = F.when(x.between(lo, hi), "PASS").when(x.between(lo - slack, hi + slack), "WARN").otherwise("FAIL")
    return class_targets(spark, sf_dir).join(F.broadcast(checks), ["cls", "metric"]).where(x.isNotNull() & ~F.isnan(x)).select("cls", "metric", "value", "known", status.alias("status"))


@query("literature_checks", q(CELLS, GEOM, _TARGETS, _CHECKS, _STATUS, select="SELECT cls, metric, round(value, 6) AS value, status, known FROM s"))
def literature_checks(spark, sf_dir):
    return checked(spark, sf_dir).withColumn("value", rnd(F.col("value")))


@query("check_report", q(CELLS, GEOM, _TARGETS, _CHECKS, _STATUS, select="SELECT status, known, count(*) AS n, count(*) FILTER (status = 'FAIL' AND NOT known) AS unexpected FROM s GROUP BY ALL"))
def check_report(spark, sf_dir):
    """Checks by status and whether a deviation is documented; failures that are not are unexpected."""
    return checked(spark, sf_dir).groupBy("status", "known").agg(F.count("*").alias("n"), F.count(F.when((F.col("status") == "FAIL") & ~F.col("known"), 1)).alias("unexpected"))


@query("expected_class_windows", q(CELLS, f"w AS (SELECT tile_id, {_NAMES} AS cls, max(z) - min(z) AS relief FROM cells GROUP BY tile_id)", select="SELECT cls, count(*) AS n_windows, count(*) >= 50 AS enough, round(avg(relief), 6) AS mean_relief FROM w GROUP BY 1"))
def expected_class_windows(spark, sf_dir):
    """Windows by their region's expected class, not their own label."""
    regions = spark.createDataFrame(list(enumerate(EXPECTED)), "region int, cls string")
    w = R.emb_cells(spark, sf_dir).groupBy("tile_id").agg((F.max("z") - F.min("z")).alias("relief")).withColumn("region", (F.col("tile_id") % 5).cast("int"))
    return w.join(F.broadcast(regions), "region").groupBy("cls").agg(F.count("*").alias("n_windows"), (F.count("*") >= 50).alias("enough"), rnd(F.avg("relief")).alias("mean_relief"))


@query("profile_stats", "SELECT label, p, round(avg(x), 6) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)), 6) AS std, count(DISTINCT vec_id // 64) AS n_windows, count(*) < 50 AS low_sample FROM (SELECT label, vec_id, CAST(i - 1 AS INT) AS p, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, 22)) AS t(i)) GROUP BY label, p")
def profile_stats(spark, sf_dir):
    """Mean, deviation and contributing windows of the 21 positions of a profile, by class."""
    x = R.table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 64).alias("w"), F.posexplode(F.slice("embedding", 1, 21)).alias("p", "x")).withColumn("x", F.col("x").cast("double"))
    std = F.sqrt(F.greatest(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"), F.lit(0.0)))
    return x.groupBy("label", "p").agg(rnd(F.avg("x")).alias("mean"), rnd(std).alias("std"), F.count_distinct("w").alias("n_windows"), (F.count("*") < 50).alias("low_sample"))


@query("box_blur_clamped", q(CELLS, *[f"b{k} AS (SELECT tile_id, r, c, (coalesce(lag(h) OVER v, h) + h + coalesce(lead(h) OVER v, h)) / 9 AS z FROM (SELECT tile_id, r, c, coalesce(lag(z) OVER u, z) + z + coalesce(lead(z) OVER u, z) AS h FROM {'cells' if k == 0 else f'b{k - 1}'} WINDOW u AS (PARTITION BY tile_id, r ORDER BY c)) WINDOW v AS (PARTITION BY tile_id, c ORDER BY r))" for k in range(3)], select="SELECT tile_id, r, CAST(c AS INT) AS c, round(z, 6) AS z FROM b2 WHERE r % 8 = 0 AND c % 8 = 0"))
def box_blur_clamped(spark, sf_dir):
    """Three box blurs of 3 x 3 cells, edge cells standing in for what is outside; each eighth cell is shown."""
    x = R.emb_cells(spark, sf_dir)
    for _ in range(3):
        for w in (R.ROW, R.COL):
            x = x.withColumn("z", F.coalesce(F.lag("z").over(w), "z") + F.col("z") + F.coalesce(F.lead("z").over(w), "z"))
        x = x.withColumn("z", F.col("z") / 9)
    return x.where("r % 8 = 0 AND c % 8 = 0").select("tile_id", "r", "c", rnd(F.col("z")).alias("z"))


def runs(cells: DataFrame, flag: str) -> DataFrame:
    """cells with run: a number for each stretch of equal flags along a row."""
    turned = F.coalesce((F.col(flag) != F.lag(flag).over(R.ROW)).cast("int"), F.lit(0))
    return cells.withColumn("_turned", turned).withColumn("run", F.sum("_turned").over(R.ROW)).drop("_turned")


_RUNS = "SELECT *, sum(t) OVER (PARTITION BY tile_id, r ORDER BY c) AS run FROM (SELECT *, coalesce((f <> lag(f) OVER (PARTITION BY tile_id, r ORDER BY c))::INT, 0) AS t FROM {})"


@query("valley_widths", q(CELLS, GEOM, "m AS (SELECT tile_id, r, c, geom IN (7, 9) AS v FROM geo)", "b AS (SELECT tile_id, r, c, v OR coalesce(lag(v) OVER w AND lead(v) OVER w, false) AS f FROM m WINDOW w AS (PARTITION BY tile_id, r ORDER BY c))", f"n AS (SELECT tile_id, r, run, count(*) AS k FROM ({_RUNS.format('b')}) WHERE f GROUP BY ALL)", select="SELECT tile_id, count(*) AS runs, round(avg(k), 6) AS mean_px, round(avg(k) * 0.09, 6) AS mean_km FROM n GROUP BY 1"))
def valley_widths(spark, sf_dir):
    """Mean length of runs of hollow and valley cells along rows; a gap of one cell is bridged."""
    x = R.geom_cells(spark, sf_dir).withColumn("v", F.col("geom").isin(7, 9))
    x = x.withColumn("f", F.col("v") | F.coalesce(F.lag("v").over(R.ROW) & F.lead("v").over(R.ROW), F.lit(False)))
    n = runs(x, "f").where("f").groupBy("tile_id", "r", "run").agg(F.count("*").alias("k"))
    return n.groupBy("tile_id").agg(F.count("*").alias("runs"), rnd(F.avg("k")).alias("mean_px"), rnd(F.avg("k") * 0.09).alias("mean_km"))


@query("belt_widths", q(CELLS, "w AS (SELECT tile_id, r, c + 64 * k AS c, z > 100 AS f FROM cells, (VALUES (0), (1), (2)) AS t(k))", f"u AS ({_RUNS.format('w')})", "v AS (SELECT *, c - min(c) OVER p AS before, max(c) OVER p - c AS after FROM u WINDOW p AS (PARTITION BY tile_id, r, run))", select="SELECT tile_id, CAST(least(before, 16) + least(after, 16) + 1 AS INT) AS width, count(*) AS cells FROM v WHERE f AND c >= 64 AND c < 128 GROUP BY ALL"))
def belt_widths(spark, sf_dir):
    """How wide the belt of high cells is at each of them, along rows that wrap around, looking a quarter of a row to both sides."""
    x = R.emb_cells(spark, sf_dir).select("tile_id", "r", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("c") + R.SIDE * k)).alias("c"), (F.col("z") > 100).alias("f"))
    p = Window.partitionBy("tile_id", "r", "run")
    v = runs(x, "f").withColumn("before", F.col("c") - F.min("c").over(p)).withColumn("after", F.max("c").over(p) - F.col("c"))
    most = F.lit(R.SIDE // 4)
    v = v.where(F.col("f") & (F.col("c") >= R.SIDE) & (F.col("c") < 2 * R.SIDE))
    return v.groupBy("tile_id", (F.least("before", most) + F.least("after", most) + 1).cast("int").alias("width")).agg(F.count("*").alias("cells"))


@query("consecutive_distinct", q(CELLS, GEOM, "l AS (SELECT tile_id, r, c, geom, lag(geom) OVER (PARTITION BY tile_id, r ORDER BY c) AS p FROM geo)", select="SELECT tile_id, r, count(*) AS steps, CAST(sum(geom) AS BIGINT) AS total FROM l WHERE p IS NULL OR p <> geom GROUP BY ALL"))
def consecutive_distinct(spark, sf_dir):
    """Codes along rows without those that repeat the one before."""
    x = R.geom_cells(spark, sf_dir).withColumn("p", F.lag("geom").over(R.ROW)).where("p IS NULL OR p <> geom")
    return x.groupBy("tile_id", "r").agg(F.count("*").alias("steps"), F.sum("geom").alias("total"))


_POINTS = "pts AS (SELECT vec_id, vec_id // 64 AS line, greatest(-80.0, least(80.0, 200 * CAST(embedding[20] AS DOUBLE))) AS lat, greatest(-170.0, least(170.0, 400 * CAST(embedding[21] AS DOUBLE))) AS lon FROM embeddings)"


def points(spark, sf_dir: str) -> DataFrame:
    e = lambda i, k, most: F.greatest(F.lit(-most), F.least(F.lit(most), k * F.col("embedding")[i].cast("double")))
    return R.table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).cast("long").alias("line"), e(19, 200, 80.0).alias("lat"), e(20, 400, 170.0).alias("lon"))


@query("arc_lengths", q(_POINTS, "d AS (SELECT *, acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(plat)) + cos(radians(lat)) * cos(radians(plat)) * cos(radians(lon - plon))))) AS a FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pts WINDOW w AS (PARTITION BY line ORDER BY vec_id)))", select="SELECT vec_id, round(degrees(sum(coalesce(a, 0)) OVER (PARTITION BY line ORDER BY vec_id)), 4) AS degrees FROM d"))
def arc_lengths(spark, sf_dir):
    """Length of each line up to each of its points, along great circles."""
    w = Window.partitionBy("line").orderBy("vec_id")
    rad = F.radians
    x = points(spark, sf_dir).withColumn("plat", F.lag("lat").over(w)).withColumn("plon", F.lag("lon").over(w))
    cosine = F.sin(rad("lat")) * F.sin(rad("plat")) + F.cos(rad("lat")) * F.cos(rad("plat")) * F.cos(rad(F.col("lon") - F.col("plon")))
    step = F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))), F.lit(0.0))
    return x.withColumn("a", step).select("vec_id", F.round(F.degrees(F.sum("a").over(w)), 4).alias("degrees"))


@query("bilinear_samples", q(CELLS, "s AS (SELECT tile_id, k, 63 * (k * 37 % 101) / 101.0 AS fx, 63 * (k * 53 % 103) / 103.0 AS fy FROM (SELECT DISTINCT tile_id FROM cells), unnest(range(8)) AS t(k))", "j AS (SELECT s.tile_id, s.k, z * (1 - abs(c - fx)) * (1 - abs(r - fy)) AS v FROM s JOIN cells ON cells.tile_id = s.tile_id AND abs(c - fx) < 1 AND abs(r - fy) < 1)", select="SELECT tile_id, CAST(k AS INT) AS k, round(sum(v), 6) AS z FROM j GROUP BY ALL"))
def bilinear_samples(spark, sf_dir):
    """Heights between cells, of eight points of each tile, from the four cells around each."""
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(k.alias("k"), (63 * (k * 37 % 101) / 101.0).alias("fx"), (63 * (k * 53 % 103) / 103.0).alias("fy")))
    corner = lambda x, n: F.array_distinct(F.array(F.floor(x).cast("int"), F.least(F.floor(x).cast("int") + 1, F.lit(n))))
    # points are dealt out like the cells, four rows each, and meet them by equal (tile, row, column)
    tiles = R.emb_cells(spark, sf_dir)
    s = tiles.where("r = 0 AND c = 0").select("tile_id", F.explode(at).alias("p")).select("tile_id", "p.*").withColumn("r", F.explode(corner(F.col("fy"), 63))).withColumn("c", F.explode(corner(F.col("fx"), 63)))
    v = F.col("z") * (1 - F.abs(F.col("c") - F.col("fx"))) * (1 - F.abs(F.col("r") - F.col("fy")))
    return tiles.join(s, ["tile_id", "r", "c"]).groupBy("tile_id", "k").agg(rnd(F.sum(v)).alias("z"))


@query("strided_samples", "SELECT line, vec_id FROM (SELECT vec_id // 640 AS line, vec_id, row_number() OVER (PARTITION BY vec_id // 640 ORDER BY embedding[1], vec_id) - 1 AS k, count(*) OVER (PARTITION BY vec_id // 640) AS n FROM embeddings) WHERE k % greatest(n // 96, 1) = 0 AND k // greatest(n // 96, 1) < 96")
def strided_samples(spark, sf_dir):
    """Of each group every n-th row in order of a distance, 96 at most: the operator is this limit."""
    w = Window.partitionBy("line")
    x = R.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 640).cast("long").alias("line"), "vec_id", F.col("embedding")[0].alias("d"))
    x = x.withColumn("k", F.row_number().over(w.orderBy("d", "vec_id")) - 1).withColumn("step", F.greatest(F.floor(F.count("*").over(w) / 96), F.lit(1)))
    return x.where((F.col("k") % F.col("step") == 0) & (F.floor(F.col("k") / F.col("step")) < 96)).select("line", "vec_id")


@query("weighted_samples", "SELECT line, vec_id FROM (SELECT vec_id // 64 AS line, vec_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY ln((CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) + 1) / 4294967297.0) / power(0.01 + abs(CAST(embedding[1] AS DOUBLE)), 0.7) DESC, vec_id) AS k FROM embeddings) WHERE k <= 5")
def weighted_samples(spark, sf_dir):
    """Five rows of each group, drawn without replacement by weights to the power 0.7: those with the greatest ln(u) / w."""
    u = (F.conv(F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)
    key = F.log(u) / F.pow(0.01 + F.abs(F.col("embedding")[0].cast("double")), F.lit(0.7))
    x = R.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).cast("long").alias("line"), "vec_id", key.alias("key"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("key"), "vec_id"))).where("k <= 5").select("line", "vec_id")


@query("render_normalised", q(CELLS, "m AS (SELECT tile_id, min(z) AS lo, max(z) AS hi FROM cells GROUP BY 1)", select="SELECT tile_id, r, round(avg(CASE WHEN z >= 0 THEN 0.5 + 0.5 * z / greatest(hi, 0.001) ELSE 0.5 * (z - lo) / greatest(-lo, 0.001) END), 6) AS shade FROM cells JOIN m USING (tile_id) GROUP BY ALL"))
def render_normalised(spark, sf_dir):
    """Heights to 0..1 with the sea's level at a half, as means of rows."""
    x = R.emb_cells(spark, sf_dir).withColumn("lo", F.min("z").over(R.TILE)).withColumn("hi", F.max("z").over(R.TILE))
    z = F.col("z")
    shade = F.when(z >= 0, 0.5 + 0.5 * z / F.greatest("hi", F.lit(0.001))).otherwise(0.5 * (z - F.col("lo")) / F.greatest(-F.col("lo"), F.lit(0.001)))
    return x.groupBy("tile_id", "r").agg(rnd(F.avg(shade)).alias("shade"))


@query("ceiling_stats", q(CELLS, "m AS (SELECT tile_id, r, count(*) FILTER (z > 250) AS n FROM cells GROUP BY ALL)", "k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY tile_id) AS w FROM m)", select="SELECT tile_id, max(n) FILTER (k = round(0.9 * (w - 1))) AS p90, round(avg((n = 0)::INT), 6) AS zero_share FROM k GROUP BY 1"))
def ceiling_stats(spark, sf_dir):
    """Of the counts of very high cells in rows: the ninth tenth, and how many rows have none."""
    m = R.emb_cells(spark, sf_dir).groupBy("tile_id", "r").agg(F.count(F.when(F.col("z") > 250, 1)).alias("n"))
    w = Window.partitionBy("tile_id")
    k = m.withColumn("k", F.row_number().over(w.orderBy("n")) - 1).withColumn("w", F.count("*").over(w))
    return k.groupBy("tile_id").agg(F.max(F.when(F.col("k") == F.round(F.lit(0.9) * (F.col("w") - 1)), F.col("n"))).alias("p90"), rnd(F.avg((F.col("n") == 0).cast("int"))).alias("zero_share"))


@query("group_histogram", "SELECT label, CAST(least(9, greatest(0, floor((x + 0.5) * 10))) AS INT) AS bin, count(*) AS n, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY ALL")
def group_histogram(spark, sf_dir):
    """Counts, least and greatest value of ten bins, by group."""
    x = R.table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    return x.groupBy("label", F.least(F.lit(9), F.greatest(F.lit(0), F.floor((F.col("x") + 0.5) * 10))).cast("int").alias("bin")).agg(F.count("*").alias("n"), rnd(F.min("x")).alias("lo"), rnd(F.max("x")).alias("hi"))
