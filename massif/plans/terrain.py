"""Slope, aspect, roughness, fractal, hypsometric and landform metrics of tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query, registered
from ..operators import raster as R
from .sqltext import CELLS, GRAD, NB, q

rnd = R.rounded


def slopes(spark, sf_dir: str) -> DataFrame:
    gx, gy = R.horn()
    return R.with_neighbours(R.emb_cells(spark, sf_dir)).select("tile_id", "r", "c", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope")).where(F.col("slope").isNotNull())


_SLOPE = "slope AS (SELECT tile_id, degrees(atan(sqrt(gx * gx + gy * gy))) AS s FROM grad WHERE gx IS NOT NULL AND gy IS NOT NULL)"
_BINS = "bins AS (SELECT tile_id, least(CAST(floor(s) AS INT), 89) AS bin, count(*) AS n FROM slope GROUP BY ALL)"


@query("slope_distribution", q(CELLS, NB, GRAD, _SLOPE, _BINS, "mode AS (SELECT tile_id, max_by(bin, n * 1000 + bin) + 0.5 AS mode FROM bins GROUP BY 1)", "m AS (SELECT tile_id, avg(s) AS mu, stddev_pop(s) AS sd FROM slope GROUP BY 1)", select="SELECT s.tile_id, CAST(any_value(mode) AS DOUBLE) AS mode_deg, round(any_value(mu), 6) AS mean_deg, round(any_value(sd), 6) AS std_deg, round(CASE WHEN any_value(sd) < 1e-12 THEN 0.0 ELSE avg(power(s - mu, 3)) / power(any_value(sd), 3) END, 6) AS skew FROM slope s JOIN mode USING (tile_id) JOIN m USING (tile_id) GROUP BY 1"))
def slope_distribution(spark, sf_dir):
    """Mode (of 90 one-degree bins, the last of equals), mean, deviation and skewness of the slope of each tile."""
    s = slopes(spark, sf_dir)
    bins = s.groupBy("tile_id", F.least(F.floor("slope").cast("int"), F.lit(89)).alias("bin")).agg(F.count("*").alias("n"))
    mode = bins.groupBy("tile_id").agg((F.max_by("bin", F.struct("n", "bin")) + 0.5).cast("double").alias("mode_deg"))
    sd = F.stddev_pop("slope")
    out = s.groupBy("tile_id").agg(rnd(F.avg("slope")).alias("mean_deg"), rnd(sd).alias("std_deg"), rnd(F.when(sd < 1e-12, 0.0).otherwise(F.skewness("slope"))).alias("skew"))
    return mode.join(out, "tile_id")


@query("slope_histogram", q(CELLS, NB, GRAD, _SLOPE, _BINS, select="SELECT tile_id, bin, round(n / CAST(sum(n) OVER (PARTITION BY tile_id) AS DOUBLE), 6) AS share FROM bins"))
def slope_histogram(spark, sf_dir):
    n = slopes(spark, sf_dir).groupBy("tile_id", F.least(F.floor("slope").cast("int"), F.lit(89)).alias("bin")).agg(F.count("*").alias("n"))
    return n.select("tile_id", "bin", rnd(F.col("n") / F.sum("n").over(R.TILE)).alias("share"))


@query("slope_mode_central", q(CELLS, NB, "s AS (SELECT tile_id, least(CAST(floor(degrees(atan(sqrt(power((e - w) / 180, 2) + power((s - n) / 180, 2))))) AS INT), 90) AS bin FROM nb WHERE e - w + s - n IS NOT NULL)", "b AS (SELECT tile_id, bin, count(*) AS n FROM s GROUP BY ALL)", select="SELECT tile_id, CAST(max_by(bin, n * 1000 + bin) + 0.5 AS DOUBLE) AS mode_deg FROM b GROUP BY 1"))
def slope_mode_central(spark, sf_dir):
    """Mode of the slope by central differences (the target family's estimator)."""
    c = F.col
    slope = F.degrees(F.atan(F.sqrt(F.pow((c("e") - c("w")) / 180, 2) + F.pow((c("s") - c("n")) / 180, 2))))
    s = R.with_neighbours(R.emb_cells(spark, sf_dir)).select("tile_id", F.least(F.floor(slope).cast("int"), F.lit(90)).alias("bin"), slope.alias("x")).where("x IS NOT NULL")
    return s.groupBy("tile_id", "bin").agg(F.count("*").alias("n")).groupBy("tile_id").agg((F.max_by("bin", F.struct("n", "bin")) + 0.5).cast("double").alias("mode_deg"))


@query("aspect_circular_variance", q(CELLS, NB, GRAD, "a AS (SELECT tile_id, atan2(gx, -gy) AS t, sqrt(gx * gx + gy * gy) >= 1.745e-4 AS ok FROM grad WHERE gx + gy IS NOT NULL)", "m AS (SELECT tile_id, avg(cos(t)) FILTER (ok) AS mc, avg(sin(t)) FILTER (ok) AS ms, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS flat FROM a GROUP BY 1)", select="SELECT tile_id, round(1 - sqrt(mc * mc + ms * ms), 6) AS circular_variance, round(degrees(atan2(ms, mc)), 6) AS mean_direction_deg, round(flat, 6) AS flat_share FROM m"))
def aspect_circular_variance(spark, sf_dir):
    gx, gy = R.horn()
    g = R.with_neighbours(R.emb_cells(spark, sf_dir)).select("tile_id", gx.alias("gx"), gy.alias("gy")).where("gx + gy IS NOT NULL")
    ok = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) >= 1.745e-4
    t = F.when(ok, F.atan2("gx", -F.col("gy")))
    m = g.groupBy("tile_id").agg(F.avg(F.cos(t)).alias("mc"), F.avg(F.sin(t)).alias("ms"), F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("flat"))
    return m.select("tile_id", rnd(1 - F.sqrt(F.col("mc") * F.col("mc") + F.col("ms") * F.col("ms"))).alias("circular_variance"), rnd(F.degrees(F.atan2("ms", "mc"))).alias("mean_direction_deg"), rnd(F.col("flat")).alias("flat_share"))


@query("grain_anisotropy", q(CELLS, NB, "a AS (SELECT tile_id, atan2((s - n) / 180, -(e - w) / 180) AS t FROM nb WHERE e - w + s - n IS NOT NULL AND (e <> w OR s <> n))", select="SELECT tile_id, round(1 - sqrt(power(avg(cos(t)), 2) + power(avg(sin(t)), 2)), 6) AS anisotropy FROM a GROUP BY 1 HAVING count(*) >= 100"))
def grain_anisotropy(spark, sf_dir):
    c = F.col
    a = R.with_neighbours(R.emb_cells(spark, sf_dir)).where("e - w + s - n IS NOT NULL AND (e <> w OR s <> n)").select("tile_id", F.atan2((c("s") - c("n")) / 180, -(c("e") - c("w")) / 180).alias("t"))
    return a.groupBy("tile_id").agg(F.count("*").alias("k"), rnd(1 - F.sqrt(F.pow(F.avg(F.cos("t")), 2) + F.pow(F.avg(F.sin("t")), 2))).alias("anisotropy")).where("k >= 100").drop("k")


_EIGHT = ("n", "ne", "e", "se", "s", "sw", "w", "nw")
_SUM9, _SQ9 = " + ".join(("z", *_EIGHT)), " + ".join(f"{x} * {x}" for x in ("z", *_EIGHT))
_SUM8, _SQ8 = " + ".join(_EIGHT), " + ".join(f"{x} * {x}" for x in _EIGHT)


@query("roughness_elev_corr", q(CELLS, NB, f"x AS (SELECT tile_id, sqrt(greatest(({_SQ9}) / 9 - power(({_SUM9}) / 9, 2), 0)) AS sd, (rank() OVER (PARTITION BY tile_id ORDER BY z) - 1) / 4096.0 AS p FROM nb)", select="SELECT tile_id, round(corr(sd, p), 6) AS r FROM x WHERE sd IS NOT NULL GROUP BY 1"))
def roughness_elev_corr(spark, sf_dir):
    """Correlation of the 3x3 deviation with the percentile rank of the height."""
    x = R.with_neighbours(R.emb_cells(spark, sf_dir)).withColumn("p", (F.rank().over(R.TILE.orderBy("z")) - 1) / (R.SIDE * R.SIDE))
    x = x.withColumn("sd", F.expr(f"sqrt(greatest(({_SQ9}) / 9 - power(({_SUM9}) / 9, 2), 0D))")).where("sd IS NOT NULL")
    return x.groupBy("tile_id").agg(rnd(F.corr("sd", "p")).alias("r"))


@query("roughness_elev_corr_target", q(CELLS, NB, f"x AS (SELECT tile_id, z, sqrt(greatest(({_SQ8}) / 8 - power(({_SUM8}) / 8, 2), 0)) AS sd FROM nb)", select="SELECT tile_id, round(coalesce(corr(z, sd), 0), 6) AS r FROM x WHERE sd IS NOT NULL GROUP BY 1 HAVING count(*) >= 100"))
def roughness_elev_corr_target(spark, sf_dir):
    """Correlation of the height with the deviation of its eight neighbours."""
    x = R.with_neighbours(R.emb_cells(spark, sf_dir)).withColumn("sd", F.expr(f"sqrt(greatest(({_SQ8}) / 8 - power(({_SUM8}) / 8, 2), 0D))")).where("sd IS NOT NULL")
    return x.groupBy("tile_id").agg(F.count("*").alias("k"), rnd(F.coalesce(F.corr("z", "sd"), F.lit(0.0))).alias("r")).where("k >= 100").drop("k")


LAGS = range(2, 9)


def increments(spark, sf_dir: str) -> DataFrame:
    """(tile_id, lag, d): differences along rows and columns at all lags, in one pass."""
    cells = R.emb_cells(spark, sf_dir)
    along = lambda w: F.array(*[F.struct(F.lit(h).alias("lag"), (F.lead("z", h).over(w) - F.col("z")).alias("d")) for h in LAGS])
    return cells.select("tile_id", F.concat(along(R.ROW), along(R.COL)).alias("x")).select("tile_id", F.explode("x").alias("x")).select("tile_id", "x.lag", "x.d").where("d IS NOT NULL")


_INC = "inc AS (SELECT tile_id, lag, d FROM (" + " UNION ALL ".join(f"SELECT tile_id, {h} AS lag, lead(z, {h}) OVER (PARTITION BY tile_id, {k} ORDER BY {o}) - z AS d FROM cells" for h in LAGS for k, o in (("r", "c"), ("c", "r"))) + ") WHERE d IS NOT NULL)"


@query("variogram", q(CELLS, _INC, select="SELECT tile_id, lag, round(avg(d * d), 6) AS gamma, count(*) AS pairs FROM inc GROUP BY ALL"))
def variogram(spark, sf_dir):
    return increments(spark, sf_dir).groupBy("tile_id", "lag").agg(rnd(F.avg(F.col("d") * F.col("d"))).alias("gamma"), F.count("*").alias("pairs"))


@query("hurst_pooled", q(CELLS, _INC, "g AS (SELECT tile_id, lag, avg(d * d) AS g FROM inc GROUP BY ALL)", select="SELECT tile_id, round(regr_slope(ln(g), ln(lag)) / 2, 6) AS hurst, round(regr_r2(ln(g), ln(lag)), 6) AS r2 FROM g GROUP BY 1 HAVING max(g) >= 1e-6"))
def hurst_pooled(spark, sf_dir):
    """Hurst exponent of the pooled structure function."""
    g = increments(spark, sf_dir).groupBy("tile_id", "lag").agg(F.avg(F.col("d") * F.col("d")).alias("g"))
    return g.groupBy("tile_id").agg(F.max("g").alias("m"), rnd(F.regr_slope(F.log("g"), F.log("lag")) / 2).alias("hurst"), rnd(F.regr_r2(F.log("g"), F.log("lag"))).alias("r2")).where("m >= 1e-6").drop("m")


@query("hurst_profile", q(CELLS, "p AS (SELECT tile_id, 'r' || r AS p, c AS x, z FROM cells WHERE r % 16 = 0 UNION ALL SELECT tile_id, 'c' || c, r, z FROM cells WHERE c % 16 = 0)", "d AS (" + " UNION ALL ".join(f"SELECT tile_id, p, {h} AS lag, lead(z, {h}) OVER (PARTITION BY tile_id, p ORDER BY x) - z AS d FROM p" for h in LAGS) + ")", "g AS (SELECT tile_id, p, lag, avg(d * d) AS g FROM d WHERE d IS NOT NULL GROUP BY ALL HAVING g > 0)", "h AS (SELECT tile_id, least(regr_slope(ln(g), ln(lag)) / 2, 1) AS h FROM g GROUP BY tile_id, p HAVING count(*) >= 4)", select="SELECT tile_id, round(avg(h), 6) AS hurst FROM h GROUP BY 1"))
def hurst_profile(spark, sf_dir):
    """Mean Hurst exponent of every 16th row and column."""
    cells = R.emb_cells(spark, sf_dir)
    w = Window.partitionBy("tile_id", "p").orderBy("x")
    p = cells.where("r % 16 = 0").select("tile_id", F.concat(F.lit("r"), "r").alias("p"), F.col("c").alias("x"), "z").unionByName(cells.where("c % 16 = 0").select("tile_id", F.concat(F.lit("c"), "c").alias("p"), F.col("r").alias("x"), "z"))
    d = p.select("tile_id", "p", F.array(*[F.struct(F.lit(h).alias("lag"), (F.lead("z", h).over(w) - F.col("z")).alias("d")) for h in LAGS]).alias("y")).select("tile_id", "p", F.explode("y").alias("y")).select("tile_id", "p", "y.lag", "y.d").where("d IS NOT NULL")
    g = d.groupBy("tile_id", "p", "lag").agg(F.avg(F.col("d") * F.col("d")).alias("g")).where("g > 0")
    h = g.groupBy("tile_id", "p").agg(F.count("*").alias("k"), F.least(F.regr_slope(F.log("g"), F.log("lag")) / 2, F.lit(1.0)).alias("h")).where("k >= 4")
    return h.groupBy("tile_id").agg(rnd(F.avg("h")).alias("hurst"))


_Q = (-2, -1, 1, 2)


@query("multifractal_width", q(CELLS, _INC, "m AS (SELECT tile_id, q, lag, avg(power(abs(d), q)) FILTER (q > 0 OR abs(d) >= 1e-6) AS s, count(*) FILTER (q > 0 OR abs(d) >= 1e-6) AS k, count(*) AS n FROM inc, (VALUES (-2), (-1), (1), (2)) AS v(q) GROUP BY ALL HAVING k >= 10 AND k >= 0.1 * n)", "h AS (SELECT tile_id, q, regr_slope(ln(s), ln(lag)) / q AS h FROM m GROUP BY tile_id, q)", select="SELECT tile_id, round(max(h) FILTER (q = -2) - max(h) FILTER (q = 2), 6) AS width FROM h GROUP BY 1"))
def multifractal_width(spark, sf_dir):
    """H(-2) - H(2) of the generalised structure functions."""
    x = increments(spark, sf_dir).withColumn("q", F.explode(F.array(*[F.lit(v) for v in _Q])))
    ok = (F.col("q") > 0) | (F.abs("d") >= 1e-6)
    m = x.groupBy("tile_id", "q", "lag").agg(F.avg(F.when(ok, F.pow(F.abs("d"), F.col("q").cast("double")))).alias("s"), F.count(F.when(ok, 1)).alias("k"), F.count("*").alias("n")).where("k >= 10 AND k >= 0.1 * n")
    h = m.groupBy("tile_id", "q").agg((F.regr_slope(F.log("s"), F.log("lag")) / F.first("q")).alias("h"))
    return h.groupBy("tile_id").agg(rnd(F.max(F.when(F.col("q") == -2, F.col("h"))) - F.max(F.when(F.col("q") == 2, F.col("h")))).alias("width"))


_SCALES = (8, 16, 32)


@query("mfdfa_width", q(CELLS, "p AS (SELECT tile_id, c, z, s, c // s AS g FROM cells, (VALUES (8), (16), (32)) AS v(s) WHERE r = 32)", "f AS (SELECT tile_id, s, g, sqrt(greatest(regr_syy(z, c) - regr_sxy(z, c) * regr_sxy(z, c) / regr_sxx(z, c), 0) / count(*)) AS f FROM p GROUP BY tile_id, s, g)", "m AS (SELECT tile_id, s, q, power(avg(power(f, q)), 1.0 / q) AS m FROM f, (VALUES (-4), (-2), (2), (4)) AS v(q) WHERE f > 1e-9 GROUP BY tile_id, s, q)", "h AS (SELECT tile_id, q, regr_slope(ln(m), ln(s)) AS h FROM m GROUP BY ALL)", select="SELECT tile_id, round(max(h) - min(h), 6) AS width FROM h GROUP BY 1"))
def mfdfa_width(spark, sf_dir):
    """Width of the slopes of detrended fluctuations of the middle row."""
    p = R.emb_cells(spark, sf_dir).where("r = 32").withColumn("s", F.explode(F.array(*[F.lit(s) for s in _SCALES]))).withColumn("g", F.floor(F.col("c") / F.col("s")))
    rest = F.regr_syy("z", "c") - F.regr_sxy("z", "c") * F.regr_sxy("z", "c") / F.regr_sxx("z", "c")
    f = p.groupBy("tile_id", "s", "g").agg(F.sqrt(F.greatest(rest, F.lit(0.0)) / F.count("*")).alias("f")).where("f > 1e-9")
    qs = f.withColumn("q", F.explode(F.array(*[F.lit(v) for v in (-4, -2, 2, 4)])))
    m = qs.groupBy("tile_id", "s", "q").agg(F.avg(F.pow("f", F.col("q").cast("double"))).alias("a")).withColumn("m", F.pow("a", 1.0 / F.col("q")))
    h = m.groupBy("tile_id", "q").agg(F.regr_slope(F.log("m"), F.log("s")).alias("h"))
    return h.groupBy("tile_id").agg(rnd(F.max("h") - F.min("h")).alias("width"))


def _square_tpi(size: int) -> str:
    k = size // 2
    return f"SELECT tile_id, {size} AS size, z - (s - z) / (n - 1) AS t FROM (SELECT tile_id, z, sum(rs) OVER w AS s, sum(rn) OVER w AS n FROM (SELECT *, sum(z) OVER v AS rs, count(z) OVER v AS rn FROM cells WINDOW v AS (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)) WINDOW w AS (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))"


@query("tpi_square", q(CELLS, "t AS (" + " UNION ALL ".join(_square_tpi(s) for s in (3, 7, 15, 31)) + ")", select="SELECT tile_id, size, round(stddev_pop(t), 6) AS tpi_std FROM t GROUP BY ALL"))
def tpi_square(spark, sf_dir):
    """Deviation of the height's difference from the mean of squares of four sizes."""
    x = R.emb_cells(spark, sf_dir)
    for s in (3, 7, 15, 31):
        x = R.box_sums(x, s // 2).withColumn(f"t{s}", F.col("z") - (F.col("_sum") - F.col("z")) / (F.col("_n") - 1)).drop("_sum", "_n")
    sd = x.groupBy("tile_id").agg(*[F.stddev_pop(f"t{s}").alias(f"t{s}") for s in (3, 7, 15, 31)])
    return sd.select("tile_id", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), rnd(F.col(f"t{s}")).alias("tpi_std")) for s in (3, 7, 15, 31)])).alias("x")).select("tile_id", "x.*")


def _disc(radius: int) -> list[tuple[int, int]]:
    return [(dr, math.isqrt(radius * radius - dr * dr)) for dr in range(-radius, radius + 1)]


def _disc_sql(radius: int, stride: int) -> str:
    total = " + ".join(f"{'lag' if dr < 0 else 'lead'}(h{half}, {abs(dr)}) OVER w" if dr else f"h{half}" for dr, half in _disc(radius))
    count = sum(2 * half + 1 for _, half in _disc(radius))
    halves = sorted({half for _, half in _disc(radius)})
    sums = ", ".join(f"sum(z) OVER (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS h{k}" for k in halves)
    return f"SELECT tile_id, {radius} AS radius, z - m AS t FROM (SELECT tile_id, r, c, z, ({total}) / {count}.0 AS m FROM (SELECT *, {sums} FROM cells) WINDOW w AS (PARTITION BY tile_id, c ORDER BY r)) WHERE r BETWEEN {radius} AND {63 - radius} AND c BETWEEN {radius} AND {63 - radius} AND (r - {radius}) % {stride} = 0 AND (c - {radius}) % {stride} = 0"


@query("tpi_disc", q(CELLS, "t AS (" + " UNION ALL ".join(_disc_sql(a, b) for a, b in ((5, 1), (10, 4), (20, 4))) + ")", select="SELECT tile_id, radius, round(stddev_pop(t), 6) AS tpi_std FROM t GROUP BY ALL"))
def tpi_disc(spark, sf_dir):
    """Deviation of the height's difference from the mean of discs; row sums of each half-width, then row offsets."""
    out = None
    cells = R.emb_cells(spark, sf_dir)
    for radius, stride in ((5, 1), (10, 4), (20, 4)):
        x = cells
        for k in sorted({half for _, half in _disc(radius)}):
            x = x.withColumn(f"h{k}", F.sum("z").over(R.ROW.rowsBetween(-k, k)))
        total = None
        for dr, half in _disc(radius):
            v = F.col(f"h{half}") if dr == 0 else F.lag(f"h{half}", -dr).over(R.COL) if dr < 0 else F.lead(f"h{half}", dr).over(R.COL)
            total = v if total is None else total + v
        n = sum(2 * half + 1 for _, half in _disc(radius))
        inside = F.col("r").between(radius, 63 - radius) & F.col("c").between(radius, 63 - radius) & ((F.col("r") - radius) % stride == 0) & ((F.col("c") - radius) % stride == 0)
        t = x.select("tile_id", "r", "c", (F.col("z") - total / n).alias("t")).where(inside).groupBy("tile_id").agg(F.lit(radius).alias("radius"), rnd(F.stddev_pop("t")).alias("tpi_std"))
        out = t if out is None else out.unionByName(t)
    return out


@query("tpi_ratios", q(f"t AS ({registered('tpi_disc')})", "p AS (SELECT tile_id, max(tpi_std) FILTER (radius = 5) AS a, max(tpi_std) FILTER (radius = 10) AS b, max(tpi_std) FILTER (radius = 20) AS c FROM t GROUP BY 1)", select="SELECT tile_id, round(a / nullif(b, 0), 5) AS r1_r2, round(b / nullif(c, 0), 5) AS r2_r3, coalesce(abs(a / nullif(b, 0) - b / nullif(c, 0)) > 0.1, false) AS scale_dependent FROM p"))
def tpi_ratios(spark, sf_dir):
    """Ratios of the deviations at neighbouring radii, and whether they differ by scale."""
    at = lambda r: F.max(F.when(F.col("radius") == r, F.col("tpi_std")))
    p = tpi_disc(spark, sf_dir).groupBy("tile_id").agg(at(5).alias("a"), at(10).alias("b"), at(20).alias("c"))
    x, y = F.col("a") / F.nullif("b", F.lit(0.0)), F.col("b") / F.nullif("c", F.lit(0.0))
    return p.select("tile_id", rnd(x, 5).alias("r1_r2"), rnd(y, 5).alias("r2_r3"), F.coalesce(F.abs(x - y) > 0.1, F.lit(False)).alias("scale_dependent"))


@query("hypsometric_integral", q(CELLS, select="SELECT tile_id, round(CASE WHEN max(z) - min(z) < 1 THEN 0.0 ELSE (avg(z) - min(z)) / (max(z) - min(z)) END, 6) AS hi, round(max(z) - min(z), 6) AS relief FROM cells GROUP BY 1"))
def hypsometric_integral(spark, sf_dir):
    low, high = F.min("z"), F.max("z")
    return R.emb_cells(spark, sf_dir).groupBy("tile_id").agg(rnd(F.when(high - low < 1, 0.0).otherwise((F.avg("z") - low) / F.nullif(high - low, F.lit(0.0)))).alias("hi"), rnd(high - low).alias("relief"))


@query("hypsometric_cdf", q(CELLS, "s AS (SELECT tile_id, list_sort(list(z)) AS a FROM cells GROUP BY 1)", select="SELECT tile_id, i AS step, round(a[CAST(floor(i * len(a) / 100.0) AS INT) + 1], 6) AS z FROM s, unnest(range(0, 100)) AS t(i)"))
def hypsometric_cdf(spark, sf_dir):
    """100 steps of the sorted heights of each tile; a tile is the unit, so its cells are sorted together."""
    ranked = R.emb_cells(spark, sf_dir).withColumn("k", F.row_number().over(R.TILE.orderBy("z", "r", "c")) - 1).withColumn("n", F.count("*").over(R.TILE))
    steps = F.expr("filter(sequence(0, 99), i -> floor(i * n / 100.0) = k)")
    return ranked.select("tile_id", F.explode(steps).alias("step"), rnd(F.col("z")).alias("z")).select("tile_id", F.col("step").cast("long").alias("step"), "z")


@query("hypsometric_shaping", q(CELLS, "p AS (SELECT tile_id, r, c, z, (row_number() OVER (PARTITION BY tile_id ORDER BY z, r, c) - 1) / 4095.0 AS p FROM cells)", select="SELECT tile_id, r, c, round(power(p, 1 / 0.35 - 1), 6) AS shaped FROM p"))
def hypsometric_shaping(spark, sf_dir):
    """Ranks raised so that the hypsometric integral becomes 0.35."""
    p = (F.row_number().over(R.TILE.orderBy("z", "r", "c")) - 1) / (R.SIDE * R.SIDE - 1)
    return R.emb_cells(spark, sf_dir).select("tile_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), rnd(F.pow(p, F.lit(1 / 0.35 - 1))).alias("shaped"))


#: The landform of (positive, negative) directions, first match wins; codes 1 to 10 as in the landform rasters.
GEOMORPHON_RULES = (("p = 0 AND m = 0", 1), ("p = 8 OR (p = 7 AND m = 0)", 10), ("m = 8 OR (p = 0 AND m = 7)", 2), ("m = 0 AND p >= 6", 9), ("p = 0 AND m >= 6", 3), ("m <= 1 AND p >= 4", 8), ("p <= 1 AND m >= 4", 4), ("p > m", 7), ("m > p", 5))
_CLASS = "CASE " + " ".join(f"WHEN {w} THEN {k}" for w, k in GEOMORPHON_RULES) + " ELSE 6 END"
_FLAT, _REACH = 1.0, 3


def ternary(spark, sf_dir: str) -> DataFrame:
    """cells with t0..t7: +1 if the horizon rises over the flat threshold, else -1 if it falls below, by direction from north clockwise."""
    offsets = [(dr * k, dc * k) for _, dr, dc in R.D8 for k in range(1, _REACH + 1)]
    x = R.shifted(R.emb_cells(spark, sf_dir), offsets)
    for d, (_, dr, dc) in enumerate(R.D8):
        unit = R.CELL * math.hypot(dr, dc)
        angles = [F.degrees(F.atan((F.col(f"v{d * _REACH + k - 1}") - F.col("z")) / (unit * k))) for k in range(1, _REACH + 1)]
        x = x.withColumn(f"t{d}", F.when(F.greatest(*angles) > _FLAT, 1).when(F.least(*angles) < -_FLAT, -1).otherwise(0))
    inside = F.col("r").between(_REACH, R.SIDE - 1 - _REACH) & F.col("c").between(_REACH, R.SIDE - 1 - _REACH)
    return x.where(inside).select("tile_id", "r", "c", *[f"t{d}" for d in range(8)])


def _ternary_sql() -> str:
    cols = {-3, -2, -1, 0, 1, 2, 3}
    row = ", ".join(f"{'lead' if k > 0 else 'lag'}(z, {abs(k)}) OVER v AS x{k + 3}" if k else "z AS x3" for k in sorted(cols))
    shift = lambda dr, dc: f"x{dc + 3}" if dr == 0 else f"{'lead' if dr > 0 else 'lag'}(x{dc + 3}, {abs(dr)}) OVER w"
    parts = []
    for d, (_, dr, dc) in enumerate(R.D8):
        a = [f"degrees(atan(({shift(dr * k, dc * k)} - z) / {R.CELL * math.hypot(dr, dc) * k!r}))" for k in (1, 2, 3)]
        parts.append(f"CASE WHEN greatest({', '.join(a)}) > 1 THEN 1 WHEN least({', '.join(a)}) < -1 THEN -1 ELSE 0 END AS t{d}")
    return f"tern AS (SELECT * FROM (SELECT tile_id, r, c, {', '.join(parts)} FROM (SELECT *, {row} FROM cells WINDOW v AS (PARTITION BY tile_id, r ORDER BY c)) WINDOW w AS (PARTITION BY tile_id, c ORDER BY r)) WHERE r BETWEEN 3 AND 60 AND c BETWEEN 3 AND 60)"


_PM = "pm AS (SELECT *, " + " + ".join(f"(t{d} = 1)::INT" for d in range(8)) + " AS p, " + " + ".join(f"(t{d} = -1)::INT" for d in range(8)) + " AS m FROM tern)"


def landforms(spark, sf_dir: str) -> DataFrame:
    t = ternary(spark, sf_dir)
    ones = lambda v: sum((F.when(F.col(f"t{d}") == v, 1).otherwise(0) for d in range(8)), F.lit(0))
    return t.withColumn("p", ones(1)).withColumn("m", ones(-1)).withColumn("landform", F.expr(_CLASS))


@query("geomorphon_hist", q(CELLS, _ternary_sql(), _PM, f"k AS (SELECT tile_id, {_CLASS} AS landform, count(*) AS n FROM pm GROUP BY ALL)", select="SELECT tile_id, landform, round(n / CAST(sum(n) OVER (PARTITION BY tile_id) AS DOUBLE), 6) AS share FROM k"))
def geomorphon_hist(spark, sf_dir):
    n = landforms(spark, sf_dir).groupBy("tile_id", "landform").agg(F.count("*").alias("n"))
    return n.select("tile_id", "landform", rnd(F.col("n") / F.sum("n").over(R.TILE)).alias("share"))


@query("geomorphon_canonical", q(CELLS, _ternary_sql(), "k AS (SELECT tile_id, least(" + ", ".join(" + ".join(f"(t{(d + k) % 8} + 1) * {3 ** (7 - d)}" for d in range(8)) for k in range(8)) + ") AS code FROM tern)", select="SELECT tile_id, code, count(*) AS n FROM k GROUP BY ALL"))
def geomorphon_canonical(spark, sf_dir):
    """Pattern codes that are least under rotation."""
    codes = [sum(((F.col(f"t{(d + k) % 8}") + 1) * 3 ** (7 - d) for d in range(8)), F.lit(0)) for k in range(8)]
    return ternary(spark, sf_dir).groupBy("tile_id", F.least(*codes).alias("code")).agg(F.count("*").alias("n"))


_BLOCKS = "b AS (SELECT tile_id, r // 8 AS br, c // 8 AS bc, (avg(z) - min(z)) / nullif(max(z) - min(z), 0) AS hi FROM cells GROUP BY ALL HAVING max(z) - min(z) >= 1), d AS (SELECT *, hi - avg(hi) OVER (PARTITION BY tile_id) AS x FROM b)"


@query("morans_i_blocks", q(CELLS, _BLOCKS, "p AS (SELECT a.tile_id, count(*) AS w, sum(a.x * b.x) AS s FROM d a JOIN d b ON a.tile_id = b.tile_id AND greatest(abs(a.br - b.br), abs(a.bc - b.bc)) = 1 GROUP BY 1)", "v AS (SELECT tile_id, count(*) AS n, sum(x * x) AS v FROM d GROUP BY 1)", select="SELECT tile_id, round(n / CAST(w AS DOUBLE) * s / v, 6) AS i FROM p JOIN v USING (tile_id) WHERE n >= 4 AND v > 1e-12"))
def morans_i_blocks(spark, sf_dir):
    """Moran's I of the hypsometric integrals of 8x8 blocks with queen contiguity; neighbours by equal keys after an offset."""
    low, high = F.min("z"), F.max("z")
    b = R.emb_cells(spark, sf_dir).groupBy("tile_id", F.floor(F.col("r") / 8).alias("br"), F.floor(F.col("c") / 8).alias("bc")).agg((high - low).alias("range"), ((F.avg("z") - low) / F.nullif(high - low, F.lit(0.0))).alias("hi")).where("range >= 1")
    d = b.withColumn("x", F.col("hi") - F.avg("hi").over(R.TILE)).select("tile_id", "br", "bc", "x")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(o).alias("dc")) for _, a, o in R.D8]))
    near = d.select("tile_id", "br", "bc", F.col("x").alias("y"), steps.alias("o")).select("tile_id", (F.col("br") + F.col("o.dr")).alias("br"), (F.col("bc") + F.col("o.dc")).alias("bc"), "y")
    p = d.join(near, ["tile_id", "br", "bc"]).groupBy("tile_id").agg(F.count("*").alias("w"), F.sum(F.col("x") * F.col("y")).alias("s"))
    v = d.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("v"))
    return p.join(v, "tile_id").where("n >= 4 AND v > 1e-12").select("tile_id", rnd(F.col("n") / F.col("w") * F.col("s") / F.col("v")).alias("i"))


@query("local_detrend", q(CELLS, "b AS (SELECT tile_id, r, c, z, sum(rs) OVER w / sum(rn) OVER w AS m FROM (SELECT *, sum(z) OVER v AS rs, count(z) OVER v AS rn FROM cells WINDOW v AS (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING)) WINDOW w AS (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING))", select="SELECT tile_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(z - m, 4) AS residual FROM b"))
def local_detrend(spark, sf_dir):
    """Heights less the mean of a box of a third of the tile."""
    return R.box_sums(R.emb_cells(spark, sf_dir), R.SIDE // 3).select("tile_id", "r", "c", rnd(F.col("z") - F.col("_sum") / F.col("_n"), 4).alias("residual"))


def _gauss(radius: int, sigma: float = 1.5) -> list[tuple[int, float]]:
    w = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return [(d, x / sum(w)) for d, x in zip(range(-radius, radius + 1), w, strict=True)]


_G = _gauss(5)
_GROW = " + ".join(f"{w!r} * list_z[least(greatest(c + {d}, 0), 63) + 1]" for d, w in _G)
_GCOL = " + ".join(f"{w!r} * list_y[least(greatest(r + {d}, 0), 63) + 1]" for d, w in _G)


@query("gaussian_blur", q(CELLS, "x AS (SELECT *, list(z) OVER (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS list_z FROM cells)", f"y AS (SELECT tile_id, r, c, {_GROW} AS y FROM x)", "v AS (SELECT *, list(y) OVER (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS list_y FROM y)", select=f"SELECT tile_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round({_GCOL}, 4) AS z FROM v"))
def gaussian_blur(spark, sf_dir):
    """Separable blur (sigma 1.5, edges repeated): each line is an array, blurred in place, transposed by one aggregation a pass."""
    def blurred(lines: DataFrame, key: str, along: str) -> DataFrame:
        rows = lines.groupBy("tile_id", key).agg(F.transform(F.array_sort(F.collect_list(F.struct(along, "z"))), lambda x: x["z"]).alias("v"))
        at = lambda i, d: F.element_at("v", F.least(F.greatest(i + d, F.lit(0)), F.size("v") - 1) + 1)
        out = F.transform("v", lambda _, i: sum((at(i, d) * w for d, w in _G), F.lit(0.0)))
        return rows.select("tile_id", key, F.posexplode(out).alias(along, "z"))

    done = blurred(blurred(R.emb_cells(spark, sf_dir), "r", "c"), "c", "r")
    return done.select("tile_id", "r", "c", rnd(F.col("z"), 4).alias("z"))
