"""Forests and graphs over cells: pointer jumping, components, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import drop, stored
from . import raster as R


def flow(cells: DataFrame, side: int = R.SIDE) -> DataFrame:
    """cells with code (0 sink, 1..8 the steepest of D8, the first of equals), id and dst (null at sinks)."""
    x = R.with_neighbours(cells)
    root2 = 2**0.5
    drops = [(F.col("z") - F.col(name)) / (root2 if dr and dc else 1.0) for name, dr, dc in R.D8]
    best = F.greatest(*drops)
    code = F.lit(0)
    for k in range(8, 0, -1):
        code = F.when(drops[k - 1] == F.col("_best"), k).otherwise(code)
    x = x.withColumn("_best", best).withColumn("code", F.when(F.col("_best") > 0, code).otherwise(0))
    step = F.create_map(*[F.lit(v) for k, (_, dr, dc) in enumerate(R.D8, 1) for v in (k, dr * side + dc)])
    return x.select("tile_id", "r", "c", "z", "code", (F.col("r") * side + F.col("c")).alias("id")).withColumn("dst", F.col("id") + F.element_at(step, F.nullif("code", F.lit(0))))


def roots_and_counts(nodes: DataFrame) -> DataFrame:
    """(tile_id, id, root, acc): the sink that each node ends in, and how many nodes, itself included, pass through it.

    Pointers double each round, and counts with them: who comes within 2**k steps.  Rounds are the logarithm of the longest path.
    """
    x = stored(nodes.select("tile_id", "id", F.col("dst").alias("jump"), F.coalesce("dst", "id").alias("root"), F.lit(1).cast("long").alias("acc")), "flow")
    while not x.where("jump IS NOT NULL").isEmpty():
        come = x.where("jump IS NOT NULL").groupBy("tile_id", F.col("jump").alias("id")).agg(F.sum("acc").alias("more"))
        ahead = x.select("tile_id", F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("next_root"))
        y = x.join(come, ["tile_id", "id"], "left").join(ahead, ["tile_id", "jump"], "left")
        x = stored(y.select("tile_id", "id", F.col("next").alias("jump"), F.coalesce("next_root", "root").alias("root"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), "flow")
    return x.select("tile_id", "id", "root", "acc")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of an edge table of longs: label is the least node that it is connected with.

    Each round ranks nodes by a hash that is drawn anew, points every node at the
    best within two steps, follows pointers once more, and contracts the edges.
    Of a path about one node in five is left after a round, whatever the order of
    its ids, and a star goes at once, so rounds are the logarithm of the nodes.
    Both steps aggregate before they shuffle; a hub's edges are the probe side of
    the join, whose large partitions Spark splits.
    """
    left = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges")
    rounds, done = [], []
    while not left.isEmpty():
        rank = lambda x, k=len(rounds): F.struct(F.xxhash64(F.lit(k), x).alias("h"), F.col(x).alias("n"))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), F.col("m")).alias("m"))
        ahead = one.select(F.col("u").alias("v"), F.col("m").alias("best"))
        two = stored(both.join(ahead, "v").groupBy("u").agg(F.min("best").alias("m")).select("u", F.least(rank("u"), F.col("m"))["n"].alias("p")), "pointers")
        point = stored(two.join(two.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "pointers")
        x = point.select("u", F.col("p").alias("x"))
        y = point.select(F.col("u").alias("v"), F.col("p").alias("y"))
        contracted = stored(left.join(x, "u").join(y, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        done += [left, two, point]
        rounds.append(point)
        left = contracted
    done.append(left)
    # the rounds shrink, so their pointers are put together from the last to the first
    roots = None
    for point in reversed(rounds):
        if roots is None:
            roots = point
        else:
            last = roots.select(F.col("u").alias("p"), F.col("p").alias("q"))
            roots = point.join(last, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    if roots is None:
        out = left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    else:
        least = roots.groupBy("p").agg(F.min("u").alias("label"))
        out = roots.join(least, "p").select(F.col("u").alias("node"), "label")
    out = stored(out, "labels")
    out._rounds = len(rounds)
    drop(*done)
    return out


def components(mask: DataFrame, diagonal: bool, side: int = R.SIDE) -> DataFrame:
    """(tile_id, id, label) of the cells (tile_id, r, c) of a mask: label is the least id of the 4- or 8-connected component."""
    area = side * side
    n = stored(mask.select("tile_id", "r", "c", (F.col("tile_id") * area + F.col("r") * side + F.col("c")).alias("node")), "mask")
    steps = [(dr, dc) for _, dr, dc in R.D8 if (dr, dc) > (0, 0) and (diagonal or not (dr and dc))]  # each pair once
    near = n.select("tile_id", F.col("node").alias("v"), F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])).alias("o")).select("tile_id", "v", "o.r", "o.c")
    edges = n.join(near, ["tile_id", "r", "c"]).select(F.col("node").alias("a"), F.col("v").alias("b"))
    labels = n.join(connected(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return labels.select("tile_id", (F.col("node") % area).alias("id"), (F.col("label") % area).alias("label"))
