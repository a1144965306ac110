"""Exact Jaccard self-join of large sets: prefix groups, signature trees, components.

Two sets that are similar enough share one of their first hashes in any fixed
order (prefix filter).  The order puts frequent hashes last, so groups of sets
with a common prefix hash stay small; which are frequent only steers the order,
never the result.  Work goes in two steps:

1. neighbours by size within each group are compared; their components already
   hold many of each family of copies;
2. within groups that still have several components, signature trees find the
   pairs of different components that may be similar.  In the first rounds each
   set takes the likeliest partner of every group alone, which joins families
   at few comparisons; the last round takes all pairs, so that no link between
   components is lost.

Groups are never gathered: rows are dealt out by ranges of (hash, size, set), so
a large group lies in many partitions, and is worked in blocks of bounded size;
a pair of blocks is formed only where their sizes can fit.  A pair whose
signatures cannot overlap enough falls before any set is loaded; what is left is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected as components
from . import shared, sigtree
from . import textkit as T

#: Sets in a block of a large group; hashes kept as frequent at most (2**17 longs are broadcast); where a hash counts as frequent; rounds of the search, all but the last of likeliest partners.
BLOCK, FREQUENT, FREQUENT_FROM, ROUNDS = 512, 1 << 17, 12, 3
#: Bytes of text in which a hash has to occur twice to be counted.
COUNTED = 8 << 20
#: Rows of groups with the same least set that are searched in one place; more are split.
FAMILY = 1 << 17


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (-(-percent * n // 100)) + 1, 0)


def frequent_hashes(docs: DataFrame, sets: Callable) -> np.ndarray:
    """The most frequent hashes of the corpus, by lossy counting: batches send what occurs in them twice or more."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate([sets(p.column(0))[0] for p in shared.pieces(b)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    sums = shared.arrow_map(docs, count, "h long, n long", COUNTED).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    return np.sort(np.array([r["h"] for r in shared.most_counted(sums, FREQUENT).select("h").collect()], np.int64).view(np.uint64))


def node_of(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A hash of each set, from its hashes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h), dtype=np.uint64)])
    return T.mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64))


def describe(column: pa.Array, sets: Callable, frequent: np.ndarray, percent: int) -> list[pa.Array]:
    """node, n, prefix (hashes in order) and signature of each row."""
    h, offs = sets(column)
    n, rows = np.diff(offs), len(offs) - 1
    row = np.repeat(np.arange(rows), n)
    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), bool)
    order = np.argsort(2 * row + late, kind="stable")  # hashes are in order within a row
    place = np.arange(len(h)) - np.repeat(offs[:-1], n)
    size = prefix_length(n, percent)
    kept = h[order][place < np.repeat(size, n)]
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return [pa.array(node_of(h, offs).view(np.int64)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(kept.view(np.int64))), pa.array(sigtree.signatures(h, offs), pa.binary())]


def _runs(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of these columns; the first always does."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in names:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def neighbours(rows: DataFrame) -> DataFrame:
    """rows (key, node, n, ...) of keys that other sets have too, each once, with near and near_n: the row before it, by size, in its group.

    Rows are dealt out by ranges of (key, n, node) and looked at in order, so no
    task holds a group.  At the ends of a partition single rows are kept, as the
    rest of their group may be next door.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spread = rows.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node")

    def run(batches):
        held, first = None, True
        for whole in batches:
            for b in shared.pieces(whole):
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                same = ~_runs(t, ["key", "node"])
                t = t.filter(pa.array(~same)) if same.any() else t  # a set that several tasks have sent
                # held: the last row, whose next is not known yet, and the one before it
                skip = 1 if held is not None and held.num_rows == 2 else 0
                if t.num_rows > skip + 1:
                    yield from given(t, skip, t.num_rows - 1, first, False)
                    first = False
                held = t.slice(max(0, t.num_rows - 2))
                if t.num_rows <= skip + 1 and skip == 0:
                    held = t
        if held is not None:
            skip = 0 if first and held.num_rows == 1 else held.num_rows - 1
            yield from given(held, skip, held.num_rows, first, True)

    def given(t: pa.Table, a: int, z: int, first: bool, last: bool):
        new = _runs(t, ["key"])
        after = np.append(~new[1:], last)  # the next row has the same key; the end of a partition counts as if
        keep = ~new | after
        if first:
            keep[0] = True
        near, near_n = np.roll(t.column("node").to_numpy(), 1), np.roll(t.column("n").to_numpy(), 1)
        t = t.append_column("near", pa.array(near, mask=new)).append_column("near_n", pa.array(near_n, mask=new))
        keep[:a] = keep[z:] = False
        out = t.filter(pa.array(keep)).combine_chunks()
        yield from out.to_batches()

    return shared.batched(spread, run, f"{fields}, near long, near_n long")


def grouped(nodes: DataFrame, percent: int) -> DataFrame:
    """Stored table (key, node, n, index, near, near_n): prefix hashes that several sets have, one of which is there in its index prefix; near is the neighbour by size."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    # of a similar pair, the smaller set has the first common hash among these
    index = F.col("pos") < F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    return shared.stored(neighbours(rows.select("key", "node", "n", index.alias("index"))), "prefix-groups")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of sets whose signatures may overlap enough."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("s_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("s_b"))

    def keep(t: pa.RecordBatch) -> pa.RecordBatch:
        n = [t.column(i).to_numpy() for i in (2, 4)]
        most = sigtree.overlaps(*n, t.column(3), t.column(5))
        return t.select(["a", "b"]).filter(pa.array(most >= sigtree.need(*n, percent)))

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return shared.arrow_map(joined, keep, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, load: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Stored table (a, b) of those pairs whose whole sets are similar."""
    pairs = shared.stored(likely(pairs, nodes, percent), "candidates")
    wanted = shared.stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    sets = shared.stored(load(wanted), "sets")
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def compare(t: pa.RecordBatch) -> pa.RecordBatch:
        x, xo = T.buffers(t.column(2))
        y, yo = T.buffers(t.column(3))
        x, y, xo, yo = x.view(np.uint64), y.view(np.uint64), xo // 8, yo // 8
        rows = len(xo) - 1
        h = np.concatenate([x, y])
        r = np.concatenate([np.repeat(np.arange(rows), np.diff(xo)), np.repeat(np.arange(rows), np.diff(yo))])
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=rows)
        union = np.diff(xo) + np.diff(yo) - both
        keep = 100 * both >= percent * union
        return t.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "x", "y")
    links = shared.stored(shared.arrow_map(joined, compare, "a long, b long"), "links")
    shared.drop(sets, wanted, pairs)
    return links


def first_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """At most two pairs (a, b) for each set: with the neighbours, by size, that it meets in most groups."""
    fit = (F.col("near") != F.col("node")) & (100 * F.col("near_n") >= percent * F.col("n"))
    met = groups.where(fit).groupBy(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).agg(F.count("*").alias("c")).where("c > 1")
    met = shared.stored(met, "neighbours")
    best = [met.groupBy(k).agg(F.max(F.struct("c", o)).alias("m")).select(F.col(k), F.col(f"m.{o}").alias(o)).select("a", "b") for k, o in (("a", "b"), ("b", "a"))]
    return best[0].unionByName(best[1]).distinct()


def distinct_groups(groups: DataFrame) -> DataFrame:
    """Stored rows (key, node, n) of one of all groups that have the same sets, if one of those has a set in its index prefix.

    A passage or a family of copies makes one group for each of its hashes; two
    hashes of the members tell that they are the same.
    """
    h = F.xxhash64("node", F.lit(1))
    known = groups.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(h, 24)).alias("y"), F.count("*").alias("c"), F.max("index").alias("i"))
    kept = known.where("c > 1").groupBy("x", "y", "c").agg(F.min("key").alias("key"), F.max("i").alias("i")).where("i").select("key")
    return shared.stored(groups.select("key", "node", "n").join(kept, "key"), "distinct-groups")


def mixed_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored rows (key, node, n, label, minor, block) of groups with several labels; minor is false for the label that most rows of a large group have."""
    labels = labels.select(F.col("node").alias("_n"), "label")
    rows = groups.join(shared.small(labels), groups["node"] == F.col("_n"), "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    major = each.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all")).where(F.col("m.c") < F.col("all"))
    minor = (F.col("label") != F.col("m.label")) | (F.col("all") <= BLOCK)
    return shared.stored(blocks(rows.join(major, "key").select("key", "node", "n", "label", minor.alias("minor"))), "mixed-groups")


def blocks(rows: DataFrame) -> DataFrame:
    """rows (key, minor, n, node, ...) with block: runs of at most BLOCK rows of one group and side, by size; dealt out by ranges, so that no task holds a group."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spread = rows.repartitionByRange("key", "minor", "n", "node").sortWithinPartitions("key", "minor", "n", "node")
    most = BLOCK

    def run(batches):
        part, last, count, block = TaskContext.get().partitionId() << 33, None, 0, -1
        for whole in batches:
            for b in shared.pieces(whole):
                key, minor = b.column("key").to_numpy(), b.column("minor").to_numpy(zero_copy_only=False)
                out = np.empty(len(key), np.int64)
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (minor[1:] != minor[:-1])
                starts = np.flatnonzero(new)
                for a, z in zip(starts, np.append(starts[1:], len(key)), strict=True):
                    if last != (key[a], minor[a]):
                        last, count, block = (key[a], minor[a]), 0, block + 1
                    steps = (count + np.arange(z - a)) // most
                    out[a:z] = block + steps
                    block, count = int(out[z - 1]), (count + int(z - a) - 1) % most + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out + part)], [*b.schema.names, "block"])

    return shared.batched(spread, run, f"{fields}, block long")


def rest_pairs(rows: DataFrame, nodes: DataFrame, percent: int, best: bool, whole: bool = False) -> DataFrame:
    """Pairs (a, b) of sets with different labels that share a group of rows and that the signature trees leave over.

    best: of each set and group one alone.  whole: nodes have their hashes, which
    are small; pairs are verified at once, and links that join the same sets are
    given as a star, so that a group gives no more rows than it has.
    """
    # the label with the most rows of a group meets the others only; a block is met by those whose sizes fit
    sides = rows.groupBy("key", "minor", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("node").alias("least"), F.count("*").alias("size"))
    o = sides.select("key", *[F.col(c).alias(f"o_{c}") for c in ("minor", "block", "lo", "hi", "least", "size")])
    fits = (100 * F.col("hi") >= percent * F.col("o_lo")) & (100 * F.col("o_hi") >= percent * F.col("lo")) & (F.col("minor") | F.col("o_minor"))
    met = sides.join(o, "key").where(fits & (F.col("block") <= F.col("o_block"))).select("key", F.col("block").alias("x"), F.col("o_block").alias("y"), F.least("least", "o_least").alias("near"), (F.col("size") + F.col("o_size")).alias("size"))
    met = dealt(met.withColumn("task", F.xxhash64("key", "x", "y")))
    ends = met.select("task", "near", F.col("x").alias("block")).unionByName(met.where("x <> y").select("task", "near", F.col("y").alias("block")))
    held = nodes.select("node", F.col("hashes" if whole else "sig").alias("held"))
    spread = rows.join(ends, "block").join(held, "node")
    # groups of one family mostly have their least set in common: they come together, and a pair that several of them give goes once
    spread = spread.select("task", "near", "node", "n", "label", "held").repartition("near").sortWithinPartitions("task").drop("near")

    def search(t: pa.RecordBatch) -> pa.RecordBatch | None:
        task, node, n, label = (t.column(c).to_numpy() for c in ("task", "node", "n", "label"))
        n = n.astype(np.int64)
        _, group = np.unique(task, return_inverse=True)
        _, lab = np.unique(label, return_inverse=True)
        if whole:
            flat, offs = T.buffers(t.column("held"))
            h, offs = flat.view(np.uint64), offs // 8
            i, j, most = sigtree.candidates(group, n, lab, sigtree.signatures(h, offs), percent)
            for k in range(0, len(i), 1 << 14):
                i[k : k + (1 << 14)], j[k : k + (1 << 14)] = _same(h, offs, i[k : k + (1 << 14)], j[k : k + (1 << 14)], percent)
            i, j = star(len(n), i, j)
        else:
            i, j, most = sigtree.candidates(group, n, lab, t.column("held").to_pylist(), percent)
        if best and len(i):
            both, other, like = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(most / (n[i] + n[j]), 2)
            order = np.lexsort((node[other], -like, both))
            first = order[np.unique(both[order], return_index=True)[1]]
            i, j = both[first], other[first]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        if not len(a):
            return None
        ab = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

    def found(batches):
        held = None
        for many in batches:
            for b in shared.pieces(many):
                t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                task = t.column("task").to_numpy()
                cut = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
                held = t.slice(cut)
                if cut and (out := search(t.slice(0, cut).combine_chunks())) is not None:
                    yield out
        if held is not None and (out := search(held.combine_chunks())) is not None:
            yield out

    def run(batches):
        kept = []
        for out in found(batches):  # a pair that several groups give goes once
            kept.append(out)
            if sum(x.num_rows for x in kept) > 1 << 16:
                kept = [once(kept)]
                if kept[0].num_rows > 1 << 15:
                    yield kept.pop()
        if kept:
            yield once(kept)

    def once(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        ab = np.unique(np.concatenate([np.stack([x.column(k).to_numpy() for k in (0, 1)], axis=1) for x in kept]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

    return shared.batched(spread, run, "a long, b long")


def dealt(met: DataFrame) -> DataFrame:
    """met (task, near, size, ...) with the near of a family of more than FAMILY rows split by task, so that no family stays in one place."""
    large = met.groupBy("near").agg(F.sum("size").alias("all")).where(F.col("all") > FAMILY).select(F.col("near").alias("_near"), F.ceil(F.col("all") / FAMILY).alias("parts"))
    split = F.when(F.col("parts").isNotNull(), F.xxhash64("near", F.pmod("task", "parts"))).otherwise(F.col("near"))
    return met.join(large, met["near"] == large["_near"], "left").withColumn("near", split).drop("_near", "parts", "size")


def _same(h: np.ndarray, offs: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of these sets that are similar; a pair that is not is given as i with itself."""
    n = np.diff(offs)
    pair = np.arange(len(i))
    of = np.concatenate([np.repeat(pair, n[i]), np.repeat(pair, n[j])])
    at = np.concatenate([i, j])
    bounds = np.cumsum(n[at]) - n[at]
    x = h[np.repeat(offs[:-1][at] - bounds, n[at]) + np.arange(len(of))]
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    both = np.bincount(of[1:][(x[1:] == x[:-1]) & (of[1:] == of[:-1])], minlength=len(i))
    return i, np.where(100 * both >= percent * (n[i] + n[j] - both), j, i)


def star(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of n places and the least that links reach from it, without those that reach none below."""
    least = np.arange(n)
    while True:
        last = least.copy()
        np.minimum.at(least, i, last[j])
        np.minimum.at(least, j, last[i])
        least = least[least]
        if (least == last).all():
            break
    at = np.flatnonzero(least != np.arange(n))
    return at, least[at]


def similar_components(nodes: DataFrame, load: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, label) of the sets that are similar to another: label is the least node of the component.

    nodes: stored table (node, n, prefix, sig) of distinct sets, node being a hash of the set; load gives (node, hashes) for a table of nodes.
    """
    return joined(grouped(nodes, percent), nodes, load, percent)


def joined(groups: DataFrame, nodes: DataFrame, load: Callable[[DataFrame], DataFrame], percent: int, whole: bool = False) -> DataFrame:
    """similar_components, from groups as grouped gives them; whole: nodes have their hashes, as those are small."""
    links = verified(first_pairs(groups, percent), nodes, load, percent)
    labels = components(links)
    every, groups = groups, distinct_groups(groups)
    shared.drop(every)
    for k in range(1 if whole else ROUNDS):
        best = not whole and k < ROUNDS - 1
        rows = mixed_groups(groups, labels)
        if whole:
            more = shared.stored(rest_pairs(rows, nodes, percent, False, True), "links")
        else:
            more = verified(_fewest(rest_pairs(rows, nodes, percent, best), best), nodes, load, percent)
        shared.drop(rows)
        if not more.isEmpty():
            links = links.unionByName(more)
            shared.drop(labels)
            labels = components(links)
    shared.drop(groups)
    return labels


def _fewest(pairs: DataFrame, best: bool) -> DataFrame:
    """In rounds of likeliest partners, of each set the pair that most groups name."""
    if not best:
        return pairs.distinct()
    named = shared.stored(pairs.groupBy("a", "b").agg(F.count("*").alias("c")), "likeliest")
    ends = named.select(F.col("a").alias("node"), "a", "b", "c").unionByName(named.select(F.col("b").alias("node"), "a", "b", "c"))
    return ends.groupBy("node").agg(F.max(F.struct("c", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
