"""Signature trees over groups of sets, and their dual traversal.

A set's signature is a bitmap of its hashes; sets of like size have bitmaps of
like width.  Within a group, sets are sorted by size and packed eight to a
node, nodes eight to a higher node: each holds the OR of its bitmaps, its range
of sizes, and the most hashes that any of its sets hides behind equal bits.
Two sets can share at most popcount(A & B) + hidden hashes, so a pair of nodes
falls if that, or the sizes, leave less than the least overlap of its smallest
sets.  Many groups are traversed at once, level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FANOUT = 8
#: Widths in bits; a set gets the first that is at least four times its size, the last at most: then few hashes hide.
WIDTHS = (128, 512, 2048, 8192, 32768)


def width_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(np.array(WIDTHS), 4 * n), len(WIDTHS) - 1)


def signatures(hashes: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A bitmap of each set of 64-bit hashes."""
    n = np.diff(offs)
    widths = np.array(WIDTHS)[width_class(n)]
    starts = np.concatenate([[0], np.cumsum(widths // 8)])
    bits = np.zeros(starts[-1] * 8, np.uint8)
    place = (hashes >> np.uint64(20)) % np.repeat(widths, n).astype(np.uint64)
    bits[np.repeat(starts[:-1] * 8, n) + place.astype(np.int64)] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def need(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


class Tree:
    """Levels of the sets of many groups: level 0 are the sets, sorted by group and size."""

    def __init__(self, group, n, bits, one):
        """one: label that all of a node's sets have, -1 if they differ; such pairs of nodes need no search."""
        hidden = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [{"group": group, "lo": n, "hi": n, "hidden": hidden, "bits": bits, "one": one}]
        while True:
            low = self.levels[-1]
            starts = np.flatnonzero(np.concatenate([[True], low["group"][1:] != low["group"][:-1]])) if len(low["group"]) else np.zeros(0, np.int64)
            size = np.diff(np.append(starts, len(low["group"])))
            if len(self.levels) > 1 and (size <= 1).all():
                self.roots = low["group"]
                return
            heads = np.concatenate([np.arange(a, a + s, FANOUT) for a, s in zip(starts, size, strict=True)]) if len(starts) else starts
            ends = np.minimum(heads + FANOUT, np.repeat(np.append(starts[1:], len(low["group"])), -(-size // FANOUT)))
            red = lambda f, x: f.reduceat(x, heads, axis=0)
            least, most = red(np.minimum, low["one"]), red(np.maximum, low["one"])
            self.levels.append({"group": low["group"][heads], "lo": red(np.minimum, low["lo"]), "hi": red(np.maximum, low["hi"]), "hidden": red(np.maximum, low["hidden"]), "bits": red(np.bitwise_or, low["bits"]), "one": np.where(least == most, least, -1), "first": heads, "end": ends})


def dual(x: Tree, y: Tree, percent: int, same: bool, budget: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of level-0 places of x and y in the same group that the bounds leave over; each once if the trees are the same."""
    i = np.arange(len(x.roots))
    at = np.searchsorted(y.roots, x.roots)
    ok = (at < len(y.roots)) & (y.roots[np.minimum(at, max(len(y.roots) - 1, 0))] == x.roots) if len(y.roots) else np.zeros(len(i), bool)
    work = [(len(x.levels) - 1, len(y.levels) - 1, i[ok], at[ok])]
    left, right = [], []
    while work:
        lx, ly, i, j = work.pop()
        if len(i) > budget:  # halves, depth first: the frontier stays bounded
            half = len(i) // 2
            work += [(lx, ly, i[:half], j[:half]), (lx, ly, i[half:], j[half:])]
            continue
        a, b = x.levels[lx], y.levels[ly]
        if same and lx == ly:
            up = i < j if lx == 0 else i <= j
            i, j = i[up], j[up]
        fits = (100 * b["hi"][j] >= percent * a["lo"][i]) & (100 * a["hi"][i] >= percent * b["lo"][j])
        fits &= (a["one"][i] != b["one"][j]) | (a["one"][i] < 0)
        i, j = i[fits], j[fits]
        if len(i):
            most = np.bitwise_count(a["bits"][i] & b["bits"][j]).sum(axis=1).astype(np.int64) + np.minimum(a["hidden"][i], b["hidden"][j])
            fits = np.minimum(most, np.minimum(a["hi"][i], b["hi"][j])) >= need(a["lo"][i], b["lo"][j], percent)
            i, j = i[fits], j[fits]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            left.append(i)
            right.append(j)
        elif lx >= ly:
            if lx == ly and lx > 0:
                i, j = _down(a, i, j)
                j, i = _down(b, j, i)
                work.append((lx - 1, ly - 1, i, j))
            else:
                i, j = _down(a, i, j)
                work.append((lx - 1, ly, i, j))
        else:
            j, i = _down(b, j, i)
            work.append((lx, ly - 1, i, j))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _down(level: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node i, with j repeated."""
    size = level["end"][i] - level["first"][i]
    back = np.cumsum(size) - size
    return np.repeat(level["first"][i] - back, size) + np.arange(size.sum()), np.repeat(j, size)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps at a narrower width: the OR of their parts."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def overlaps(n_a: np.ndarray, n_b: np.ndarray, a: pa.Array, b: pa.Array) -> np.ndarray:
    """How much the sets of each pair overlap at most, by their bitmaps."""
    ca, cb = width_class(n_a), width_class(n_b)
    most = np.zeros(len(n_a), np.int64)
    for x, y in {*zip(ca.tolist(), cb.tolist(), strict=True)}:
        at = np.flatnonzero((ca == x) & (cb == y))
        words = WIDTHS[min(x, y)] // 64
        p, q = (fold(np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1), words) for c in (a, b))
        hidden = [n[at] - np.bitwise_count(bits).sum(axis=1).astype(np.int64) for n, bits in ((n_a, p), (n_b, q))]
        both = np.bitwise_count(p & q).sum(axis=1).astype(np.int64)
        most[at] = np.minimum(both + np.minimum(*hidden), np.minimum(n_a[at], n_b[at]))
    return most


def candidates(group: np.ndarray, n: np.ndarray, label: np.ndarray, sigs: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of the same group, of different labels, that may overlap enough, and by how much at most."""
    order = np.lexsort((n, group))
    cls = width_class(n)
    out_a, out_b, out_c = [], [], []
    rows = {c: order[cls[order] == c] for c in np.unique(cls)}
    bits = {c: np.frombuffer(b"".join(sigs[k] for k in r), np.uint64).reshape(len(r), -1) for c, r in rows.items()}
    for c, r in rows.items():
        tree = Tree(group[r], n[r], bits[c], label[r])
        sides = [(r, bits[c], tree)]
        if c + 1 in rows:
            wide, narrow = rows[c + 1], fold(bits[c + 1], bits[c].shape[1])
            sides.append((wide, narrow, Tree(group[wide], n[wide], narrow, label[wide])))
        for other, other_bits, other_tree in sides:
            i, j = dual(tree, other_tree, percent, other_tree is tree)
            most = np.concatenate([np.bitwise_count(bits[c][i[k : k + 65536]] & other_bits[j[k : k + 65536]]).sum(axis=1) for k in range(0, max(len(i), 1), 65536)])
            out_a.append(r[i])
            out_b.append(other[j])
            out_c.append(most.astype(np.int64))
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_c)
