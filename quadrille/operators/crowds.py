"""Sums of radial kernels over all pairs of points that crowd, in work that doesn't grow with a crowd's density.

A cell is *open* while a cell near it holds ``ncrit`` places or more.  Places have their sums in the first cell around them
that isn't open: so all cells near it hold fewer, and their places meet pair by pair.  At each level the cells of an open
parent meet those others by expansions that aren't near them, while their parents are.  What a place gets from levels above
is passed down within its block.  Blocks are cubes of cells of one level: each gets the places and moments of its surroundings,
packed, so that no pair is a row, and no task holds more than a block's surroundings.  The driver holds a row for each full
cell and for each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taylor import Coulomb, Expansion
from . import fields, sums
from .lineage import cut

#: Levels that are counted together; pairs of places, and of cells, that are evaluated together; pairs of an offset for which it becomes a matrix; pairs nearer than this part of a cell are taken from their differences.
STEP, TOGETHER, MET, OFTEN, CLOSE = 8, 1 << 15, 1 << 10, 8, 0.1


class Cells:
    """A set of cells of one level."""

    def __init__(self, cells: np.ndarray):
        self.values = [np.unique(c) for c in cells.T]
        self.codes = np.unique(self.coded(cells)[0])

    def coded(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, known = np.zeros(len(cells), np.int64), np.ones(len(cells), bool)
        for v, c in zip(self.values, cells.T, strict=True):
            at = np.minimum(np.searchsorted(v, c), len(v) - 1)
            known &= v[at] == c
            code = code * len(v) + at
        return code, known

    def has(self, cells: np.ndarray) -> np.ndarray:
        code, known = self.coded(cells)
        return known & (self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code)


class Opened:
    """Which cells are open: those with a full cell within ``reach`` cells, and some more where reach is wide."""

    def __init__(self, full: dict[int, np.ndarray], reach: int):
        self.shift, self.levels = int(reach > 1), {}
        wide = (reach + self.shift) >> self.shift
        for level, cells in full.items():
            if level < fields.DEPTH:
                cells = np.unique(cells >> self.shift, axis=0)
                for a in range(cells.shape[1]):
                    step = np.zeros((2 * wide + 1, cells.shape[1]), np.int64)
                    step[:, a] = np.arange(-wide, wide + 1)
                    cells = np.unique((cells[:, None] + step).reshape(-1, cells.shape[1]), axis=0)
                self.levels[level] = Cells(cells)

    def has(self, level: int, cells: np.ndarray) -> np.ndarray:
        return self.levels[level].has(cells >> self.shift) if level in self.levels else np.zeros(len(cells), bool)


def numbered(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, the number of its cell for each row)."""
    found, which = np.unique(cells, axis=0, return_inverse=True)
    return found, which.reshape(-1)


def met_pairs(method, targets: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(t, s, offsets, which): pairs that aren't near, while their parents are, by t; all offsets of a source, and that of each pair."""
    o = sources - targets[:, None]
    t, s = np.nonzero(~method.near(o) & method.near((sources >> 1) - (targets >> 1)[:, None]))
    last = 2 * method.reach + 1
    span = (2 * last + 1,) * targets.shape[1]
    code = np.ravel_multi_index(tuple((o[t, s] + last).T), span)
    used = np.flatnonzero(np.bincount(code))
    return t, s, np.stack(np.unravel_index(used, span), 1) - last, np.searchsorted(used, code)


class Taylor:
    """Expansions of an order, of cells whose bounding spheres' radii are at most theta times their distance."""

    side = wide = 3

    def __init__(self, dims: int, kernel, order: int, theta: float):
        self.dims, self.kernel, self.taylor = dims, kernel, Expansion(dims, order)
        self.apart = dims / theta**2
        self.reach = int(np.ceil(np.sqrt(self.apart))) - 1
        self.size, self.values = self.taylor.size, 1
        taylor = self.taylor
        self.both = np.array([[taylor.at.get(tuple(x + y for x, y in zip(n, k, strict=True)), self.size) for k in taylor.of] for n in taylor.of])
        self.sums = [(n, k, self.both[n, k]) for n in range(self.size) for k in range(self.size) if self.both[n, k] < self.size]
        self.signs = np.array([(-1.0) ** sum(k) for k in taylor.of])
        self.lower = [tuple(map(list, zip(*[(taylor.at[k], taylor.at[taylor.less(k, a)]) for k in taylor.of if k[a]], strict=True))) for a in range(dims)]

    def near(self, o: np.ndarray) -> np.ndarray:
        return (o * o).sum(-1) < self.apart

    def terms(self, r2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        if isinstance(self.kernel, Coulomb):
            same = r2 == 0
            v = np.sqrt(r2)
            np.divide(1.0, v, out=v, where=~same) if (some := same.any()) else np.divide(1.0, v, out=v)
            if some:
                v[same] = 0
            w = np.multiply(v, v, out=r2)
            w *= v
            return [v], np.negative(w, out=w)
        value, slope = self.kernel.terms(r2, 1)
        return [value], slope

    def moments(self, box, level: int, cells: np.ndarray, p: np.ndarray, q: np.ndarray, below) -> tuple[np.ndarray, np.ndarray]:
        found, which = numbered(cells)
        each = self.taylor.powers(p - box.centre(level, found)[which]) * q[:, None]
        order = np.argsort(which, kind="stable")
        return found, np.add.reduceat(each[order], np.searchsorted(which[order], np.arange(len(found))), axis=0)

    def met(self, box, level: int, targets: np.ndarray, sources: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, m, size = np.zeros((len(targets), self.size)), m * self.signs, box.width / 2.0**level
        for first in range(0, len(targets), step := max(1, 512 * MET // len(sources))):
            t, s, offsets, which = met_pairs(self, targets[first : first + step], sources)
            if not len(t):
                continue
            grown = np.column_stack([self.taylor.derivatives(self.kernel, offsets * -size), np.zeros(len(offsets))])
            counts, order = np.bincount(which), np.argsort(which, kind="stable")
            ends = np.cumsum(counts)
            for n in np.flatnonzero(counts >= OFTEN):
                rows = order[ends[n] - counts[n] : ends[n]]
                out[first + t[rows]] += m[s[rows]] @ grown[n][self.both]
            rest = np.flatnonzero(counts[which] < OFTEN)
            for k in range(0, len(rest), MET):
                rows = rest[k : k + MET]
                their, d, room = np.ascontiguousarray(m[s[rows]].T), np.ascontiguousarray(grown[which[rows]].T), np.zeros((self.size, len(rows)))
                for n, a, b in self.sums:
                    room[n] += their[a] * d[b]
                mine, start = np.unique(t[rows], return_index=True)
                out[first + mine] += np.add.reduceat(room, start, axis=1).T
        return out

    def lowered(self, box, level: int, cells: np.ndarray, above: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Locals of cells of a level, from those of the level above, one for each."""
        return self.taylor.lowered(local, box.centre(level, cells) - box.centre(level - 1, above))

    def value(self, box, level: int, cells: np.ndarray, which: np.ndarray, local: np.ndarray, p: np.ndarray) -> np.ndarray:
        """At places of some cells, which: that of each."""
        out, d = np.zeros((len(p), 1 + self.dims)), p - box.centre(level, cells)[which]
        for k in range(0, len(p), MET):
            powers, own = self.taylor.powers(d[k : k + MET]), local[which[k : k + MET]]
            out[k : k + MET, 0] = (powers * own).sum(1)
            for a, (terms, low) in enumerate(self.lower):
                out[k : k + MET, 1 + a] = (powers[:, low] * own[:, terms]).sum(1)
        return out


class Chebyshev:
    """Interpolation at Chebyshev nodes of cells that aren't adjacent, by skeletons: the first function to double precision, the others as told."""

    side, wide, reach = 2, 3, 1

    def __init__(self, dims: int, kernel: sums.Kernel, terms: Callable, width: float, levels: int, bounds: list[float]):
        self.dims, self.kernel, self.terms, self.nodes = dims, kernel, terms, sums.Nodes(dims)
        halves = [width / 2.0 ** (level + 1) for level in range(2, max(2, levels) + 1)]
        sketch = lambda bound: max(64, sums.SKETCH[dims] // (3 if bound > 1e-9 else 1) * 2 // 3)
        self.bases = [sums.skeleton(self.nodes, f, halves[:1] if scaled(f, width) else halves, bound, sketch(bound)) for f, bound in zip(kernel.values, bounds, strict=True)]
        self.ends = np.cumsum([0, *[len(places) for places, _ in self.bases]])
        self.size, self.values = int(self.ends[-1]), len(kernel.values)
        x = self.nodes.x
        self.halved = [self.nodes.basis((x + s) / 2) for s in (-1, 1)]  # what each node of a parent has at a child's nodes

    def near(self, o: np.ndarray) -> np.ndarray:
        return (np.abs(o) <= 1).all(-1)

    def moved(self, m: np.ndarray, bits: np.ndarray, up: bool) -> np.ndarray:
        shape = m.shape
        m = m.reshape((self.nodes.p,) * self.dims)
        for b in bits:  # each turns the axes by one
            m = np.tensordot(m, self.halved[b], axes=(0, 0 if up else 1))
        return m.reshape(shape)

    def moments(self, box, level: int, cells: np.ndarray, p: np.ndarray, q: np.ndarray, below):
        found, which = numbered(cells)
        m = np.zeros((len(found), self.nodes.size))
        if below is not None:
            for c, each in zip(*below, strict=True):
                m[int((found == c >> 1).all(1).argmax())] += self.moved(each, c & 1, True)
        else:
            u, order = (p - box.centre(level, found)[which]) * (2.0 ** (level + 1) / box.width), np.argsort(which, kind="stable")
            for k, rows in enumerate(np.split(order, np.searchsorted(which[order], np.arange(1, len(found))))):
                m[k] = self.nodes.moments(u[rows], q[rows])
        return found, m

    def packed(self, m: np.ndarray) -> np.ndarray:
        return np.concatenate([m @ to.T for _, to in self.bases], 1)

    def met(self, box, level: int, targets: np.ndarray, sources: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, half = np.zeros((len(targets), self.size)), box.width / 2.0 ** (level + 1)
        t, s, offsets, which = met_pairs(self, targets, sources)
        if not len(t):
            return out
        order = np.argsort(which, kind="stable")
        runs = dict(zip(map(tuple, offsets.tolist()), np.split(order, np.searchsorted(which[order], np.arange(1, len(offsets)))), strict=True))
        for o, rows in runs.items():
            back = runs.get(tuple(-x for x in o))
            if back is not None and o < (0,) * self.dims:
                continue  # together with its opposite
            for f, (places, _), a, b in zip(self.kernel.values, self.bases, self.ends, self.ends[1:]):
                mine, theirs = places, places + 2.0 * np.array(o)
                r2 = np.column_stack([-2 * mine, (mine * mine).sum(1), np.ones(len(mine))]) @ np.column_stack([theirs, np.ones(len(mine)), (theirs * theirs).sum(1)]).T
                between = f(np.multiply(r2, half**2, out=r2))
                out[t[rows], a:b] += m[s[rows], a:b] @ between.T
                if back is not None:
                    out[t[back], a:b] += m[s[back], a:b] @ between
        return out

    def unpacked(self, local: np.ndarray) -> np.ndarray:
        return np.concatenate([local[:, a:b] @ to for (_, to), a, b in zip(self.bases, self.ends, self.ends[1:])], 1)

    def lowered(self, box, level: int, cells: np.ndarray, above: np.ndarray, local: np.ndarray) -> np.ndarray:
        n = self.nodes.size
        return np.array([np.concatenate([self.moved(x[k * n : (k + 1) * n], c & 1, False) for k in range(self.values)]) for c, x in zip(cells, local, strict=True)])

    def value(self, box, level: int, cells: np.ndarray, which: np.ndarray, local: np.ndarray, p: np.ndarray) -> np.ndarray:
        scale, n, out = 2.0 ** (level + 1) / box.width, self.nodes.size, np.zeros((len(p), self.values + self.dims))
        for k in np.flatnonzero(local.any(1)):
            rows = np.flatnonzero(which == k)
            u = (p[rows] - box.centre(level, cells[k : k + 1])) * scale
            bases = [self.nodes.basis(u[:, a]) for a in range(self.dims)]
            slopes = [[self.nodes.slopes(u[:, b]) if a == b else bases[b] for b in range(self.dims)] for a in range(self.dims)]
            found = [self.nodes.value(local[k, v * n : (v + 1) * n], bases) for v in range(self.values)]
            out[rows] = np.stack([*found, *[self.nodes.value(local[k, :n], s) * scale for s in slopes]], 1)
        return out


def scaled(f: Callable, width: float) -> bool:
    """Whether f is a power of r: then one skeleton is that of the cells of all levels."""
    r2 = np.array([1.0, 4.0, 0.25, 1e-6]) * width**2
    return bool(np.allclose(f(r2 * 9) / f(r2), f(r2[:1] * 9) / f(r2[:1]), rtol=1e-13))


def placed(points: DataFrame, axes: list[str]) -> tuple[DataFrame, list[float], float]:
    """fields.placed() on a box of a power of two at a corner of as few bits, so that places about a cell's centre have all their digits."""
    at, low, width = fields.placed(points, axes)
    bits = math.frexp(width)[1]
    while True:
        step = 2.0 ** (bits - 10)
        corner = [math.floor(lo / step) * step for lo in low]
        if all(lo - c + width < 2.0**bits for lo, c in zip(low, corner, strict=True)):
            break
        bits += 1
    k = {f"k{a}": F.least(F.floor((F.col(a) - F.lit(c)) / F.lit(2.0**bits) * F.lit(2.0**fields.DEPTH)).cast("long"), F.lit(2**fields.DEPTH - 1)) for a, c in zip(axes, corner, strict=True)}
    return at.withColumns(k), corner, 2.0**bits


class Box:
    def __init__(self, low: list[float], width: float):
        self.low, self.width = np.array(low), width

    def centre(self, level: int, cells: np.ndarray) -> np.ndarray:
        return self.low + (cells + 0.5) * (self.width / 2.0**level)


def paired(method, targets: np.ndarray, sources: np.ndarray, q: np.ndarray, size: float) -> np.ndarray:
    """(targets, values and gradient) about a cell's centre, pair by pair.

    Squares of distances are a product of matrices; of close pairs, where that would lose digits, they are taken from differences.
    """
    dims, n = targets.shape[1], method.values
    mine = np.column_stack([-2 * targets, (targets * targets).sum(1), np.ones(len(targets))])
    theirs = np.column_stack([sources, np.ones(len(sources)), (sources * sources).sum(1)])
    charge, out = np.column_stack([q, sources * q[:, None]]), np.zeros((len(targets), n + dims))
    many = min(len(sources), 1024)
    for s in range(0, len(sources), many or 1):
        other, c = np.ascontiguousarray(theirs[s : s + many].T), charge[s : s + many]
        for t in range(0, len(targets), step := max(1, TOGETHER // many)):
            r2 = mine[t : t + step] @ other
            close = np.flatnonzero(r2 < (CLOSE * size) ** 2)
            if len(close):
                i, j = np.divmod(close, r2.shape[1])
                d = targets[t + i] - sources[s + j]
                r2.reshape(-1)[close] = (d * d).sum(1)
            values, slope = method.terms(r2)
            for k, v in enumerate(values):
                out[t : t + step, k] += v @ c[:, 0]
            w = slope @ c
            out[t : t + step, n:] += targets[t : t + step] * w[:, :1] - w[:, 1:]
    return out


def full_cells(at: DataFrame, keys: list[str], ncrit: int) -> dict[int, np.ndarray]:
    """The cells of each level with ncrit places or more."""
    full, above, live = {}, -1, at.select(*keys)
    while True:
        level = min(fields.DEPTH, above + STEP)
        cells = live.groupBy(*[F.shiftright(k, fields.DEPTH - level).alias(k) for k in keys]).agg(F.count("*").alias("n"))
        up = cells.withColumn("level", F.explode(F.sequence(F.lit(above + 1), F.lit(level))))
        up = up.groupBy("level", *[F.expr(f"shiftright({k}, {level} - level)").alias(k) for k in keys]).agg(F.sum("n").alias("n"))
        found = up.where(F.col("n") >= ncrit).toPandas()
        for lv, x in found.groupby("level"):
            full[int(lv)] = x[keys].to_numpy(np.int64)
        if level not in full or level == fields.DEPTH:
            return full
        named = at.sparkSession.createDataFrame(pd.DataFrame(full[level], columns=[f"f{k}" for k in keys]))
        live = live.join(named, [F.shiftright(k, fields.DEPTH - level) == F.col(f"f{k}") for k in keys], "left_semi")
        above = level


def cell_sums(places: tuple, axes: list[str], make: Callable, ncrit: int, names: list[str]) -> DataFrame:
    """(axes.., names..) of each place. places: those of placed(); make(box, deepest level): the method."""
    at, low, width = places
    dims, keys, blocks, box = len(axes), [f"k{a}" for a in axes], [f"b{a}" for a in axes], Box(low, width)
    full = full_cells(at, keys, ncrit)
    method = make(box, max(full, default=0) + 1)
    reach, side, opened = method.reach, method.side, Opened(full, method.reach)
    crowded = {level: Cells(cells) for level, cells in full.items()}
    pack, unpack = getattr(method, "packed", lambda m: m), getattr(method, "unpacked", lambda x: x)

    def levelled(batches):
        for x in batches:
            k, level, live = x[keys].to_numpy(np.int64), np.zeros(len(x), int), np.arange(len(x))
            lv = 0
            while len(live := live[opened.has(lv, k[live] >> (fields.DEPTH - lv))]):
                lv += 1
                level[live] = lv
            up = (fields.DEPTH - level)[:, None]
            yield x.assign(level=level, **dict(zip(blocks, ((k >> up) >> side).T, strict=True)))

    long = lambda names: ", ".join(f"{c} long" for c in names)
    at = cut(at.mapInPandas(levelled, f"{', '.join(f'{a} double' for a in axes)}, q double, {long(keys)}, level int, {long(blocks)}"))
    known = at.groupBy("level", *blocks).count().toPandas()
    leaves = {int(lv): x[blocks].to_numpy(np.int64) for lv, x in known.groupby("level")}
    meets = {lv: np.unique(np.concatenate([b >> (own - lv + method.wide - side) for own, b in leaves.items() if own >= lv]), axis=0) for lv in range(1, max(leaves, default=0) + 1)}

    def about(of: np.ndarray, c: np.ndarray, margin: int, side: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(block, which of the cells) for all blocks with cells within margin."""
        some = of[((of << side) - margin <= c.max(0)).all(1) & (((of + 1) << side) + margin > c.min(0)).all(1)]
        each = [(b, np.flatnonzero(((c >= (b << side) - margin) & (c < ((b + 1) << side) + margin)).all(1))) for b in some]
        return [(b, k) for b, k in each if len(k)]

    def sent(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        k, p, q, rows = x[keys].to_numpy(np.int64), x[axes].to_numpy(float), x.q.to_numpy(float), []
        pq = np.column_stack([p, q])
        for level, of in leaves.items():
            c = k >> (fields.DEPTH - level)
            few = np.flatnonzero(~crowded[level].has(c)) if level in crowded and level < fields.DEPTH else np.arange(len(c))  # no place that has its sums here is near a full cell
            for b, some in about(of, c[few], reach, side) if len(few) else ():
                own = level == key[0] and tuple(b) == tuple(key[1:])
                rows.append((level, *b, 1 if own else 0, 0, k[few[some]].tobytes(), pq[few[some]].tobytes()))
        below, whole = None, False
        for level in sorted(meets, reverse=True):
            c = k >> (fields.DEPTH - level)
            if not (to := about(meets[level], c, 2 * reach + 1, method.wide)):
                below, whole = None, False
                continue
            some = np.unique(np.concatenate([i for _, i in to]))
            below = method.moments(box, level, c[some], p[some], q[some], below if whole and len(some) == len(c) else None)
            whole, (cells, m) = len(some) == len(c), (below[0], pack(below[1]))
            for b, i in about(np.array([b for b, _ in to]), cells, 2 * reach + 1, method.wide):
                rows.append((level, *b, 2, level, cells[i].tobytes(), m[i].tobytes()))
        return pd.DataFrame(rows, columns=["level", *blocks, "kind", "at", "cells", "data"])

    def read(cells: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(cells, np.int64).reshape(-1, dims), np.frombuffer(data).reshape(-1, width)

    def crossed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        level, block, rows = int(key[0]), np.array(key[1:]), []
        cells, m = map(np.concatenate, zip(*[read(c, d, method.size) for c, d in zip(x.cells, x.data, strict=True)], strict=True))
        sources, which = numbered(cells)
        moments = np.zeros((len(sources), method.size))
        np.add.at(moments, which, m)
        targets = sources[(sources >> method.wide == block).all(1)]
        targets = targets[opened.has(level - 1, targets >> 1)]
        if len(targets):
            local = method.met(box, level, targets, sources, moments)
            for own, of in leaves.items():
                for b in of[(of >> (own - level + method.wide - side) == block).all(1)] if own >= level else ():
                    low, high = ((b << side) >> (own - level)), (((b + 1) << side) - 1) >> (own - level)
                    if (some := ((targets >= low) & (targets <= high)).all(1)).any():
                        rows.append((own, *b, 3, level, targets[some].tobytes(), local[some].tobytes()))
        return pd.DataFrame(rows, columns=["level", *blocks, "kind", "at", "cells", "data"])

    def summed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        level, near, mine, local = int(key[0]), [], None, {}
        for kind, lv, c, d in zip(x.kind, x["at"], x.cells, x.data, strict=True):
            if kind == 3:
                local.setdefault(lv, []).append(read(c, d, method.size))
            else:
                near.append(read(c, d, dims + 1))
                mine = near[-1] if kind == 1 else mine
        order = lambda k, p: (c := k >> (fields.DEPTH - level), o := np.lexsort(c.T[::-1]), c[o], p[o])[2:]
        cells, p = order(*map(np.concatenate, zip(*near, strict=True)))
        held, first = np.unique(cells, axis=0, return_index=True)
        last = np.append(first[1:], len(cells))
        k, own = order(*mine)
        targets, start = np.unique(k, axis=0, return_index=True)
        end, out = np.append(start[1:], len(k)), np.zeros((len(k), len(names)))
        above, known = targets[:1] >> level, np.zeros((1, method.values * method.nodes.size if isinstance(method, Chebyshev) else method.size))
        for lv in range(1, level + 1):
            here = np.unique(targets >> (level - lv), axis=0)
            up = (above[None] == (here >> 1)[:, None]).all(2).argmax(1)
            found = method.lowered(box, lv, here, above[up], known[up]) if known.any() else np.zeros((len(here), known.shape[1]))
            for c, values in local.get(lv, ()):
                i, j = np.nonzero((here[:, None] == c[None]).all(2))
                found[i] += unpack(values[j])
            above, known = here, found
        for t, a, b in zip(targets, start, end, strict=True):
            some = np.flatnonzero(method.near(held - t))
            rows = np.concatenate([np.arange(first[s], last[s]) for s in some])
            centre = box.centre(level, t[None])[0]
            out[a:b] = paired(method, own[a:b, :dims] - centre, p[rows, :dims] - centre, p[rows, dims], width / 2.0**level)
        if known.any():
            out += method.value(box, level, targets, np.repeat(np.arange(len(targets)), end - start), known, own[:, :dims])
        return pd.DataFrame({**dict(zip(axes, own[:, :dims].T, strict=True)), **dict(zip(names, out.T, strict=True))})

    schema = f"level int, {long(blocks)}, kind int, at int, cells binary, data binary"
    groups = len(known)
    each = cut(sums.dealt(at, groups, "level", *blocks).groupBy("level", *blocks).applyInPandas(sent, schema))
    far = sums.dealt(each.where("kind = 2"), groups, "level", *blocks).groupBy("level", *blocks).applyInPandas(crossed, schema)
    every = sums.dealt(each.where("kind < 2").unionByName(far), groups, "level", *blocks)
    return every.groupBy("level", *blocks).applyInPandas(summed, ", ".join(f"{c} double" for c in [*axes, *names]))


def at_points(points: DataFrame, axes: list[str], found: Callable, names: list[str]) -> DataFrame:
    """(id, names..) of each point, from found(places)."""
    own = points.select("id", *[F.col(a).cast("double").alias(a) for a in axes], F.coalesce(F.col("q").cast("double"), F.lit(0.0)).alias("q"))
    return own.drop("q").join(cut(found(placed(own, axes))), axes, "left").select("id", *names)


def crowd_fields(points: DataFrame, axes: list[str], kernel=None, order: int = 6, theta: float = 0.6, ncrit: int = 256) -> DataFrame:
    """fields.fields() where many points crowd: cells of one level meet, so that no pair of cells is a row.

    Cells meet by expansions where the radii of the spheres around them are at most theta times their distance; those that are
    nearer, and hold fewer than ncrit places, meet pair by pair.
    """
    dims, names = len(axes), ["u", *[f"g{a}" for a in axes]]
    return at_points(points, axes, lambda at: cell_sums(at, axes, lambda *_: Taylor(dims, kernel or Coulomb(), order, theta), ncrit, names), names)


def crowd_sums(points: DataFrame, axes: list[str], kernel: sums.Kernel, terms: Callable, bounds: list[float], names: list[str], few: int = sums.FEW, ncrit: int = 1024) -> DataFrame:
    """sums.pair_sums() where many points crowd. terms(r^2): the kernel's functions and its slope; bounds: what their skeletons leave out.

    Up to ``few`` points meet one by one.
    """
    if points.count() <= few:
        return sums.pair_sums(points, axes, kernel, names)
    make = lambda box, levels: Chebyshev(len(axes), kernel, terms, box.width, levels, bounds)
    return at_points(points, axes, lambda at: cell_sums(at, axes, make, ncrit, names), names)
