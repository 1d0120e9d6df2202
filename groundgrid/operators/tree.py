"""Merge trees of bands: the components of all thresholds at once, by tiles whose border parts are joined level by level.

A pixel enters at its band (0 first) and stays, so parts only grow and merge from band to band.
A tile joins its own pixels; a part that touches no border of its tile can't change any more and
is finished there. Of the others only the nodes of their tree and the pixels on the border go on
to the next level, where two by two tiles are one. So a task holds one tile, or the borders of
four, and no component has to fit into one, however large it is. Neighbouring pixels of one band
are one leaf, which arrays find; only leaves are looked at one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import tiles
from .components import exploded, written

_TOPS = pa.list_(pa.struct([("v", pa.float64()), ("y", pa.int64()), ("x", pa.int64())]))
#: kind 0, a node that is still open; 1, a border pixel and its node; 2, a finished node; 3, a top, or a pixel to look up; 4, the height of such a pixel.
#: comp_y, comp_x: the component of the mask that it belongs to, as only its own pixels hang together.
_LONGS = ["kind", "nid", "parent", "band", "until", "y", "x", "area", "marks", "sum_y", "sum_x", "first_y", "first_x", "comp_y", "comp_x"]
_STATE = ", ".join(f"{c} long" for c in _LONGS) + ", v double, tops array<struct<v: double, y: long, x: long>>"


@dataclass(frozen=True)
class Sweep:
    """How parts get tops (tops.sweep()). probe: with centroids, only list the pixels whose height is needed."""

    centroid: bool = False
    probe: bool = False


def thin(tops: list[tuple], eps: float) -> list[tuple]:
    """tops (-v, y, x) without those that have a higher one, kept or not, closer than 2 eps; looked up in cells of 2 eps."""
    kept, cells, side = [], {}, max(2 * eps, 1e-9)
    for t in sorted(tops):
        cy, cx = int(t[1] // side), int(t[2] // side)
        near = (u for dy in (-1, 0, 1) for dx in (-1, 0, 1) for u in cells.get((cy + dy, cx + dx), ()))
        if all((t[1] - u[1]) ** 2 + (t[2] - u[2]) ** 2 >= 4 * eps * eps for u in near):
            kept.append(t)
        cells.setdefault((cy, cx), []).append(t)
    return kept


class _Part:
    """A node: what it adds to its open children in pixels, marks, sums, highest (-v, y, x), first pixel, and tops of finished parts."""

    __slots__ = ("area", "band", "children", "comp", "first", "high", "marks", "open", "sum_x", "sum_y", "tops")

    def __init__(self, band: int, area=0, marks=0, sum_y=0, sum_x=0, high=None, first=None, tops=(), comp=(0, 0)):
        self.band, self.area, self.marks, self.sum_y, self.sum_x, self.high, self.first, self.comp = band, area, marks, sum_y, sum_x, high, first, comp
        self.tops, self.children, self.open = list(tops), [], False

    def add(self, o: _Part) -> None:
        self.area += o.area
        self.marks += o.marks
        self.sum_y += o.sum_y
        self.sum_x += o.sum_x
        self.tops += o.tops
        self.high = min((h for h in (self.high, o.high) if h is not None), default=None)
        self.first = min((f for f in (self.first, o.first) if f is not None), default=None)


class _Tile:
    """Joins the nodes of one tile, or those on the borders of several."""

    def __init__(self, sweep: Sweep | None, eps: float, least: float, heights: dict, last_band: int):
        self.sweep, self.eps, self.least, self.heights, self.last_band = sweep, eps, least, heights, last_band
        self.out: list[dict] = []
        self.leaves: dict[int, _Part] = {}
        self.parents: dict[int, int] = {}
        self.pixels: dict[tuple[int, int], tuple[int, int]] = {}  # (y, x): (band, node)
        self.edges: list[tuple[int, int, int]] | None = None  # (band, node, node) where they are known, so that pixels need no neighbours

    def fill(self, y, x, v, band, marks, comp, comps: list[tuple[int, int]], opened) -> None:
        """Leaves of pixels (arrays; comp counts in comps): those of one band and component that hang together. opened: pixels on the outer border."""
        if not len(y):
            self.edges = []
            return
        order = np.lexsort((x, y))
        y, x, v, band, marks, comp, opened = (c[order] for c in (y, x, v, band, marks, comp, opened))
        a, b = touching(y, x)
        own = comp[a] == comp[b]
        a, b = a[own], b[own]
        same = band[a] == band[b]
        leaf = _least(len(y), a[same], b[same])
        first = leaf == np.arange(len(y))
        leaf, first = (np.cumsum(first) - 1)[leaf], np.flatnonzero(first)
        k = len(first)
        top, high = np.full(k, -np.inf), np.full(k, len(y) - 1)
        np.maximum.at(top, leaf, v)
        best = np.flatnonzero(v == top[leaf])
        np.minimum.at(high, leaf[best], best)
        whole = lambda w: np.bincount(leaf, w, k).astype("int64").tolist()
        columns = (band[first], v[high], y[high], x[high], y[first], x[first], comp[first])
        for i, (e, area, m, sy, sx, (hv, hy, hx, fy, fx, of)) in enumerate(zip(columns[0].tolist(), whole(None), whole(marks), whole(y), whole(x), zip(*(q.tolist() for q in columns[1:])))):
            self.leaves[i] = _Part(e, area, m, sy, sx, (-hv, hy, hx), (fy, fx), comp=comps[of])
        a, b = a[~same], b[~same]
        code = np.unique(np.minimum(leaf[a], leaf[b]) * k + np.maximum(leaf[a], leaf[b]))
        a, b = code // k, code % k
        self.edges = list(zip(np.maximum(columns[0][a], columns[0][b]).tolist(), a.tolist(), b.tolist()))
        o = np.flatnonzero(opened)
        self.pixels = dict(zip(zip(y[o].tolist(), x[o].tolist()), zip(band[o].tolist(), leaf[o].tolist())))

    def finish(self, p: _Part, until: int) -> _Part:
        """A part that won't change any more; its children are in it already."""
        if self.sweep is None:
            self.out.append({"kind": 2, "band": p.band, "until": until, "first_y": p.first[0], "first_x": p.first[1], "area": p.area, "marks": p.marks})
            return p
        p.tops = thin(p.tops, self.eps) if len(p.tops) > 1 else p.tops
        if not p.tops and p.area > self.least:
            p.tops = [p.high]
            if self.sweep.centroid:
                middle = (p.sum_y // p.area, p.sum_x // p.area)
                p.tops = [(-self.heights.get((*middle, p.comp), 0.0), *middle)]
                if self.sweep.probe:
                    self.out.append({"kind": 3, "v": 0.0, "y": middle[0], "x": middle[1], "comp_y": p.comp[0], "comp_x": p.comp[1]})
        return p

    def join(self, is_open) -> list[dict]:
        """Band by band. is_open(y, x) tells pixels on the outer border; parts without one are finished, the others' nodes are written out."""
        root: dict[int, int] = {}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        unions: dict[int, list[tuple[int, int]]] = {}
        enters: dict[int, list[int]] = {}
        for i, p in self.leaves.items():
            enters.setdefault(p.band, []).append(i)
            if i in self.parents:
                unions.setdefault(self.leaves[self.parents[i]].band, []).append((i, self.parents[i]))
        border: dict[int, list[tuple[int, int]]] = {}
        get = self.pixels.get
        for (y, x), (band, i) in self.pixels.items():
            if is_open(y, x):
                border.setdefault(band, []).append((y, x))
            for n in ((y, x + 1), (y + 1, x - 1), (y + 1, x), (y + 1, x + 1)) if self.edges is None else ():
                if (o := get(n)) and o[1] != i and self.leaves[o[1]].comp == self.leaves[i].comp:
                    unions.setdefault(max(band, o[0]), []).append((i, o[1]))
        for band, i, j in self.edges or ():
            unions.setdefault(band, []).append((i, j))
        live: dict[int, _Part] = {}  # by a part's root
        held: dict[tuple[int, int], _Part] = {}  # of open pixels: their node
        for band in sorted(enters.keys() | unions.keys()):
            changed: dict[int, _Part] = {}
            for i in enters.get(band, ()):
                root[i], live[i] = i, self.leaves[i]
                changed[i] = self.leaves[i]
            for c in border.get(band, ()):
                self.leaves[get(c)[1]].open = True
            for i, j in unions.get(band, ()):
                a, b = find(i), find(j)
                if a == b:
                    continue
                for r in (a, b):
                    if r not in changed:  # grows in this band, so a new node stands over it
                        new = _Part(band, comp=live[r].comp)
                        new.open, new.children = live[r].open, [live[r]]
                        live[r] = changed[r] = new
                p, q = changed.pop(a), changed.pop(b)
                if len(p.children) + len(p.tops) < len(q.children) + len(q.tops):
                    p, q = q, p
                p.add(q)
                p.children += q.children
                p.open |= q.open
                root[b] = a
                del live[b]
                live[a] = changed[a] = p
            for p in changed.values():
                closed = [c for c in p.children if not c.open]
                p.children = [c for c in p.children if c.open]
                for c in closed:
                    p.add(self.finish(c, band - 1))
            for c in border.get(band, ()):
                held[c] = live[find(get(c)[1])]
        ids: dict[int, int] = {}
        for p in live.values():
            if not p.open:
                done = self.finish(p, self.last_band)
                if self.sweep and not self.sweep.probe:
                    self.out += [{"kind": 3, "v": -v, "y": y, "x": x} for v, y, x in done.tops]
                continue
            todo: list[tuple[_Part, int | None]] = [(p, None)]
            while todo:
                node, parent = todo.pop()
                ids[id(node)] = nid = len(ids)
                high, first = node.high or (None, None, None), node.first or (None, None)
                self.out.append({
                    "kind": 0, "nid": nid, "parent": parent, "band": node.band, "area": node.area, "marks": node.marks, "sum_y": node.sum_y, "sum_x": node.sum_x, "v": None if high[0] is None else -high[0], "y": high[1], "x": high[2],
                    "first_y": first[0], "first_x": first[1], "comp_y": node.comp[0], "comp_x": node.comp[1], "tops": [{"v": -v, "y": y, "x": x} for v, y, x in node.tops],
                })
                todo += [(c, nid) for c in node.children]
        self.out += [{"kind": 1, "nid": ids[id(node)], "band": self.pixels[c][0], "y": c[0], "x": c[1]} for c, node in held.items()]
        self.out += [{"kind": 4, "y": y, "x": x, "v": v, "comp_y": of[0], "comp_x": of[1]} for (y, x, of), v in self.heights.items()] if ids else []
        return self.out


def touching(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of pixels (sorted by y, x) that touch by a side or a corner, each pair once."""
    if not len(y):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    at = np.full((int(y[-1] - y[0]) + 2, int(x.max() - x.min()) + 3), -1)
    r, c = y - y[0], x - x.min() + 1
    at[r, c] = n = np.arange(len(y))
    a, b = (np.concatenate(e) for e in zip(*[(n, at[r + dy, c + dx]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    return a[b >= 0], b[b >= 0]


def parts(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first pixel of each pixel's 8-connected component, of pixels sorted by y, x."""
    return _least(len(y), *touching(y, x))


class _Heights:
    """Heights of the pixels of a window by (y, x, component)."""

    def __init__(self, y, x, v, comp, comps):
        self.v, self.comp, self.comps, self.y0, self.x0 = v, comp, comps, int(y.min(initial=0)), int(x.min(initial=0))
        self.at = np.full((int(y.max(initial=0)) - self.y0 + 1, int(x.max(initial=0)) - self.x0 + 1), -1)
        self.at[y - self.y0, x - self.x0] = np.arange(len(y))

    def get(self, key, default):
        y, x, of = key
        i = self.at[y - self.y0, x - self.x0]  # a centroid lies within the box of its part
        return float(self.v[i]) if i >= 0 and self.comps[self.comp[i]] == of else default


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and edges (a, b), the least node that each hangs together with."""
    first = np.arange(n)
    while len(a):
        less, more = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        np.minimum.at(first, more, less)
        while not np.array_equal(first, further := first[first]):
            first = further
        apart = first[a] != first[b]
        a, b = a[apart], b[apart]
    return first


def _is_open(y, x, span: int, last: bool):
    """Whether pixels lie on a border of their tile; the raster's own first row and column are none."""
    return (not last) & (((y % span == 0) & (y > 0)) | (y % span == span - 1) | ((x % span == 0) & (x > 0)) | (x % span == span - 1))


def _made(rows: list[dict], raster: pa.Array, eps: float, least: float, ty: int, tx: int) -> pa.Table:
    """What a tile tells, as the state's rows; raster: the one key of its raster."""
    made = {"raster_id": raster.take(pa.array([0] * len(rows), pa.int64())), "eps": pa.array([eps] * len(rows), pa.float64()), "least": pa.array([least] * len(rows), pa.float64())}
    made |= {"ty": pa.array([ty] * len(rows), pa.int32()), "tx": pa.array([tx] * len(rows), pa.int32())}
    made |= {c: pa.array([r.get(c) for r in rows], pa.int64()) for c in _LONGS}
    return pa.table({**made, "v": pa.array([r.get("v") for r in rows], pa.float64()), "tops": pa.array([r.get("tops") for r in rows], _TOPS)})


def _level(sweep: Sweep | None, bands: int, span: int, last: bool):
    """A level above the first for applyInArrow: what four tiles left open in, its state out."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in table.column_names if c != "raster_id"}
        heights = {(y, x, (cy, cx)): v for k, y, x, v, cy, cx in zip(*(cols[c] for c in ("kind", "y", "x", "v", "comp_y", "comp_x"))) if k == 4}
        tile = _Tile(sweep, cols["eps"][0], cols["least"][0], heights, bands - 1)
        # Ids count from 0 in each of the tiles that meet here.
        far = lambda ty, tx, nid: ((ty & 1) * 2 + (tx & 1)) << 40 | nid
        for r in zip(*(cols[c] for c in ("kind", "ty", "tx", "nid", "parent", "band", "y", "x", "v", "area", "marks", "sum_y", "sum_x", "first_y", "first_x", "tops", "comp_y", "comp_x"))):
            kind, ty, tx, nid, parent, band, y, x, v, area, marks, sum_y, sum_x, fy, fx, tops, cy, cx = r
            if kind == 0:
                i = far(ty, tx, nid)
                tile.leaves[i] = _Part(band, area, marks, sum_y, sum_x, None if v is None else (-v, y, x), None if fy is None else (fy, fx), [(-t["v"], t["y"], t["x"]) for t in tops], (cy, cx))
                if parent is not None:
                    tile.parents[i] = far(ty, tx, parent)
            elif kind == 1:
                tile.pixels[y, x] = (band, far(ty, tx, nid))
        rows = tile.join(lambda y, x: _is_open(y, x, span, last))
        return _made(rows, table.column("raster_id").combine_chunks(), cols["eps"][0], cols["least"][0], cols["ty"][0] // 2, cols["tx"][0] // 2)

    return run


def _climbed(made: DataFrame, most: int, bands: int, sweep: Sweep | None, tile: int) -> DataFrame:
    """Finished nodes (kind 2) or tops (kind 3) of all levels; made: the first one's state, most: its last row or column of tiles."""
    made = written(made)
    finished, span = made.where("kind IN (2, 3)"), tile
    for level in range(1, most.bit_length() + 1):
        span *= 2
        keys = ["raster_id", *[F.shiftright(c, 1).alias(f"at_{c}") for c in ("ty", "tx")]]
        run = _level(sweep, bands, span, most >> level == 0)
        made = written(made.where("kind IN (0, 1, 4)").groupBy(*keys).applyInArrow(run, made.schema))
        finished = finished.union(made.where("kind IN (2, 3)"))
    return finished


def _last(blocks: DataFrame) -> int:
    """The last row or column of tiles."""
    return blocks.agg(F.max(F.greatest("ty", "tx"))).first()[0] or 0


def _schema(blocks: DataFrame) -> str:
    return f"raster_id {blocks.schema['raster_id'].dataType.simpleString()}, eps double, least double, ty int, tx int, {_STATE}"


def entry_band(v, thresholds):
    """The band in which a height enters, when thresholds (an array) are lowered one by one: as many are above it."""
    return F.size(F.filter(thresholds, lambda t: t > v))


def band_components(cells: DataFrame, group: list[str], bands: int, tile: int = 256) -> DataFrame:
    """(group, band, comp_y, comp_x, area, marks): the 8-connected components of every band.

    cells: (group, y, x, band), and marks, a number added up over a component's pixels. A pixel is
    in its band and all later ones, up to bands - 1. comp_y, comp_x: the component's smallest (y, x).
    """
    marks = F.col("marks") if "marks" in cells.columns else F.lit(0)
    key = F.col(group[0]) if len(group) == 1 else F.struct(*group)
    ready = cells.select(key.alias("raster_id"), *[F.col(c).cast("int").alias(c) for c in ("y", "x")], F.col("band").cast("double").alias("band"), marks.cast("double").alias("marks"))
    values = ("band", "marks")
    blocks = written(tiles.packed(ready, lambda axis, c: (c // tile, c // tile), values))
    most = _last(blocks)

    def run(table: pa.Table) -> pa.Table:
        own, made = tiles.unpacked(table.column("cells"), values), _Tile(None, 0.0, 0.0, {}, bands - 1)
        y, x = own["y"].astype("int64"), own["x"].astype("int64")
        opened = _is_open(y, x, tile, most == 0)
        made.fill(y, x, np.zeros(len(y)), own["band"].astype("int64"), own["marks"], np.zeros(len(y), "int64"), [(0, 0)], opened)
        rows = made.join(lambda y, x: True)
        return _made(rows, table.column("raster_id").combine_chunks(), 0.0, 0.0, table.column("ty")[0].as_py(), table.column("tx")[0].as_py())

    found = _climbed(blocks.groupBy("raster_id", "ty", "tx").applyInArrow(run, _schema(blocks)), most, bands, None, tile)
    names = [F.col("raster_id").alias(group[0])] if len(group) == 1 else [F.col(f"raster_id.{g}").alias(g) for g in group]
    return found.select(*names, F.explode(F.sequence(F.col("band").cast("int"), F.col("until").cast("int"))).alias("band"), F.col("first_y").cast("int").alias("comp_y"), F.col("first_x").cast("int").alias("comp_x"), "area", "marks")


def bands_of(v, top, low, step):
    """The band in which a height enters a sweep from the highest one, and whether it enters before the last."""
    return np.maximum(0, np.ceil((top - v) / step) - 1), np.maximum(1, np.trunc((top - step - low) / step) - 1)


def swept(y, x, v, comp, comps: list[tuple[int, int]], step: float, eps: float, least: float, centroid: bool) -> list[tuple[int, int, float]]:
    """Tops (y, x, v) of the components of one window in memory, as sweep_tops() finds them. comp counts in comps."""
    top, low = np.full(len(comps), -np.inf), np.full(len(comps), np.inf)
    np.maximum.at(top, comp, v)
    np.minimum.at(low, comp, v)
    heights = _Heights(y, x, v, comp, comps)
    band, last = bands_of(v, top[comp], low[comp], step)
    enters = (band < last) & (top > low)[comp]
    y, x, v, comp, band = (c[enters] for c in (y, x, v, comp, band))
    tile = _Tile(Sweep(centroid), eps, least, heights, 0)
    tile.fill(y, x, v, band.astype("int64"), np.zeros(len(y)), comp, comps, np.zeros(len(y), bool))
    return [(r["y"], r["x"], r["v"]) for r in tile.join(lambda y, x: False) if r["kind"] == 3]


_CELLS = ("v", "comp")


def sweep_tops(p: DataFrame, labelled: DataFrame, params: DataFrame, centroid: bool = False, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, v): tops of each component by lowering the threshold band by band; see tops.sweep().

    p (raster_id, y, x, v double) and runs (raster_id, y, x0, x1, comp_y, comp_x) meet in tiles. With centroids
    a first pass lists the pixels whose heights are needed, and a second one knows them.
    """
    at = lambda c: F.floor(c / tile).cast("int")
    kind = p.schema["raster_id"].dataType.simpleString()
    key = ["raster_id", "ty", "tx"]
    runs = labelled.select(F.col("raster_id").cast(kind).alias("raster_id"), "y", "x0", "x1", F.col("comp_y").cast("long").alias("comp_y"), F.col("comp_x").cast("long").alias("comp_x"))
    runs = runs.withColumns({"ty": at(F.col("y")), "tx": F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))})
    place = [F.col(c).cast("int").alias(c) for c in ("y", "x")]
    heights = tiles.packed(p.select("raster_id", *place, "v").where("y IS NOT NULL AND x IS NOT NULL AND v IS NOT NULL"), lambda axis, c: (c // tile, c // tile))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """One row: the tile's pixels with their components, of which each has its highest and lowest pixel here."""
        if not left.num_rows or not right.num_rows:
            return nothing
        ty, tx = left.column("ty")[0].as_py() * tile, left.column("tx")[0].as_py() * tile
        own = tiles.unpacked(left.column("cells"))
        v, there = np.zeros((tile, tile)), np.zeros((tile, tile), bool)
        v[own["y"] - ty, own["x"] - tx], there[own["y"] - ty, own["x"] - tx] = own["v"], True
        y, x0, x1, cy, cx = (right.column(c).to_numpy().astype("int64") for c in ("y", "x0", "x1", "comp_y", "comp_x"))
        x0, x1 = np.maximum(x0, tx), np.minimum(x1, tx + tile - 1)
        comps, comp = np.unique(np.stack([cy, cx]), axis=1, return_inverse=True)
        n = x1 - x0 + 1
        many = np.repeat(np.arange(len(n)), n)
        y, x, comp = y[many] - ty, (x0[many] - tx) + np.arange(len(many)) - (np.cumsum(n) - n)[many], comp.ravel()[many]
        inside = there[y, x]
        y, x, comp = y[inside], x[inside], comp[inside]
        cells = np.empty(len(y), tiles.cell(_CELLS))
        cells["y"], cells["x"], cells["v"], cells["comp"] = y + ty, x + tx, v[y, x], comp
        top, low = np.full(comps.shape[1], -np.inf), np.full(comps.shape[1], np.inf)
        np.maximum.at(top, comp, cells["v"])
        np.minimum.at(low, comp, cells["v"])
        one = left.select(key).slice(0, 1).combine_chunks().append_column("cells", pa.array([cells.tobytes()], pa.binary()))
        for name, values in (("comp_y", comps[0]), ("comp_x", comps[1]), ("top", top), ("low", low)):
            one = one.append_column(name, pa.array([values.tolist()], pa.list_(pa.float64() if name in ("top", "low") else pa.int64())))
        return one

    schema = f"raster_id {kind}, ty int, tx int, cells binary, comp_y array<long>, comp_x array<long>, top array<double>, low array<double>"
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    blocks = written(heights.groupBy(*key).cogroup(runs.groupBy(*key)).applyInArrow(meet, schema))
    most = _last(blocks)
    here = blocks.select(*key, F.posexplode(F.arrays_zip("comp_y", "comp_x", "top", "low")).alias("comp", "c")).select(*key, "comp", "c.*")
    ends = here.groupBy("raster_id", "comp_y", "comp_x").agg(F.max("top").alias("top"), F.min("low").alias("low")).where("top > low")
    sizes = [F.col(c).cast("double").alias(c) for c in ("step", "eps")]
    ends = ends.join(params.select(F.col("raster_id").cast(kind).alias("raster_id"), *sizes, F.col("min_pix").cast("double").alias("least")), "raster_id")
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    known = exploded(here.drop("top", "low")).join(ends, ["raster_id", "comp_y", "comp_x"]).select(*key, "comp", "comp_y", "comp_x", "top", "low", "step", "eps", "least", *none("y", "x"))
    known = written(known)

    def first(sweep: Sweep, told: DataFrame) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            sought = right.filter(right.column("y").is_valid())
            right = right.filter(right.column("y").is_null())
            if not left.num_rows or not right.num_rows:
                return empty
            comp, cy, cx, top, low, step = (right.column(c).to_numpy() for c in ("comp", "comp_y", "comp_x", "top", "low", "step"))
            eps, least = right.column("eps")[0].as_py(), right.column("least")[0].as_py()
            own = np.concatenate([np.frombuffer(c, tiles.cell(_CELLS)) for c in left.column("cells").to_pylist()])
            n = max(int(own["comp"].max(initial=0)), int(comp.max())) + 1
            of = np.full(n, -1)
            of[comp] = np.arange(len(comp))
            mine = of[own["comp"].astype("int64")]
            own, mine = own[mine >= 0], mine[mine >= 0]
            y, x, v = own["y"].astype("int64"), own["x"].astype("int64"), own["v"]
            comps = list(zip(cy.tolist(), cx.tolist()))
            heights = {}
            if sought.num_rows:
                held = dict(zip(zip(y.tolist(), x.tolist()), zip(v.tolist(), mine.tolist())))
                for c in zip(*(sought.column(c).to_pylist() for c in ("y", "x", "comp_y", "comp_x"))):
                    if (h := held.get(c[:2])) and comps[h[1]] == c[2:]:
                        heights[c[0], c[1], c[2:]] = h[0]
            band, last = bands_of(v, top[mine], low[mine], step[mine])
            enters = band < last
            y, x, v, mine, band = (c[enters] for c in (y, x, v, mine, band))
            made = _Tile(sweep, eps, least, heights, 0)
            made.fill(y, x, v, band.astype("int64"), np.zeros(len(y)), mine, comps, _is_open(y, x, tile, most == 0))
            rows = made.join(lambda y, x: True)
            return _made(rows, left.column("raster_id").combine_chunks(), eps, least, left.column("ty")[0].as_py(), left.column("tx")[0].as_py())

        empty = to_arrow_schema(StructType.fromDDL(_schema(blocks))).empty_table()
        made = blocks.select(*key, "cells").groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(run, _schema(blocks))
        return _climbed(made, most, 1, sweep, tile)

    if centroid:
        sought = first(Sweep(True, True), known).select("raster_id", at(F.col("y")).alias("ty"), at(F.col("x")).alias("tx"), "comp_y", "comp_x", "y", "x").distinct()
        known = known.unionByName(sought, allowMissingColumns=True)
    return first(Sweep(centroid), known).where("kind = 3").select("raster_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
