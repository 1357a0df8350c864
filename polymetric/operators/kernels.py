"""Distances between many pairs of vectors, in tiles that fit a processor's cache; nothing here needs Spark.

A tile is computed in single precision first, or in whole numbers of 16 bits
where these are fine enough.  Pairs that may pass by its error bound, and only
those, are computed again in double precision, term by term in the order of
the components, so results are those of a plain sum.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have the package: functions of this module travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs of a tile, a row or column of which is a vector, and pairs that are computed again at once.
TILE, AGAIN = 512, 65_536
#: Larger components are left to double precision.
PLAIN = 1e15
#: Largest step of a grid of whole numbers, as a share of the mean deviation of components; a coarser one would leave too many pairs to compute again.
STEP = 0.04


def vectors(column: pa.Array | pa.ChunkedArray, nan: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``positions, matrix`` for every length of vector that occurs; vectors that are null or hold a null or, unless ``nan`` is set, NaN are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        flat = (column if len(at) == len(column) else column.take(pa.array(at))).flatten()
        out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n) if nan else np.isnan(out)
        good = ~missing.any(axis=1)
        yield at[good], out[good]


def grouped(batch: pa.RecordBatch | pa.Table, columns: Sequence[str]) -> Iterator[tuple[tuple[int, ...], np.ndarray, list[np.ndarray]]]:
    """``lengths, positions, matrices`` of the rows whose vectors in all ``columns`` count, by the lengths of these."""
    found: list[tuple[tuple[int, ...], np.ndarray, list[np.ndarray]]] = [((), np.arange(batch.num_rows), [])]
    for c in columns:
        new = list(vectors(batch.column(batch.schema.get_field_index(c))))
        both = []
        for lengths, at, own in found:
            for place, matrix in new:
                _, i, j = np.intersect1d(at, place, assume_unique=True, return_indices=True)
                if len(i):
                    both.append(((*lengths, matrix.shape[1]), at[i], [x[i] for x in own] + [matrix[j]]))
        found = both
    return iter(found)


def plain(*parts: np.ndarray) -> bool:
    """Whether single precision has room for sums and squares of the components."""
    return all(not x.size or np.abs(x).max() <= PLAIN for x in parts)


def exact(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` from the rows of ``b``, added up from the first component to the last."""
    with np.errstate(all="ignore"):
        gap = a - b
        terms = np.abs(gap) if kind == "l1" else gap * gap
        total = np.zeros(len(a))
        for x in terms.T:
            total += x
        return total if kind == "l1" else np.sqrt(total)


def tile(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` from every row of ``b``, up to the error of their type."""
    out, gap = np.zeros((len(a), len(b)), a.dtype), np.empty((len(a), len(b)), a.dtype)
    with np.errstate(all="ignore"):
        for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
            np.subtract(x[:, None], y[None, :], out=gap)
            np.abs(gap, out=gap) if kind == "l1" else np.multiply(gap, gap, out=gap)
            out += gap
        return out if kind == "l1" else np.sqrt(out, out=out)


def slack(kind: str, a: np.ndarray, b: np.ndarray, dtype: type) -> float:
    """More than a distance of ``tile`` is off by."""
    if not a.size or not b.size:
        return 0.0
    largest = float(np.abs(a).max() + np.abs(b).max())
    width = a.shape[1]
    # The last term is for squares under the least number of single precision.
    return 4 * (width + 4) * float(np.finfo(dtype).eps) * largest * (width if kind == "l1" else width**0.5 + 1) + 1e-18 * width


def grid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """``a`` and ``b`` in whole steps, few enough for sums of their gaps to fit 16 bits, and the step; None where that is too coarse."""
    if not a.size or not b.size:
        return None
    low = float(min(a.min(), b.min()))
    step = (float(max(a.max(), b.max())) - low) / (np.iinfo(np.int16).max // a.shape[1] or 1)
    if not 1e-30 < step <= STEP * float(np.abs(b - b.mean(dtype=np.float64)).mean(dtype=np.float64)):
        return None
    return *(np.rint((x.astype(np.float64) - low) / step).astype(np.int16) for x in (a, b)), step


def rough(kind: str, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float]]:
    """``row, column, distances, slack`` of tiles; where components are huge, in double precision and with no bound on the error."""
    fast = plain(a, b)
    x, y = (a.astype(np.float32), b.astype(np.float32)) if fast else (a, b)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            p, q = x[i : i + TILE], y[j : j + TILE]
            off = slack(kind, p, q, np.float32) if fast else float("inf")
            whole = grid(p, q) if fast and kind == "l1" else None
            if whole:
                # A component is off by half a step, so a gap by one.
                yield i, j, tile(kind, *whole[:2]) * np.float32(whole[2]), off + p.shape[1] * whole[2] * (1 + 1e-6)
            else:
                yield i, j, tile(kind, p, q), off


def within(kinds: Sequence[str], scale: Sequence[float], a: Sequence[np.ndarray], b: Sequence[np.ndarray], radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``rows, columns, distances`` of pairs within ``radius`` by the sum of the metrics' distances times ``scale``."""
    for i, j, d, off in _tiles(kinds, scale, a, b):
        yield from _again(kinds, scale, a, b, *np.nonzero(d <= radius + off) if off < float("inf") else np.indices(d.shape).reshape(2, -1), i, j, radius)


def _tiles(kinds, scale, a, b) -> Iterator[tuple[int, int, np.ndarray, float]]:
    for parts in zip(*[rough(k, x, y) for k, x, y in zip(kinds, a, b)]):
        i, j = parts[0][:2]
        total = sum(np.asarray(d) * d.dtype.type(s) for (_, _, d, _), s in zip(parts, scale)) if len(parts) > 1 or scale[0] != 1 else parts[0][2]
        yield i, j, total, sum(off * s for (_, _, _, off), s in zip(parts, scale)) * (1 + 1e-3)


def _again(kinds, scale, a, b, rows, columns, i, j, radius) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(0, len(rows), AGAIN):
        r, c = rows[k : k + AGAIN] + i, columns[k : k + AGAIN] + j
        d = 0.0
        for kind, (weight, most), x, y in zip(kinds, getattr(scale, "pairs", [(s, 1.0) for s in scale]), a, b):
            d = d + weight * (exact(kind, x[r], y[c]) / most)
        keep = d <= radius
        yield r[keep], c[keep], d[keep]


class Scale(list):
    """Weights over largest distances; ``pairs`` keeps both, so that double precision divides and multiplies as a plan does."""

    def __init__(self, weights: Sequence[float], most: Sequence[float]):
        super().__init__(w / m for w, m in zip(weights, most))
        self.pairs = list(zip(weights, most))


class Nearest:
    """The ``k`` nearest rows of every query so far, ties to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.d, self.keys = k, np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)
        self.held = np.zeros(queries, dtype=np.int64)

    def add(self, kinds, scale, queries, rows, keys: np.ndarray) -> None:
        """Queries are the rows of the tiles.  Only pairs no farther than a query's ``k``-th so far, or than its ``k``-th in the tile, are computed again."""
        for i, j, d, off in _tiles(kinds, scale, queries, rows):
            n, width = d.shape
            if off < float("inf"):
                bound = np.where(self.held[i : i + n] >= self.k, self.d[i : i + n, -1], np.inf) + off
                if width > self.k:
                    bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + 2 * off)
                at = np.nonzero(d <= bound[:, None])
            else:
                at = np.indices(d.shape).reshape(2, -1)
            for r, c, dist in _again(kinds, scale, queries, rows, *at, i, j, np.inf):
                self._merge(r, dist, keys[c])

    def _merge(self, r: np.ndarray, d: np.ndarray, keys: np.ndarray) -> None:
        touched, own = np.unique(r, return_inverse=True)
        held = np.arange(self.k)[None, :] < self.held[touched][:, None]
        who = np.concatenate([np.repeat(np.arange(len(touched)), self.k)[held.ravel()], own])
        d = np.concatenate([self.d[touched][held], d])
        keys = np.concatenate([self.keys[touched][held], keys])
        order = np.lexsort((keys, d, who))
        who, d, keys = who[order], d[order], keys[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        self.d[touched[who[keep]], place[keep]] = d[keep]
        self.keys[touched[who[keep]], place[keep]] = keys[keep]
        self.held[touched] = np.bincount(who[keep], minlength=len(touched))


def close(a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, columns`` of all pairs under a Euclidean ``radius``, by products of matrices; exact."""
    fast = plain(a, b)
    kind = np.float32 if fast else np.float64
    half = [np.einsum("ij,ij->i", x, x) / 2 for x in (a, b)]
    one = [np.ones((len(x), 1)) for x in (a, b)]
    # Minus half of the squared distance is one product of the vectors with two more components.
    x = np.hstack([a, -half[0][:, None], one[0]]).astype(kind)
    y = np.hstack([b, one[1], -half[1][:, None]]).astype(kind)
    for i in range(0, len(a), 2 * TILE):
        for j in range(0, len(b), 4 * TILE):
            p, q = slice(i, i + 2 * TILE), slice(j, j + 4 * TILE)
            off = 4 * (a.shape[1] + 4) * float(np.finfo(kind).eps) * 2 * float(half[0][p].max() + half[1][q].max()) + 1e-35 * a.shape[1]
            least = -radius * radius / 2 - off
            hits = np.flatnonzero(((x[p] @ y[q].T) >= least).ravel()) if np.isfinite(off) else np.arange(len(a[p]) * len(b[q]))
            width = len(b[q])
            for k in range(0, len(hits), AGAIN):
                r, c = np.divmod(hits[k : k + AGAIN], width)
                r, c = r + i, c + j
                keep = exact("euclid", a[r], b[c]) < radius
                if keep.any():
                    yield r[keep], c[keep]


def batch_task(queries, kinds: Sequence[str], scale: Scale, columns: Sequence[str], key: str, names: Sequence[str], most: float, k: int | None):
    """A function over Arrow batches: ``query, key, distance`` under ``names`` of pairs within ``most``, or of the ``k`` nearest of every query in a task.

    ``queries`` is a broadcast of ``{lengths: (keys, matrices)}``.
    """

    def rows(ids: np.ndarray, keys: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(d, pa.float64())], names=list(names))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        held = {lengths: Nearest(len(ids), k) for lengths, (ids, _) in asked.items()} if k else {}
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(key)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for lengths, at, matrices in grouped(batch, columns):
                if lengths not in asked:
                    continue
                ids, wanted = asked[lengths]
                if k:
                    held[lengths].add(kinds, scale, wanted, matrices, own[at])
                    continue
                for q, r, d in within(kinds, scale, wanted, matrices, most):
                    yield rows(ids[q], own[at][r], d)
        for lengths, best in held.items():
            there = np.arange(k)[None, :] < best.held[:, None]
            ids = np.repeat(asked[lengths][0], k).reshape(-1, k)
            yield rows(ids[there], best.keys[there], best.d[there])

    return one


def chunk_task(single: bool):
    """A function over Arrow batches of ``block, id, n, hashes, v``: a row a block and batch, with these packed."""
    kind = np.float32 if single else np.float64

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            hashes = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            blocks, packed = [], []
            for at, v in vectors(batch.column(4)):
                for b in np.unique(block[at]):
                    own = block[at] == b
                    blocks.append(int(b))
                    packed.append(pickle.dumps((ids[at][own], n[at][own], hashes[at][own], v[own].astype(kind)), protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])

    return one


def links_task(radius: float):
    """A function over a group of ``a, b, block, packed``, two blocks of classes: ``id, links`` for those with links, counting rows of the other class."""

    def one(table: pa.Table) -> pa.Table:
        first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        sides: dict[int, dict[int, list]] = {first: {}, second: {}}
        for block, packed in zip(table.column("block").to_pylist(), table.column("packed")):
            part = pickle.loads(packed.as_py())
            sides[block].setdefault(part[3].shape[1], []).append(part)
        ids, links = [], []
        for width in sides[first].keys() & sides[second].keys():
            x, y = ([np.concatenate(p) for p in zip(*sides[s][width])] for s in (first, second))
            here, there = np.zeros(len(x[0]), np.int64), np.zeros(len(y[0]), np.int64)
            for r, c in close(x[3].astype(np.float64), y[3].astype(np.float64), radius):
                keep = (x[2][r] == y[2][c]).any(axis=1)
                if first == second:
                    keep &= r != c
                r, c = r[keep], c[keep]
                here += np.bincount(r, y[1][c], len(here)).astype(np.int64)
                if first != second:
                    there += np.bincount(c, x[1][r], len(there)).astype(np.int64)
            for own, got in ((x[0], here), (y[0], there)):
                ids.append(own[got > 0])
                links.append(got[got > 0])
        return pa.table({"id": pa.array(np.concatenate(ids) if ids else [], pa.int64()), "links": pa.array(np.concatenate(links) if links else [], pa.int64())})

    return one


def leaf_task(nodes, kind: str, most: float, levels: int, column: str):
    """A function over Arrow batches with ``leaf`` and vectors in ``column``: the batches with the leaves ``levels`` levels down.

    ``nodes`` is a broadcast of ``{node: (vantage point, reach)}``; rows
    without a distance from a vantage point go to leaf 0.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {len(v) for v, _ in nodes.value.values()}:
            own = [n for n, (v, _) in nodes.value.items() if len(v) == width]
            points[width] = (np.array([nodes.value[n][0] for n in own], dtype=float).reshape(len(own), width), np.array([nodes.value[n][1] for n in own]), np.array(own))
        inner = np.array(sorted(nodes.value), dtype=np.int64)
        for batch in batches:
            place = batch.schema.get_field_index("leaf")
            leaf = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            found = list(vectors(batch.column(batch.schema.get_field_index(column)), nan=True))
            for _ in range(levels):
                cut = np.isin(leaf, inner)
                if not cut.any():
                    break
                down = np.zeros_like(leaf)  # a vector of another length than the point's, or with a null, has no distance
                for at, v in found:
                    vantage, reach, own = points.get(v.shape[1], (None, None, np.zeros(0, np.int64)))
                    here = np.isin(leaf[at], own)
                    if not here.any():
                        continue
                    order = np.argsort(own)
                    k = order[np.searchsorted(own, leaf[at][here], sorter=order)]
                    d = exact(kind, vantage[k], v[here]) / most
                    # NaN is more than any number, as in the plan's comparison.
                    down[at[here]] = 2 * leaf[at][here] + (np.isnan(d) & ~np.isnan(reach[k]) | (d > reach[k]))
                leaf = np.where(cut, down, leaf)
            yield batch.set_column(place, "leaf", pa.array(leaf, pa.int32()))

    return one
