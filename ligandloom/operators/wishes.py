"""Rows and choices within tolerances, block by block in numpy: all pairs, or the nearest of each row and the row-by-row walk over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

WISHES = 64  # choices that a row brings to the walk
TURNS = 16  # members of a group of equal choices whose order it brings along
BLOCK = 1 << 20  # distances computed at once
ROWS_AT_ONCE = 256
SLACK = 1.0001

WISH = "array<struct<dist: double, turn: bigint, u: bigint, pos: bigint, cap: bigint, turns: array<bigint>>>"
FIELDS = ("dist", "turn", "u", "pos", "cap", "turns")


def numbers(table: pa.Table | pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """(rows, columns) of doubles."""
    return np.column_stack([np.asarray(table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in columns])


class Choices:
    """Choices sorted by the properties without tolerance and the first with one, so a row meets a slice of them."""

    def __init__(self, table: pa.Table, columns: Sequence[str], tolerance: Sequence[float]):
        self.tolerance = [float(t) for t in tolerance]
        self.equal = [i for i, t in enumerate(tolerance) if t == 0]
        self.first = [i for i, t in enumerate(tolerance) if t > 0][:1]
        values = numbers(table, columns)
        order = self.order(values)
        self.values, self.table = values[order], table.take(pa.array(order)).combine_chunks()
        self.runs = {key: (a, b) for key, a, b in self.cut(self.values)}

    def order(self, values: np.ndarray) -> np.ndarray:
        keys = [values[:, i] for i in (*self.equal, *self.first)]
        return np.lexsort(keys[::-1]) if keys else np.arange(len(values))

    def cut(self, values: np.ndarray) -> Iterator[tuple[tuple, int, int]]:
        """(key, from, to) of each run of sorted rows that are equal where there is no tolerance."""
        key = values[:, self.equal]
        ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        a = 0
        for b in ends if len(values) else []:
            if np.isfinite(key[a]).all():
                yield tuple(key[a].tolist()), a, b
            a = b

    def blocks(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(rows, first choice, distances, which are within the tolerance) of some rows and a slice of the choices at a time."""
        order = self.order(values)
        ranked = values[order]
        for key, a, b in self.cut(ranked):
            lo, hi = self.runs.get(key, (0, 0))
            step = min(ROWS_AT_ONCE, max(1, BLOCK // max(1, hi - lo)))
            for at in range(a, b if hi > lo else a, step):
                x = ranked[at : min(at + step, b)]
                start, end = lo, hi
                for i in self.first:
                    reach = self.tolerance[i] * SLACK
                    start = lo + np.searchsorted(self.values[lo:hi, i], x[0, i] - reach)
                    end = lo + np.searchsorted(self.values[lo:hi, i], x[-1, i] + reach, "right")
                if end <= start:
                    continue
                total, near = np.zeros((len(x), end - start)), np.ones((len(x), end - start), bool)
                for i, t in enumerate(self.tolerance):
                    if t:
                        apart = np.abs(self.values[None, start:end, i] - x[:, None, i])
                        near &= apart <= t
                        apart /= t
                        total += apart
                yield order[at : at + len(x)], start, total, near

    def pairs(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, choice) of all that are within the tolerance, some at a time."""
        for rows, start, _, near in self.blocks(values):
            row, choice = np.nonzero(near)
            if len(row):
                yield rows[row], start + choice

    def nearest(self, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, choice, distance) of the ``k`` first choices of each row and all that tie with the last, and which rows have more."""
        more = np.zeros(len(values), bool)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows, start, total, near in self.blocks(values):
            total[~near] = np.inf
            more[rows] = near.sum(axis=1) > k
            if near.shape[1] > k:
                near &= total <= np.partition(total, k - 1, axis=1)[:, k - 1 : k]
            row, choice = np.nonzero(near)
            found.append((rows[row], start + choice, total[near]))
        row, choice, dist = (np.concatenate(x) for x in zip(*found))
        return row, choice, dist, more


def add_wishes(batch: pa.RecordBatch, choices: Choices, columns: Sequence[str], k: int) -> tuple[pa.ListArray, np.ndarray]:
    """(wishes, more): the ``k`` first of what the rows wished so far and of these choices, nearest first (ties: lowest turn)."""
    row, choice, dist, more = choices.nearest(numbers(batch, columns), k)
    old = batch.column("wishes")
    mine = choices.table.select(FIELDS[1:]).take(pa.array(choice)).combine_chunks()
    new = [pa.array(dist), *(mine[c].chunk(0) if mine[c].num_chunks else pa.array([], mine[c].type) for c in FIELDS[1:])]
    kind = old.type.value_type
    flat = pa.concat_arrays([old.flatten(), pa.StructArray.from_arrays([c.cast(kind.field(i).type) for i, c in enumerate(new)], fields=list(kind))])
    row = np.concatenate([np.repeat(np.arange(len(old)), old.value_lengths().to_numpy()), row])
    order = np.lexsort([flat.field(1).to_numpy(), flat.field(0).to_numpy(), row])
    row = row[order]
    size = np.bincount(row, minlength=len(old))
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    more |= batch.column("more").to_numpy(zero_copy_only=False) | (size > k)
    ends = np.cumsum(np.r_[0, np.minimum(size, k)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(order[place < k])), type=old.type), more


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, u, pos, dist) of the row-by-row loop: each row in turn takes the first of its wishes that has room.

    A row that cannot be settled with what it brought, as all its wishes went to rows before it and it has more, or as the order of
    members that tie is not known so far, ends the walk: it comes out without a choice, rows behind it do not come out.
    """
    used: dict[int, int] = {}
    stop = False
    for batch in batches:
        out: list[tuple] = []
        lists = batch.column("wishes")
        ends, flat = lists.offsets.to_pylist(), lists.values
        dist, turn, u, pos, cap = (flat.field(i).to_numpy().tolist() for i in range(5))
        for k, (at, more) in enumerate(zip(batch.column("at").to_pylist(), batch.column("more").to_pylist())):
            if stop:
                break
            lo, hi = ends[k], ends[k + 1]
            i = next((i for i in range(lo, hi) if used.get(u[i], 0) < cap[i]), None)
            if i is None:
                if more:
                    stop = True
                    out.append((at, None, None, None))
                continue
            tied = [j for j in range(i, hi) if dist[j] == dist[i] and used.get(u[j], 0) < cap[j]] if i + 1 < hi and dist[i + 1] == dist[i] else [i]
            edge = more and dist[hi - 1] == dist[i]  # choices beyond the list may be as near
            if len(tied) > 1 or edge and used.get(u[i], 0):
                known = [(used.get(u[j], 0), flat.field(5)[j].as_py(), j) for j in tied]
                turns = [(turn[j] if not n else t[n] if n < len(t) else None, j) for n, t, j in known]
                if any(t is None for t, _ in turns) or edge and min(turns)[0] > turn[hi - 1]:
                    stop = True
                    out.append((at, None, None, None))
                    continue
                i = min(turns)[1]
            n = used.get(u[i], 0)
            used[u[i]] = n + 1
            out.append((at, u[i], pos[i] + n, dist[i]))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["at", "u", "pos", "dist"])
