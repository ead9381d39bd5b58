"""The algebra of one LD block on its entries: an ordering with little fill, L D L',
solves, log-determinant and the inverse's diagonal.  Memory follows the entries of L."""

from __future__ import annotations

import heapq

import numpy as np

from .precision import Block

#: A factor with more than this share of a full triangle is kept as a dense matrix.
DENSE = 0.25


def least_degree_order(n: int, i: np.ndarray, j: np.ndarray, most: int | None = None) -> np.ndarray | None:
    """An elimination order by least degree, ties by index; None if L would have more than
    ``most`` entries below its diagonal."""
    beside: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if a != b:
            beside[a].add(b)
            beside[b].add(a)
    heap = [(len(s), k) for k, s in enumerate(beside)]
    heapq.heapify(heap)
    order, gone, entries = [], np.zeros(n, bool), 0
    while heap:
        degree, k = heapq.heappop(heap)
        if gone[k] or degree != len(beside[k]):
            continue
        gone[k] = True
        order.append(k)
        around, beside[k] = beside[k], set()
        entries += len(around)
        if most is not None and entries > most:
            return None
        for a in around:
            beside[a] |= around
            beside[a] -= {a, k}
            heapq.heappush(heap, (len(beside[a]), a))
    return np.array(order, np.int64)


class Graph:
    """Places of the entries (one triangle, no diagonal) and, in elimination order, of L's."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray | None = None):
        self.n, self.i, self.j = n, np.asarray(i, np.int64), np.asarray(j, np.int64)
        self._order, self._columns = None if order is None else np.asarray(order, np.int64), None

    @property
    def order(self) -> np.ndarray:
        if self._order is None:
            self._order = least_degree_order(self.n, self.i, self.j)
        return self._order

    @property
    def columns(self) -> list[np.ndarray]:
        """Rows below the diagonal of every column of L, ascending: a column's rows but the first
        are rows of the column named by the first."""
        if self._columns is None:
            place = np.empty(self.n, np.int64)
            place[self.order] = np.arange(self.n)
            self.place = place
            a, b = place[self.i], place[self.j]
            below: list[set[int]] = [set() for _ in range(self.n)]
            for lo, hi in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
                below[lo].add(hi)
            out = []
            for k in range(self.n):
                rows = np.array(sorted(below[k]), np.int64)
                out.append(rows)
                if len(rows):
                    below[rows[0]].update(rows[1:].tolist())
                below[k] = set()
            self._columns = out
            self._across: list[list[int]] = [[] for _ in range(self.n)]
            for k, rows in enumerate(out):
                for r in rows.tolist():
                    self._across[r].append(k)
        return self._columns

    @property
    def across(self) -> list[list[int]]:
        """Columns with an entry in every row of L, ascending."""
        self.columns  # noqa: B018
        return self._across


class Factor:
    """L D L' of a symmetric matrix, row by row (up-looking)."""

    def __init__(self, graph: Graph, off: np.ndarray, diagonal: np.ndarray):
        columns, across, n = graph.columns, graph.across, graph.n
        self.graph, self.values, self.d = graph, [np.zeros(len(c)) for c in columns], np.zeros(n)
        a, b = graph.place[graph.i], graph.place[graph.j]
        row, col = np.maximum(a, b), np.minimum(a, b)
        by = np.argsort(row, kind="stable")
        row, col, off = row[by], col[by], np.asarray(off, float)[by]
        starts = np.searchsorted(row, np.arange(n + 1))
        own = np.asarray(diagonal, float)[graph.order]
        filled, x = np.zeros(n, np.int64), np.zeros(n)
        for k in range(n):
            s = slice(starts[k], starts[k + 1])
            np.add.at(x, col[s], off[s])
            d = own[k]
            for j in across[k]:
                v, at = x[j], filled[j]
                x[j] = 0.0
                if at:
                    x[columns[j][:at]] -= self.values[j][:at] * v
                scaled = v / self.d[j]
                d -= scaled * v
                self.values[j][at] = scaled
                filled[j] = at + 1
            if d == 0:
                raise np.linalg.LinAlgError("singular block")
            self.d[k] = d

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, columns = np.array(b, float)[self.graph.order], self.graph.columns
        wide = x.ndim > 1
        for k, rows in enumerate(columns):
            if len(rows):
                x[rows] -= np.outer(self.values[k], x[k]) if wide else self.values[k] * x[k]
        x /= self.d[:, None] if wide else self.d
        for k in range(len(columns) - 1, -1, -1):
            if len(columns[k]):
                x[k] -= self.values[k] @ x[columns[k]]
        out = np.empty_like(x)
        out[self.graph.order] = x
        return out

    def logdet(self) -> float:
        return float(np.log(np.abs(self.d)).sum())

    def inverse_diagonal(self) -> np.ndarray:
        """From the last column back: the inverse is only found where L has entries."""
        columns, n = self.graph.columns, self.graph.n
        z, diagonal = [np.zeros(len(c)) for c in columns], np.zeros(n)
        for k in range(n - 1, -1, -1):
            rows, v = columns[k], self.values[k]
            if not len(rows):
                diagonal[k] = 1 / self.d[k]
                continue
            inner = np.diag(diagonal[rows])
            for t, r in enumerate(rows[:-1].tolist()):
                part = z[r][np.searchsorted(columns[r], rows[t + 1:])]
                inner[t + 1:, t] = part
                inner[t, t + 1:] = part
            z[k] = -inner @ v
            diagonal[k] = 1 / self.d[k] - z[k] @ v
        out = np.empty(n)
        out[self.graph.order] = diagonal
        return out

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """A draw with the inverse as covariance."""
        columns = self.graph.columns
        x = rng.standard_normal(self.graph.n) / np.sqrt(self.d)
        for k in range(len(columns) - 1, -1, -1):
            if len(columns[k]):
                x[k] -= self.values[k] @ x[columns[k]]
        out = np.empty_like(x)
        out[self.graph.order] = x
        return out


class SparseBlock(Block):
    """A block on its entries; the same numbers as the dense form."""

    def __init__(self, graph: Graph, off: np.ndarray, diagonal: np.ndarray, selected: np.ndarray | None = None):
        self.graph, self.off, self.own = graph, np.asarray(off, float), np.asarray(diagonal, float)
        self.selected = np.arange(graph.n) if selected is None else np.asarray(selected)
        self._factor: Factor | None = None
        self._rest: Factor | None = None

    @property
    def size(self) -> int:
        return self.graph.n

    @property
    def factor(self) -> Factor:
        if self._factor is None:
            self._factor = Factor(self.graph, self.off, self.own)
        return self._factor

    @property
    def nbytes(self) -> int:
        return self.off.nbytes + self.own.nbytes + self.graph.i.nbytes + self.graph.j.nbytes

    def __getitem__(self, which) -> SparseBlock:
        out = SparseBlock(self.graph, self.off, self.own, np.atleast_1d(self.selected[which]))
        out._factor = self._factor
        return out

    def diagonal(self) -> np.ndarray:
        return self.own[self.selected]

    def scaled(self, by: float) -> SparseBlock:
        return SparseBlock(self.graph, self.off * by, self.own * by, self.selected)

    def plus_diagonal(self, d) -> SparseBlock:
        own = self.own.copy()
        own[self.selected] += d
        if (own[self.selected] <= 0).any():
            raise ValueError("a diagonal element would not be positive")
        return SparseBlock(self.graph, self.off, own, self.selected)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        every = np.arange(self.size)
        i, j = np.concatenate([self.graph.i, every]), np.concatenate([self.graph.j, every])
        return i.astype(np.int32), j.astype(np.int32), np.concatenate([self.off, self.own]), self.graph.order.astype(np.int32)

    def product(self, x: np.ndarray) -> np.ndarray:
        """The whole matrix times ``x``, entry by entry."""
        off, own = (self.off[:, None], self.own[:, None]) if x.ndim > 1 else (self.off, self.own)
        y = own * x
        np.add.at(y, self.graph.i, off * x[self.graph.j])
        np.add.at(y, self.graph.j, off * x[self.graph.i])
        return y

    def _rest_factor(self) -> tuple[np.ndarray, Factor | None]:
        u = self.rest
        if self._rest is None and len(u):
            to = np.full(self.size, -1)
            to[u] = np.arange(len(u))
            keep = (to[self.graph.i] >= 0) & (to[self.graph.j] >= 0)
            self._rest = Factor(Graph(len(u), to[self.graph.i[keep]], to[self.graph.j[keep]]), self.off[keep], self.own[u])
        return u, self._rest

    def multiply(self, x: np.ndarray) -> np.ndarray:
        u, rest = self._rest_factor()
        full = self._whole(np.asarray(x, float))
        y = self.product(full)
        if not len(u):
            return y[self.selected]
        full[u] = -rest.solve(y[u])
        return self.product(full)[self.selected]

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self.factor.solve(self._whole(np.asarray(b, float)))[self.selected]

    def whole_solve(self, full: np.ndarray) -> np.ndarray:
        return self.factor.solve(full)

    def whole_diagonal(self) -> np.ndarray:
        return self.own

    def rest_logdet(self) -> float:
        _, rest = self._rest_factor()
        return rest.logdet() if rest is not None else 0.0

    def logdet(self) -> float:
        return self.factor.logdet() - self._of_rest()

    def correlations(self, indices: np.ndarray) -> np.ndarray:
        units = np.zeros((self.size, len(indices)))
        units[self.selected[indices], np.arange(len(indices))] = 1.0
        return self.factor.solve(units)[self.selected].T

    def correlation_row(self):
        return lambda index: self.correlations(np.array([index]))[0]

    def correlation(self) -> np.ndarray:
        return self.solve(np.eye(len(self)))

    def _exact_diagonal(self) -> np.ndarray:
        return self.factor.inverse_diagonal()[self.selected]

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        return self.factor.draw(rng)[self.selected]
