"""Algebra of one LD block: a precision matrix, some of whose indices are selected, in dense
form here and on its entries in ``sparse_block``.

The matrix stands for the inverse of the LD matrix of the selected indices: products
use the Schur complement over the unselected ones, solves restrict the full inverse.
"""

from __future__ import annotations

import numpy as np


class Block:
    known_rest_logdet: float | None = None

    def __init__(self, matrix: np.ndarray, selected: np.ndarray | None = None):
        self.matrix = np.asarray(matrix, float)
        self.selected = np.arange(len(self.matrix)) if selected is None else np.arange(len(self.matrix))[selected]
        self._inverse: np.ndarray | None = None

    @classmethod
    def from_entries(cls, i, j, v, n: int, order=None) -> Block:
        """One triangle of entries, mirrored; the diagonal counts once.  Sparse where the factor
        is, dense otherwise.  ``order`` is an elimination order found before (empty: dense)."""
        from .sparse_block import DENSE, Graph, SparseBlock, least_degree_order

        i, j, v = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(v, float)
        inner = i != j
        if order is None:
            most = int(DENSE * n * (n - 1) / 2)
            order = least_degree_order(n, i[inner], j[inner], most) if len(set(zip(i[inner].tolist(), j[inner].tolist(), strict=True))) <= most else None
        if order is not None and len(order):
            return SparseBlock(Graph(n, i[inner], j[inner], order), v[inner], np.bincount(i[~inner], v[~inner], n))
        m = np.zeros((n, n))
        np.add.at(m, (i, j), v)
        np.add.at(m, (j, i), np.where(inner, v, 0.0))
        return cls(m)

    @property
    def size(self) -> int:
        return len(self.matrix)

    @property
    def nbytes(self) -> int:
        return self.matrix.nbytes

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(float)

    def __getitem__(self, which) -> Block:
        out = Block(self.matrix, np.atleast_1d(self.selected[which]))
        out._inverse = self._inverse
        return out

    def __len__(self) -> int:
        return len(self.selected)

    @property
    def rest(self) -> np.ndarray:
        return np.setdiff1d(np.arange(self.size), self.selected)

    def diagonal(self) -> np.ndarray:
        """The selected diagonal elements."""
        return np.diag(self.matrix)[self.selected]

    def plus_element(self, i: int, v: float) -> Block:
        """One selected diagonal element changed."""
        d = np.zeros(len(self))
        d[i] = v
        return self.plus_diagonal(d)

    def inv(self):
        """The correlation matrix as a function of vectors."""
        return self.solve

    def scaled(self, by: float) -> Block:
        return Block(self.matrix * by, self.selected)

    def plus_diagonal(self, d) -> Block:
        m = self.matrix.copy()
        m[self.selected, self.selected] += d
        if (np.diag(m)[self.selected] <= 0).any():
            raise ValueError("a diagonal element would not be positive")
        return Block(m, self.selected)

    def multiply(self, x: np.ndarray) -> np.ndarray:
        s, u, m = self.selected, self.rest, self.matrix
        y = m[np.ix_(s, s)] @ x
        return y - m[np.ix_(s, u)] @ np.linalg.solve(m[np.ix_(u, u)], m[np.ix_(u, s)] @ x) if len(u) else y

    def _whole(self, b: np.ndarray) -> np.ndarray:
        full = np.zeros((self.size, *b.shape[1:]))
        full[self.selected] = b
        return full

    def solve(self, b: np.ndarray) -> np.ndarray:
        full = self._whole(np.asarray(b, float))
        x = self._inverse @ full if self._inverse is not None else np.linalg.solve(self.matrix, full)
        return x[self.selected]

    def variant_solve(self, b: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The correlation matrix times ``b``, both by variant; ``index`` is each one's index."""
        if len(b) != len(index):
            raise ValueError("as many values as indices are needed")
        return self.solve(np.bincount(index, b, len(self)))[index]

    def product(self, x: np.ndarray) -> np.ndarray:
        """The whole matrix, unselected indices too, times ``x``."""
        return self.matrix @ x

    def solve_iteratively(self, b: np.ndarray, tolerance: float = 1e-8, steps: int = 1000, like: Block | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """(solution, steps) by conjugate gradients, all right sides at once.  ``like`` is a block
        near this one whose factor is the preconditioner (else the diagonal is), ``start``
        a solution to begin with."""
        full = self._whole(np.asarray(b, float).reshape(len(self), -1))
        own = self.whole_diagonal()[:, None]
        nearly = (lambda r: r / own) if like is None else like.whole_solve
        x = np.zeros_like(full) if start is None else self._from_selected(start)
        r = full - self.product(x)
        z = nearly(r)
        p, rz = z.copy(), (r * z).sum(axis=0)
        goal = tolerance * np.maximum(1e-300, np.linalg.norm(full, axis=0))
        for k in range(steps + 1):
            left = np.linalg.norm(r, axis=0) > goal
            if not left.any():
                out = x[self.selected]
                return (out[:, 0] if np.ndim(b) == 1 else out), k
            q = self.product(p)
            step = np.where(left, rz / np.where(left, (p * q).sum(axis=0), 1.0), 0.0)
            x, r = x + step * p, r - step * q
            z = nearly(r)
            rz, before = (r * z).sum(axis=0), rz
            p = z + np.where(left, rz / np.where(left, before, 1.0), 0.0) * p
        raise ArithmeticError("conjugate gradients did not converge")

    def whole_solve(self, full: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.matrix, full)

    def whole_diagonal(self) -> np.ndarray:
        return np.diag(self.matrix)

    def _from_selected(self, start: np.ndarray) -> np.ndarray:
        """A solution on the selection carried to the unselected indices, whose right side is 0."""
        return self._whole(np.asarray(start, float).reshape(len(self), -1))

    def logdet(self) -> float:
        return float(np.linalg.slogdet(self.matrix)[1]) - self._of_rest()

    def _of_rest(self) -> float:
        """The unselected part's log-determinant, which changes of the selected diagonal leave
        as it is: what is known from before, else found."""
        return self.rest_logdet() if self.known_rest_logdet is None else self.known_rest_logdet

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, v, order) that ``from_entries`` takes; no order for a dense block."""
        i, j = np.nonzero(np.tril(self.matrix))
        return i.astype(np.int32), j.astype(np.int32), self.matrix[i, j], np.zeros(0, np.int32)

    def rest_logdet(self) -> float:
        u = self.rest
        return float(np.linalg.slogdet(self.matrix[np.ix_(u, u)])[1]) if len(u) else 0.0

    def correlations(self, indices: np.ndarray) -> np.ndarray:
        """Rows of the correlation matrix."""
        return self.correlation()[indices]

    def correlation_row(self):
        """A function that gives one row."""
        return self.correlation().__getitem__

    def _exact_diagonal(self) -> np.ndarray:
        return np.diag(self.correlation()).copy()

    def correlation(self) -> np.ndarray:
        """The inverse restricted to the selection; kept for further selections."""
        if self._inverse is None:
            self._inverse = np.linalg.inv(self.matrix)
        return self._inverse[np.ix_(self.selected, self.selected)]

    def inverse_diagonal(self, method: str = "exact", samples: int = 100, seed: int | None = None) -> np.ndarray:
        if method == "exact":
            return self._exact_diagonal()
        rng, n = np.random.default_rng(seed), len(self)
        probes = rng.choice([-1.0, 1.0], size=(n, min(samples, n) if method == "xdiag" else samples))
        y = self.solve(probes)
        if method == "hutchinson":
            return (probes * y).mean(axis=1)
        return xdiag(probes, y, self.solve)

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """A draw from N(0, inverse), on the selection."""
        chol = np.linalg.cholesky(self.matrix)
        return np.linalg.solve(chol.T, rng.standard_normal(len(self.matrix)))[self.selected]


def xdiag(probes: np.ndarray, y: np.ndarray, solve) -> np.ndarray:
    """The diagonal from ``y``, the inverse times the probes: each probe's residual is estimated
    with the low-rank part of the others.  One factor of all probes gives what leaving out
    each of them would, by the columns of R's inverse; dependent probes are left out one by one."""
    m = probes.shape[1]
    q, r = np.linalg.qr(y)
    steep = np.abs(np.diag(r))
    if steep.min() > 1e-8 * steep.max():
        s = np.linalg.inv(r).T
        s /= np.linalg.norm(s, axis=0)
        z = solve(q)
        qs = q @ s
        return (q * z).sum(axis=1) + (qs * (probes * (s * r).sum(axis=0) - z @ s)).mean(axis=1)
    out = np.zeros(len(y))
    for k in range(m):
        q, r = np.linalg.qr(np.delete(y, k, axis=1))
        q = q[:, np.abs(np.diag(r)) > 1e-8 * steep.max()]
        z = solve(q)
        out += (q * z).sum(axis=1) + probes[:, k] * (y[:, k] - q @ (z.T @ probes[:, k]))
    return out / m


def log_likelihood(pz: np.ndarray, m: Block) -> float:
    return -0.5 * (len(pz) * np.log(2 * np.pi) + m.logdet() + pz @ m.solve(pz))


def likelihood_gradient(pz: np.ndarray, m: Block, jacobian: np.ndarray | None = None, method: str = "exact", samples: int = 100, seed: int | None = None) -> np.ndarray:
    """By diagonal element, or by parameter through a Jacobian; the inverse's diagonal exactly
    or estimated with random probes."""
    b = m.solve(pz)
    node = -0.5 * (m.inverse_diagonal(method, samples, seed) - b * b)
    return node if jacobian is None else node @ jacobian


def likelihood_hessian(pz: np.ndarray, m: Block, jacobian: np.ndarray | None = None, method: str = "exact", samples: int = 100, seed: int | None = None) -> np.ndarray:
    """By parameter, or without a Jacobian the diagonal by diagonal element."""
    if jacobian is None:
        return -0.5 * m.solve(pz) ** 2 * m.inverse_diagonal(method, samples, seed)
    scaled = m.solve(pz)[:, None] * jacobian
    return -0.5 * scaled.T @ m.solve(scaled)
