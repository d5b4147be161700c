"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Every entry c becomes the integer x = floor(1024 c) + 100000; the fit list is all valid vectors.

1. *Sums*: exact column sums, so a row is centred as (x - m) - (S - n m) / n with the integer m
   nearest to the mean; nothing is lost to the offset.
2. *Blockwise QR*: a task reduces its centred rows block by block to one triangle R, triangles
   are reduced in groups of ``FAN`` until one (width^2 numbers) is left for the driver.  The
   covariance is never formed: its eigenvalues are the squared singular values of R over n.
3. *Solver* (on the driver, width^2 numbers): Householder reflections make R bidiagonal; dqds
   finds all squared singular values (shifts between Newton's lower bound and the smallest
   twisted pivot, so they stay positive); for each leading value a twisted factorisation of
   B'B - value, begun at its smallest pivot, gives the vector, sharpened by Rayleigh quotients
   and kept orthogonal to those before it.
4. *Rows* are projected where they lie; directions (width x components) are sent to the tasks.

Defined cases: null and empty vectors and those with null or non-finite entries are dropped;
entries missing from shorter vectors count as c = 0; an entry of 2^37 or more in size raises
ValueError; repeated rows and null ids count and come back as often as they are there; a
component without variance (one row, equal rows, fewer dimensions) has null ``whitened``; tied
eigenvalues get some orthonormal basis; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
FAN = 32
BLOCK_ENTRIES = 1 << 20
LARGEST = 2.0 ** 47
EPS = float(np.finfo(float).eps)


# -- the solver: width^2 numbers, on the driver --------------------------------------------------
def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v, beta with (1 - beta v v') x along the first axis."""
    v = x.copy()
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or not np.abs(x[1:]).max(initial=0.0):
        return v, 0.0
    norm = scale * math.sqrt(float(((x / scale) ** 2).sum()))
    v[0] += math.copysign(norm, x[0])
    v /= v[0]
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transformation P of r = Q B P'."""
    a, n = r.astype(float).copy(), len(r)
    p = np.eye(n)
    for k in range(n):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * v, v @ a[k:, k:])
        if k < n - 2:
            v, beta = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, beta * v)
            p[:, k + 1:] -= np.outer(p[:, k + 1:] @ v, beta * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _pass(q: list, e: list, shift: float):
    """One differential qd transform with shift; None if the shift went past the smallest value."""
    qs, es, d = [], [], q[0] - shift
    for i in range(len(e)):
        if not d > 0:
            return None
        top = d + e[i]
        t = q[i + 1] / top
        qs.append(top)
        es.append(e[i] * t)
        d = d * t - shift
    return (qs + [d], es) if d >= 0 else None


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling, by dqds with deflation."""
    out = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while work:
        q, e, moved = work.pop()
        while q:
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            if e[-1] <= EPS * EPS * (q[-1] + moved) or e[-1] <= 1e-300:
                out.append(q.pop() + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (min(q[i], q[i + 1]) + moved)), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            pivot, pivots = q[-1], [q[-1]]                  # twisted pivots: 1 / diagonal of the inverse
            for i in range(len(e) - 1, -1, -1):
                pivot = pivot * (q[i] / (e[i] + pivot)) if pivot > 0 else 0.0
                pivots.append(pivot)
            least = min(pivots)
            low = 1.0 / sum(1.0 / x for x in pivots) if least > 0 else 0.0
            for shift in ((low + least) / 2, low * (1 - 4 * EPS), low / 2, 0.0):
                done = _pass(q, e, shift)
                if done:
                    q, e = done
                    moved += shift
                    break
            else:                                           # a zero pivot: the smallest value is moved itself
                q[-1] = 0.0
                e[-1] = 0.0
    return np.array(sorted((max(x, 0.0) for x in out), reverse=True))


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, before: np.ndarray) -> np.ndarray:
    """Unit eigenvector of B'B at about value, orthogonal to the columns of ``before``."""
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)))
    a = np.where(np.abs(diagonal) < EPS * size, EPS * size, diagonal)
    d, low = a ** 2, above / a[:-1]                         # B'B = L D L'
    tiny = EPS * EPS * size * size
    safe = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)

    def solve(value, place):
        s, up = np.empty(n), np.empty(max(0, n - 1))
        s[0] = -value
        for i in range(n - 1):
            up[i] = d[i] * low[i] / safe(d[i] + s[i])
            s[i + 1] = up[i] * low[i] * s[i] - value
        p, down = np.empty(n), np.empty(max(0, n - 1))
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            t = d[i] / safe(d[i] * low[i] ** 2 + p[i + 1])
            down[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        pivots = s + p + value
        at = int(np.argsort(np.abs(pivots), kind="stable")[place])
        z = np.zeros(n)
        z[at] = 1.0
        for i in range(at - 1, -1, -1):
            z[i] = -up[i] * z[i + 1]
        for i in range(at, n - 1):
            z[i + 1] = -down[i] * z[i]
        return z, pivots[at]

    best = None
    for place in range(n):                                  # the smallest pivot, others if that vector is taken
        now = value
        for _ in range(4):
            z, pivot = solve(now, place)
            norm = float(np.linalg.norm(z))
            if not math.isfinite(norm):
                break
            step = pivot / norm ** 2
            z = z / norm
            if abs(step) <= 2 * EPS * abs(now):
                break
            if abs(step) > 1e-6 * max(abs(value), tiny):    # off to another value: stay
                break
            now += step
        if not np.isfinite(z).all():
            continue
        rest = z - before @ (before.T @ z)
        rest -= before @ (before.T @ rest)
        left = float(np.linalg.norm(rest))
        if best is None or left > best[0]:
            best = (left, rest)
        if left > 0.5:
            break
    return best[1] / best[0]


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k largest squared singular values, right singular vectors as columns) of r."""
    size = float(np.abs(r).max(initial=0.0))
    if not size:
        return np.zeros(k), np.eye(len(r))[:, :k]
    diagonal, above, p = bidiagonal(r / size)
    values = dqds(diagonal, above)[:k]
    found = np.zeros((len(r), 0))
    for v in values:
        found = np.column_stack([found, twisted(diagonal, above, float(v), found)])
    w = p @ found
    first = w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])]
    return values * size ** 2, w * np.where(first < 0, -1.0, 1.0)


# -- Spark steps ---------------------------------------------------------------------------------
def _integers(column: pa.Array, width: int) -> np.ndarray:
    """x of every entry, rows x width."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.floor(SCALE * np.asarray(column.flatten()))
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError("an embedding entry of 2^37 or more in size")
    out = np.full((len(lengths), width), OFFSET, np.int64)
    out[np.arange(width) < lengths[:, None]] = values.astype(np.int64) + OFFSET
    return out


def _sums(batches):
    for batch in batches:
        column = batch.column(0)
        if len(column):
            x = _integers(column, int(np.diff(np.asarray(column.offsets)).max()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(axis=0)),
                 pa.array(np.full(x.shape[1], len(x)))], ["place", "total", "rows"])


class Centre(NamedTuple):
    n: int
    sums: list               # exact, per dimension

    @property
    def middle(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        m = self.middle
        return (x - m) - np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, m)])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exact."""
        m = self.middle
        x, rest = x - m, [s - self.n * int(c) for s, c in zip(self.sums, m)]
        most = (int(np.abs(x).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 62:
            return pa.array(((x * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = x.astype(object) * self.n - np.array(rest, object)
        from decimal import Context
        wide = Context(prec=40)
        return pa.array([wide.create_decimal(int(v)) for v in (exact * exact).sum(axis=1)], pa.decimal128(38, 0))


def _triangle(stack: list) -> np.ndarray:
    return np.linalg.qr(np.concatenate(stack), mode="r")


def _reduce(centre: Centre):
    width = len(centre.sums)
    rows = max(width, BLOCK_ENTRIES // width)

    def run(batches):
        r = None
        for batch in batches:
            x = _integers(batch.column(0), width)
            for i in range(0, len(x), rows):
                r = _triangle(([] if r is None else [r]) + [centre.rows(x[i:i + rows])])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])
    return run


def _combine(width: int):
    def run(batches):
        r = None
        for batch in batches:
            for got in batch.column(0).to_pylist():
                r = _triangle(([] if r is None else [r]) + [np.frombuffer(got).reshape(-1, width)])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])
    return run


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return (vectors.select(v.alias("v"), F.col(id_col).cast("long").alias("id"))
            .filter((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


class Whitening(NamedTuple):
    centre: Centre
    triangle: np.ndarray     # R of the centred rows
    values: np.ndarray       # eigenvalues of the covariance
    directions: np.ndarray   # width x components
    explained: np.ndarray

    @property
    def told(self) -> np.ndarray:
        """True for components whose variance is more than rounding."""
        return self.values > 64 * EPS * EPS * max(1.0, float((self.triangle ** 2).sum()) / self.centre.n)


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, id_col: str = "vec_id") -> Whitening | None:
    """Directions of all valid vectors; None if there are none."""
    rows = _valid(vectors, id_col, vec_col)
    sums = (rows.select("v").mapInArrow(_sums, "place int, total long, rows long").groupBy("place")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")).orderBy("place").collect())
    if not sums:
        return None
    n = max(s["rows"] for s in sums)
    # a batch's total covers its own width: rows of narrower batches hold c = 0 there
    centre = Centre(n, [int(s["total"]) + OFFSET * (n - s["rows"]) for s in sums])
    width = len(sums)
    parts = staged(rows.select("v").mapInArrow(_reduce(centre), "r binary"), "whitening-r")
    many = parts.count()
    while many > 1:
        groups = -(-many // FAN)
        parts = staged(parts.repartition(groups, F.pmod(F.xxhash64("r"), F.lit(groups)))
                       .mapInArrow(_combine(width), "r binary"), "whitening-r")
        many = parts.count()
    r = np.frombuffer(parts.first()["r"]).reshape(-1, width)
    r = np.concatenate([r, np.zeros((width - len(r), width))])
    values, directions = principal(r, min(components, width))
    total = float((r ** 2).sum())
    return Whitening(centre, r, values / n, directions, values / total if total else values * 0.0)


def _project(w: Whitening, x: np.ndarray) -> np.ndarray:
    scale = np.where(w.told, 1 / np.sqrt(np.where(w.told, w.values, 1.0)), 0.0)
    return (w.centre.rows(x) @ w.directions) * scale


def _moments(w: Whitening):
    def run(batches):
        total = 0.0
        for batch in batches:
            z = _project(w, _integers(batch.column(0), len(w.centre.sums)))
            z = np.column_stack([z, np.ones(len(z))])
            total = total + z.T @ z
        if not np.isscalar(total):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
                                              pa.array(total.ravel())], ["i", "j", "s"])
    return run


def identity_error(vectors: DataFrame, w: Whitening, vec_col: str = "embedding", id_col: str = "vec_id") -> float:
    """Largest entry of (covariance of the whitened rows - identity), measured over all rows."""
    k, n = len(w.values), w.centre.n
    got = (_valid(vectors, id_col, vec_col).select("v").mapInArrow(_moments(w), "i int, j int, s double")
           .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    m = np.zeros((k + 1, k + 1))
    for row in got:
        m[row["i"], row["j"]] = row["s"] / n
    error = np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k))[np.ix_(w.told, w.told)]
    return float(error.max(initial=0.0))


def _rows(w: Whitening, error: float):
    k = len(w.values)

    def run(batches):
        for batch in batches:
            x = _integers(batch.column(0), len(w.centre.sums))
            if not len(x):
                continue
            z = _project(w, x).ravel()
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(at), w.centre.n)), w.centre.deviations(x).take(pa.array(at)),
                 pa.array(z, mask=np.tile(~w.told, len(x))), pa.array(np.tile(w.explained, len(x))),
                 pa.array(np.full(len(at), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


ROW_SCHEMA = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation decimal, whitened, explained, identity_error)`` per valid row
    and component."""
    w = fit(vectors, vec_col, components, id_col)
    if w is None:
        return vectors.sparkSession.createDataFrame([], ROW_SCHEMA)
    return _valid(vectors, id_col, vec_col).mapInArrow(_rows(w, identity_error(vectors, w, vec_col, id_col)), ROW_SCHEMA)
