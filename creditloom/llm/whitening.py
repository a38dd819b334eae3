"""Embedding whitening by spectrum slicing."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole components beyond this size count as this size, so that sums of products stay exact.
MOST = 2**36
#: Eigenvalues below this share of the largest count as zero: their direction holds no data to scale.
FLAT = 1e-12


@dataclass
class Whitener:
    """``n`` vectors with sums ``total`` per dimension; rows of ``vectors`` are unit eigenvectors by falling ``values``."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        base = self.total // self.n  # whole part first: what is left is small, so nothing is lost in doubles
        rest = (self.total - base * self.n).astype(float) / self.n
        return ((x - base).astype(float) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - total)^2``, exact; none where a long cannot hold it."""
        limit = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.total).max(initial=0))
        if limit**2 * max(1, x.shape[1]) < 2**63:
            return ((self.n * x - self.total) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - self.total.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def below(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below ``shift``: negative pivots of an LDLᵀ factorisation of ``a - shift``.

    By Sylvester's law D has the inertia of the matrix.  Pivots are single entries or blocks of two (Bunch and
    Kaufman's choice), so the factors stay bounded.
    """
    m = a - shift * np.eye(len(a))
    bound = (1 + 17**0.5) / 8
    k, n, count = 0, len(m), 0
    while k < n:
        column = np.abs(m[k + 1 :, k])
        most = column.max(initial=0.0)
        pair = False
        if most > 0 and abs(m[k, k]) < bound * most:
            r = k + 1 + int(column.argmax())
            other = np.abs(m[k:, r])
            other[r - k] = 0
            sigma = other.max()
            if abs(m[k, k]) * sigma < bound * most * most:
                pair = abs(m[r, r]) < bound * sigma
                to = k + 1 if pair else k
                if to != r:
                    m[[to, r], :] = m[[r, to], :]
                    m[:, [to, r]] = m[:, [r, to]]
        if pair:
            block, beside = m[k : k + 2, k : k + 2], m[k + 2 :, k : k + 2]
            count += 1  # a block chosen so has one negative and one positive eigenvalue
            m[k + 2 :, k + 2 :] -= beside @ np.linalg.solve(block, beside.T)
            k += 2
        else:
            pivot = m[k, k]
            count += bool(pivot < 0)
            if pivot:
                m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k] / pivot, m[k + 1 :, k])
            k += 1
    return count


def isolate(a: np.ndarray, k: int) -> list[tuple[float, float, int, int]]:
    """Intervals ``[low, high)`` that hold the ``k`` largest eigenvalues, by falling values: low, high, number of the first, how many.

    Slices are halved until each holds one, or is too narrow to be told apart; counts give the numbers.
    """
    n = len(a)
    size = np.abs(a).sum(axis=1).max()  # no eigenvalue lies beyond it
    tight = 4 * n * np.finfo(float).eps * size
    edge = size + tight
    found, todo = [], [(-edge, edge, 0, n)]  # eigenvalues below each end
    while todo:
        low, high, under, upto = todo.pop()
        first = n - upto + 1
        if under == upto or first > k:
            continue
        if upto - under == 1 or high - low <= tight:
            found.append((low, high, first, upto - under))
            continue
        middle = (low + high) / 2
        count = min(max(below(a, middle), under), upto)
        todo += [(low, middle, under, count), (middle, high, count, upto)]
    return sorted(found, key=lambda f: f[2])


def _solved(a: np.ndarray, shift: float, x: np.ndarray, tiny: float) -> np.ndarray:
    """Direction of ``(a - shift)^-1 x``; a shift that hits an eigenvalue is moved by ``tiny``."""
    for nudge in (0.0, tiny, -3 * tiny, 7 * tiny):
        try:
            y = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), x)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(y)
        if np.isfinite(size) and size > 0:
            return y / size
    raise ArithmeticError("no direction found")


def eigenpairs(a: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix and their unit vectors (rows; the largest entry is positive).

    Each eigenvalue is isolated by inertia counts.  Inverse iteration inside its interval finds the direction, Rayleigh
    quotient iteration sharpens it; a quotient that leaves the interval halves the interval by a count and starts
    anew, so the number of each pair is certified.  Eigenvalues too close to be told apart share an interval and get
    vectors orthogonal to those found before.
    """
    n = len(a)
    k = min(k, n)
    if not np.any(a):
        return np.zeros(k), np.eye(n)[:k]
    rng = np.random.default_rng(seed)
    values, vectors = [], []
    tiny = 4 * n * np.finfo(float).eps * max(np.abs(a).sum(axis=1).max(), 1e-290)
    for low, high, first, many in isolate(a, k):
        for number in range(first, min(first + many, k + 1)):
            base = np.array(vectors).reshape(-1, n)  # kept out of the iteration: close neighbours would draw it to themselves
            while True:
                x = rng.normal(size=n)
                value, trusted, before = (low + high) / 2, False, np.inf
                for _ in range(60):
                    x = _solved(a, value if trusted else (low + high) / 2, x - base.T @ (base @ x), tiny)
                    x -= base.T @ (base @ x)
                    x /= np.linalg.norm(x)
                    value = float(x @ a @ x)
                    residual = np.linalg.norm(a @ x - value * x)
                    if residual <= tiny or residual <= 1e6 * tiny and residual > 0.5 * before:
                        break
                    trusted, before = low <= value < high and residual < 0.1 * (high - low), residual
                if below(a, value - 4 * tiny) <= n - number < below(a, value + 4 * tiny) or high - low <= tiny:
                    break
                middle = (low + high) / 2  # the quotient ran away: narrow the interval and begin again
                if below(a, middle) > n - number:
                    high = middle
                else:
                    low = middle
            values.append(value)
            vectors.append(x if x[np.abs(x).argmax()] > 0 else -x)
    return np.array(values), np.array(vectors).reshape(-1, n)


def whole_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, x``: components as ``floor(scale * component) + offset`` (before the offset at most ``MOST`` in size).

    Left out: null and empty vectors, and those with null or non-finite components.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    held = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * scale))
    return vectors.where(good).select("vec_id", F.transform(v, lambda c: F.floor(held(c)).cast("bigint") + offset).alias("x"))


def _matrix(column, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, length)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number and sums per dimension of the vectors of the commonest length (ties: the longer); tasks sum first."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            column = batch.column("x")
            lengths = np.diff(np.asarray(column.offsets))
            for length in np.unique(lengths).tolist():
                x = _matrix(column.filter(pa.array(lengths == length)), length)
                held = sums.setdefault(length, [0, [0] * length])
                held[0] += len(x)
                held[1] = [a + b for a, b in zip(held[1], x.sum(axis=0).tolist())]
        for length, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array(total, pa.int64())],
                names=["length", "dim", "n", "total"],
            )

    partial = rows.select("x").mapInArrow(run, "length int, dim int, n bigint, total bigint")
    summed = partial.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    common = summed.where("dim = 0").orderBy(F.col("n").desc(), F.col("length").desc()).limit(1).collect()
    if not common:
        return 0, []
    got = summed.where(F.col("length") == common[0]["length"]).select("dim", "total").collect()  # one row a dimension
    return common[0]["n"], [int(r["total"]) for r in sorted(got, key=lambda r: r["dim"])]


def _covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the vectors: tasks multiply whole numbers centred at the rounded mean, and the rest of the mean is taken off exactly."""
    d = len(total)
    middle = [(2 * s + n) // (2 * n) for s in total]

    def run(batches):
        sums = None
        base = np.array(middle, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column("x"), d) - base
            most = int(np.abs(y).max())
            if most * most * len(y) < 2**53:  # exact in doubles
                product = (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
            else:
                product = y.T.astype(object) @ y.astype(object)
            sums = product if sums is None else sums + product
        if sums is not None:
            i, j = np.triu_indices(d)
            text = pa.array([str(v) for v in sums[i, j]])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), text], names=["i", "j", "s"])

    partial = rows.where(F.size("x") == d).select("x").mapInArrow(run, "i int, j int, s string")
    summed = partial.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # d * (d + 1) / 2 rows
    out = np.zeros((d, d))
    left = [s - n * m for s, m in zip(total, middle)]
    for r in summed:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = float(Fraction(n * int(r["s"]) - left[r["i"]] * left[r["j"]], n * n))
    return out


def fit(rows: DataFrame, k: int = 32) -> Whitener | None:
    """Sums, covariance and the ``k`` leading components of ``whole_vectors``; none without rows.

    The driver gets ``d * d`` numbers for vectors of ``d`` components, however many rows there are.
    """
    n, total = _sums(rows)
    if not n:
        return None
    covariance = _covariance(rows, n, total)
    values, vectors = eigenpairs(covariance, k)
    good = values > FLAT * max(values.max(initial=0.0), 0.0)
    return Whitener(n, np.array(total, dtype=np.int64), values[good], vectors[good], float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity.

    Tasks sum products of centred values and round them to multiples of 2^-40, so the total depends on no order.
    """
    k, d = model.vectors.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)  # k * d numbers
    unit = 2.0**40

    def run(batches):
        sums = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = shared.value.apply(_matrix(batch.column("x"), d))
                sums[:k] += w.T @ w
                sums[k] += w.sum(axis=0)
        i, j = np.indices(sums.shape).reshape(2, -1)
        text = pa.array([str(int(round(v * unit))) for v in sums.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), text], names=["i", "j", "s"])

    partial = rows.where(F.size("x") == d).select("x").mapInArrow(run, "i int, j int, s string")
    got = partial.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # (k + 1) * k rows
    sums = np.zeros((k + 1, k))
    for r in got:
        sums[r["i"], r["j"]] = float(Fraction(int(r["s"]), int(unit) * model.n))
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Every usable row's whitened components: one row per vector and component, numbered from 1 by falling eigenvalue.

    All rows are fitted: tasks sum whole numbers exactly, the driver slices the spectrum of the covariance of at most a
    few thousand dimensions, and rows are projected where they lie; nothing is shuffled but the tasks' sums.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored.  Rows without a vector or with null or non-finite
    components are left out (see ``whole_vectors``), and so are vectors of another length than most (ties: the longer).
    A null id is kept; repeated rows count one by one.  Directions without spread (as with equal vectors, or fewer rows
    than components) give no component; no rows give an empty result.
    Returns ``vec_id, component, n, deviation`` (null where a long cannot hold it), ``whitened, explained, identity_error``.
    """
    rows = whole_vectors(vectors, scale, offset)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(rows, k)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    count, d = model.vectors.shape

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d)
            rows = len(x)
            where = pa.array(np.repeat(np.arange(rows), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(where),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, m.n, dtype=np.int64)),
                    pa.array(m.deviations(x), pa.int64()).take(where),
                    pa.array(m.apply(x).ravel()),
                    pa.array(np.tile(m.values / m.trace, rows)),
                    pa.array(np.full(rows * count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == d).mapInArrow(run, schema)
