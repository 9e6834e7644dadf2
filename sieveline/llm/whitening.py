"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance of a fit list are found without the covariance itself: a pass over the list
returns the centred product XᵀXQ for a narrow block Q, summed from task to task, and only that product reaches the driver
(dimensions x block numbers). A Chebyshev polynomial of the covariance, built by its three-term recurrence with one pass a
degree, damps the spectrum below the block's least Ritz value; then the block is made orthonormal by QR and rotated by
Rayleigh-Ritz. It ends when it is certified: the residuals of the wanted pairs are at the precision of doubles, and nothing
above the least wanted eigenvalue is left beside the block - by the trace that is left, or else by a second block, started
at random and filtered at right angles to the first.

The fit list is every distinct integer vector once; sums are exact, entries are centred before they are multiplied, and the
divisor is the length of the list. Rows whose vector is null or empty, has null or non-finite entries or another length than
most are left out (``vectors.quantized``). Every other row is whitened, repeated rows and null keys too. Components whose
eigenvalue is not above the rounding errors of the first do not exist: fewer distinct vectors or dimensions give fewer of
them, a single distinct vector none. Equal eigenvalues have any basis of their space. An empty table gives an empty result.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import stored
from sieveline.llm.vectors import exact, matrix, quantized

COMPONENTS = 4
#: columns of the block beside the wanted ones, degree of the polynomial, and the residual by the first eigenvalue
SPARE, DEGREE, PRECISION = 28, 10, 1e-13
#: bytes of a tile of the fit list, were its entries longs
TILE = 1 << 22
_CELL = pa.schema([("at", pa.int32()), ("value", pa.float64())])
_SUM = pa.schema([("at", pa.int32()), ("value", pa.decimal128(38, 0)), ("rows", pa.int64()), ("most", pa.decimal128(38, 0))])


@dataclass
class Whitener:
    """Length and exact sums of the fit list, its greatest entry, and the pairs: eigenvalues, unit vectors as columns."""
    n: int
    sums: list
    most: int
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self):
        return self.values / self.trace if self.trace else self.values


_TILE = pa.schema([("d", pa.int32()), ("bits", pa.int32()), ("tile", pa.binary())])


def tiles(vectors: DataFrame, tile_bytes: int = TILE) -> DataFrame:
    """Vectors ``x``, many to a row and in the fewest bytes that hold them, so that a pass reads them at little cost."""
    def packed(parts):
        x = np.concatenate(parts)
        most = max(-int(x.min()), int(x.max()))
        bits = 16 if most < 1 << 15 else 32 if most < 1 << 31 else 64
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([bits], pa.int32()),
                                           pa.array([x.astype(f"<i{bits // 8}").tobytes()], pa.binary())], schema=_TILE)

    def pack(batches):
        parts, held = [], 0
        for batch in batches:
            x = matrix(batch)
            size = max(1, tile_bytes // (8 * max(1, x.shape[1])))
            for n in range(0, len(x), size):
                parts.append(x[n:n + size])
                held += len(parts[-1])
                if held >= size:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return vectors.mapInArrow(pack, "d int, bits int, tile binary")


def _read(batches):
    """The matrices of tiles."""
    for batch in batches:
        for d, bits, tile in zip(*(batch.column(c) for c in ("d", "bits", "tile"))):
            yield np.frombuffer(tile.as_buffer(), f"<i{bits.as_py() // 8}").reshape(-1, d.as_py())


def _moments(fit: DataFrame):
    """Rows, exact sums and the greatest absolute entry of the fit list."""
    def add(batches):
        sums, rows, most = None, 0, 0
        for x in _read(batches):
            top = max(-int(x.min()), int(x.max()), 0)
            part = exact(x, top * len(x)).sum(axis=0)
            sums = [int(a) + int(b) for a, b in zip(sums or [0] * x.shape[1], part)]
            rows, most = rows + len(x), max(most, top)
        if sums:
            d = len(sums)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(d), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
                pa.array([rows] * d, pa.int64()), pa.array([Decimal(most)] * d, pa.decimal128(38, 0))], schema=_SUM)

    got = fit.mapInArrow(add, "at int, value decimal(38,0), rows long, most decimal(38,0)").groupBy("at").agg(
        F.sum("value").cast("decimal(38,0)"), F.sum("rows"), F.max("most")).collect()
    got = sorted(map(tuple, got))
    return (int(got[0][2]), [int(r[1]) for r in got], max(int(r[3]) for r in got)) if got else (0, [], 0)


def centred(x, n: int, sums: list, most: int):
    """Exact n * x - S."""
    bound = 2 * n * most
    return exact(x, bound) * n - exact(np.array(sums, object), bound)


def _product(fit: DataFrame, mean, q):
    """XᵀXQ of the centred fit list divided by its length, and the trace of XᵀX so divided: one pass."""
    def multiply(batches):
        total, trace, rows = 0.0, 0.0, 0
        for x in _read(batches):
            z = x - mean
            total, trace, rows = total + z.T @ (z @ q), trace + float(np.einsum("ij,ij->", z, z)), rows + len(z)
        if rows:
            cells = np.concatenate([total.ravel(), [trace, float(rows)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], schema=_CELL)

    got = fit.mapInArrow(multiply, "at int, value double").groupBy("at").agg(F.sum("value")).collect()
    cells = np.array([r[1] for r in sorted(map(tuple, got))])
    return cells[:-2].reshape(q.shape) / cells[-1], cells[-2] / cells[-1]


def _ritz(times, q):
    """The block rotated to Ritz vectors, by falling value: values, vectors, and the covariance times the vectors."""
    vq = times(q)
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def _filtered(times, q, vq, cut, top, degree):
    """A Chebyshev polynomial of the covariance times q: small on [0, cut], 1 at ``top``; ``vq`` is the covariance times q."""
    half = cut / 2
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def leading(times, d: int, wanted: int, trace, seed: int = 0, spare: int = SPARE, degree: int = DEGREE):
    """The leading pairs of a positive semidefinite matrix known by ``times``, its product with a block.

    ``trace`` is called for the trace after the first product. Returns values and vectors of the wanted pairs, the greatest
    residual by the first value, and whether they are certified.
    """
    rng = np.random.default_rng(seed)
    width = min(d, wanted + spare)
    wanted = min(d, wanted)
    values, q, vq = _ritz(times, np.linalg.qr(rng.standard_normal((d, width)))[0])
    residual, before = np.inf, np.inf
    while True:
        top = values[0]
        if top <= 0:
            return values[:wanted], q[:, :wanted], 0.0, True
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top
        still = residual > before / 2  # rounding errors are reached
        if width == d or residual <= PRECISION or (still and residual <= 1e4 * PRECISION):
            rest = trace() - values[:width].sum()
            if width == d or rest < values[wanted - 1]:
                return values[:wanted], q[:, :wanted], residual, True
            # a second block at right angles to the first finds what that may have missed
            away = lambda y: y - q @ (q.T @ y)
            probe = np.linalg.qr(away(rng.standard_normal((d, min(width, d - width)))))[0]
            inner = lambda y: away(times(away(y)))
            cut = max(values[-1], 1e-6 * top)
            probe = away(_filtered(inner, probe, inner(probe), cut, 2 * top, degree))
            found, extra, _ = _ritz(inner, np.linalg.qr(probe)[0])
            if found[0] <= values[wanted - 1] * (1 + 1e-9):
                return values[:wanted], q[:, :wanted], residual, True
            q = np.linalg.qr(np.hstack([q[:, :width - extra.shape[1] // 2], extra[:, :extra.shape[1] // 2]]))[0]
            values, q, vq = _ritz(times, q)
            before = np.inf
            continue
        before = residual
        cut = max(values[-1], 1e-6 * top)
        y = _filtered(times, q, vq, min(cut, top / 2), top, degree)
        values, q, vq = _ritz(times, np.linalg.qr(y)[0])


def fit(rows: DataFrame, components: int = COMPONENTS, x: str = "x") -> Whitener:
    """The whitener of the distinct vectors ``x`` of ``rows``, with the greatest error of the whitened covariance."""
    distinct = rows.select(F.col(x).alias("x")).groupBy("x").agg(F.lit(1).alias("one")).drop("one")
    fit_list = stored(tiles(distinct), "whitening-fit")
    n, sums, most = _moments(fit_list)
    d = len(sums)
    mean = np.array([float(s) / n for s in sums]) if n else np.zeros(0)
    none = Whitener(n, sums, most, 0.0, np.zeros(0), np.zeros((d, 0)))
    if n < 2:
        return none
    traces = []

    def times(q):
        product, trace = _product(fit_list, mean, q)
        traces.append(trace)
        return product

    values, vectors, _, _ = leading(times, d, components, lambda: traces[0])
    real = values > max(values[0], 0) * d * 1e-14
    if not real.any():
        return none
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    found = Whitener(n, sums, most, traces[0], values, vectors)
    scaled = vectors / np.sqrt(values)
    covariance = scaled.T @ _product(fit_list, mean, scaled)[0]
    found.identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    return found


def transform(rows: DataFrame, model: Whitener, key: str = "vec_id", x: str = "x") -> DataFrame:
    """k, deviation (exact) and whitened (a number a component) of every row."""
    scaled = model.vectors / np.sqrt(model.values) / max(1, model.n)
    out = pa.schema([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    n, sums, most = model.n, model.sums, model.most
    kind = rows.schema[key]

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            z = centred(matrix(batch), n, sums, most)
            squares = exact(z, len(sums) * (2 * n * most) ** 2)
            deviation = [Decimal(int(v)) for v in (squares * squares).sum(axis=1)]
            white = z.astype(np.float64) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, max(1, white.shape[1]), dtype=np.int32)
                                             if white.shape[1] else np.zeros(len(z) + 1, np.int32), white.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(deviation, out.field(0).type), lists],
                                             names=["k", "deviation", "whitened"])

    return rows.select(F.col(key).alias("k"), F.col(x).alias("x")).mapInArrow(
        project, f"k {kind.dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS):
    """The whitener of all rows, and the rows as ``transform`` gives them."""
    held = stored(quantized(rows.select(F.col(key).alias("k"), F.col(vector).alias("v")), "v").select("k", "x"), "whitening-rows")
    model = fit(held, components)
    return model, transform(held, model, "k")


def digest(model: Whitener, rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row for each row and component; a deviation beyond a long is null."""
    explained = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.values) else F.array().cast("array<double>")
    return rows.select(F.col("k").alias(key), F.expr("try_cast(deviation AS long)").alias("deviation"),
                       F.posexplode(F.arrays_zip(F.col("whitened"), explained.alias("explained"))).alias("at", "c")).select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
